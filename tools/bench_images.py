"""Images per second on generated 640x400 PNG signs: decode, detect, redact, re-scan, measure, encode, judge."""

from __future__ import annotations

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from redactflow import sources  # noqa: E402
from redactflow.image import ops  # noqa: E402
from redactflow.session import local_session, spread  # noqa: E402
from tests.helpers import bright_bands, sign, write_png  # noqa: E402


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 240
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for i in range(n):
        write_png(f"{folder}/sign_{i:04d}.png", sign(seed=i))
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    for _ in range(2):  # the first round starts the workers
        start = time.perf_counter()
        done = ops.anonymize_images(
            spread(sources.decode_images(spark, folder)), lambda: lambda rgb: [], lambda: bright_bands
        )
        clean = done.groupBy("route").count().collect()
        took = time.perf_counter() - start
    spark.stop()
    print({"images": n, "seconds": round(took, 2), "images_per_sec": round(n / took, 1), "routes": {r[0]: r[1] for r in clean}})


if __name__ == "__main__":
    main()
