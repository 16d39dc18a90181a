"""redactflow: anonymize, verify and route large text and image collections with Spark.

Every operator is a plain function ``DataFrame -> DataFrame`` or ``Column -> Column``; nothing runs until the
caller writes or collects. Sub-packages:

* ``functions``  column functions (hashes, names, secrets, vectors, boxes, time, batch sizes)
* ``sources``    file listings, images, audit records, events, manifests
* ``sinks``      keyed and append-only writers, export with verification
* ``operators``  screening, queue, QA, routing, verification, reports, text masking
* ``image``      raster operators run as Arrow UDFs
* ``plans``      composed flows and the registered queries
* ``streaming``  Structured Streaming versions of the flows
"""

from redactflow.config import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
