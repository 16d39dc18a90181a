"""Every registered query next to its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_oracle import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    frame = queries()[name](spark, FOLDER)
    got, got_names = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if name not in oracle_sql():
        assert got
        return
    cur = con.execute(oracle_sql()[name])
    want, want_names = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got_names == want_names
    assert got == want


def test_entry(spark):
    row = entry(spark).first()
    assert row["images_in_master"] == row["passed"] + row["failed"] > 0


def test_widths_that_two_formats_cannot_hold(spark, tmp_path):
    """Texts of more than 65,535 characters, whose number is the width, in every language."""
    rows = [(i, "x", lang, "web", n) for i, (lang, n) in enumerate((lang, n) for lang in ("en", "fr", "de", "es") for n in (0, 65_535, 65_536, 128_657))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["width"], r["height"], r["pixels"]) for r in queries()["image_dims_by_format"](spark, str(tmp_path)).collect()}
    assert got == {i: (n, 63, n * 63) for i, _, _, _, n in rows}
