"""Every core query against its SQL twin on the smallest tables, and the decode stages on odd files."""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as tf
from paperloom.model.writer import build
from paperloom.operators import decode
from paperloom.plans import engine, more, queries
from paperloom.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "events", "documents")


def _norm(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


ALL, ORACLE = queries.QUERIES | more.QUERIES | engine.QUERIES, queries.ORACLE | more.ORACLE | engine.ORACLE


@pytest.mark.parametrize("name", sorted(ALL))
def test_query_matches_sql(spark, db, name):
    df = ALL[name](spark, SF)
    got = Counter(tuple(map(_norm, r)) for r in df.select(*sorted(df.columns)).collect())
    cols = ", ".join(sorted(df.columns))
    assert got == Counter(tuple(map(_norm, r)) for r in db.execute(f"select {cols} from ({ORACLE[name]})").fetchall())


def test_odd_files_do_not_fail_the_job(spark):
    good = build([[("Hello", 10, 100, 10)]])
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"no pdf")), (3, None), (4, bytearray(good[:200]))], "doc_id long, content binary")
    rows = {r["doc_id"]: r for r in decode.files(df).collect()}
    assert rows[1]["page_count"] == 1 and rows[1]["open_error"] is None and rows[2]["open_error"] and rows[3]["open_error"]
    assert [(r["doc_id"], r["text"]) for r in decode.lines(df).where("doc_id < 4").collect()] == [(1, "Hello")]
    assert decode.spans(df.limit(0)).count() == 0


def test_native_functions(spark):
    df = spark.createDataFrame([("exam-\nple A-\nB", [["a,b", "c\td"]], [1.0, 0.0, 3.0])], "t string, c array<array<string>>, v array<double>")
    r = df.select(tf.dehyphenate(F.col("t")), tf.csv(F.col("c")), tf.tsv(F.col("c")), tf.upper_median(F.col("v")), tf.is_rtl(F.lit("אב"))).first()
    assert tuple(r) == ("example A-\nB", '"a,b",c\td', "a,b\tc d", 3.0, True)


def test_stream_equals_batch(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.pdf").write_bytes(build([[(f"file {i}", 10, 100, 10)]]))
    stream = ingest.stream_pdfs(spark, str(tmp_path), 2).withColumn("doc_id", F.regexp_extract("path", r"(\d)\.pdf", 1).cast("long"))
    q = decode.lines(stream).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["text"] for r in spark.sql("select text from arrived").collect()) == ["file 0", "file 1", "file 2"]
