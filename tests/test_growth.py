"""What keeps tasks bounded as tables grow: their rows, their batches, and pairs that are counted and not listed."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from paperloom.model.content import read
from paperloom.model.document import Pdf
from paperloom.model.fonts import Font
from paperloom.model.layout import lines, search
from paperloom.model.objects import Parser, PdfError, Ref
from paperloom.model.writer import build
from paperloom.operators import decode, relations
from paperloom.plans import more, queries
from paperloom.runtime import batched, sliced
from paperloom.sources import corpus


def _random_boxes(spark, seed: int):
    r, rows = random.Random(seed), []
    for i in range(400):
        x, y = r.choice([0, 8, 15.5, 16, 24, 31]) + r.randint(-20, 20), r.choice([0, 16, 32]) + r.randint(-9, 9)
        rows.append((r.randint(0, 1), r.randint(0, 2), i, float(x), float(y), float(x + r.randint(-1, 30)), float(y + r.randint(0, 20))))
    return spark.createDataFrame(rows, "doc_id long, page int, id long, x0 double, y0 double, x1 double, y1 double")


def test_pairs_of_boxes_are_counted_without_listing_them(spark, tmp_path):
    b = _random_boxes(spark, 3)
    left, right = b.where("id % 3 > 0"), b.where("id % 3 < 2")  # a third is on both sides
    listed = relations.overlaps(left, right, 16.0).groupBy("doc_id", "page").agg(F.count(F.lit(1)), F.sum("left_id"), F.sum("right_id"))
    counted = relations.overlap_sums(left, right, 16.0)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, listed.collect())) != []
    # 2 x 3,000 boxes at two places that meet: nine million pairs in one cell
    odd = next(r for r in range(7, 54_600, 14) if r * 37 % 600 < 50 and r * 91 % 780 < 20)
    p = spark.range(6000).select((F.floor(F.col("id") / 2) * 54_600 + F.col("id") % 2 * odd).alias("p_partkey"), F.lit(50).alias("p_size"))
    p.write.parquet(f"{tmp_path}/part.parquet")
    found = more.overlapping_boxes(spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    whole = 54_600 * sum(range(3000)) * 3000
    assert [tuple(r) for r in found.collect()] == [(0, 9_000_000, 7 * (whole + odd * 9_000_000) + whole)]


def test_rows_of_a_long_row_group_are_dealt_to_tasks(spark):
    rows = spark.range(3 * corpus.ROWS_PER_TASK * 4).coalesce(1)
    made = corpus.crafted(rows, "id", lambda r: b"x")
    most = made.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most <= 1.1 * corpus.ROWS_PER_TASK and made.count() == 3 * corpus.ROWS_PER_TASK * 4


def test_batches_hold_several_files_and_bounded_bytes(spark):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    files = [[{"doc_id": i, "text": "x" * 10}] for i in range(25)] + [[]]
    assert [b.num_rows for b in batched(files, schema, most_rows=10)] == [10, 10, 5]
    assert [b.num_rows for b in batched(files, schema, most=50)] == [5] * 5
    assert list(batched([], schema)) == []
    whole = pa.RecordBatch.from_pydict({"id": list(range(100)), "text": ["y" * 1000] * 100})
    parts = list(sliced([whole], most=10_000))
    assert [i for b in parts for i in b.column(0).to_pylist()] == list(range(100)) and max(b.num_rows for b in parts) <= 10
    assert list(sliced([whole.slice(0, 0)])) == []


def test_a_stage_writes_few_batches(spark, monkeypatch):
    """Six hundred small files gave as many batches of the decode stage."""
    made = build([[("a", 10, 100, 10)]])
    df = spark.range(600).coalesce(1).select(F.col("id").alias("doc_id"), F.lit(made).alias("content"))
    sizes = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: sizes.extend(b.num_rows for b in run(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(600)), "content": [made] * 600, "password": [""] * 600})]))))
    decode.spans(df)
    assert sum(sizes) == 600 and len(sizes) == 1


def test_tokens():
    assert Parser(b"<< /A 1 0 R /B [1 2 0 R (x)] /C#20D <4 1> /E << >> 7 /F -.5>>").next() == {"A": Ref(1, 0), "B": [1, Ref(2, 0), b"x"], "C D": b"A", "E": {}, "F": -0.5}
    assert [Parser(b"1 0 R", refs=False).next(), Parser(b"%c\n1 0 Rx").next()] == [1, 1]
    comments = b"%" * 3000 + b" 1 0 obj"  # one comment, in whatever parts it is tried
    assert Parser(comments).next() == ""
    for deep in (b"[" * 200, b"<</A " * 200):
        try:
            Parser(deep).next()
            raise AssertionError
        except PdfError:
            pass


def test_fonts_and_search_share_their_tables():
    d = {"Type": "Font", "Subtype": "Type1", "BaseFont": "Helvetica", "Encoding": "WinAnsiEncoding"}
    pdf = Pdf(build([[("İstanbul ΣΑΣ", 10, 100, 10), ("ab ab", 10, 50, 10)]]))
    a, b = Font(pdf, d), Font(pdf, dict(d))
    assert a.table is b.table and a.show(b"A\x00B") == ("AB", 667 + 667 + 500, 3, 0)
    own = lines(read(pdf, pdf.pages[0]).spans)
    assert [h["start"] for h in search(own, "AB")] == [0, 3] and [h["line"] for h in search(own, "σας")] == [] and len(search(own, "σασ")) == 1


def test_hits_are_marked_where_they_are_found(spark):
    """Files went through storage and a join with their hits."""
    plan = queries.annotated_hits(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 3


def test_numbers_with_their_operator():
    """Too many numbers, a constant as an operand, a zero byte as white space, and operators without a space before or after."""
    body = b"BT /F0 10 Tf 9 9 1 0 0 1 4 5. Tm (a) Tj 1 0 0 1 .5 -2 Tm\x00(b) Tj true Tj 7 8 Td(c)Tj 1 0 0 1 9 9 Tm5 (d) Tj"
    pdf = Pdf(build([[]], graphics={0: body}))
    assert [(s["text"], s["x"], s["y"]) for s in read(pdf, pdf.pages[0]).spans] == [("a", 0, 0), ("b", 0.5, -2), ("c", 7.5, 6), ("d", 12.5, 6)]
