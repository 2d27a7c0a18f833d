"""PDF files, from storage or made from the parquet tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model.objects import PdfError
from ..model.writer import assemble, build, encrypt, merge
from ..runtime import ship, sliced

LINES_PER_PAGE = 50
#: Bytes of the files of a group that are merged in one task.
MOST_MERGED = 512 << 20
#: Rows of which a task makes files: some seconds of work, however large the table and however few its row groups.
ROWS_PER_TASK = 5_000
TOP, LEADING, SIZE, LEFT = 760.0, 14.0, 10.0, 40.0


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, ...) of the PDF files below path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, der, sha256) of the certificates in PEM or DER files below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    text = F.decode("content", "ISO-8859-1")
    blocks = F.regexp_extract_all(text, F.lit("(?s)-----BEGIN CERTIFICATE-----(.*?)-----END CERTIFICATE-----"), 1)
    der = F.when(F.size(blocks) > 0, F.transform(blocks, lambda b: F.unbase64(F.regexp_replace(b, r"\s", "")))).otherwise(F.array("content"))
    return files.select("path", F.posexplode(der).alias("ordinal", "der")).withColumn("sha256", F.sha2("der", 256))


def lay_out(lines: list[str], per_page: int = LINES_PER_PAGE) -> list[list[tuple]]:
    """Pages of one span per line that isn't made of spaces alone."""
    chunks = [lines[i : i + per_page] for i in range(0, len(lines), per_page)] or [[]]
    return [[(t, LEFT, TOP - LEADING * k, SIZE) for k, t in enumerate(c) if t.strip(" ")] for c in chunks]


def crafted(rows: DataFrame, id_col: str, write: Callable[[dict], bytes]) -> DataFrame:
    """(doc_id, content): the bytes that write() gives for a row.

    Rows are counted first (of a table in storage that reads its footers) and dealt to tasks of up to ROWS_PER_TASK each,
    and to all cores: a row group may hold a million rows, and making files is far dearer than this exchange."""
    ship(rows.sparkSession)
    names, cores = rows.columns, rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-rows.count() // ROWS_PER_TASK))
    if rows.rdd.getNumPartitions() < tasks:
        rows = rows.repartition(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            made = [write(dict(zip(names, r))) for r in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([b.column(names.index(id_col)).cast(pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "content"])

    return rows.mapInArrow(run, "doc_id long, content binary")


def make(rows: DataFrame, id_col: str, describe: Callable[[dict], dict]) -> DataFrame:
    """(doc_id, content): a file per row, from what describe() says of it (the arguments of build())."""
    return crafted(rows, id_col, lambda r: build(**describe(r)))


def text_files(documents: DataFrame, per_page: int = LINES_PER_PAGE) -> DataFrame:
    """A file per document, one span per line; null and empty texts give a file of one empty page."""
    return make(documents.select("doc_id", "text"), "doc_id", lambda r: {"pages": lay_out((r["text"] or "").split("\n"), per_page)})


def merged(files: DataFrame, group: F.Column, most_bytes: int = MOST_MERGED) -> DataFrame:
    """(doc_id, content, error): the files of each group as one, in the order of doc_id, with their bookmarks, fields and
    layers. A group is merged in the memory of one task; one of over most_bytes gives an error and no content."""
    ship(files.sparkSession)

    def run(t: pa.Table) -> pa.Table:
        g, content, error = t.column("g")[0].as_py(), None, None
        if t.column("content").null_count:
            error = f"a file is null, or the group has over {most_bytes} bytes"
        else:
            try:
                content = merge(t.sort_by("doc_id").column("content").to_pylist())
            except (PdfError, ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError) as e:
                error = f"{type(e).__name__}: {e}"[:200]
        return pa.table({"doc_id": pa.array([g], pa.int64()), "content": pa.array([content], pa.binary()), "error": pa.array([error], pa.string())})

    total = F.sum(F.octet_length("content")).over(Window.partitionBy("g"))  # partitioned as the groups below: no exchange of its own
    sized = files.select("doc_id", "content", group.cast("long").alias("g")).withColumn("total", total)
    bounded = sized.select("doc_id", "g", F.when(F.col("total") <= most_bytes, F.col("content")).alias("content"))
    return bounded.groupBy("g").applyInArrow(run, "doc_id long, content binary, error string")


def rearranged(files: DataFrame, choose: Callable[[int], list[int]]) -> DataFrame:
    """(doc_id, content) with the pages that choose(page count) names: extract, delete, reorder or repeat pages."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..model.document import Pdf

        for b in sliced(batches, 1):
            made = [assemble([(c, choose(len(Pdf(c).pages)))]) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["doc_id", "content"])

    return files.select("doc_id", "content").mapInArrow(run, "doc_id long, content binary")


def encrypted(files: DataFrame, user: str = "", owner: str = "", aes: bool = True) -> DataFrame:
    """(doc_id, content) of the files encrypted with these passwords."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            made = [encrypt(c, user.encode(), owner.encode(), aes) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["doc_id", "content"])

    return files.select("doc_id", "content").mapInArrow(run, "doc_id long, content binary")


def edited(files: DataFrame, change: Callable[[bytes, dict], bytes], id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """(doc_id, content, error): change(content, row) for every file, as with the functions of model.edit.

    A file that can't be changed has null content and the error; no file fails the job.
    """
    ship(files.sparkSession)
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, names.index(content_col)):
            made, errors = [], []
            for values in zip(*(c.to_pylist() for c in b.columns)):
                row = dict(zip(names, values))
                try:
                    made.append(change(row[content_col] or b"", row))
                    errors.append(None)
                except (PdfError, ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError) as e:
                    made.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([b.column(names.index(id_col)).cast(pa.int64()), pa.array(made, pa.binary()), pa.array(errors, pa.string())], names=["doc_id", "content", "error"])

    return files.mapInArrow(run, "doc_id long, content binary, error string")
