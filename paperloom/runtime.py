"""Session helpers that every subpackage shares: code shipping, the shared folder, written intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Used only where no checkpoint folder is set and the driver is the only machine, as in tests.
LOCAL_SHARED_DIR = "/tmp/checkpoints/paperloom"
#: A batch of Spark has up to 10,000 rows whatever their size; a worker takes so many bytes of text from it at a time.
SLICE_BYTES = 1_000_000


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per Spark context, whatever the driver's path is."""
    sc = spark.sparkContext
    if getattr(sc, "_paperloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix="paperloom-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(name)
    atexit.register(Path(name).unlink, missing_ok=True)  # executors may ask for it as long as the driver lives
    sc._paperloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, else the one of setCheckpointDir().

    Without either a local master gets a folder of our own; on a cluster that is an error, since no folder of one machine
    can hold tables that others read.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not (sc.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(LOCAL_SHARED_DIR)
    return LOCAL_SHARED_DIR


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage and outlives executors.

    The folder goes when the driver ends, or with forget().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that written() gave, once nothing reads it any more."""
    spark = df.sparkSession
    for place in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sliced(batches: Iterator[pa.RecordBatch], column: int | None = None, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, without copies, in parts whose texts in column take up to most bytes; a longer text is alone in its part.
    Without a column all bytes of a batch count, its rows as if they had equal shares of them.

    So a worker holds the objects that it makes of texts, and their results, for one part and not for a whole batch.
    """
    for b in batches:
        if column is None:
            step = max(1, b.num_rows * most // max(1, b.nbytes))
            yield from (b.slice(at, step) for at in range(0, b.num_rows, step))
            continue
        texts = b.column(column)
        if not len(texts) or pa.types.is_null(texts.type):
            yield b
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = done = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield b.slice(at, to - at)
            at, done = to, int(ends[to - 1])


def batched(rows: Iterable[list[dict]], schema: pa.Schema, most_rows: int = 1000, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of the rows that each file gives, of several files at a time: a batch a file costs more than most files' rows.

    A batch ends once it has so many rows, or so many bytes (or members) in the columns that may be long."""
    long = [f.name for f in schema if pa.types.is_string(f.type) or pa.types.is_binary(f.type) or pa.types.is_list(f.type)]
    out: list[dict] = []
    size = 0
    for own in rows:
        out += own
        for r in own:
            for name in long:
                if v := r.get(name):
                    size += len(v)
        if len(out) >= most_rows or size >= most:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
