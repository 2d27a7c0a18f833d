"""Files that arrive: the same decode stages over a stream, copies dropped, counts and sessions over event time, revisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_pdfs(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of (path, content, ...); its content column goes through the functions of operators.decode unchanged."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_per_trigger).load(path)


def distinct_uploads(files: DataFrame, content: str = "content", time: str = "modificationTime", within: str = "1 day") -> DataFrame:
    """Files without those whose bytes came before, as far back as ``within`` on a stream; digests alone are remembered."""
    marked = files.withColumn("sha256", F.sha2(content, 256))
    if marked.isStreaming:
        return marked.withWatermark(time, within).dropDuplicatesWithinWatermark(["sha256"])
    return marked.dropDuplicates(["sha256"])


def counts(events: DataFrame, time: str, length: str, slide: str | None = None, keys: tuple[str, ...] = (), late: str = "1 hour") -> DataFrame:
    """(keys, start, end, n): events in tumbling windows, or in sliding ones, on streams and tables alike."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    own = marked.groupBy(*keys, F.window(time, length, slide or length).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return own.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): sessions parted by gaps in event time, on streams and tables alike."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    own = marked.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return own.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


REVISION = "doc string, revision int, at timestamp, sha256 string, previous string"


def revisions(uploads: DataFrame) -> DataFrame:
    """(doc, revision, at, sha256, previous): uploads (doc, at, sha256) numbered from 1 for each document, where one whose
    bytes are those of the revision before is none.

    On a stream the state of a document is its last revision; within a batch uploads count in the order of their time, and
    one that comes after a later one has been numbered is numbered behind it. A table gives what a stream of one batch would."""
    rows = uploads.select(F.col("doc").cast("string").alias("doc"), F.col("at").cast("timestamp").alias("at"), F.col("sha256").cast("string").alias("sha256"))

    def follow(last: tuple[int, str | None], frame: pd.DataFrame, doc: str) -> tuple[tuple[int, str | None], list[tuple]]:
        n, digest = last
        out = []
        for at, sha in frame.sort_values(["at", "sha256"])[["at", "sha256"]].itertuples(index=False):
            if sha != digest:
                n, previous, digest = n + 1, digest, sha
                out.append((doc, n, at, sha, previous))
        return (n, digest), out

    columns = ["doc", "revision", "at", "sha256", "previous"]
    if rows.isStreaming:

        def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            last = tuple(state.get) if state.exists else (0, None)
            frame = pd.concat(list(frames), ignore_index=True)  # one document's uploads in a batch
            last, out = follow(last, frame, key[0])
            state.update(last)
            yield pd.DataFrame(out, columns=columns)

        return rows.groupBy("doc").applyInPandasWithState(update, REVISION, "n int, digest string", "append", GroupStateTimeout.NoTimeout)
    w = Window.partitionBy("doc").orderBy("at", "sha256")
    changed = rows.withColumn("previous", F.lag("sha256").over(w)).where(F.col("previous").isNull() | (F.col("previous") != F.col("sha256")))
    return changed.select("doc", F.row_number().over(w).alias("revision"), "at", "sha256", "previous")
