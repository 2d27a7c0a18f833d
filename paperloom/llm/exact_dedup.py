"""Exact deduplication with a log-structured merge index of text digests.

Ingest: each task keeps a memtable (digest -> smallest identifier, rows). A full memtable is flushed as a run: for each
digest bucket one row with the sorted digests, their identifiers and counts, and a Bloom filter over them. Runs are
written to the shared folder, so they outlive executors.

Compaction goes in levels of at most about ``fan_in`` runs. A level merges groups of runs, bucket by bucket, into one run
each, sorted, with the smallest identifier and the sum of rows of every digest and a new filter, and cuts its buckets
``fan_in`` times as fine, so that a piece keeps its size while runs get fewer and longer. The last level merges what is
left of a bucket: an entry of one row whose digest is in no other run's filter is a first and only occurrence and skips
the merge, and only entries of two rows or more ("hits") leave it. So an entry is moved once a level, and a filter is
probed by at most fan_in runs.

Verification: texts are only fetched for rows with a hit. A row is compared byte for byte with the row that stays; a row
that fails (equal digests, other bytes) is a group of its own.

Memory: a memtable has at most ``memtable_rows`` entries; the buckets of the last level have about ``bucket_rows`` entries;
a digest has at most one entry in a run, whatever its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship, sliced, written

#: A-Z to a-z; all other bytes stay.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
FILTER_BITS_PER_ENTRY = 10
FILTER_PROBES = 4
RUN_SCHEMA = "bucket int, run string, digests binary, ids binary, counts binary, filter binary"
FAN_IN = 64
#: Marks of hits are broadcast up to so many rows (8 bytes each); beyond, all rows go through the exchange with their texts.
BROADCAST_ROWS = 1_000_000


def normalised(text: bytes | None) -> bytes:
    """The text's UTF-8 bytes with A-Z lower-cased; null counts as empty."""
    return (text or b"").translate(ASCII_LOWER)


def _probes(heads: np.ndarray, tails: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions, one row per digest, by double hashing of two digest words."""
    k = np.arange(FILTER_PROBES, dtype=np.uint64)
    return (heads[:, None] + k * (tails[:, None] | np.uint64(1))) % np.uint64(bits)


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = digests.view(np.uint8).reshape(-1, 32)
    return np.ascontiguousarray(w[:, 8:16]).view("<u8").ravel(), np.ascontiguousarray(w[:, 16:24]).view("<u8").ravel()


def make_filter(digests: np.ndarray) -> bytes:
    bits = max(64, len(digests) * FILTER_BITS_PER_ENTRY)
    out = np.zeros((bits + 7) // 8 * 8, dtype=np.uint8)
    out[_probes(*_words(digests), bits).ravel().astype(np.int64)] = 1
    return bits.to_bytes(8, "little") + np.packbits(out).tobytes()


def in_filter(data: bytes, digests: np.ndarray) -> np.ndarray:
    bits = int.from_bytes(data[:8], "little")
    have = np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=8))
    return have[_probes(*_words(digests), bits).astype(np.int64)].all(axis=1)


def _flush(table: dict[bytes, list[int]], run: str, buckets: int) -> pa.RecordBatch:
    digests = sorted(table)
    ids = np.array([table[d][0] for d in digests], dtype=np.int64)
    counts = np.array([table[d][1] for d in digests], dtype=np.int64)
    return _pieces(np.array(digests, dtype="V32"), ids, counts, run, buckets)


def _pieces(keys: np.ndarray, ids: np.ndarray, counts: np.ndarray, run: str, buckets: int) -> pa.RecordBatch:
    """A sorted run as one row per bucket that it has entries in."""
    own = _bucket_of(keys, buckets)
    cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
    rows = {"bucket": [], "run": [], "digests": [], "ids": [], "counts": [], "filter": []}
    for a, b in zip(cuts, cuts[1:]):
        rows["bucket"].append(int(own[a]))
        rows["run"].append(run)
        rows["digests"].append(keys[a:b].tobytes())
        rows["ids"].append(ids[a:b].tobytes())
        rows["counts"].append(counts[a:b].tobytes())
        rows["filter"].append(make_filter(keys[a:b]))
    types = [pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], names=list(rows))


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the first 32 bits, so that a sorted run falls into sorted buckets."""
    head = np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 32)[:, :4]).view(">u4").ravel().astype(np.uint64)
    return (head * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def merge_runs(runs: list[dict], last: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests in order, the smallest identifier and the rows of each; of the last level only those in two rows or more."""
    keys, ids, counts = [], [], []
    blocks = [(np.frombuffer(r["digests"], dtype="V32"), np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["counts"], dtype=np.int64), r["filter"]) for r in runs]
    for i, (k, v, n, _) in enumerate(blocks):
        need = n > 1 if last else np.ones(len(n), bool)
        for j, other in enumerate(blocks):
            if last and i != j:
                rest = np.flatnonzero(~need)
                if not len(rest):
                    break
                need[rest[in_filter(other[3], k[rest])]] = True
        keys.append(k[need]), ids.append(v[need]), counts.append(n[need])
    k, v, n = np.concatenate(keys), np.concatenate(ids), np.concatenate(counts)
    if not len(k):
        return k, v, n
    text = np.ascontiguousarray(k).view("S32")  # trailing zero bytes compare equal only to trailing zero bytes of the same width
    order = np.argsort(text, kind="stable")
    raw = k.view(np.uint8).reshape(-1, 32)[order]
    new = np.concatenate([[True], (raw[1:] != raw[:-1]).any(axis=1)])
    at = np.flatnonzero(new)
    total = np.add.reduceat(n[order], at)
    least = np.minimum.reduceat(v[order], at)
    hit = total > 1 if last else np.ones(len(total), bool)
    return k[order][at][hit], least[hit], total[hit]


class DigestIndex:
    """A log-structured merge index over the normalised texts of a table.

    ``sign`` is 1 to keep the smallest identifier of equal texts, -1 to keep the largest (identifiers are negated).
    """

    def __init__(self, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memtable_rows: int = 100_000, bucket_rows: int = 200_000, fan_in: int = FAN_IN):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is 'smallest' or 'largest'")
        self.id_col, self.text_col, self.sign = id_col, text_col, 1 if keep == "smallest" else -1
        self.memtable_rows, self.bucket_rows, self.fan_in = memtable_rows, bucket_rows, max(2, fan_in)
        self.buckets = 1

    def runs(self, docs: DataFrame) -> DataFrame:
        """Flushed runs of all rows, in the shared folder."""
        ship(docs.sparkSession)
        self.buckets = max(1, docs.count() // self.bucket_rows)
        buckets, sign, most = min(self.buckets, self.fan_in), self.sign, self.memtable_rows

        def ingest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, flushed, mem = TaskContext.get().partitionId(), 0, {}
            for batch in sliced(batches, 1):
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    d = hashlib.sha256(normalised(t)).digest()
                    if i is None:
                        continue
                    i *= sign
                    e = mem.get(d)
                    if e is None:
                        mem[d] = [i, 1]
                    else:
                        e[1] += 1
                        if i < e[0]:
                            e[0] = i
                    if len(mem) >= most:
                        yield _flush(mem, f"{part}-{flushed}", buckets)
                        flushed, mem = flushed + 1, {}
            if mem:
                yield _flush(mem, f"{part}-{flushed}", buckets)

        return written(docs.select(F.col(self.id_col).cast("long"), F.col(self.text_col).cast("binary")).mapInArrow(ingest, RUN_SCHEMA), "lsm-runs")

    def compact(self, runs: DataFrame) -> DataFrame:
        """(digest, stays, group_size) of digests in two rows or more, in the shared folder."""
        sign, fan_in = self.sign, self.fan_in
        n, buckets, level = runs.select("run").distinct().count(), min(self.buckets, self.fan_in), 0

        def merging(level: int, buckets: int):
            def merge(t: pa.Table) -> pa.Table:
                group = t.column("group")[0].as_py()
                return pa.Table.from_batches([_pieces(*merge_runs(t.to_pylist(), last=False), f"{level}-{group}", buckets)])

            return merge

        while n > fan_in or buckets < self.buckets:
            n, buckets, level = -(-n // fan_in), min(self.buckets, buckets * fan_in), level + 1
            grouped = runs.withColumn("group", F.pmod(F.xxhash64("run"), F.lit(n)))
            runs = written(grouped.groupBy("bucket", "group").applyInArrow(merging(level, buckets), RUN_SCHEMA), "lsm-level")

        def hits(t: pa.Table) -> pa.Table:
            k, v, rows = merge_runs(t.to_pylist())
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(k), [None, pa.py_buffer(k.tobytes())]).cast(pa.binary())
            return pa.table({"digest": raw, "stays": pa.array(v * sign, pa.int64()), "group_size": pa.array(rows, pa.int64())})

        return written(runs.groupBy("bucket").applyInArrow(hits, "digest binary, stays long, group_size long"), "lsm-hits")


def _digested(docs: DataFrame) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            body = [normalised(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashlib.sha256(x).digest() for x in body], pa.binary()), pa.array(body, pa.binary())], names=["id", "digest", "body"])

    return docs.mapInArrow(digest, "id long, digest binary, body binary")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memtable_rows: int = 100_000, bucket_rows: int = 200_000, fan_in: int = FAN_IN, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, digest.

    Texts are equal when their UTF-8 bytes are, after lower-casing A-Z only. Null text: the empty text. Null id: the row
    is in no group (keep_id null, group_size 1, kept). A row that repeats an id and its text counts in group_size and
    shares the fate of its twin, since an id names a document. Rows of equal digest whose bytes differ from those of the
    row that stays are kept, each a group of its own. Empty table: no rows. Other columns of docs are not read.
    """
    index = DigestIndex("id", "text", keep, memtable_rows, bucket_rows, fan_in)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    hits = index.compact(index.runs(docs))
    rows = _digested(docs)
    # Rows without a hit are done. Those that may have one (a hash of the digest tells, so some may not) go on with their texts.
    marks = hits.select(F.xxhash64("digest").alias("mark"), F.lit(True).alias("hit")).distinct()
    if hits.count() <= broadcast_rows:
        rows = rows.withColumn("mark", F.xxhash64("digest")).join(F.broadcast(marks), "mark", "left")
    else:
        rows = rows.withColumn("hit", F.lit(True))
    parted = written(rows.select("id", "digest", F.coalesce("hit", F.lit(False)).alias("hit"), F.when(F.col("hit"), F.col("body")).alias("body")), "lsm-rows")
    alone = parted.where(~F.col("hit")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    # Equal digests may be a third of all rows: sort-merge joins of written tables, whose large partitions adaptive execution splits.
    hit = F.col("group_size").isNotNull()
    tagged = parted.where("hit").drop("hit").join(hits.hint("merge"), "digest", "left")
    tagged = written(tagged.select("id", "digest", "stays", "group_size", F.when(hit, F.col("body")).alias("body")), "lsm-tagged")
    first = tagged.where(F.col("id") == F.col("stays")).select("digest", F.col("body").alias("first_body")).dropDuplicates(["digest"])
    first = written(first, "lsm-first")
    joined = tagged.join(first.hint("merge"), "digest", "left")
    found = F.col("id").isNotNull() & F.col("first_body").isNotNull() & (F.col("body") == F.col("first_body"))
    return alone.unionByName(
        joined.select(
            "id",
            F.when(found, F.col("stays")).otherwise(F.col("id")).alias("keep_id"),
            F.when(found, F.col("group_size")).otherwise(F.lit(1)).cast("long").alias("group_size"),
            F.when(found, F.col("id") == F.col("stays")).otherwise(F.lit(True)).alias("kept"),
            "digest",
        )
    )
