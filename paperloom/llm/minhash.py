"""Near-duplicate classes by min-max hashing.

Each document's set of distinct word shingles is hashed; under each of ``signature / 2`` permutations both the smallest
and the largest value are kept, so a signature costs half the hash evaluations of plain MinHash and each of its values
agrees between two sets with probability equal to their Jaccard similarity. ``rows`` values make a band; documents that
share a band are candidates. With 40 bands of 5 rows a pair at similarity 0.8 shares none with probability 1.3e-7.

Hot groups. Documents with equal sets collapse first into one class (partial aggregation on a digest of the set). A class
that shares less than ``percent`` of its shingles with any other candidate can't be linked and leaves; for the others
that count bounds the similarity of a pair from above, which discards most pairs of a large family of copies that were
edited too much. Within a band only links to one leader are tried at first (a star, not all pairs), the class with the
fewest shingles of its own. Bands whose members then lie in several components are tried again with another leader, and
at last an exact prefix join compares all pairs *between different components* of the classes left in such bands that
pass the bounds. So every pair of classes that shares a band ends in one component, or is ruled out or compared: no cap,
no sampling.

Comparison: a sketch of one bit per signature value discards pairs whose estimated similarity is over six standard
deviations below the threshold; the rest are confirmed on their full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import forget, ship, sliced, written
from .exact_dedup import ASCII_LOWER

BANDS, ROWS = 40, 5
SKETCH_BITS = 192
STAR_ROUNDS = 2
#: A list of class identifiers is broadcast up to so many rows (8 bytes each), and joined by exchange beyond.
BROADCAST_ROWS = 1_000_000
WORD_CACHE = 400_000
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _words(text: bytes, cache: dict[bytes, int]) -> np.ndarray:
    """A 64-bit hash of each word: runs of bytes other than space and 09-0D, A-Z lower-cased."""
    words = text.translate(ASCII_LOWER).split()
    try:
        return np.array([cache[w] for w in words], dtype=np.uint64)
    except KeyError:
        if len(cache) > WORD_CACHE:
            cache.clear()
        for w in words:
            if w not in cache:
                cache[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([cache[w] for w in words], dtype=np.uint64)


def shingle_set(text: bytes | None, width: int, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words has one, of the whole sequence."""
    w = _words(text or b"", cache)
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, 0x9E3779B97F4A7C15 * (k + 1) % 2**64, dtype=np.uint64)
    for i in range(k):
        h = h * _U(0x100000001B3) + _mix(w[i : len(w) - k + 1 + i] + _U(i + 1))
    return np.unique(_mix(h))


class MinMax:
    """Signatures, bands and sketches; the same for the same seed wherever they are computed."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 11):
        if bands * rows % 2 or bands * rows < SKETCH_BITS:
            raise ValueError(f"bands x rows must be even and at least {SKETCH_BITS}")
        rng = np.random.default_rng(seed)
        half = bands * rows // 2
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 2**31, half, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, half, dtype=np.uint32)[:, None]
        self.band_mix = rng.integers(0, 2**63, rows, dtype=np.uint64) * _U(2) + _U(1)
        self.band_salt = rng.integers(0, 2**63, bands, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Minima under all permutations, then maxima; blocks keep memory bounded for very long texts."""
        x = (shingles >> _U(32)).astype(np.uint32)
        low = high = None
        for i in range(0, len(x), 8192):
            v = x[None, i : i + 8192] * self.a + self.b
            v ^= v >> np.uint32(15)
            least, most = v.min(axis=1), v.max(axis=1)
            low = least if low is None else np.minimum(low, least)
            high = most if high is None else np.maximum(high, most)
        return np.concatenate([low, high])

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        s = signature.astype(np.uint64).reshape(self.bands, self.rows)
        return _mix(_mix(s + _U(0x632BE59BD9B4E019)) @ self.band_mix + self.band_salt).view(np.int64)

    @staticmethod
    def sketch(signature: np.ndarray) -> np.ndarray:
        bits = ((signature[:SKETCH_BITS] * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
        return np.packbits(bits).view("<i8")


def least_agreement(threshold: float, bits: int) -> int:
    """Equal sketch bits that a pair at the threshold has but for six standard deviations."""
    p = (1 + threshold) / 2
    return math.floor(bits * p - 6 * math.sqrt(bits * p * (1 - p)))


def _hashed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mm, cache = MinMax(bands, rows), {}
        for batch in sliced(batches, 1):
            n, key, band, sketch = [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingle_set(t, width, cache)
                n.append(len(s))
                if len(s):
                    sig = mm.signature(s)
                    key.append(xxhash.xxh3_128_digest(s.tobytes()))
                    band.append(mm.band_keys(sig))
                    sketch.append(mm.sketch(sig))
                else:
                    key.append(None), band.append(None), sketch.append([None] * 3)
            sk = [pa.array([x[i] for x in sketch], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(band, pa.list_(pa.int64())), *sk], names=["id", "n", "key", "bands", "s0", "s1", "s2"])

    return docs.mapInArrow(run, "id long, n long, key binary, bands array<long>, s0 long, s1 long, s2 long")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in sliced(batches, 1):
            sets = [shingle_set(t, width, cache) for t in batch.column(1).to_pylist()]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["rep", "key", "shingles"])

    return docs.mapInArrow(run, "rep long, key binary, shingles array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): the smallest node it reaches.

    Labels fall to the smallest label next to them and then to their label's label, until no label changes; each round
    is a table in the shared folder, so lineage stays short and nothing but a count reaches the driver.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(seen, F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "m").alias("label"))
        hop = labels.select(F.col("node").alias("label"), F.col("component").alias("next"))
        nxt = written(lower.join(hop, "label", "left").select("node", F.least("label", "next").alias("component"), "was"), "labels")
        moved = nxt.where("component <> was").limit(1).count()
        forget(labels)
        labels = nxt.select("node", "component")
        if not moved:
            return labels


def _prefix_pairs(open_: DataFrame, sets: DataFrame, percent: int, may_link) -> DataFrame:
    """Pairs (a, b) of classes of different components that may be linked, complete among the classes in open_.

    Shingles are ordered by how many of these classes hold them, rarest first. If x and y are linked and h is the first
    shingle that they share, at the places i of x and j of y, then they share at most the shingles from there on, which
    must be enough for a link; so h lies in the first part of both. Members of a large family of copies differ in their
    rare shingles and so seldom meet.
    """
    reps = written(open_.select("c", "component").distinct(), "open-classes")
    each = sets.join(reps.select(F.col("c.rep").alias("rep")), "rep").select("rep", F.explode("shingles").alias("h"))
    often = written(each.groupBy("h").agg(F.count(F.lit(1)).alias("often")), "often")  # written: so the join below can split a hot shingle
    placed = each.join(often, "h").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("often", "h"))).alias("o"))  # one document's shingles
    n = F.size("o")
    first = F.slice("o", F.lit(1), (n - F.ceil(n * percent / 100) + 1).cast("int"))
    posted = placed.select("rep", F.posexplode(first).alias("i", "t")).where("t.often > 1").join(reps.withColumn("rep", F.col("c.rep")), "rep")
    posted = written(posted.select(F.col("t.h").alias("h"), "i", "c", "component"), "postings")
    several = posted.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("h")
    posted = written(posted.join(written(several, "met"), "h"), "met-postings")  # written: so the join below can split a hot shingle
    x = posted.select("h", F.col("i").alias("xi"), F.col("c").alias("x"), F.col("component").alias("xc"))
    y = posted.select("h", F.col("i").alias("yi"), F.col("c").alias("y"), F.col("component").alias("yc"))
    most = F.least(F.col("x.n") - F.col("xi"), F.col("y.n") - F.col("yi"))
    enough = 100 * most >= percent * (F.col("x.n") + F.col("y.n") - most)
    return x.join(y, "h").where((F.col("xc") < F.col("yc")) & enough & may_link("x", "y")).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Two documents are linked when 100 x intersection >= percent x union of their shingle sets. component_id is the
    smallest id reachable by links. Words: runs of characters other than space and U+0009-U+000D, A-Z lower-cased.
    A text of fewer than ``width`` words has one shingle, its whole sequence; null or wordless texts have none and are
    linked with nothing. Null id: the row takes the component of its equal-set class, or null if that has no id; it is
    kept only then. Rows that repeat an id are one node. Empty table: no rows. Other columns of docs are not read.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    base = written(_hashed(source, width, bands, rows), "minmax")
    classes = written(base.where("n > 0").groupBy("key").agg(F.min("id").alias("rep")).where("rep is not null"), "classes")  # a hot set is aggregated before the exchange
    # One row per class carries its bands and sketch. By rep, so that a hot set meets no hot key.
    one = base.join(classes.select(F.col("rep").alias("id"), F.col("key").alias("k")), "id").where("key = k").dropDuplicates(["key"])
    one = written(one.select(F.col("id").alias("rep"), "key", "n", "bands", "s0", "s1", "s2"), "candidates")
    spread = one.select(F.explode("bands").alias("band"), "rep")
    # Groups are written before they meet their rows again, here and below: an aggregate in the same stage as a join keeps it from splitting a hot band.
    shared = written(spread.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high").select("band"), "shared")
    near = written(spread.join(shared, "band"), "bands")
    involved = written(near.select("rep").distinct(), "involved")
    if involved.count() <= BROADCAST_ROWS:
        involved = F.broadcast(involved)
    sets = _sets(source.join(involved.withColumnRenamed("rep", "id"), "id").select("id", "text"), width)
    sets = written(sets.join(classes.select("rep", F.col("key").alias("k")), "rep").where("key = k").dropDuplicates(["key"]).select("rep", "shingles"), "sets")
    # How many of its shingles a class shares with any other candidate.
    each = sets.select("rep", F.explode("shingles").alias("h"))
    common = written(each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), "common")  # written: so the join below can split a hot shingle
    counts = each.join(common, "h").groupBy("rep").agg(F.count(F.lit(1)).alias("common"))
    fit = one.drop("bands", "key").join(counts, "rep").where(100 * F.col("common") >= percent * F.col("n"))
    about = F.struct((F.col("common") / F.col("n")).alias("ratio"), "rep", "n", "common", "s0", "s1", "s2")
    members = written(near.join(fit, "rep").select("band", about.alias("c")), "members")
    need = least_agreement(percent / 100, SKETCH_BITS)

    def may_link(x: str, y: str):
        """Neither the shared shingles nor the sketches rule the pair out."""
        least = F.least(f"{x}.common", f"{y}.common")
        return (100 * least >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n") - least)) & (agreement(x, y) >= need)

    def agreement(x: str, y: str):
        return F.lit(SKETCH_BITS) - sum((F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(3)), F.lit(0))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Of candidate pairs of classes (a, b), the links, on full sets."""
        left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("p"))
        right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("q"))
        both = F.size(F.array_intersect("p", "q"))
        return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("p") + F.size("q") - both)).select("a", "b")

    links, found, open_ = None, None, members.withColumn("component", F.col("c.rep"))
    for turn in range(STAR_ROUNDS):
        # The first leader is the class with the fewest shingles of its own, later ones are drawn by a hash.
        order = F.struct(F.col("c.ratio") if turn == 0 else F.xxhash64(F.lit(turn), "c.rep"), "c.rep")
        leaders = open_.groupBy("band").agg(F.max_by(F.struct("c", "component"), order).alias("lead")).select("band", F.col("lead.c").alias("lead"), F.col("lead.component").alias("lead_component"))
        leaders = written(leaders, "leaders")
        stars = open_.join(leaders, "band").where((F.col("component") != F.col("lead_component")) & may_link("c", "lead"))
        best = stars.groupBy(F.col("c.rep").alias("a")).agg(F.max_by(F.col("lead.rep"), F.struct(agreement("c", "lead"), "lead.rep")).alias("b"))
        new = written(confirmed(best), "links")
        links = new if links is None else links.union(new)
        found = components(links)
        placed = members.join(found, F.col("c.rep") == F.col("node"), "left").select("band", "c", F.coalesce("component", "c.rep").alias("component"))
        placed = written(placed, "placed")
        several = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band")
        open_ = written(placed.join(written(several, "several"), "band"), "open")
    last = written(confirmed(_prefix_pairs(open_, sets, percent, may_link)), "links")
    if last.limit(1).count():
        found = components(links.union(last))
    placed = classes.join(found, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    # Equal sets may be a third of all rows: a sort-merge join, whose large partitions adaptive execution splits.
    out = base.select("id", "n", "key").join(placed.hint("merge"), "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))
