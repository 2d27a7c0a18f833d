"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix. DataFrame functions only.

1. Sources are the partitions that rows are read in. Each is ordered by a hash of its rows' keys (permute locally) and
   written to the shared folder with every row's place; a lost executor can't change what is written. The matrix has one
   row per source and one column per shard: how many of the source's rows go to the shard. Its row sums are the sources'
   counts, its column sums the shard sizes (equal, but for one row more in the first shards), and it is drawn from the
   law that a uniform permutation of all rows would give it: a multivariate hypergeometric draw per source, without
   replacement.
2. The first M[source, 0] rows of a source go to shard 0, the next to shard 1, and so on.
3. Exchange: rows go to (shard, part of shard).
4. Permute again: within a shard rows are ordered by a second hash, salted by the row's place in its source, so that rows
   that are equal in all keys part. Parts are ranges of that hash, numbered on their own and put in place by the parts'
   counts, so that a shard is never ordered by one task.

The only exchange of rows is the one of step 3. The matrix is drawn on the driver from one count per source, and goes out
as one string; both grow with the number of read partitions, about 130 bytes each, and not with the rows in them.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import written

PART_ROWS = 1_000_000
#: Values looked at on either side of the mode: so many standard deviations and so many more.
DEVIATIONS, MORE = 10, 40


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows taken without replacement are good, by inversion.

    Weights come from the exact ratios of neighbouring probabilities, outwards from the mode, and are summed, so no
    factorial is taken and they add up to one at any size; each has a relative error of about the number of steps times
    2 ** -53. What lies further out than DEVIATIONS standard deviations and MORE has a probability below 1e-20.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    n = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (n + 2)))
    sd = math.sqrt(draws / n * good * (bad / n) * ((n - draws) / max(1, n - 1)))
    reach = int(DEVIATIONS * sd) + MORE
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)  # from k to k + 1
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)  # from k to k - 1
    above = np.cumprod((good - up) / (up + 1) * ((draws - up) / (bad - draws + up + 1)))
    below = np.cumprod(down / (good - down + 1) * ((bad - draws + down) / (draws - down + 1)))
    weights = np.concatenate([below[::-1], [1.0], above])
    ends = np.cumsum(weights)
    at = int(np.searchsorted(ends, rng.random() * ends[-1], side="right"))
    return mode - len(below) + min(at, len(weights) - 1)


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows that each source sends to each shard; row sums are counts, column sums are sizes."""
    if sum(counts) != sum(sizes):
        raise ValueError("counts and sizes must have the same sum")
    rng, room, out = random.Random(seed), list(sizes), []
    for n in counts:
        rest, left, row = sum(room), n, []
        for r in room:
            x = hypergeometric(rng, r, rest - r, left) if left else 0
            row.append(x)
            rest, left = rest - r, left - x
        room = [r - x for r, x in zip(room, row)]
        out.append(row)
    return out


def shard_sizes(n: int, shards: int) -> list[int]:
    return [n // shards + (s < n % shards) for s in range(shards)]


def shuffle_into_shards(rows: DataFrame, key_cols: list[str], shards: int, seed: int = 0, part_rows: int = PART_ROWS) -> DataFrame:
    """rows with two more columns, shard (int) and slot (long, from 0 without gaps in each shard).

    key_cols order the rows of a source; nulls hash as nulls, and rows equal in all of them, however many, are parted by
    their places. Shards differ by at most one row. An empty table gives no rows. A column named shard or slot is
    replaced; all others stay, whatever their names. The same partitions of the same rows give the same result.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    spark, own = rows.sparkSession, [c for c in rows.columns if c not in ("shard", "slot")]
    keys = [F.col(f"`{c}`") for c in key_cols]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.xxhash64(F.lit(seed), F.lit(1), *keys).alias("first"))  # no name can clash within the struct
    ordered = packed.sortWithinPartitions("first", *[F.col("row").getField(c) for c in key_cols])
    # The place holds the partition in its upper and the rank in its lower 33 bits.
    placed = written(ordered.select("row", F.monotonically_increasing_id().alias("place")), "sharding-sources")
    source = F.shiftright("place", 33)
    counts = {r["source"]: r["n"] for r in placed.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per read partition
    if not counts:
        return placed.select("row.*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    names, n = sorted(counts), sum(counts.values())
    matrix = communication_matrix([counts[s] for s in names], shard_sizes(n, shards), seed)
    text = ";".join(f"{s}:" + " ".join(map(str, np.cumsum(row).tolist())) for s, row in zip(names, matrix))
    line = spark.range(1).select(F.explode(F.split(F.lit(text), ";")).alias("line"))
    ends = line.select(F.substring_index("line", ":", 1).cast("long").alias("source"), F.transform(F.split(F.substring_index("line", ":", -1), " "), lambda e: e.cast("long")).alias("ends"))
    rank = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    second = F.xxhash64(F.lit(seed), F.lit(2), "place")
    parts = max(4, -(-n // (shards * part_rows)))
    part = F.shiftright(F.shiftrightunsigned(second, 33) * F.lit(parts).cast("long"), 31).cast("int")
    sent = placed.withColumn("source", source).join(F.broadcast(ends), "source")  # a row per read partition
    sent = sent.select("row", "place", second.alias("second"), F.size(F.filter("ends", lambda e: e <= rank)).cast("int").alias("shard"), part.alias("part"))
    sizes = sent.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))  # shards x parts rows
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    here = Window.partitionBy("shard", "part").orderBy("second", "place")
    numbered = sent.withColumn("at", F.row_number().over(here).cast("long") - 1)
    return numbered.join(F.broadcast(offsets), ["shard", "part"]).select("row.*", "shard", (F.col("at") + F.col("offset")).alias("slot"))
