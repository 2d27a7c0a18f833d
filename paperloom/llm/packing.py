"""Harmonic packing of tokenised documents into sequences.

Class k holds pieces longer than C / (k + 1) and at most C / k tokens, and k of them fill one of its bins, so a worker
needs no more than a counter per class and no other worker. A document is cut so that little is lost: first into pieces of
the whole capacity, then, while the rest is in a class below ``fine``, into the largest piece of exactly floor(C / k)
tokens that it holds. Only the last piece of a document is shorter than its class's share, and by less than 1 / fine.

Each task fills bins from its own documents. What its classes have left open (fewer than k pieces each) is dealt out by
class and a salt, so that a group has about GROUP_ROWS pieces however hot its class is, and filled again the same way. A
group leaves at most the sum of k - 1 over its classes (10,000 or so at 2048), so each round leaves a small share, until
one task can fill what is left; what is then still open, fewer than k pieces a class over all data, it packs best-fit.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..runtime import ship, sliced, written

CAPACITY = 2048
FINE = 16
GROUP_ROWS = 50_000
#: Fixed value: the words of a byte-level pre-tokenizer that uses its own pattern.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of this length exhausts the stack of the fast library's pattern engine, which looks ahead.
LONG_SPACE = 10_000
PIECES = "id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIELDS = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 characters stand
    for themselves, the others are numbered from U+0100 in byte order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class DocumentTokenizer:
    """The ids that the tokenizers library gives for a byte-level BPE file, without special tokens added.

    tiktoken runs the same vocabulary several times as fast. It is used where the file's words are those of ``pattern`` and
    its merges are in the order of their ids, as ranks must be; ``slow`` (the tokenizers library itself) serves all other
    files, texts that hold a special token's string, and texts with a run of LONG_SPACE white space characters or more.
    """

    def __init__(self, path: str, pattern: str):
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        alphabet, vocab = byte_alphabet(), model["model"]["vocab"]
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        made = [vocab[a + b] for a, b in pairs]
        self.fast = None
        self.special = list(special)
        before = model.get("pre_tokenizer") or {}
        same_words = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and pattern == BYTE_LEVEL_PATTERN
        if same_words and made == sorted(set(made)) and not model.get("normalizer") and all(c in alphabet for t in vocab if t not in special for c in t):
            ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if t not in special}
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.long_space = re.compile(rf"\s{{{LONG_SPACE}}}")

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special) or len(text) >= LONG_SPACE and self.long_space.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


_TOKENIZERS: dict[tuple[str, str], DocumentTokenizer] = {}


def tokenizer(path: str, pattern: str) -> DocumentTokenizer:
    """One per Python worker."""
    if (path, pattern) not in _TOKENIZERS:
        _TOKENIZERS[path, pattern] = DocumentTokenizer(path, pattern)
    return _TOKENIZERS[path, pattern]


def cut(n: int, capacity: int = CAPACITY, fine: int = FINE) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of n tokens, in order."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if k >= fine or capacity // k == rest:
            out.append((rest, k))
            break
        size = capacity // (k + 1)
        out.append((size, k + 1))
        rest -= size
    return out


class Bins:
    """One open bin per class. Numbers of sequences: 5 bits for the round, 24 for the task, 34 for its bins."""

    def __init__(self, turn: int, part: int):
        self.first, self.made, self.open = (turn << 58) + (part << 34), 0, {}

    def add(self, k: int, piece: list) -> list[list]:
        """The pieces of the bin that this piece closes, with sequence and offset; else none."""
        own = self.open.setdefault(k, [])
        own.append(piece)
        if len(own) < k:
            return []
        del self.open[k]
        return self.close(own)

    def close(self, pieces: list[list]) -> list[list]:
        at, out = 0, []
        for p in pieces:
            out.append([*p[:5], self.first + self.made, at])
            at += p[2]
        self.made += 1
        return out

    def rest(self) -> list[list]:
        return [[*p[:5], None, None] for own in self.open.values() for p in own]


def best_fit(pieces: list[list], capacity: int) -> list[list[list]]:
    """Bins of pieces, longest first, each put where least room is left."""
    bins: list[list[list]] = []
    by_room: dict[int, list[int]] = {}
    for p in sorted(pieces, key=lambda p: (-p[2], str(p[0]), p[1])):
        room = next((r for r in range(p[2], capacity + 1) if by_room.get(r)), None)
        if room is None:
            bins.append([])
            at, room = len(bins) - 1, capacity
        else:
            at = by_room[room].pop()
        bins[at].append(p)
        by_room.setdefault(room - p[2], []).append(at)
    return bins


def _batch(rows: list[list], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [id_type, *[pa.int64()] * 6]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(7)], names=FIELDS)


def pack(docs: DataFrame, path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, fine: int = FINE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and then end_id; null counts as empty, so every row gives at least one piece. Null ids
    stay null; rows that repeat an id are packed as separate documents. sequence_id is unique, not gapless. An empty
    table gives no rows. Other columns of docs are not read. Very long texts are tokenised whole, in one task.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = PIECES.format(id=rows.schema["id"].dataType.simpleString())

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t, bins, kind = tokenizer(path, pattern), Bins(0, TaskContext.get().partitionId()), None
        for b in sliced(batches, 1):
            kind, out = b.schema.field(0).type, []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(t.ids(text or ""), np.uint32(end_id)).astype("<u4")
                at = 0
                for n, k in cut(len(ids), capacity, fine):
                    out += bins.add(k, [i, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), None, None])
                    at += n
            yield _batch(out, kind)
        if kind is not None:
            yield _batch(bins.rest(), kind)

    def refill(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            bins, kind = Bins(turn, TaskContext.get().partitionId()), None
            for b in batches:
                kind, out = b.schema.field(0).type, []
                for p in zip(*(c.to_pylist() for c in b.columns[:7])):
                    out += bins.add(capacity // p[2], list(p))
                yield _batch(out, kind)
            if kind is not None:
                yield _batch(bins.rest(), kind)

        return run

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, kind, out = Bins(31, 0), None, []
        for b in batches:
            kind = b.schema.field(0).type
            for p in sorted(map(list, zip(*(c.to_pylist() for c in b.columns[:7]))), key=lambda p: (-p[2], str(p[0]), p[1])):
                out += bins.add(capacity // p[2], p)
        if kind is not None:
            out += [p for own in best_fit(bins.rest(), capacity) for p in bins.close(own)]
            yield _batch(out, kind)

    done = written(rows.mapInArrow(fill, schema), "packed")
    whole, left, turn = done.where("sequence_id is not null"), done.where("sequence_id is null"), 1
    while turn < 31 and (n := left.count()) > group_rows:
        size = F.floor(F.lit(capacity) / F.col("length")).cast("int")
        dealt = left.withColumn("class", size).withColumn("salt", F.pmod(F.xxhash64("id", "start", F.monotonically_increasing_id()), F.lit(-(-n // group_rows))))
        done = written(dealt.repartition("class", "salt").sortWithinPartitions("class", F.col("length").desc(), "id", "start").mapInArrow(refill(turn), schema), "packed")
        whole, left, turn = whole.union(done.where("sequence_id is not null")), done.where("sequence_id is null"), turn + 1
    return whole.union(left.coalesce(1).mapInArrow(finish, schema))  # about group_rows at most
