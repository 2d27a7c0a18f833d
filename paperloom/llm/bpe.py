"""Byte-level BPE encoding and decoding by recursive SQL in an embedded DuckDB, once per partition.

Words (matches of the tokenizer's pattern) become rows (word, position, token), a row per byte, unless the vocabulary
holds the whole word. Each step of a recursive query joins neighbouring tokens with the merge table, and contracts the
leftmost pair of the lowest rank in every word; a word without such a pair leaves the recursion. Decoding sees identifiers
alone: the identifiers of each distinct word are joined with the vocabulary and their bytes put together by an ordered
aggregation; a text's bytes are those of its words.

A partition's distinct words are looked up once: texts are cut before single spaces and line ends, where no match of the
pattern can cross, and the pieces' results are kept in a bounded table. Texts with longer runs of white space are cut
by the pattern alone.

Words of over ``LONG`` bytes would make the recursion keep every state of a long list. Their steps are run on a table that
holds one state, and a step contracts all occurrences of the word's lowest pair, every other one where they overlap. That
gives the same identifiers if every token of the vocabulary, cut into bytes, is contracted to itself by pairs of no higher
rank than its own: tokens x, a, b that stand side by side are what the steps so far make of the string xab alone, and had
xab a lower rank than ab, a pair of a lower rank than ab would be left among them; so no pair that a contraction makes
ranks below it, and the other occurrences come next, leftmost first. The vocabulary is checked for this when the first
long word comes; where it fails, one pair is contracted at a time.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

LONG = 64
LONG_AT_ONCE = 1_000_000
WORDS_AT_ONCE = 40_000
CACHE = 1_000_000
TEXT_AT_ONCE = 4_000_000

#: Each step unnests the words that changed into token-position rows (w, i, l, r: neighbouring tokens at i and i + 1),
#: joins the merge table, and contracts each word's pair of the lowest (rank, position). Words without one drop out.
ENCODE = """
    with recursive st as (
        select w, list(t order by p) as ts from init group by w
        union all
        select st.w, st.ts[1:(b.key & 4294967295) - 1] || [(b.key >> 32)::integer] || st.ts[(b.key & 4294967295) + 2:]
        from st join (
            select w, min((m.id::bigint << 32) + i) as key
            from (select w, i, (ts[i]::bigint << 32) + ts[i + 1] as pair from (select w, ts, unnest(range(1, len(ts))) as i from st)) join merges m using (pair) {where}
            group by w) b using (w))
    select w, arg_min(ts, len(ts)) as ts from st group by w"""
#: Identifiers in decimal joined by commas, and what they decode to in hexadecimal, from (w, ts).
DECODE = """
    with coded as materialized ({coded})
    select w, array_to_string(ts, ',') as ids, hex from coded join (
        select w, string_agg(coalesce(hex, error('unknown identifier')), '' order by p) as hex
        from (select w, unnest(ts) as t, generate_subscripts(ts, 1) as p from coded) left join vocab on vocab.id = t group by w) using (w)"""
#: The same for long words, one state of each in a table; {chosen} picks the occurrences of the lowest pair.
CONTRACT = """
    with pairs as (select w, p, t, (t::bigint << 32) + lead(t) over (partition by w order by p) as pair from state),
         ranked as (select w, p, t, id, min(id) over (partition by w) as low from pairs left join merges using (pair)),
         hits as (select w, p from ranked where id = low),
         chosen as ({chosen})
    select r.w, row_number() over (partition by r.w order by r.p) as p, case when a.p is not null then r.low else r.t end as t
    from ranked r left join chosen a on a.w = r.w and a.p = r.p left join chosen b on b.w = r.w and b.p + 1 = r.p
    where b.p is null"""
LEFTMOST = "select w, min(p) as p from hits group by w"
ALL = """select w, p from (select w, p, row_number() over (partition by w, run order by p) as k
    from (select w, p, p - row_number() over (partition by w order by p) as run from hits)) where k % 2 = 1"""


#: A word's or piece's identifiers, in decimal joined by commas, and the bytes that they decode to.
Coded = tuple[str, bytes]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class SqlBpe:
    """Encodes and decodes words with a vocabulary of ranks; needs all 256 single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.edge = regex.compile(r"^\s|\s$")
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})  # never spills
        pairs = [((ranks[k[:i]] << 32) + ranks[k[i:]], v) for k, v in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks]
        self._table("merges", {"pair": pa.array([p[0] for p in pairs], pa.int64()), "id": pa.array([p[1] for p in pairs], pa.int32())})
        self._table("vocab", {"id": pa.array(list(ranks.values()), pa.int32()), "raw": pa.array(list(ranks), pa.binary()), "hex": pa.array([k.hex() for k in ranks])})
        # Per piece: its identifiers and their bytes; None: see texts(). Pieces have a space before them unless they begin
        # with a line end; heads are pieces at the start of a text.
        self.pieces: dict[str, Coded | None] = {}
        self.heads: dict[str, Coded | None] = {}

    def _table(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.db.register("arriving", pa.table(columns))
        self.db.execute(f"create or replace table {name} as select * from arriving")
        self.db.unregister("arriving")

    @functools.cached_property
    def steps(self) -> str:
        """How long words are contracted: all occurrences of a pair, if every token is made of pairs up to its own rank."""
        got = self.db.execute("select raw, id from vocab order by id").fetchall()
        if any(len(raw) > 1000 for raw, _ in got):
            return LEFTMOST  # not checked
        for i in range(0, len(got), WORDS_AT_ONCE):
            own = got[i : i + WORDS_AT_ONCE]
            self._table("caps", {"w": pa.array(range(len(own)), pa.int32()), "cap": pa.array([k for _, k in own], pa.int32())})
            coded = self.contracted([raw for raw, _ in own], "join caps using (w) where m.id <= cap")
            if any(ids != str(k) for (ids, _), (_, k) in zip(coded, own)):
                return LEFTMOST
        return ALL

    def _rows(self, words: list[bytes]) -> pa.Table:
        """(w, p, t): a row per byte, numbered from 0."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        which = np.repeat(np.arange(len(words), dtype=np.int32), length)
        at = np.arange(len(which), dtype=np.int64) - np.repeat(np.cumsum(length) - length, length)
        return pa.table({"w": which, "p": at, "t": self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]})

    def _coded(self, coded: str, n: int) -> list[Coded]:
        """Of n words, from a query of (w, ts)."""
        got = self.db.sql(DECODE.format(coded=coded)).to_arrow_table()
        out: list = [None] * n
        for w, ids, h in zip(*(got.column(c).to_pylist() for c in ("w", "ids", "hex"))):
            out[w] = ids, bytes.fromhex(h)
        return out

    def contracted(self, words: list[bytes], where: str = "") -> list[Coded]:
        """Words by the recursion."""
        self.db.register("init", self._rows(words))
        try:
            return self._coded(ENCODE.format(where=where), len(words))
        finally:
            self.db.unregister("init")

    def stepped(self, words: list[bytes], chosen: str) -> list[Coded]:
        """The same for words of any length, step by step in a table."""
        rows = self._rows(words)
        self._table("state", {c: rows.column(c) for c in rows.column_names})
        left = rows.num_rows + 1
        while (n := self.db.execute("select count(*) from state").fetchall()[0][0]) < left:
            left = n
            self.db.execute(f"create or replace table stepped as {CONTRACT.format(chosen=chosen)}")
            self.db.execute("drop table state; alter table stepped rename to state")
        out = self._coded("select w, list(t order by p) as ts from state group by w", len(words))
        self.db.execute("drop table state")
        return out

    def words(self, words: Iterable[str]) -> dict[str, Coded]:
        """Identifiers and bytes of each word; a word that the vocabulary holds is its own token."""
        out: dict[str, Coded] = {}
        all_ = [(w, w.encode("utf-8", "surrogatepass")) for w in words if w]
        for i in range(0, len(all_), WORDS_AT_ONCE):
            batch = all_[i : i + WORDS_AT_ONCE]
            self.db.register("asked", pa.table({"k": pa.array(range(len(batch)), pa.int32()), "raw": pa.array([b for _, b in batch], pa.binary())}))
            whole = {k: (str(x), bytes.fromhex(h)) for k, x, h in self.db.execute("select k, id, hex from asked join vocab using (raw)").fetchall()}
            self.db.unregister("asked")
            out |= {batch[k][0]: x for k, x in whole.items()}
            rest = [x for k, x in enumerate(batch) if k not in whole]
            short = [x for x in rest if len(x[1]) <= LONG]
            if short:
                out |= zip([w for w, _ in short], self.contracted([b for _, b in short]))
            now, size = [], 0
            for x in [*(x for x in rest if len(x[1]) > LONG), None]:
                if now and (x is None or size + len(x[1]) > LONG_AT_ONCE):
                    out |= zip([w for w, _ in now], self.stepped([b for _, b in now], self.steps))
                    now, size = [], 0
                if x is not None:
                    now.append(x)
                    size += len(x[1])
        return out

    def _learn(self, new: set[str], known: dict[str, Coded | None], before: str) -> None:
        single, cut = {}, {}
        for p in new:
            if p.isalpha():
                single[p] = before + p  # letters only: one word
            elif not p or self.edge.search(p[1:] if p[0] == "\n" and before else p) or p == "\n":
                known[p] = None  # white space meets white space: only the whole text tells
            else:
                cut[p] = self.pattern.findall(p if p[0] == "\n" else before + p)
        words = self.words({*single.values(), *itertools.chain.from_iterable(cut.values())})
        for p, w in single.items():
            known[p] = words[w]
        for p, ws in cut.items():
            own = [words[w] for w in ws]
            known[p] = ",".join([x for x, _ in own]), b"".join([x for _, x in own])

    def texts(self, texts: list[str]) -> list[list[Coded]]:
        """Per text its pieces: identifiers in decimal joined by commas, and the bytes that these decode to."""
        for known in (self.pieces, self.heads):
            if len(known) > CACHE:
                known.clear()
        cut = [t.replace("\n", " \n").split(" ") for t in texts]
        heads = [c.pop(0) for c in cut]
        for found, known, before in ((set().union(*cut), self.pieces, " "), (set(heads), self.heads, "")):
            if new := found - known.keys():
                self._learn(new, known, before)
        out = [[self.heads[h], *map(self.pieces.__getitem__, c)] for h, c in zip(heads, cut)]
        odd = {k: self.pattern.findall(texts[k]) for k, pieces in enumerate(out) if None in pieces}
        if odd:
            words = self.words({w for ws in odd.values() for w in ws})
            for k, ws in odd.items():
                out[k] = [words[w] for w in ws]
        return out

    def decoded(self, sequences: list[str]) -> list[bytes]:
        """The bytes of sequences of identifiers, each in decimal joined by commas."""
        self.db.register("sequences", pa.table({"w": pa.array(range(len(sequences)), pa.int32()), "s": pa.array(sequences, pa.string())}))
        try:
            return [x[1] if x else b"" for x in self._coded("select w, string_split(s, ',')::integer[] as ts from sequences where s <> ''", len(sequences))]
        finally:
            self.db.unregister("sequences")

    def portions(self, texts: list[str]) -> Iterator[list[list[Coded]]]:
        """texts() of portions of bounded size, in order."""
        now, size = [], 0
        for i, t in enumerate(texts):
            now.append(t)
            size += len(t)
            if size >= TEXT_AT_ONCE or i + 1 == len(texts):
                gc.disable()  # many short lists, no cycles
                try:
                    got = self.texts(now)
                finally:
                    gc.enable()
                yield got
                now, size = [], 0


_ENGINES: dict[tuple[str, str], SqlBpe] = {}


def engine(path: str, pattern: str) -> SqlBpe:
    """One engine per Python worker, kept over its tasks."""
    if (path, pattern) not in _ENGINES:
        _ENGINES[path, pattern] = SqlBpe(read_ranks(path), pattern)
    return _ENGINES[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): each text's identifiers as an array, empty for null and empty texts. Null ids stay null, repeated rows
    repeat, an empty table gives no rows; other columns of docs are not read."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = engine(path, pattern)
        for b in batches:
            ids = [[int(i) for s, _ in pieces for i in s.split(",")] for got in e.portions([t or "" for t in b.column(1).to_pylist()]) for pieces in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes): the bytes of each row's identifiers, by an ordered aggregation; null and empty arrays give none. An
    identifier that the vocabulary lacks is an error."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = engine(path, pattern)
        for b in batches:
            raw = e.decoded([",".join(map(str, x or [])) for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["id", "bytes"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the identifiers, in decimal joined by commas, and of the
    bytes that decoding these identifiers gives. Cases as in encode()."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = engine(path, pattern)
        for b in batches:
            n, x, y = [], [], []
            for got in e.portions([t or "" for t in b.column(1).to_pylist()]):
                for pieces in got:
                    ids, raw = ",".join([x for x, _ in pieces]), b"".join([x for _, x in pieces])
                    n.append(ids.count(",") + 1 if ids else 0), x.append(hashlib.sha256(ids.encode()).hexdigest()), y.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
