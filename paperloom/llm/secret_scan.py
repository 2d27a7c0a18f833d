"""Secrets in text: fixed patterns, and values in a credential context that would be costly to guess.

The cost of a value is the base-10 logarithm of the guesses of an attacker who knows how people choose passwords: the
cheapest way, by dynamic programming over the value, to cut it into common words, dates, repeats, keyboard walks and
brute-force spans. Every part of a value that is such a span is a candidate, so the result is the minimum over all ways to
cut it. A value after a credential word is a secret if its cost reaches a threshold;
letters alone only after a sign, since "is" and "bearer" also stand before words of prose.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]++")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
#: What a text must hold, lower-cased, before ASSIGN or CONTEXT can match.
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT_HINTS = (*ASSIGN_HINTS, "passphrase", "passcode", "pwd", "api-key", "api key", "access key", "access-key", "access_key", "private key", "private_key", "bearer", "credential")
_CREDENTIAL = r"(?:password|passwd|passphrase|passcode|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?)"
#: Before a sign the credential word may stand anywhere in a name; before "is" it must end one.
#: What follows in the name holds no other such word, so that a long name is read once.
CONTEXT = re.compile(
    rf"(?ai:{_CREDENTIAL}(?:(?:(?!{_CREDENTIAL})[A-Z0-9_-])*+[\"'`]?\x20{{0,3}}(?P<sign>=>|:=|[:=])|[\"']?\x20{{0,3}}\bis\b)|\bbearer)\x20{{0,3}}[\"'`]?"
    r"(?P<value>[^\s\"'`<>,;]{6,}+)",
    re.A,
)
#: Words that people use in passwords, commonest first.
COMMON = (
    "password pass admin letmein welcome monkey dragon master login love sunshine princess football baseball shadow superman "
    "hello freedom whatever trustno secret summer winter spring autumn flower test guest root user changeme default qazwsx "
    "michael jordan hunter charlie batman soccer hockey killer george pepper cheese coffee orange banana purple silver "
    "computer internet server access system example sample demo token key value none null undefined"
).split()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
LONGEST = max(map(len, COMMON))
LEET = str.maketrans("@4310$5!7", "aaeiossit")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
#: Dates, each part of which may be one too (a year in a date), so whole matches at every length are tried.
DATE = re.compile(r"(?:19|20)\d\d[-/._]?\d{1,2}[-/._]?\d{1,2}|\d{1,2}[-/._]\d{1,2}[-/._](?:(?:19|20)?\d\d)|(?:19|20)\d\d", re.A)
DATE_LENGTHS = range(4, 11)
LONGEST_UNIT, LEAST_REPEATS, LEAST_WALK = 8, 3, 3
SPAN_COST = 0.5  # of one more span
THRESHOLD = 8.0


def _char_cost(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


def word_cost(word: str) -> float | None:
    """Cost of a common word, also with capitals or with digits and signs for letters; null if it is none."""
    low = word.lower()
    if len(low) != len(word):
        return None
    plain, extra = low.translate(LEET), 0.0
    rank = RANK.get(low)
    if rank is None and (rank := RANK.get(plain)) is not None:
        extra = math.log10(2) * sum(a != b for a, b in zip(low, plain))
    if rank is None:
        return None
    upper = sum(c.isupper() for c in word)
    return math.log10(rank + 1) + extra + math.log10(2) * min(upper, len(word) - upper + 1)


def date_cost(s: str) -> float | None:
    return None if not DATE.fullmatch(s) else 2.1 if len(s) == 4 else 4.6


def step(a: str, b: str) -> tuple[int, int] | None:
    """The move on the keyboard from a key to a neighbour; null if they aren't neighbours."""
    if (x := PLACE.get(a.lower())) is None or (y := PLACE.get(b.lower())) is None or x == y:
        return None
    return (y[0] - x[0], y[1] - x[1]) if max(abs(y[0] - x[0]), abs(y[1] - x[1])) <= 1 else None


class _Starts:
    """Starts i of spans whose cost is base(i) + log10((j - i) / unit) at the end j, and the cheapest at each j.

    Of two starts the earlier one gets cheaper against the later one as j grows, and once cheaper it stays so. So a stack
    is enough: the newest start that isn't beaten is on top, and the next below is the first to beat it.
    """

    def __init__(self, unit: int):
        self.unit, self.stack = unit, []  # (start, base, end from which the start below is as cheap)

    @staticmethod
    def _beaten(older: tuple, start: int, base: float) -> float:
        """The end from which an older start is as cheap as this one: (j - older) / (j - start) <= 10 ** difference."""
        ratio = 10.0 ** min(300.0, base - older[1])
        return math.inf if ratio <= 1 else (ratio * start - older[0]) / (ratio - 1)

    def put(self, start: int, base: float, now: int) -> None:
        while self.stack:
            end = self._beaten(self.stack[-1], start, base)
            if end <= now:
                return
            if len(self.stack) > 1 and self.stack[-1][2] <= end:
                self.stack.pop()
                continue
            self.stack.append((start, base, end))
            return
        self.stack.append((start, base, math.inf))

    def least(self, j: int) -> float:
        while len(self.stack) > 1 and self.stack[-1][2] <= j:
            self.stack.pop()
        if not self.stack:
            return math.inf
        start, base, _ = self.stack[-1]
        return base + math.log10((j - start) / self.unit)


def guess_cost(value: str) -> float:
    """log10 of the guesses for value; 0 for an empty value. Time grows linearly with its length."""
    n, turn = len(value), math.log10(4)
    best = [0.0] + [math.inf] * n  # cheapest segmentation of each prefix
    brute = math.inf  # the same, if it ends in a brute-force span
    chars = [0.0]  # cost of the characters before each place
    repeats = [[_Starts(u) for _ in range(u)] for u in range(1, LONGEST_UNIT + 1)]  # by unit and by start modulo unit
    since = [0] * (LONGEST_UNIT + 1)  # by unit: from where the value repeats itself up to here
    walks, walk_from, before, turns = _Starts(1), 0, None, [0]  # turns[k]: turns up to character k of the walk so far
    for j in range(1, n + 1):
        c = value[j - 1]
        chars.append(chars[-1] + _char_cost(c))
        brute = min(brute, best[j - 1] + SPAN_COST) + _char_cost(c)
        least = brute
        for i in range(max(0, j - LONGEST), j - 2):
            if (cost := word_cost(value[i:j])) is not None:
                least = min(least, best[i] + SPAN_COST + cost)
        if c.isdigit():
            for k in DATE_LENGTHS:
                if k <= j and (cost := date_cost(value[j - k : j])) is not None:
                    least = min(least, best[j - k] + SPAN_COST + cost)
        for u in range(1, min(LONGEST_UNIT, j - 1) + 1):
            if c != value[j - 1 - u]:
                since[u] = j - u
                for s in repeats[u - 1]:
                    s.stack.clear()
                continue
            own, i = repeats[u - 1][j % u], j - LEAST_REPEATS * u
            if i >= since[u]:
                own.put(i, best[i] + chars[i + u] - chars[i], j)
                least = min(least, own.least(j) + SPAN_COST)
        if j > 1:
            way = step(value[j - 2], c)
            if way is None:
                walk_from, before = j - 1, None
                walks.stack.clear()
                turns.append(0)
            else:
                turns.append(turns[-1] + (before is not None and way != before))
                before = way
                i = j - LEAST_WALK
                if i >= walk_from:
                    walks.put(i, best[i] + math.log10(47) - turn * turns[i + 1], j)
                    least = min(least, walks.least(j) + turn * turns[j - 1] + SPAN_COST)
        best[j] = least
    return max(0.0, best[n] - SPAN_COST) if n else 0.0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the fixed patterns, leftmost and non-overlapping per kind, by start and then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def costly_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """Spans ("guess", start, end) of the values in a credential context whose guess cost reaches the threshold."""
    low = text.lower()
    if not any(h in low for h in CONTEXT_HINTS):
        return []
    out = []
    for m in CONTEXT.finditer(text):
        value = m["value"].rstrip(".!?)]}*#$%&|")
        if len(value) >= 6 and (m["sign"] or not value.isalpha()) and any(c.isascii() and c.isalnum() for c in value) and guess_cost(value) >= threshold:
            out.append(("guess", m.start("value"), m.start("value") + len(value)))
    return out


def scan(text: str | None, threshold: float = THRESHOLD) -> tuple[list, list]:
    """(base spans, all spans): a costly value is added unless a base span overlaps it."""
    if not text:
        return [], []
    base = base_spans(text)
    added = [s for s in costly_spans(text, threshold) if not any(b[1] < s[2] and s[1] < b[2] for b in base)]
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, base_sha256, spans (text), found (array of structs).

    Offsets are code points, ends exclusive. Null text: no spans. Null ids stay null, repeated rows repeat, an empty table
    gives no rows; other columns of docs are not read.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digest, spans, found = ([], [], []), [], [], []
            for t in b.column(1).to_pylist():
                base, every = scan(t, threshold)
                for c, k in zip(counts, KINDS):
                    c.append(sum(s[0] == k for s in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                found.append([{"kind": k, "start": i, "end": j} for k, i, j in every])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(found, kind)], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long>>")
