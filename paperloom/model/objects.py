"""PDF objects: a lexer and parser over bytes, and stream filters. Pure Python, no Spark."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np

MAX_DEPTH = 100
#: Bytes that all filters of one stream may give together; more is an error, never a shorter stream.
MAX_DECODED = 256 << 20


class PdfError(ValueError):
    pass


@dataclass(frozen=True)
class Limits:
    """What reading a file may take. Beyond objects or decoded bytes something fails, beyond operators a page is cut."""

    objects: int = 5_000_000
    decoded: int = MAX_DECODED
    operators: int = 1_000_000
    pages: int = 1_000_000


class Budget:
    """Counts what the filters of a stream give, and fails beyond the limit."""

    def __init__(self, limit: int | None = None):
        self.left = MAX_DECODED if limit is None else limit

    def take(self, n: int) -> None:
        self.left -= n
        if self.left < 0:
            raise PdfError("a stream decodes to more than the limit")


class Name(str):
    __slots__ = ()


class Ref:
    """A reference. Files are full of them, so it is a plain class and not a frozen dataclass, which is made several times slower."""

    __slots__ = ("num", "gen")

    def __init__(self, num: int, gen: int):
        self.num, self.gen = num, gen

    def __eq__(self, other) -> bool:
        return other.__class__ is Ref and other.num == self.num and other.gen == self.gen

    def __hash__(self) -> int:
        return hash((self.num, self.gen))

    def __repr__(self) -> str:
        return f"Ref(num={self.num!r}, gen={self.gen!r})"


class Keyword(str):
    __slots__ = ()


@dataclass
class Stream:
    dict: dict
    raw: bytes
    extra: dict = field(default_factory=dict)


_SPACE = b"\x00\t\n\x0c\r "
#: One token by its kind, which lastindex tells: an integer, a name, a string without escapes and parentheses, a hexadecimal
#: string of digits alone, another run of regular characters, anything else; none at the end.
_KINDS = rb"([+-]?\d+)(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])|/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|\(([^\\()]*)\)|<([0-9A-Fa-f]*)>|([^\x00\t\n\x0c\r ()<>\[\]{}/%]+)|(<<|>>|.)"
#: White space and comments; possessive, so that what follows may fail without trying comments in all their parts.
SKIPPED = rb"[\x00\t\n\x0c\r ]*+(?:%[^\r\n]*+[\x00\t\n\x0c\r ]*+)*+"
#: No regular character follows.
END_OF_WORD = rb"(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])"
INTEGER, NAME, STRING, DIGITS, REGULAR, OTHER = range(1, 7)
TOKEN = re.compile(SKIPPED + rb"(?:" + _KINDS + rb")?", re.S)
#: The same where two integers and an R are a reference.
_TOKEN_OR_REF = re.compile(SKIPPED + rb"(?:(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R" + END_OF_WORD + rb"|" + _KINDS + rb")?", re.S)
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")
#: Names and keywords met so far, which most files share; at most so many.
_NAMES: dict[bytes, Name] = {}
_KEYS: dict[bytes, str] = {}
_KEYWORDS: dict[bytes, object] = {}
MOST_SHARED = 10_000
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\x0c"}
END = Keyword("")


class Parser:
    """Reads objects from data at pos. Content streams have no references; operators come as keywords."""

    def __init__(self, data: bytes, pos: int = 0, refs: bool = True):
        self.data, self.pos, self.refs = data, pos, refs
        self._match, self._before = (_TOKEN_OR_REF.match, 2) if refs else (TOKEN.match, 0)  # groups before the kinds

    def next(self, depth: int = 0):
        if depth > MAX_DEPTH:
            raise PdfError("objects nested too deeply")
        m = self._match(self.data, self.pos)
        self.pos = m.end()
        at = m.lastindex
        if at is None:
            return END
        t, kind = m[at], at - self._before
        if kind == NAME:
            return _NAMES.get(t) or name_of(t)
        if kind == INTEGER:
            return int(t)
        if kind == 0:
            return Ref(int(m[1]), int(t))
        if kind == STRING:
            return t
        if kind == REGULAR:
            return regular(t)
        if kind == DIGITS:
            return bytes.fromhex((t + b"0" * (len(t) % 2)).decode())
        if t == b"(":
            return self._string()
        if t == b"<":
            end = self.data.find(b">", self.pos)
            end = len(self.data) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.pos : end])
            self.pos = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if t == b"[":
            return self._array(depth + 1)
        if t == b"<<":
            return self._dictionary(depth + 1)
        return regular(t)

    def _array(self, depth: int) -> list:
        if depth > MAX_DEPTH:
            raise PdfError("objects nested too deeply")
        out, data, match, before = [], self.data, self._match, self._before
        while True:
            m = match(data, self.pos)
            at = m.lastindex
            if at is not None and at == before + INTEGER:  # the usual members without a call each
                self.pos = m.end()
                out.append(int(m[at]))
                continue
            if at is not None and at == before:
                self.pos = m.end()
                out.append(Ref(int(m[1]), int(m[2])))
                continue
            x = self.next(depth)
            if isinstance(x, Keyword) and (x is END or x == "]"):
                return out
            out.append(x)

    def _dictionary(self, depth: int) -> dict:
        if depth > MAX_DEPTH:
            raise PdfError("objects nested too deeply")
        out, data, match, before = {}, self.data, self._match, self._before
        name = before + NAME
        while True:
            m = match(data, self.pos)
            if m.lastindex != name:  # the end, or what is no key and is passed over
                k = self.next(depth)
                if isinstance(k, Keyword) and (k is END or k == ">>"):
                    return out
                continue
            k, m = key_of(m[name]), match(data, m.end())
            at = m.lastindex
            if at == name:  # the usual values without a call each
                v = name_of(m[at])
            elif at is not None and at == before:
                v = Ref(int(m[1]), int(m[2]))
            elif at == before + INTEGER:
                v = int(m[at])
            elif at == before + STRING:
                v = m[at]
            else:
                self.pos = m.start()
                v = self.next(depth)
                if isinstance(v, Keyword) and v == ">>":
                    return out
                out[k] = v
                continue
            self.pos = m.end()
            out[k] = v

    def _string(self) -> bytes:
        out, depth, data, i = bytearray(), 1, self.data, self.pos
        while i < len(data):
            c = data[i : i + 1]
            i += 1
            if c == b"\\":
                e = data[i : i + 1]
                if e in _ESCAPES:
                    out += _ESCAPES[e]
                    i += 1
                elif m := re.compile(rb"[0-7]{1,3}").match(data, i):
                    out.append(int(m[0], 8) & 255)
                    i = m.end()
                elif e in (b"\r", b"\n"):
                    i += 2 if data[i : i + 2] == b"\r\n" else 1
                else:
                    out += e
                    i += 1
            elif c == b")":
                depth -= 1
                if not depth:
                    break
                out += c
            else:
                depth += c == b"("
                out += c
        self.pos = i
        return bytes(out)


def name_of(raw: bytes) -> Name:
    """The name of these characters behind a slash."""
    found = _NAMES.get(raw)
    if found is None:
        plain = re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), raw) if b"#" in raw else raw
        found = Name(plain.decode("utf-8", "replace"))
        if len(_NAMES) < MOST_SHARED and len(raw) <= 64:
            _NAMES[raw] = found
    return found


def key_of(raw: bytes) -> str:
    """The same as a plain string, as dictionaries hold their keys."""
    found = _KEYS.get(raw)
    if found is None:
        found = str(name_of(raw))
        if len(_KEYS) < MOST_SHARED and len(raw) <= 64:
            _KEYS[raw] = found
    return found


def regular(t: bytes):
    """What a run of regular characters is: a number, a constant or a keyword."""
    if t in _KEYWORDS:
        return _KEYWORDS[t]
    if _NUMBER.fullmatch(t):
        return float(t) if b"." in t else int(t)
    found = {b"true": True, b"false": False, b"null": None}.get(t, Keyword(t.decode("latin-1")))
    if len(_KEYWORDS) < MOST_SHARED and len(t) <= 16:
        _KEYWORDS[t] = found
    return found


# Filters.


def _inflate(data: bytes, bits: int, budget: Budget) -> tuple[bytes, bool]:
    """What can be read, and whether it is whole."""
    d = zlib.decompressobj(bits)
    try:  # sound data without the copies that find damage
        whole = d.decompress(data, budget.left + 1)
        if d.eof:
            budget.take(len(whole))
            return whole, True
    except zlib.error:
        pass
    out, d, at = [], zlib.decompressobj(bits), 0
    step = len(data) or 1  # in one piece as long as it is sound
    while at < len(data):
        try:
            before = d.copy()
            got = d.decompress(data[at : at + step], budget.left + 1)
        except zlib.error:
            if step == 1:
                return b"".join(out), False
            d, step = before, max(1, step // 16)  # nearer to the damage
            continue
        budget.take(len(got))
        out.append(got)
        while d.unconsumed_tail:
            got = d.decompress(d.unconsumed_tail, budget.left + 1)
            budget.take(len(got))
            out.append(got)
        at += step
        if d.eof:
            break
    return b"".join(out), d.eof


def _flate(data: bytes, budget: Budget) -> bytes:
    """zlib data; if none can be read, without its header, or behind up to 16 stray bytes. A cut or damaged stream gives
    what can be read of it; nothing at all is an error."""
    if not data:
        return b""
    best = b""
    for start, bits in [(0, 15), (0, -15), *((k, 15) for k in range(1, min(16, len(data))) if data[k] & 15 == 8 and int.from_bytes(data[k : k + 2], "big") % 31 == 0)]:
        trial = Budget(budget.left)
        found, whole = _inflate(data[start:], bits, trial)
        if whole or (found and start == 0 and bits == 15):
            budget.left = trial.left
            return found
        best = max(best, found, key=len) if bits == 15 else best
    if not best:
        raise PdfError("no compressed data")
    budget.take(len(best))
    return best


def _lzw(data: bytes, early: int, budget: Budget) -> bytes:
    out, table, width, bits, have, last = bytearray(), [], 9, 0, 0, b""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code, bits = bits >> have, bits & (1 << have) - 1
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        if code == 257:
            break
        table = table or list(base)
        if code < len(table):
            entry = table[code]
        elif last:
            entry = last + last[:1]
        else:
            break
        budget.take(len(entry))
        out += entry
        if last and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        n = len(table) + early
        width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
    return bytes(out)


def _run_length(data: bytes, budget: Budget) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        more = data[i + 1 : i + 2 + n] if n < 128 else data[i + 1 : i + 2] * (257 - n)
        budget.take(len(more))
        out += more
        i += n + 2 if n < 128 else 2
    return bytes(out)


def _ascii85(data: bytes, budget: Budget) -> bytes:
    """Groups of five; z is four zero bytes, a last group may be short, characters outside the alphabet are passed over."""
    body = data.split(b"~")[0]
    out, group = bytearray(), []
    for c in body:
        if c == 0x7A and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(v * 85 ** (4 - i) for i, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group) - 1
        group += [84] * (5 - len(group))
        out += (sum(v * 85 ** (4 - i) for i, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")[:n]
    budget.take(len(out))
    return bytes(out)


def _samples(row: bytes, bits: int) -> np.ndarray:
    """Unsigned samples of a row, of 1, 2, 4, 8 or 16 bits."""
    if bits == 16:
        return np.frombuffer(row[: len(row) // 2 * 2], dtype=">u2").astype(np.uint32)
    raw = np.frombuffer(row, dtype=np.uint8)
    if bits == 8:
        return raw.astype(np.uint32)
    per = 8 // bits
    shifts = np.arange(per - 1, -1, -1, dtype=np.uint8) * bits
    return ((raw[:, None] >> shifts) & ((1 << bits) - 1)).astype(np.uint32).ravel()


def _packed(samples: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return samples.astype(">u2").tobytes()
    if bits == 8:
        return samples.astype(np.uint8).tobytes()
    per = 8 // bits
    shifts = np.arange(per - 1, -1, -1, dtype=np.uint32) * bits
    return (samples.reshape(-1, per) << shifts).sum(axis=1).astype(np.uint8).tobytes()


def _differences(data: bytes, colors: int, bits: int, width: int, columns: int) -> bytes:
    """Horizontal differences undone: each sample is the sum of its colour's so far, modulo its range."""
    out = []
    for i in range(0, len(data), width):
        row = data[i : i + width]
        v = _samples(row, bits)
        n = min(len(v) // colors, columns) * colors
        v[:n] = (np.cumsum(v[:n].reshape(-1, colors), axis=0, dtype=np.uint64) & ((1 << bits) - 1)).astype(np.uint32).ravel()
        out.append(_packed(v, bits)[: len(row)])
    return b"".join(out)


def _paeth(row: bytearray, above: bytes, step: int) -> None:
    for j in range(len(row)):
        a, b = row[j - step] if j >= step else 0, above[j]
        c = above[j - step] if j >= step else 0
        p = a + b - c
        row[j] = row[j] + min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2] & 255


def _unpredict(data: bytes, parms: dict) -> bytes:
    predictor = parms.get("Predictor", 1)
    if predictor < 2:
        return data
    colors, bpc, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    if not (1 <= colors <= 32 and bpc in (1, 2, 4, 8, 16) and 1 <= columns <= 1 << 24):
        raise PdfError("bad predictor parameters")
    step, width = max(1, colors * bpc // 8), (colors * bpc * columns + 7) // 8
    if predictor == 2:
        return _differences(data, colors, bpc, width, columns)
    out, above = [], bytes(width)
    for i in range(0, len(data), width + 1):
        kind, raw = data[i], data[i + 1 : i + 1 + width]
        up = np.frombuffer(above, dtype=np.uint8)[: len(raw)]
        if kind == 1:  # sums along the row, a lane for each byte of a pixel
            v = np.frombuffer(raw + bytes(-len(raw) % step), dtype=np.uint8).reshape(-1, step)
            raw = np.cumsum(v, axis=0, dtype=np.uint64).astype(np.uint8).tobytes()[: len(raw)]
        elif kind == 2:
            raw = (np.frombuffer(raw, dtype=np.uint8) + up).tobytes()
        elif kind == 3:
            row = bytearray(raw)
            for j in range(len(row)):
                row[j] = row[j] + ((row[j - step] if j >= step else 0) + above[j]) // 2 & 255
            raw = bytes(row)
        elif kind == 4:
            row = bytearray(raw)
            _paeth(row, above, step)
            raw = bytes(row)
        out.append(raw)
        above = raw + bytes(width - len(raw))
    return b"".join(out)


def decode_stream(s: Stream, resolve=lambda x: x, budget: Budget | None = None) -> bytes:
    """The stream's bytes after all its filters; image codecs are left encoded and end the chain."""
    budget = budget or Budget()
    names, parms = resolve(s.dict.get("Filter", s.dict.get("F"))), resolve(s.dict.get("DecodeParms", s.dict.get("DP")))
    names = names if isinstance(names, list) else [names] if isinstance(names, str) else []
    parms = parms if isinstance(parms, list) else [parms] * len(names)
    data = s.raw
    for i, n in enumerate(names):
        p = resolve(parms[i]) if i < len(parms) else None
        p = {k: resolve(v) for k, v in p.items()} if isinstance(p, dict) else {}
        n = resolve(n)
        if n in ("FlateDecode", "Fl"):
            data = _unpredict(_flate(data, budget), p)
        elif n in ("LZWDecode", "LZW"):
            data = _unpredict(_lzw(data, p.get("EarlyChange", 1), budget), p)
        elif n in ("ASCIIHexDecode", "AHx"):
            data = Parser(b"<" + data).next()
        elif n in ("ASCII85Decode", "A85"):
            data = _ascii85(data, budget)
        elif n in ("RunLengthDecode", "RL"):
            data = _run_length(data, budget)
        elif n != "Crypt":
            break
    return data
