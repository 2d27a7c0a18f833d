"""Fonts as far as text needs them: codes of a string, the characters they stand for, and their widths."""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache
from sys import byteorder

import numpy as np

from .glyphs import character
from .objects import END, Keyword, Name, Parser, Stream, decode_stream

#: Advance widths of standard fonts for the printable ASCII characters from space, in thousandths of an em.
HELVETICA = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
HELVETICA_BOLD = (
    278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 333, 333, 584, 584, 584, 611,
    975, 722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 333, 278, 333, 584, 556,
    333, 556, 611, 556, 611, 556, 333, 611, 611, 278, 278, 556, 278, 889, 611, 611, 611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389, 280, 389, 584,
)
TIMES = (
    250, 333, 408, 500, 500, 833, 778, 180, 333, 333, 500, 564, 250, 333, 250, 278, 500, 500, 500, 500, 500, 500, 500, 500, 500, 500, 278, 278, 564, 564, 564, 444,
    921, 722, 667, 667, 722, 611, 556, 722, 722, 333, 389, 722, 611, 889, 722, 722, 556, 722, 667, 556, 611, 722, 722, 944, 722, 722, 611, 333, 278, 333, 469, 500,
    333, 444, 500, 444, 500, 444, 333, 500, 500, 278, 278, 500, 278, 778, 500, 500, 500, 500, 333, 389, 278, 500, 500, 722, 500, 500, 444, 480, 200, 480, 541,
)
#: The characters of a base encoding where it isn't ASCII, from a code on; a space stands for none.
STANDARD_FROM_A1 = "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ –†‡· ¶•‚„”»…‰ ¿ `´ˆ˜¯˘˙¨ ˚¸ ˝˛ˇ—                Æ ª    ŁØŒº     æ   ı  łøœß"
PDFDOC_FROM_18 = "˘ˇˆ˙˝˛˚˜"
PDFDOC_FROM_80 = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž €"
SYMBOL_FROM_20 = " !∀#∃%&∋()∗+,−./0123456789:;<=>?≅ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ[∴]⊥_‾αβχδεφγηιϕκλμνοπθρστυϖωξψζ{|}∼"
SYMBOL_FROM_A0 = "€ϒ′≤⁄∞ƒ♣♦♥♠↔←↑→↓°±″≥×∝∂•÷≠≡≈…⏐⎯↵ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉∠∇®©™∏√⋅¬∧∨⇔⇐⇑⇒⇓◊〈®©™∑⎛⎜⎝⎡⎢⎣⎧⎨⎩⎪ 〉∫⌠⎮⌡⎞⎟⎠⎤⎥⎦⎫⎬⎭"
#: Zapf Dingbats codes that aren't at their place in the Unicode block of dingbats.
DINGBATS = {0x20: " ", 0x25: "☎", 0x2A: "☛", 0x2B: "☞", 0x48: "★", 0x6C: "●", 0x6E: "■", 0x73: "▲", 0x74: "▼", 0x75: "◆", 0x77: "◗", 0xA8: "♣", 0xA9: "♦", 0xAA: "♥", 0xAB: "♠", 0xD5: "→", 0xD6: "↔", 0xD7: "↕"}
#: Predefined maps of two-byte character sets, and the codec that reads their codes.
LEGACY = {"GBK": "gbk", "GBKp": "gbk", "GBK2K": "gb18030", "GB": "gb2312", "GBpc": "gb2312", "B5pc": "big5", "ETen": "big5", "ETenms": "big5", "HKscs": "big5hkscs", "90ms": "cp932", "90msp": "cp932", "90pv": "cp932", "EUC": "euc_jp", "KSC": "euc_kr", "KSCms": "cp949", "KSCpc": "euc_kr"}


def _placed(text: str, start: int) -> dict[int, str]:
    return {start + i: c for i, c in enumerate(text) if c != " " or start + i == 32}


def _codec(name: str) -> dict[int, str]:
    return {c: ch for c in range(32, 256) if (ch := bytes([c]).decode(name, "ignore")) and (c < 127 or c >= 160 or ch.isprintable()) and not 127 <= ord(ch) < 160}


ASCII = {c: chr(c) for c in range(32, 127)}
BASES: dict[str, dict[int, str]] = {
    "StandardEncoding": ASCII | {0x27: "’", 0x60: "‘"} | _placed(STANDARD_FROM_A1, 0xA1),
    "WinAnsiEncoding": _codec("cp1252") | {0xA0: " ", 0xAD: "-"} | dict.fromkeys((0x7F, 0x81, 0x8D, 0x8F, 0x90, 0x9D), "•"),
    "MacRomanEncoding": _codec("mac_roman") | {0xCA: " ", 0xDB: "¤"},
    "PDFDocEncoding": ASCII | {c: chr(c) for c in range(0xA1, 256) if c != 0xAD} | _placed(PDFDOC_FROM_18, 0x18) | _placed(PDFDOC_FROM_80, 0x80),
    "Symbol": _placed(SYMBOL_FROM_20, 0x20) | _placed(SYMBOL_FROM_A0, 0xA0),
    "ZapfDingbats": {c: chr(0x2701 + c - 0x21) for c in range(0x21, 0x7F)} | {c: chr(0x2761 + c - 0xA1) for c in range(0xA1, 0xFF) if c != 0xF0} | {c: chr(0x2460 + c - 0xAC) for c in range(0xAC, 0xB6)} | DINGBATS,
}


def _utf16(raw: bytes) -> str:
    return raw.decode("utf-16-be", "replace") if len(raw) % 2 == 0 else raw.decode("latin-1")


class CMap:
    """Code spaces, and what codes stand for: characters (ToUnicode) or identifiers (CID maps)."""

    def __init__(self, data: bytes = b"", other=None):
        self.spaces: list[tuple[int, int, int]] = list(other.spaces) if other else []  # (bytes, low, high)
        self.text: dict[tuple[int, int], str] = {}
        self.cids: dict[int, int] = dict(other.cids) if other else {}
        self.ranges: list[tuple[int, int, int]] = list(other.ranges) if other else []
        self.vertical = bool(other and other.vertical)
        self._read(data)

    def _read(self, data: bytes) -> None:
        p, args = Parser(data, refs=False), []
        while (o := p.next()) is not END:
            if not isinstance(o, Keyword):
                args.append(o)
                continue
            word, a, args = str(o), args, []
            if word == "endcodespacerange":
                self.spaces += [(len(lo), int.from_bytes(lo, "big"), int.from_bytes(hi, "big")) for lo, hi in zip(a[::2], a[1::2]) if isinstance(lo, bytes) and isinstance(hi, bytes)]
            elif word == "endbfchar":
                for code, to in zip(a[::2], a[1::2]):
                    if isinstance(code, bytes):
                        self.text[len(code), int.from_bytes(code, "big")] = _utf16(to) if isinstance(to, bytes) else character(str(to)) or ""
            elif word == "endbfrange":
                for lo, hi, to in zip(a[::3], a[1::3], a[2::3]):
                    if isinstance(lo, bytes) and isinstance(hi, bytes):
                        self._range(len(lo), int.from_bytes(lo, "big"), int.from_bytes(hi, "big"), to)
            elif word == "endcidchar":
                self.cids |= {int.from_bytes(c, "big"): n for c, n in zip(a[::2], a[1::2]) if isinstance(c, bytes) and isinstance(n, int)}
            elif word == "endcidrange":
                self.ranges += [(int.from_bytes(lo, "big"), int.from_bytes(hi, "big"), n) for lo, hi, n in zip(a[::3], a[1::3], a[2::3]) if isinstance(lo, bytes) and isinstance(hi, bytes) and isinstance(n, int)]
            elif word == "def" and len(a) >= 2 and a[-2] == "WMode":
                self.vertical = a[-1] == 1

    def _range(self, size: int, lo: int, hi: int, to) -> None:
        n = min(hi - lo + 1, 65_536)
        if isinstance(to, list):
            self.text |= {(size, lo + k): _utf16(x) for k, x in enumerate(to[:n]) if isinstance(x, bytes)}
        elif isinstance(to, bytes) and to:
            s = _utf16(to)
            if s and ord(s[-1]) + n <= 0x110000:
                self.text |= {(size, lo + k): s[:-1] + chr(ord(s[-1]) + k) for k in range(n)}

    def cid(self, code: int) -> int:
        if code in self.cids:
            return self.cids[code]
        return next((n + code - lo for lo, hi, n in self.ranges if lo <= code <= hi), 0)

    def split(self, raw: bytes) -> list[tuple[int, int]]:
        """(bytes, code) of a string by the code spaces; two bytes where none fits."""
        if not self.spaces or all(n == 2 for n, _, _ in self.spaces):
            return [(2, int.from_bytes(raw[i : i + 2], "big")) for i in range(0, len(raw) - 1, 2)]
        out, i, sizes = [], 0, sorted({n for n, _, _ in self.spaces})
        while i < len(raw):
            for n in sizes:
                own = raw[i : i + n]
                if len(own) == n and any(n == m and all(a <= c <= b for a, c, b in zip(lo.to_bytes(n, "big"), own, hi.to_bytes(n, "big"))) for m, lo, hi in self.spaces):
                    break
            else:
                n = min(sizes[0], len(raw) - i)
                own = raw[i : i + n]
            out.append((n, int.from_bytes(own, "big")))
            i += n
        return out


class Font:
    """One font: show() gives what a string of it says and how far it moves, in thousandths of the size."""

    def __init__(self, pdf, d: dict):
        self.two = pdf.get(d.get("Subtype")) == "Type0"
        self.name = str(pdf.get(d.get("BaseFont")) or "").split("+")[-1]
        self.vertical = self.plain = False
        self.whole: np.ndarray | None = None
        to = pdf.get(d.get("ToUnicode"))
        self.unicode = CMap(decode_stream(to, pdf.get)) if isinstance(to, Stream) else None
        if self.two:
            self._composite(pdf, d)
        else:
            self._simple(pdf, d)

    # Simple fonts: a byte a character.

    def _simple(self, pdf, d: dict) -> None:
        kind, flags = pdf.get(d.get("Subtype")), pdf.get(pdf.dict(d.get("FontDescriptor")).get("Flags")) or 0
        symbolic, encoding = isinstance(flags, int) and bool(flags & 4), pdf.get(d.get("Encoding"))
        if not self.unicode and not isinstance(encoding, dict) and not pdf.list(d.get("Widths")):
            self.table, self.advances, self.plain, self.whole = _plain(self.name, kind if isinstance(kind, str) else None, encoding if isinstance(encoding, str) else None, symbolic)
            return
        table = dict(self._base(pdf, self.name, encoding, kind, symbolic))
        for code, name in self._differences(pdf, encoding):
            table[code] = character(name) or ""
        if self.unicode:
            table |= {code: s for (size, code), s in self.unicode.text.items() if size <= 2 and code < 256}
        self.table = _filled(table)
        first, widths = pdf.get(d.get("FirstChar")) or 0, pdf.list(d.get("Widths"))
        if widths:
            missing = pdf.get(pdf.dict(d.get("FontDescriptor")).get("MissingWidth")) or 0
            own = {first + i: w for i, w in enumerate(map(pdf.get, widths)) if isinstance(w, (int, float))}
            scale = 1.0
            if kind == "Type3":  # widths are in glyph space
                m = [pdf.get(x) for x in pdf.list(d.get("FontMatrix"))]
                scale = m[0] * 1000 if m and isinstance(m[0], (int, float)) else 1.0
            self.advances = [own.get(c, missing) * scale for c in range(256)]
        else:
            self.advances = [standard_width(self.name, self.table[c]) for c in range(256)]

    @staticmethod
    def _base(pdf, own: str, encoding, kind, symbolic: bool) -> dict[int, str]:
        default = BASES["Symbol"] if own.startswith("Symbol") else BASES["ZapfDingbats"] if own.startswith("ZapfDingbats") else BASES["WinAnsiEncoding" if kind == "TrueType" else "StandardEncoding"]
        if isinstance(encoding, str) and encoding in BASES:
            return BASES[encoding]
        if isinstance(encoding, dict):
            return BASES.get(pdf.get(encoding.get("BaseEncoding")), default)
        return {} if symbolic and default not in (BASES["Symbol"], BASES["ZapfDingbats"]) else default

    @staticmethod
    def _differences(pdf, encoding) -> list[tuple[int, str]]:
        out, code = [], None
        for x in pdf.list(encoding.get("Differences")) if isinstance(encoding, dict) else []:
            if isinstance(x, int):
                code = x if 0 <= x <= 255 else None
            elif isinstance(x, Name) and code is not None:
                out.append((code, str(x)))
                code = code + 1 if code < 255 else None
        return out

    # Composite fonts: codes of one to four bytes, by a map.

    def _composite(self, pdf, d: dict) -> None:
        encoding, below = pdf.get(d.get("Encoding")), pdf.dict((pdf.list(d.get("DescendantFonts")) or [None])[0])
        self.codec, self.direct = None, False
        if isinstance(encoding, Stream):
            other = pdf.get(encoding.dict.get("UseCMap"))
            self.map = CMap(decode_stream(encoding, pdf.get), CMap(decode_stream(other, pdf.get)) if isinstance(other, Stream) else None)
            self.vertical = self.map.vertical or pdf.get(encoding.dict.get("WMode")) == 1
        else:
            name = str(encoding or "Identity-H")
            self.map, self.vertical = CMap(), name.endswith("-V")
            self.direct = name.startswith("Uni")  # the code is the character
            self.codec = None if self.direct else LEGACY.get(name.split("-")[0])
        self.identity = not isinstance(encoding, Stream)
        self.missing = pdf.get(below.get("DW"))
        self.missing = float(self.missing) if isinstance(self.missing, (int, float)) else 1000.0
        self.widths: dict[int, float] = {}
        self._runs([pdf.get(x) for x in pdf.list(below.get("W"))], pdf, 1, lambda cid, v: self.widths.__setitem__(cid, v[0]))
        down = [pdf.get(x) for x in pdf.list(below.get("DW2"))]
        self.down = float(down[1]) if len(down) == 2 and isinstance(down[1], (int, float)) else -1000.0
        self.downs: dict[int, float] = {}
        if self.vertical:
            self._runs([pdf.get(x) for x in pdf.list(below.get("W2"))], pdf, 3, lambda cid, v: self.downs.__setitem__(cid, v[0]))
        #: The characters of codes that are all of two bytes and their own identifiers, the usual case.
        plain = self.identity and not (self.codec or self.direct or self.vertical or self.map.spaces)
        self.pairs = {code: s for (n, code), s in (self.unicode.text if self.unicode else {}).items() if n == 2} if plain else None

    @staticmethod
    def _runs(flat: list, pdf, size: int, put) -> None:
        """Width arrays: first [values ...], or first last values."""
        i = 0
        while i + 1 < len(flat):
            if isinstance(flat[i + 1], list):
                own = [pdf.get(x) for x in flat[i + 1]]
                for k in range(0, len(own) - size + 1, size):
                    put(flat[i] + k // size, own[k : k + size])
                i += 2
            else:
                own = flat[i + 2 : i + 2 + size]
                if len(own) == size and all(isinstance(x, int) for x in flat[i : i + 2]):
                    for cid in range(flat[i], min(flat[i + 1], flat[i] + 65_535) + 1):
                        put(cid, own)
                i += 2 + size

    def _codes(self, raw: bytes) -> list[tuple[int, int, str]]:
        """(bytes, code, character)."""
        if self.codec:
            out, i = [], 0
            while i < len(raw):
                for n in (1, 2, 4):
                    try:
                        c = raw[i : i + n].decode(self.codec)
                    except UnicodeDecodeError:
                        continue
                    break
                else:
                    n, c = 1, ""
                out.append((n, int.from_bytes(raw[i : i + n], "big"), c))
                i += n
            return out
        if self.direct:
            text = raw.decode("utf-16-be", "replace")
            return [(len(c.encode("utf-16-be", "surrogatepass")), ord(c), c) for c in text]
        found = self.unicode.text if self.unicode else {}
        return [(n, code, found.get((n, code), "")) for n, code in self.map.split(raw)]

    def show(self, raw: bytes) -> tuple[str, float, int, int]:
        """(text, sum of advances, characters, single-byte spaces)."""
        if not self.two:
            text = raw.decode("latin-1")
            if not (self.plain and text.isascii() and text.isprintable()):
                text = text.translate(self.table)
            if self.whole is not None and len(raw) > 64:  # sums of whole numbers, exact in any order
                return text, float(self.whole[np.frombuffer(raw, dtype=np.uint8)].sum()), len(raw), raw.count(b" ")
            return text, sum(map(self.advances.__getitem__, raw)), len(raw), raw.count(b" ")
        if self.pairs is not None:
            own = array("H", raw[: len(raw) & ~1])
            if byteorder == "little":
                own.byteswap()
            total = self.missing * len(own) if not self.widths and self.missing.is_integer() else sum([self.widths.get(c, self.missing) for c in own])
            return "".join([self.pairs.get(c, "") for c in own]), total, len(own), 0
        codes = self._codes(raw)
        cid = (lambda c: c) if self.identity else self.map.cid
        if self.vertical:
            total = sum(self.downs.get(cid(c), self.down) for _, c, _ in codes)
        else:
            total = sum(self.widths.get(cid(c), self.missing) for _, c, _ in codes)
        return "".join([t for _, _, t in codes]), total, len(codes), sum(n == 1 and c == 32 for n, c, _ in codes)


def _filled(table: dict[int, str]) -> dict[int, str]:
    """What each byte stands for."""
    return {c: table.get(c, chr(c) if 32 <= c < 127 or 161 <= c else "") for c in range(256)}


@lru_cache(maxsize=256)
def _plain(name: str, kind: str | None, encoding: str | None, symbolic: bool) -> tuple[dict[int, str], list[float], bool, np.ndarray]:
    """Characters and widths of a font that says no more than its name and its encoding; files share a few of these. Also
    whether it leaves printable ASCII as it is, and the widths as an array, which are whole numbers."""
    table = _filled(Font._base(None, name, encoding, kind, symbolic))
    advances = [standard_width(name, table[c]) for c in range(256)]
    return table, advances, all(table[c] == chr(c) for c in range(32, 127)), np.array(advances)


@lru_cache(maxsize=16_384)
def standard_width(name: str, char: str) -> float:
    """Of one of the standard fonts, by its name; an accented letter is as wide as its base. 500 where it isn't known."""
    if name.startswith("Courier"):
        return 600.0
    widths = TIMES if name.startswith("Times") else HELVETICA_BOLD if "Bold" in name else HELVETICA
    base = unicodedata.normalize("NFD", char)[:1]
    return float(widths[ord(base) - 32]) if base and 32 <= ord(base) < 127 else 500.0
