"""Text of a page in reading order: blocks by recursive cuts along white space, or the order of the structure tree."""

from __future__ import annotations

import math
import re

from .layout import rows_of, upper_median

MAX_CUTS = 24
#: Points that a baseline may be off within a line.
TOLERANCE = 2.0
#: Structure types that begin a new line.
BLOCK_LEVEL = frozenset("Document Part Art Sect Div BlockQuote Caption TOC TOCI Index P H H1 H2 H3 H4 H5 H6 L LI Table TR Note Figure Formula".split())
#: Unicode ranges that are written from right to left.
RTL = "\u0590-\u08ff\ufb1d-\ufdff\ufe70-\ufeff"
_RTL_CHAR = re.compile(f"[{RTL}]")


def _gap_below(spans: list[dict], unit: float) -> float | None:
    """The middle of the widest stretch of height that no span touches, at least 0.8 units."""
    best, cut, top = 0.0, None, None
    for low, high in sorted((s["y"] - 0.2 * s["size"], s["y"] + 0.8 * s["size"]) for s in spans):
        if top is not None and low - top > best:
            best, cut = low - top, (low + top) / 2
        top = high if top is None else max(top, high)
    return cut if best >= 0.8 * unit else None


def _column(spans: list[dict], unit: float) -> float | None:
    """The x in the middle three fifths that lies in the most rows' gaps, if at least half of the rows and two have one there."""
    rows = rows_of(spans, lambda a, s: 0.6 * unit)
    ends = []
    for row in rows:
        right = None
        for s in row:
            if right is not None and s["x"] - right > 0.5 * unit:
                ends += [(right, 1), (s["x"], -1)]
            right = s["x"] + s["advance"] if right is None else max(right, s["x"] + s["advance"])
    left, right = min(s["x"] for s in spans), max(s["x"] + s["advance"] for s in spans)
    ends.sort()
    best, at, depth = 0, None, 0
    for (x, step), (after, _) in zip(ends, ends[1:]):
        depth += step
        mid = (x + after) / 2
        if after - x >= 1e-6 and depth > best and min(mid - left, right - mid) >= 0.2 * (right - left):
            best, at = depth, mid
    return at if best >= max(2, math.ceil(len(rows) / 2)) else None


def blocks(spans: list[dict], unit: float) -> list[list[dict]]:
    """Blocks in reading order. Full-width gaps part first; then one cut into columns, which are only parted downwards."""
    out, todo = [], [(spans, 0, True)]
    while todo:
        own, depth, columns = todo.pop()
        if depth < MAX_CUTS and len(own) > 1:
            y = _gap_below(own, unit)
            x = _column(own, unit) if y is None and columns else None
            first = [s for s in own if (s["y"] >= y if y is not None else x is not None and s["x"] + s["advance"] / 2 < x)]
            if 0 < len(first) < len(own):
                ids = set(map(id, first))
                todo += [([s for s in own if id(s) not in ids], depth + 1, columns and x is None), (first, depth + 1, columns and x is None)]
                continue
        out.append(own)
    return out


def _joined(spans: list[dict], breaks) -> str:
    out, end = "", None
    for s, new_line in zip(spans, breaks):
        if new_line:
            out += "\n"
        elif out and s["x"] - end > 0.25 * s["size"] and not out[-1].isspace() and not s["text"][:1].isspace():
            out += " "
        out += s["text"]
        end = s["x"] + s["advance"]
    return out


def block_text(block: list[dict], tolerance: float = TOLERANCE) -> str:
    """A new line where the baseline is further from the line's first one than tolerance and half the size."""
    own, breaks, anchor = sorted(block, key=lambda s: (-s["y"], s["x"])), [], None
    for s in own:
        breaks.append(anchor is not None and abs(anchor - s["y"]) > max(tolerance, 0.5 * s["size"]))
        anchor = s["y"] if anchor is None or breaks[-1] else anchor
    return _joined(own, breaks)


def in_logical_order(line: str) -> str:
    """Stretches from right-to-left characters to others, without letters of other scripts between, are turned round."""
    if not _RTL_CHAR.search(line):
        return line
    out, at, is_rtl = "", 0, [bool(_RTL_CHAR.match(c)) for c in line]
    while at < len(line):
        if not is_rtl[at]:
            out, at = out + line[at], at + 1
            continue
        stop = next((j for j in range(at, len(line)) if line[j].isalpha() and not is_rtl[j]), len(line))
        last = max(j for j in range(at, stop) if is_rtl[j])
        out, at = out + line[at : last + 1][::-1], last + 1
    return out


def text(spans: list[dict], tolerance: float = TOLERANCE) -> str:
    shown = [s for s in spans if s["text"] and all(map(math.isfinite, (s["x"], s["y"], s["size"], s["advance"])))]
    if not shown:
        return ""
    unit = max(1.0, upper_median([s["size"] for s in shown]))
    return "\n".join(in_logical_order(x) for b in blocks(shown, unit) for x in block_text(b, tolerance).split("\n"))


class _Lines:
    """Text put together from spans and replacements; only block-level elements and lines of the page break it."""

    def __init__(self):
        self.out, self.last = "", None  # last: end, baseline and size of the span before

    def span(self, s: dict) -> None:
        if self.last is not None:
            end, y, size = self.last
            if abs(y - s["y"]) > 0.5 * max(size, s["size"]):
                self.out += "\n"
            elif s["x"] - end > 0.25 * s["size"]:
                self._space(s["text"])
        self.out += s["text"]
        self.last = (s["x"] + s["advance"], s["y"], s["size"])

    def replacement(self, t: str) -> None:
        """Text of unknown place: a space parts it from what is before."""
        if self.last is not None:
            self._space(t)
        self.out += t
        self.last = None

    def _space(self, t: str) -> None:
        if self.out and not self.out[-1].isspace() and not t[:1].isspace():
            self.out += " "

    def block(self) -> None:
        if self.out and not self.out.endswith("\n"):
            self.out += "\n"
        self.last = None


def structured(spans: list[dict], tree: list[dict], page: int) -> str:
    """Text by the structure tree (Pdf.structure()): ActualText stands for all below it, Alt where nothing else is. What no
    element holds follows in reading order."""
    held: dict[int, list[dict]] = {}
    for s in spans:
        if s["text"] and s["mcid"] is not None:
            held.setdefault(s["mcid"], []).append(s)
    used: set[int] = set()
    lines = _Lines()

    def contents(node: int) -> list[int]:
        found, todo = [], [node]
        while todo:
            for k in tree[todo.pop()]["kids"]:
                if k[0] == "element":
                    todo.append(k[1])
                elif k[1] == page:
                    found.append(k[2])
        return found

    def walk(node: int) -> None:
        e = tree[node]
        here, block = e["page"] is None or e["page"] == page, e["role"] in BLOCK_LEVEL
        if block:
            lines.block()
        if e["actual_text"] is not None:
            if here:
                lines.replacement(e["actual_text"])
                used.update(contents(node))
        else:
            before = len(lines.out)
            for k in e["kids"]:
                if k[0] == "element":
                    walk(k[1])
                elif k[1] == page and k[2] in held:
                    used.add(k[2])
                    for s in held[k[2]]:
                        lines.span(s)
            if here and e["alt"] is not None and not lines.out[before:].strip():
                lines.replacement(e["alt"])
        if block:
            lines.block()

    for e in tree:
        if e["parent"] is None:
            walk(e["node"])
    rest = text([s for s in spans if s["mcid"] is None or s["mcid"] not in used])
    own = "\n".join(map(in_logical_order, lines.out.strip().split("\n")))
    return "\n".join(x for x in (own, rest) if x)
