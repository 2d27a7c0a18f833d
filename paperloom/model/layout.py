"""Text of a page from its spans: rows, lines with characters, search hits, ruled or aligned tables."""

from __future__ import annotations

import math
import re


def upper_median(values: list[float], default: float = 12.0) -> float:
    own = sorted(v for v in values if v > 0)
    return own[len(own) // 2] if own else default


def rows_of(spans: list[dict], tolerance) -> list[list[dict]]:
    """Rows from the top; a row ends where a baseline is further from its first span than tolerance(first, span)."""
    out: list[list[dict]] = []
    for s in sorted(spans, key=lambda s: (-s["y"], s["x"], s["seq"])):
        if out and abs(out[-1][0]["y"] - s["y"]) <= tolerance(out[-1][0], s):
            out[-1].append(s)
        else:
            out.append([s])
    return [sorted(r, key=lambda s: (s["x"], s["seq"])) for r in out]


def joined(row: list[dict]) -> str:
    """A row's text; a gap of over a quarter of the size is a space unless there is one."""
    out, end = "", None
    for s in row:
        if out and s["x"] - end > 0.25 * s["size"] and not out[-1].isspace() and not s["text"][:1].isspace():
            out += " "
        out += s["text"]
        end = s["x"] + s["advance"]
    return out


def lines(spans: list[dict]) -> list[dict]:
    """Lines of a page from the top: text, y and size."""
    shown = [s for s in spans if s["text"] and all(map(math.isfinite, (s["x"], s["y"], s["size"])))]
    found = rows_of(shown, lambda a, s: max(0.5 * max(a["size"], s["size"]), 1.0))
    return [{"line": i, "text": joined(r), "y": r[0]["y"], "size": max(s["size"] for s in r), "spans": r} for i, r in enumerate(found)]


def _fold(c: str) -> str:
    return c.lower()[:1] or c


class _Folds(dict):
    """The fold of each character, for str.translate(), which looks each one up once."""

    def __missing__(self, code: int) -> str:
        self[code] = found = _fold(chr(code))
        return found


_FOLDS = _Folds()


def search(page_lines: list[dict], query: str, ignore_case: bool = True) -> list[dict]:
    """Literal hits, left to right and not overlapping, never across lines; x extents are shared evenly by characters."""
    if not query:
        return []
    fold = (lambda s: s.lower() if s.isascii() else s.translate(_FOLDS)) if ignore_case else (lambda s: s)
    wanted, out = fold(query), []
    for ln in page_lines:
        text, at = fold(ln["text"]), 0
        if wanted not in text:
            continue
        places: list[tuple[float, float] | None] = []
        holder: list[int | None] = []  # the span of each character
        for number, s in enumerate(ln["spans"]):
            gap = len(places)
            if places and ln["text"][gap : gap + 1] == " " and not s["text"].startswith(" ") and ln["text"][gap : gap + len(s["text"])] != s["text"]:
                places.append(None)
                holder.append(None)
            step = s["advance"] / len(s["text"])
            places += [tuple(sorted((s["x"] + i * step, s["x"] + (i + 1) * step))) for i in range(len(s["text"]))]
            holder += [number] * len(s["text"])
        while (at := text.find(wanted, at)) >= 0:
            own = [p for p in places[at : at + len(wanted)] if p]
            inside = {k: s for k, s in enumerate(ln["spans"]) if k in set(holder[at : at + len(wanted)])}.values()
            rect = (min(p[0] for p in own), min(s["y"] - 0.2 * s["size"] for s in inside), max(p[1] for p in own), max(s["y"] + 0.8 * s["size"] for s in inside)) if own else None
            out.append({"line": ln["line"], "start": at, "length": len(wanted), "rect": rect})
            at += len(wanted)
    return out


#: Limits of table detection for one page; what is cut is marked.
MAX_SPANS, MAX_RULES, MAX_TABLES = 50_000, 20_000, 1_000
PROSE_FILL = 0.8


def _close(values: list[float], least: float) -> list[float]:
    """Ascending values without those nearer than least to the last one kept."""
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] >= least:
            out.append(v)
    return out


def _ends(s: dict) -> tuple[float, float]:
    return min(s["x"], s["x"] + s["advance"]), max(s["x"], s["x"] + s["advance"])


def tables(spans: list[dict], rules: list[dict] = ()) -> list[dict]:
    """Tables of a page: bands of rows whose columns are parted by gutters that most rows leave free, and by rules.

    cells, col_x (edges of columns), row_y (separators of rows, one more than rows, downwards) and truncated.
    """
    shown = [s for s in spans if s["text"].strip() and all(map(math.isfinite, (s["x"], s["y"], s["size"], s["advance"])))]
    cut = len(shown) > MAX_SPANS or len(rules) > MAX_RULES
    shown, rules = shown[:MAX_SPANS], [r for r in rules[:MAX_RULES] if all(map(math.isfinite, (r["pos"], r["start"], r["end"])))]
    if len(shown) < 6:
        return []
    unit = max(1.0, upper_median([s["size"] for s in shown]))
    bands: list[list[list[dict]]] = []
    for r in rows_of(shown, lambda a, s: 0.6 * unit):
        if bands and bands[-1][-1][0]["y"] - r[0]["y"] <= 2.2 * unit:
            bands[-1].append(r)
        else:
            bands.append([r])
    found = [t for t in (_band(b, rules, unit) for b in bands if len(b) >= 3) if t]
    cut = cut or len(found) > MAX_TABLES
    return [{**t, "truncated": cut} for t in found[:MAX_TABLES]]


def _band(band: list[list[dict]], rules: list[dict], unit: float) -> dict | None:
    left, right = min(_ends(s)[0] for r in band for s in r), max(_ends(s)[1] for r in band for s in r)
    top, bottom = band[0][0]["y"], band[-1][0]["y"]
    height = max(top - bottom, unit)
    inside = lambda r: left + 0.2 * unit < r["pos"] < right - 0.2 * unit and min(r["end"], top + unit) - max(r["start"], bottom - unit) >= 0.5 * height
    ruled = _close([r["pos"] for r in rules if r["vertical"] and inside(r)], 0.2 * unit)
    free = [(a + b) / 2 for a, b in _gutters(band, unit, left, right) if not any(a <= x <= b for x in ruled)]
    edges = _close([left, *ruled, *free, right], 0.2 * unit)
    if len(edges) < 3:
        return None
    column = lambda s: min(len(edges) - 2, sum(sum(_ends(s)) / 2 >= e for e in edges[1:]))
    placed = [[[s for s in r if column(s) == c] for c in range(len(edges) - 1)] for r in band]
    several = [sum(map(bool, r)) >= 2 for r in placed]
    if not any(several):
        return None
    a, b = several.index(True), len(several) - several[::-1].index(True)
    rows, placed, several = band[a:b], placed[a:b], several[a:b]
    cells = [[joined(c).strip() for c in r] for r in placed]
    filled = [sum(bool(row[k]) for row in cells) for k in range(len(edges) - 1)]
    if len(rows) < 3 or sum(several) < max(2, math.ceil(len(rows) / 2)) or sum(f >= 2 for f in filled) < 2:
        return None
    if not ruled:  # prose fills its columns, cells leave room
        fills = sorted(
            min(1.0, (max(_ends(s)[1] for s in c) - min(_ends(s)[0] for s in c)) / (edges[k + 1] - edges[k]))
            for r, texts in zip(placed, cells) for k, c in enumerate(r) if texts[k]
        )
        if fills and fills[len(fills) // 2] > PROSE_FILL:
            return None
    y, size = [r[0]["y"] for r in rows], [max(1.0, max(s["size"] for s in r)) for r in rows]
    return {"cells": cells, "col_x": edges, "row_y": [y[0] + 0.8 * size[0], *((u + v) / 2 for u, v in zip(y, y[1:])), y[-1] - 0.2 * size[-1]]}


def _gutters(band: list[list[dict]], unit: float, left: float, right: float) -> list[tuple[float, float]]:
    """The x ranges within the band that all rows but a few leave free, at least 0.4 units wide. Rows of one stretch that
    takes nine tenths of the width have no vote, but count."""
    allowed = max(1 if len(band) >= 4 else 0, math.floor(0.15 * len(band) + 0.5))
    events: dict[float, int] = {}
    for r in band:
        merged: list[list[float]] = []
        for s, e in sorted(map(_ends, r)):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        if len(merged) == 1 and merged[0][1] - merged[0][0] >= 0.9 * (right - left):
            continue
        for s, e in merged:
            events[s] = events.get(s, 0) + 1
            events[e] = events.get(e, 0) - 1
    out, depth, start = [], 0, left
    for x in sorted(events):
        before, depth = depth, depth + events[x]
        if before > allowed >= depth:
            start = x
        elif start is not None and before <= allowed < depth:
            if start > left and x < right and x - start >= 0.4 * unit:
                out.append((start, x))
            start = None
    return out


def dehyphenate(text: str) -> str:
    """Words broken by a hyphen at a line's end are joined if the next line goes on in lower case."""
    return re.sub(r"(?<=[^\W\d_])[-­][^\S\n]*\n([^\S\n]*)(?=(\w))", lambda m: m[1] if m[2].islower() else m[0], text)


def tsv(cells: list[list[str]]) -> str:
    return "\n".join("\t".join(re.sub(r"[\t\r\n]", " ", c) for c in row) for row in cells)


def csv(cells: list[list[str]]) -> str:
    quote = lambda c: '"' + c.replace('"', '""') + '"' if re.search(r'[",\r\n]', c) else c
    return "\r\n".join(",".join(map(quote, row)) for row in cells)
