"""Changes appended to a file: the old bytes stay, new objects and a cross-reference section that points back follow."""

from __future__ import annotations

import math
import re
import zlib

from .content import IDENTITY, apply, concat
from .document import Pdf, text_of
from .objects import END, Keyword, Name, Parser, PdfError, Ref, Stream
from .writer import WIN_ANSI, rewrite, serialise


class Update:
    """Collects new and changed objects of a file; bytes() is the file with them. Recovered and encrypted files are refused."""

    def __init__(self, data: bytes):
        self.pdf = Pdf(data)
        if self.pdf.recovered or "Encrypt" in self.pdf.trailer:
            raise PdfError("only files with intact cross references and without encryption can be updated")
        self.changed: dict[int, object] = {}
        self.size = max([self.pdf.trailer.get("Size") or 0, *(n + 1 for n in self.pdf.xref)])
        self.trailer = {k: v for k, v in self.pdf.trailer.items() if k in ("Root", "Info", "ID")}

    def now(self, ref):
        return self.changed.get(ref.num, self.pdf.get(ref)) if isinstance(ref, Ref) else self.pdf.get(ref)

    def add(self, o) -> Ref:
        self.size += 1
        self.changed[self.size - 1] = o
        return Ref(self.size - 1, 0)

    def set(self, ref: Ref, o) -> None:
        self.changed[ref.num] = o

    def page(self, index: int) -> tuple[Ref, dict]:
        ref = self.pdf.pages[index]["_ref"]
        if not isinstance(ref, Ref):
            raise PdfError("a page without its own object can't be changed")
        return ref, dict(self.now(ref))

    def bytes(self) -> bytes:
        if not self.changed:
            return self.pdf.data
        at = int(re.match(rb"\s*(\d+)", self.pdf.data[self.pdf.data.rfind(b"startxref") + 9 :])[1])
        streamed = not self.pdf.data[at:].lstrip().startswith(b"xref")
        out, places = bytearray(self.pdf.data), {}
        out += b"" if out.endswith(b"\n") else b"\n"
        for num, o in sorted(self.changed.items()):
            places[num] = len(out)
            out += b"%d 0 obj\n" % num + serialise(o) + b"\nendobj\n"
        start, trailer = len(out), {**self.trailer, "Size": self.size, "Prev": at}
        if streamed:
            places[self.size] = start
            index = [x for n in sorted(places) for x in (n, 1)]
            rows = b"".join(b"\x01" + places[n].to_bytes(8, "big") + b"\0\0" for n in sorted(places))
            out += b"%d 0 obj\n" % self.size + serialise(Stream({**trailer, "Size": self.size + 1, "Type": Name("XRef"), "W": [1, 8, 2], "Index": index}, rows)) + b"\nendobj\n"
        else:
            out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % x for x in sorted(places.items())) + b"trailer\n" + serialise(trailer) + b"\n"
        return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def set_info(data: bytes, values: dict[str, str | None], modified: str | None = None) -> bytes:
    """Information entries set, or removed where the value is null; ModDate becomes ``modified`` where that is given."""
    u = Update(data)
    old = dict(u.pdf.dict(u.trailer.get("Info")))
    values = {**values, **({"ModDate": modified} if modified is not None else {})}
    new = {k: v for k, v in {**old, **values}.items() if v is not None}
    if isinstance(u.trailer.get("Info"), Ref):
        u.set(u.trailer["Info"], new)
    else:
        u.trailer["Info"] = u.add(new)
    return u.bytes()


def fill(data: bytes, values: dict[str, str]) -> bytes:
    """Values of form fields set by their full names; viewers are told to draw them anew. An unknown name is an error."""
    u, left = Update(data), dict(values)

    def walk(ref, above: str, depth: int) -> None:
        d = u.now(ref)
        if not isinstance(d, dict) or depth > 50:
            return
        own = text_of(u.pdf.get(d.get("T")))
        name = f"{above}.{own}" if above and own else own or above
        kids = [k for k in u.pdf.list(d.get("Kids")) if "T" in u.pdf.dict(k)]
        for k in kids:
            walk(k, name, depth + 1)
        if not kids and name in left and isinstance(ref, Ref):
            value = left.pop(name)
            button = u.pdf.get(d.get("FT")) == "Btn"
            u.set(ref, {**{k: v for k, v in d.items() if k != "AP" or button}, "V": Name(value) if button else value} | ({"AS": Name(value)} if button else {}))

    form = u.pdf.root.get("AcroForm")
    for f in u.pdf.list(u.pdf.dict(form).get("Fields")):
        walk(f, "", 0)
    if left:
        raise PdfError(f"no field {sorted(left)[0]}")
    if values:
        new = {**u.pdf.dict(form), "NeedAppearances": True}
        if isinstance(form, Ref):
            u.set(form, new)
        else:
            u.set(u.pdf.trailer["Root"], {**u.pdf.root, "AcroForm": new})
    return u.bytes()


def annotate(data: bytes, notes: list[dict]) -> bytes:
    """Annotations added: {page, subtype, rect, contents, color}. Markup of text gets its rectangle as quad points."""
    u = Update(data)
    for n in notes:
        ref, page = u.page(n["page"])
        x0, y0, x1, y1 = map(float, n["rect"])
        d = {"Type": Name("Annot"), "Subtype": Name(n["subtype"]), "Rect": [x0, y0, x1, y1], "P": ref, "F": 4, "C": [float(c) for c in n.get("color") or (1, 1, 0)]}
        d |= {"Contents": n["contents"]} if n.get("contents") is not None else {}
        if n["subtype"] in ("Highlight", "Underline", "StrikeOut", "Squiggly"):
            d["QuadPoints"] = [x0, y1, x1, y1, x0, y0, x1, y0]
        old = u.now(page.get("Annots"))
        u.set(ref, {**page, "Annots": [*(old if isinstance(old, list) else []), u.add(d)]})
    return u.bytes()


def rotate(data: bytes, turns: dict[int, int]) -> bytes:
    """Pages (by index) turned clockwise by quarter turns."""
    u = Update(data)
    for index, quarter in turns.items():
        ref, page = u.page(index)
        old = u.pdf.get(u.pdf.pages[index].get("Rotate")) or 0
        u.set(ref, {**page, "Rotate": (old + 90 * quarter) % 360})
    return u.bytes()


def edit_annotations(data: bytes, changes: list[dict]) -> bytes:
    """Annotations changed or removed: {page, ordinal, delete, rect, color, contents, width}; what isn't named stays. A
    changed place, colour or width drops the appearance, so that viewers draw it anew."""
    u = Update(data)
    gone: dict[int, set[int]] = {}
    for c in changes:
        ref, page = u.page(c["page"])
        own = u.now(page.get("Annots"))
        if not isinstance(own, list) or not 0 <= c["ordinal"] < len(own):
            raise PdfError("no such annotation")
        if c.get("delete"):
            gone.setdefault(c["page"], set()).add(c["ordinal"])
            continue
        at = own[c["ordinal"]]
        d = dict(u.now(at) or {})
        look = {"Rect": [float(x) for x in c["rect"]]} if c.get("rect") is not None else {}
        look |= {"C": [float(x) for x in c["color"]]} if c.get("color") is not None else {}
        look |= {"BS": {"W": float(c["width"])}} if c.get("width") is not None else {}
        if look:
            d.pop("AP", None)
        d |= look | ({"Contents": c["contents"]} if c.get("contents") is not None else {})
        if isinstance(at, Ref):
            u.set(at, d)
        else:
            u.set(ref, {**page, "Annots": [d if k == c["ordinal"] else x for k, x in enumerate(own)]})
    for index, ordinals in gone.items():
        ref, page = u.page(index)
        own = u.now(page.get("Annots"))
        u.set(ref, {**page, "Annots": [x for k, x in enumerate(own) if k not in ordinals]})
    return u.bytes()


def _meets(box: tuple, rects: list[tuple]) -> bool:
    return any(box[0] < r[2] and r[0] < box[2] and box[1] < r[3] and r[1] < box[3] for r in rects)


def _box(m: tuple, x0: float, y0: float, x1: float, y1: float) -> tuple:
    points = [apply(m, x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    return min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)


class _Tracker:
    """As much of the graphics state as places an operator: matrices, text position, font size, the path so far.

    The extent of a string is estimated wide, 0.55 of the size for each byte and from 0.3 below to 1.1 above the baseline,
    so that rather more goes than less."""

    def __init__(self):
        self.ctm, self.stack, self.tm, self.tlm = IDENTITY, [], IDENTITY, IDENTITY
        self.size, self.leading, self.path = 0.0, 0.0, []

    def line(self, dx: float, dy: float) -> None:
        self.tm = self.tlm = concat((1, 0, 0, 1, dx, dy), self.tlm)

    def string(self, raw: bytes) -> tuple:
        """The box of a string; the pen moves behind it."""
        w = 0.55 * self.size * len(raw)
        box = _box(concat(self.tm, self.ctm), 0.0, -0.3 * self.size, w, 1.1 * self.size)
        self.tm = concat((1, 0, 0, 1, w, 0), self.tm)
        return box

    def follow(self, op: str, a: list, n: list) -> None:
        if op == "q":
            self.stack.append((self.ctm, self.size, self.leading))
        elif op == "Q" and self.stack:
            self.ctm, self.size, self.leading = self.stack.pop()
        elif op == "cm" and len(n) == 6:
            self.ctm = concat(tuple(n), self.ctm)
        elif op == "BT":
            self.tm = self.tlm = IDENTITY
        elif op == "Tf" and n:
            self.size = abs(float(n[-1]))
        elif op == "TL" and n:
            self.leading = float(n[0])
        elif op in ("Td", "TD") and len(n) == 2:
            self.leading = -float(n[1]) if op == "TD" else self.leading
            self.line(*n)
        elif op == "Tm" and len(n) == 6:
            self.tm = self.tlm = tuple(n)
        elif op in ("T*", "'", '"'):
            self.line(0, -self.leading)
        elif op in ("m", "l", "c", "v", "y"):
            self.path += [apply(self.ctm, x, y) for x, y in zip(n[::2], n[1::2])]
        elif op == "re" and len(n) == 4:
            x, y, w, h = n
            self.path += [apply(self.ctm, *p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]


def redacted_content(content: bytes, rects: list[tuple]) -> bytes:
    """The content without strings, images and forms that meet a rectangle, and with paths that do left unpainted."""
    t, out, args, p = _Tracker(), bytearray(), [], Parser(content, refs=False)
    start = 0
    while (o := p.next()) is not END:
        if not isinstance(o, Keyword):
            args.append(o)
            continue
        op, keep = str(o), content[start : p.pos]
        n = [x for x in args if isinstance(x, (int, float)) and not isinstance(x, bool)]
        if op == "BI":
            m = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)").search(content, p.pos)
            p.pos = m.end() if m else len(content)
            keep = b" " if _meets(_box(t.ctm, 0, 0, 1, 1), rects) else content[start : p.pos]
        elif op == "Do" and _meets(_box(t.ctm, 0, 0, 1, 1), rects):
            keep = b" "
        elif op in ("Tj", "'", '"', "TJ"):
            t.follow(op, args, n)
            parts = [x for x in (args[-1] if op == "TJ" and args and isinstance(args[-1], list) else args[-1:]) if isinstance(x, bytes)]
            if any([_meets(t.string(x), rects) for x in parts]):
                keep = b" T* " if op in ("'", '"') else b" "
        elif op in PAINTS:
            if t.path and _meets((min(x for x, _ in t.path), min(y for _, y in t.path), max(x for x, _ in t.path), max(y for _, y in t.path)), _thick(rects)):
                keep = b" n "
            t.path = []
        elif op == "n":
            t.path = []
        else:
            t.follow(op, args, n)
        out += keep + b"\n"
        args, start = [], p.pos
    return bytes(out)


#: Operators that paint a path.
PAINTS = frozenset(("S", "s", "f", "F", "f*", "B", "B*", "b", "b*"))


def _thick(rects: list[tuple]) -> list[tuple]:
    """Rectangles a hair larger, so that lines without a height meet them."""
    return [(a - 1e-6, b - 1e-6, c + 1e-6, d + 1e-6) for a, b, c, d in rects]


def redact(data: bytes, regions: list[dict], fill: tuple[float, float, float] | None = (0.0, 0.0, 0.0)) -> bytes:
    """What lies in regions {page, rect} is taken out of the content, with annotations that overlap them; boxes of the
    colour ``fill`` cover them. Forms that meet a region go as a whole.

    The content is replaced in an appended update and the file then written anew, so the old bytes are gone."""
    u = Update(data)
    by_page: dict[int, list[tuple]] = {}
    for r in regions:
        x0, y0, x1, y1 = map(float, r["rect"])
        if not all(map(math.isfinite, (x0, y0, x1, y1))):
            raise PdfError("rectangles must be finite")
        by_page.setdefault(r["page"], []).append((min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)))
    for index, rects in by_page.items():
        ref, page = u.page(index)
        body = redacted_content(u.pdf.content(u.pdf.pages[index]), rects)
        if fill is not None:
            body += b"q\n%s %s %s rg\n" % tuple(serialise(float(c)) for c in fill)
            body += b"".join(b"%s %s %s %s re f\n" % tuple(serialise(v) for v in (a, b, c - a, d - b)) for a, b, c, d in rects) + b"Q\n"
        page["Contents"] = u.add(Stream({"Filter": Name("FlateDecode")}, zlib.compress(body)))
        kept = []
        for a in u.pdf.list(page.get("Annots")):
            box = [x for x in map(u.pdf.get, u.pdf.list(u.pdf.dict(a).get("Rect"))) if isinstance(x, (int, float))]
            if len(box) != 4 or not _meets((min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])), rects):
                kept.append(a)
        if "Annots" in page:
            page["Annots"] = kept
        u.set(ref, page)
    return rewrite(u.bytes()) if regions else data


def stamp(data: bytes, marks: list[dict]) -> bytes:
    """Text over pages: {page (all without), text, x, y, size, color, angle (degrees)}, behind the page's own content if
    ``under`` is true. The page's content is kept in its own graphics state."""
    u = Update(data)
    font = u.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")})
    by_page: dict[int, list[dict]] = {}
    for m in marks:
        for index in [m["page"]] if m.get("page") is not None else range(len(u.pdf.pages)):
            by_page.setdefault(index, []).append(m)
    for index, own in by_page.items():
        ref, page = u.page(index)
        resources = dict(u.pdf.dict(u.pdf.pages[index].get("Resources")))
        fonts = dict(u.pdf.dict(resources.get("Font")))
        name = next(f"Stamp{k}" for k in range(len(fonts) + 1) if f"Stamp{k}" not in fonts)
        page["Resources"] = {**resources, "Font": {**fonts, name: font}}
        old = u.pdf.get(page.get("Contents"))
        old = old if isinstance(old, list) else [page["Contents"]] if "Contents" in page else []
        drawn = {True: b"", False: b""}
        for m in own:
            if not all(c in WIN_ANSI for c in m["text"]):
                raise PdfError("a character that the font lacks")
            c, s = math.cos(math.radians(m.get("angle", 0))), math.sin(math.radians(m.get("angle", 0)))
            numbers = [*m.get("color", (0.5, 0.5, 0.5)), m.get("size", 24), c, s, -s, c, m["x"], m["y"]]
            drawn[bool(m.get("under"))] += b"q %s %s %s rg BT /%s %s Tf %s %s %s %s %s %s Tm %s Tj ET Q\n" % (*(serialise(float(v)) for v in numbers[:3]), name.encode(), *(serialise(float(v)) for v in numbers[3:]), serialise(b"".join(map(WIN_ANSI.__getitem__, m["text"]))))
        page["Contents"] = [u.add(Stream({}, drawn[True] + b"q\n")), *old, u.add(Stream({}, b"\nQ\n" + drawn[False]))]
        u.set(ref, page)
    return u.bytes()


def tag(data: bytes, lang: str | None = None) -> bytes:
    """A structure tree for an untagged file: a Document with a Part for each page, whose content is one marked sequence."""
    u = Update(data)
    if u.pdf.tagged or u.pdf.dict(u.pdf.root.get("StructTreeRoot")):
        raise PdfError("the file has a structure tree")
    top, document = u.add(None), u.add(None)
    parts = []
    for index in range(len(u.pdf.pages)):
        ref, page = u.page(index)
        old = u.pdf.get(page.get("Contents"))
        old = old if isinstance(old, list) else [page["Contents"]] if "Contents" in page else []
        parts.append(u.add({"Type": Name("StructElem"), "S": Name("Part"), "P": document, "Pg": ref, "K": 0}))
        u.set(ref, {**page, "StructParents": index, "Contents": [u.add(Stream({}, b"/Part <</MCID 0>> BDC\n")), *old, u.add(Stream({}, b"\nEMC\n"))]})
    u.set(document, {"Type": Name("StructElem"), "S": Name("Document"), "P": top, "K": parts})
    u.set(top, {"Type": Name("StructTreeRoot"), "K": document, "ParentTree": {"Nums": [x for k, p in enumerate(parts) for x in (k, [p])]}, "ParentTreeNextKey": len(parts)})
    u.set(u.pdf.trailer["Root"], {**u.pdf.root, "StructTreeRoot": top, "MarkInfo": {"Marked": True}} | ({"Lang": lang} if lang else {}))
    return u.bytes()
