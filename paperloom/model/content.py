"""Page content to positioned text spans, ruled lines, images and painted paths."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from .document import Pdf
from .fonts import Font
from .objects import END, END_OF_WORD, INTEGER, NAME, REGULAR, STRING, TOKEN, Keyword, Name, Parser, PdfError, Ref, Stream, name_of, regular

#: Limits of the format's readers. What is cut by one of them is marked as truncated.
MAX_OPERANDS, MAX_SAVED, MAX_MARKS, MAX_FORMS = 10_000, 256, 128, 16
#: Ruled lines: at most so thick, so far off the axis, and at least so long.
RULE_THICK, RULE_SKEW, RULE_LONG = 3.0, 0.5, 8.0
IDENTITY = (1, 0, 0, 1, 0, 0)
#: Short names of inline images.
INLINE_KEYS = {"BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "DP": "DecodeParms", "F": "Filter", "H": "Height", "IM": "ImageMask", "I": "Interpolate", "W": "Width"}
INLINE_SPACES = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}
COMPONENTS = {"DeviceGray": 1, "CalGray": 1, "DeviceRGB": 3, "CalRGB": 3, "Lab": 3, "DeviceCMYK": 4, "Indexed": 1, "Separation": 1}


def concat(m: tuple, n: tuple) -> tuple:
    """The matrix that applies m first and then n."""
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l)


def apply(m: tuple, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def scale_of(m: tuple) -> float:
    """The mean length of the axes."""
    return (math.hypot(m[0], m[1]) + math.hypot(m[2], m[3])) / 2


#: Up to six numbers and an operator.
_USUAL = re.compile(rb"[\t\n\x0c\r ]*+((?:[+-]?(?:\d++\.?+\d*+|\.\d++)[\t\n\x0c\r ]++){0,6}+)([A-Za-z'\"][A-Za-z0-9*]*+)" + END_OF_WORD)
CONSTANTS = (b"true", b"false", b"null")


@dataclass
class Found:
    """What a page's content gives, in the order of painting."""

    spans: list[dict] = field(default_factory=list)
    rules: list[dict] = field(default_factory=list)
    images: list[dict] = field(default_factory=list)
    paints: list[dict] = field(default_factory=list)
    truncated: bool = False


class _Cut(Exception):
    """A limit ends the page."""


STATE = {"ctm": IDENTITY, "font": None, "size": 0.0, "tc": 0.0, "tw": 0.0, "tz": 1.0, "tl": 0.0, "rise": 0.0, "mode": 0, "width": 1.0, "cap": 0, "join": 0, "miter": 10.0, "dash": ((), 0), "flat": 0.0, "intent": "RelativeColorimetric", "fill": ("DeviceGray", (0.0,)), "stroke": ("DeviceGray", (0.0,)), "fill_alpha": 1.0, "stroke_alpha": 1.0, "blend": "Normal", "overprint": False, "clips": ()}


class Interpreter:
    """Runs content streams over a graphics state. Forms run within the state of their caller and leave it as it was."""

    def __init__(self, pdf: Pdf, most: int | None = None, paints: bool = False):
        self.pdf, self.left, self.want_paints = pdf, pdf.limits.operators if most is None else most, paints
        self.out = Found()
        self.state = dict(STATE)
        self.stack: list[dict] = []
        self.unsaved = 0  # saves beyond the limit, whose restores do nothing
        self.marks: list[tuple[int | None, bool]] = []  # identifier, hidden
        self.tm = self.tlm = IDENTITY
        self.path: list[tuple] = []
        self.pending_clip: str | None = None
        self.resources: dict = {}
        self.depth = 0

    # Streams.

    def run(self, data: bytes, resources: dict) -> None:
        before, self.resources = self.resources, resources
        usual = _USUAL.match
        p, args, match, pos = Parser(data, refs=False), [], TOKEN.match, 0
        try:
            while True:
                if (m := usual(data, pos)) and m[2] not in CONSTANTS and len(args) < MAX_OPERANDS - 6:  # numbers and their operator at once
                    args += [float(x) if b"." in x else int(x) for x in m[1].split()]
                    o, pos = regular(m[2]), m.end()
                elif (kind := (m := match(data, pos)).lastindex) is None:
                    break
                elif kind == REGULAR:
                    o, pos = regular(m[REGULAR]), m.end()
                elif kind == INTEGER:
                    o, pos = int(m[INTEGER]), m.end()
                elif kind == STRING:
                    o, pos = m[STRING], m.end()
                elif kind == NAME:
                    o, pos = name_of(m[NAME]), m.end()
                else:
                    p.pos = pos
                    o, pos = p.next(), p.pos
                if not isinstance(o, Keyword):
                    if len(args) < MAX_OPERANDS:
                        args.append(o)
                    else:
                        self.out.truncated = True
                    continue
                self.left -= 1
                if self.left < 0:
                    raise _Cut
                if o == "BI":
                    p.pos = pos
                    self.inline_image(p)
                    pos = p.pos
                elif (do := OPERATORS.get(o)) is not None:
                    n = [x for x in args if isinstance(x, (int, float)) and not isinstance(x, bool)]
                    do(self, args, n)
                args = []
        finally:
            self.resources = before

    def page(self, page: dict) -> Found:
        try:
            self.run(self.pdf.content(page), self.pdf.dict(page.get("Resources")))
        except _Cut:
            self.out.truncated = True
        self.out.truncated = self.out.truncated or bool(self.pdf.skipped(page))
        return self.out

    def resource(self, kind: str, name) -> object:
        return self.pdf.dict(self.resources.get(kind)).get(str(name))

    @property
    def hidden(self) -> bool:
        return bool(self.marks) and any(h for _, h in self.marks)

    # Graphics state.

    def save(self, a, n):
        if len(self.stack) < MAX_SAVED:
            self.stack.append(dict(self.state))
        else:
            self.unsaved += 1

    def restore(self, a, n):
        if self.unsaved:
            self.unsaved -= 1
        elif self.stack:
            self.state = self.stack.pop()

    def transform(self, a, n):
        if len(n) == 6 and all(map(math.isfinite, n)):
            self.state["ctm"] = concat(tuple(n), self.state["ctm"])

    def ext_state(self, a, n):
        d = self.pdf.dict(self.resource("ExtGState", a[0])) if a else {}
        get = self.pdf.get
        for key, name in (("LW", "width"), ("LC", "cap"), ("LJ", "join"), ("ML", "miter"), ("FL", "flat"), ("ca", "fill_alpha"), ("CA", "stroke_alpha")):
            if isinstance(v := get(d.get(key)), (int, float)):
                self.state[name] = v
        mode = get(d.get("BM"))
        if mode := (get(mode[0]) if isinstance(mode, list) and mode else mode):
            self.state["blend"] = str(mode)
        if isinstance(v := get(d.get("OP", d.get("op"))), bool):
            self.state["overprint"] = v
        if isinstance(v := get(d.get("RI")), str):
            self.state["intent"] = str(v)
        dash = [get(x) for x in self.pdf.list(d.get("D"))]
        if len(dash) == 2 and isinstance(dash[0], list):
            self.state["dash"] = (tuple(map(get, dash[0])), dash[1])
        font = [*self.pdf.list(d.get("Font"))]
        if len(font) == 2 and isinstance(size := get(font[1]), (int, float)):
            self.state["font"], self.state["size"] = self.pdf.font(font[0]), float(size)

    def dash(self, a, n):
        if len(a) == 2 and isinstance(a[0], list) and n:
            self.state["dash"] = (tuple(x for x in a[0] if isinstance(x, (int, float))), n[-1])

    # Colour: (space, components).

    def device(self, target: str, space: str, count: int):
        def do(self, a, n):
            if len(n) >= count:
                self.state[target] = (space, tuple(n[-count:]))

        return do

    def space(self, target: str, a) -> None:
        if not a:
            return
        name = str(a[0])
        found = self.pdf.get(self.resource("ColorSpace", name))
        kind = str(self.pdf.get(found[0])) if isinstance(found, list) and found else str(found) if isinstance(found, str) else name
        if kind == "ICCBased":
            count = self.pdf.get(self.pdf.dict(found[1]).get("N")) if len(found) > 1 else 3
            kind = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}.get(count, kind)
        count = COMPONENTS.get(kind, 1)
        self.state[target] = (kind, (0.0,) * (count - 1) + (1.0,) if kind in ("DeviceCMYK", "Separation") else (0.0,) * count)

    def components(self, target: str, a, n) -> None:
        kind = self.state[target][0]
        self.state[target] = ("Pattern", (str(a[-1]),)) if a and isinstance(a[-1], Name) else (kind, tuple(n))

    # Paths, in page coordinates.

    def point(self, op: str, *xy: float) -> None:
        ctm = self.state["ctm"]
        self.path.append((op, *(c for i in range(0, len(xy), 2) for c in apply(ctm, xy[i], xy[i + 1]))))

    def move(self, a, n):
        if len(n) == 2:
            self.point("m", *n)

    def line(self, a, n):
        if len(n) == 2:
            self.point("l", *n)

    def curve(self, a, n):
        if len(n) == 6:
            self.point("c", *n)

    def _user(self) -> tuple | None:
        """The end of the path so far, in page coordinates."""
        return self.path[-1][-2:] if self.path and len(self.path[-1]) > 1 else None

    def curve_from_here(self, a, n):
        if len(n) == 4 and (now := self._user()):
            ctm = self.state["ctm"]
            self.path.append(("c", *now, *apply(ctm, n[0], n[1]), *apply(ctm, n[2], n[3])))

    def curve_to_end(self, a, n):
        if len(n) == 4:
            self.point("c", *n, *n[2:])

    def rectangle(self, a, n):
        if len(n) == 4:
            x, y, w, h = n
            for op, *xy in (("m", x, y), ("l", x + w, y), ("l", x + w, y + h), ("l", x, y + h)):
                self.point(op, *xy)
            self.path.append(("h",))

    def close(self, a=None, n=None):
        if self.path:
            self.path.append(("h",))

    def paint(self, fill: str | None, stroke: bool, closing: bool = False):
        def do(self, a, n):
            if closing:
                self.close()
            if not self.hidden:
                if stroke and self.state["width"] * scale_of(self.state["ctm"]) <= RULE_THICK:
                    self.out.rules += _stroked(self.path)
                if fill:
                    self.out.rules += _filled(self.path)
                if self.want_paints and self.path and (fill or stroke):
                    self.emit("path", d=svg_path(self.path), fill=self.colour("fill") if fill else None, stroke=self.colour("stroke") if stroke else None, line_width=self.state["width"] * scale_of(self.state["ctm"]), even_odd=fill == "even-odd")
            self.end_path()

        return do

    def end_path(self, a=None, n=None):
        if self.pending_clip and self.path:
            self.state["clips"] = (*self.state["clips"], (svg_path(self.path), self.pending_clip == "even-odd")) if self.want_paints else ()
        self.path, self.pending_clip = [], None

    def clip(self, rule: str):
        def do(self, a, n):
            self.pending_clip = rule

        return do

    def colour(self, target: str) -> tuple[int, int, int]:
        from ..functions.colour import rgb_bytes

        return rgb_bytes(*self.state[target])

    def emit(self, kind: str, **values) -> None:
        s = self.state
        self.out.paints.append({"seq": len(self.out.paints), "kind": kind, "d": None, "fill": None, "stroke": None, "line_width": None, "even_odd": False, "text": None, "font": None, "size": None, "matrix": None, "fill_alpha": s["fill_alpha"], "stroke_alpha": s["stroke_alpha"], "blend": s["blend"], "clips": [c for c, _ in s["clips"]]} | values)

    # Text.

    def begin_text(self, a, n):
        self.tm = self.tlm = IDENTITY

    def font(self, a, n):
        if len(a) == 2 and n:
            ref = self.resource("Font", a[0])
            self.state["font"], self.state["size"] = self.pdf.font(ref), float(n[0])

    def number(self, name: str, factor: float = 1.0):
        def do(self, a, n):
            if n:
                self.state[name] = n[0] * factor

        return do

    def line_to(self, dx: float, dy: float) -> None:
        self.tm = self.tlm = concat((1, 0, 0, 1, dx, dy), self.tlm)

    def offset(self, leading: bool):
        def do(self, a, n):
            if len(n) == 2:
                if leading:
                    self.state["tl"] = -float(n[1])
                self.line_to(*n)

        return do

    def matrix(self, a, n):
        if len(n) == 6:
            self.tm = self.tlm = tuple(n)

    def next_line(self, a=None, n=None):
        self.line_to(0, -self.state["tl"])

    def show_string(self, a, n):
        if a and isinstance(a[-1], bytes):
            self.show(a[-1])

    def show_next(self, a, n):
        self.next_line()
        self.show_string(a, n)

    def show_spaced(self, a, n):
        if len(n) >= 2:
            self.state["tw"], self.state["tc"] = float(n[0]), float(n[1])
        self.show_next(a, n)

    def show_array(self, a, n):
        for x in a[0] if a and isinstance(a[0], list) else []:
            if isinstance(x, bytes):
                self.show(x)
            elif isinstance(x, (int, float)):
                s = self.state
                by = -x / 1000 * s["size"]
                upright = s["font"] is not None and s["font"].vertical
                self.tm = concat((1, 0, 0, 1, 0, by) if upright else (1, 0, 0, 1, by * s["tz"], 0), self.tm)

    def show(self, raw: bytes) -> None:
        s = self.state
        font, size = s["font"], s["size"]
        if not raw:
            return
        if font is None:
            text, total, count, gaps = raw.decode("latin-1"), 600.0 * len(raw), len(raw), raw.count(b" ")
        else:
            text, total, count, gaps = font.show(raw)
        before, ctm = self.tm, s["ctm"]
        m = concat(before, ctm)
        x, y = apply(m, 0, s["rise"])
        run = total / 1000 * size + s["tc"] * count + s["tw"] * gaps
        self.tm = concat((1, 0, 0, 1, 0, run) if font is not None and font.vertical else (1, 0, 0, 1, run * s["tz"], 0), before)
        if not text or self.hidden:
            return
        mcid = next((k for k, _ in reversed(self.marks) if k is not None), None) if self.marks else None
        end = concat(self.tm, ctm)
        self.out.spans.append({"seq": len(self.out.spans), "text": text, "x": x, "y": y, "size": abs(size) * scale_of(m), "advance": end[4] - m[4], "mcid": mcid})
        if self.want_paints and s["mode"] not in (3, 7):
            self.emit("text", text=text, font=font.name if font else None, size=float(size), matrix=[float(v) for v in concat((s["tz"], 0, 0, 1, 0, s["rise"]), m)], fill=self.colour("fill") if s["mode"] in (0, 2, 4, 6) else None, stroke=self.colour("stroke") if s["mode"] in (1, 2, 5, 6) else None)

    # Marked content.

    def begin_mark(self, a, n):
        if len(self.marks) >= MAX_MARKS:
            self.out.truncated = True
            self.marks.append(self.marks[-1])
            return
        props = a[1] if len(a) > 1 else None
        named = self.resource("Properties", props) if isinstance(props, Name) else None
        props = self.pdf.dict(named) if isinstance(props, Name) else props
        m = props.get("MCID") if isinstance(props, dict) else None
        self.marks.append((m if isinstance(m, int) else None, bool(a) and str(a[0]) == "OC" and self.pdf.hidden(named)))

    def end_mark(self, a, n):
        if self.marks:
            self.marks.pop()

    # Forms and images.

    def do(self, a, n):
        ref = self.resource("XObject", a[0]) if a else None
        x = self.pdf.get(ref)
        if not isinstance(x, Stream) or self.hidden or self.pdf.hidden(x.dict.get("OC")):
            return
        if x.dict.get("Subtype") == "Image":
            self.image(str(a[0]), ref.num if isinstance(ref, Ref) else None, {k: self.pdf.get(v) for k, v in x.dict.items()}, False)
        elif x.dict.get("Subtype") == "Form":
            if self.depth >= MAX_FORMS:
                self.out.truncated = True
                return
            saved, stack, text = dict(self.state), self.stack, (self.tm, self.tlm)
            self.stack, self.depth = [], self.depth + 1
            m = [self.pdf.get(v) for v in self.pdf.list(x.dict.get("Matrix"))]
            if len(m) == 6:
                self.state["ctm"] = concat(tuple(m), self.state["ctm"])
            try:
                self.run(self.pdf.decoded(x), self.pdf.dict(x.dict.get("Resources")) or self.resources)
            except PdfError:
                self.out.truncated = True
            finally:
                self.state, self.stack, self.depth = saved, stack, self.depth - 1
                self.tm, self.tlm = text

    def image(self, name: str | None, number: int | None, d: dict, inline: bool) -> None:
        corners = [apply(self.state["ctm"], x, y) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]
        space, filters = d.get("ColorSpace"), d.get("Filter")
        space = self.pdf.get(space[0]) if isinstance(space, list) and space else space
        count = lambda k: d[k] if isinstance(d.get(k), int) else None
        mask = d.get("ImageMask") is True
        self.out.images.append({
            "seq": len(self.out.images), "name": name, "object": number, "inline": inline, "width": count("Width"), "height": count("Height"), "bits": count("BitsPerComponent") or (1 if mask else None),
            "color_space": INLINE_SPACES.get(str(space), str(space)) if inline and isinstance(space, str) else str(space) if isinstance(space, str) else None, "filters": [str(f) for f in (filters if isinstance(filters, list) else [filters]) if isinstance(f, str)],
            "mask": mask, "soft_mask": d.get("SMask") is not None, "x0": min(c[0] for c in corners), "y0": min(c[1] for c in corners), "x1": max(c[0] for c in corners), "y1": max(c[1] for c in corners),
        })
        if self.want_paints:
            self.emit("image", text=name, matrix=[float(v) for v in self.state["ctm"]])

    def inline_image(self, p: Parser) -> None:
        """From BI to EI: the data is as long as its dictionary says, or ends at the first EI that stands by itself."""
        d: dict = {}
        while (k := p.next()) is not END and k != "ID":
            if isinstance(k, Name):
                d[INLINE_KEYS.get(str(k), str(k))] = p.next()
        start = p.pos + (2 if p.data[p.pos : p.pos + 2] == b"\r\n" else 1)
        end = None
        if "Filter" not in d and isinstance(d.get("Width"), int) and isinstance(d.get("Height"), int):
            space = d.get("ColorSpace")
            space = space[0] if isinstance(space, list) and space else space
            count = COMPONENTS.get(INLINE_SPACES.get(str(space), str(space)), 1)
            bits = 1 if d.get("ImageMask") is True else d.get("BitsPerComponent", 8)
            if isinstance(bits, int) and 0 < bits <= 16:
                size = (d["Width"] * count * bits + 7) // 8 * d["Height"]
                if re.compile(rb"[\x00\t\n\x0c\r ]*EI(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])").match(p.data, start + size):
                    end = start + size
        m = re.compile(rb"[\x00\t\n\x0c\r ]*EI(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])").match(p.data, end) if end is not None else re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)").search(p.data, start)
        p.pos = m.end() if m else len(p.data)
        if not self.hidden:
            self.image(None, None, d, True)


def _build() -> dict[str, Callable]:
    i = Interpreter
    one = Interpreter.__new__(Interpreter)
    number = lambda *x: i.number(one, *x)
    table = {
        "q": i.save, "Q": i.restore, "cm": i.transform, "gs": i.ext_state, "d": i.dash, "w": number("width"), "J": number("cap"), "j": number("join"), "M": number("miter"), "i": number("flat"),
        "ri": lambda s, a, n: s.state.__setitem__("intent", str(a[0])) if a else None,
        "m": i.move, "l": i.line, "c": i.curve, "v": i.curve_from_here, "y": i.curve_to_end, "h": i.close, "re": i.rectangle, "n": i.end_path, "W": i.clip(one, "non-zero"), "W*": i.clip(one, "even-odd"),
        "S": i.paint(one, None, True), "s": i.paint(one, None, True, True), "f": i.paint(one, "non-zero", False), "F": i.paint(one, "non-zero", False), "f*": i.paint(one, "even-odd", False),
        "B": i.paint(one, "non-zero", True), "B*": i.paint(one, "even-odd", True), "b": i.paint(one, "non-zero", True, True), "b*": i.paint(one, "even-odd", True, True),
        "CS": lambda s, a, n: s.space("stroke", a), "cs": lambda s, a, n: s.space("fill", a),
        "BT": i.begin_text, "Tf": i.font, "Tc": number("tc"), "Tw": number("tw"), "Tz": number("tz", 0.01), "TL": number("tl"), "Ts": number("rise"), "Tr": number("mode"),
        "Td": i.offset(one, False), "TD": i.offset(one, True), "Tm": i.matrix, "T*": i.next_line, "Tj": i.show_string, "'": i.show_next, '"': i.show_spaced, "TJ": i.show_array,
        "BMC": i.begin_mark, "BDC": i.begin_mark, "EMC": i.end_mark, "Do": i.do,
    }
    for op, space, count in (("g", "DeviceGray", 1), ("rg", "DeviceRGB", 3), ("k", "DeviceCMYK", 4)):
        table[op], table[op.upper()] = i.device(one, "fill", space, count), i.device(one, "stroke", space, count)
    for op in ("sc", "scn"):
        table[op] = lambda s, a, n: s.components("fill", a, n)
        table[op.upper()] = lambda s, a, n: s.components("stroke", a, n)
    return table


OPERATORS = _build()


def read(pdf: Pdf, page: dict, most: int | None = None, paints: bool = False) -> Found:
    """Everything that the page's content gives; paints (a display list) only if asked for."""
    return Interpreter(pdf, most, paints).page(page)


def interpret(pdf: Pdf, page: dict, most: int | None = None) -> tuple[list[dict], list[dict], bool]:
    """(spans, rules, truncated). A span per string shown: text, x, y, size, advance, mcid; coordinates in points, y up."""
    found = read(pdf, page, most)
    return found.spans, found.rules, found.truncated


def svg_path(path: list[tuple]) -> str:
    return " ".join(f"{op.upper() if op != 'h' else 'Z'}{' '.join(f'{v:.3f}'.rstrip('0').rstrip('.') for v in xy)}" for op, *xy in path)


def _segments(path: list[tuple]):
    """(from, to) of straight lines, those that close a subpath too."""
    now = start = None
    for op, *v in path:
        if op == "m":
            now = start = tuple(v)
        elif op == "h":
            if now is not None and start is not None and now != start:
                yield now, start
            now = start
        else:
            to = tuple(v[-2:])
            if op == "l" and now is not None:
                yield now, to
            now = to


def _stroked(path: list[tuple]) -> list[dict]:
    """Straight lines along an axis."""
    out = []
    for (x0, y0), (x1, y1) in _segments(path):
        w, h = abs(x1 - x0), abs(y1 - y0)
        if h <= RULE_SKEW and w >= RULE_LONG:
            out.append({"vertical": False, "pos": (y0 + y1) / 2, "start": min(x0, x1), "end": max(x0, x1)})
        elif w <= RULE_SKEW and h >= RULE_LONG:
            out.append({"vertical": True, "pos": (x0 + x1) / 2, "start": min(y0, y1), "end": max(y0, y1)})
    return out


def _filled(path: list[tuple]) -> list[dict]:
    """Subpaths of four corners or more without curves that are so thin that they are lines."""
    out, points, curved = [], [], False
    for op, *v in [*path, ("m", 0.0, 0.0)]:
        if op == "m":
            if len(points) >= 4 and not curved:
                x0, x1 = min(p[0] for p in points), max(p[0] for p in points)
                y0, y1 = min(p[1] for p in points), max(p[1] for p in points)
                if y1 - y0 <= RULE_THICK and x1 - x0 >= RULE_LONG:
                    out.append({"vertical": False, "pos": (y0 + y1) / 2, "start": x0, "end": x1})
                elif x1 - x0 <= RULE_THICK and y1 - y0 >= RULE_LONG:
                    out.append({"vertical": True, "pos": (x0 + x1) / 2, "start": y0, "end": y1})
            points, curved = [], False
        curved = curved or op == "c"
        if op != "h":
            points.append(tuple(v[-2:]))
    return out
