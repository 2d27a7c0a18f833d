"""A PDF file: cross-reference tables and streams, recovery, page tree, and the readers of its metadata."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from functools import cached_property

from .crypt import Handler
from .objects import END_OF_WORD, SKIPPED, Budget, Keyword, Limits, Name, Parser, PdfError, Ref, Stream, decode_stream

MAX_TREE_DEPTH, MAX_FIELD_DEPTH = 64, 50
#: Flags of annotations and fields, and the numbers that each kind of view has.
HIDDEN, NO_VIEW, PRINT = 1 << 1, 1 << 5, 1 << 2
MULTILINE, PASSWORD, COMB = 1 << 12, 1 << 13, 1 << 24
#: What most files have in these places, read at once; anything else is read token by token.
_HEAD = re.compile(SKIPPED + rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj" + END_OF_WORD)
_STREAM = re.compile(SKIPPED + rb"stream" + END_OF_WORD)
_END_STREAM = re.compile(rb"[\s\x00]*endstream")
_ENTRY = re.compile(rb"[\x00\t\n\x0c\r ]*(\d{1,20})[\x00\t\n\x0c\r ]+(\d{1,20})[\x00\t\n\x0c\r ]+([nf])" + END_OF_WORD)
VIEWS = {"XYZ": 3, "Fit": 0, "FitH": 1, "FitV": 1, "FitR": 4, "FitB": 0, "FitBH": 1, "FitBV": 1}


def text_of(raw) -> str | None:
    """A text string: UTF-16 by its mark, else Latin-1."""
    if not isinstance(raw, bytes):
        return None
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    return raw.decode("latin-1")


class Pdf:
    """An open file. ``repair`` searches the whole file for objects instead of trusting its cross references."""

    def __init__(self, data: bytes, password: bytes | str | None = b"", limits: Limits | None = None, repair: bool = False):
        self.data, self.limits = data, limits or Limits()
        self._password = password.encode() if isinstance(password, str) else password or b""
        self._handler: Handler | None = None
        m = re.search(rb"%PDF-(\d)\.(\d)", data[:1024])
        self.version = (int(m[1]), int(m[2])) if m else (1, 7)
        self.xref: dict[int, tuple] = {}
        self.trailer: dict = {}
        self.recovered = False
        self._cache: dict[int, object] = {}
        self._members: dict[int, list] = {}
        self._fonts: dict = {}
        self._skipped: set[int] = set()
        try:
            if repair:
                raise PdfError("asked to repair")
            at = data.rfind(b"startxref")
            self._sections(Parser(data, at + 9).next() if at >= 0 else -1)
            self._unlock()
            if not self.pages:
                raise PdfError("no pages")
        except (PdfError, ValueError, TypeError, IndexError, KeyError, AttributeError, RecursionError):
            self._recover()
            self._unlock()
            if not self.pages:
                raise PdfError("no pages")

    def _unlock(self) -> None:
        """Sets the handler of an encrypted file. Without a password, or with another handler, what can't be decrypted stays as it is."""
        d = self.dict(self.trailer.get("Encrypt"))
        if not d or d.get("Filter", "Standard") != "Standard":
            return
        d = {k: self.get(v) for k, v in d.items()}
        if "CF" in d:
            d["CF"] = {k: self.dict(v) for k, v in d["CF"].items()}
        ids = self.list(self.trailer.get("ID"))
        first = self.get(ids[0]) if ids else b""
        try:
            self._handler = Handler(d, first if isinstance(first, bytes) else b"", self._password)
        except (PdfError, KeyError, TypeError, AttributeError) as e:
            if self._password:
                raise PdfError(f"not opened by this password ({type(e).__name__})") from e
            return
        self._cache, self._members = {}, {}
        self.__dict__.pop("pages", None)

    # Cross references: the newest section comes first, and the first entry of an object wins.

    def _sections(self, at) -> None:
        seen: set[int] = set()
        while isinstance(at, int) and at not in seen:
            if not 0 <= at < len(self.data):
                raise PdfError("bad xref offset")
            seen.add(at)
            p = Parser(self.data, at)
            if (first := p.next()) == "xref":
                trailer = self._table(p)
                if isinstance(hybrid := trailer.get("XRefStm"), int):
                    self._stream_section(hybrid)
            elif isinstance(first, int):
                trailer = self._stream_section(at)
            else:
                raise PdfError("no xref section")
            self.trailer = {**trailer, **self.trailer}
            at = trailer.get("Prev")

    def _table(self, p: Parser) -> dict:
        while isinstance(start := p.next(), int):
            for num in range(start, start + int(p.next())):
                if m := _ENTRY.match(p.data, p.pos):
                    p.pos = m.end()
                    self.xref.setdefault(num, ("at", int(m[1]), int(m[2])) if m[3] == b"n" else ("free",))
                    continue
                offset, gen, kind = p.next(), p.next(), p.next()
                if kind == "n":
                    self.xref.setdefault(num, ("at", offset, gen))
                else:
                    self.xref.setdefault(num, ("free",))
        if start != "trailer" or not isinstance(t := p.next(), dict):
            raise PdfError("no trailer")
        return t

    def _stream_section(self, at: int) -> dict:
        s = self._object_at(at)
        if not isinstance(s, Stream):
            raise PdfError("no xref stream")
        w, data = s.dict["W"], self.decoded(s, resolve=False)
        if len(w) < 3 or any(not isinstance(x, int) or not 0 <= x <= 8 for x in w) or not sum(w):
            raise PdfError("bad field widths")
        index = s.dict.get("Index") or [0, s.dict["Size"]]
        cell, i = sum(w), 0
        for start, n in zip(index[::2], index[1::2]):
            for num in range(start, start + n):
                row = data[i : i + cell]
                i += cell
                if len(row) < cell:
                    break
                kind = int.from_bytes(row[: w[0]], "big") if w[0] else 1
                a, b = int.from_bytes(row[w[0] : w[0] + w[1]], "big"), int.from_bytes(row[w[0] + w[1] :], "big")
                self.xref.setdefault(num, {1: ("at", a, b), 2: ("in", a, b)}.get(kind, ("free",)))
        return s.dict

    def _recover(self) -> None:
        """The whole file is searched for objects; the last one of a number wins."""
        self.recovered, self.xref, self._cache, self._members = True, {}, {}, {}
        for m in re.finditer(rb"(?<!\d)(\d{1,10})[\s\x00]+(\d{1,5})[\s\x00]+obj\b", self.data):
            self.xref[int(m[1])] = ("at", m.start(), int(m[2]))
            if len(self.xref) > self.limits.objects:
                raise PdfError("too many objects")
        for num in list(self.xref):
            o = self.get(Ref(num, 0))
            if isinstance(o, Stream) and o.dict.get("Type") == "ObjStm":
                for i, (n, _) in enumerate(self._object_stream(num)):
                    self.xref.setdefault(n, ("in", num, i))
        for m in re.finditer(rb"\btrailer\b", self.data):
            t = Parser(self.data, m.end()).next()
            if isinstance(t, dict) and t.get("Root"):
                self.trailer = t
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            dicts = {n: o for n in self.xref if isinstance(o := self.get(Ref(n, 0)), dict)}
            roots = [n for n, o in dicts.items() if o.get("Type") == "Catalog"] or [n for n, o in dicts.items() if "Pages" in o and "Type" not in o]
            if not roots and not any(o.get("Type") == "Page" for o in dicts.values()):
                raise PdfError("not a PDF")
            self.trailer = {**self.trailer, "Root": Ref(roots[-1], 0)} if roots else self.trailer  # else pages without a root
        self.__dict__.pop("pages", None)

    # Objects.

    def _object_at(self, at: int):
        p = Parser(self.data, at)
        if m := _HEAD.match(self.data, at):
            p.pos = m.end()
        else:
            num, gen, word = p.next(), p.next(), p.next()
            if not isinstance(num, int) or word != "obj":
                raise PdfError("no object here")
        o = p.next()
        if isinstance(o, dict):
            if m := _STREAM.match(self.data, p.pos):
                p.pos = m.end()
                start = p.pos + (2 if self.data[p.pos : p.pos + 2] == b"\r\n" else 1)
                n = self.get(o.get("Length"))
                end = start + n if isinstance(n, int) else -1
                if end < 0 or not _END_STREAM.match(self.data, end):
                    end = self.data.find(b"endstream", start)
                    end = len(self.data) if end < 0 else end
                return Stream(o, self.data[start:end])
        return o

    def _object_stream(self, num: int) -> list:
        if num not in self._members:
            s = self.get(Ref(num, 0))
            if not isinstance(s, Stream):
                return []
            data = self.decoded(s)
            p = Parser(data)
            heads = [(p.next(), p.next()) for _ in range(self.get(s.dict.get("N")) or 0)]
            first = self.get(s.dict.get("First")) or 0
            self._members[num] = [(n, Parser(data, first + at)) for n, at in heads if isinstance(n, int) and isinstance(at, int)]
        return self._members[num]

    def get(self, o, depth: int = 0):
        """What o refers to, or o itself; null for missing objects and cycles."""
        while isinstance(o, Ref) and depth < 32:
            depth += 1
            if o.num not in self._cache:
                entry, found = self.xref.get(o.num, ("free",)), None
                self._cache[o.num] = None
                if entry[0] == "at":
                    try:
                        found = self._object_at(entry[1])
                        if self._handler and self.trailer.get("Encrypt") != o:
                            found = self._handler.decrypt(found, o.num, entry[2])
                    except (PdfError, ValueError):
                        found = None
                elif entry[0] == "in":
                    own = self._object_stream(entry[1])
                    found = own[entry[2]][1].next() if entry[2] < len(own) else None
                self._cache[o.num] = found
            o = self._cache[o.num]
        return None if isinstance(o, (Ref, Keyword)) else o

    def dict(self, o) -> dict:
        o = self.get(o)
        return o if isinstance(o, dict) else o.dict if isinstance(o, Stream) else {}

    def list(self, o) -> list:
        o = self.get(o)
        return o if isinstance(o, list) else []

    # Pages.

    @property
    def root(self) -> dict:
        return self.dict(self.trailer.get("Root"))

    @cached_property
    def pages(self) -> list[dict]:
        """Page dictionaries in order, with what they inherit, and their own reference as "_ref"."""
        out: list[dict] = []

        def walk(ref, inherited: dict, depth: int, above: frozenset) -> None:
            node = self.dict(ref)
            if depth > MAX_TREE_DEPTH or ref in above or len(out) >= self.limits.pages:
                return
            own = {**inherited, **{k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}}
            if "Kids" in node:
                for k in self.list(node["Kids"]):
                    walk(k, own, depth + 1, above | {ref} if isinstance(ref, Ref) else above)
            elif node:
                out.append({**own, **node, "_ref": ref})

        walk(self.root.get("Pages"), {}, 0, frozenset())
        if not out:  # no tree: all pages by type, or else all dictionaries of the shape of a page
            dicts = [(Ref(n, 0), o) for n in sorted(self.xref) if isinstance(o := self.get(Ref(n, 0)), dict) and "Kids" not in o]
            found = [x for x in dicts if x[1].get("Type") == "Page"] or [x for x in dicts if "Type" not in x[1] and "Contents" in x[1] and ("MediaBox" in x[1] or "Resources" in x[1])]
            out += [{**o, "_ref": ref} for ref, o in found[: self.limits.pages]]
        return out

    def decoded(self, s: Stream, resolve: bool = True) -> bytes:
        return decode_stream(s, self.get if resolve else lambda x: x, Budget(self.limits.decoded))

    def _rect(self, o) -> list[float] | None:
        b = [self.get(x) for x in self.list(o)]
        if len(b) != 4 or not all(isinstance(x, (int, float)) and abs(x) < 1e9 for x in b):
            return None
        found = [float(min(b[0], b[2])), float(min(b[1], b[3])), float(max(b[0], b[2])), float(max(b[1], b[3]))]
        return found if found[2] > found[0] and found[3] > found[1] else None

    def box(self, page: dict) -> list[float]:
        """The crop box cut with the media box; the media box if they don't meet; US Letter if it can't be used."""
        media = self._rect(page.get("MediaBox")) or [0.0, 0.0, 612.0, 792.0]
        crop = self._rect(page.get("CropBox"))
        if not crop:
            return media
        cut = [max(media[0], crop[0]), max(media[1], crop[1]), min(media[2], crop[2]), min(media[3], crop[3])]
        return cut if cut[2] > cut[0] and cut[3] > cut[1] else media

    def content(self, page: dict) -> bytes:
        c = self.get(page.get("Contents"))
        parts = c if isinstance(c, list) else [c]
        out = []
        for s in map(self.get, parts):
            if isinstance(s, Stream):
                try:
                    out.append(self.decoded(s))
                except (PdfError, ValueError, TypeError):
                    self._skipped.add(id(page))
        return b"\n".join(out)

    def skipped(self, page: dict) -> bool:
        """Whether content() left out a stream of the page that can't be decoded."""
        return id(page) in self._skipped

    def font(self, ref):
        """The font of a reference or dictionary, read once per file."""
        from .fonts import Font

        key = ref if isinstance(ref, Ref) else id(ref)
        if key not in self._fonts:
            d = self.get(ref)
            self._fonts[key] = (Font(self, d), ref) if isinstance(d, dict) else (None, ref)  # holds ref, so that its id stays its own
        return self._fonts[key][0]

    def page_index(self, ref) -> int | None:
        if not hasattr(self, "_page_of"):
            self._page_of = {p["_ref"]: i for i, p in enumerate(self.pages) if isinstance(p["_ref"], Ref)}
        return self._page_of.get(ref)

    # Metadata.

    def info(self) -> dict[str, str | None]:
        d = self.dict(self.trailer.get("Info"))
        value = lambda v: str(v) if isinstance(v, Name) else text_of(v)
        return {k: value(self.get(d.get(k))) for k in ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate", "Trapped")}

    def xmp(self, most: int = 1024, longest: int = 8192, prefixes: str = "dc|xmp|pdf") -> list[dict]:
        """(name, ordinal, value) of the properties with these prefixes in the metadata stream; entities other than the five of XML stay as they are."""
        s = self.get(self.root.get("Metadata"))
        if not isinstance(s, Stream):
            return []
        raw = decode_stream(s, self.get)[: 8 << 20]
        packet, out = raw.decode("utf-16" if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else "utf-8", "replace"), []
        plain = lambda v: html.unescape(re.sub(r"&(?!(?:amp|lt|gt|quot|apos);)", "&amp;", v)).strip()[:longest]
        found = [(m.start(), m[1], [m[3]]) for m in re.finditer(rf"""[\s<]((?:{prefixes}):\w+)=(["'])(.*?)\2""", packet, re.S)]
        for m in re.finditer(rf"<((?:{prefixes}):\w+)(?:\s[^>]*)?(?<!/)>(.*?)</\1\s*>", packet, re.S):
            found.append((m.start(), m[1], re.findall(r"<rdf:li(?:\s[^>]*)?(?<!/)>(.*?)</rdf:li\s*>", m[2], re.S) or [m[2]]))
        for _, name, values in sorted(found):
            out += [{"name": name, "ordinal": i, "value": plain(v), "truncated": len(v) > longest} for i, v in enumerate(values) if "<" not in v]
        cut = len(out) > most
        return [{**x, "truncated": x["truncated"] or cut} for x in out[:most]]

    def layers(self) -> list[dict]:
        """Optional content groups: name, and whether the default configuration shows them (OFF before ON before the base state)."""
        d = self.dict(self.root.get("OCProperties"))
        c = self.dict(d.get("D"))
        on, off = self.list(c.get("ON")), self.list(c.get("OFF"))
        base = self.get(c.get("BaseState")) != "OFF"
        return [{"layer": i, "name": text_of(self.get(self.dict(g).get("Name"))), "visible": g not in off and (g in on or base)} for i, g in enumerate(self.list(d.get("OCGs")))]

    @cached_property
    def _shown(self) -> dict:
        return {g: x["visible"] for g, x in zip(self.list(self.dict(self.root.get("OCProperties")).get("OCGs")), self.layers()) if isinstance(g, Ref)}

    def _expression(self, o, depth: int = 0) -> bool:
        """A visibility expression: And, Or or Not over groups and expressions."""
        e = self.get(o)
        if not isinstance(e, list):
            return self._shown.get(o, True)
        if not e or depth > 32:
            return True
        states = [self._expression(x, depth + 1) for x in e[1:]]
        word = self.get(e[0])
        return all(states) if word == "And" else any(states) if word == "Or" else not (states and states[0])

    def hidden(self, layer) -> bool:
        """Whether a group, or a membership by its expression or its policy over groups, is off in the default configuration."""
        d = self.dict(layer)
        if d.get("Type") != "OCMD":
            return isinstance(layer, Ref) and not self._shown.get(layer, True)
        if isinstance(self.get(d.get("VE")), list):
            return not self._expression(d["VE"])
        own = d.get("OCGs")
        several = self.get(own)
        states = [self._shown.get(g, True) for g in (several if isinstance(several, list) else [own]) if isinstance(g, Ref)]
        if not states:
            return False
        policy = self.get(d.get("P")) or "AnyOn"
        return not {"AllOn": all(states), "AnyOff": not all(states), "AllOff": not any(states)}.get(str(policy), any(states))

    def _tree(self, o, leaf: str, depth: int = 0) -> list:
        """(key, value) of a name or number tree."""
        d = self.dict(o)
        flat = self.list(d.get(leaf))
        out = [(self.get(a), b) for a, b in zip(flat[::2], flat[1::2])]
        for k in self.list(d.get("Kids")) if depth < MAX_TREE_DEPTH else []:
            out += self._tree(k, leaf, depth + 1)
        return out

    def label_ranges(self) -> list[dict]:
        out = []
        for start, v in sorted(((k, v) for k, v in self._tree(self.root.get("PageLabels"), "Nums") if isinstance(k, int)), key=lambda x: x[0]):
            d = self.dict(v)
            out.append({"start": start, "style": self.get(d.get("S")), "prefix": text_of(self.get(d.get("P"))) or "", "first": self.get(d.get("St")) or 1})
        return out

    @cached_property
    def _names(self) -> dict:
        """Named destinations of the name tree, read once."""
        return {k: v for k, v in reversed(self._tree(self.dict(self.root.get("Names")).get("Dests"), "Names")) if isinstance(k, bytes)}

    def destination(self, dest) -> tuple[int | None, str | None]:
        """(page index, view) of a destination, named or explicit; the view is its kind and numbers, null ones as "null"."""
        dest = self.get(dest)
        if isinstance(dest, (str, bytes)):
            key = dest if isinstance(dest, bytes) else str(dest).encode()
            dest = self.get(self._names.get(key, self.dict(self.root.get("Dests")).get(key.decode("latin-1"))))
        if isinstance(dest, dict):
            dest = self.get(dest.get("D"))
        if not isinstance(dest, list) or not dest:
            return None, None
        page = dest[0] if isinstance(dest[0], int) else self.page_index(dest[0])
        kind = self.get(dest[1]) if len(dest) > 1 else None
        if kind not in VIEWS:
            return page, None
        numbers = [self.get(x) for x in dest[2 : 2 + VIEWS[kind]]]
        numbers += [None] * (VIEWS[kind] - len(numbers))
        if kind == "XYZ" and numbers[2] == 0:
            numbers[2] = None  # keeps the zoom
        return page, " ".join([kind, *("null" if not isinstance(x, (int, float)) else f"{x:g}" for x in numbers)])

    def _target(self, d: dict) -> tuple[int | None, str | None, str | None, str | None]:
        """(page, view, address, file) that a link or bookmark leads to."""
        action = self.dict(d.get("A"))
        kind = self.get(action.get("S"))
        uri = text_of(self.get(action.get("URI"))) if kind == "URI" else None
        spec = self.get(action.get("F")) if kind == "GoToR" else None
        if isinstance(spec, dict):
            spec = self.get(spec.get("UF")) or self.get(spec.get("F"))
        return *self.destination(d.get("Dest") or (action.get("D") if kind == "GoTo" else None)), uri, text_of(spec)

    def outline(self, most: int = 65_536) -> list[dict]:
        """Bookmarks before their children: node, parent, ordinal, depth, title, page, view, uri, file, open; truncated on
        all rows if there are more."""
        out: list[dict] = []
        seen: set = set()
        todo, cut = [(self.dict(self.root.get("Outlines")).get("First"), None, 0, 0)], False
        while todo:
            ref, parent, ordinal, depth = todo.pop()
            d = self.dict(ref)
            if not d or ref in seen:
                continue
            if len(out) >= most or depth > MAX_TREE_DEPTH:
                cut = True
                continue
            seen.add(ref)
            page, view, uri, file = self._target(d)
            count = self.get(d.get("Count"))
            out.append({"node": len(out), "parent": parent, "ordinal": ordinal, "depth": depth, "title": text_of(self.get(d.get("Title"))) or "", "page": page, "view": view, "uri": uri, "file": file, "open": isinstance(count, int) and count > 0})
            todo.append((d.get("Next"), parent, ordinal + 1, depth))
            todo.append((d.get("First"), out[-1]["node"], 0, depth + 1))
        return [{**x, "truncated": cut} for x in out]

    def annotations(self, page: dict) -> list[dict]:
        out = []
        for a in self.list(page.get("Annots")):
            d = self.dict(a)
            if d:
                dest, _, uri, file = self._target(d)
                rect = [float(x) for x in map(self.get, self.list(d.get("Rect"))) if isinstance(x, (int, float))]
                flags = self.get(d.get("F"))
                flags = flags if isinstance(flags, int) else 0
                look = self.get(self.dict(d.get("AP")).get("N"))
                if isinstance(look, dict):  # one appearance for each state
                    look = self.get(look.get(self.get(d.get("AS"))))
                kind = self.get(d.get("Subtype"))
                measure = self.dict(d.get("Measure"))
                points = [float(x) for x in map(self.get, self.list(measure.get("GPTS"))) if isinstance(x, (int, float))][:1024]
                place = self.dict(measure.get("GCS"))
                area = len(rect) == 4 and rect[0] != rect[2] and rect[1] != rect[3]
                out.append({
                    "subtype": kind, "rect": rect, "contents": text_of(self.get(d.get("Contents"))), "dest_page": dest, "uri": uri, "file": file, "flags": flags, "appearance": isinstance(look, Stream),
                    "viewable": not flags & (HIDDEN | NO_VIEW) and kind != "Popup" and isinstance(look, Stream) and area and not self.hidden(d.get("OC")), "associated": bool(self.list(d.get("AF"))),
                    "measure": str(self.get(measure.get("Subtype"))) if measure else None, "geo_points": points, "epsg": code if isinstance(code := self.get(place.get("EPSG")), int) else None, "wkt": (text_of(self.get(place.get("WKT"))) or "")[: 32 << 10] or None,
                })
        return out

    def fields(self, most: int = 20_000) -> list[dict]:
        """Terminal form fields with dotted names, their own and inherited values, and the objects that present them;
        truncated on all rows if there are more."""
        out: list[dict] = []
        seen: set = set()
        cut = False

        def walk(ref, name: str, above: dict, depth: int) -> None:
            nonlocal cut
            d = self.dict(ref)
            if not d or ref in seen or depth > MAX_FIELD_DEPTH:
                return
            if isinstance(ref, Ref):
                seen.add(ref)
            own = text_of(self.get(d.get("T")))
            name = f"{name}.{own}" if name and own else own or name
            held = {k: self.get(d[k]) if k in d else above.get(k) for k in ("FT", "V", "Ff", "DA", "Q", "MaxLen", "Opt")}
            kids = self.list(d.get("Kids"))
            named = [k for k in kids if "T" in self.dict(k)]
            if named:
                for k in named:
                    walk(k, name, held, depth + 1)
            elif len(out) >= most:
                cut = True
            else:
                out.append({"field": len(out), "name": name, **self._field(held), "widgets": [k.num for k in kids or [ref] if isinstance(k, Ref)]})

        form = self.dict(self.root.get("AcroForm"))
        for f in self.list(form.get("Fields")):
            walk(f, "", {k: self.get(form.get(k)) for k in ("DA", "Q")}, 0)
        return [{**x, "truncated": cut} for x in out]

    def _field(self, held: dict) -> dict:
        kind, value, flags = held["FT"], held["V"], held["Ff"] if isinstance(held["Ff"], int) else 0
        plain = lambda v: text_of(v) if isinstance(v, bytes) else str(v)
        values = [plain(v) for v in map(self.get, value if isinstance(value, list) else [value]) if v is not None and not isinstance(v, (dict, Stream))]
        options = {}
        for o in map(self.get, held["Opt"] if isinstance(held["Opt"], list) else []):
            pair = [plain(self.get(x)) for x in o] if isinstance(o, list) and len(o) == 2 else [plain(o)] * 2
            options.setdefault(*pair)
        shown = [options.get(v, v) if kind == "Ch" else v for v in values]
        display = None if isinstance(value, Name) and value == "Off" else "\n".join(shown) or None
        text, longest = kind == "Tx", held["MaxLen"] if isinstance(held["MaxLen"], int) else None
        return {
            "kind": kind, "value": values, "flags": flags, "display": display, "multiline": text and bool(flags & MULTILINE), "password": text and bool(flags & PASSWORD),
            "comb": text and flags & (COMB | MULTILINE | PASSWORD) == COMB and (longest or 0) > 0, "options": [f"{k}={v}" for k, v in options.items()], "max_length": longest,
        }

    def structure(self, most: int = 500_000) -> list[dict]:
        """Elements of the structure tree before their kids: node, parent, depth, role, alt, actual_text, and kids in order.

        A kid is ("element", node), ("content", page index, mcid) or ("object", null, null). A role is looked up in the role map. Content directly
        under the root is left out; an element met twice counts once. truncated is set on all if there are more.
        """
        cut = False
        top = self.dict(self.root.get("StructTreeRoot"))
        names, out, seen = self.dict(top.get("RoleMap")), [], set()

        def role(name) -> str:
            for _ in range(32):
                to = self.get(names.get(str(name)))
                if not isinstance(to, str) or to == name:
                    break
                name = to
            return str(name or "")

        def walk(ref, parent: int | None, page, depth: int) -> None:
            nonlocal cut
            found = self.get(ref)
            if isinstance(found, list):
                for k in found:
                    walk(k, parent, page, depth)
            elif isinstance(found, int):
                if parent is not None and page is not None:
                    out[parent]["kids"].append(("content", page, found))
            elif isinstance(found, dict):
                own = self.page_index(found["Pg"]) if isinstance(found.get("Pg"), Ref) else page
                if found.get("Type") == "OBJR":
                    if parent is not None:
                        out[parent]["kids"].append(("object", None, None))
                elif found.get("Type") == "MCR" or "MCID" in found:
                    walk(found.get("MCID"), parent, own, depth)
                elif "S" in found and (depth >= MAX_TREE_DEPTH or len(out) >= most):
                    cut = True
                elif "S" in found and id(found) not in seen:
                    seen.add(id(found))
                    node = len(out)
                    if parent is not None:
                        out[parent]["kids"].append(("element", node))
                    out.append({"node": node, "parent": parent, "depth": depth, "role": role(self.get(found["S"])), "alt": text_of(self.get(found.get("Alt"))), "actual_text": text_of(self.get(found.get("ActualText"))), "page": own, "kids": []})
                    walk(found.get("K"), node, own, depth + 1)

        walk(top.get("K"), None, None, 0)
        return [{**e, "truncated": cut} for e in out]

    def attachments(self) -> list[dict]:
        """Files of the name tree and the associated files of the catalog and the pages: one row for each embedded stream,
        in the order they are met; what one entry lacks another one of the same stream fills in."""
        found = [v for _, v in self._tree(self.dict(self.root.get("Names")).get("EmbeddedFiles"), "Names")] + self.list(self.root.get("AF"))
        for page in self.pages:
            found += self.list(page.get("AF"))
        out: dict = {}
        for v in found:
            d = self.dict(v)
            body = self.dict(d.get("EF"))
            ref = body.get("UF", body.get("F"))
            s = self.get(ref)
            if not isinstance(s, Stream):
                continue
            kind, relation = self.get(s.dict.get("Subtype")), self.get(d.get("AFRelationship"))
            row = {"name": text_of(self.get(d.get("UF"))) or text_of(self.get(d.get("F"))) or "", "description": text_of(self.get(d.get("Desc"))), "relationship": str(relation) if relation else None, "mime": str(kind) if kind else None}
            old = out.setdefault(ref.num if isinstance(ref, Ref) else id(s), {**row, "object": ref.num if isinstance(ref, Ref) else None, "stream": s})
            for k, x in row.items():
                old[k] = old[k] or x
        rows = []
        for x in out.values():
            try:
                data = self.decoded(x["stream"])
            except (PdfError, ValueError):
                data = None
            rows.append({**{k: v for k, v in x.items() if k != "stream"}, "safe_name": safe_name(x["name"]), "data": data})
        return rows

    def output_intents(self, most: int = 64) -> list[dict]:
        """Of the document (page null) and of its pages."""
        out = []
        for page, holder in [(None, self.root), *enumerate(self.pages)]:
            for d in map(self.dict, self.list(holder.get("OutputIntents"))):
                profile = self.get(d.get("DestOutputProfile"))
                kind = self.get(d.get("S"))
                out.append({"page": page, "subtype": str(kind) if kind else None, "identifier": text_of(self.get(d.get("OutputConditionIdentifier"))), "components": self.get(profile.dict.get("N")) if isinstance(profile, Stream) else None})
        return out[:most]

    def signatures(self, most: int = 1024) -> list[dict]:
        """Signature fields with a value: what they say, what bytes they cover, and whether the digest of these bytes is
        the one that was signed: match, mismatch, or null where it can't be told (no detached signature of a known form)."""
        from .signing import embedded, message_digest

        out: list[dict] = []
        seen: set = set()

        def walk(ref, above: str, kind, depth: int) -> None:
            d = self.dict(ref)
            if not d or ref in seen or depth > MAX_FIELD_DEPTH or len(out) >= most:
                return
            if isinstance(ref, Ref):
                seen.add(ref)
            own = text_of(self.get(d.get("T")))
            name = f"{above}.{own}" if above and own else own or above
            kind = self.get(d.get("FT", kind))
            named = [k for k in self.list(d.get("Kids")) if "T" in self.dict(k)]
            for k in named:
                walk(k, name, kind, depth + 1)
            v = self.dict(d.get("V"))
            if named or kind != "Sig" or not v:
                return
            numbers = [int(x) for x in map(self.get, self.list(v.get("ByteRange"))) if isinstance(x, (int, float))]
            ranges = [(a, n) for a, n in zip(numbers[::2], numbers[1::2]) if a >= 0 and n >= 0]
            end = sum(ranges[-1]) if ranges else 0
            form, signed = self.get(v.get("SubFilter")), self.get(v.get("Contents"))
            algorithm, wanted = message_digest(signed) if isinstance(signed, bytes) else (None, None)
            certificates, stamped = embedded(signed) if isinstance(signed, bytes) else (0, False)
            state = None
            if form in ("adbe.pkcs7.detached", "ETSI.CAdES.detached") and wanted is not None and ranges:
                state = hashlib.new(algorithm, b"".join(self.data[a : a + n] for a, n in ranges)).digest() == wanted
            say = lambda k: text_of(self.get(v.get(k)))
            out.append({
                "field": name, "sub_filter": str(form) if form else None, "signer": say("Name"), "signed_at": say("M"), "location": say("Location"), "reason": say("Reason"), "contact": say("ContactInfo"),
                "byte_range": [x for r in ranges for x in r], "whole_document": bool(ranges) and ranges[0][0] == 0 and end == len(self.data), "bytes_after": max(0, len(self.data) - end),
                "digest_algorithm": algorithm, "digest": None if state is None else "match" if state else "mismatch", "security_store": isinstance(self.get(self.root.get("DSS")), dict), "certificates": certificates, "timestamp": stamped,
            })

        for f in self.list(self.dict(self.root.get("AcroForm")).get("Fields")):
            walk(f, "", None, 0)
        return out

    def objects(self) -> list[dict]:
        """Every object in use: number, generation, type, subtype, kind, and the length of a stream's data."""
        out = []
        for num in sorted(self.xref):
            entry = self.xref[num]
            if entry[0] == "free":
                continue
            o = self.get(Ref(num, 0))
            d = o.dict if isinstance(o, Stream) else o if isinstance(o, dict) else {}
            kind, sub = self.get(d.get("Type")), self.get(d.get("Subtype"))
            form = "stream" if isinstance(o, Stream) else "dictionary" if isinstance(o, dict) else "array" if isinstance(o, list) else "name" if isinstance(o, Name) else "string" if isinstance(o, bytes) else "null" if o is None else "boolean" if isinstance(o, bool) else "number"
            out.append({"object": num, "generation": entry[2] if entry[0] == "at" else 0, "compressed": entry[0] == "in", "kind": form, "type": str(kind) if isinstance(kind, str) else None, "subtype": str(sub) if isinstance(sub, str) else None, "raw_bytes": len(o.raw) if isinstance(o, Stream) else None})
        return out

    @property
    def tagged(self) -> bool:
        return self.get(self.dict(self.root.get("MarkInfo")).get("Marked")) is True


#: Device names that a file can't have on some systems.
DEVICES = ("CON", "PRN", "AUX", "NUL")


def safe_name(name: str) -> str | None:
    """The last part of a file name, without characters and endings that a system forbids; null if nothing is left."""
    own = re.split(r"[/\\]", name)[-1].strip()
    own = "".join("_" if unicodedata.category(c) == "Cc" or c in ':<>"|?*' else c for c in own)[:200].rstrip(" .")
    if not own.strip(". _"):
        return None
    stem = own.split(".")[0].upper()
    return f"_{own}" if stem in DEVICES or re.fullmatch(r"(?:COM|LPT)[0-9]", stem) else own


def page_label(index: int, ranges: list[dict]) -> str | None:
    """The label of a page: its number from 1 without any ranges, null before the first range."""
    if not ranges:
        return str(index + 1)
    own = [r for r in ranges if r["start"] <= index]
    if not own:
        return None
    r = own[-1]
    n = index - r["start"] + r["first"]
    style = r["style"]
    if style == "D" or style and n > 100_000:  # longer numerals aren't written out
        s = str(n)
    elif style in ("R", "r"):
        s = roman(n) if style == "R" else roman(n).lower()
    elif style in ("A", "a"):
        s = chr(65 + (n - 1) % 26) * ((n - 1) // 26 + 1)
        s = s if style == "A" else s.lower()
    else:
        s = ""
    return r["prefix"] + s


def roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        while n >= value:
            out, n = out + sign, n - value
    return out
