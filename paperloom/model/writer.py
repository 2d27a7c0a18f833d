"""PDF bytes from a plain description, and page operations on existing files."""

from __future__ import annotations

import hashlib
import zlib
from codecs import charmap_encode
from functools import lru_cache

from .crypt import PAD, Handler, aes_cbc_encrypt, hash_r6, rc4
from .document import Pdf, text_of
from .fonts import BASES, HELVETICA, standard_width
from .objects import Keyword, Name, PdfError, Ref, Stream

MEDIA = (612, 792)


#: Characters that the standard fonts' encoding writes and reads back; other texts get a two-byte font with a map to Unicode.
WIN_ANSI = {c: bytes([code]) for code, c in sorted(BASES["WinAnsiEncoding"].items(), reverse=True) if code not in (0x7F, 0x81, 0x8D, 0x8F, 0x90, 0x9D, 0xA0, 0xAD)}


_WIN_ANSI_CODES = {ord(c): code[0] for c, code in WIN_ANSI.items()}
#: Names written so far, which most files share; at most so many.
_WRITTEN: dict[str, bytes] = {}
MOST_SHARED = 10_000


def width(text: str, size: float) -> float:
    return sum(standard_width("Helvetica", c) for c in text) / 1000 * size


class Wide:
    """A two-byte font whose codes are given to characters as they come, and its map back to Unicode."""

    def __init__(self):
        self.code: dict[int, int] = {}  # by character

    def encode(self, text: str) -> bytes:
        for c in dict.fromkeys(text):
            self.code.setdefault(ord(c), len(self.code) + 1)
        return text.translate(self.code).encode("utf-16-be", "surrogatepass")

    def to_unicode(self) -> bytes:
        each = [b"<%04X> <%s>" % (code, chr(c).encode("utf-16-be", "surrogatepass").hex().upper().encode()) for c, code in self.code.items()]
        blocks = [b"%d beginbfchar\n" % len(each[i : i + 100]) + b"\n".join(each[i : i + 100]) + b"\nendbfchar\n" for i in range(0, len(each), 100)]
        return b"/CIDInit /ProcSet findresource begin\n12 dict begin\nbegincmap\n/CMapName /Own def\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n" + b"".join(blocks) + b"endcmap\nend\nend\n"

    def add(self, o: Objects) -> Ref:
        below = o.add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("Own"), "CIDSystemInfo": {"Registry": "Adobe", "Ordering": "Identity", "Supplement": 0}, "DW": 500})
        to = o.add(Stream({"Filter": Name("FlateDecode")}, zlib.compress(self.to_unicode())))
        return o.add({"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Own"), "Encoding": Name("Identity-H"), "DescendantFonts": [below], "ToUnicode": to})


def _written(name: str) -> bytes:
    """A name with its slash."""
    found = _WRITTEN.get(name)
    if found is None:
        found = b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"()<>[]{}/%#" else b"#%02X" % c for c in name.encode())
        if len(_WRITTEN) < MOST_SHARED and len(name) <= 64:
            _WRITTEN[str(name)] = found
    return found


@lru_cache(maxsize=4096)
def _decimal(o: float, negative: bool) -> bytes:
    """A number of four places at most; its sign is an argument of its own, since 0.0 and -0.0 are equal."""
    return f"{o:.4f}".rstrip("0").rstrip(".").encode() or b"0"


def _string(o: bytes) -> bytes:
    return b"(" + o.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


@lru_cache(maxsize=256)
def _deflated(small: bytes) -> bytes:
    return zlib.compress(small)


def deflated(data: bytes) -> bytes:
    """zlib data; that of small contents, such as empty pages, is made once."""
    return _deflated(data) if len(data) <= 32 else zlib.compress(data)


def serialise(o) -> bytes:
    kind = type(o)  # the usual ones first
    if kind is dict:
        return b"<<" + b"".join([b" " + _written(k) + b" " + serialise(o[k]) for k in sorted(o) if not k.startswith("_")]) + b" >>"
    if kind is Name:
        return _written(o)
    if kind is Ref:
        return b"%d %d R" % (o.num, o.gen)
    if kind is float:
        return _decimal(o, o == 0 and str(o)[0] == "-")
    if kind is int:
        return b"%d" % o
    if o is None:
        return b"null"
    if isinstance(o, bool):
        return b"true" if o else b"false"
    if isinstance(o, int):
        return str(o).encode()
    if isinstance(o, float):
        return _decimal(o, o == 0 and str(o)[0] == "-")
    if isinstance(o, Keyword):
        return o.encode("latin-1")
    if isinstance(o, str):
        o = o.encode("latin-1") if (o.isascii() or max(o) < "\u0100") and not o.startswith(("\xfe\xff", "\xef\xbb\xbf")) else b"\xfe\xff" + o.encode("utf-16-be")
    if isinstance(o, bytes):
        return _string(o)
    if isinstance(o, (list, tuple)):
        return b"[" + b" ".join(map(serialise, o)) + b"]"
    if isinstance(o, Stream):
        return serialise({**o.dict, "Length": len(o.raw)}) + b"\nstream\n" + o.raw + b"\nendstream"
    raise TypeError(type(o))


class Objects:
    """Numbered objects, and the file that holds them with a cross-reference table. The same input gives the same bytes."""

    def __init__(self):
        self.all: list = []

    def add(self, o=None) -> Ref:
        self.all.append(o)
        return Ref(len(self.all), 0)

    def set(self, ref: Ref, o) -> Ref:
        self.all[ref.num - 1] = o
        return ref

    def file(self, root: Ref, info: Ref | None = None, more: dict | None = None) -> bytes:
        out, at = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
        for i, o in enumerate(self.all, 1):
            at.append(len(out))
            out += b"%d 0 obj\n" % i + serialise(o) + b"\nendobj\n"
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(at) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
        trailer = {"Size": len(at) + 1, "Root": root} | ({"Info": info} if info else {}) | (more or {})
        return bytes(out + b"trailer\n" + serialise(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % start)


def build(pages: list[list[tuple]], info: dict | None = None, outline: list[dict] | None = None, links: list[dict] | None = None, labels: list[dict] | None = None, fields: list[dict] | None = None, files: list[dict] | None = None, compress: bool = True, tags: list[dict] | None = None, xmp: str | None = None, layers: list[dict] | None = None, graphics: dict[int, bytes] | None = None, images: list[dict] | None = None) -> bytes:
    """A PDF in Helvetica; spans with characters that its encoding lacks are in a two-byte font that maps back to them.

    pages: per page (text, x, y, size); outline: {title, page, parent (index or None)}; links: {page, rect, uri or
    dest_page}; labels: {start, style, prefix, first}; fields: {name, value, kind, flags, options, max_length}; files: {name, data, description};
    tags: {role, page, spans (indices)} in reading order, each a marked content and a structure element;
    xmp: a metadata packet; layers: {name, visible}; graphics: further content by page index;
    images: {page, x, y, width, height (in points), columns, rows, channels (1, 3 or 4), pixels (rows of bytes from the
    top)}, whose fourth channel becomes a soft mask.
    """
    o = Objects()
    tagged = {(t["page"], k): (n, t["role"]) for n, t in enumerate(tags or []) for k in t["spans"]}

    def mark(page: int, k: int, shown: bytes) -> bytes:
        if (page, k) not in tagged:
            return shown
        n, role = tagged[page, k]
        return serialise(Name(role)) + b" <</MCID %d>> BDC\n" % n + shown + b"EMC\n"

    root, tree, font = o.add(), o.add(), o.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")})
    refs = [o.add() for _ in pages]
    wide = Wide()
    streams = []

    def shown(text: str) -> tuple[bytes, bytes]:
        """(font, string)."""
        if text.isascii() and text.isprintable():  # written as it is
            return b"/F0", _string(text.encode())
        try:
            return b"/F0", _string(charmap_encode(text, "strict", _WIN_ANSI_CODES)[0])
        except UnicodeEncodeError:
            pass
        if len(wide.code) + len(set(text)) > 65_000:
            raise PdfError("too many distinct characters for one font")
        return b"/F1", b"<" + wide.encode(text).hex().encode() + b">"

    for i, spans in enumerate(pages):
        body = [b"BT\n"]
        for k, (t, x, y, s) in enumerate(spans):
            name, string = shown(t)
            drawn = name + b" %s Tf 1 0 0 1 %s %s Tm %s Tj\n" % (serialise(float(s)), serialise(float(x)), serialise(float(y)), string)
            body.append(mark(i, k, drawn) if tagged else drawn)
        streams.append(b"".join([*body, b"ET"]) + (b"\n" + graphics[i] if graphics and graphics.get(i) else b""))
    fonts = {"F0": font} | ({"F1": wide.add(o)} if wide.code else {})
    for k, x in enumerate(images or []):
        streams[x["page"]] += b"\nq %s 0 0 %s %s %s cm /I%d Do Q" % (*(serialise(float(x[n])) for n in ("width", "height", "x", "y")), k)
    for i, (ref, body) in enumerate(zip(refs, streams)):
        stream = Stream({"Filter": Name("FlateDecode")}, deflated(body)) if compress else Stream({}, body)
        drawn = {f"I{k}": _image(o, x) for k, x in enumerate(images or []) if x["page"] == i}
        page = {"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, *MEDIA], "Resources": {"Font": fonts} | ({"XObject": drawn} if drawn else {}), "Contents": o.add(stream)}
        own = [x for x in links or [] if x["page"] == i]
        if own:
            page["Annots"] = [o.add({"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": list(x["rect"])} | ({"A": {"S": Name("URI"), "URI": x["uri"]}} if x.get("uri") else {"Dest": [refs[x["dest_page"]], Name("Fit")]})) for x in own]
        o.set(ref, page)
    o.set(tree, {"Type": Name("Pages"), "Kids": refs, "Count": len(refs)})
    catalog = {"Type": Name("Catalog"), "Pages": tree}
    if outline:
        top, items = o.add(), [o.add() for _ in outline]
        below: dict = {}
        for i, x in enumerate(outline):
            below.setdefault(x.get("parent"), []).append(i)
        for i, x in enumerate(outline):
            own = below[x.get("parent")]
            k, kids = own.index(i), below.get(i, [])
            d = {"Title": x["title"], "Parent": top if x.get("parent") is None else items[x["parent"]], "Dest": [refs[x["page"]], Name("Fit")]}
            d |= {"Next": items[own[k + 1]]} if k + 1 < len(own) else {}
            d |= {"First": items[kids[0]], "Last": items[kids[-1]], "Count": len(kids)} if kids else {}
            o.set(items[i], d)
        o.set(top, {"Type": Name("Outlines"), "First": items[below[None][0]], "Last": items[below[None][-1]]})
        catalog["Outlines"] = top
    if labels:
        nums = []
        for r in labels:
            nums += [r["start"], ({"S": Name(r["style"])} if r.get("style") else {}) | ({"P": r["prefix"]} if r.get("prefix") else {}) | ({"St": r["first"]} if r.get("first", 1) != 1 else {})]
        catalog["PageLabels"] = {"Nums": nums}
    if fields:
        catalog["AcroForm"] = {"Fields": [o.add({"FT": Name(f.get("kind", "Tx")), "T": f["name"], "V": f["value"]} | ({"Ff": f["flags"]} if f.get("flags") else {}) | ({"Opt": [list(x) for x in f["options"]]} if f.get("options") else {}) | ({"MaxLen": f["max_length"]} if f.get("max_length") else {})) for f in fields]}
    if xmp is not None:
        catalog["Metadata"] = o.add(Stream({"Type": Name("Metadata"), "Subtype": Name("XML")}, xmp.encode()))
    if layers:
        groups = [o.add({"Type": Name("OCG"), "Name": x["name"]}) for x in layers]
        catalog["OCProperties"] = {"OCGs": groups, "D": {"OFF": [g for g, x in zip(groups, layers) if not x["visible"]]}}
    if tags:
        top = o.add()
        kids = [o.add({"Type": Name("StructElem"), "S": Name(t["role"]), "P": top, "Pg": refs[t["page"]], "K": n}) for n, t in enumerate(tags)]
        catalog |= {"StructTreeRoot": o.set(top, {"Type": Name("StructTreeRoot"), "K": kids}), "MarkInfo": {"Marked": True}}
    if files:
        names = []
        for f in sorted(files, key=lambda f: f["name"]):
            body = o.add(Stream({"Type": Name("EmbeddedFile"), "Filter": Name("FlateDecode")}, zlib.compress(f["data"])))
            names += [f["name"], o.add({"Type": Name("Filespec"), "F": f["name"], "UF": f["name"], "EF": {"F": body}} | ({"Desc": f["description"]} if f.get("description") else {}))]
        catalog["Names"] = {"EmbeddedFiles": {"Names": names}}
    o.set(root, catalog)
    return o.file(root, o.add(dict(info)) if info else None)


def _image(o: Objects, x: dict) -> Ref:
    head = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": x["columns"], "Height": x["rows"], "BitsPerComponent": 8, "Filter": Name("FlateDecode")}
    space = lambda n: {"ColorSpace": Name("DeviceGray" if n == 1 else "DeviceRGB")}
    body, n = x["pixels"], x["channels"]
    if len(body) != x["columns"] * x["rows"] * n or n not in (1, 3, 4):
        raise PdfError("an image of another size than its pixels")
    if n < 4:
        return o.add(Stream(head | space(n), zlib.compress(body)))
    plain = b"".join(body[k : k + 3] for k in range(0, len(body), 4))
    mask = o.add(Stream(head | space(1), zlib.compress(body[3::4])))
    return o.add(Stream(head | space(3) | {"SMask": mask}, zlib.compress(plain)))


class Copier:
    """Copies objects of one file into another one, each once, with the references they need renumbered."""

    def __init__(self, pdf: Pdf, to: Objects):
        self.pdf, self.to, self.done = pdf, to, {}

    def copy(self, x):
        if isinstance(x, Ref):
            if x.num in self.done:
                return self.done[x.num]
            found = self.pdf.get(x)
            if isinstance(found, dict) and found.get("Type") in ("Page", "Pages", "Catalog"):
                return None  # a way back into the old tree
            self.done[x.num] = self.to.add()
            return self.to.set(self.done[x.num], self.copy(found))
        if isinstance(x, dict):
            return {k: self.copy(v) for k, v in x.items() if k not in ("Parent", "_ref")}
        if isinstance(x, list):
            return [self.copy(v) for v in x]
        if isinstance(x, Stream):
            return Stream({k: self.copy(v) for k, v in x.dict.items() if k != "Length"}, x.raw)
        return x


def assemble(parts: list[tuple[bytes, list[int]]]) -> bytes:
    """A file of the chosen pages (by index) of each part, in order: split, reorder and delete are choices.

    Objects that pages need are copied once per part; document-level structures aren't, see merge().
    """
    o = Objects()
    root, tree, kids = o.add(), o.add(), []
    for data, chosen in parts:
        pdf = Pdf(data)
        copier = Copier(pdf, o)
        for i in chosen:
            kids.append(o.add({**copier.copy(pdf.pages[i]), "Parent": tree}))
    o.set(tree, {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)})
    o.set(root, {"Type": Name("Catalog"), "Pages": tree})
    return o.file(root)


def merge(parts: list[bytes]) -> bytes:
    """All pages of the files in order, with their bookmarks, form fields and layers.

    Destinations lead to the pages' new places. Of fields with the same name at the top the later ones are called name_2,
    name_3 and so on. Layers keep their states. Page labels, structure trees and attachments aren't merged.
    """
    o = Objects()
    root, tree, kids, top = o.add(), o.add(), [], o.add()
    bookmarks: list[Ref] = []
    fields: list[Ref] = []
    named: dict[str, int] = {}
    groups: list = []
    off: list = []
    for data in parts:
        pdf = Pdf(data)
        copier = Copier(pdf, o)
        own = [o.add() for _ in pdf.pages]
        copier.done |= {p["_ref"].num: new for p, new in zip(pdf.pages, own) if isinstance(p["_ref"], Ref)}
        for p, new in zip(pdf.pages, own):
            o.set(new, {**copier.copy({k: v for k, v in p.items() if k != "_ref"}), "Parent": tree})
        kids += own
        bookmarks += _copied_outline(pdf, o, own, top)
        form = pdf.dict(pdf.root.get("AcroForm"))
        for f in pdf.list(form.get("Fields")):
            new = copier.copy(f)
            d = o.all[new.num - 1] if isinstance(new, Ref) else new
            if not isinstance(d, dict):
                continue
            name = text_of(pdf.get(d.get("T"))) or ""
            named[name] = named.get(name, 0) + 1
            renamed = name
            while named[name] > 1 and (renamed := f"{name}_{named[name]}") in named:
                named[name] += 1
            named.setdefault(renamed, 1)
            d = {**d, "T": renamed}
            fields.append(o.set(new, d) if isinstance(new, Ref) else o.add(d))
        for g, x in zip(pdf.list(pdf.dict(pdf.root.get("OCProperties")).get("OCGs")), pdf.layers()):
            new = copier.copy(g)
            groups.append(new)
            off += [] if x["visible"] else [new]
    o.set(tree, {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)})
    catalog = {"Type": Name("Catalog"), "Pages": tree}
    if bookmarks:
        for i, ref in enumerate(bookmarks):
            d = o.all[ref.num - 1]
            o.set(ref, d | ({"Prev": bookmarks[i - 1]} if i else {}) | ({"Next": bookmarks[i + 1]} if i + 1 < len(bookmarks) else {}))
        o.set(top, {"Type": Name("Outlines"), "First": bookmarks[0], "Last": bookmarks[-1]})
        catalog["Outlines"] = top
    if fields:
        catalog["AcroForm"] = {"Fields": fields}
    if groups:
        catalog["OCProperties"] = {"OCGs": groups, "D": {"OFF": off}}
    o.set(root, catalog)
    return o.file(root)


def _copied_outline(pdf: Pdf, o: Objects, pages: list[Ref], top: Ref) -> list[Ref]:
    """New bookmarks of a file; the ones at the top, not yet tied to each other."""
    rows = pdf.outline()
    refs = [o.add() for _ in rows]
    below: dict = {}
    for r in rows:
        below.setdefault(r["parent"], []).append(r["node"])
    for r in rows:
        d = {"Title": r["title"], "Parent": top if r["parent"] is None else refs[r["parent"]]}
        if r["page"] is not None and 0 <= r["page"] < len(pages):
            kind, *numbers = (r["view"] or "Fit").split(" ")
            d["Dest"] = [pages[r["page"]], Name(kind), *(None if x == "null" else float(x) for x in numbers)]
        elif r["uri"] is not None:
            d["A"] = {"S": Name("URI"), "URI": r["uri"]}
        kids = below.get(r["node"], [])
        if kids:
            d |= {"First": refs[kids[0]], "Last": refs[kids[-1]], "Count": len(kids) if r["open"] else -len(kids)}
        if r["parent"] is not None:
            own = below[r["parent"]]
            k = own.index(r["node"])
            d |= ({"Prev": refs[own[k - 1]]} if k else {}) | ({"Next": refs[own[k + 1]]} if k + 1 < len(own) else {})
        o.set(refs[r["node"]], d)
    return [refs[n] for n in below.get(None, [])]


def rewrite(data: bytes, least: int = 64) -> bytes:
    """The file with only the objects that its catalog and information reach, numbered anew; streams of ``least`` bytes or
    more without a filter are compressed. An encrypted file that opens comes out without encryption."""
    pdf, o = Pdf(data), Objects()
    done: dict[int, Ref] = {}
    todo: list[int] = []

    def moved(x):
        if isinstance(x, Ref):
            if x.num not in done and pdf.get(x) is not None:
                done[x.num] = o.add()
                todo.append(x.num)
            return done.get(x.num)
        if isinstance(x, dict):
            return {k: moved(v) for k, v in x.items()}
        if isinstance(x, list):
            return [moved(v) for v in x]
        if isinstance(x, Stream):
            d, raw = {k: moved(v) for k, v in x.dict.items() if k != "Length"}, x.raw
            if "Filter" not in d and len(raw) >= least and len(small := zlib.compress(raw, 9)) < len(raw):
                d, raw = {**d, "Filter": Name("FlateDecode")}, small
            return Stream(d, raw)
        return x

    root, info = moved(pdf.trailer.get("Root")), moved(pdf.trailer.get("Info"))
    while todo:
        num = todo.pop()
        o.set(done[num], moved(pdf.get(Ref(num, 0))))
    return o.file(root if isinstance(root, Ref) else o.add(root), info if isinstance(info, Ref) else None)


def encrypt(data: bytes, user: bytes = b"", owner: bytes = b"", aes: bool = True, permissions: int = -4) -> bytes:
    """The file encrypted with AES-256 (revision 6) or RC4 of 128 bits (revision 3). Salts and vectors are digests of the file, so bytes repeat."""
    pdf, salt = Pdf(data), lambda *x: hashlib.sha256(repr(x).encode() + data).digest()
    d = {"Filter": Name("Standard"), "P": permissions}
    file_id = salt("id")[:16]
    if aes:
        key = salt("key", user, owner)
        u, o = salt("u")[:16], salt("o")[:16]
        d |= {"V": 5, "R": 6, "Length": 256, "CF": {"StdCF": {"CFM": Name("AESV3"), "Length": 32}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
        d["U"] = hash_r6(user, u[:8]) + u
        d["UE"] = aes_cbc_encrypt(hash_r6(user, u[8:]), bytes(16), key)
        d["O"] = hash_r6(owner or user, o[:8], d["U"]) + o
        d["OE"] = aes_cbc_encrypt(hash_r6(owner or user, o[8:], d["U"]), bytes(16), key)
        plain = (permissions & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff\xff\xff\xffTadb" + salt("perms")[:4]
        d["Perms"] = aes_cbc_encrypt(key, bytes(16), plain)
    else:
        d |= {"V": 2, "R": 3, "Length": 128}
        h = Handler.__new__(Handler)
        h.revision, h.bytes, h.metadata, h.d, h.file_id = 3, 16, True, d, file_id
        wrapped, key = (user + PAD)[:32], h.owner_key(owner or user)
        for i in range(20):
            wrapped = rc4(bytes(c ^ i for c in key), wrapped)
        d["O"] = wrapped
        d["U"] = h.proof(h._from_user(user)) + bytes(16)
    handler = Handler(d, file_id, user)

    def seal(x, num: int, n: list[int]):
        if isinstance(x, str) and not isinstance(x, (Name, Keyword)):
            x = x.encode("latin-1") if all(ord(c) < 256 for c in x) else b"\xfe\xff" + x.encode("utf-16-be")
        if isinstance(x, bytes):
            if not aes:
                return rc4(handler.object_key(num, 0, "V2"), x)
            n[0] += 1
            iv, pad = salt(num, n[0])[:16], 16 - len(x) % 16
            return iv + aes_cbc_encrypt(handler.key, iv, x + bytes([pad]) * pad)
        if isinstance(x, dict):
            return {k: seal(v, num, n) for k, v in x.items()}
        if isinstance(x, list):
            return [seal(v, num, n) for v in x]
        if isinstance(x, Stream):
            return Stream({k: seal(v, num, n) for k, v in x.dict.items() if k != "Length"}, seal(x.raw, num, n))
        return x

    out = Objects()
    kept = {num: out.add() for num in sorted(pdf.xref) if pdf.xref[num][0] != "free" and not (isinstance(o := pdf.get(Ref(num, 0)), Stream) and o.dict.get("Type") in ("XRef", "ObjStm"))}

    def moved(x):
        if isinstance(x, Ref):
            return kept.get(x.num)
        if isinstance(x, dict):
            return {k: moved(v) for k, v in x.items()}
        if isinstance(x, list):
            return [moved(v) for v in x]
        return Stream(moved(x.dict), x.raw) if isinstance(x, Stream) else x

    for num, ref in kept.items():
        out.set(ref, seal(moved(pdf.get(Ref(num, 0))), ref.num, [0]))
    info = moved(pdf.trailer.get("Info"))
    return out.file(moved(pdf.trailer["Root"]), info if isinstance(info, Ref) else None, {"Encrypt": d, "ID": [file_id, file_id]})
