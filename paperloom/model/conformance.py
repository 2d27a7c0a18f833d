"""Rules of PDF/A, PDF/UA and PDF/X over a file: one row per rule that it breaks, with a count."""

from __future__ import annotations

from .document import PRINT, Pdf, text_of
from .objects import Ref, Stream

#: Kinds of annotations that archives and prints can't have, and those that tell a reader something.
ANNOTATIONS = frozenset(("3D", "Sound", "Movie"))
TOLD = frozenset(("Widget", "Link", "FreeText", "Text", "Highlight", "Underline", "StrikeOut", "Squiggly"))
HEADINGS = ("H1", "H2", "H3", "H4", "H5", "H6")
#: Structure types of the file format.
STANDARD = frozenset(
    "Document DocumentFragment Part Art Sect Div BlockQuote Caption TOC TOCI Index NonStruct Private Aside Title FENote P H H1 H2 H3 H4 H5 H6 L LI Lbl LBody "
    "Table TR TH TD THead TBody TFoot Span Quote Note Reference BibEntry Code Link Annot Ruby RB RT RP Warichu WT WP Figure Formula Form Sub Em Strong Artifact".split()
)


def _actions(pdf: Pdf) -> int:
    """JavaScript: scripts of the name tree, and every action of that kind among the file's objects."""
    scripts = len(pdf._tree(pdf.dict(pdf.root.get("Names")).get("JavaScript"), "Names"))
    return scripts + sum(1 for n in sorted(pdf.xref) if isinstance(o := pdf.get(Ref(n, 0)), dict) and o.get("S") == "JavaScript")


def _fonts(pdf: Pdf) -> list[dict]:
    return [o for n in sorted(pdf.xref) if isinstance(o := pdf.get(Ref(n, 0)), dict) and o.get("Type") == "Font" and o.get("Subtype") != "Type3"]


def _embedded(pdf: Pdf, font: dict) -> bool:
    for part in (font, *map(pdf.dict, pdf.list(font.get("DescendantFonts")))):
        if any(isinstance(pdf.get(pdf.dict(part.get("FontDescriptor")).get(k)), Stream) for k in ("FontFile", "FontFile2", "FontFile3")):
            return True
    return False


def claimed(pdf: Pdf) -> tuple[str, str] | None:
    """Part and conformance of PDF/A that the metadata names."""
    found = {r["name"]: r["value"] for r in pdf.xmp(prefixes="pdfaid")}
    return (found["pdfaid:part"], found.get("pdfaid:conformance", "")) if "pdfaid:part" in found else None


def _rows(broken: list[tuple[str, int]]) -> list[dict]:
    return [{"rule": k, "count": int(n)} for k, n in broken if n]


def _annotations(pdf: Pdf) -> list[dict]:
    return [d for p in pdf.pages for a in pdf.list(p.get("Annots")) if (d := pdf.dict(a))]


def _acts(pdf: Pdf, holder: dict, key: str) -> bool:
    return pdf.get(pdf.dict(holder.get(key)).get("S")) in ("JavaScript", "Launch")


def _transparent(pdf: Pdf) -> bool:
    return any(pdf.get(pdf.dict(p.get("Group")).get("S")) == "Transparency" for p in pdf.pages)


def _unembedded(pdf: Pdf) -> int:
    return sum(not _embedded(pdf, f) for f in _fonts(pdf) if f.get("Subtype") not in ("CIDFontType0", "CIDFontType2"))


def archive(pdf: Pdf, part: int = 2) -> list[dict]:
    """Rules of PDF/A, parts 1 to 3, level b."""
    root, claim = pdf.root, claimed(pdf)
    profiles = [d for d in map(pdf.dict, pdf.list(root.get("OutputIntents"))) if d.get("S") == "GTS_PDFA1"]
    files = len(pdf.attachments())
    metadata = isinstance(pdf.get(root.get("Metadata")), Stream)
    notes = _annotations(pdf)
    barred = ANNOTATIONS | ({"FileAttachment"} if part == 1 else set())
    related = [d for holder in (root, *pdf.pages) for d in map(pdf.dict, pdf.list(holder.get("AF"))) if pdf.dict(d.get("EF"))]
    return _rows([
        ("encryption", "Encrypt" in pdf.trailer), ("file-id", not pdf.list(pdf.trailer.get("ID"))), ("header-version", pdf.version > ((1, 4) if part == 1 else (1, 7))),
        ("xmp-missing", not metadata), ("xmp-pdfaid", metadata and (claim is None or claim[0] != str(part))),
        ("output-intent", not profiles), ("output-intent-profile", sum(not isinstance(pdf.get(d.get("DestOutputProfile")), Stream) for d in profiles)),
        ("font-not-embedded", _unembedded(pdf)), ("javascript", _actions(pdf)), ("open-action", _acts(pdf, root, "OpenAction")), ("embedded-files", files if part == 1 else 0),
        ("transparency", part == 1 and _transparent(pdf)), ("annotation-subtype", sum(pdf.get(d.get("Subtype")) in barred for d in notes)),
        ("annotation-action", sum(pdf.get(d.get("Subtype")) not in barred and _acts(pdf, d, "A") for d in notes)),
        ("embedded-files-af", part == 3 and files > 0 and not any(pdf.list(h.get("AF")) for h in (root, *pdf.pages))), ("af-relationship", sum(pdf.get(d.get("AFRelationship")) is None for d in related) if part == 3 else 0),
    ])


def accessible(pdf: Pdf, part: int = 1) -> list[dict]:
    """Rules of PDF/UA, parts 1 and 2, that the structure tree decides. table-structure may come twice: for tables with
    children that are no rows, and for rows with children that are no cells."""
    tree = pdf.structure()
    levels = [int(e["role"][1]) for e in tree if e["role"] in HEADINGS]
    kids = lambda e: [tree[k[1]]["role"] for k in e["kids"] if k[0] == "element"]
    told = sum(pdf.get(d.get("Subtype")) in TOLD for d in _annotations(pdf))
    objects = sum(k[0] == "object" for e in tree for k in e["kids"])
    return _rows([
        ("header-version", part == 2 and pdf.version[0] != 2), ("tagged", not pdf.tagged), ("struct-tree", not tree), ("lang", not text_of(pdf.get(pdf.root.get("Lang")))),
        ("figure-alt", sum(e["role"] in ("Figure", "Formula") and not e["alt"] and e["actual_text"] is None for e in tree)), ("headings", sum(b > a + 1 for a, b in zip([0, *levels], levels))),
        ("role-unmapped", sum(e["role"] not in STANDARD for e in tree)), ("table-structure", sum(e["role"] == "Table" and any(r != "TR" for r in kids(e)) for e in tree)),
        ("table-structure", sum(e["role"] == "TR" and any(r not in ("TH", "TD") for r in kids(e)) for e in tree)),
        ("annotation-objr", told if tree and told and not objects else 0), ("page-struct-parents", sum("StructParents" not in p for p in pdf.pages) if tree else 0),
    ])


def _spaces(pdf: Pdf) -> set[str]:
    """Kinds of the colour spaces that pages name; profiles with their number of components."""
    out = set()
    for p in pdf.pages:
        for v in pdf.dict(pdf.dict(p.get("Resources")).get("ColorSpace")).values():
            v = pdf.get(v)
            kind = pdf.get(v[0]) if isinstance(v, list) and v else v
            if kind == "ICCBased" and len(v) > 1:
                kind = f"ICCBased:{pdf.get(pdf.dict(v[1]).get('N'))}"
            out |= {str(kind)} if isinstance(kind, str) else set()
    return out


def _within(a: list[float], b: list[float]) -> bool:
    return b[0] <= a[0] + 1e-6 and b[1] <= a[1] + 1e-6 and a[2] <= b[2] + 1e-6 and a[3] <= b[3] + 1e-6


def _nested(pdf: Pdf, page: dict) -> int:
    """How many boxes of a page don't lie in the next larger one: art in trim, trim in bleed, bleed in media."""
    media, boxes = pdf._rect(page.get("MediaBox")), [pdf._rect(page.get(k)) for k in ("BleedBox", "TrimBox", "ArtBox")]
    if not media:
        return 0
    outer, wrong = media, 0
    for b in boxes:
        if b:
            wrong += not _within(b, outer)
            outer = b
    return wrong


def exchange(pdf: Pdf, profile: str = "4") -> list[dict]:
    """Rules of PDF/X: 1a, 3, 4 and 6."""
    root, old, notes = pdf.root, profile in ("1a", "3"), _annotations(pdf)
    ids = pdf.get(pdf.trailer.get("ID"))
    version = {"1a": (1, 0) <= pdf.version <= (1, 3), "3": (1, 0) <= pdf.version <= (1, 3), "4": (1, 4) <= pdf.version <= (1, 7), "6": pdf.version[0] == 2}[profile]
    intent = next((d for holder in (root, *pdf.pages) for d in map(pdf.dict, pdf.list(holder.get("OutputIntents"))) if pdf.get(d.get("S")) == "GTS_PDFX"), None)
    target = pdf.get(intent.get("DestOutputProfile")) if intent else None
    barred = ANNOTATIONS | {"FileAttachment"}
    allowed = [d for d in notes if pdf.get(d.get("Subtype")) not in barred]
    prints = lambda d: isinstance(f := pdf.get(d.get("F")), int) and bool(f & PRINT)
    trapped, spaces = pdf.info()["Trapped"], _spaces(pdf)
    return _rows([
        ("encryption", "Encrypt" in pdf.trailer), ("file-id", not (isinstance(ids, list) and len(ids) == 2)), ("header-version", not version), ("xmp-missing", not isinstance(pdf.get(root.get("Metadata")), Stream)),
        ("output-intent", intent is None), ("output-intent-profile", intent is not None and not isinstance(target, Stream)), ("output-intent-cmyk", isinstance(target, Stream) and pdf.get(target.dict.get("N")) != 4),
        ("font-not-embedded", _unembedded(pdf)), ("page-trimbox", sum(not (pdf._rect(p.get("TrimBox")) or pdf._rect(p.get("ArtBox"))) for p in pdf.pages)), ("page-box-containment", sum(_nested(pdf, p) for p in pdf.pages)),
        ("color-rgb", len(spaces & {"DeviceRGB", "CalRGB", "CalGray", "ICCBased:3"}) if profile == "1a" else 0), ("color-device-rgb", profile != "1a" and "DeviceRGB" in spaces),
        ("javascript", "JavaScript" in pdf.dict(root.get("Names"))), ("open-action", _acts(pdf, root, "OpenAction")), ("transparency", old and _transparent(pdf)),
        ("annotation-subtype", len(notes) - len(allowed)), ("annotation-action", sum(_acts(pdf, d, "A") for d in allowed)), ("annotation-print-flag", sum(pdf.get(d.get("Subtype")) != "Widget" and not prints(d) for d in allowed) if old else 0),
        ("trapped", old and trapped not in ("True", "False")), ("trapped-unknown", profile == "4" and trapped == "Unknown"),
    ])


PROFILES = {
    "pdfa-1b": lambda p: archive(p, 1), "pdfa-2b": lambda p: archive(p, 2), "pdfa-3b": lambda p: archive(p, 3), "pdfua-1": lambda p: accessible(p, 1), "pdfua-2": lambda p: accessible(p, 2),
    "pdfx-1a": lambda p: exchange(p, "1a"), "pdfx-3": lambda p: exchange(p, "3"), "pdfx-4": lambda p: exchange(p, "4"), "pdfx-6": lambda p: exchange(p, "6"),
}
