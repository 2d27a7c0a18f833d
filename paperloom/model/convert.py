"""A whole file as text, Markdown, HTML or SVG pages."""

from __future__ import annotations

import html
import re

from . import layout, reading
from .content import read
from .document import Pdf, page_label

#: Rows of a document's metadata: name, entry of the information dictionary, properties of the metadata stream.
METADATA = (
    ("Author", "Author", ("dc:creator",)), ("Subject", "Subject", ("dc:description",)), ("Keywords", "Keywords", ("pdf:Keywords", "dc:subject")), ("Creator", "Creator", ("xmp:CreatorTool",)),
    ("Producer", "Producer", ("pdf:Producer",)), ("Created", "CreationDate", ("xmp:CreateDate",)), ("Modified", "ModDate", ("xmp:ModifyDate",)),
)


def metadata(pdf: Pdf) -> dict[str, str]:
    """Title and the rows above: the information dictionary first, then the metadata stream; several values are joined."""
    info, found = pdf.info(), {}
    for r in pdf.xmp():
        found.setdefault(r["name"], []).append(r["value"])
    out = {}
    for name, key, others in (("Title", "Title", ("dc:title",)), *METADATA):
        value = info[key] if info[key] is not None else next((", ".join(found[k]) if k in ("dc:creator", "dc:subject") else found[k][0] for k in others if found.get(k)), None)
        if value is not None:
            out[name] = value
    return out


def escape_markdown(text: str) -> str:
    text = re.sub(r"([\\`*_\[\]<>|])", r"\\\1", text)
    text = re.sub(r"(?m)^([^\S\n]*)([#+-])", r"\1\\\2", text)
    return re.sub(r"(?m)^([^\S\n]*[0-9]+)([.)])", r"\1\\\2", text)


def escape_html(text: str) -> str:
    return html.escape(text).replace("&#x27;", "&#39;")


def pages_of(pdf: Pdf, structured: bool = False) -> list[dict]:
    """Text, label, size and rotation of every page."""
    tree, ranges, out = pdf.structure() if structured else [], pdf.label_ranges(), []
    for i, page in enumerate(pdf.pages):
        spans = read(pdf, page).spans
        own = reading.structured(spans, tree, i) if tree else reading.text(spans)
        x0, y0, x1, y1 = pdf.box(page)
        out.append({"page": i, "text": layout.dehyphenate(own), "label": page_label(i, ranges) if ranges else None, "width": x1 - x0, "height": y1 - y0, "rotate": (pdf.get(page.get("Rotate")) or 0) % 360})
    return out


def _rows(pdf: Pdf, structured: bool) -> list[tuple[str, str]]:
    facts = metadata(pdf)
    tagged = structured and bool(pdf.structure())
    head = [("PDF version", "%d.%d" % pdf.version), ("Pages", str(len(pdf.pages))), ("Reading order", "Tagged PDF structure" if tagged else "Geometric")]
    return head + [(name, facts[name]) for name, _, _ in METADATA if name in facts]


def to_text(pdf: Pdf, structured: bool = False) -> str:
    """Pages parted by an empty line, with a line end at the end."""
    out = "\n\n".join(p["text"] for p in pages_of(pdf, structured))
    return out if out.endswith("\n") else out + "\n"


def to_markdown(pdf: Pdf, structured: bool = False, rich: bool = True, title: str = "PDF document") -> str:
    out = []
    if rich:
        out.append(f"# {escape_markdown(metadata(pdf).get('Title') or title)}\n\n| Field | Value |\n| --- | --- |\n")
        cell = lambda v: re.sub(r"[\r\n]", "<br>", v.replace("\\", "\\\\").replace("|", "\\|"))
        out += [f"| {k} | {cell(v)} |\n" for k, v in _rows(pdf, structured)] + ["\n"]
    for p in pages_of(pdf, structured):
        label = f" ({escape_markdown(p['label'])})" if rich and p["label"] else ""
        out.append(f"## Page {p['page'] + 1}{label}\n\n")
        if rich:
            out.append(f"_Size: {p['width']:.2f} x {p['height']:.2f} pt; rotation: {p['rotate']} degrees._\n\n")
        if p["text"]:
            out.append(escape_markdown(p["text"]) + "\n\n")
    return "".join(out)


def to_html(pdf: Pdf, structured: bool = False, rich: bool = True, title: str = "PDF document") -> str:
    title = metadata(pdf).get("Title") or title
    out = [f'<!doctype html>\n<html lang="und">\n<head>\n<meta charset="utf-8">\n<title>{escape_html(title)}</title>\n</head>\n<body>\n<main>\n']
    if rich:
        out.append(f'<header>\n<h1>{escape_html(title)}</h1>\n<table class="metadata"><thead><tr><th>Field</th><th>Value</th></tr></thead><tbody>\n')
        newline = "\n"
        out += [f"<tr><th>{escape_html(k)}</th><td>{escape_html(v).replace(newline, '<br>')}</td></tr>\n" for k, v in _rows(pdf, structured)]
        out.append("</tbody></table>\n</header>\n")
    for p in pages_of(pdf, structured):
        label = f" ({escape_html(p['label'])})" if rich and p["label"] else ""
        out.append(f'<section class="page" data-page="{p["page"] + 1}">\n<h2>Page {p["page"] + 1}{label}</h2>\n')
        if rich:
            out.append(f'<p class="page-meta">Size: {p["width"]:.2f} × {p["height"]:.2f} pt; rotation: {p["rotate"]} degrees.</p>\n')
        if p["text"]:
            out.append(f'<pre class="text">{escape_html(p["text"])}</pre>\n')
        out.append("</section>\n")
    return "".join([*out, "</main>\n</body>\n</html>\n"])


def _style(p: dict) -> str:
    paint = lambda c: "none" if c is None else "#%02x%02x%02x" % tuple(c)
    out = f'fill="{paint(p["fill"])}" stroke="{paint(p["stroke"])}"'
    if p["fill"] is not None and p["fill_alpha"] < 1:
        out += f' fill-opacity="{p["fill_alpha"]:g}"'
    if p["stroke"] is not None:
        out += f' stroke-width="{p["line_width"] or 1:g}"' + (f' stroke-opacity="{p["stroke_alpha"]:g}"' if p["stroke_alpha"] < 1 else "")
    return out + (' fill-rule="evenodd"' if p["even_odd"] else "")


def to_svg(pdf: Pdf, index: int) -> str:
    """A page's paths and strings; images are empty frames. Clips are clip paths; text is text, in a font of the same name."""
    page = pdf.pages[index]
    found = read(pdf, page, paints=True)
    x0, y0, x1, y1 = pdf.box(page)
    w, h, turn = x1 - x0, y1 - y0, (pdf.get(page.get("Rotate")) or 0) % 360
    base = {90: f"matrix(0 1 1 0 {0 - y0:g} {0 - x0:g})", 180: f"matrix(-1 0 0 1 {x1:g} {0 - y0:g})", 270: f"matrix(0 -1 -1 0 {y1:g} {x1:g})"}.get(turn, f"matrix(1 0 0 -1 {0 - x0:g} {y1:g})")
    if turn in (90, 270):
        w, h = h, w
    clips: dict[tuple, int] = {}
    body = []
    for p in found.paints:
        inner = ""
        if p["kind"] == "path":
            inner = f'<path d="{p["d"]}" {_style(p)}/>'
        elif p["kind"] == "text" and (p["fill"] is not None or p["stroke"] is not None):
            a, b, c, d, e, f = p["matrix"]
            inner = f'<text transform="matrix({a:g} {b:g} {0 - c:g} {0 - d:g} {e:g} {f:g})" font-family="{escape_html(p["font"] or "sans-serif")}" font-size="{p["size"]:g}" xml:space="preserve" {_style(p | {"line_width": 1, "even_odd": False})}>{escape_html(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", p["text"]))}</text>'
        elif p["kind"] == "image":
            inner = f'<rect class="image" width="1" height="1" fill="none" stroke="none" transform="matrix({" ".join(f"{v:g}" for v in p["matrix"])})"/>'
        for path in reversed(p["clips"]):
            n = clips.setdefault(path, len(clips))
            inner = f'<g clip-path="url(#c{n})">{inner}</g>' if inner else ""
        if inner:
            body.append(inner)
    defs = "".join(f'<clipPath id="c{n}"><path d="{d}"/></clipPath>' for d, n in clips.items())
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{w:g}" height="{h:g}" viewBox="0 0 {w:g} {h:g}"><defs>{defs}</defs><g transform="{base}">{"".join(body)}</g></svg>'
