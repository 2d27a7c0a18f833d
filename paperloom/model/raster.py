"""Pixels of images that need no codec, dashed lines, and slides. Plain Python and numpy, no Spark."""

from __future__ import annotations

import io
import math
import re
import zipfile

import numpy as np

from ..functions.colour import rgb_bytes
from .content import COMPONENTS, read
from .document import Pdf
from .layout import lines
from .objects import PdfError, Stream, _samples

#: Most pixels of one image.
MAX_PIXELS = 64 << 20
CODECS = frozenset(("DCTDecode", "DCT", "JPXDecode", "JBIG2Decode", "CCITTFaxDecode", "CCF"))


def pixels(pdf: Pdf, s: Stream) -> tuple[int, int, bytes]:
    """(columns, rows, rows of red, green and blue from the top) of an image of gray, RGB, CMYK or indexed samples, or of a
    stencil, whose painted pixels are black. Images behind a codec and other spaces are errors."""
    d = {k: pdf.get(v) for k, v in s.dict.items()}
    names = d.get("Filter")
    if CODECS & {str(n) for n in (names if isinstance(names, list) else [names])}:
        raise PdfError("an image behind a codec")
    w, h, mask = d.get("Width"), d.get("Height"), d.get("ImageMask") is True
    bits = 1 if mask else d.get("BitsPerComponent")
    if not isinstance(w, int) or not isinstance(h, int) or w < 1 or h < 1 or w * h > MAX_PIXELS or bits not in (1, 2, 4, 8, 16):
        raise PdfError("bad image size")
    space, palette = d.get("ColorSpace"), None
    kind = "DeviceGray" if mask else str(pdf.get(space[0]) if isinstance(space, list) and space else space)
    if kind == "ICCBased":
        kind = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}.get(pdf.get(pdf.dict(space[1]).get("N")), kind)
    if kind in ("Indexed", "I"):
        base = pdf.get(space[1])
        base = str(pdf.get(base[0]) if isinstance(base, list) and base else base)
        table = pdf.get(space[3])
        table = pdf.decoded(table) if isinstance(table, Stream) else table
        n = COMPONENTS.get(base, 0)
        if not isinstance(table, bytes) or n not in (1, 3, 4):
            raise PdfError("bad palette")
        palette = [rgb_bytes(base, tuple(v / 255 for v in table[k : k + n])) for k in range(0, len(table) - n + 1, n)]
        kind = "Indexed"
    n = COMPONENTS.get(kind)
    if kind not in ("DeviceGray", "CalGray", "DeviceRGB", "CalRGB", "DeviceCMYK", "Indexed"):
        raise PdfError(f"no pixels of {kind}")
    raw, width = pdf.decoded(s), (w * n * bits + 7) // 8
    raw = raw[: width * h].ljust(width * h, b"\0")
    v = np.stack([_samples(raw[k * width : (k + 1) * width], bits)[: w * n] for k in range(h)]).reshape(h, w, n)
    decode = [float(x) for x in map(pdf.get, pdf.list(d.get("Decode"))) if isinstance(x, (int, float))]
    if palette is not None:
        return w, h, np.array(palette, np.uint8)[np.minimum(v[:, :, 0], len(palette) - 1)].tobytes()
    x = v / ((1 << bits) - 1)
    if len(decode) == 2 * n:
        low, high = np.array(decode[::2]), np.array(decode[1::2])
        x = low + x * (high - low)
    if kind == "DeviceCMYK":
        found, at = np.unique(np.round(np.clip(x, 0, 1).reshape(-1, 4) * 255).astype(np.uint8), axis=0, return_inverse=True)
        return w, h, np.array([rgb_bytes(kind, tuple(c / 255)) for c in found], np.uint8)[at.ravel()].tobytes()
    x = np.floor(np.clip(x, 0, 1) * 255 + 0.5).astype(np.uint8)
    return w, h, (x if n == 3 else np.repeat(x, 3, axis=2)).tobytes()


def dashes(points: list[tuple[float, float]], pattern: list[float], phase: float = 0.0) -> list[list[tuple[float, float]]]:
    """The strokes of a line through points by a pattern of lengths, on and off in turn; the line itself without a sound
    pattern. The pattern runs on over corners."""
    if not pattern or any(not math.isfinite(x) or x < 0 for x in pattern) or sum(pattern) <= 0:
        return [list(points)]
    own = list(pattern) * (2 if len(pattern) % 2 else 1)
    left = phase % sum(own)
    k = 0
    while left >= own[k]:
        left, k = left - own[k], (k + 1) % len(own)
    rest, out = own[k] - left, []
    now = [points[0]] if k % 2 == 0 and points else None
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        length = math.hypot(x1 - x0, y1 - y0)
        at = 0.0
        while length - at > rest:
            at += rest
            p = (x0 + (x1 - x0) * at / length, y0 + (y1 - y0) * at / length)
            if now is not None:
                out.append([*now, p])
            k = (k + 1) % len(own)
            now, rest = ([p] if k % 2 == 0 else None), own[k]
        rest -= length - at
        if now is not None:
            now.append((x1, y1))
    return out + ([now] if now and len(now) > 1 else [])


# Slides.

_A = "http://schemas.openxmlformats.org/drawingml/2006/main"
_P = "http://schemas.openxmlformats.org/presentationml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_NS = f'xmlns:a="{_A}" xmlns:r="{_R}" xmlns:p="{_P}"'
_GROUP = '<p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>'
EMU = 12_700  # a point


def _xml(text: str) -> str:
    text = re.sub(r"[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", "", text)
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def _frame(x: float, y: float, w: float, h: float) -> str:
    return f'<a:xfrm><a:off x="{round(x * EMU)}" y="{round(y * EMU)}"/><a:ext cx="{max(0, round(w * EMU))}" cy="{max(0, round(h * EMU))}"/></a:xfrm>'


def _slide(pdf: Pdf, page: dict) -> str:
    found = read(pdf, page, paints=True)
    x0, _, _, y1 = pdf.box(page)
    shapes = []
    for p in found.paints:
        corners = [tuple(map(float, xy.split())) for xy in re.findall(r"[ML](\S+ \S+)", p["d"] or "")]
        xs, ys = {round(x, 3) for x, _ in corners}, {round(y, 3) for _, y in corners}
        if p["kind"] == "path" and len(corners) >= 4 and len(xs) == len(ys) == 2 and "C" not in p["d"]:  # a rectangle along the axes
            fill = f'<a:solidFill><a:srgbClr val="{"%02X%02X%02X" % tuple(p["fill"])}"/></a:solidFill>' if p["fill"] else "<a:noFill/>"
            line = f'<a:ln w="{round((p["line_width"] or 1) * EMU)}"><a:solidFill><a:srgbClr val="{"%02X%02X%02X" % tuple(p["stroke"])}"/></a:solidFill></a:ln>' if p["stroke"] else ""
            shapes.append((f"{_frame(min(xs) - x0, y1 - max(ys), max(xs) - min(xs), max(ys) - min(ys))}<a:prstGeom prst=\"rect\"><a:avLst/></a:prstGeom>{fill}{line}", "<a:p/>"))
        elif p["kind"] == "path" and len(corners) == 2 and p["stroke"]:
            line = f'<a:ln w="{round((p["line_width"] or 1) * EMU)}"><a:solidFill><a:srgbClr val="{"%02X%02X%02X" % tuple(p["stroke"])}"/></a:solidFill></a:ln>'
            shapes.append((f"{_frame(min(xs) - x0, y1 - max(ys), max(xs) - min(xs), max(ys) - min(ys))}<a:prstGeom prst=\"line\"><a:avLst/></a:prstGeom>{line}", "<a:p/>"))
    for ln in lines(found.spans):
        left, right = min(s["x"] for s in ln["spans"]), max(s["x"] + s["advance"] for s in ln["spans"])
        box = _frame(left - x0, y1 - ln["y"] - 0.8 * ln["size"], right - left, 1.2 * ln["size"])
        run = f'<a:p><a:r><a:rPr sz="{max(100, round(100 * ln["size"]))}"/><a:t>{_xml(ln["text"])}</a:t></a:r></a:p>'
        shapes.append((f'{box}<a:prstGeom prst="rect"><a:avLst/></a:prstGeom><a:noFill/>', run))
    body = "".join(f'<p:sp><p:nvSpPr><p:cNvPr id="{k}" name="s{k}"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr>{shape}</p:spPr><p:txBody><a:bodyPr wrap="none" lIns="0" tIns="0" rIns="0" bIns="0"/><a:lstStyle/>{text}</p:txBody></p:sp>' for k, (shape, text) in enumerate(shapes, 2))
    return f"{_HEAD}<p:sld {_NS}><p:cSld><p:spTree>{_GROUP}{body}</p:spTree></p:cSld><p:clrMapOvr><a:masterClrMapping/></p:clrMapOvr></p:sld>"


def to_slides(pdf: Pdf) -> bytes:
    """A presentation with a slide for each page: its lines as text boxes, rectangles and straight lines as shapes. The
    same file gives the same bytes. Images, curves and clips are left out."""
    n = len(pdf.pages)
    x0, y0, x1, y1 = pdf.box(pdf.pages[0])
    rel = lambda rows: _HEAD + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_R}/{kind}" Target="{to}"/>' for i, kind, to in rows) + "</Relationships>"
    types = "".join(f'<Override PartName="/ppt/{part}" ContentType="application/vnd.openxmlformats-officedocument.{kind}+xml"/>' for part, kind in [
        ("presentation.xml", "presentationml.presentation.main"), ("slideMasters/slideMaster1.xml", "presentationml.slideMaster"), ("slideLayouts/slideLayout1.xml", "presentationml.slideLayout"), ("theme/theme1.xml", "theme"),
        *((f"slides/slide{k}.xml", "presentationml.slide") for k in range(1, n + 1)),
    ])
    colours = "".join(f'<a:{k}><a:srgbClr val="{v}"/></a:{k}>' for k, v in zip("dk1 lt1 dk2 lt2 accent1 accent2 accent3 accent4 accent5 accent6 hlink folHlink".split(), ["000000", "FFFFFF"] * 6))
    plain = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>'
    face = '<a:latin typeface="Arial"/><a:ea typeface=""/><a:cs typeface=""/>'
    empty = f"<p:cSld><p:spTree>{_GROUP}</p:spTree></p:cSld>"
    parts = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>',
        "_rels/.rels": rel([(1, "officeDocument", "ppt/presentation.xml")]),
        "ppt/presentation.xml": f'{_HEAD}<p:presentation {_NS}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:sldIdLst>{"".join(f"<p:sldId id=\"{255 + k}\" r:id=\"rId{k + 1}\"/>" for k in range(1, n + 1))}</p:sldIdLst><p:sldSz cx="{round((x1 - x0) * EMU)}" cy="{round((y1 - y0) * EMU)}"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rel([(1, "slideMaster", "slideMasters/slideMaster1.xml"), *((k + 1, "slide", f"slides/slide{k}.xml") for k in range(1, n + 1))]),
        "ppt/slideMasters/slideMaster1.xml": f'{_HEAD}<p:sldMaster {_NS}>{empty}<p:clrMap bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" accent1="accent1" accent2="accent2" accent3="accent3" accent4="accent4" accent5="accent5" accent6="accent6" hlink="hlink" folHlink="folHlink"/><p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst></p:sldMaster>',
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": rel([(1, "slideLayout", "../slideLayouts/slideLayout1.xml"), (2, "theme", "../theme/theme1.xml")]),
        "ppt/slideLayouts/slideLayout1.xml": f'{_HEAD}<p:sldLayout {_NS} type="blank">{empty}<p:clrMapOvr><a:masterClrMapping/></p:clrMapOvr></p:sldLayout>',
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": rel([(1, "slideMaster", "../slideMasters/slideMaster1.xml")]),
        "ppt/theme/theme1.xml": f'{_HEAD}<a:theme xmlns:a="{_A}" name="plain"><a:themeElements><a:clrScheme name="plain">{colours}</a:clrScheme><a:fontScheme name="plain"><a:majorFont>{face}</a:majorFont><a:minorFont>{face}</a:minorFont></a:fontScheme><a:fmtScheme name="plain"><a:fillStyleLst>{plain * 3}</a:fillStyleLst><a:lnStyleLst>{f"<a:ln>{plain}</a:ln>" * 3}</a:lnStyleLst><a:effectStyleLst>{"<a:effectStyle><a:effectLst/></a:effectStyle>" * 3}</a:effectStyleLst><a:bgFillStyleLst>{plain * 3}</a:bgFillStyleLst></a:fmtScheme></a:themeElements></a:theme>',
    }
    for k, page in enumerate(pdf.pages, 1):
        parts[f"ppt/slides/slide{k}.xml"] = _slide(pdf, page)
        parts[f"ppt/slides/_rels/slide{k}.xml.rels"] = rel([(1, "slideLayout", "../slideLayouts/slideLayout1.xml")])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body.encode(), zipfile.ZIP_DEFLATED)
    return out.getvalue()
