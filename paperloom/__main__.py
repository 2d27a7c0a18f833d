"""The engine from a shell.

Reading verbs take a file or a folder and print a JSON line for each row; they run on a local Spark session, or on the one
that spark-submit makes. Converting verbs write a file per document (or page) into a folder. Editing verbs read one file
and write another.
"""

from __future__ import annotations

import argparse
import base64
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import conformance, edit
from .model.document import Pdf
from .model.objects import PdfError, Ref, Stream, decode_stream
from .model.writer import assemble, encrypt, merge, rewrite
from .operators import decode
from .sources.corpus import read_pdfs

READING = {
    "info": decode.summary, "files": decode.files, "dump": decode.objects, "pages": decode.pages, "status": decode.page_status, "spans": decode.spans, "lines": decode.lines, "rules": decode.rules, "images": decode.images,
    "paints": decode.paints, "tables": decode.tables, "forms": decode.form_fields, "outline": decode.outline, "annotations": decode.annotations, "struct": decode.structure, "attachments": decode.attachments,
    "signatures": decode.signatures, "xmp": decode.xmp, "layers": decode.layers, "intents": decode.output_intents,
}


def chosen(text: str, n: int) -> list[int]:
    """Indices of pages from 1 as in "1,3-5,8-": lists, ranges, open ends; all without a text. Beyond the file: an error."""
    if not text:
        return list(range(n))
    out = []
    for part in text.split(","):
        a, dash, b = part.strip().partition("-")
        low, high = int(a or 1), int(b or n) if dash else int(a)
        if not 1 <= low <= high <= n:
            raise PdfError(f"no pages {part} of {n}")
        out += range(low - 1, high)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="paperloom", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args, **kinds) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        for a in args:
            v.add_argument(a)
        v.add_argument("--password", default="")
        for k, how in kinds.items():
            v.add_argument(f"--{k}", **how)
        return v

    flag, number = {"action": "store_true"}, {"type": float}
    for name in READING:
        verb(name, "path")
    verb("text", "path", struct=flag)
    verb("search", "path", query={"required": True}, case=flag, page={"type": int, "action": "append"})
    verb("links", "path")
    verb("validate", "path", profile={"default": "pdfa-2b", "choices": sorted(conformance.PROFILES)})
    verb("debug-stream", "path", object={"type": int, "required": True}, raw=flag)
    verb("convert", "path", "folder", form={"default": "text", "choices": ["text", "markdown", "html"]}, struct=flag)
    for name in ("export-svg", "export-pptx"):
        verb(name, "path", "folder")
    verb("merge", "output").add_argument("inputs", nargs="+")
    verb("split", "path", "output", pages={"required": True})
    verb("arrange", "path", "output", order={"default": ""}, delete={"default": ""}, rotate={"type": int, "default": 0})
    verb("optimize", "path", "output")
    verb("encrypt", "path", "output", user={"default": ""}, owner={"default": ""}, rc4=flag)
    verb("fill", "path", "output", set={"action": "append", "default": []})
    verb("set-meta", "path", "output", set={"action": "append", "default": []}, modified={})
    rect = {"type": float, "nargs": 4, "required": True}
    verb("annotate", "path", "output", page={"type": int, "default": 0}, subtype={"default": "Highlight"}, rect=rect, contents={})
    verb("redact", "path", "output", page={"type": int, "default": 0}, rect=rect, bare=flag)
    verb("stamp", "path", "output", text={"required": True}, page={"type": int}, x=number | {"default": 100.0}, y=number | {"default": 100.0}, size=number | {"default": 24.0}, angle=number | {"default": 0.0}, under=flag)
    verb("tag", "path", "output", lang={})
    return p


def edited(a: argparse.Namespace) -> bytes | None:
    """What an editing verb makes of its file; null for the other verbs."""
    pairs = lambda: dict(x.split("=", 1) for x in a.set)
    if a.verb == "merge":
        return merge([Path(x).read_bytes() for x in a.inputs])
    if a.verb not in ("split", "arrange", "optimize", "encrypt", "fill", "set-meta", "annotate", "redact", "stamp", "tag"):
        return None
    data = Path(a.path).read_bytes()
    n = len(Pdf(data, a.password).pages)
    if a.verb == "split":
        return assemble([(data, chosen(a.pages, n))])
    if a.verb == "arrange":
        gone = set(chosen(a.delete, n)) if a.delete else set()
        kept = [k for k in chosen(a.order, n) if k not in gone]
        if not kept:
            raise PdfError("a file needs a page")
        out = assemble([(data, kept)])
        return edit.rotate(out, {k: a.rotate // 90 for k in range(len(kept))}) if a.rotate else out
    if a.verb == "optimize":
        return rewrite(data)
    if a.verb == "encrypt":
        return encrypt(data, a.user.encode(), a.owner.encode(), aes=not a.rc4)
    if a.verb == "fill":
        return edit.fill(data, pairs())
    if a.verb == "set-meta":
        return edit.set_info(data, pairs(), a.modified)
    if a.verb == "annotate":
        return edit.annotate(data, [{"page": a.page, "subtype": a.subtype, "rect": a.rect, "contents": a.contents}])
    if a.verb == "redact":
        return edit.redact(data, [{"page": a.page, "rect": a.rect}], None if a.bare else (0.0, 0.0, 0.0))
    if a.verb == "stamp":
        return edit.stamp(data, [{"page": a.page, "text": a.text, "x": a.x, "y": a.y, "size": a.size, "angle": a.angle, "under": a.under}])
    return edit.tag(data, a.lang)


def read(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The rows of a reading or converting verb, with the paths of their files."""
    files = read_pdfs(spark, a.path).select("path", "content").withColumn("doc_id", F.xxhash64("path"))
    names = {"password": a.password}
    if a.verb == "text":
        rows = decode.text(files, structured=a.struct, **names)
    elif a.verb == "search":
        rows = decode.search(files, a.query, not a.case, a.page, **names)
    elif a.verb == "links":
        rows = decode.annotations(files, **names).where("subtype = 'Link'")
    elif a.verb == "validate":
        rows = decode.violations(files, a.profile, **names)
    elif a.verb == "convert":
        rows = decode.converted(files, a.form, a.struct, **names)
    elif a.verb in ("export-svg", "export-pptx"):
        rows = (decode.svg if a.verb == "export-svg" else decode.slides)(files, **names)
    else:
        rows = READING[a.verb](files, **names)
    return files.select("doc_id", "path").join(rows, "doc_id").drop("doc_id")


def plain(v):
    """A value as JSON holds it; bytes in base 64."""
    return base64.b64encode(v).decode() if isinstance(v, (bytes, bytearray)) else v


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    try:
        if a.verb == "debug-stream":
            pdf = Pdf(Path(a.path).read_bytes(), a.password)
            s = pdf.get(Ref(a.object, 0))
            if not isinstance(s, Stream):
                raise PdfError("no stream")
            sys.stdout.buffer.write(s.raw if a.raw else decode_stream(s, pdf.get))
            return 0
        out = edited(a)
    except (PdfError, ValueError, KeyError, IndexError, OSError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    if out is not None:
        Path(a.output).write_bytes(out)
        return 0
    spark = spark or SparkSession.builder.appName("paperloom").getOrCreate()
    endings = {"convert": {"text": "txt", "markdown": "md", "html": "html"}.get(getattr(a, "form", "")), "export-svg": "svg", "export-pptx": "pptx"}
    for row in read(spark, a).toLocalIterator():
        r = row.asDict()
        if a.verb not in endings:
            print(json.dumps({k: plain(v) for k, v in r.items()}, ensure_ascii=False, default=str))
            continue
        body = r.get("body", r.get("svg", r.get("pptx")))
        name = Path(r["path"]).stem + (f"-{r['page'] + 1}" if "page" in r else "")
        target = Path(a.folder) / f"{name}.{endings[a.verb]}"
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(bytes(body) if isinstance(body, (bytes, bytearray)) else body.encode())
    return 0


if __name__ == "__main__":
    sys.exit(main())
