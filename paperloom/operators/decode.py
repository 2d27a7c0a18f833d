"""PDF files to relational tables. One file is one row in; each table comes from one Arrow stage without a shuffle.

A file that can't be read gives a row in files() with open_error, and none in the other tables: no file fails a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..model import content as content_model
from ..model import conformance, convert, layout, raster, reading
from ..model.document import Pdf, page_label, text_of
from ..model.objects import Limits, PdfError, Ref, Stream, decode_stream
from ..runtime import batched, ship, sliced

ERRORS = (PdfError, ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError, OverflowError)


def each_file(files: DataFrame, schema: str, rows: Callable[[Pdf], Iterator[dict]], id_col: str = "doc_id", content_col: str = "content", password: str = "", password_col: str | None = None, limits: Limits | None = None, repair: bool = False) -> DataFrame:
    """A table of one's own: rows(file) of every file that opens, as doc_id and the columns of schema (DDL).

    All tables here are made this way and take the same options: a password for all files or a column of passwords, limits
    of what reading may take, and whether cross references are searched for instead of trusted. Rows are dictionaries;
    missing keys are null. A file for which rows() fails gives none."""
    ship(files.sparkSession)
    key = F.col(password_col) if password_col else F.lit(password)
    own = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(content_col).alias("content"), key.cast("string").alias("password"))
    arrow = to_arrow_schema(StructType.fromDDL(f"doc_id long, {schema}"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        for b in sliced(batches, 1):
            for i, data, word in zip(*(b.column(k).to_pylist() for k in range(3))):
                try:
                    out = [{"doc_id": i, **r} for r in rows(Pdf(data or b"", word, limits, repair))]
                except ERRORS:
                    continue
                yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(each(batches), arrow)

    return own.mapInArrow(run, f"doc_id long, {schema}")


_stage = each_file


def each_page(files: DataFrame, schema: str, rows: Callable[[int, dict, content_model.Found], Iterator[dict]], **options) -> DataFrame:
    """The same of every page: rows(index, page, content); page and truncated are columns too. A page that fails gives none."""
    return each_file(files, f"page int, {schema}, truncated boolean", lambda p: _each_page(p, rows), **options)


def files(df: DataFrame, id_col: str = "doc_id", content_col: str = "content", password: str = "", password_col: str | None = None, limits: Limits | None = None, repair: bool = False) -> DataFrame:
    """A row per file: version, page count, recovered, open_error."""
    ship(df.sparkSession)
    key = F.col(password_col) if password_col else F.lit(password)
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(content_col).alias("content"), key.cast("string").alias("password"))
    schema = "doc_id long, major int, minor int, page_count int, recovered boolean, open_error string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            out = []
            for i, data, word in zip(*(b.column(k).to_pylist() for k in range(3))):
                row = dict.fromkeys(arrow.names) | {"doc_id": i}
                try:
                    p = Pdf(data or b"", word, limits, repair)
                    row |= {"major": p.version[0], "minor": p.version[1], "page_count": len(p.pages), "recovered": p.recovered}
                except ERRORS as e:
                    row["open_error"] = f"{type(e).__name__}: {e}"[:200]
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, arrow)

    return own.mapInArrow(run, schema)


def pages(df: DataFrame, **names) -> DataFrame:
    def rows(p: Pdf):
        ranges = p.label_ranges()
        for i, page in enumerate(p.pages):
            x0, y0, x1, y1 = p.box(page)
            yield {"page": i, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "rotate": (p.get(page.get("Rotate")) or 0) % 360, "label": page_label(i, ranges), "n_annots": len(p.list(page.get("Annots")))}

    return _stage(df, "page int, x0 double, y0 double, x1 double, y1 double, rotate int, label string, n_annots int", rows, **names)


def _each_page(p: Pdf, rows: Callable[[int, dict, content_model.Found], Iterator[dict]]) -> Iterator[dict]:
    """rows(index, page, content) of every page, with whether a limit cut the page. A page that fails gives none; its error
    is in page_status()."""
    for i, page in enumerate(p.pages):
        try:
            found = content_model.read(p, page)
            out = [{"page": i, "truncated": found.truncated, **r} for r in rows(i, page, found)]
        except ERRORS:
            continue
        yield from out


def page_status(df: DataFrame, **names) -> DataFrame:
    """A row per page: how many spans, rules and images its content gives, whether a limit cut it, and its error if it
    can't be read."""

    def rows(p: Pdf):
        for i, page in enumerate(p.pages):
            row = {"page": i, "spans": 0, "rules": 0, "images": 0, "truncated": False, "page_error": None}
            try:
                f = content_model.read(p, page)
                row |= {"spans": len(f.spans), "rules": len(f.rules), "images": len(f.images), "truncated": f.truncated}
            except ERRORS as e:
                row["page_error"] = f"{type(e).__name__}: {e}"[:200]
            yield row

    return _stage(df, "page int, spans int, rules int, images int, truncated boolean, page_error string", rows, **names)


def spans(df: DataFrame, **names) -> DataFrame:
    """A row per string shown, in the order of painting (seq)."""
    return _stage(df, "page int, seq int, text string, x double, y double, size double, advance double, mcid int, truncated boolean", lambda p: _each_page(p, lambda i, page, f: f.spans), **names)


def rules(df: DataFrame, **names) -> DataFrame:
    """A row per ruled line, drawn as a stroke or as a thin rectangle."""
    return _stage(df, "page int, seq int, vertical boolean, pos double, start double, end double, truncated boolean", lambda p: _each_page(p, lambda i, page, f: [{"seq": k, **r} for k, r in enumerate(f.rules)]), **names)


def images(df: DataFrame, **names) -> DataFrame:
    """A row per image painted, with its place; the same object may be painted several times. Inline images have no object."""
    return _stage(df, "page int, seq int, name string, object int, inline boolean, width int, height int, bits int, color_space string, filters array<string>, mask boolean, soft_mask boolean, x0 double, y0 double, x1 double, y1 double, truncated boolean", lambda p: _each_page(p, lambda i, page, f: f.images), **names)


def paints(df: DataFrame, **names) -> DataFrame:
    """A row per path, string or image painted, in order: a display list. Paths are in the notation of SVG, in points with
    y up; colours are red, green and blue from 0 to 255."""

    def rows(p: Pdf):
        for i, page in enumerate(p.pages):
            try:
                found = content_model.read(p, page, paints=True)
            except ERRORS:
                continue
            yield from ({"page": i, "truncated": found.truncated, **r} for r in found.paints)

    return _stage(df, "page int, seq int, kind string, d string, fill array<int>, stroke array<int>, line_width double, even_odd boolean, text string, font string, size double, matrix array<double>, fill_alpha double, stroke_alpha double, blend string, clips array<string>, truncated boolean", rows, **names)


def lines(df: DataFrame, **names) -> DataFrame:
    def rows(i: int, page: dict, f: content_model.Found):
        return [{k: ln[k] for k in ("line", "text", "y", "size")} for ln in layout.lines(f.spans)]

    return _stage(df, "page int, line int, text string, y double, size double, truncated boolean", lambda p: _each_page(p, rows), **names)


def text(df: DataFrame, structured: bool = False, dehyphenated: bool = True, **names) -> DataFrame:
    """A row per page: its text in reading order, or in the order of the structure tree."""

    def own(p: Pdf):
        tree = p.structure() if structured else []

        def rows(i: int, page: dict, f: content_model.Found):
            found = reading.structured(f.spans, tree, i) if tree else reading.text(f.spans)
            return [{"text": layout.dehyphenate(found) if dehyphenated else found}]

        return _each_page(p, rows)

    return _stage(df, "page int, text string, truncated boolean", own, **names)


def structure(df: DataFrame, **names) -> DataFrame:
    """A row per element of the structure tree, parents first; mcids are its own content."""

    def rows(p: Pdf):
        for e in p.structure():
            yield {**{k: v for k, v in e.items() if k != "kids"}, "mcids": [k[2] for k in e["kids"] if k[0] == "content"]}

    return _stage(df, "node int, parent int, depth int, role string, alt string, actual_text string, page int, mcids array<int>, truncated boolean", rows, **names)


def search(df: DataFrame, query: str, ignore_case: bool = True, pages: list[int] | None = None, **names) -> DataFrame:
    """A row per hit, with its line's text; of all pages or of those named."""
    return _stage(df, "page int, line int, start int, length int, x0 double, y0 double, x1 double, y1 double, line_text string, truncated boolean", lambda p: hits(p, query, ignore_case, pages), **names)


def hits(p: Pdf, query: str, ignore_case: bool = True, pages: list[int] | None = None) -> Iterator[dict]:
    """The rows of search() for one open file."""

    def rows(i: int, page: dict, f: content_model.Found):
        if pages is not None and i not in pages:
            return
        own = layout.lines(f.spans)
        for h in layout.search(own, query, ignore_case):
            x0, y0, x1, y1 = h["rect"] or (None,) * 4
            yield {"line": h["line"], "start": h["start"], "length": h["length"], "x0": x0, "y0": y0, "x1": x1, "y1": y1, "line_text": own[h["line"]]["text"].strip()}

    return _each_page(p, rows)


def tables(df: DataFrame, **names) -> DataFrame:
    def rows(i: int, page: dict, f: content_model.Found):
        for k, t in enumerate(layout.tables(f.spans, f.rules)):
            yield {"table": k, "cells": t["cells"], "col_x": t["col_x"], "row_y": t["row_y"], "truncated": t["truncated"] or f.truncated}

    return _stage(df, "page int, table int, cells array<array<string>>, col_x array<double>, row_y array<double>, truncated boolean", lambda p: _each_page(p, rows), **names)


def table_cells(found: DataFrame) -> DataFrame:
    """A row per cell of tables()."""
    rows = found.select("doc_id", "page", "table", F.posexplode("cells").alias("row", "own"))
    return rows.select("doc_id", "page", "table", "row", F.posexplode("own").alias("col", "cell"))


def info(df: DataFrame, **names) -> DataFrame:
    def rows(p: Pdf):
        d = p.info()
        yield {"title": d["Title"], "author": d["Author"], "subject": d["Subject"], "keywords": d["Keywords"], "creator": d["Creator"], "producer": d["Producer"], "creation_date": d["CreationDate"], "mod_date": d["ModDate"], "trapped": d["Trapped"]}

    return _stage(df, "title string, author string, subject string, keywords string, creator string, producer string, creation_date string, mod_date string, trapped string", rows, **names)


def outline(df: DataFrame, **names) -> DataFrame:
    return _stage(df, "node int, parent int, ordinal int, depth int, title string, page int, view string, uri string, file string, open boolean, truncated boolean", lambda p: iter(p.outline()), **names)


def annotations(df: DataFrame, **names) -> DataFrame:
    def rows(p: Pdf):
        for i, page in enumerate(p.pages):
            for k, a in enumerate(p.annotations(page)):
                yield {"page": i, "ordinal": k, **a}

    return _stage(df, "page int, ordinal int, subtype string, rect array<double>, contents string, dest_page int, uri string, file string, flags int, appearance boolean, viewable boolean, associated boolean, measure string, geo_points array<double>, epsg int, wkt string", rows, **names)


def form_fields(df: DataFrame, **names) -> DataFrame:
    return _stage(df, "field int, name string, kind string, value array<string>, flags int, display string, multiline boolean, password boolean, comb boolean, options array<string>, max_length int, widgets array<int>, truncated boolean", lambda p: iter(p.fields()), **names)


def attachments(df: DataFrame, **names) -> DataFrame:
    return _stage(df, "name string, safe_name string, description string, relationship string, mime string, object int, data binary", lambda p: iter(p.attachments()), **names)


def xmp(df: DataFrame, **names) -> DataFrame:
    return _stage(df, "name string, ordinal int, value string, truncated boolean", lambda p: iter(p.xmp()), **names)


def layers(df: DataFrame, **names) -> DataFrame:
    return _stage(df, "layer int, name string, visible boolean", lambda p: iter(p.layers()), **names)


def signatures(df: DataFrame, **names) -> DataFrame:
    """A row per signed field, with what its byte range covers and whether the digest of these bytes is the one signed."""
    return _stage(df, "field string, sub_filter string, signer string, signed_at string, location string, reason string, contact string, byte_range array<long>, whole_document boolean, bytes_after long, digest_algorithm string, digest string, security_store boolean, certificates int, timestamp boolean", lambda p: iter(p.signatures()), **names)


def objects(df: DataFrame, **names) -> DataFrame:
    """A row per object in use, with its type: a scan to filter by type or to join references with."""
    return _stage(df, "object int, generation int, compressed boolean, kind string, type string, subtype string, raw_bytes long", lambda p: iter(p.objects()), **names)


def stream_data(df: DataFrame, object_col: str, decoded: bool = True, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """(doc_id, object, data, error): the data of the object that each file's row names."""
    ship(df.sparkSession)
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(object_col).cast("int").alias("object"), F.col(content_col).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2):
            found, errors = [], []
            for num, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                out = error = None
                try:
                    p = Pdf(data or b"")
                    s = p.get(Ref(num, 0)) if num is not None else None
                    if isinstance(s, Stream):
                        out = decode_stream(s, p.get) if decoded else s.raw
                    else:
                        error = "no stream"
                except ERRORS as e:
                    error = f"{type(e).__name__}: {e}"[:200]
                found.append(out), errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary()), pa.array(errors, pa.string())], names=["doc_id", "object", "data", "error"])

    return own.mapInArrow(run, "doc_id long, object int, data binary, error string")


def image_pixels(df: DataFrame, **names) -> DataFrame:
    """A row per image object: its size, its red, green and blue bytes from the top, or why there are none (a codec)."""

    def rows(p: Pdf):
        for o in p.objects():
            if o["subtype"] == "Image":
                row = {"object": o["object"], "columns": None, "rows": None, "pixels": None, "image_error": None}
                try:
                    row["columns"], row["rows"], row["pixels"] = raster.pixels(p, p.get(Ref(o["object"], 0)))
                except ERRORS as e:
                    row["image_error"] = f"{type(e).__name__}: {e}"[:200]
                yield row

    return _stage(df, "object int, columns int, rows int, pixels binary, image_error string", rows, **names)


def slides(df: DataFrame, **names) -> DataFrame:
    """A row per file: a presentation of its pages."""
    return _stage(df, "pptx binary", lambda p: iter([{"pptx": raster.to_slides(p)}]), **names)


def output_intents(df: DataFrame, **names) -> DataFrame:
    return _stage(df, "page int, subtype string, identifier string, components int", lambda p: iter(p.output_intents()), **names)


def label_ranges(df: DataFrame, **names) -> DataFrame:
    """A row per range of page labels; relations.labelled_pages() joins them with pages."""
    return _stage(df, "start int, style string, prefix string, first int", lambda p: iter(p.label_ranges()), **names)


def summary(df: DataFrame, **names) -> DataFrame:
    """A row per file that opens: version, counts of what it holds, and its metadata, the information dictionary first."""

    def rows(p: Pdf):
        facts = convert.metadata(p)
        tree = p.structure()
        yield {
            "major": p.version[0], "minor": p.version[1], "pages": len(p.pages), "encrypted": "Encrypt" in p.trailer, "recovered": p.recovered, "tagged": p.tagged, "lang": text_of(p.get(p.root.get("Lang"))),
            "bookmarks": len(p.outline()), "elements": len(tree), "fields": len(p.fields()), "attachments": len(p.attachments()), "layers": len(p.layers()), "signatures": len(p.signatures()), "objects": len(p.objects()),
            "title": facts.get("Title"), "author": facts.get("Author"), "producer": facts.get("Producer"), "claim": "".join(conformance.claimed(p) or ()) or None,
        }

    return _stage(df, "major int, minor int, pages int, encrypted boolean, recovered boolean, tagged boolean, lang string, bookmarks int, elements int, fields int, attachments int, layers int, signatures int, objects int, title string, author string, producer string, claim string", rows, **names)


def converted(df: DataFrame, form: str = "text", structured: bool = False, rich: bool = True, **names) -> DataFrame:
    """A row per file: the whole of it as text, markdown or html."""
    make = {"text": lambda p: convert.to_text(p, structured), "markdown": lambda p: convert.to_markdown(p, structured, rich), "html": lambda p: convert.to_html(p, structured, rich)}[form]
    return _stage(df, "body string", lambda p: iter([{"body": make(p)}]), **names)


def svg(df: DataFrame, **names) -> DataFrame:
    """A row per page: its paths and strings as SVG."""
    return _stage(df, "page int, svg string", lambda p: ({"page": i, "svg": convert.to_svg(p, i)} for i in range(len(p.pages))), **names)


def violations(df: DataFrame, profile: str = "pdfa-2b", **names) -> DataFrame:
    """A row per broken rule of a profile (conformance.PROFILES), with a count; none for a file that conforms."""
    check = conformance.PROFILES.get(profile)
    if check is None:
        raise ValueError(f"no profile {profile}")
    return _stage(df, "rule string, count int", lambda p: iter(check(p)), **names)


def conforming(df: DataFrame, profile: str = "pdfa-2b", id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """(doc_id, conforms): whether a file that opens breaks no rule of the profile; null for one that doesn't open."""
    found = files(df, id_col, content_col).select("doc_id", F.col("open_error").isNull().alias("opens"))
    broken = violations(df, profile, id_col=id_col, content_col=content_col).select("doc_id").distinct().withColumn("broken", F.lit(True))
    return found.join(broken, "doc_id", "left").select("doc_id", F.when(F.col("opens"), F.col("broken").isNull()).alias("conforms"))
