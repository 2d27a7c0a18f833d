"""Queries over the file engine's finer points and the remaining relations, each with its SQL twin."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tf
from ..functions import values
from ..model.objects import Name, Stream
from ..model.writer import Objects
from ..operators import decode, relations
from ..runtime import ship, table, written
from ..sources import corpus

HELVETICA = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}


def _pages(contents: list, resources: dict | None = None, catalog: dict | None = None, before: list | None = None, page: dict | None = None) -> bytes:
    """A file of pages with these contents (bytes or streams) in Helvetica as F0. Objects of ``before`` are numbered from 1."""
    o = Objects()
    for x in before or []:
        o.add(x)
    root, tree, font = o.add(), o.add(), o.add(HELVETICA)
    res = {"Font": {"F0": font}} | (resources or {})
    kids = [o.add({"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, 612, 792], "Resources": res, "Contents": o.add(c if isinstance(c, Stream) else Stream({}, c))} | (page or {})) for c in contents]
    o.set(tree, {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)})
    extra = catalog(kids, o) if callable(catalog) else catalog or {}
    o.set(root, {"Type": Name("Catalog"), "Pages": tree} | extra)
    return o.file(root)


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")


def _lzw(data: bytes) -> bytes:
    """Codes of nine bits, one a byte, with a clear code often enough that they never get longer."""
    codes = []
    for i, c in enumerate(data):
        codes += [256] * (i % 200 == 0) + [c]
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def filter_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same text behind each filter, behind two, and behind two predictors."""

    def write(r: dict) -> bytes:
        body = b"BT /F0 10 Tf 72 700 Td (" + r["n_name"].encode() + b") Tj ET"
        body += b" " * (-len(body) % 8)
        rows = [body[k : k + 8] for k in range(0, len(body), 8)]
        up = b"".join(b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above)) for row, above in zip(rows, [bytes(8), *rows]))
        tiff = b"".join(bytes((row[k] - (row[k - 1] if k else 0)) & 255 for k in range(8)) for row in rows)
        a85 = re.sub(rb"(.{40})", rb"\1\n", __import__("base64").a85encode(zlib.compress(body))) + b"~>"
        runs = b"".join(bytes([len(x) - 1]) + x for x in (body[k : k + 100] for k in range(0, len(body), 100))) + b"\x80"
        of = lambda raw, *names, **parms: Stream({"Filter": [Name(n) for n in names]} | ({"DecodeParms": [None] * (len(names) - 1) + [parms]} if parms else {}), raw)
        return _pages([of(zlib.compress(body), "FlateDecode"), of(body.hex().encode() + b">", "ASCIIHexDecode"), of(a85, "ASCII85Decode", "FlateDecode"), of(runs, "RunLengthDecode"), of(_lzw(body), "LZWDecode"), of(zlib.compress(up), "FlateDecode", Predictor=12, Columns=8), of(zlib.compress(tiff), "FlateDecode", Predictor=2, Columns=8)])

    return decode.lines(corpus.crafted(_nations(spark, sf_dir), "n_nationkey", write)).select(F.col("doc_id").alias("n_nationkey"), "page", "text")


def text_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where strings land: spacing, scaling, leading, rise, adjustments in arrays, line operators, an invisible string."""
    body = b"""q 2 0 0 2 10 20 cm BT /F0 10 Tf 14 TL 1 Tc 5 Tw 50 Tz 100 300 Td (ab c) Tj (d) Tj T* 3 Ts (e) Tj 0 Ts (f) '
        2 1 (g h) " 0 Tc 0 Tw 100 Tz 0 -20 TD [(A) -1000 (B) 500 (C)] TJ 3 Tr (unseen) Tj ET Q BT (after) Tj ET"""
    found = decode.spans(corpus.crafted(_nations(spark, sf_dir), "n_nationkey", lambda r: _pages([body])))
    return found.select(F.col("doc_id").alias("n_nationkey"), "seq", "text", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("size", 3).alias("size"))


def hidden_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text in layers: off, on, memberships by policy, and by an expression."""

    def write(r: dict) -> bytes:
        body = b"BT /F0 10 Tf 72 700 Td " + b" ".join(b"/OC /P%d BDC 0 -20 Td (%d) Tj EMC" % (k, k) for k in range(5)) + b" 0 -20 Td (plain) Tj ET"
        o = Objects()
        on, off = o.add({"Type": Name("OCG"), "Name": "on"}), o.add({"Type": Name("OCG"), "Name": "off"})
        props = {
            "P0": on, "P1": off, "P2": o.add({"Type": Name("OCMD"), "OCGs": [on, off], "P": Name("AllOn")}), "P3": o.add({"Type": Name("OCMD"), "OCGs": [on, off], "P": Name("AnyOn")}),
            "P4": o.add({"Type": Name("OCMD"), "VE": [Name("And"), on, [Name("Not"), off]]}),
        }
        return _pages([body], {"Properties": props}, {"OCProperties": {"OCGs": [on, off], "D": {"OFF": [off]}}}, o.all)

    return decode.spans(corpus.crafted(_nations(spark, sf_dir), "n_nationkey", write)).select(F.col("doc_id").alias("n_nationkey"), "seq", "text")


def destination_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks to views: explicit, by a name of the tree, by an old name, an unknown name, a file."""

    def catalog(kids, o):
        top = o.add()
        items = [o.add() for _ in range(6)]
        targets = [{"Dest": [kids[1], Name("XYZ"), 0, 792, 0]}, {"Dest": b"sec"}, {"Dest": Name("old")}, {"Dest": b"none"}, {"A": {"S": Name("GoTo"), "D": [kids[0], Name("FitR"), 1, 2, 3, 4]}}, {"A": {"S": Name("GoToR"), "F": b"other.pdf"}}]
        for k, (ref, t) in enumerate(zip(items, targets)):
            o.set(ref, {"Title": f"b{k}", "Parent": top} | t | ({"Next": items[k + 1]} if k < 5 else {}))
        o.set(top, {"Type": Name("Outlines"), "First": items[0], "Last": items[5]})
        return {"Outlines": top, "Names": {"Dests": {"Kids": [{"Names": [b"sec", {"D": [kids[2], Name("FitH"), 700]}]}]}}, "Dests": {"old": [kids[2], Name("Fit")]}}

    found = decode.outline(corpus.crafted(_nations(spark, sf_dir), "n_nationkey", lambda r: _pages([b""] * 3, catalog=catalog)))
    return found.select(F.col("doc_id").alias("n_nationkey"), "title", "page", "view", "file")


def rtl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings drawn from left to right come back in the order they are read."""
    made = corpus.make(_nations(spark, sf_dir), "n_nationkey", lambda r: {"pages": [[("םולש", 72.0, 700.0, 10.0), (f"{r['n_name']} םלוע בוט end", 72.0, 680.0, 10.0)]]})
    return decode.text(made).select(F.col("doc_id").alias("n_nationkey"), F.col("text").alias("page_text"), tf.is_rtl(F.col("text")).alias("rtl"))


def viewable_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which annotations a reader sees: flags, appearances by state, popups, no area."""

    def catalog(kids, o):
        look = o.add(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 9, 9]}, b""))
        notes = [
            {"Subtype": Name("Square"), "AP": {"N": look}}, {"Subtype": Name("Square"), "AP": {"N": look}, "F": 2}, {"Subtype": Name("Square"), "AP": {"N": look}, "F": 32}, {"Subtype": Name("Popup"), "AP": {"N": look}},
            {"Subtype": Name("Square")}, {"Subtype": Name("Widget"), "AP": {"N": {"On": look}}, "AS": Name("On")}, {"Subtype": Name("Widget"), "AP": {"N": {"On": look}}, "AS": Name("Off")}, {"Subtype": Name("Square"), "AP": {"N": look}, "Rect": [5, 5, 5, 9]},
        ]
        o.all[kids[0].num - 1]["Annots"] = [{"Type": Name("Annot"), "Rect": [0, 0, 9, 9], "Contents": "note"} | n for n in notes]
        return {}

    found = decode.annotations(corpus.crafted(_nations(spark, sf_dir), "n_nationkey", lambda r: _pages([b""], catalog=catalog)))
    return found.select(F.col("doc_id").alias("n_nationkey"), "ordinal", "subtype", "appearance", "viewable")


def strong_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files encrypted by AES-256, opened by the owner's password."""
    made = corpus.make(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_regionkey", lambda r: {"pages": [[(r["r_name"], 72.0, 700.0, 10.0)]]})
    sealed = corpus.encrypted(made, "user", "owner")
    return decode.lines(sealed, password="owner").select(F.col("doc_id").alias("r_regionkey"), "text")


def slide_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presentations made of files, read again as archives of XML."""
    made = corpus.make(_nations(spark, sf_dir), "n_nationkey", lambda r: {"pages": [[(r["n_name"] + " & <more>", 72.0, 700.0, 10.0)], [("second", 72.0, 700.0, 10.0)]], "graphics": {0: b"10 10 20 30 re f"}})
    pptx = decode.slides(made)
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, data in zip(*(c.to_pylist() for c in b.columns)):
                z = zipfile.ZipFile(io.BytesIO(data))
                for k, name in enumerate(sorted(n for n in z.namelist() if re.match(r"ppt/slides/slide\d+\.xml", n))):
                    xml = z.read(name).decode()
                    out.append({"n_nationkey": i, "slide": k, "text": "|".join(re.findall("<a:t>(.*?)</a:t>", xml)), "shapes": xml.count("<p:sp>")})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("n_nationkey", pa.int64()), ("slide", pa.int32()), ("text", pa.string()), ("shapes", pa.int32())]))

    return pptx.mapInArrow(run, "n_nationkey long, slide int, text string, shapes int")


def _photo(r: dict, twist: int = 0) -> dict:
    k = r["n_nationkey"]
    pixels = bytes((k * 7 + 11 * i + twist * (i % 2)) % 256 for i in range(4 * 3 * 3))
    return {"pages": [[], []], "images": [{"page": p, "x": 10, "y": 20 + 50 * p, "width": 40, "height": 30, "columns": 4, "rows": 3, "channels": 3, "pixels": pixels} for p in (0, 1)]}


def decoded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of image objects."""
    found = decode.image_pixels(corpus.make(_nations(spark, sf_dir), "n_nationkey", _photo))
    return found.groupBy(F.col("doc_id").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("objects"), F.min("columns").alias("columns"), F.min("rows").alias("rows"), F.hex(F.min(F.substring("pixels", 1, 3))).alias("first"), F.max("image_error").alias("image_error"))


def placed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each image object is painted."""
    found = relations.image_placements(decode.images(corpus.make(_nations(spark, sf_dir), "n_nationkey", _photo)))
    return found.select(F.col("doc_id").alias("n_nationkey"), "placements", "ordinal")


def differing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of two versions of a file, compared."""
    left, right = (decode.image_pixels(corpus.make(_nations(spark, sf_dir), "n_nationkey", lambda r, t=t: _photo(r, t))).select("doc_id", F.col("object").alias("row"), "pixels") for t in (0, 1))
    found = relations.compare_images(left, right, ["doc_id"])
    return found.select(F.col("doc_id").alias("n_nationkey"), "size_equal", "differ", F.round("share", 6).alias("share"))


def widget_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widgets of pages joined with the fields that they present."""

    def catalog(kids, o):
        own = o.add({"Type": Name("Annot"), "Subtype": Name("Widget"), "Rect": [0, 0, 9, 9], "FT": Name("Tx"), "T": "one", "V": "x"})
        parent = o.add()
        both = [o.add({"Type": Name("Annot"), "Subtype": Name("Widget"), "Rect": [0, 0, 9, 9], "Parent": parent}) for _ in range(2)]
        o.set(parent, {"FT": Name("Btn"), "T": "two", "Kids": both})
        return {"AcroForm": {"Fields": [own, parent]}}

    made = written(corpus.crafted(_nations(spark, sf_dir), "n_nationkey", lambda r: _pages([b""], catalog=catalog)), "widgets")
    widgets = decode.objects(made).where("subtype = 'Widget'").select("doc_id", "object")
    return relations.widget_fields(widgets, decode.form_fields(made)).groupBy(F.col("doc_id").alias("n_nationkey"), "name").agg(F.count(F.lit(1)).alias("widgets"))


def resolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References joined with the objects they name; null where there is none."""
    made = written(corpus.make(_nations(spark, sf_dir), "n_nationkey", lambda r: {"pages": [[]]}), "referred")
    refs = made.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(99))).alias("ref"))
    return relations.resolved(refs, decode.objects(made), "ref").select(F.col("doc_id").alias("n_nationkey"), "ref", "object_kind")


def merged_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of two lists for the same embedded objects, merged."""
    n = _nations(spark, sf_dir).select(F.lit(0).cast("long").alias("doc_id"), F.col("n_nationkey").alias("object"), "n_name")
    tree = n.where("object % 3 <> 0").select("doc_id", "object", F.col("n_name").alias("name"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("relationship"))
    af = n.where("object % 2 = 0").select("doc_id", "object", F.lit("other").alias("name"), F.col("n_name").alias("description"), F.lit("Data").alias("relationship"))
    return relations.merged_attachments(tree, af).select("object", "name", "description", "relationship")


def structure_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables outside tables, and headings that leave levels out, by joins and windows over the structure."""
    roles = ("H1", "TR", "H3", "H2", "H4")
    made = written(corpus.make(_nations(spark, sf_dir), "n_nationkey", lambda r: {"pages": [[(x, 72.0, 700.0 - 20 * k, 10.0) for k, x in enumerate(roles)]], "tags": [{"role": x, "page": 0, "spans": [k]} for k, x in enumerate(roles[: 2 + r["n_nationkey"] % 4])]}), "faulty")
    s = written(decode.structure(made), "structure")
    rows = relations.misplaced_rows(s).select(F.col("doc_id").alias("n_nationkey"), F.lit("row").alias("fault"), "node")
    return rows.union(relations.heading_jumps(s).select("doc_id", F.lit("heading"), "node"))


def ruled_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertical rules that cover at least half of a band of lines."""
    body = b"1 w 200 690 m 200 590 l S 300 690 m 300 670 l S 0 600 m 500 600 l S 4 w 400 690 m 400 590 l S 450 590 1.5 100 re f 100 100 m 104 100 l S"
    made = written(corpus.make(_nations(spark, sf_dir), "n_nationkey", lambda r: {"pages": [[("x", 72.0, 680.0 - 14 * k, 10.0) for k in range(6)]], "graphics": {0: body}}), "ruled")
    b = relations.bands(decode.lines(made)).groupBy("doc_id", "page", "band").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    return relations.rules_in_bands(decode.rules(made), b).select(F.col("doc_id").alias("n_nationkey"), "band", F.round("pos", 3).alias("pos"))


def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list(F.col("c_custkey").cast("double") - 40).alias("v"))  # a nation's customers
    return c.select("c_nationkey", tf.upper_median(F.col("v")).alias("median"))


def permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of pages: which are permutations, and which pages a choice leaves."""
    n = _nations(spark, sf_dir)
    order = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.pmod(k * F.col("n_nationkey"), F.lit(5)).cast("int"))
    return n.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), relations.is_permutation(order, F.lit(5)).alias("sound"))


def kept_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = corpus.make(_nations(spark, sf_dir), "n_nationkey", lambda r: {"pages": [[]] * 5})
    return relations.chosen_pages(decode.pages(made), [1, 3], keep=False).select(F.col("doc_id").alias("n_nationkey"), "page")


def page_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the lower left corner of a page lands once it is turned."""
    made = corpus.crafted(_nations(spark, sf_dir), "n_nationkey", lambda r: _pages([b""], page={"Rotate": 90 * (r["n_nationkey"] % 4), "CropBox": [10, 20, 700, 300]}))
    box = F.array("x0", "y0", "x1", "y1")
    p = decode.pages(made).withColumn("at", values.transform(values.page_matrix(box, F.col("rotate")), F.col("x0"), F.col("y0")))
    return p.select(F.col("doc_id").alias("n_nationkey"), "rotate", "x1", F.col("at")[0].alias("x"), F.col("at")[1].alias("y"))


def painted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A display list: paths with colours of three spaces, a dash of alpha, a clip, and curves."""
    body = b"q 0 1 0 RG 3 w 10 10 m 20 10 l S Q 0.2 g 5 5 10 10 re f q 0 0 50 50 re W n /G gs 0 0 0 1 k 1 2 m 3 4 5 6 7 8 c 9 9 9 0 v b* Q"
    made = corpus.crafted(_nations(spark, sf_dir), "n_nationkey", lambda r: _pages([body], {"ExtGState": {"G": {"ca": 0.5, "BM": Name("Multiply")}}}))
    p = decode.paints(made)
    colour = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return p.select(F.col("doc_id").alias("n_nationkey"), "seq", "d", colour(F.col("fill")).alias("fill"), colour(F.col("stroke")).alias("stroke"), "line_width", "fill_alpha", "blend", F.size("clips").alias("clips"))


QUERIES = {f.__name__: f for f in (
    filter_chains, text_operators, hidden_layers, destination_views, rtl_lines, viewable_notes, strong_files, slide_texts, decoded_images, placed_images, differing_images, widget_fields, resolved_references,
    merged_attachments, structure_faults, ruled_bands, upper_medians, permutations, kept_pages, page_matrices, painted_paths,
)}

_KEY = "n_nationkey::bigint as n_nationkey"
ORACLE = {
    "filter_chains": f"select {_KEY}, unnest(range(7))::int as page, n_name as text from nation",
    # Widths of Helvetica: a b d e f g h 556 (f 278), c 500, space 278, A B 667, C 722; doubled and moved by the matrix.
    "text_operators": f"""select {_KEY}, unnest(range(10))::int as seq, unnest(['ab c', 'd', 'e', 'f', 'g h', 'A', 'B', 'C', 'unseen', 'after']) as text,
        unnest([210, 210 + (18.9 + 4 + 5), 210, 210, 210, 210, 210 + 33.34, 210 + 36.68, 210 + 51.12, 0])::double as x, unnest([620, 620, 598, 564, 536, 496, 496, 496, 496, 0])::double as y,
        unnest([20, 20, 20, 20, 20, 20, 20, 20, 20, 0])::double as size from nation""",
    "hidden_layers": f"select {_KEY}, unnest(range(4))::int as seq, unnest(['0', '3', '4', 'plain']) as text from nation",
    "destination_views": f"""select {_KEY}, unnest(['b0', 'b1', 'b2', 'b3', 'b4', 'b5']) as title, unnest([1, 2, 2, null, 0, null])::int as page,
        unnest(['XYZ 0 792 null', 'FitH 700', 'Fit', null, 'FitR 1 2 3 4', null]) as view, unnest([null, null, null, null, null, 'other.pdf']) as file from nation""",
    "rtl_lines": f"select {_KEY}, 'שלום' || chr(10) || n_name || ' טוב עולם end' as page_text, true as rtl from nation",
    "viewable_notes": f"""select {_KEY}, unnest(range(8))::int as ordinal, unnest(['Square', 'Square', 'Square', 'Popup', 'Square', 'Widget', 'Widget', 'Square']) as subtype,
        unnest([true, true, true, true, false, true, false, true]) as appearance, unnest([true, false, false, false, false, true, false, false]) as viewable from nation""",
    "strong_files": "select r_regionkey::bigint as r_regionkey, r_name as text from region",
    "slide_texts": f"select {_KEY}, unnest([0, 1])::int as slide, unnest([n_name || ' &amp; &lt;more&gt;', 'second']) as text, unnest([2, 1])::int as shapes from nation",
    "decoded_images": f"""select {_KEY}, 2::bigint as objects, 4::int as columns, 3::int as rows, upper(printf('%02x%02x%02x', (n_nationkey * 7 % 256)::int, ((n_nationkey * 7 + 11) % 256)::int, ((n_nationkey * 7 + 22) % 256)::int)) as first, null::varchar as image_error from nation""",
    "placed_images": f"select {_KEY}, 1::bigint as placements, unnest([0, 1])::int as ordinal from nation",
    "differing_images": f"select {_KEY}, true as size_equal, 36::bigint as differ, 0.5::double as share from nation",
    "widget_fields": f"select {_KEY}, unnest(['one', 'two']) as name, unnest([1, 2])::bigint as widgets from nation",
    "resolved_references": f"select {_KEY}, unnest([1, 2, 99])::int as ref, unnest(['dictionary', 'dictionary', 'null']) as object_kind from nation",
    "merged_attachments": """select n_nationkey as object, case when n_nationkey % 3 <> 0 then n_name else 'other' end as name, case when n_nationkey % 2 = 0 then n_name end as description, case when n_nationkey % 2 = 0 then 'Data' end as relationship
        from nation where n_nationkey % 3 <> 0 or n_nationkey % 2 = 0""",
    "structure_faults": f"""select {_KEY}, 'row' as fault, 1::int as node from nation union all select {_KEY}, 'heading', 2 from nation where n_nationkey % 4 >= 1 union all select {_KEY}, 'heading', 4 from nation where n_nationkey % 4 = 3""",
    "ruled_bands": f"select {_KEY}, 0::int as band, unnest([200.0, 450.75])::double as pos from nation",
    "upper_medians": """with c as (select c_nationkey, c_custkey - 40 as v from customer), r as (select c_nationkey, v, row_number() over (partition by c_nationkey order by v) - 1 as k, count(*) over (partition by c_nationkey) as n from c where v > 0)
        select a.c_nationkey, coalesce(max(r.v), 12)::double as median from (select distinct c_nationkey from customer) a left join r on a.c_nationkey = r.c_nationkey and r.k = r.n // 2 group by a.c_nationkey""",
    "permutations": f"select {_KEY}, n_nationkey % 5 <> 0 as sound from nation",
    "kept_pages": f"select {_KEY}, unnest([0, 2, 4])::int as page from nation",
    "page_matrices": f"""select {_KEY}, (90 * (n_nationkey % 4))::int as rotate, 612.0::double as x1, case n_nationkey % 4 when 0 then 0 when 1 then 0 when 2 then 602 else 280 end::double as x,
        case n_nationkey % 4 when 0 then 0 when 1 then 602 when 2 then 280 else 0 end::double as y from nation""",
    "painted_paths": f"""select {_KEY}, unnest([0, 1, 2])::int as seq, unnest(['M10 10 L20 10', 'M5 5 L15 5 L15 15 L5 15 Z', 'M1 2 C3 4 5 6 7 8 C7 8 9 9 9 0 Z']) as d, unnest([null, '51,51,51', '44,46,53']) as fill,
        unnest(['0,255,0', null, '0,0,0']) as stroke, unnest([3.0, 1.0, 1.0])::double as line_width, unnest([1.0, 1.0, 0.5])::double as fill_alpha, unnest(['Normal', 'Normal', 'Multiply']) as blend, unnest([0, 0, 1])::int as clips from nation""",
}
