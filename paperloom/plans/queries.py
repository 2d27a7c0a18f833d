"""The engine's queries over PDF files made from the test tables, each with SQL that gives the same rows from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tf
from ..model import edit
from ..model.document import Pdf
from ..operators import decode
from ..runtime import table, written
from ..sources import corpus
from ..streaming.ingest import sessions

LINES_SQL = """(select doc_id, (n - 1) // 50 as page, (n - 1) % 50 as pos, line
    from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n from documents) where trim(line) <> '')"""
PAGES_SQL = "ceil(len(string_split(coalesce(text, ''), chr(10))) / 50)"
QUERY = "ththe"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.text_files(table(spark, sf_dir, "documents"))


def extract_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.lines(_files(spark, sf_dir)).select("doc_id", "page", "line", F.col("text").alias("line_text"))


def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.files(_files(spark, sf_dir)).select("doc_id", "page_count", "recovered")


def search_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decode.search(_files(spark, sf_dir), QUERY)
    return hits.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("hits"), F.min("line").alias("first_line"))


def span_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = decode.spans(_files(spark, sf_dir))
    top, bottom = F.max(F.col("y") + 0.8 * F.col("size")), F.min(F.col("y") - 0.2 * F.col("size"))
    return s.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("spans"), F.round(F.min("x"), 3).alias("x0"), F.round(bottom, 3).alias("y0"), F.round(top, 3).alias("y1"))


def recovered_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose cross-reference table is cut off still give their text."""
    cut = written(_files(spark, sf_dir).withColumn("content", F.substring("content", F.lit(1), F.octet_length("content") - 60)), "cut-files")  # made once, read twice
    got = decode.lines(cut).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))
    return decode.files(cut).select("doc_id", "recovered").join(got, "doc_id", "left").select("doc_id", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("chars", F.lit(0)).alias("chars"), "recovered")


def _nation_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").withColumn("at", F.row_number().over(Window.orderBy("n_nationkey")))  # 25 rows
    one = rows.groupBy().agg(F.sort_array(F.collect_list(F.struct("at", "n_nationkey", "n_name", "n_regionkey"))).alias("rows")).select(F.lit(0).cast("long").alias("doc_id"), "rows")

    def grid(r: dict) -> dict:
        return {"pages": [[(str(v), x, 740.0 - 14 * i, 10.0) for i, n in enumerate(r["rows"]) for v, x in ((n["n_nationkey"], 50.0), (n["n_name"], 150.0), (n["n_regionkey"], 350.0))]]}

    return corpus.make(one, "doc_id", grid)


def detect_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.table_cells(decode.tables(_nation_file(spark, sf_dir))).select("row", "col", "cell")


def table_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = decode.tables(_nation_file(spark, sf_dir))
    return t.select(tf.csv(F.col("cells")).alias("csv"), tf.tsv(F.col("cells")).alias("tsv"))


def document_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    made = corpus.make(c, "c_custkey", lambda r: {"pages": [[]], "info": {"Title": r["c_name"], "Subject": r["c_mktsegment"]}})
    return decode.info(made).select(F.col("doc_id").alias("c_custkey"), "title", "subject", "author")


def outline_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    r = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))

    def marks(x: dict) -> dict:
        own = [{"title": x["r_name"], "page": 0, "parent": None}] + [{"title": y["n_name"], "page": i + 1, "parent": 0} for i, y in enumerate(x["nations"])]
        return {"pages": [[]] * len(own), "outline": own}

    found = decode.outline(corpus.make(r.select("r_regionkey", "r_name", "nations"), "r_regionkey", marks))
    return found.select(F.col("doc_id").alias("r_regionkey"), "node", "parent", "ordinal", "depth", "title", "page")


def links_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    made = corpus.make(s, "s_suppkey", lambda r: {"pages": [[]] * 25, "links": [{"page": 0, "rect": (10, 10, 50, 20), "dest_page": r["s_nationkey"]}, {"page": 1, "rect": (10, 30, 50, 40), "uri": f"https://example.org/{r['s_nationkey']}"}]})
    found = decode.annotations(made).where("subtype = 'Link'")
    return found.groupBy(F.coalesce(F.col("dest_page").cast("string"), "uri").alias("target")).agg(F.count(F.lit(1)).alias("links"))


def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    made = corpus.make(o, "o_orderkey", lambda r: {"pages": [[]], "fields": [{"name": "status", "value": r["o_orderstatus"]}, {"name": "priority", "value": r["o_orderpriority"]}]})
    return decode.form_fields(made).select(F.col("doc_id").alias("o_orderkey"), "name", "kind", F.element_at("value", 1).alias("value"))


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    made = corpus.make(c, "c_custkey", lambda r: {"pages": [[]], "files": [{"name": f"{r['c_name']}.txt", "data": r["c_name"].encode(), "description": "a name"}]})
    return decode.attachments(made).select(F.col("doc_id").alias("c_custkey"), "name", "description", F.decode("data", "UTF-8").alias("body"))


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select("r_regionkey")
    ranges = [{"start": 0, "style": "r"}, {"start": 3, "style": "D", "prefix": "p-", "first": 5}, {"start": 6, "style": "A"}]
    made = corpus.make(r, "r_regionkey", lambda x: {"pages": [[]] * 8, "labels": ranges})
    return decode.pages(made).select(F.col("doc_id").alias("r_regionkey"), "page", "label")


def merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files merged by eights, in the order of their ids, and read again."""
    found = decode.lines(corpus.merged(_files(spark, sf_dir), F.floor(F.col("doc_id") / 8)))
    return found.groupBy("doc_id").agg((F.max("page") + 1).cast("long").alias("last_page"), F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


def reverse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode.lines(corpus.rearranged(_files(spark, sf_dir), lambda n: list(range(n))[::-1]))
    return found.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("lines"))


def line_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of lines: a drop of over 2.2 times the size begins a new one."""
    w = Window.partitionBy("doc_id", "page").orderBy("line")
    s = decode.lines(_files(spark, sf_dir)).withColumn("new", (F.coalesce(F.lag("y").over(w) - F.col("y"), F.lit(0.0)) > 2.2 * F.col("size")).cast("int"))
    return s.groupBy("doc_id", "page").agg((F.sum("new") + 1).alias("bands"), F.count(F.lit(1)).alias("lines"))


def dehyphenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words broken after their fourth letter come together again."""
    d = table(spark, sf_dir, "documents")
    broken = F.regexp_replace("text", r"\b([a-z]{4})([a-z]{3,})\b", "$1-\n$2")
    return d.select("doc_id", F.md5(tf.dehyphenate(broken).cast("binary")).alias("text_md5"))


def sessionize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"))


def _columns(d: DataFrame) -> DataFrame:
    """A file per customer: a title over two columns of three lines, drawn row by row and tagged from right to left."""

    def describe(r: dict) -> dict:
        left, right = ([f"{r['c_name']} {side} {k}" for k in range(3)] for side in ("left", "right"))
        cells = [(t, x, 700.0 - 14 * k, 10.0) for k in range(3) for t, x in ((left[k], 40.0), (right[k], 320.0))]
        return {"pages": [[(r["c_mktsegment"], 40.0, 760.0, 10.0), *cells]], "tags": [{"role": "P", "page": 0, "spans": [2, 4, 6]}, {"role": "P", "page": 0, "spans": [1, 3, 5]}]}

    return corpus.make(d.select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", describe)


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.text(_columns(table(spark, sf_dir, "customer"))).select(F.col("doc_id").alias("c_custkey"), "page", F.col("text").alias("page_text"))


def structure_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.text(_columns(table(spark, sf_dir, "customer")), structured=True).select(F.col("doc_id").alias("c_custkey"), "page", F.col("text").alias("page_text"))


def structure_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.structure(_columns(table(spark, sf_dir, "customer"))).select(F.col("doc_id").alias("c_custkey"), "node", "role", F.element_at("mcids", 1).alias("mcid"))


def encrypted_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files encrypted by a password (RC4), opened with it again."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    sealed = corpus.encrypted(corpus.make(s, "s_suppkey", lambda r: {"pages": [[]], "info": {"Title": r["s_name"]}}), "secret", aes=False)
    return decode.info(sealed, password="secret").select(F.col("doc_id").alias("s_suppkey"), "title")


def filled_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank form per supplier, filled from its row by an appended update and read again."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    blank = corpus.make(s, "s_suppkey", lambda r: {"pages": [[]], "fields": [{"name": "name", "value": ""}, {"name": "kept", "value": "as is"}]})
    done = corpus.edited(blank.join(s, F.col("doc_id") == F.col("s_suppkey")), lambda c, r: edit.fill(c, {"name": r["s_name"]}))
    return decode.form_fields(done).select(F.col("doc_id").alias("s_suppkey"), "name", F.element_at("value", 1).alias("value"))


def annotated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit of the search gets a highlight in its file; the highlights of each page are counted after.

    A file is searched and marked where it is, so no file goes through storage or a join; those without hits aren't read again."""

    def mark(content: bytes, row: dict) -> bytes | None:
        found = [{"page": h["page"], "subtype": "Highlight", "rect": tuple(h[k] for k in ("x0", "y0", "x1", "y1"))} for h in decode.hits(Pdf(content), QUERY) if h["x0"] is not None]
        return edit.annotate(content, found) if found else None

    marked = corpus.edited(_files(spark, sf_dir), mark).where("content is not null")
    return decode.annotations(marked).where("subtype = 'Highlight'").groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("highlights"))


def xmp_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    def describe(r: dict) -> dict:
        packet = f"<x:xmpmeta><rdf:RDF><rdf:Description pdf:Producer='loom'><dc:title><rdf:Alt><rdf:li xml:lang='x-default'>{r['p_name']} &amp; more</rdf:li></rdf:Alt></dc:title></rdf:Description></rdf:RDF></x:xmpmeta>"
        return {"pages": [[]], "xmp": packet}

    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return decode.xmp(corpus.make(p, "p_partkey", describe)).select(F.col("doc_id").alias("p_partkey"), "name", "ordinal", "value")


def layer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    made = corpus.make(n, "n_nationkey", lambda r: {"pages": [[]], "layers": [{"name": r["n_name"], "visible": r["n_regionkey"] > 1}, {"name": "base", "visible": True}]})
    return decode.layers(made).select(F.col("doc_id").alias("n_nationkey"), "layer", "name", "visible")


def archive_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of PDF/A-1b that files of suppliers break; those of even keys have metadata, those of keys divisible by 3 an attachment."""

    def describe(r: dict) -> dict:
        k = r["s_suppkey"]
        claim = "<rdf:Description pdfaid:part='1' pdfaid:conformance='B'/>" if k % 2 == 0 else None
        return {"pages": [[]], "xmp": claim, "files": [{"name": "a.txt", "data": b"a"}] if k % 3 == 0 else None}

    found = decode.violations(corpus.make(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", describe), "pdfa-1b")
    return found.select(F.col("doc_id").alias("s_suppkey"), "rule", F.col("count").alias("n"))


QUERIES = {f.__name__: f for f in (
    extract_text_lines, page_count, search_count, span_boxes, recovered_text, detect_table_cells, table_csv, document_info, outline_flatten, links_by_target,
    form_fields, attachments, page_labels, merge_pages, reverse_pages, line_gaps, dehyphenated, sessionize_events, reading_order,
    structure_order, structure_roles, encrypted_info, filled_forms, annotated_hits, xmp_properties, layer_states, archive_violations,
)}

ORACLE = {
    "extract_text_lines": f"select doc_id, page::int as page, (row_number() over (partition by doc_id, page order by pos) - 1)::int as line, line as line_text from {LINES_SQL}",
    "page_count": f"select doc_id, {PAGES_SQL}::int as page_count, false as recovered from documents",
    "search_count": f"""select doc_id, page::int as page, sum((length(lower(line)) - length(replace(lower(line), '{QUERY}', ''))) // {len(QUERY)})::bigint as hits, min(n)::int as first_line
        from (select *, row_number() over (partition by doc_id, page order by pos) - 1 as n from {LINES_SQL}) where contains(lower(line), '{QUERY}') group by all""",
    "span_boxes": f"select doc_id, page::int as page, count(*) as spans, 40.0::double as x0, round(760 - 14 * max(pos) - 2, 3)::double as y0, round(760 - 14 * min(pos) + 8, 3)::double as y1 from {LINES_SQL} group by all",
    "recovered_text": f"select d.doc_id, count(l.line) as lines, coalesce(sum(length(l.line)), 0)::bigint as chars, true as recovered from documents d left join {LINES_SQL} l using (doc_id) group by d.doc_id",
    "detect_table_cells": """select (row_number() over (order by n_nationkey) - 1)::int as row, unnest([0, 1, 2])::int as col, unnest([n_nationkey::varchar, n_name, n_regionkey::varchar]) as cell from nation""",
    "table_csv": """select string_agg(n_nationkey || ',' || n_name || ',' || n_regionkey, chr(13) || chr(10) order by n_nationkey) as csv,
        string_agg(n_nationkey || chr(9) || n_name || chr(9) || n_regionkey, chr(10) order by n_nationkey) as tsv from nation""",
    "document_info": "select c_custkey, c_name as title, c_mktsegment as subject, null::varchar as author from customer",
    "outline_flatten": """select r_regionkey::bigint as r_regionkey, 0::int as node, null::int as parent, 0::int as ordinal, 0::int as depth, r_name as title, 0::int as page from region
        where r_regionkey in (select n_regionkey from nation)
        union all select n_regionkey::bigint, k::int, 0::int, (k - 1)::int, 1::int, n_name, k::int from (select *, row_number() over (partition by n_regionkey order by n_nationkey) as k from nation)""",
    "links_by_target": "select target, count(*) as links from (select unnest([s_nationkey::varchar, 'https://example.org/' || s_nationkey]) as target from supplier) group by target",
    "form_fields": "select o_orderkey, unnest(['status', 'priority']) as name, 'Tx' as kind, unnest([o_orderstatus, o_orderpriority]) as value from orders",
    "attachments": "select c_custkey, c_name || '.txt' as name, 'a name' as description, c_name as body from customer",
    "page_labels": "select r_regionkey::bigint as r_regionkey, unnest(range(8))::int as page, unnest(['i', 'ii', 'iii', 'p-5', 'p-6', 'p-7', 'A', 'B']) as label from region",
    "merge_pages": f"""with p as (select doc_id, {PAGES_SQL}::bigint as n from documents),
             o as (select doc_id, doc_id // 8 as g, coalesce(sum(n) over (partition by doc_id // 8 order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from p)
        select g as doc_id, (max(before + page) + 1)::bigint as last_page, count(*) as lines, sum(length(line))::bigint as chars from {LINES_SQL} join o using (doc_id) group by g""",
    "reverse_pages": f"""select l.doc_id, (p.n - 1 - page)::int as page, count(*) as lines from {LINES_SQL} l
        join (select doc_id, {PAGES_SQL} as n from documents) p using (doc_id) group by all""",
    "line_gaps": f"""select doc_id, page::int as page, (sum(new) + 1)::bigint as bands, count(*) as lines
        from (select doc_id, page, (coalesce(14 * (pos - lag(pos) over (partition by doc_id, page order by pos)), 0) > 22)::int as new from {LINES_SQL}) group by all""",
    "reading_order": """select c_custkey, 0::int as page, concat_ws(chr(10), c_mktsegment, c_name || ' left 0', c_name || ' left 1', c_name || ' left 2',
        c_name || ' right 0', c_name || ' right 1', c_name || ' right 2') as page_text from customer""",
    "structure_order": """select c_custkey, 0::int as page, concat_ws(chr(10), c_name || ' right 0', c_name || ' right 1', c_name || ' right 2',
        c_name || ' left 0', c_name || ' left 1', c_name || ' left 2', c_mktsegment) as page_text from customer""",
    "structure_roles": "select c_custkey, k::int as node, 'P' as role, k::int as mcid from customer, (select unnest([0, 1]) as k)",
    "filled_forms": "select s_suppkey, unnest(['name', 'kept']) as name, unnest([s_name, 'as is']) as value from supplier",
    "annotated_hits": f"""select doc_id, page::int as page, sum((length(lower(line)) - length(replace(lower(line), '{QUERY}', ''))) // {len(QUERY)})::bigint as highlights
        from {LINES_SQL} where contains(lower(line), '{QUERY}') group by all""",
    "xmp_properties": "select p_partkey, unnest(['pdf:Producer', 'dc:title']) as name, 0::int as ordinal, unnest(['loom', p_name || ' & more']) as value from part",
    "layer_states": "select n_nationkey::bigint as n_nationkey, unnest([0, 1])::int as layer, unnest([n_name, 'base']) as name, unnest([n_regionkey > 1, true]) as visible from nation",
    "archive_violations": """select s_suppkey, rule, 1::int as n from supplier, (select unnest(['file-id', 'header-version', 'output-intent', 'font-not-embedded', 'xmp-missing', 'embedded-files']) as rule)
        where (rule <> 'xmp-missing' or s_suppkey % 2 = 1) and (rule <> 'embedded-files' or s_suppkey % 3 = 0)""",
    "encrypted_info": "select s_suppkey, s_name as title from supplier",
    "dehyphenated": "select doc_id, md5(text) as text_md5 from documents",
    "sessionize_events": """with e as (select user_id, ts, (coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 30 minutes, true))::int as new from events),
             s as (select user_id, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from e),
             n as (select user_id, s, count(*) as n from s group by all)
        select user_id, count(*) as sessions, sum(n)::bigint as events, max(n) as longest from n group by user_id""",
}
