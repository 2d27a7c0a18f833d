"""Relations between decoded tables, as joins, windows and aggregates. Every table has doc_id; page tables have page too."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from ..model import boxes as box_model
from ..runtime import ship

PAGE = ["doc_id", "page"]


# Structure and spans.


def structure_contents(structure: DataFrame) -> DataFrame:
    """(doc_id, page, node, mcid): the marked content of each element."""
    return structure.select("doc_id", "page", "node", F.explode("mcids").alias("mcid"))


def placed_spans(spans: DataFrame, structure: DataFrame) -> DataFrame:
    """Spans with the element (node, role) that holds their marked content: an equi join on page and identifier."""
    held = structure.select("doc_id", "page", "node", "role", F.explode("mcids").alias("mcid"))
    return spans.where("mcid is not null").join(held, [*PAGE, "mcid"])


def leftover_spans(spans: DataFrame, structure: DataFrame) -> DataFrame:
    """Spans that no element holds, those without an identifier too: an anti join."""
    return spans.join(structure_contents(structure).select(*PAGE, "mcid").distinct(), [*PAGE, "mcid"], "left_anti")


def misplaced_rows(structure: DataFrame) -> DataFrame:
    """Table rows whose parent is no table: a self join of elements with their parents."""
    above = structure.select("doc_id", F.col("node").alias("parent"), F.col("role").alias("parent_role"))
    rows = structure.where("role = 'TR'").join(above, ["doc_id", "parent"], "left")
    return rows.where(F.coalesce(~F.col("parent_role").isin("Table", "THead", "TBody", "TFoot"), F.lit(True))).select("doc_id", "node", "parent", "parent_role")


def heading_jumps(structure: DataFrame) -> DataFrame:
    """Headings more than one level below the heading before them."""
    h = structure.where(F.col("role").rlike("^H[1-6]$")).withColumn("level", F.substring("role", 2, 1).cast("int"))
    before = F.coalesce(F.lag("level").over(Window.partitionBy("doc_id").orderBy("node")), F.lit(0))
    return h.withColumn("before", before).where(F.col("level") > F.col("before") + 1).select("doc_id", "node", "level", "before")


# Lookups.


def resolved(links: DataFrame, objects: DataFrame, ref_col: str) -> DataFrame:
    """Links with the kind of the object that they name; "null" where there is none: a left join with a default."""
    known = objects.select("doc_id", F.col("object").alias(ref_col), F.col("kind").alias("object_kind"))
    return links.join(known, ["doc_id", ref_col], "left").withColumn("object_kind", F.coalesce("object_kind", F.lit("null")))


def widget_fields(widgets: DataFrame, fields: DataFrame) -> DataFrame:
    """Widgets (doc_id, object) with the field that they present."""
    return widgets.join(fields.select("doc_id", "field", "name", F.explode("widgets").alias("object")), ["doc_id", "object"])


def labelled_pages(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pages with the label of the last range (doc_id, start, style, prefix, first) that starts at or before them: an as-of
    join by a window over both tables. Null before the first range; the page's number where a document has no ranges."""
    marks = ranges.select("doc_id", F.col("start").alias("page"), F.lit(0).alias("side"), F.struct("start", "style", "prefix", "first").alias("range"))
    own = pages.select("doc_id", "page", F.lit(1).alias("side"), F.lit(None).cast(marks.schema["range"].dataType).alias("range"))
    so_far = Window.partitionBy("doc_id").orderBy("page", "side")
    whole = Window.partitionBy("doc_id")
    both = marks.union(own).withColumn("own", F.last("range", ignorenulls=True).over(so_far)).withColumn("some", F.max(F.col("side") == 0).over(whole))
    n = F.col("page") - F.col("own.start") + F.coalesce("own.first", F.lit(1))
    label = F.when(F.col("own").isNotNull(), F.concat(F.coalesce("own.prefix", F.lit("")), values.numeral(F.col("own.style"), n))).when(~F.col("some"), (F.col("page") + 1).cast("string"))
    return both.where("side = 1").select("doc_id", "page", label.alias("label"))


def merged_attachments(tree: DataFrame, associated: DataFrame) -> DataFrame:
    """One row per embedded object of either list (doc_id, object, name, description, relationship); what one entry lacks
    the other fills in: an outer join."""
    b = associated.select("doc_id", "object", *[F.col(c).alias(f"{c}_b") for c in ("name", "description", "relationship")])
    both = tree.select("doc_id", "object", "name", "description", "relationship").join(b, ["doc_id", "object"], "full")
    return both.select("doc_id", "object", *[F.coalesce(c, f"{c}_b").alias(c) for c in ("name", "description", "relationship")])


# Layout.


def bands(lines: DataFrame, drop: float = 2.2) -> DataFrame:
    """Lines with the number of their band: a new one begins where the baseline falls by more than ``drop`` sizes."""
    w = Window.partitionBy(*PAGE).orderBy("line")
    new = (F.coalesce(F.lag("y").over(w) - F.col("y"), F.lit(0.0)) > drop * F.col("size")).cast("int")
    return lines.withColumn("new", new).withColumn("band", F.sum("new").over(w).cast("int")).drop("new")


def spans_in_columns(spans: DataFrame, edges: DataFrame) -> DataFrame:
    """Spans with the column of a table (doc_id, page, table, col_x: edges) whose half-open range holds their middle; the
    last column takes its right edge. A range join within the page."""
    columns = edges.select(*PAGE, "table", F.posexplode(F.arrays_zip(F.slice("col_x", 1, F.size("col_x") - 1).alias("low"), F.slice("col_x", 2, F.size("col_x") - 1).alias("high"))).alias("col", "e"), (F.size("col_x") - 2).alias("last"))
    mid = F.col("x") + F.col("advance") / 2
    inside = (mid >= F.col("e.low")) & ((mid < F.col("e.high")) | ((F.col("col") == F.col("last")) & (mid <= F.col("e.high"))))
    return spans.join(columns, PAGE).where(inside).drop("e", "last")


def rules_in_bands(rules: DataFrame, extents: DataFrame, cover: float = 0.5) -> DataFrame:
    """Vertical rules that cover at least half of a band's height (doc_id, page, band, low, high): an overlap join."""
    overlap = F.least("end", "high") - F.greatest("start", "low")
    return rules.where("vertical").join(extents, PAGE).where(overlap >= cover * (F.col("high") - F.col("low"))).select(*PAGE, "band", "pos")


def free_gutters(rows: DataFrame, keys: list[str], allowed: Column) -> DataFrame:
    """Maximal x ranges that at most ``allowed`` of the intervals (keys, start, end) cover: a running sum over their ends.

    ``allowed`` is an expression over the number of intervals n."""
    ends = rows.select(*keys, F.col("start").alias("x"), F.lit(1).alias("d")).union(rows.select(*keys, F.col("end").alias("x"), F.lit(-1).alias("d")))
    steps = ends.groupBy(*keys, "x").agg(F.sum("d").alias("d"), F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("opened"))
    w = Window.partitionBy(*keys).orderBy("x")
    depth = steps.withColumn("depth", F.sum("d").over(w)).withColumn("next", F.lead("x").over(w)).withColumn("n", F.sum("opened").over(Window.partitionBy(*keys)))
    free = depth.where("next is not null").withColumn("free", (F.col("depth") <= allowed).cast("int"))
    run = free.withColumn("run", F.sum(F.when(F.coalesce(F.lag("free").over(w), F.lit(-1)) != F.col("free"), 1).otherwise(0)).over(w))
    return run.where("free = 1").groupBy(*keys, "run").agg(F.min("x").alias("start"), F.max("next").alias("end")).drop("run")


def merged_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals (keys, start, end) that touch or overlap as one: a running maximum of the ends so far."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    grouped = rows.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    return grouped.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def row_separators(lines: DataFrame) -> DataFrame:
    """(doc_id, page, k, y): above the first line, half way between neighbours, below the last one."""
    w = Window.partitionBy(*PAGE).orderBy("line")
    own = lines.withColumn("before", F.lag("y").over(w)).withColumn("after", F.lead("y").over(w)).withColumn("k", F.row_number().over(w).cast("int"))
    upper = own.select(*PAGE, (F.col("k") - 1).alias("k"), F.when(F.col("before").isNull(), F.col("y") + 0.8 * F.col("size")).otherwise((F.col("before") + F.col("y")) / 2).alias("y"))
    lower = own.where("after is null").select(*PAGE, "k", (F.col("y") - 0.2 * F.col("size")).alias("y"))
    return upper.union(lower)


def overlaps(left: DataFrame, right: DataFrame, cell: float = 256.0) -> DataFrame:
    """Pairs (left_id, right_id) of boxes (doc_id, page, id, x0, y0, x1, y1) of a page whose insides meet.

    A spatial join: both sides are dealt to the cells of a grid that they touch and joined on page and cell; a pair counts
    in the cell of the lower left corner of what it shares, so it comes once. No page is a cross product. For numbers of pairs
    alone overlap_sums() takes far fewer steps where boxes lie close."""
    pairs = _dealt(left, cell, "left_").join(_dealt(right, cell, "right_"), [*PAGE, "cx", "cy"])
    c = F.col
    meets = (c("left_x0") < c("right_x1")) & (c("right_x0") < c("left_x1")) & (c("left_y0") < c("right_y1")) & (c("right_y0") < c("left_y1"))
    here = (F.floor(F.greatest("left_x0", "right_x0") / cell) == c("cx")) & (F.floor(F.greatest("left_y0", "right_y0") / cell) == c("cy"))
    return pairs.where(meets & here).select(*PAGE, "left_id", "right_id")


def _dealt(boxes: DataFrame, cell: float, prefix: str = "") -> DataFrame:
    """Boxes with every cell of the grid that they touch."""
    at = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    own = boxes.where("x1 > x0 and y1 > y0").select(*PAGE, *[F.col(c).alias(f"{prefix}{c}") for c in ("id", "x0", "y0", "x1", "y1")], F.explode(at("x0", "x1")).alias("cx"), at("y0", "y1").alias("rows"))
    return own.withColumn("cy", F.explode("rows")).drop("rows")


def overlap_sums(left: DataFrame, right: DataFrame, cell: float = 256.0) -> DataFrame:
    """(doc_id, page, pairs, left_ids, right_ids): of the pairs of overlaps() their number and the sums of their identifiers,
    for pages where any meet.

    Pairs aren't listed: a cell's boxes go to one call, which counts them in n log(n)^2 steps (model.boxes), where the join
    takes their square. Cells are dealt to four tasks a core whatever their bytes, since little data is much work here."""
    ship(left.sparkSession)
    corner = ("x0", "y0", "x1", "y1")
    keys = [*PAGE, "cx", "cy", *corner]

    def run(t: pa.Table) -> pa.Table:
        is_left = t.column("is_left").to_numpy(zero_copy_only=False).astype(bool)
        ids = t.column("id").to_numpy()
        corners = np.stack([t.column(c).to_numpy() for c in corner], axis=1)
        key = {c: t.column(c)[0].as_py() for c in (*PAGE, "cx", "cy")}
        sums = box_model.cell_sums(corners[is_left], ids[is_left], corners[~is_left], ids[~is_left], cell, key["cx"], key["cy"])
        own = {"doc_id": key["doc_id"], "page": key["page"], **dict(zip(("pairs", "left_ids", "right_ids"), sums))}
        return pa.Table.from_pylist([own] if sums[0] else [], pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), *((c, pa.int64()) for c in ("pairs", "left_ids", "right_ids"))]))

    sides = [_dealt(side, cell).select(*[F.col(c).cast("double") if c in corner else F.col(c) for c in keys], F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"), F.lit(is_left).alias("is_left")) for side, is_left in ((left, True), (right, False))]
    tasks = 4 * left.sparkSession.sparkContext.defaultParallelism
    dealt = sides[0].union(sides[1]).repartition(tasks, *PAGE, "cx", "cy")
    cells = dealt.groupBy(*PAGE, "cx", "cy").applyInArrow(run, "doc_id long, page int, pairs long, left_ids long, right_ids long")
    return cells.groupBy(*PAGE).agg(*[F.sum(c).alias(c) for c in ("pairs", "left_ids", "right_ids")])


def bounding_boxes(boxes: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


# Pages, images and objects.


def image_placements(images: DataFrame) -> DataFrame:
    """(doc_id, object, placements, ordinal): how often each image object is painted, numbered as they first appear."""
    found = images.where("object is not null").groupBy("doc_id", "object").agg(F.count(F.lit(1)).alias("placements"), F.min(F.struct("page", "seq")).alias("first"))
    return found.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")) - 1).drop("first")


def compare_images(left: DataFrame, right: DataFrame, keys: list[str], threshold: int = 0) -> DataFrame:
    """Of images as rows of bytes (keys, row, pixels: binary of equal length): how many values differ by more than the
    threshold, the mean absolute and the root mean square difference, the largest one, and the share that differs.

    Rows are compared where they are joined; images of other sizes give size_equal false and nulls."""
    spread = lambda side: F.transform(F.sequence(F.lit(1), F.length(side)), lambda i: F.conv(F.hex(F.substring(F.col(side), i, F.lit(1))), 16, 10).cast("int"))
    both = left.select(*keys, "row", F.col("pixels").alias("p")).join(right.select(*keys, "row", F.col("pixels").alias("q")), [*keys, "row"], "full")
    same = F.coalesce(F.length("p") == F.length("q"), F.lit(False))
    d = F.when(same & (F.length("p") > 0), F.zip_with(spread("p"), spread("q"), lambda a, b: F.abs(a - b)))
    fold = lambda f: F.aggregate("d", F.lit(0).cast("long"), f)
    rows = both.withColumn("same", same).withColumn("d", d)
    each = rows.select(*keys, "same", F.size("d").alias("n"), fold(lambda a, x: a + x).alias("total"), fold(lambda a, x: a + x * x).alias("squares"), F.array_max("d").alias("most"), fold(lambda a, x: a + (x > threshold).cast("long")).alias("differ"))
    out = each.groupBy(*keys).agg(F.min("same").alias("size_equal"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.max("most").alias("most"), F.sum("differ").alias("differ"))
    ok = lambda c: F.when(F.col("size_equal"), c)
    return out.select(*keys, "size_equal", ok(F.col("differ")).alias("differ"), ok(F.col("total") / F.col("n")).alias("mean_error"), ok(F.sqrt(F.col("squares") / F.col("n"))).alias("rms_error"), ok(F.col("most")).alias("most"), ok(F.col("differ") / F.col("n")).alias("share"))


def chosen_pages(pages: DataFrame, wanted: Iterable[int], keep: bool = True) -> DataFrame:
    """Pages by index: those wanted, or all others."""
    test = F.col("page").isin(list(wanted))
    return pages.where(test if keep else ~test)


def is_permutation(order: Column, n: Column) -> Column:
    """Whether an array holds each of 0 to n - 1 once."""
    return (F.size(order) == n) & (F.array_sort(order) == F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))


def reachable(edges: DataFrame, roots: DataFrame, most: int = 64) -> DataFrame:
    """(doc_id, node, depth) of the nodes that edges (doc_id, a, b) reach from roots (doc_id, node), each at its least depth.

    A round a level, over the nodes that are new; at most ``most`` levels, as deep as a file's trees may be. Each round is
    a table in the shared folder."""
    from ..runtime import written

    found = written(roots.select("doc_id", "node", F.lit(0).alias("depth")).dropDuplicates(["doc_id", "node"]), "reached")
    new = found
    for depth in range(1, most + 1):
        step = new.join(edges.select("doc_id", F.col("a").alias("node"), "b"), ["doc_id", "node"]).select("doc_id", F.col("b").alias("node")).distinct()
        new = written(step.join(found, ["doc_id", "node"], "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if not new.limit(1).count():
            break
        found = found.union(new)
    return found
