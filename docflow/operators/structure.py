"""Document structure: list numbering, outlines, style inheritance, pagination, and table geometry.

Every running computation is a window over one document. Inheritance doubles its reach with each join, so a chain of 33
styles takes six joins whatever the number of styles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docflow.functions.labels import list_label
from docflow.sources.storage import materialize

LEVELS = 9
#: Styles in a chain of inheritance at most, the first one included: 2 to the power of DOUBLINGS, and one.
DOUBLINGS = 5
EPSILON = 0.25


def numbered(items: DataFrame, numbers: DataFrame, levels: DataFrame, doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """Counts and labels of list items. A count starts over when an item of a lesser level of the same list comes between.

    items: doc, order, num_id, ilvl; numbers: num_id, abstract_id; levels: abstract_id, ilvl, start, fmt, level_text.
    Items whose list or level is not defined, or whose level is none of the LEVELS that lists have, have no count and an
    empty label, and touch no other count.
    """
    real = F.col("fmt").isNotNull() & F.col("ilvl").between(0, LEVELS - 1)
    known = items.join(numbers, "num_id", "left").join(levels, ["abstract_id", "ilvl"], "left").withColumn("valid", F.coalesce(real, F.lit(False)))
    so_far = W.partitionBy(doc, "num_id").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    resets = F.array(*(F.sum((F.col("valid") & (F.col("ilvl") < level)).cast("int")).over(so_far) for level in range(LEVELS)))
    within = known.withColumn("reset", F.when(F.col("valid"), F.try_element_at(resets, (F.col("ilvl") + 1).cast("int"))))
    group = W.partitionBy(doc, "num_id", "ilvl", "reset").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    count = F.when(F.col("valid"), F.greatest(F.col("start") - 1, F.lit(0)) + F.sum(F.col("valid").cast("int")).over(group)).cast("long")
    counted = within.withColumn("count", count)
    return counted.withColumn("label", F.when(F.col("valid"), list_label(F.col("count"), F.col("ilvl"), F.col("fmt"), F.col("level_text"))).otherwise("")).drop("reset", "valid")


def outline(headings: DataFrame, doc: str = "doc_id", order: str = "idx", level: str = "level", title: str = "title") -> DataFrame:
    """The headings with depth (from 0) and parent_idx. A heading goes at most one level below the one before it.

    Blank titles are left out. With i the heading's place, the effective level is i + min(least level, min over the
    headings so far of level - place): a running minimum in place of a recursion. The parent is the last heading one level
    above: each heading stands at its own depth as a possible parent and at the one above as a child, so any depth will do.
    """
    some = headings.where(F.col(level).isNotNull() & (F.trim(title) != ""))
    by = W.partitionBy(doc).orderBy(order)
    placed = some.withColumn("__i", F.row_number().over(by) - 1).withColumn("__least", F.min(level).over(W.partitionBy(doc)))
    effective = F.col("__i") + F.least(F.col("__least"), F.min(F.col(level) - F.col("__i")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    deep = placed.withColumn("depth", (effective - F.col("__least")).cast("long"))
    entries = deep.withColumn("__at", F.explode(F.array("depth", F.col("depth") - 1)))
    before = W.partitionBy(doc, "__at").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    parent = F.last(F.when(F.col("depth") == F.col("__at"), F.col(order)), ignorenulls=True).over(before)
    return entries.withColumn("parent_idx", parent).where(F.col("__at") == F.col("depth") - 1).drop("__i", "__least", "__at")


def inherited(styles: DataFrame, properties: list[str], doc: str = "doc_id", style: str = "style_id", base: str = "based_on") -> DataFrame:
    """Every style with its properties filled from its bases, the nearest first; a missing base ends the chain.

    After k joins a style knows 2^k of its chain and points past them, so cycles end too. Every join's result is a table, for
    the next one reads it twice.
    """
    own = materialize(styles.select(doc, style, *properties, base), "styles")
    now = own
    for step in range(DOUBLINGS + 1):
        # the last step adds one more style, so that 33 count in all
        source = now if step < DOUBLINGS else own
        upper = source.select(F.col(doc).alias("__d"), F.col(style).alias("__s"), *(F.col(p).alias(f"__{p}") for p in properties), F.col(base).alias("__next"))
        joined = now.join(upper, (F.col(doc) == F.col("__d")) & (F.col(base) == F.col("__s")), "left")
        now = joined.select(doc, style, *(F.coalesce(p, f"__{p}").alias(p) for p in properties), F.col("__next").alias(base))
        now = materialize(now, "styles") if step < DOUBLINGS else now
    return now.drop(base)


def page_of(y: Column, height: Column) -> Column:
    return F.greatest(F.floor((y + EPSILON) / height), F.lit(0))


def paginated(blocks: DataFrame, page_height: float, doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """blocks with the page each starts on. A break moves on to the next page; blocks: doc, order, kind, height (with spaces).

    Between breaks the place is a running sum; the pages before a break are a running sum over the stretches between breaks.
    """
    by = W.partitionBy(doc).orderBy(order)
    is_break = F.col("kind") == "break"
    height = F.lit(page_height)
    cut = blocks.withColumn("__part", F.coalesce(F.sum(is_break.cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    cut = cut.withColumn("__h", F.when(is_break, 0.0).otherwise(F.col("height")))
    inside = W.partitionBy(doc, "__part").orderBy(order)
    local = cut.withColumn("__y", F.coalesce(F.sum("__h").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    # at a break the stretch before it is known; its pages count for everything after it
    turned = local.withColumn("__pages", F.when(is_break, page_of(F.col("__y"), height) + 1).otherwise(0))
    first = F.coalesce(F.sum("__pages").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = turned.withColumn("__first", first).withColumn("page", (F.col("__first") + page_of(F.col("__y"), height)).cast("long"))
    bottom = F.when(is_break, (F.col("__first") + F.col("__pages")) * height).otherwise(F.col("__first") * height + F.col("__y") + F.col("__h"))
    return placed.withColumn("bottom", bottom).drop("__part", "__h", "__y", "__pages", "__first")


def page_counts(placed: DataFrame, page_height: float, doc: str = "doc_id", order: str = "idx") -> DataFrame:
    return placed.groupBy(doc).agg(F.greatest(F.ceil(F.max_by("bottom", order) / page_height), F.lit(1)).cast("long").alias("page_count"))


def paginated_with_images(blocks: DataFrame, page_height: float, doc: str = "doc_id", order: str = "idx") -> DataFrame:
    """Like paginated, where blocks also have `images` (array<double>, heights): an image that does not fit the rest of its page goes to the next.

    Where an image goes depends on all before it, so this is a fold over the document's blocks.
    """
    block = F.struct(order, "kind", "space_before", "height", F.coalesce("images", F.array().cast("array<double>")).alias("images"))
    grouped = blocks.groupBy(doc).agg(F.array_sort(F.collect_list(block)).alias("b"))
    h = F.lit(page_height)

    def with_image(y: Column, image: Column) -> Column:
        page = page_of(y, h)
        over = (y - page * h + image > h) & (image <= h)
        return F.when(image < 1, y).otherwise(F.when(over, (page + 1) * h).otherwise(y) + image)

    def step(a: Column, b: Column) -> Column:
        paragraph = F.aggregate(b["images"], a["y"] + b["space_before"], with_image) + b["height"]
        y = F.when(b["kind"] == "break", (page_of(a["y"], h) + 1) * h).otherwise(paragraph)
        return F.struct(y.alias("y"), F.array_append(a["out"], F.struct(b[order].alias(order), page_of(a["y"], h).alias("page"), y.alias("bottom"))).alias("out"))

    start = F.struct(F.lit(0.0).alias("y"), F.array().cast(f"array<struct<{order}:bigint,page:bigint,bottom:double>>").alias("out"))
    return grouped.select(doc, F.explode(F.aggregate("b", start, step, lambda a: a["out"])).alias("o")).select(doc, f"o.{order}", "o.page", "o.bottom")


def text_height(chars: Column, size_pt: Column, line_factor: Column, chars_per_line: float) -> Column:
    """Height of a paragraph by a metric model: so many characters to a line, 1.15 times the size to a line's height."""
    lines = F.greatest(F.ceil(chars / chars_per_line), F.lit(1))
    return lines * F.greatest(size_pt * 1.15 * F.greatest(line_factor, F.lit(0.5)), F.lit(1.0))


def inherited_reference(sections: DataFrame, ref: str, doc: str = "doc_id", order: str = "section") -> DataFrame:
    """A section without a header (footer) of its own has that of the section before."""
    return sections.withColumn(ref, F.last(ref, ignorenulls=True).over(W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def table_width(width: Column, is_percent: Column, content: Column) -> Column:
    """Width of a table: of 5000ths of the content and no wider, in twips as it stands, or the content's."""
    return F.when(is_percent & (width > 0), F.least(content * width / 5000, content)).when(width > 0, width / 20).otherwise(content)


def column_widths(cells: DataFrame, keys: list[str], total: Column) -> DataFrame:
    """keys, col, width: columns share the table's width by their grid widths, equally if those are all 0."""
    grid = cells.groupBy(*keys, "col").agg(F.max("grid").alias("grid"), F.max(total).alias("__total"))
    over = W.partitionBy(*keys)
    share = F.when(F.sum("grid").over(over) > 0, F.col("grid") / F.sum("grid").over(over)).otherwise(F.lit(1.0) / F.count("*").over(over))
    return grid.select(*keys, "col", (F.col("__total") * share).alias("width"))


def row_heights(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, height: exact heights count as they stand; else the tallest cell, at least the row's or 12 points. cells: keys, row, height, row_height (twips), exact."""
    tallest, least = F.max("height"), F.max("row_height")
    return cells.groupBy(*keys, "row").agg(F.when(F.max(F.col("exact").cast("int")).cast("boolean") & (least > 0), least / 20).otherwise(F.greatest(tallest, F.when(least > 0, least / 20).otherwise(12.0))).alias("height"))


def spanned_cells(cells: DataFrame, widths: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, cell, left, width of cells that span columns. cells: keys, row, cell, span."""
    before = W.partitionBy(*keys, "row").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    first = cells.withColumn("__first", F.coalesce(F.sum("span").over(before), F.lit(0)))
    covered = first.select(*keys, "row", "cell", F.explode(F.sequence(F.col("__first"), F.col("__first") + F.greatest("span", F.lit(1)) - 1)).alias("col"))
    left = W.partitionBy(*keys).orderBy("col").rowsBetween(W.unboundedPreceding, -1)
    placed = widths.withColumn("left", F.coalesce(F.sum("width").over(left), F.lit(0.0)))
    return covered.join(placed, [*keys, "col"]).groupBy(*keys, "row", "cell").agg(F.min("left").alias("left"), F.sum("width").alias("width"))


def edge_borders(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Which border each side of a cell gets: its own, else the table's outer one at an edge, else the inner one."""
    over = W.partitionBy(*keys)
    low, high = (lambda c: F.min(c).over(over)), (lambda c: F.max(c).over(over))
    side = lambda own, edge, outer, inner: F.coalesce(own, F.when(edge, outer).otherwise(inner))
    c = F.col
    return cells.withColumns({
        "border_top": side(c("top"), c("row") == low("row"), c("table_top"), c("inside_h")),
        "border_bottom": side(c("bottom"), c("row") == high("row"), c("table_bottom"), c("inside_h")),
        "border_left": side(c("left"), c("col") == low("col"), c("table_left"), c("inside_v")),
        "border_right": side(c("right"), c("col") == high("col"), c("table_right"), c("inside_v")),
    })
