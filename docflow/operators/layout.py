"""Spreads, their positions, and what of them is visible.

Positions are sums within a document, so every window is partitioned by the document; where a page falls is arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docflow.functions.units import CSS_DPI, PT_PER_INCH, effective_ratio, half_up, rotation, turned_size

MODES = ("single", "double", "odd-right", "odd-left")


def place_of(page: Column, mode: str) -> tuple[Column, Column]:
    """Spread and slot (from 0) of a page (from 1). odd-right: the first page stands alone on the right; odd-left: pages run right to left."""
    if mode == "single":
        return page - 1, F.lit(0)
    if mode == "double":
        return F.floor((page - 1) / 2), F.pmod(page - 1, F.lit(2))
    return F.floor(page / 2), F.pmod(page + int(mode == "odd-left"), F.lit(2))


def spread_of(page: Column, pages: Column, mode: str) -> Column:
    """The spread of a page; 0 for pages that are not there."""
    return F.when(page.between(1, pages), place_of(page, mode)[0]).otherwise(0).cast("long")


def spreads(documents: DataFrame, mode: str, key: str = "doc_id", pages: str = "page_count") -> DataFrame:
    """key, spread_index, slot0, slot1 (page numbers; null for an empty slot). documents: key and number of pages."""
    every = documents.where(F.col(pages) > 0).select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col(pages).cast("long"))).alias("page"))
    spread, slot = place_of(F.col("page"), mode)
    return every.select(key, spread.cast("long").alias("spread_index"), slot.alias("slot"), "page").groupBy(key, "spread_index").agg(F.max(F.when(F.col("slot") == 0, F.col("page"))).alias("slot0"), F.max(F.when(F.col("slot") == 1, F.col("page"))).alias("slot1"))


def primary_page(slot0: Column, slot1: Column) -> Column:
    return F.coalesce(slot0, slot1, F.lit(1))


def _pixels(points: Column, scale: float | Column, dpi: float, ratio: float) -> Column:
    """Points to whole device pixels."""
    return half_up(points * (dpi / PT_PER_INCH) * scale * ratio)


def _sized(pages: DataFrame, scale: float | Column, dpi: float, user_rotation: int, ratio: float, crop: str | None = None) -> DataFrame:
    width, height = F.col("width"), F.col("height")
    if crop == "vertical":
        height = F.coalesce("content_height", height)
    elif crop:
        width, height = F.coalesce("content_width", width), F.coalesce("content_height", height)
    w, h = turned_size(width, height, rotation(F.coalesce("rotation", F.lit(0)), F.lit(user_rotation)))
    return pages.withColumns({"w": _pixels(w, scale, dpi, ratio), "h": _pixels(h, scale, dpi, ratio)})


def spread_layouts(pages: DataFrame, mode: str, scale: float | Column = 1.0, page_spacing: float = 10, spread_spacing: float = 20, dpi: float = CSS_DPI, user_rotation: int = 0, ratio: float = 1.0, key: str = "doc_id") -> DataFrame:
    """key, spread_index, top, width, height. pages: key, page_index, width, height, rotation.

    Every size is rounded to device pixels before it is summed, so spreads meet without gaps. An empty slot is as wide as
    the first page of its spread.
    """
    spread, slot = place_of(F.col("page_index") + 1, mode)
    sized = _sized(pages, scale, dpi, user_rotation, ratio).withColumns({"spread_index": spread.cast("long"), "slot": slot})
    two = mode != "single"
    per = sized.groupBy(key, "spread_index").agg(F.sum("w").alias("sum_w"), F.count("*").alias("n"), F.min_by("w", "slot").alias("first_w"), F.max("h").alias("h"))
    # in double mode a last spread with one page still has two slots
    width = F.col("sum_w") + (F.when(F.col("n") == 1, F.col("first_w")).otherwise(0) + half_up(F.lit(page_spacing * ratio)) if two else F.lit(0))
    gap = half_up(F.lit(spread_spacing * ratio))
    above = W.partitionBy(key).orderBy("spread_index").rowsBetween(W.unboundedPreceding, -1)
    top = F.coalesce(F.sum(F.col("h") + gap).over(above), F.lit(0)) + gap
    return per.select(key, "spread_index", (top / ratio).alias("top"), (width / ratio).alias("width"), (F.col("h") / ratio).alias("height"))


def total_height(layouts: DataFrame, spread_spacing: float = 20, ratio: float = 1.0, key: str = "doc_id") -> DataFrame:
    """Height of the whole: the last spread's bottom and one more space."""
    return layouts.groupBy(key).agg((F.max_by(F.col("top") + F.col("height"), "spread_index") + half_up(F.lit(spread_spacing * ratio)) / ratio).alias("total_height"), F.max("width").alias("content_width"))


def visible_range(layouts: DataFrame, scroll_top: Column, viewport_height: float, buffer: int = 1, key: str = "doc_id") -> DataFrame:
    """key, first and last visible spread (positions in order of spread_index, inclusive), widened by buffer and clamped."""
    placed = layouts.withColumn("__top", scroll_top)
    found = placed.groupBy(key).agg(
        F.count("*").alias("n"),
        F.coalesce(F.min(F.when(F.col("top") + F.col("height") >= F.col("__top"), F.col("spread_index"))), F.lit(0)).alias("lo"),
        F.max(F.when(F.col("top") <= F.col("__top") + viewport_height, F.col("spread_index"))).alias("hi"),
    )
    last = F.greatest(F.coalesce("hi", "lo"), F.col("lo"))
    return found.select(key, F.greatest(F.col("lo") - buffer, F.lit(0)).cast("long").alias("first_index"), F.least(last + buffer, F.col("n") - 1).cast("long").alias("last_index"))


def nearest_spread(layouts: DataFrame, y: Column, key: str = "doc_id") -> DataFrame:
    """The spread whose centre is nearest to y; of equals the first."""
    away = F.abs(F.col("top") + F.col("height") / 2 - y)
    return layouts.groupBy(key).agg(F.min(F.struct(away.alias("away"), "spread_index")).alias("m")).select(key, F.col("m.spread_index").alias("spread_index"), F.col("m.away").alias("distance"))


def linear_layout(pages: DataFrame, scale: float = 1.0, dpi: float = CSS_DPI, user_rotation: int = 0, ratio: float = 1.0, key: str = "doc_id") -> DataFrame:
    """Pages below each other without space, cropped to the height of their content."""
    sized = _sized(pages, scale, dpi, user_rotation, ratio, "vertical")
    above = W.partitionBy(key).orderBy("page_index").rowsBetween(W.unboundedPreceding, -1)
    return sized.select(key, "page_index", (F.coalesce(F.sum("h").over(above), F.lit(0)) / ratio).alias("top"), (F.col("w") / ratio).alias("width"), (F.col("h") / ratio).alias("height"))


def grid_layout(tiles: DataFrame, scale: float = 1.0, dpi: float = CSS_DPI, user_rotation: int = 0, ratio: float = 1.0, key: str = "doc_id") -> DataFrame:
    """Tiles in rows and columns: a column is as wide as its widest tile, a row as high as its highest. tiles: key, page_index, row, col, width, height."""
    sized = _sized(tiles, scale, dpi, user_rotation, ratio, "both")
    columns = sized.groupBy(key, "col").agg(F.max("w").alias("cw"))
    rows = sized.groupBy(key, "row").agg(F.max("h").alias("rh"))
    before = lambda by: W.partitionBy(key).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    columns = columns.select(key, "col", F.coalesce(F.sum("cw").over(before("col")), F.lit(0)).alias("left"), F.sum("cw").over(W.partitionBy(key)).alias("__content"))
    rows = rows.select(key, "row", F.coalesce(F.sum("rh").over(before("row")), F.lit(0)).alias("top"), "rh")
    joined = sized.join(columns, [key, "col"]).join(rows, [key, "row"])
    return joined.select(key, "page_index", "row", "col", *((F.col(c) / ratio).alias(n) for c, n in (("left", "left"), ("top", "top"), ("w", "width"), ("rh", "row_height"), ("__content", "content_width"))))


def tiled_positions(groups: DataFrame, tiles: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tiles of groups: each group's pages start .. start + count - 1 by equality, not by a range join. groups: key, group_id, start, count."""
    pages = groups.where(F.col("count") > 0).select(key, "group_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)).alias("page_index"))
    return pages.join(tiles, [key, "page_index"])


def zoom_step(zoom: Column, steps: list[float], up: bool, limit: float) -> Column:
    """The next step above or below, clamped; past the last step the last one."""
    every = F.array(*(F.lit(float(s)) for s in sorted(steps)))
    if up:
        return F.least(F.coalesce(F.array_min(F.filter(every, lambda s: s > zoom + 1e-9)), F.lit(float(max(steps)))), F.lit(limit))
    return F.greatest(F.coalesce(F.array_max(F.filter(every, lambda s: s < zoom - 1e-9)), F.lit(float(min(steps)))), F.lit(limit))


def prerender_scale(pages: DataFrame, zoom: float, dpi: float = CSS_DPI, ratio: float = 2.0, reach: int = 2, key: str = "doc_id") -> DataFrame:
    """The scale that pages around each page can all be drawn at: the least device ratio within reach."""
    points = dpi / PT_PER_INCH
    own = effective_ratio(F.col("width") * points * zoom, F.col("height") * points * zoom, F.lit(ratio))
    near = W.partitionBy(key).orderBy("page_index").rangeBetween(-reach, reach)
    return pages.select(key, "page_index", (F.least(F.min(own).over(near), F.lit(ratio)) * points * zoom).alias("scale"))


def prerendered(focus: DataFrame, reach: int = 2, key: str = "doc_id") -> DataFrame:
    """Pages to draw ahead, in order: next before previous, near before far. focus: key, page, page_count."""
    offsets = F.array(*(F.lit(s * d) for d in range(1, reach + 1) for s in (1, -1)))
    every = focus.select(key, "page", "page_count", F.posexplode(offsets).alias("rank", "offset")).withColumn("target", F.col("page") + F.col("offset"))
    return every.where(F.col("target").between(0, F.col("page_count") - 1)).select(key, "page", "target", "rank")


ZOOM_MODES = ("custom", "fit-spread-width", "fit-spread-width-max", "fit-spread-height", "fit-spread")


def view_scales(pages: DataFrame, mode: str, zoom_mode: str, view_width: float, view_height: float, zoom: float = 1.0, continuous: bool = True, page_spacing: float = 10, spread_spacing: float = 20, scrollbar: float = 15.0, dpi: float = CSS_DPI, user_rotation: int = 0, ratio: float = 1.0, key: str = "doc_id") -> DataFrame:
    """key, scale: what a zoom mode gives for the largest spread. Fitting the width leaves room for a scrollbar if one will show.

    Whether one will is seen by laying all spreads out at the full width's scale: two aggregations and a join by document.
    """
    sizes = spread_layouts(pages, mode, 1.0, page_spacing, spread_spacing, dpi, user_rotation, ratio, key)
    largest = sizes.groupBy(key).agg(F.max("width").alias("max_w"), F.max("height").alias("max_h"), F.count("*").alias("n"))
    if zoom_mode == "custom":
        return largest.select(key, F.lit(float(zoom)).alias("scale"))
    snap = lambda v: float((v * ratio + 0.5) // 1) / ratio
    width, height, gap = snap(view_width), snap(view_height), snap(spread_spacing)
    target = F.lit(max(0.0, height - 2 * gap + 1))
    if zoom_mode == "fit-spread-height":
        return largest.select(key, (target / F.col("max_h")).alias("scale"))
    if zoom_mode == "fit-spread":
        return largest.select(key, F.least(width / F.col("max_w"), target / F.col("max_h")).alias("scale"))
    full = largest.withColumn("full", width / F.col("max_w"))
    if continuous:
        again = spread_layouts(pages.join(full.select(key, "full"), key), mode, F.col("full"), page_spacing, spread_spacing, dpi, user_rotation, ratio, key)
        full = full.join(again.groupBy(key).agg(F.sum("height").alias("total")), key).withColumn("needs", F.col("total") + gap * (F.col("n") + 1) > height)
    else:
        full = full.withColumn("needs", F.col("max_h") * F.col("full") + 2 * gap > height)
    scale = F.when(F.col("needs") & F.lit(scrollbar > 0), (width - scrollbar) / F.col("max_w")).otherwise(F.col("full"))
    return full.select(key, (F.least(scale, F.lit(1.0)) if zoom_mode == "fit-spread-width-max" else scale).alias("scale"))


def visible_pages(spreads_: DataFrame, ranges: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, first_page, last_page (from 0) of the visible spreads; documents without a page in view are left out."""
    seen = spreads_.join(ranges, key).where(F.col("spread_index").between(F.col("first_index"), F.col("last_index")))
    return seen.groupBy(key).agg((F.min(F.least("slot0", "slot1")) - 1).alias("first_page"), (F.max(F.greatest("slot0", "slot1")) - 1).alias("last_page"))


def layout_or_first(wanted: DataFrame, layouts: DataFrame, key: str = "doc_id") -> DataFrame:
    """The layout of each wanted spread; where it is not laid out, the document's first."""
    first = layouts.groupBy(key).agg(F.min_by("top", "spread_index").alias("first_top"))
    return wanted.join(layouts.select(key, "spread_index", "top"), [key, "spread_index"], "left").join(first, key).select(key, "spread_index", F.coalesce("top", "first_top").alias("top"))


def scroll_target(top: Column, height: Column, scroll: Column, view: Column, content: Column, align: str) -> Column:
    """Where to scroll so that a box shows at the top, centre or bottom, or moves as little as needed (nearest); clamped."""
    at_bottom, at_centre = top + height - view, top + height / 2 - view / 2
    nearest = F.when(top < scroll, top).when(top + height > scroll + view, at_bottom).otherwise(scroll)
    wanted = {"top": top, "center": at_centre, "bottom": at_bottom, "nearest": nearest}[align]
    return F.greatest(F.least(wanted, content - view), F.lit(0.0))


def overflow_states(deltas: DataFrame, threshold: float, key: str, order: str) -> DataFrame:
    """Whether content overflows, with hysteresis: the state goes on only above threshold and off only below -threshold.

    A value between the bounds repeats the last decided one, and before any the state is off: a fill, not a fold.
    """
    decided = F.when(F.col("delta") > threshold, True).when(F.col("delta") < -threshold, False)
    first = W.partitionBy(key).orderBy(order)
    return deltas.withColumn("overflow", F.coalesce(F.last(decided, ignorenulls=True).over(first.rowsBetween(W.unboundedPreceding, 0)), F.lit(False)))
