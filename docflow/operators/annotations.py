"""Annotations as rows: adding, replacing, patching, removing, geometry, threads, and what edits leave behind.

An annotation's key is (doc_id, page, name); of rows that share a key the first (least ord) is the one that is meant.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docflow.sources.storage import materialize

KEY = ["doc_id", "page", "name"]
THREAD_DEPTH = 3
MIN_SIZE = 2.0


def first_matches(annotations: DataFrame, order: str = "ord") -> DataFrame:
    """The row that each key means."""
    return annotations.groupBy(*KEY).agg(F.min_by(F.struct(*(c for c in annotations.columns if c not in KEY)), order).alias("__a")).select(*KEY, "__a.*")


def with_metadata(annotations: DataFrame) -> DataFrame:
    """Annotations that have an author, contents or a subject."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return annotations.where(some("author") | some("contents") | some("subject"))


def saved(annotations: DataFrame) -> DataFrame:
    return annotations.where(~F.coalesce("ephemeral", F.lit(False)))


def added(annotations: DataFrame, new: DataFrame, order: str = "ord") -> DataFrame:
    """New annotations after those of their page; one without a name gets one from its place (a random one could not be repeated by a retry)."""
    last = annotations.groupBy("doc_id", "page").agg(F.max(order).alias("__last"))
    at = F.coalesce("__last", F.lit(-1)) + F.row_number().over(W.partitionBy("doc_id", "page").orderBy(order))
    placed = new.join(last, ["doc_id", "page"], "left").withColumn(order, at)
    named = placed.withColumn("name", F.coalesce("name", F.sha2(F.concat_ws(":", "doc_id", "page", order), 256))).drop("__last")
    return annotations.unionByName(named, allowMissingColumns=True)


def missing(annotations: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes that name no annotation: where there is any, a batch is refused as a whole."""
    return changes.join(annotations.select(*KEY).distinct(), KEY, "left_anti")


def replaced(annotations: DataFrame, updates: DataFrame, fields: list[str], order: str = "ord") -> DataFrame:
    """Annotations with the fields of their update; the name stays. Only the first match of a key is replaced, by its last update."""
    last = updates.groupBy(*KEY).agg(F.max_by(F.struct(*fields), "ordinal").alias("__u"))
    firsts = annotations.groupBy(*KEY).agg(F.min(order).alias("__first"))
    joined = annotations.join(firsts, KEY).join(last, KEY, "left")
    hit = F.col("__u").isNotNull() & (F.col(order) == F.col("__first"))
    return joined.select(*(F.when(hit, F.col("__u")[c]).otherwise(F.col(c)).alias(c) if c in fields else c for c in annotations.columns))


def patched(annotations: DataFrame, patches: DataFrame, fields: list[str], metadata: str | None = None, order: str = "ord") -> DataFrame:
    """Annotations with what their patch sets. A null field of a patch leaves the old value; metadata (a map) is merged.

    Every patch is applied to the original, so of several for one annotation the last alone counts. Kind and name stay.
    """
    carried = [*fields, *([metadata] if metadata else [])]
    last = patches.groupBy(*KEY).agg(F.max_by(F.struct(*carried), "ordinal").alias("__p"))
    firsts = annotations.groupBy(*KEY).agg(F.min(order).alias("__first"))
    joined = annotations.join(firsts, KEY).join(last, KEY, "left")
    hit = F.col("__p").isNotNull() & (F.col(order) == F.col("__first"))

    def value(c: str) -> Column:
        new = F.col("__p")[c]
        if c == metadata:
            old = F.coalesce(F.col(c), F.create_map().cast("map<string,string>"))
            merged = F.map_zip_with(old, new, lambda k, a, b: F.coalesce(b, a))
            return F.when(hit & new.isNotNull(), merged).otherwise(F.col(c)).alias(c)
        return F.when(hit, F.coalesce(new, F.col(c))).otherwise(F.col(c)).alias(c)

    return joined.select(*(value(c) if c in carried else c for c in annotations.columns))


def removed(annotations: DataFrame, gone: DataFrame, order: str = "ord") -> DataFrame:
    """Annotations without the first match of each key that goes."""
    firsts = annotations.join(gone.select(*KEY).distinct(), KEY, "left_semi").groupBy(*KEY).agg(F.min(order).alias(order))
    return annotations.join(firsts, [*KEY, order], "left_anti")


def overlaid(state: DataFrame, engine: DataFrame, fields: list[str]) -> DataFrame:
    """What the state has, else what the engine has."""
    both = engine.join(state.select(*KEY, *(F.col(f).alias(f"__{f}") for f in fields)), KEY, "full_outer")
    return both.select(*KEY, *(F.coalesce(f"__{f}", f).alias(f) for f in fields))


def page_comment_counts(annotations: DataFrame) -> DataFrame:
    return with_metadata(annotations).groupBy("doc_id", "page").agg(F.count("*").alias("n_comments"))


def dirty_pages(edits: DataFrame) -> DataFrame:
    """Pages that an edit of a lasting annotation has touched."""
    return edits.where(~(F.coalesce("was_ephemeral", F.lit(True)) & F.coalesce("is_ephemeral", F.lit(True)))).select("doc_id", "page").distinct()


def folded_edits(edits: DataFrame, fields: list[str]) -> DataFrame:
    """The annotations that a log of add, update and remove leaves: of each key the last action, if it removes nothing."""
    last = edits.groupBy(*KEY).agg(F.max_by(F.struct("action", *fields), "seq").alias("l"), F.min("seq").alias("ord"))
    return last.where("l.action != 'remove'").select(*KEY, "ord", *(F.col(f"l.{f}") for f in fields))


def replies(comments: DataFrame) -> DataFrame:
    """Threads of comments: depth (0 for those without parent), shown_depth (3 at most) and the comment that starts the thread.

    Pointers to ancestors double with each join, until no further comment reaches the start of its thread: depths have no
    gaps, so what is open then has none (cycles, missing parents) and is left out. A thread of depth 64 takes seven joins.
    """
    rows = comments.select("doc_id", "name", "parent_name")
    start = F.col("parent_name").isNull()
    now = materialize(rows.select("doc_id", "name", F.coalesce("parent_name", "name").alias("up"), F.when(start, 0).otherwise(1).alias("depth"), start.alias("done")), "threads")
    before, reached = -1, now.where("done").count()
    while reached > before and not now.where("NOT done").isEmpty():
        far = now.select(F.col("doc_id").alias("__d"), F.col("name").alias("__n"), F.col("up").alias("__up"), F.col("depth").alias("__depth"), F.col("done").alias("__done"))
        further = now.where("NOT done").join(far, (F.col("doc_id") == F.col("__d")) & (F.col("up") == F.col("__n"))).select("doc_id", "name", F.col("__up").alias("up"), (F.col("depth") + F.col("__depth")).alias("depth"), F.col("__done").alias("done"))
        now = materialize(now.where("done").unionByName(further), "threads")  # the next join reads it twice
        before, reached = reached, now.where("done").count()
    return now.where("done").select("doc_id", "name", F.col("up").alias("thread"), "depth", F.least("depth", F.lit(THREAD_DEPTH)).alias("shown_depth"))


# geometry -----------------------------------------------------------------------------------------------------------


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def rect(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def moved_point(p: Column, dx: Column, dy: Column) -> Column:
    return point(p["x"] + dx, p["y"] + dy)


def moved_rect(r: Column, dx: Column, dy: Column) -> Column:
    return rect(r["x"] + dx, r["y"] + dy, r["width"], r["height"])


def moved_points(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: moved_point(p, dx, dy))


def moved_strokes(strokes: Column, dx: Column, dy: Column) -> Column:
    """Ink and quads: arrays of arrays of points."""
    return F.transform(strokes, lambda s: moved_points(s, dx, dy))


def remapped(p: Column, old: Column, new: Column) -> Column:
    """A point at the same share of the new bounds; along an extent of zero it goes to the new origin."""
    share = lambda v, start, size: F.when(size > 0, (v - start) / size).otherwise(0.0)
    return point(new["x"] + share(p["x"], old["x"], old["width"]) * new["width"], new["y"] + share(p["y"], old["y"], old["height"]) * new["height"])


def resized_points(points: Column, old: Column, new: Column) -> Column:
    return F.transform(points, lambda p: remapped(p, old, new))


def resized_strokes(strokes: Column, old: Column, new: Column) -> Column:
    return F.transform(strokes, lambda s: resized_points(s, old, new))


def same_bounds(a: Column, b: Column, epsilon: float = 0.1) -> Column:
    return reduce(lambda x, y: x & y, (F.abs(a[c] - b[c]) < epsilon for c in ("x", "y", "width", "height")))


def unrotated(dx: Column, dy: Column, turn: Column) -> Column:
    """A movement on the turned page in the page's own directions."""
    return F.when(turn == 90, point(dy, -dx)).when(turn == 180, point(-dx, -dy)).when(turn == 270, point(-dy, dx)).otherwise(point(dx, dy))


def resized_bounds(r: Column, handle: Column, dx: Column, dy: Column) -> Column:
    """Bounds after a handle (n, ne, e, ..) was dragged; at least 2 wide and high."""
    west, east, north, south = (F.contains(handle, F.lit(s)) for s in "wens")
    x, width = r["x"] + F.when(west, dx).otherwise(0.0), r["width"] + F.when(west, -dx).otherwise(0.0) + F.when(east, dx).otherwise(0.0)
    y, height = r["y"] + F.when(north, dy).otherwise(0.0), r["height"] + F.when(north, -dy).otherwise(0.0) + F.when(south, dy).otherwise(0.0)
    return rect(F.when(width < MIN_SIZE, x + width - MIN_SIZE).otherwise(x), F.when(height < MIN_SIZE, y + height - MIN_SIZE).otherwise(y), F.greatest(width, F.lit(MIN_SIZE)), F.greatest(height, F.lit(MIN_SIZE)))


def bounding_rect(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, rect(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)))


def drawn(strokes: DataFrame, keys: list[str], kind: str = "tool", order: str = "seq") -> DataFrame:
    """Shapes from the points a tool has set: keys, kind, points, bounds. Ink and lines need 2 points, polygons 3, rectangles an area."""
    gathered = strokes.groupBy(*keys, kind).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "x", "y"))), lambda p: point(p["x"], p["y"])).alias("points"))
    shaped = gathered.withColumn("bounds", bounding_rect(F.col("points")))
    enough = F.when(F.col(kind) == "polygon", F.size("points") >= 3).when(F.col(kind).isin("square", "circle"), (F.col("bounds.width") > 0) & (F.col("bounds.height") > 0)).otherwise(F.size("points") >= 2)
    return shaped.where(enough)


def composed(a: Column, b: Column) -> Column:
    """Affine transforms: first b, then a. struct<scale_x, skew_x, skew_y, scale_y, tx, ty>."""
    return F.struct(
        (a["scale_x"] * b["scale_x"] + a["skew_x"] * b["skew_y"]).alias("scale_x"),
        (a["scale_x"] * b["skew_x"] + a["skew_x"] * b["scale_y"]).alias("skew_x"),
        (a["skew_y"] * b["scale_x"] + a["scale_y"] * b["skew_y"]).alias("skew_y"),
        (a["skew_y"] * b["skew_x"] + a["scale_y"] * b["scale_y"]).alias("scale_y"),
        (a["scale_x"] * b["tx"] + a["skew_x"] * b["ty"] + a["tx"]).alias("tx"),
        (a["skew_y"] * b["tx"] + a["scale_y"] * b["ty"] + a["ty"]).alias("ty"),
    )


def region(x: Column, y: Column, width: Column, height: Column, scale: float, page_width: Column, page_height: Column) -> Column:
    """The part of a drawn page that a rectangle shows, in whole pixels, cut at the page's edges; null if nothing is left."""
    whole = lambda v: F.floor(v * scale + 0.5)
    left, top = whole(x), whole(y)
    right, bottom = F.least(left + whole(width), page_width), F.least(top + whole(height), page_height)
    left, top = F.greatest(left, F.lit(0)), F.greatest(top, F.lit(0))
    return F.when((width > 0) & (height > 0) & (right > left) & (bottom > top), rect(left, top, right - left, bottom - top))


def navigation_target(kind: Column, page_index: Column, pages: Column, left: Column, top: Column, zoom: Column) -> Column:
    """Where a destination leads: page (from 1, within the document), scroll_x, scroll_y, zoom."""
    page = F.greatest(F.least(page_index + 1, F.greatest(pages, F.lit(1))), F.lit(1))
    across, down = kind.isin("xyz", "fitV", "fitBV"), kind.isin("xyz", "fitH", "fitBH")
    return F.struct(page.alias("page"), F.when(across, left).alias("scroll_x"), F.when(down, top).alias("scroll_y"), F.when((kind == "xyz") & (zoom > 0), zoom).alias("zoom"))
