"""Viewer settings as data: defaults and presets as lookups, and what a change of settings asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docflow.functions.labels import lookup

# View settings by document format: (view mode, scroll mode, zoom mode).
FORMAT_DEFAULTS = {
    "pdf": ("paged", "continuous", "fit-spread-width-max"),
    "docx": ("paged", "continuous", "fit-spread-width-max"),
    "xlsx": ("continuous", "continuous", "fit-spread-width-max"),
    "pptx": ("paged", "spread", "fit-spread"),
    "image": ("paged", "spread", "fit-spread"),
}
# Page and spread spacing by spacing mode.
SPACING = {"all": (20, 20), "none": (0, 0), "spread-only": (0, 20), "page-only": (20, 0)}
#: Settings whose change means other spreads; those that only move them; and the one that scrolls to the page.
STRUCTURE = ("doc_id", "page_count", "active_group", "view_mode", "layout_mode")
PLACEMENT = ("scroll_mode", "zoom", "dpi", "rotation", "page_spacing", "spread_spacing", "view_width", "view_height")
ZOOM_MODE = "zoom_mode"


def format_defaults(fmt: Column, **overrides: Column) -> list[Column]:
    """view_mode, scroll_mode and zoom_mode of a format, each replaced by its override where that is not null."""
    names = ("view_mode", "scroll_mode", "zoom_mode")
    return [F.coalesce(*([overrides[n]] if n in overrides else []), lookup({f: v[i] for f, v in FORMAT_DEFAULTS.items()}, fmt)).alias(n) for i, n in enumerate(names)]


def spacing_of(mode: Column) -> tuple[Column, Column]:
    return lookup({m: v[0] for m, v in SPACING.items()}, mode), lookup({m: v[1] for m, v in SPACING.items()}, mode)


def view_preset(mode: Column) -> Column:
    """What setting a view mode sets besides: continuous lays single pages without space or turn, paged gives the spaces back."""
    continuous = mode == "continuous"
    return F.struct(
        F.when(continuous, "single-page").alias("layout_mode"), F.when(continuous, "continuous").alias("scroll_mode"), F.when(continuous, "none").otherwise("all").alias("spacing_mode"),
        F.when(continuous, 0).otherwise(20).alias("page_spacing"), F.when(continuous, 0).otherwise(20).alias("spread_spacing"), F.when(continuous, 0).alias("rotation"),
    )


def layout_changes(states: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each state what it asks for after the one before: layout_changed, clear_spreads, restore_position, scroll_to_page."""
    by = W.partitionBy(*keys).orderBy(order)
    first = F.row_number().over(by) == 1

    def changed(columns: tuple[str, ...]) -> Column:
        present = [c for c in columns if c in states.columns]
        now = F.struct(*present)
        return first | ~now.eqNullSafe(F.struct(*(F.lag(c).over(by).alias(c) for c in present)))

    spreads, zoom = changed(STRUCTURE), changed((ZOOM_MODE,))
    moved = spreads | zoom | changed(PLACEMENT)
    return states.withColumns({"layout_changed": moved, "clear_spreads": spreads, "restore_position": moved & ~spreads & ~zoom, "scroll_to_page": spreads | zoom})


def group_visibility(groups: DataFrame, changes: DataFrame, key: str = "group_id") -> DataFrame:
    """Groups with the visibility of their last change."""
    last = changes.groupBy(key).agg(F.max_by("visible", "seq").alias("__v"))
    return groups.join(last, key, "left").withColumn("visible", F.coalesce("__v", "visible")).drop("__v")


def is_flat(runs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, flat: decided by the first run that is moved by its transform (flat) or has glyphs (not); without either not flat."""
    away = F.lit(False)
    for column, rest in (("scale_x", 1), ("scale_y", 1), ("skew_x", 0), ("skew_y", 0), ("tx", 0), ("ty", 0)):
        away = away | (F.abs(F.col(column) - rest) > 0.001)
    decides = F.when(away, True).when(F.col("kind") == "glyphs", False)
    decided = runs.withColumn("__d", decides)
    return decided.groupBy(*keys).agg(F.coalesce(F.min_by("__d", F.when(F.col("__d").isNotNull(), F.col(order))), F.lit(False)).alias("flat"))


def undo_redo(log: DataFrame, key: str, order: str, depth: int = 50) -> DataFrame:
    """key, undo, redo: the stacks (entry numbers, newest last) after a log of edit, undo and redo. An edit empties the redo stack.

    What undo takes off depends on all before it, so this is a fold; its state is the two stacks, `depth` entries each.
    """
    steps = log.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "action", "entry"))).alias("steps"))
    none = F.array().cast("array<bigint>")
    top = lambda stack: F.slice(stack, F.size(stack), F.lit(1))
    rest = lambda stack: F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
    pick = lambda s, stack: F.when(F.size(stack) > 0, top(stack)).otherwise(none)
    last = lambda stack: F.slice(stack, F.greatest(F.size(stack) - depth + 1, F.lit(1)), F.lit(depth))

    def step(a: Column, s: Column) -> Column:
        undo, redo = a["undo"], a["redo"]
        return (
            F.when(s["action"] == "undo", F.struct(rest(undo).alias("undo"), F.concat(redo, pick(s, undo)).alias("redo")))
            .when(s["action"] == "redo", F.struct(F.concat(undo, pick(s, redo)).alias("undo"), rest(redo).alias("redo")))
            .otherwise(F.struct(last(F.array_append(undo, s["entry"])).alias("undo"), none.alias("redo")))
        )

    return steps.select(key, F.aggregate("steps", F.struct(none.alias("undo"), none.alias("redo")), step).alias("s")).select(key, "s.undo", "s.redo")


def font_rows(usage: DataFrame, key: str) -> DataFrame:
    """One row for the resolved font and each fallback, with its label. usage: key, typeface, resolved, fallbacks (structs of family, bold, italic)."""
    every = usage.select(key, "typeface", F.posexplode(F.concat(F.array("resolved"), "fallbacks")).alias("rank", "font"))
    label = F.concat(F.coalesce("font.family", "typeface"), F.when(F.col("font.bold"), " Bold").otherwise(""), F.when(F.col("font.italic"), " Italic").otherwise(""))
    return every.select(key, "rank", (F.col("rank") == 0).alias("is_primary"), label.alias("label"))


def toggled(disabled: Column, names: Column, off: Column) -> Column:
    """A set of disabled names after some are switched off, or on again."""
    return F.array_sort(F.when(off, F.array_union(disabled, names)).otherwise(F.array_except(disabled, names)))


def active_match(n_matches: Column, active: Column, reset: Column) -> Column:
    """The active match after a search result came: the first after a reset, else the same place within the matches; -1 without matches."""
    return F.when(n_matches == 0, -1).when(reset | (active < 0), 0).otherwise(F.least(active, n_matches - 1))


def ease(t: Column) -> Column:
    """Quadratic easing in and out."""
    return F.when(t < 0.5, 2 * t * t).otherwise(1 - (2 - 2 * t) * (2 - 2 * t) / 2)


def border_pixels(eighths: Column, scale: float) -> Column:
    """Thickness of a border in whole pixels, one at least."""
    return F.greatest(eighths / 8.0 * scale, F.lit(1.0)).cast("int")


def tab_split(text: Column) -> tuple[Column, Column]:
    """What stands before the last tab (other tabs as spaces) and after it; without a tab all stands after."""
    tabbed = F.contains(text, F.lit("\t"))
    right = F.substring_index(text, "\t", -1)
    left = F.when(tabbed, F.replace(F.substring(text, F.lit(1), F.length(text) - F.length(right) - 1), F.lit("\t"), F.lit(" "))).otherwise("")
    return left, right


def page_info(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each page: uniform size, not turned. documents: key, page_count, page_w, page_h."""
    return documents.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("page_count") - 1)).alias("page_index"), F.col("page_w").alias("width"), F.col("page_h").alias("height"), F.lit(0).alias("rotation"))


def page_groups(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """The one group of a document's pages, in a row."""
    return documents.select(key, F.lit(0).alias("group_id"), F.lit(0).cast("long").alias("start"), F.col("page_count").alias("count"), F.lit("linear").alias("layout"))
