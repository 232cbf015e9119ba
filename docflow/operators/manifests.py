"""Page ranges, and plans for composing and splitting documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _number(text: Column) -> Column:
    """The whole number a text begins with (white space before it and anything after are let be), else null."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1), F.lit("")).try_cast("bigint")


def normalized_pages(pages: Column) -> Column:
    """Page numbers (array) as a list that `parse_page_range` reads; an empty array gives an empty text, a null one null."""
    return F.array_join(F.transform(pages, lambda p: p.cast("string")), ",")


def sheet_label(name: Column, index: Column) -> Column:
    """The name of a group of pages, or "Sheet" and its number from 1 where it has none."""
    return F.coalesce(name, F.concat(F.lit("Sheet "), (index + 1).cast("string")))


def parse_page_range(spec: Column, pages: Column) -> Column:
    """Pages of a list such as "1,3,5-8", ascending without repeats; null if any part is bad or there is none."""
    parts = F.filter(F.transform(F.split(spec, ",", -1), lambda p: F.trim(p)), lambda p: p != "")

    def bounds(part: Column) -> Column:
        ends = F.split(part, "-", -1)
        first, last = _number(ends[0]), _number(F.element_at(ends, -1))
        good = (F.size(ends) <= 2) & first.between(1, pages) & last.between(1, pages) & (first <= last)
        return F.when(good, F.struct(first.alias("a"), last.alias("b")))

    ranges = F.transform(parts, bounds)
    bad = F.exists(ranges, lambda r: r.isNull()) | (F.size(parts) == 0)
    every = F.flatten(F.transform(ranges, lambda r: F.sequence(r["a"], r["b"])))
    return F.when(~bad, F.array_sort(F.array_distinct(every)))


def compose(picks: DataFrame, key: str, order: str, source: str, pages: str, rotation: str) -> DataFrame:
    """key, out_index, doc_index, source, page_index, rotation: the pages of a composition in order.

    picks: an array of page indices each. Sources are numbered by their first use.
    """
    first = picks.groupBy(key, source).agg(F.min(order).alias("__first"))
    numbered = first.withColumn("doc_index", F.row_number().over(W.partitionBy(key).orderBy("__first")).cast("long") - 1).drop("__first")
    every = picks.select(key, order, source, rotation, F.posexplode(pages).alias("__pos", "page_index"))
    out = F.row_number().over(W.partitionBy(key).orderBy(order, "__pos")).cast("long") - 1
    return every.withColumn("out_index", out).join(numbered, [key, source]).select(key, "out_index", "doc_index", source, "page_index", rotation)


def split_by_outline(outline: DataFrame, documents: DataFrame, key: str = "doc_id", max_level: int = 1) -> DataFrame:
    """key, part, title, first_page, last_page: from each entry of the upper levels to the page before the next one's.

    An entry that starts on the same page as the one before takes over that part; pages before the first entry form a part without title.
    """
    upper = outline.where(F.col("depth") < max_level)
    starts = upper.groupBy(key, F.col("page").alias("first_page")).agg(F.max_by("title", "idx").alias("title"))
    front = documents.select(key, F.lit(0).cast("long").alias("first_page"), F.lit(None).cast("string").alias("title")).join(starts.where("first_page = 0").select(key), key, "left_anti")
    every = starts.select(key, "first_page", "title").unionByName(front).join(documents, key)
    by = W.partitionBy(key).orderBy("first_page")
    return every.select(key, (F.row_number().over(by).cast("long") - 1).alias("part"), "title", "first_page", (F.coalesce(F.lead("first_page").over(by), F.col("page_count")) - 1).alias("last_page"))


def selected_pages(requests: DataFrame, key: str) -> DataFrame:
    """key, page_index of print requests: kind all, current, fromTo (from, to from 1, clamped) or custom (pages from 1, those in the document)."""
    last = F.col("page_count") - 1
    low, high = F.greatest(F.col("from") - 1, F.lit(0)), F.least(F.col("to") - 1, last)
    whole = lambda a, b: F.when(a <= b, F.sequence(a.cast("long"), b.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    chosen = (
        F.when(F.col("kind") == "all", whole(F.lit(0), last))
        .when(F.col("kind") == "current", F.array((F.col("current") - 1).cast("long")))
        .when(F.col("kind") == "fromTo", whole(low, high))
        .otherwise(F.filter(F.transform("pages", lambda p: (p - 1).cast("long")), lambda p: p.between(0, last)))
    )
    return requests.select(key, F.explode(F.array_distinct(chosen)).alias("page_index"))
