"""Full-text search over page texts: exact and normalised matching, overlapping hits, offsets, snippets, highlight boxes.

Offsets count code points. A page that lacks the query is dropped before any text is taken apart; pages are independent,
so search never shuffles.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Characters that normalised search leaves out - white space and separators, and list markers.
SEPARATORS = " \t\n\r|￼ ﻿​‌‍  " + "".join(map(chr, range(0x20)))
LIST_MARKERS = "•·‣⁃∙▪▫■□○●◦◆◇▶▷★☆❖⬥⬦"
# Typographic punctuation and what users type instead.
FOLDS = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "″": '"', "–": "-", "—": "-", "−": "-", "­": "-"}
#: White space as snippets see it.
BLANK = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
DROPPED = "".join(dict.fromkeys(SEPARATORS + LIST_MARKERS))
DROPPED_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in DROPPED) + "]"
CONTEXT_CHARS, CONTEXT_WORDS = 30, 3


def normalize(text: Column) -> Column:
    """text without separators and list markers, with typographic punctuation folded."""
    return F.translate(F.regexp_replace(text, DROPPED_CLASS, ""), "".join(FOLDS), "".join(FOLDS.values()))


def normalized_query(query: str) -> str:
    return "".join(FOLDS.get(c, c) for c in query if c not in DROPPED)


def kept_positions(text: Column) -> Column:
    """For each character of normalize(text) its position in text."""
    return F.filter(F.transform(F.split(text, "", -1), lambda c, i: F.when((c != "") & ~F.regexp_like(c, F.lit(DROPPED_CLASS)), i)), lambda p: p.isNotNull())


def occurrences(text: Column, needle: str) -> Column:
    """Offsets of all, also overlapping, occurrences: the text is cut in front of each, and the pieces' lengths add up."""
    pieces = F.split(text, f"(?={re.escape(needle)})", -1)
    lengths = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"] + n).alias("out"))
    later = F.aggregate(lengths, start, step, lambda a: a["out"])
    return F.when(F.startswith(text, F.lit(needle)), F.concat(F.array(F.lit(0)), later)).otherwise(later)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+", -1), lambda w: w != "")


def last_words(text: Column, n: int) -> Column:
    words = _words(text)
    tail = F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.lit(n)), " ")
    ending = F.when(F.regexp_like(F.substring(text, -1, 1), F.lit(BLANK)), F.substring(text, -1, 1)).otherwise("")
    return F.when(F.size(words) <= n, text).otherwise(F.concat(tail, ending))


def first_words(text: Column, n: int) -> Column:
    words = _words(text)
    head = F.array_join(F.slice(words, F.lit(1), F.lit(n)), " ")
    beginning = F.when(F.regexp_like(F.substring(text, 1, 1), F.lit(BLANK)), F.substring(text, 1, 1)).otherwise("")
    return F.when(F.size(words) <= n, text).otherwise(F.concat(beginning, head))


def snippet(text: Column, offset: Column, length: Column) -> tuple[Column, Column, Column]:
    """What stands before the match, the match, and what follows, at most a line and three words on either side."""
    before = F.substring_index(F.substring(text, F.greatest(offset - CONTEXT_CHARS, F.lit(0)) + 1, F.least(offset, F.lit(CONTEXT_CHARS))), "\n", -1)
    after = F.substring_index(F.substring(text, offset + length + 1, F.lit(CONTEXT_CHARS)), "\n", 1)
    short_before, short_after = last_words(before, CONTEXT_WORDS), first_words(after, CONTEXT_WORDS)
    return (
        F.concat(F.when(F.length(short_before) < F.length(before), "…").otherwise(""), short_before),
        F.substring(text, offset + 1, length),
        F.concat(short_after, F.when(F.length(short_after) < F.length(after), "…").otherwise("")),
    )


def search(pages: DataFrame, query: str, case_sensitive: bool = False, page_range: tuple[int, int] | None = None, fuzzy: bool = False, page: str = "page_index", text: str = "text", context: bool = False) -> DataFrame:
    """One row for each match: the columns of pages but text, char_offset, length, and with context before, match, after.

    A blank query finds nothing. page_range is inclusive. Fuzzy search compares normalised texts and maps matches back.
    """
    rest = [c for c in pages.columns if c != text]
    needle = normalized_query(query) if fuzzy else query
    needle = needle if case_sensitive else needle.lower()
    if page_range:
        pages = pages.where(F.col(page).between(*page_range))
    if not query.strip() or not needle:
        pages, needle = pages.where(F.lit(False)), needle or " "
    cased = F.col(text) if case_sensitive else F.lower(text)
    if fuzzy:
        hit = pages.withColumn("__cased", cased).withColumn("__plain", normalize(F.col("__cased"))).where(F.contains("__plain", F.lit(needle))).withColumn("__kept", kept_positions(F.col("__cased")))
        found = hit.select(*rest, text, "__kept", F.explode(occurrences(F.col("__plain"), needle)).alias("__at"))
        first, last = F.element_at("__kept", F.col("__at") + 1), F.element_at("__kept", F.col("__at") + len(needle))
        found = found.withColumn("char_offset", first).withColumn("length", last - first + 1)
    else:
        hit = pages.withColumn("__cased", cased).where(F.contains("__cased", F.lit(needle)))
        found = hit.select(*rest, text, F.explode(occurrences(F.col("__cased"), needle)).alias("char_offset")).withColumn("length", F.lit(len(needle)))
    if context:
        before, match, after = snippet(F.col(text), F.col("char_offset"), F.col("length"))
        found = found.withColumns({"before": before, "match": match, "after": after})
    return found.select(*rest, "char_offset", "length", *(["before", "match", "after"] if context else []))


RUN = "struct<text:string,font_size:double,scale_x:double,skew_x:double,skew_y:double,scale_y:double,tx:double,ty:double,glyphs:array<struct<x:double,advance:double>>>"


def page_text(runs: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Text of each page: the runs' texts in order; runs without text or glyphs are left out."""
    kept = runs.where((F.coalesce(F.length("text"), F.lit(0)) > 0) & (F.coalesce(F.size("glyphs"), F.lit(0)) > 0) if "glyphs" in runs.columns else F.coalesce(F.length("text"), F.lit(0)) > 0)
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda r: r["text"]), "").alias("text"))


def match_rects(glyphs: Column) -> Column:
    """Boxes of a match: array<struct<x, y, width, height, angle>>.

    glyphs: array<struct<x, y, advance, font_size, angle>> in page space, angle in radians. A glyph joins the current box
    while its angle differs from the box's by less than half a degree and its baseline lies within half of the larger font
    size of the box's first baseline; so this is a fold over the glyphs, not a comparison of neighbours.
    """
    box = "struct<x:double,y:double,along:double,size:double,angle:double>"
    empty = F.struct(F.array().cast(f"array<{box}>").alias("done"), F.lit(None).cast(box).alias("now"))

    def step(a: Column, g: Column) -> Column:
        now = a["now"]
        dx, dy = g["x"] - now["x"], g["y"] - now["y"]
        apart = F.abs(-F.sin(now["angle"]) * dx + F.cos(now["angle"]) * dy)
        joins = now.isNotNull() & (F.abs(g["angle"] - now["angle"]) * (180 / math.pi) < 0.5) & (apart < F.greatest(now["size"], g["font_size"]) * 0.5)
        along = F.cos(now["angle"]) * dx + F.sin(now["angle"]) * dy + g["advance"]
        longer = F.struct(now["x"].alias("x"), now["y"].alias("y"), F.greatest(now["along"], along).alias("along"), F.greatest(now["size"], g["font_size"]).alias("size"), now["angle"].alias("angle"))
        fresh = F.struct(g["x"].alias("x"), g["y"].alias("y"), g["advance"].alias("along"), g["font_size"].alias("size"), g["angle"].alias("angle"))
        done = F.when(joins | now.isNull(), a["done"]).otherwise(F.array_append(a["done"], now))
        return F.struct(done.alias("done"), F.when(joins, longer).otherwise(fresh).alias("now"))

    boxes = F.aggregate(glyphs, empty, step, lambda a: F.when(a["now"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["now"])))
    place = lambda b: F.struct((b["x"] + F.sin(b["angle"]) * b["size"] * 0.8).alias("x"), (b["y"] - F.cos(b["angle"]) * b["size"] * 0.8).alias("y"), b["along"].alias("width"), b["size"].alias("height"), (b["angle"] * (180 / math.pi)).alias("angle"))
    return F.transform(boxes, place)


def page_counts(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Matches per page."""
    return matches.groupBy(*keys).agg(F.count("*").alias("n_matches"))


def visible_highlights(matches: DataFrame, ranges: DataFrame, key: str = "doc_id", page: str = "page_index") -> DataFrame:
    """The matches on pages in view, with rank (from 0 within the document's matches) and active. ranges: key, first_page, last_page, active_index."""
    by = W.partitionBy(key).orderBy(page, "char_offset")
    ranked = matches.withColumn("rank", (F.row_number().over(by) - 1).cast("long"))
    seen = ranked.join(ranges, key).where(F.col(page).between(F.col("first_page"), F.col("last_page")))
    return seen.withColumn("active", F.coalesce(F.col("rank") == F.col("active_index"), F.lit(False))).drop("first_page", "last_page", "active_index")


def neighbours(index: Column, total: Column) -> tuple[Column, Column]:
    """Next and previous match, going round."""
    return F.pmod(index + 1, total), F.pmod(index - 1, total)
