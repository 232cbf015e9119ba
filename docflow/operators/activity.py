"""What happened in a viewer: timings, caches, queues, edits and loads, as sums, joins and windows over event logs.

Windows are partitioned by client (or document), never by an event's type alone, so that no type's rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNDO_DEPTH, COALESCE_MS, THROTTLE_MS = 50, 300, 500
BOOST_RANGE = 5
#: Order of work kinds on one page; what is not listed comes last.
WORK_ORDER = {"preview": 0, "page": 1, "annotation": 2, "text": 3}
LAST_KIND, THUMBNAIL = "fontUsageCheck", "thumbnail"
# What messages of exhausted memory contain.
OUT_OF_MEMORY = ("out of memory", "allocation failed", "memory access out of bounds", "unreachable executed", "RuntimeError")


def is_out_of_memory(message: Column) -> Column:
    return F.coalesce(F.regexp_like(message, F.lit("(?i)" + "|".join(OUT_OF_MEMORY))), F.lit(False))


def summary(ends: DataFrame, kind: str, duration: str) -> DataFrame:
    """Per kind: count, total, mean, least and most of the known durations."""
    some = ends.where(F.col(duration).isNotNull())
    d = F.col(duration)
    return some.groupBy(kind).agg(F.count("*").alias("count"), F.round(F.sum(d), 6).alias("total"), F.round(F.avg(d), 6).alias("avg"), F.min(d).alias("min"), F.max(d).alias("max"))


def pairs(starts: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """Starts with their ends; an end without a start is dropped."""
    return starts.join(ends, key)


def pending(starts: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    return starts.join(ends.select(key), key, "left_anti")


def cache_stats(entries: DataFrame, kind: str, size: Column) -> DataFrame:
    """Entries and bytes per kind, and over all (kind null)."""
    return entries.withColumn("__bytes", size).rollup(kind).agg(F.count("*").alias("entries"), F.sum("__bytes").alias("bytes"))


def evicted(entries: DataFrame, keys: list[str], recent: list[Column], size: str, budget: int) -> DataFrame:
    """The entries that do not fit a budget when the most recently used are kept first; with their running total."""
    newest = W.partitionBy(*keys).orderBy(*recent).rowsBetween(W.unboundedPreceding, 0)
    return entries.withColumn("running", F.sum(size).over(newest)).where(F.col("running") > budget)


def least_recent(entries: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The next victim of each cache: least recently used, first inserted on ties."""
    return entries.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("victim"))


def changes(events: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """Only the rows whose payload differs from the one before."""
    by = W.partitionBy(*keys).orderBy(*order)
    now = F.struct(*payload)
    return events.withColumn("__now", now).withColumn("__before", F.lag("__now").over(by)).where(~F.col("__now").eqNullSafe(F.col("__before"))).drop("__now", "__before")


def undo_entries(edits: DataFrame, key: str, page: str, ms: str, order: list[str], within: int = COALESCE_MS, depth: int = UNDO_DEPTH) -> DataFrame:
    """The undo stack that a log of edits leaves: an edit of the same page within the time joins the entry before; the newest depth entries stay.

    key, entry (from 1), page, first_ms, last_ms, n_edits, age (1: newest).
    """
    by = W.partitionBy(key).orderBy(*order)
    apart = F.lag(page).over(by).isNull() | (F.lag(page).over(by) != F.col(page)) | (F.col(ms) - F.lag(ms).over(by) >= within)
    islands = edits.withColumn("entry", F.sum(apart.cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    entries = islands.groupBy(key, "entry").agg(F.min(page).alias(page), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"), F.count("*").alias("n_edits"))
    return entries.withColumn("age", F.row_number().over(W.partitionBy(key).orderBy(F.desc("entry")))).where(F.col("age") <= depth)


def queue_order(queue: DataFrame, client: str, seq: str) -> DataFrame:
    """Position of each piece of work: thumbnails after all else, the font check last of the rest, near the focus first, then by kind, then as it came.

    queue: client, seq, kind, doc, page, focus_doc, focus_page, thumb_doc, thumb_page (a null focus is infinitely far).
    """
    thumb = F.col("kind") == THUMBNAIL
    far = F.lit(float("inf"))
    distance = lambda d, p: F.coalesce(F.when(F.col("doc") == F.col(d), F.abs(F.col("page") - F.col(p)).cast("double")), far)
    away = F.when(thumb, distance("thumb_doc", "thumb_page")).otherwise(distance("focus_doc", "focus_page"))
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in WORK_ORDER.items() for x in pair)), F.col("kind")), F.lit(4))
    keys = [thumb.cast("int"), (F.col("kind") == LAST_KIND).cast("int"), F.when(thumb, 0).otherwise((away > BOOST_RANGE).cast("int")), away, F.when(thumb, 0).otherwise(rank), F.col(seq)]
    return queue.withColumn("position", F.row_number().over(W.partitionBy(client).orderBy(*keys)))


def deduplicated_work(queue: DataFrame, keys: list[str], seq: str, scale: str) -> DataFrame:
    """One piece of queued work for each key, at the newest scale, in the place of the first."""
    return queue.groupBy(*keys).agg(F.min(seq).alias("first_seq"), F.max_by(scale, seq).alias(scale), F.count("*").alias("requests"))


def latest_state(events: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.max_by(state, order).alias(state))


def pages_to_load(focus: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """The current page and, in double mode, its neighbours, within the document, that are not known yet."""
    offsets = F.when(F.col("double_page"), F.array(F.lit(0), F.lit(-1), F.lit(1))).otherwise(F.array(F.lit(0)))
    moved = focus.select(key, "page_count", "page", F.explode(offsets).alias("offset"))
    wanted = moved.withColumn("page_index", F.col("page") + F.col("offset")).where(F.col("page_index").between(0, F.col("page_count") - 1)).select(key, "page_index")
    return wanted.join(known.select(key, "page_index"), [key, "page_index"], "left_anti")


def all_loaded(documents: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, loaded, complete: whether every page of a document(key, page_count) is known. A document without pages is never complete."""
    pages = known.groupBy(key).agg(F.count_distinct("page_index").alias("loaded"))
    found = documents.join(pages, key, "left").withColumn("loaded", F.coalesce("loaded", F.lit(0)).cast("long"))
    return found.select(key, "loaded", ((F.col("page_count") > 0) & (F.col("loaded") >= F.col("page_count"))).alias("complete"))


def throttled(events: DataFrame, key: str, ms: str, every: int = THROTTLE_MS) -> DataFrame:
    """The events that pass a throttle: one, then none until `every` ms have gone since it.

    A gap of that length resets the throttle whatever came before, so the fold runs within such sessions only.
    """
    by = W.partitionBy(key).orderBy(ms)
    opens = F.coalesce(F.col(ms) - F.lag(ms).over(by) >= every, F.lit(True)).cast("int")
    sessions = events.withColumn("__session", F.sum(opens).over(by.rowsBetween(W.unboundedPreceding, 0)))
    folded = sessions.groupBy(key, "__session").agg(F.array_sort(F.collect_list(ms)).alias("t"))
    start = F.array().cast("array<bigint>")
    passed = F.aggregate("t", start, lambda a, t: F.when((F.size(a) == 0) | (t - F.coalesce(F.try_element_at(a, F.lit(-1)), t) >= every), F.array_append(a, t)).otherwise(a))
    return folded.select(key, F.explode(passed).alias(ms))


def progress(chunks: DataFrame, key: str, order: str, size: str, total: str) -> DataFrame:
    """Bytes loaded after each chunk and the percentage, null where the total is not known."""
    loaded = F.sum(size).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    percent = F.when(F.col(total) > 0, F.floor(loaded / F.col(total) * 100 + 0.5))
    return chunks.select(key, order, loaded.alias("loaded"), percent.alias("percent"))


def batch_notifications(actions: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """One notification for each batch: the state before its first action and after its last."""
    return actions.groupBy(*keys).agg(F.min_by(f"{state}_before", order).alias("before"), F.max_by(f"{state}_after", order).alias("after"), F.count("*").alias("n_actions"))


def newest_generation(events: DataFrame, key: str, generation: str) -> DataFrame:
    """Rows of the newest generation of each key; older answers are stale."""
    newest = events.groupBy(key).agg(F.max(generation).alias(generation))
    return events.join(newest, [key, generation], "left_semi")
