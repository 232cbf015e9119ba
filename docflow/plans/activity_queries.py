"""Timing, cache, queue, edit and composition queries over the events and orders tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.operators import activity as A
from docflow.operators import manifests as M
from docflow.plans.registry import query, table


#: Milliseconds of a time stamp without zone, whatever the session's zone.
MS = "cast(floor(cast(cast(ts - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS interval second) AS decimal(24, 6)) * 1000) AS bigint)"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("page"), F.expr(MS).alias("ms"))


EVENTS = "e AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS page, epoch_us(ts) // 1000 AS ms FROM events)"


@query("SELECT event_type, count(*) AS count, round(sum(value), 6) AS total, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY 1")
def perf_summary(spark, sf_dir):
    return A.summary(events(spark, sf_dir), "event_type", "value")


_PAIRS = f"""{EVENTS}, s AS (SELECT event_id // 2 AS op, event_type, ms AS start_ms FROM e WHERE event_id % 2 = 0), f AS (SELECT event_id // 2 AS op, ms AS end_ms, value FROM e WHERE event_id % 2 = 1 AND value < 150)"""


def _log(spark, sf_dir):
    log = events(spark, sf_dir).withColumn("op", F.floor(F.col("event_id") / 2))
    return log.where("event_id % 2 = 0").select("op", "event_type", F.col("ms").alias("start_ms")), log.where("event_id % 2 = 1 AND value < 150").select("op", F.col("ms").alias("end_ms"), "value")


@query(f"WITH {_PAIRS} SELECT op, event_type, start_ms, end_ms, value, end_ms - start_ms AS duration_ms FROM s JOIN f USING (op)")
def perf_pairs(spark, sf_dir):
    return A.pairs(*_log(spark, sf_dir), "op").withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


@query(f"WITH {_PAIRS} SELECT op, event_type, start_ms FROM s ANTI JOIN f USING (op)")
def perf_pending(spark, sf_dir):
    return A.pending(*_log(spark, sf_dir), "op")


@query(f"WITH {EVENTS} SELECT event_type, count(*) AS entries, CAST(sum((page + 1) * (event_id % 50 + 1) * 4) AS BIGINT) AS bytes FROM e GROUP BY ROLLUP (event_type)")
def perf_cache_rollup(spark, sf_dir):
    return A.cache_stats(events(spark, sf_dir), "event_type", (F.col("page") + 1) * (F.col("event_id") % 50 + 1) * 4)


@query(f"WITH {EVENTS}, b AS (SELECT *, (page + 1) * 4 AS bytes FROM e), r AS (SELECT *, CAST(sum(bytes) OVER (PARTITION BY user_id, event_type ORDER BY ms DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM b) SELECT user_id, event_type, event_id, bytes, running FROM r WHERE running > 1000")
def cache_evicted(spark, sf_dir):
    entries = events(spark, sf_dir).withColumn("bytes", (F.col("page") + 1) * 4)
    return A.evicted(entries, ["user_id", "event_type"], [F.desc("ms"), F.desc("event_id")], "bytes", 1000).select("user_id", "event_type", "event_id", "bytes", "running")


@query(f"WITH {EVENTS}, l AS (SELECT user_id, event_type, page, max(ms) AS used, min(event_id) AS inserted FROM e GROUP BY ALL) SELECT user_id, event_type, arg_min(page, (used, inserted)) AS victim FROM l GROUP BY 1, 2")
def lru_victims(spark, sf_dir):
    last = events(spark, sf_dir).groupBy("user_id", "event_type", "page").agg(F.max("ms").alias("used"), F.min("event_id").alias("inserted"))
    return A.least_recent(last, ["user_id", "event_type"], ["used", "inserted"], "page")


@query(f"WITH {EVENTS}, g AS (SELECT *, lag(event_type) OVER w AS before, lag(page // 25) OVER w AS pb FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)) SELECT user_id, event_id, event_type, page // 25 AS zone FROM g WHERE event_type IS DISTINCT FROM before OR page // 25 IS DISTINCT FROM pb")
def viewport_change_dedup(spark, sf_dir):
    zoned = events(spark, sf_dir).withColumn("zone", F.floor(F.col("page") / 25))
    return A.changes(zoned, ["user_id"], ["ms", "event_id"], ["event_type", "zone"]).select("user_id", "event_id", "event_type", "zone")


_UNDO = f"""{EVENTS}, p AS (SELECT *, page // 34 AS part FROM e), m AS (SELECT *, lag(part) OVER w AS lp, lag(ms) OVER w AS lm FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
    i AS (SELECT *, sum(CASE WHEN lp IS NULL OR lp <> part OR ms - lm >= 86400000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS entry FROM m),
    u AS (SELECT user_id, CAST(entry AS BIGINT) AS entry, min(part) AS part, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS n_edits FROM i GROUP BY ALL)"""


def _undo(spark, sf_dir, depth):
    parts = events(spark, sf_dir).withColumn("part", F.floor(F.col("page") / 34))
    return A.undo_entries(parts, "user_id", "part", "ms", ["ms", "event_id"], within=86_400_000, depth=depth)


@query(f"WITH {_UNDO} SELECT * FROM u")
def undo_coalesce(spark, sf_dir):
    return _undo(spark, sf_dir, 1 << 60).drop("age")


@query(f"WITH {_UNDO}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY entry DESC) AS age FROM u) SELECT * FROM a WHERE age <= 20")
def undo_top(spark, sf_dir):
    return _undo(spark, sf_dir, 20)


_KINDS = {"click": "preview", "view": "page", "purchase": "annotation", "signup": "text", "error": "thumbnail"}
_QUEUE = f"""{EVENTS}, q AS (SELECT user_id, event_id, page, event_id % 3 AS doc, CASE WHEN event_id % 17 = 0 THEN 'fontUsageCheck' ELSE CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items())} END END AS kind FROM e)"""


def queue(spark, sf_dir):
    kind = F.element_at(F.create_map(*(F.lit(x) for p in _KINDS.items() for x in p)), F.col("event_type"))
    return events(spark, sf_dir).select("user_id", "event_id", "page", (F.col("event_id") % 3).alias("doc"), F.when(F.col("event_id") % 17 == 0, "fontUsageCheck").otherwise(kind).alias("kind"))


@query(f"""WITH {_QUEUE}, d AS (SELECT *, CASE WHEN doc = 1 THEN CASE WHEN kind = 'thumbnail' THEN abs(page - 10) ELSE abs(page - 50) END ELSE 1e9 END AS away FROM q)
    SELECT user_id, event_id, kind, row_number() OVER (PARTITION BY user_id ORDER BY kind = 'thumbnail', kind = 'fontUsageCheck', CASE WHEN kind = 'thumbnail' THEN false ELSE away > 5 END, away,
        CASE kind WHEN 'preview' THEN 0 WHEN 'page' THEN 1 WHEN 'annotation' THEN 2 WHEN 'text' THEN 3 WHEN 'thumbnail' THEN 0 ELSE 4 END, event_id) AS position FROM d""")
def queue_order(spark, sf_dir):
    focused = queue(spark, sf_dir).withColumns({"focus_doc": F.lit(1), "focus_page": F.lit(50), "thumb_doc": F.lit(1), "thumb_page": F.lit(10)})
    return A.queue_order(focused, "user_id", "event_id").select("user_id", "event_id", "kind", "position")


@query(f"WITH {_QUEUE} SELECT user_id, kind, doc, page, min(event_id) AS first_seq, arg_max(event_id % 7, event_id) AS scale, count(*) AS requests FROM q GROUP BY 1, 2, 3, 4")
def queue_dedup(spark, sf_dir):
    return A.deduplicated_work(queue(spark, sf_dir).withColumn("scale", F.col("event_id") % 7), ["user_id", "kind", "doc", "page"], "event_id", "scale")


@query(f"WITH {EVENTS} SELECT user_id, page, arg_max(event_type, event_id) AS event_type FROM e GROUP BY 1, 2")
def page_load_state(spark, sf_dir):
    return A.latest_state(events(spark, sf_dir), ["user_id", "page"], "event_id", "event_type")


@query(f"""WITH {EVENTS}, f AS (SELECT user_id AS doc_id, arg_max(page, event_id) AS page FROM e GROUP BY 1), o AS (SELECT doc_id, page + unnest(CASE WHEN doc_id % 2 = 0 THEN [0, -1, 1] ELSE [0] END) AS page_index FROM f)
    SELECT doc_id, page_index FROM o WHERE page_index BETWEEN 0 AND 99 AND NOT EXISTS (SELECT 1 FROM e WHERE user_id = doc_id AND e.page = page_index AND event_type = 'view')""")
def pages_to_load(spark, sf_dir):
    log = events(spark, sf_dir)
    focus = log.groupBy(F.col("user_id").alias("doc_id")).agg(F.max_by("page", "event_id").alias("page")).withColumns({"page_count": F.lit(100), "double_page": F.col("doc_id") % 2 == 0})
    return A.pages_to_load(focus, log.where("event_type = 'view'").select(F.col("user_id").alias("doc_id"), F.col("page").alias("page_index")))


@query(f"""WITH RECURSIVE {EVENTS}, o AS (SELECT user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms) AS k FROM e),
    t AS (SELECT user_id, k, ms, ms AS passed FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, o.ms, CASE WHEN o.ms - t.passed >= 21600000 THEN o.ms ELSE t.passed END FROM t JOIN o ON o.user_id = t.user_id AND o.k = t.k + 1)
    SELECT DISTINCT user_id, passed AS ms FROM t""")
def throttled_clears(spark, sf_dir):
    return A.throttled(events(spark, sf_dir), "user_id", "ms", 21_600_000)


@query(f"""WITH {EVENTS} SELECT user_id, event_id, CAST(sum(page) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS loaded,
    CASE WHEN user_id % 5 > 0 THEN CAST(floor(sum(page) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) / 10000.0 * 100 + 0.5) AS BIGINT) END AS percent FROM e""")
def load_progress(spark, sf_dir):
    chunks = events(spark, sf_dir).withColumn("total", F.when(F.col("user_id") % 5 > 0, 10000))
    return A.progress(chunks, "user_id", "event_id", "page", "total")


@query(f"WITH {EVENTS} SELECT user_id, event_id // 20 AS batch, arg_min(page, event_id) AS before, arg_max(value, event_id) AS after, count(*) AS n_actions FROM e GROUP BY 1, 2")
def batched_notifications(spark, sf_dir):
    actions = events(spark, sf_dir).withColumns({"batch": F.floor(F.col("event_id") / 20), "s_before": F.col("page"), "s_after": F.col("value")})
    return A.batch_notifications(actions, ["user_id", "batch"], "event_id", "s")


@query(f"WITH {EVENTS}, g AS (SELECT user_id, event_id, event_id // 500 AS generation FROM e) SELECT user_id, event_id, generation FROM g WHERE (user_id, generation) IN (SELECT user_id, max(generation) FROM g GROUP BY 1)")
def stale_discard(spark, sf_dir):
    return A.newest_generation(events(spark, sf_dir).select("user_id", "event_id", F.floor(F.col("event_id") / 500).alias("generation")), "user_id", "generation")


_SPEC = """l_linenumber || '-' || (l_linenumber + l_suppkey % 5) || CASE WHEN l_partkey % 4 = 0 THEN ', ' || (l_partkey % 9) || 'x' WHEN l_partkey % 4 = 1 THEN ',,' || (l_partkey % 12) WHEN l_partkey % 4 = 2 THEN ',1-2-3' ELSE '' END"""


@query(f"""WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_SPEC} AS spec FROM lineitem), d AS (SELECT DISTINCT spec FROM i),
    p AS (SELECT spec, trim(unnest(string_split(spec, ','))) AS part FROM d), q AS (SELECT spec, string_split(part, '-') AS ends FROM p WHERE part <> ''),
    b AS (SELECT spec, len(ends) AS n, TRY_CAST(nullif(regexp_extract(ends[1], '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS a, TRY_CAST(nullif(regexp_extract(ends[-1], '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS b FROM q),
    g AS (SELECT *, coalesce(n <= 2 AND a BETWEEN 1 AND 10 AND b BETWEEN 1 AND 10 AND a <= b, false) AS good FROM b),
    r AS (SELECT spec, bool_and(good) AS good FROM g GROUP BY 1), x AS (SELECT DISTINCT spec, unnest(range(a, b + 1)) AS page FROM g WHERE spec IN (SELECT spec FROM r WHERE good)),
    o AS (SELECT spec, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS pages FROM x GROUP BY 1)
    SELECT d.spec, o.pages FROM d LEFT JOIN o USING (spec)""")
def page_range_parse(spark, sf_dir):
    specs = table(spark, sf_dir, "lineitem").select(F.expr(_SPEC).alias("spec")).distinct()
    return specs.select("spec", F.array_join(M.parse_page_range(F.col("spec"), F.lit(10)), ",").alias("pages"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority AS source, o_orderkey % 4 AS n, (o_orderkey % 4) * 90 AS rotation FROM orders),
    f AS (SELECT o_custkey, source, row_number() OVER (PARTITION BY o_custkey ORDER BY min(o_orderkey)) - 1 AS doc_index FROM o WHERE n > 0 OR n = 0 GROUP BY 1, 2),
    x AS (SELECT *, unnest(range(0, n)) AS page_index FROM o)
    SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, page_index) - 1 AS out_index, doc_index, source, page_index, rotation FROM x JOIN f USING (o_custkey, source)""")
def compose_manifest(spark, sf_dir):
    n = F.col("o_orderkey") % 4
    pages = F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    picks = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("source"), pages.alias("pages"), (n * 90).alias("rotation"))
    return M.compose(picks, "o_custkey", "o_orderkey", "source", "pages", "rotation")


@query("""WITH r AS (SELECT o_orderkey, ['all', 'current', 'fromTo', 'custom'][o_orderkey % 4 + 1] AS kind, o_custkey % 6 + 1 AS n FROM orders),
    x AS (SELECT o_orderkey, unnest(CASE kind WHEN 'all' THEN range(0, n) WHEN 'current' THEN [o_orderkey % n] WHEN 'fromTo' THEN range(1, least(4, n)) ELSE list_filter([0, 2, 4, 6], lambda p: p < n) END) AS page_index FROM r)
    SELECT DISTINCT * FROM x""")
def print_pages(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("all", "current", "fromTo", "custom")))
    n = F.col("o_custkey") % 6 + 1
    requests = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(kinds, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("kind"), n.alias("page_count"), (F.col("o_orderkey") % n + 1).alias("current"), F.lit(2).alias("from"), F.lit(4).alias("to"), F.array(*map(F.lit, (1, 3, 5, 7))).alias("pages"))
    return M.selected_pages(requests, "o_orderkey")


@query(f"""WITH {EVENTS}, k AS (SELECT user_id, count(DISTINCT page) AS loaded FROM e WHERE event_type = 'view' AND page IS NOT NULL GROUP BY 1), d AS (SELECT DISTINCT user_id, user_id % 4 AS page_count FROM e)
    SELECT user_id AS doc_id, coalesce(loaded, 0) AS loaded, page_count > 0 AND coalesce(loaded, 0) >= page_count AS complete FROM d LEFT JOIN k USING (user_id)""")
def all_pages_loaded(spark, sf_dir):
    log = events(spark, sf_dir)
    documents = log.select(F.col("user_id").alias("doc_id"), (F.col("user_id") % 4).alias("page_count")).distinct()
    return A.all_loaded(documents, log.where("event_type = 'view'").select(F.col("user_id").alias("doc_id"), F.col("page").alias("page_index")))


@query("""SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS pages, coalesce(CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE 'group ' || l_orderkey END, 'Sheet ' || (l_orderkey % 7 + 1)) AS label
    FROM lineitem GROUP BY l_orderkey""")
def pages_and_sheet_labels(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("numbers"))
    name = F.when(F.col("l_orderkey") % 3 != 0, F.concat(F.lit("group "), F.col("l_orderkey").cast("string")))
    return lines.select("l_orderkey", M.normalized_pages(F.col("numbers")).alias("pages"), M.sheet_label(name, F.col("l_orderkey") % 7).alias("label"))
