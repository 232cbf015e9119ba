"""Queries over viewer settings and small state, with events, parts and orders as their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.functions.labels import EDITABLE, lookup
from docflow.operators import activity as A
from docflow.operators import annotations as N
from docflow.operators import viewer as V
from docflow.plans.activity_queries import EVENTS, events
from docflow.plans.registry import query, table

_FORMATS = tuple(V.FORMAT_DEFAULTS)
_F = "[" + ", ".join(f"'{f}'" for f in _FORMATS) + "][p_partkey % 5 + 1]"
_CASE = lambda i: "CASE " + " ".join(f"WHEN f = '{f}' THEN '{v[i]}'" for f, v in V.FORMAT_DEFAULTS.items()) + " END"


def _pick(values, number):
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


@query(f"WITH p AS (SELECT p_partkey, {_F} AS f, CASE WHEN p_size % 3 = 0 THEN 'spread' END AS o FROM part) SELECT p_partkey, {_CASE(0)} AS view_mode, coalesce(o, {_CASE(1)}) AS scroll_mode, {_CASE(2)} AS zoom_mode FROM p")
def format_defaults(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", _pick(_FORMATS, F.col("p_partkey")).alias("f"), F.when(F.col("p_size") % 3 == 0, "spread").alias("o"))
    return parts.select("p_partkey", *V.format_defaults(F.col("f"), scroll_mode=F.col("o")))


@query("WITH p AS (SELECT DISTINCT ['all', 'none', 'spread-only', 'page-only'][p_partkey % 4 + 1] AS mode FROM part) SELECT mode, CASE WHEN mode IN ('all', 'page-only') THEN 20 ELSE 0 END AS page_spacing, CASE WHEN mode IN ('all', 'spread-only') THEN 20 ELSE 0 END AS spread_spacing FROM p")
def spacing_presets(spark, sf_dir):
    modes = table(spark, sf_dir, "part").select(_pick(tuple(V.SPACING), F.col("p_partkey")).alias("mode")).distinct()
    page, spread = V.spacing_of(F.col("mode"))
    return modes.select("mode", page.alias("page_spacing"), spread.alias("spread_spacing"))


@query("WITH p AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'continuous' ELSE 'paged' END AS mode FROM part) SELECT mode, CASE mode WHEN 'continuous' THEN 'single-page' END AS layout_mode, CASE mode WHEN 'continuous' THEN 'none' ELSE 'all' END AS spacing_mode, CASE mode WHEN 'continuous' THEN 0 ELSE 20 END AS page_spacing FROM p")
def view_mode_presets(spark, sf_dir):
    modes = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, "continuous").otherwise("paged").alias("mode")).distinct()
    return modes.select("mode", V.view_preset(F.col("mode")).alias("p")).select("mode", "p.layout_mode", "p.spacing_mode", "p.page_spacing")


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, event_id, page // 50 AS page_count, event_type AS zoom_mode, CAST(value AS BIGINT) // 100 AS zoom FROM e),
    l AS (SELECT *, lag(page_count) OVER w AS a, lag(zoom_mode) OVER w AS b, lag(zoom) OVER w AS c, row_number() OVER w = 1 AS first FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    d AS (SELECT *, first OR a IS DISTINCT FROM page_count AS sp, first OR b IS DISTINCT FROM zoom_mode AS zm, first OR c IS DISTINCT FROM zoom AS z FROM l)
    SELECT user_id, event_id, sp OR zm OR z AS layout_changed, sp AS clear_spreads, (sp OR zm OR z) AND NOT sp AND NOT zm AS restore_position, sp OR zm AS scroll_to_page FROM d""")
def layout_changes(spark, sf_dir):
    states = events(spark, sf_dir).select("user_id", "event_id", F.floor(F.col("page") / 50).alias("page_count"), F.col("event_type").alias("zoom_mode"), F.floor(F.floor(F.round("value", 0)) / 100).alias("zoom"))
    return V.layout_changes(states, ["user_id"], "event_id").drop("page_count", "zoom_mode", "zoom")


@query(f"WITH {EVENTS}, c AS (SELECT page AS group_id, arg_max(event_id % 2 = 0, event_id) AS v FROM e WHERE event_id % 3 > 0 AND page < 60 GROUP BY 1), g AS (SELECT DISTINCT page AS group_id FROM e) SELECT group_id, coalesce(v, true) AS visible FROM g LEFT JOIN c USING (group_id)")
def group_visibility(spark, sf_dir):
    log = events(spark, sf_dir)
    groups = log.select(F.col("page").alias("group_id")).distinct().withColumn("visible", F.lit(True))
    changes = log.where("event_id % 3 > 0 AND page < 60").select(F.col("page").alias("group_id"), (F.col("event_id") % 2 == 0).alias("visible"), F.col("event_id").alias("seq"))
    return V.group_visibility(groups, changes)


@query(f"WITH {EVENTS}, d AS (SELECT user_id, page, event_id, CASE WHEN event_type = 'error' THEN true WHEN event_type IN ('click', 'view') THEN false END AS d FROM e) SELECT user_id, page, coalesce(arg_min(d, CASE WHEN d IS NOT NULL THEN event_id END), false) AS flat FROM d GROUP BY 1, 2")
def flat_layouts(spark, sf_dir):
    one, zero = F.lit(1.0), F.lit(0.0)
    runs = events(spark, sf_dir).withColumns({"kind": F.when(F.col("event_type").isin("click", "view"), "glyphs").otherwise("space"), "scale_x": one, "scale_y": one, "skew_x": zero, "skew_y": zero, "tx": F.when(F.col("event_type") == "error", 5.0).otherwise(0.0), "ty": zero})
    return V.is_flat(runs, ["user_id", "page"], "event_id")


def undo_redo(spark, sf_dir):
    action = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("edit")
    log = events(spark, sf_dir).select("user_id", "event_id", action.alias("action"), F.col("event_id").alias("entry"))
    return V.undo_redo(log, "user_id", "event_id")


query()(undo_redo)


@query("SELECT p_partkey, unnest([0, 1, 2]) AS rank, unnest([true, false, false]) AS is_primary, unnest([coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, p_name) || CASE WHEN p_size % 3 = 0 THEN ' Bold' ELSE '' END, p_type || ' Italic', 'Arial']) AS label FROM part")
def font_rows(spark, sf_dir):
    font = lambda family, bold, italic: F.struct(family.cast("string").alias("family"), bold.alias("bold"), italic.alias("italic"))
    no = F.lit(False)
    usage = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("typeface"), font(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.col("p_size") % 3 == 0, no).alias("resolved"), F.array(font(F.col("p_type"), no, F.lit(True)), font(F.lit("Arial"), no, no)).alias("fallbacks"))
    return V.font_rows(usage, "p_partkey")


@query("WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN list_distinct(['a', 'b', 'c', chr(97 + p_size % 6)]) ELSE list_filter(['a', 'b', 'c'], lambda x: x <> chr(97 + p_size % 6)) END AS s FROM part) SELECT p_partkey, array_to_string(list_sort(s), ',') AS disabled FROM p")
def disabled_sets(spark, sf_dir):
    start = F.array(*map(F.lit, "abc"))
    name = F.array(F.chr(97 + F.col("p_size") % 6))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(V.toggled(start, name, F.col("p_partkey") % 2 == 0), ",").alias("disabled"))


@query(f"WITH {EVENTS} SELECT event_id, CASE WHEN page % 10 = 0 THEN -1 WHEN event_id % 3 = 0 OR page % 7 - 1 < 0 THEN 0 ELSE least(page % 7 - 1, page % 10 - 1) END AS active FROM e")
def search_active_index(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", V.active_match(F.col("page") % 10, F.col("page") % 7 - 1, F.col("event_id") % 3 == 0).alias("active"))


@query("SELECT event_id, round(CASE WHEN (event_id % 11) / 10.0 < 0.5 THEN 2 * ((event_id % 11) / 10.0) * ((event_id % 11) / 10.0) ELSE 1 - (2 - 2 * (event_id % 11) / 10.0) * (2 - 2 * (event_id % 11) / 10.0) / 2 END, 6)::DOUBLE AS eased, CAST(trunc(greatest((event_id % 30) / 8.0 * 1.5, 1)) AS INTEGER) AS thickness FROM events")
def easing_and_borders(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(V.ease((e % 11) / 10.0), 6).alias("eased"), V.border_pixels(e % 30, 1.5).alias("thickness"))


@query("""WITH t AS (SELECT p_partkey, p_name || CASE WHEN p_size % 3 > 0 THEN chr(9) || p_brand ELSE '' END || CASE WHEN p_size % 3 > 1 THEN chr(9) || p_size ELSE '' END AS t FROM part)
    SELECT p_partkey, CASE WHEN contains(t, chr(9)) THEN replace(left(t, length(t) - length(list_extract(string_split(t, chr(9)), -1)) - 1), chr(9), ' ') ELSE '' END AS before_tab, list_extract(string_split(t, chr(9)), -1) AS after_tab FROM t""")
def tab_split(spark, sf_dir):
    size = F.col("p_size")
    text = F.concat("p_name", F.when(size % 3 > 0, F.concat(F.lit("\t"), "p_brand")).otherwise(""), F.when(size % 3 > 1, F.concat(F.lit("\t"), size.cast("string"))).otherwise(""))
    left, right = V.tab_split(F.col("t"))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("t")).select("p_partkey", left.alias("before_tab"), right.alias("after_tab"))


@query("SELECT o_custkey AS doc_id, unnest(range(0, count(*))) AS page_index, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, 0 AS rotation FROM orders GROUP BY 1")
def page_info(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count("*").alias("page_count"))
    return V.page_info(docs.withColumns({"page_w": F.lit(612.0), "page_h": F.lit(792.0)}))


@query("SELECT o_custkey AS doc_id, 0 AS group_id, 0 AS start, count(*) AS count, 'linear' AS layout FROM orders GROUP BY 1")
def page_groups(spark, sf_dir):
    return V.page_groups(table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count("*").alias("page_count")))


_KINDS = ("ink", "line", "square", "highlight", "underline", "stamp")


@query(f"WITH k AS (SELECT DISTINCT [{', '.join(f"'{k}'" for k in _KINDS)}][p_partkey % 6 + 1] AS kind FROM part) SELECT kind, CASE kind {' '.join(f"WHEN '{k}' THEN '{EDITABLE[k]}'" for k in _KINDS if k in EDITABLE)} END AS options FROM k")
def editable_options(spark, sf_dir):
    kinds = table(spark, sf_dir, "part").select(_pick(_KINDS, F.col("p_partkey")).alias("kind")).distinct()
    return kinds.select("kind", lookup(EDITABLE, F.col("kind")).alias("options"))


@query("SELECT event_id, event_type = 'error' OR event_id % 5 = 0 AS out_of_memory FROM events")
def out_of_memory(spark, sf_dir):
    message = F.when(F.col("event_type") == "error", "RangeError: Array buffer Allocation Failed").when(F.col("event_id") % 5 == 0, "OUT OF MEMORY").when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise("fine")
    return table(spark, sf_dir, "events").select("event_id", A.is_out_of_memory(message).alias("out_of_memory"))


@query("SELECT user_id AS doc_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS page, CAST(event_id AS VARCHAR) AS name, CASE WHEN event_id % 4 = 0 THEN value + 1 ELSE value END AS x FROM events WHERE event_id % 5 < 4 OR event_id % 4 = 0")
def annotation_overlay(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("user_id").alias("doc_id"), "page", F.col("event_id").cast("string").alias("name"), F.col("value").alias("x"), "event_id")
    return N.overlaid(rows.where("event_id % 4 = 0").withColumn("x", F.col("x") + 1), rows.where("event_id % 5 < 4"), ["x"])


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority <> '1-URGENT', o_orderkey) AS draw_order FROM orders")
def behind_first(spark, sf_dir):
    from pyspark.sql import Window as W

    by = W.partitionBy("o_custkey").orderBy((F.col("o_orderpriority") != "1-URGENT").cast("int"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.row_number().over(by).alias("draw_order"))
