"""Layout queries. The lines of an order stand for the pages of a document, with sizes from their quantities and parts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docflow.functions import units as U
from docflow.operators import layout as L
from docflow.plans.registry import query, table

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
PAGES = f"""pages AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) - 1 AS page_index,
    CAST(400 + 8 * l_quantity AS DOUBLE) AS width, CAST(600 + l_partkey % 300 AS DOUBLE) AS height, (l_linenumber % 4) * 90 AS rotation,
    CASE WHEN l_suppkey % 3 = 0 THEN CAST(300 + l_partkey % 300 AS DOUBLE) END AS content_height FROM lineitem)"""
DOCS = "docs AS (SELECT l_orderkey AS doc_id, count(*) AS page_count FROM lineitem GROUP BY 1)"


def pages(spark, sf_dir):
    # named before the window, so that one exchange by doc_id serves the window and all that groups by document after it
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    index = F.row_number().over(W.partitionBy("doc_id").orderBy(*_ORDER)).cast("long") - 1
    return lines.withColumn("page_index", index).select(
        "doc_id", "page_index", (F.lit(400.0) + 8 * F.col("l_quantity")).alias("width"), (F.lit(600.0) + F.col("l_partkey") % 300).alias("height"),
        (F.col("l_linenumber") % 4 * 90).alias("rotation"), F.when(F.col("l_suppkey") % 3 == 0, F.lit(300.0) + F.col("l_partkey") % 300).alias("content_height"),
    )


def documents(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("page_count"))


_PLACE = {"single": ("p - 1", "0"), "double": ("(p - 1) // 2", "(p - 1) % 2"), "odd-right": ("p // 2", "p % 2"), "odd-left": ("p // 2", "(p + 1) % 2")}


def _spreads(mode: str):
    spread, slot = _PLACE[mode]
    sql = f"""WITH {DOCS}, e AS (SELECT doc_id, unnest(range(1, page_count + 1)) AS p FROM docs)
        SELECT doc_id, {spread} AS spread_index, max(CASE WHEN {slot} = 0 THEN p END) AS slot0, max(CASE WHEN {slot} = 1 THEN p END) AS slot1 FROM e GROUP BY 1, 2"""
    query(sql, f"spreads_{mode.replace('-', '_')}")(lambda spark, sf_dir: L.spreads(documents(spark, sf_dir), mode))


for _mode in L.MODES:
    _spreads(_mode)


@query(f"""WITH {DOCS}, e AS (SELECT doc_id, page_count, unnest(range(0, page_count + 2)) AS page FROM docs)
    SELECT doc_id, page, CASE WHEN page BETWEEN 1 AND page_count THEN page // 2 ELSE 0 END AS spread_index FROM e""")
def find_spread_for_page(spark, sf_dir):
    asked = documents(spark, sf_dir).withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("page_count") + 1)))
    return asked.select("doc_id", "page", L.spread_of(F.col("page"), F.col("page_count"), "odd-right").alias("spread_index"))


@query(f"""WITH {DOCS}, e AS (SELECT doc_id, unnest(range(1, page_count + 1)) AS p FROM docs) SELECT doc_id, p // 2 AS spread_index, min_by(p, (p + 1) % 2) AS page FROM e GROUP BY 1, 2""")
def spread_primary_page(spark, sf_dir):
    return L.spreads(documents(spark, sf_dir), "odd-left").select("doc_id", "spread_index", L.primary_page(F.col("slot0"), F.col("slot1")).alias("page"))


LAYOUTS = f"""{PAGES}, turned AS (SELECT *, floor(CASE WHEN (rotation + 90) % 360 IN (90, 270) THEN height ELSE width END * 96 / 72 * 1.25 * 2 + 0.5) AS w,
        floor(CASE WHEN (rotation + 90) % 360 IN (90, 270) THEN width ELSE height END * 96 / 72 * 1.25 * 2 + 0.5) AS h FROM pages),
    s AS (SELECT doc_id, page_index // 2 AS spread_index, sum(w) + CASE WHEN count(*) = 1 THEN min_by(w, page_index) ELSE 0 END + 20 AS w, max(h) AS h FROM turned GROUP BY 1, 2),
    layouts AS (SELECT doc_id, spread_index, (coalesce(sum(h + 40) OVER (PARTITION BY doc_id ORDER BY spread_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 40) / 2 AS top, w / 2 AS width, h / 2 AS height FROM s)"""


def layouts(spark, sf_dir):
    return L.spread_layouts(pages(spark, sf_dir), "double", scale=1.25, user_rotation=90, ratio=2.0)


@query(f"WITH {LAYOUTS} SELECT * FROM layouts")
def spread_layout_tops(spark, sf_dir):
    return layouts(spark, sf_dir)


@query(f"WITH {LAYOUTS} SELECT doc_id, max(top + height) + 20 AS total_height, max(width) AS content_width FROM layouts GROUP BY 1")
def content_size(spark, sf_dir):
    return L.total_height(layouts(spark, sf_dir), ratio=2.0)


@query(f"""WITH {LAYOUTS}, r AS (SELECT doc_id, count(*) AS n, coalesce(min(CASE WHEN top + height >= 100 * (doc_id % 40) THEN spread_index END), 0) AS lo, max(CASE WHEN top <= 100 * (doc_id % 40) + 800 THEN spread_index END) AS hi FROM layouts GROUP BY doc_id)
    SELECT doc_id, greatest(lo - 1, 0) AS first_index, least(greatest(coalesce(hi, lo), lo) + 1, n - 1) AS last_index FROM r""")
def visible_range(spark, sf_dir):
    return L.visible_range(layouts(spark, sf_dir), F.lit(100) * (F.col("doc_id") % 40), 800)


@query(f"""WITH {LAYOUTS}, d AS (SELECT doc_id, spread_index, abs(top + height / 2 - 1500) AS away FROM layouts)
    SELECT doc_id, arg_min(spread_index, (away, spread_index)) AS spread_index, min(away) AS distance FROM d GROUP BY 1""")
def nearest_spread(spark, sf_dir):
    return L.nearest_spread(layouts(spark, sf_dir), F.lit(1500.0))


@query(f"""WITH {PAGES}, t AS (SELECT *, floor(CASE WHEN rotation IN (90, 270) THEN coalesce(content_height, height) ELSE width END * 96 / 72 + 0.5) AS w, floor(CASE WHEN rotation IN (90, 270) THEN width ELSE coalesce(content_height, height) END * 96 / 72 + 0.5) AS h FROM pages)
    SELECT doc_id, page_index, coalesce(sum(h) OVER (PARTITION BY doc_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top, w AS width, h AS height FROM t""")
def continuous_linear(spark, sf_dir):
    return L.linear_layout(pages(spark, sf_dir))


_GRID = f"""{PAGES}, t AS (SELECT doc_id, page_index, page_index // 3 AS row, page_index % 3 AS col, floor(width * 96 / 72 + 0.5) AS w, floor(coalesce(content_height, height) * 96 / 72 + 0.5) AS h FROM pages),
    c AS (SELECT doc_id, col, max(w) AS cw FROM t GROUP BY 1, 2), cl AS (SELECT doc_id, col, coalesce(sum(cw) OVER (PARTITION BY doc_id ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "left", sum(cw) OVER (PARTITION BY doc_id) AS content_width FROM c),
    r AS (SELECT doc_id, row, max(h) AS rh FROM t GROUP BY 1, 2), rl AS (SELECT doc_id, row, rh, coalesce(sum(rh) OVER (PARTITION BY doc_id ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM r)"""


def tiles(spark, sf_dir):
    return pages(spark, sf_dir).withColumns({"row": F.floor(F.col("page_index") / 3), "col": F.col("page_index") % 3, "content_width": F.lit(None).cast("double"), "rotation": F.lit(0)})


@query(f"""WITH {_GRID} SELECT doc_id, page_index, row, col, "left", top, w AS width, rh AS row_height, content_width FROM t JOIN cl USING (doc_id, col) JOIN rl USING (doc_id, row)""")
def continuous_grid(spark, sf_dir):
    return L.grid_layout(tiles(spark, sf_dir))


@query(f"""WITH {PAGES}, n AS (SELECT doc_id, count(*) AS n FROM pages GROUP BY 1)
    SELECT doc_id, page_index, CASE WHEN page_index < n // 2 THEN 0 ELSE 1 END AS group_id, page_index // 3 AS row, page_index % 3 AS col FROM pages JOIN n USING (doc_id)""")
def tiled_groups(spark, sf_dir):
    half = F.floor(F.col("page_count") / 2)
    first = documents(spark, sf_dir).select("doc_id", F.lit(0).alias("group_id"), F.lit(0).cast("long").alias("start"), half.alias("count"))
    second = documents(spark, sf_dir).select("doc_id", F.lit(1).alias("group_id"), half.alias("start"), (F.col("page_count") - half).alias("count"))
    return L.tiled_positions(first.unionByName(second), tiles(spark, sf_dir)).select("doc_id", "page_index", "group_id", "row", "col")


STEPS = [0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 4.0]
_STEPS_SQL = "[" + ", ".join(f"{s}::DOUBLE" for s in STEPS) + "]"


@query(f"""SELECT event_id, value / 100 AS zoom, least(coalesce(list_min(list_filter({_STEPS_SQL}, lambda s: s > value / 100 + 1e-9)), 4), 3.5) AS zoom_in, greatest(coalesce(list_max(list_filter({_STEPS_SQL}, lambda s: s < value / 100 - 1e-9)), 0.25), 0.3) AS zoom_out FROM events""")
def zoom_next_step(spark, sf_dir):
    zoom = F.col("value") / 100
    return table(spark, sf_dir, "events").select("event_id", zoom.alias("zoom"), L.zoom_step(zoom, STEPS, True, 3.5).alias("zoom_in"), L.zoom_step(zoom, STEPS, False, 0.3).alias("zoom_out"))


@query(f"WITH {PAGES} SELECT doc_id, page_index, (rotation + 270) % 360 AS turn, CASE WHEN (rotation + 270) % 360 IN (90, 270) THEN height ELSE width END AS shown_width, CASE WHEN (rotation + 270) % 360 IN (90, 270) THEN width ELSE height END AS shown_height FROM pages")
def rotation_combine(spark, sf_dir):
    turn = U.rotation(F.col("rotation"), F.lit(270))
    width, height = U.turned_size(F.col("width"), F.col("height"), turn)
    return pages(spark, sf_dir).select("doc_id", "page_index", turn.alias("turn"), width.alias("shown_width"), height.alias("shown_height"))


@query(f"WITH {PAGES} SELECT doc_id, page_index, least(3.0, sqrt(16777216 / (width * 4 * height * 4)), 4096 / greatest(width * 4, height * 4)) AS ratio FROM pages")
def effective_dpr(spark, sf_dir):
    return pages(spark, sf_dir).select("doc_id", "page_index", U.effective_ratio(F.col("width") * 4, F.col("height") * 4, F.lit(3.0)).alias("ratio"))


@query(f"""WITH {PAGES}, r AS (SELECT doc_id, page_index, least(2.0, sqrt(16777216 / (width * 4 * height * 4)), 4096 / (greatest(width, height) * 4)) AS ratio FROM pages)
    SELECT doc_id, page_index, round(min(ratio) OVER (PARTITION BY doc_id ORDER BY page_index RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) * 4, 6) AS scale FROM r""")
def prerender_scale(spark, sf_dir):
    return L.prerender_scale(pages(spark, sf_dir), 3.0).withColumn("scale", F.round("scale", 6))


@query(f"""WITH {DOCS}, o AS (SELECT doc_id, doc_id % page_count AS page, page_count, unnest([1, -1, 2, -2]) AS o, unnest([0, 1, 2, 3]) AS rank FROM docs) SELECT doc_id, page, page + o AS target, rank FROM o WHERE page + o BETWEEN 0 AND page_count - 1""")
def prerender_neighbors(spark, sf_dir):
    return L.prerendered(documents(spark, sf_dir).withColumn("page", F.col("doc_id") % F.col("page_count")))


_NATURAL = f"""{PAGES}, turned AS (SELECT *, CASE WHEN rotation IN (90, 270) THEN height ELSE width END AS tw, CASE WHEN rotation IN (90, 270) THEN width ELSE height END AS th FROM pages),
    s1 AS (SELECT doc_id, page_index // 2 AS spread_index, sum(floor(tw * (96 / 72) + 0.5)) + CASE WHEN count(*) = 1 THEN min_by(floor(tw * (96 / 72) + 0.5), page_index) ELSE 0 END + 10 AS w, max(floor(th * (96 / 72) + 0.5)) AS h FROM turned GROUP BY 1, 2),
    m AS (SELECT doc_id, max(w) AS w, max(h) AS h, count(*) AS n FROM s1 GROUP BY 1),
    t AS (SELECT doc_id, sum(h) AS total FROM (SELECT turned.doc_id, page_index // 2 AS s, max(floor(th * (96 / 72) * (1200 / m.w) + 0.5)) AS h FROM turned JOIN m USING (doc_id) GROUP BY 1, 2) GROUP BY 1)"""


@query(f"""WITH {_NATURAL} SELECT doc_id, round(least(CASE WHEN total + 20 * (n + 1) > 3000 THEN 1185 / w ELSE 1200 / w END, 1), 6) AS width_max, round(CASE WHEN h * 1200 / w + 40 > 3000 THEN 1185 / w ELSE 1200 / w END, 6) AS width_single,
    round((3000 - 40 + 1) / h, 6) AS by_height, round(least(1200 / w, (3000 - 40 + 1) / h), 6) AS both_ways FROM m JOIN t USING (doc_id)""")
def view_scales(spark, sf_dir):
    of = lambda mode, name, **more: L.view_scales(pages(spark, sf_dir), "double", mode, 1200.0, 3000.0, **more).select("doc_id", F.round("scale", 6).alias(name))
    joined = of("fit-spread-width-max", "width_max")
    for other in (of("fit-spread-width", "width_single", continuous=False), of("fit-spread-height", "by_height"), of("fit-spread", "both_ways")):
        joined = joined.join(other, "doc_id")
    return joined


@query(f"""WITH {LAYOUTS}, v AS (SELECT doc_id, spread_index FROM layouts WHERE spread_index BETWEEN 1 AND 2) SELECT doc_id, min(page_index) AS first_page, max(page_index) AS last_page FROM pages JOIN v USING (doc_id) WHERE page_index // 2 = spread_index GROUP BY 1""")
def visible_pages(spark, sf_dir):
    ranges = documents(spark, sf_dir).select("doc_id", F.lit(1).alias("first_index"), F.lit(2).alias("last_index"))
    return L.visible_pages(L.spreads(documents(spark, sf_dir), "double"), ranges)


@query(f"""WITH {LAYOUTS}, f AS (SELECT doc_id, arg_min(top, spread_index) AS first FROM layouts GROUP BY 1) SELECT d.doc_id, doc_id % 5 AS spread_index, coalesce(l.top, f.first) AS top FROM (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem) d JOIN f USING (doc_id) LEFT JOIN layouts l ON l.doc_id = d.doc_id AND l.spread_index = d.doc_id % 5""")
def layout_or_first(spark, sf_dir):
    wanted = documents(spark, sf_dir).select("doc_id", (F.col("doc_id") % 5).alias("spread_index"))
    return L.layout_or_first(wanted, layouts(spark, sf_dir))


@query(f"""WITH {LAYOUTS} SELECT doc_id, spread_index, greatest(least(CASE WHEN top < 900 THEN top WHEN top + height > 1700 THEN top + height - 800 ELSE 900 END, 8000 - 800), 0) AS nearest, greatest(least(top + height / 2 - 400, 7200), 0) AS center FROM layouts""")
def scroll_targets(spark, sf_dir):
    args = (F.col("top"), F.col("height"), F.lit(900.0), F.lit(800.0), F.lit(8000.0))
    return layouts(spark, sf_dir).select("doc_id", "spread_index", *(L.scroll_target(*args, align).alias(align) for align in ("nearest", "center")))


@query("""WITH d AS (SELECT user_id, event_id, value - 50 AS delta FROM events)
    SELECT user_id, event_id, coalesce(last_value(CASE WHEN delta > 20 THEN true WHEN delta < -20 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS overflow FROM d""")
def overflow_hysteresis(spark, sf_dir):
    deltas = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") - 50).alias("delta"))
    return L.overflow_states(deltas, 20.0, "user_id", "event_id").drop("delta")
