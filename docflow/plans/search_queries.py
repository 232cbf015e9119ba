"""Search queries over the turns of conversations, read as the pages of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docflow.operators import search as S
from docflow.plans.registry import query, table

NEEDLE = "the"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_index"), "text")


_BLANK_SQL = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _hits(needle: str, cased: str = "lower(text)", where: str = "true") -> str:
    return f"""hits AS (SELECT conv_id AS doc_id, turn AS page_index, text, unnest(list_filter(range(length({cased})), lambda i: substr({cased}, i + 1, {len(needle)}) = '{needle}')) AS char_offset
        FROM conversations WHERE contains({cased}, '{needle}') AND {where})"""


_OUT = "doc_id, page_index, CAST(char_offset AS INTEGER) AS char_offset"


@query(f"WITH {_hits('the')} SELECT {_OUT}, 3 AS length FROM hits")
def search_exact(spark, sf_dir):
    return S.search(pages(spark, sf_dir), NEEDLE)


@query(f"WITH {_hits('The', 'text')} SELECT {_OUT}, 3 AS length FROM hits")
def search_case_sensitive(spark, sf_dir):
    return S.search(pages(spark, sf_dir), "The", case_sensitive=True)


@query(f"WITH {_hits('ee', 'text')} SELECT {_OUT}, 2 AS length FROM hits")
def search_overlapping(spark, sf_dir):
    return S.search(pages(spark, sf_dir), "ee", case_sensitive=True)


@query(f"WITH {_hits('the', where='turn BETWEEN 1 AND 2')} SELECT {_OUT}, 3 AS length FROM hits")
def search_page_range(spark, sf_dir):
    return S.search(pages(spark, sf_dir), NEEDLE, page_range=(1, 2))


@query(f"WITH {_hits('the')} SELECT doc_id, page_index, count(*) AS n_matches FROM hits GROUP BY ALL")
def search_page_counts(spark, sf_dir):
    return S.page_counts(S.search(pages(spark, sf_dir), NEEDLE), ["doc_id", "page_index"])


_CONTEXT = f"""WITH {_hits('the')},
    c AS (SELECT *, list_extract(string_split(substr(text, greatest(char_offset - 30, 0) + 1, least(char_offset, 30)), chr(10)), -1) AS b,
                 list_extract(string_split(substr(text, char_offset + 4, 30), chr(10)), 1) AS a FROM hits),
    w AS (SELECT *, list_filter(string_split_regex(b, '{_BLANK_SQL}+'), lambda x: x <> '') AS bw, list_filter(string_split_regex(a, '{_BLANK_SQL}+'), lambda x: x <> '') AS aw FROM c),
    s AS (SELECT *, CASE WHEN len(bw) <= 3 THEN b ELSE array_to_string(bw[-3:], ' ') || CASE WHEN regexp_matches(right(b, 1), '{_BLANK_SQL}') THEN right(b, 1) ELSE '' END END AS sb,
                 CASE WHEN len(aw) <= 3 THEN a ELSE CASE WHEN regexp_matches(left(a, 1), '{_BLANK_SQL}') THEN left(a, 1) ELSE '' END || array_to_string(aw[:3], ' ') END AS sa FROM w)"""


@query(f"""{_CONTEXT} SELECT {_OUT}, 3 AS length, CASE WHEN length(sb) < length(b) THEN '…' ELSE '' END || sb AS before, substr(text, char_offset + 1, 3) AS match,
    sa || CASE WHEN length(sa) < length(a) THEN '…' ELSE '' END AS after FROM s""")
def search_context(spark, sf_dir):
    return S.search(pages(spark, sf_dir), NEEDLE, context=True)


@query(f"""WITH {_hits('the')}, n AS (SELECT doc_id, page_index, char_offset, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY page_index, char_offset))
    SELECT {_OUT}, i AS match_index, n AS n_matches, (i + 1) % n AS next_index, (i - 1 + n) % n AS previous_index FROM n""")
def search_nav_next_prev(spark, sf_dir):
    by = W.partitionBy("doc_id")
    found = S.search(pages(spark, sf_dir), NEEDLE).withColumn("match_index", F.row_number().over(by.orderBy("page_index", "char_offset")).cast("long") - 1).withColumn("n_matches", F.count("*").over(by))
    following, previous = S.neighbours(F.col("match_index"), F.col("n_matches"))
    return found.select("doc_id", "page_index", "char_offset", "match_index", "n_matches", following.alias("next_index"), previous.alias("previous_index"))


def _norm(text: str) -> str:
    return f"translate(regexp_replace({text}, '{S.DROPPED_CLASS}', '', 'g'), '{''.join(S.FOLDS)}', '{''.join(v.replace(chr(39), chr(39) * 2) for v in S.FOLDS.values())}')"



@query(f"SELECT conv_id AS doc_id, turn AS page_index, {_norm('text')} AS normalized FROM conversations")
def normalize_text(spark, sf_dir):
    return pages(spark, sf_dir).select("doc_id", "page_index", S.normalize(F.col("text")).alias("normalized"))


_FUZZY = "of the"
_FUZZY_NEEDLE = S.normalized_query(_FUZZY)


@query(f"""WITH p AS (SELECT conv_id AS doc_id, turn AS page_index, lower(text) AS t, {_norm('lower(text)')} AS n FROM conversations),
    k AS (SELECT doc_id, page_index, n, list_filter(range(length(t)), lambda i: NOT regexp_matches(substr(t, i + 1, 1), '{S.DROPPED_CLASS}')) AS kept FROM p WHERE contains(n, '{_FUZZY_NEEDLE}')),
    h AS (SELECT *, unnest(list_filter(range(length(n)), lambda i: substr(n, i + 1, {len(_FUZZY_NEEDLE)}) = '{_FUZZY_NEEDLE}')) AS pos FROM k)
    SELECT doc_id, page_index, CAST(kept[pos + 1] AS INTEGER) AS char_offset, CAST(kept[pos + {len(_FUZZY_NEEDLE)}] - kept[pos + 1] + 1 AS INTEGER) AS length FROM h""")
def search_fuzzy(spark, sf_dir):
    return S.search(pages(spark, sf_dir), _FUZZY, fuzzy=True)


@query("""SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n_pages FROM conversations GROUP BY conv_id""")
def page_text_concat(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("page_index", "text")))
    return pages(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"), F.count("*").alias("n_pages"))


@query(f"""WITH {_hits('the')}, g AS (SELECT doc_id, page_index, char_offset, unnest(range(char_offset, char_offset + 3)) AS p FROM hits),
    l AS (SELECT doc_id, page_index, char_offset, p // 80 AS line, min(p % 80) AS c, count(*) AS n FROM g GROUP BY ALL)
    SELECT {_OUT}, CAST(line AS INTEGER) AS line, CAST(10 * c AS DOUBLE) AS x, CAST(20 * line - 9.6 AS DOUBLE) AS y, CAST(10 * n AS DOUBLE) AS width, CAST(12 AS DOUBLE) AS height FROM l""")
def match_rects(spark, sf_dir):
    """Boxes of the matches on a page that is set 80 characters to a line, 10 points a character."""
    found = S.search(pages(spark, sf_dir), NEEDLE)
    place = F.sequence(F.col("char_offset"), F.col("char_offset") + F.col("length") - 1)
    line = lambda p: F.floor(p / 80)
    glyphs = F.transform(place, lambda p: F.struct((F.lit(10.0) * (p % 80)).alias("x"), (F.lit(20.0) * line(p)).alias("y"), F.lit(10.0).alias("advance"), F.lit(12.0).alias("font_size"), F.lit(0.0).alias("angle")))
    boxes = found.select("doc_id", "page_index", "char_offset", F.explode(S.match_rects(glyphs)).alias("r"))
    return boxes.select("doc_id", "page_index", "char_offset", F.round((F.col("r.y") + 9.6) / 20).cast("int").alias("line"), *(F.round(f"r.{c}", 6).alias(c) for c in ("x", "y", "width", "height")))


@query(f"""WITH {_hits('the')}, r AS (SELECT {_OUT}, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, char_offset) - 1 AS rank FROM hits)
    SELECT doc_id, page_index, char_offset, 3 AS length, rank, rank = doc_id % 5 AS active FROM r WHERE page_index BETWEEN doc_id % 2 AND doc_id % 2 + 2""")
def visible_highlights(spark, sf_dir):
    first = F.col("doc_id") % 2
    ranges = pages(spark, sf_dir).select("doc_id").distinct().select("doc_id", first.alias("first_page"), (first + 2).alias("last_page"), (F.col("doc_id") % 5).alias("active_index"))
    return S.visible_highlights(search_exact(spark, sf_dir), ranges)
