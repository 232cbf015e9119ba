"""Structure queries: headings and list items of web pages, lines of documents as blocks, parts as styles, order lines as table cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.functions import labels as B
from docflow.operators import structure as S
from docflow.plans.registry import query, table

_HEADING, _ITEM = r"<h([1-6])[^>]*>([^<]*)</h[1-6]>", r"<li[^>]*>(.*?)</li>"


def headings(spark, sf_dir):
    """Headings of a page, with skipped levels: a heading's level also follows the length of its title."""
    html = F.col("html")
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.arrays_zip(F.regexp_extract_all(html, F.lit(_HEADING), F.lit(1)).alias("l"), F.regexp_extract_all(html, F.lit(_HEADING), F.lit(2)).alias("t"))).alias("idx", "h"))
    items = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(_ITEM), F.lit(1))).alias("idx", "t"))
    heads = found.select(F.col("page_id").alias("doc_id"), F.col("idx").cast("long").alias("idx"), (F.col("h.l").cast("int") - 1).alias("level"), F.col("h.t").alias("title"))
    rest = items.select(F.col("page_id").alias("doc_id"), (F.col("idx") + 1000).cast("long").alias("idx"), (F.length("t") % 4).cast("int").alias("level"), F.col("t").alias("title"))
    return heads.unionByName(rest)


_HEADS = f"""heads AS (
    SELECT page_id AS doc_id, unnest(range(0, len(l))) AS idx, CAST(unnest(l) AS INTEGER) - 1 AS level, unnest(t) AS title FROM (SELECT page_id, regexp_extract_all(html, '{_HEADING}', 1) AS l, regexp_extract_all(html, '{_HEADING}', 2) AS t FROM pages)
    UNION ALL SELECT page_id, unnest(range(1000, 1000 + len(t))), length(unnest(t)) % 4, unnest(t) FROM (SELECT page_id, regexp_extract_all(html, '{_ITEM}', 1) AS t FROM pages))"""


@query(f"""WITH {_HEADS}, i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS i, min(level) OVER (PARTITION BY doc_id) AS least FROM heads WHERE trim(title) <> ''),
    e AS (SELECT *, i + least(least, min(level - i) OVER (PARTITION BY doc_id ORDER BY i)) - least AS depth FROM i)
    SELECT doc_id, idx, level, title, CAST(depth AS BIGINT) AS depth, (SELECT max(p.idx) FROM e p WHERE p.doc_id = e.doc_id AND p.idx < e.idx AND p.depth = e.depth - 1) AS parent_idx FROM e""")
def outline_depth_parent(spark, sf_dir):
    return S.outline(headings(spark, sf_dir))


_LEVELS = [(1, 0, 1, "decimal", "%1."), (1, 1, 1, "lowerLetter", "%2)"), (1, 2, 3, "lowerRoman", "(%3)"), (1, 3, 0, "bullet", " - "), (2, 0, 5, "upperRoman", "%1 "), (2, 1, 1, "upperLetter", "%1.%2"), (2, 2, 1, "bullet", " ")]
_LEVEL_ROWS = ", ".join(f"({a}, {i}, {s}, '{f}', '{t}')" for a, i, s, f, t in _LEVELS)
_ITEMS = f"""items AS (SELECT page_id AS doc_id, unnest(range(0, len(t))) AS idx, unnest(range(0, len(t))) % 3 + 1 AS num_id, length(unnest(t)) % 4 AS ilvl FROM (SELECT page_id, regexp_extract_all(html, '{_ITEM}', 1) AS t FROM pages)),
    levels(abstract_id, ilvl, start, fmt, level_text) AS (VALUES {_LEVEL_ROWS}), numbers(num_id, abstract_id) AS (VALUES (1, 1), (2, 2), (3, 1)),
    k AS (SELECT * FROM items LEFT JOIN numbers USING (num_id) LEFT JOIN levels USING (abstract_id, ilvl)),
    r AS (SELECT *, (SELECT count(*) FROM k p WHERE p.doc_id = k.doc_id AND p.num_id = k.num_id AND p.fmt IS NOT NULL AND p.idx <= k.idx AND p.ilvl < k.ilvl) AS reset FROM k),
    c AS (SELECT *, CASE WHEN fmt IS NOT NULL THEN greatest(start - 1, 0) + row_number() OVER (PARTITION BY doc_id, num_id, ilvl, reset, fmt IS NULL ORDER BY idx) END AS count FROM r)"""


def list_items(spark, sf_dir):
    items = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(F.regexp_extract_all("html", F.lit(_ITEM), F.lit(1))).alias("idx", "t"))
    items = items.select("doc_id", F.col("idx").cast("long").alias("idx"), (F.col("idx") % 3 + 1).cast("int").alias("num_id"), (F.length("t") % 4).cast("int").alias("ilvl"))
    levels = spark.createDataFrame(_LEVELS, "abstract_id int, ilvl int, start int, fmt string, level_text string")
    numbers = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "num_id int, abstract_id int")
    return S.numbered(items, numbers, levels)


@query(f"WITH {_ITEMS} SELECT doc_id, idx, num_id, ilvl, CAST(count AS BIGINT) AS count FROM c")
def list_numbering(spark, sf_dir):
    return list_items(spark, sf_dir).select("doc_id", F.col("idx"), "num_id", F.col("ilvl").cast("long").alias("ilvl"), "count")


_ROMAN_SQL = """repeat('m', CAST({0} // 1000 AS INTEGER)) || ['','c','cc','ccc','cd','d','dc','dcc','dccc','cm'][({0} // 100) % 10 + 1] || ['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc'][({0} // 10) % 10 + 1] || ['','i','ii','iii','iv','v','vi','vii','viii','ix'][{0} % 10 + 1]"""
_LETTER_SQL = "chr(CAST({1} + ((({0} % 256) - 1 + 256) % 256) % 26 AS INTEGER))"


@query(f"""WITH {_ITEMS} SELECT doc_id, idx, CASE WHEN fmt IS NULL THEN '' WHEN fmt IN ('bullet', 'none') THEN CASE WHEN trim(level_text) = '' THEN '•' ELSE trim(level_text) END || ' '
    ELSE replace(level_text, '%' || (ilvl + 1), CASE fmt WHEN 'lowerRoman' THEN {_ROMAN_SQL.format('count')} WHEN 'upperRoman' THEN upper({_ROMAN_SQL.format('count')}) WHEN 'lowerLetter' THEN {_LETTER_SQL.format('count', 97)} WHEN 'upperLetter' THEN {_LETTER_SQL.format('count', 65)} ELSE CAST(count AS VARCHAR) END) || ' ' END AS label FROM c""")
def list_labels(spark, sf_dir):
    return list_items(spark, sf_dir).select("doc_id", "idx", "label")


@query(f"SELECT DISTINCT p_partkey % 4200 AS n, CASE WHEN p_partkey % 4200 = 0 THEN '0' ELSE {_ROMAN_SQL.format('(p_partkey % 4200)')} END AS roman, CASE WHEN p_partkey % 4200 = 0 THEN '0' ELSE upper({_ROMAN_SQL.format('(p_partkey % 4200)')}) END AS upper_roman FROM part")
def roman_labels(spark, sf_dir):
    n = (F.col("p_partkey") % 4200).alias("n")
    return table(spark, sf_dir, "part").select(n).distinct().select("n", B.roman(F.col("n")).alias("roman"), B.roman(F.col("n"), True).alias("upper_roman"))


@query(f"SELECT DISTINCT p_partkey % 600 AS n, {_LETTER_SQL.format('(p_partkey % 600)', 97)} AS letter, {_LETTER_SQL.format('(p_partkey % 600)', 65)} AS upper_letter FROM part")
def letter_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 600).alias("n")).distinct().select("n", B.letter(F.col("n")).alias("letter"), B.letter(F.col("n"), True).alias("upper_letter"))


_BLOCKS = """blocks AS (SELECT doc_id, idx, CASE WHEN length(t) % 11 = 0 THEN 'break' ELSE 'paragraph' END AS kind, greatest(ceil(length(t) / 90.0), 1) * 12.5 + length(t) % 5 AS height, length(t) AS n
    FROM (SELECT doc_id, unnest(range(0, len(l))) AS idx, unnest(l) AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))"""
_PAGED = f"""{_BLOCKS}, p AS (SELECT *, coalesce(sum(CASE WHEN kind = 'break' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part, CASE WHEN kind = 'break' THEN 0 ELSE height END AS h FROM blocks),
    y AS (SELECT *, coalesce(sum(h) OVER (PARTITION BY doc_id, part ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y FROM p),
    s AS (SELECT doc_id, part + 1 AS part, max(CASE WHEN kind = 'break' THEN greatest(floor((y + 0.25) / 500), 0) + 1 END) AS pages FROM y GROUP BY 1, 2),
    f AS (SELECT doc_id, part, sum(pages) OVER (PARTITION BY doc_id ORDER BY part) AS first FROM s),
    g AS (SELECT y.*, coalesce(f.first, 0) AS first FROM y LEFT JOIN f ON f.doc_id = y.doc_id AND f.part = y.part),
    placed AS (SELECT doc_id, idx, kind, CAST(first + greatest(floor((y + 0.25) / 500), 0) AS BIGINT) AS page, CAST(CASE WHEN kind = 'break' THEN (first + greatest(floor((y + 0.25) / 500), 0) + 1) * 500 ELSE first * 500 + y + h END AS DOUBLE) AS bottom FROM g)"""


def blocks(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("idx", "t"))
    n = F.length("t")
    return lines.select("doc_id", F.col("idx").cast("long").alias("idx"), F.when(n % 11 == 0, "break").otherwise("paragraph").alias("kind"), (F.greatest(F.ceil(n / 90.0), F.lit(1)) * 12.5 + n % 5).alias("height"), n.alias("n"))


@query(f"WITH {_PAGED} SELECT * FROM placed")
def paginate_blocks(spark, sf_dir):
    return S.paginated(blocks(spark, sf_dir), 500.0).select("doc_id", "idx", "kind", "page", "bottom")


@query(f"WITH {_PAGED} SELECT doc_id, CAST(greatest(ceil(arg_max(bottom, idx) / 500), 1) AS BIGINT) AS page_count FROM placed GROUP BY 1")
def page_counts(spark, sf_dir):
    return S.page_counts(S.paginated(blocks(spark, sf_dir), 500.0), 500.0)


def paginate_with_images(spark, sf_dir):
    images = F.when(F.col("n") % 7 == 0, F.array(F.lit(120.0), (F.col("n") % 400).cast("double")))
    return S.paginated_with_images(blocks(spark, sf_dir).withColumns({"images": images, "space_before": (F.col("n") % 3).cast("double")}), 500.0)


query()(paginate_with_images)


_STYLES = """styles AS (SELECT p_brand AS doc_id, p_partkey AS style_id, CASE WHEN p_partkey % 7 = 0 THEN p_partkey + 25 WHEN p_partkey > 25 THEN p_partkey - 25 END AS based_on,
    CASE WHEN p_size % 5 = 0 THEN p_size % 2 = 0 END AS bold, CASE WHEN p_size % 4 = 1 THEN CAST(p_size AS DOUBLE) / 2 END AS size_pt, CASE WHEN p_size % 9 = 2 THEN p_type END AS font FROM part)"""


def styles(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        (k % 25).alias("doc_id"), k.alias("style_id"), F.when(k % 7 == 0, k + 25).when(k > 25, k - 25).alias("based_on"),
        F.when(s % 5 == 0, s % 2 == 0).alias("bold"), F.when(s % 4 == 1, s.cast("double") / 2).alias("size_pt"), F.when(s % 9 == 2, F.col("p_type")).alias("font"),
    )


@query(f"""WITH RECURSIVE {_STYLES.replace('p_brand AS doc_id', 'p_partkey % 25 AS doc_id')}, c AS (SELECT doc_id, style_id, 1 AS n, bold, size_pt, font, based_on FROM styles
    UNION ALL SELECT c.doc_id, c.style_id, c.n + 1, coalesce(c.bold, s.bold), coalesce(c.size_pt, s.size_pt), coalesce(c.font, s.font), s.based_on FROM c JOIN styles s ON s.doc_id = c.doc_id AND s.style_id = c.based_on WHERE c.n < 33),
    l AS (SELECT doc_id, style_id, max(n) AS n FROM c GROUP BY ALL) SELECT doc_id, style_id, bold, size_pt, font FROM c JOIN l USING (doc_id, style_id, n)""")
def style_cascade(spark, sf_dir):
    return S.inherited(styles(spark, sf_dir), ["bold", "size_pt", "font"])


_FONTS = """fonts AS (SELECT DISTINCT p_type || CASE p_size % 6 WHEN 0 THEN ' Serif' WHEN 1 THEN ' Sans Serif' WHEN 2 THEN ' Times' WHEN 3 THEN ' Roman X' ELSE '' END AS font FROM part UNION SELECT * FROM (VALUES ('Calibri'), ('Georgia'), ('Cambria'), ('arial')))"""


@query(f"""WITH {_FONTS} SELECT font, CASE WHEN lower(font) IN ('economy', 'georgia', 'arial') THEN font WHEN (contains(lower(font), 'serif') AND NOT contains(lower(font), 'sans')) OR contains(lower(font), 'times') OR contains(lower(font), 'roman') OR lower(font) IN ({', '.join(f"'{n}'" for n in B.SERIF_NAMES)}) THEN 'Liberation Serif' WHEN lower(font) = 'calibri' THEN 'Carlito' ELSE 'Liberation Sans' END AS family FROM fonts""")
def font_resolve(spark, sf_dir):
    m = F.col("p_size") % 6
    suffix = F.when(m == 0, " Serif").when(m == 1, " Sans Serif").when(m == 2, " Times").when(m == 3, " Roman X").otherwise("")
    fonts = table(spark, sf_dir, "part").select(F.concat("p_type", suffix).alias("font")).union(spark.createDataFrame([("Calibri",), ("Georgia",), ("Cambria",), ("arial",)], "font string")).distinct()
    families = spark.createDataFrame([("economy",), ("georgia",), ("arial",)], "family_key string")
    joined = fonts.join(families, F.lower("font") == F.col("family_key"), "left")
    return joined.select("font", B.substitute_family(F.col("font"), F.col("family_key").isNotNull()).alias("family"))


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
_CELLS = f"""cells AS (SELECT l_orderkey AS table_id, (row_number() OVER w - 1) // 3 AS row, (row_number() OVER w - 1) % 3 AS col, l_quantity AS grid, l_partkey % 40 + 4.5 AS height, l_suppkey % 3 * 200 AS row_height, l_linenumber % 5 = 0 AS exact FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_ORDER}))"""


def cells(spark, sf_dir):
    from pyspark.sql import Window as W

    at = F.col("__at")
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "table_id").withColumn("__at", F.row_number().over(W.partitionBy("table_id").orderBy(*_ORDER.split(", "))) - 1)
    return lines.select("table_id", F.floor(at / 3).alias("row"), (at % 3).cast("long").alias("col"), F.col("l_quantity").alias("grid"), (F.col("l_partkey") % 40 + 4.5).alias("height"), (F.col("l_suppkey") % 3 * 200).alias("row_height"), (F.col("l_linenumber") % 5 == 0).alias("exact"))


_WIDTHS = f"""{_CELLS}, g AS (SELECT table_id, col, max(grid) AS grid FROM cells GROUP BY ALL), widths AS (SELECT table_id, col, CASE table_id % 3 WHEN 0 THEN least(468 * 4000 / 5000.0, 468) WHEN 1 THEN 6000 / 20.0 ELSE 468 END * (grid / sum(grid) OVER (PARTITION BY table_id)) AS width FROM g)"""


def widths(spark, sf_dir):
    kind = F.col("table_id") % 3
    total = S.table_width(F.when(kind == 0, 4000).when(kind == 1, 6000).otherwise(0), kind == 0, F.lit(468.0))
    return S.column_widths(cells(spark, sf_dir), ["table_id"], total)


@query(f"WITH {_WIDTHS} SELECT table_id, col, round(width, 6) AS width FROM widths")
def table_col_widths(spark, sf_dir):
    return widths(spark, sf_dir).withColumn("width", F.round("width", 6))


@query(f"""WITH {_CELLS} SELECT table_id, row, CAST(CASE WHEN bool_or(exact) AND max(row_height) > 0 THEN max(row_height) / 20.0 ELSE greatest(max(height), CASE WHEN max(row_height) > 0 THEN max(row_height) / 20.0 ELSE 12 END) END AS DOUBLE) AS height FROM cells GROUP BY 1, 2""")
def table_row_heights(spark, sf_dir):
    return S.row_heights(cells(spark, sf_dir), ["table_id"])


@query(f"""WITH {_WIDTHS}, s AS (SELECT table_id, row, col AS cell, CASE WHEN col = 0 THEN 2 ELSE 1 END AS span FROM cells WHERE col < 2), p AS (SELECT *, coalesce(sum(span) OVER (PARTITION BY table_id, row ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM s)
    SELECT table_id, row, cell, round(coalesce((SELECT sum(width) FROM widths w WHERE w.table_id = p.table_id AND w.col < a), 0), 6) AS "left", round((SELECT sum(width) FROM widths w WHERE w.table_id = p.table_id AND w.col >= a AND w.col < a + span), 6) AS width FROM p WHERE EXISTS (SELECT 1 FROM widths w WHERE w.table_id = p.table_id AND w.col >= a AND w.col < a + span)""")
def table_spans(spark, sf_dir):
    spans = cells(spark, sf_dir).where("col < 2").select("table_id", "row", F.col("col").alias("cell"), F.when(F.col("col") == 0, 2).otherwise(1).cast("long").alias("span"))
    return S.spanned_cells(spans, widths(spark, sf_dir), ["table_id"]).withColumns({"left": F.round("left", 6), "width": F.round("width", 6)})


@query(f"""WITH {_CELLS}, m AS (SELECT *, max(row) OVER (PARTITION BY table_id) AS hr, max(col) OVER (PARTITION BY table_id) AS hc FROM cells)
    SELECT table_id, row, col, coalesce(CASE WHEN exact THEN 'own' END, CASE WHEN row = 0 THEN 'outer' ELSE 'inner' END) AS border_top, CASE WHEN row = hr THEN 'outer' ELSE 'inner' END AS border_bottom, CASE WHEN col = 0 THEN 'outer' ELSE 'inner' END AS border_left, CASE WHEN col = hc THEN 'outer' ELSE 'inner' END AS border_right FROM m""")
def table_borders(spark, sf_dir):
    none = F.lit(None).cast("string")
    named = cells(spark, sf_dir).withColumns({"top": F.when(F.col("exact"), "own"), "bottom": none, "left": none, "right": none, "inside_h": F.lit("inner"), "inside_v": F.lit("inner"), **{f"table_{s}": F.lit("outer") for s in ("top", "bottom", "left", "right")}})
    return S.edge_borders(named, ["table_id"]).select("table_id", "row", "col", "border_top", "border_bottom", "border_left", "border_right")


@query("""SELECT o_custkey AS doc_id, o_orderkey AS section, last_value(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM orders""")
def header_inheritance(spark, sf_dir):
    sections = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("section"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("header"))
    return S.inherited_reference(sections, "header")


@query(f"""WITH {_HEADS}, i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS i, min(level) OVER (PARTITION BY doc_id) AS least FROM heads WHERE trim(title) <> ''),
    e AS (SELECT *, i + least(least, min(level - i) OVER (PARTITION BY doc_id ORDER BY i)) - least AS depth, (idx % 1000) // 2 AS page FROM i),
    s AS (SELECT doc_id, page AS first_page, arg_max(title, idx) AS title FROM e WHERE depth < 1 GROUP BY 1, 2), z AS (SELECT * FROM s UNION ALL SELECT DISTINCT page_id, 0, NULL FROM pages WHERE page_id NOT IN (SELECT doc_id FROM s WHERE first_page = 0))
    SELECT doc_id, row_number() OVER w - 1 AS part, title, first_page, coalesce(lead(first_page) OVER w, 600) - 1 AS last_page FROM z WINDOW w AS (PARTITION BY doc_id ORDER BY first_page)""")
def split_by_outline(spark, sf_dir):
    from docflow.operators.manifests import split_by_outline as split

    entries = S.outline(headings(spark, sf_dir)).withColumn("page", F.floor(F.col("idx") % 1000 / 2))
    documents = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(600).cast("long").alias("page_count"))
    return split(entries, documents)
