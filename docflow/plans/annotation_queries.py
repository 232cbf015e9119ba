"""Annotation, geometry and scalar queries: events stand for annotations of a user's document, their value for geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from docflow.functions import labels as B
from docflow.operators import annotations as A
from docflow.plans.registry import query, table

_TYPES = {"click": "square", "view": "highlight", "purchase": "ink", "signup": "line", "error": "freeText"}


def annotations(spark, sf_dir):
    e, v = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.get_json_object("props", "$.k").cast("long").alias("page"), (e % 97).cast("string").alias("name"), e.alias("ord"), B.lookup(_TYPES, F.col("event_type")).alias("kind"),
        F.when(e % 3 == 0, F.concat(F.lit("user"), (e % 11).cast("string"))).alias("author"), F.when(e % 5 == 0, "").when(e % 7 == 0, "note").alias("contents"), F.lit(None).cast("string").alias("subject"),
        (e % 4 == 0).alias("ephemeral"), v.alias("x"), (v / 2).alias("y"), (v % 50).alias("width"), (v % 30).alias("height"),
    )


ANN = f"""ann AS (SELECT user_id AS doc_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS page, CAST(event_id % 97 AS VARCHAR) AS name, event_id AS ord,
    CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items())} END AS kind, CASE WHEN event_id % 3 = 0 THEN 'user' || (event_id % 11) END AS author,
    CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN 'note' END AS contents, event_id % 4 = 0 AS ephemeral, value AS x, value / 2 AS y, value % 50 AS width, value % 30 AS height FROM events)"""


@query(f"WITH {ANN} SELECT doc_id, page, name, author, contents FROM ann WHERE coalesce(author, '') <> '' OR coalesce(contents, '') <> ''")
def annotation_filter_meta(spark, sf_dir):
    return A.with_metadata(annotations(spark, sf_dir)).select("doc_id", "page", "name", "author", "contents")


@query(f"WITH {ANN} SELECT doc_id, page, count(*) AS n_comments FROM ann WHERE coalesce(author, '') <> '' OR coalesce(contents, '') <> '' GROUP BY 1, 2")
def annotation_page_counts(spark, sf_dir):
    return A.page_comment_counts(annotations(spark, sf_dir))


@query(f"WITH {ANN} SELECT doc_id, page, name, ord FROM ann WHERE NOT ephemeral")
def annotation_saved(spark, sf_dir):
    return A.saved(annotations(spark, sf_dir)).select("doc_id", "page", "name", "ord")


_PATCH = f"""{ANN}, patches AS (SELECT doc_id, page, name, ord % 5 AS ordinal, CASE WHEN ord % 2 = 0 THEN 'p' || ord END AS author, CASE WHEN ord % 3 = 0 THEN x + 1 END AS x, ord FROM ann WHERE ord % 6 < 3),
    last AS (SELECT doc_id, page, name, arg_max(struct_pack(author := author, x := x), ordinal * 1000000 + ord) AS p FROM patches GROUP BY 1, 2, 3), firsts AS (SELECT doc_id, page, name, min(ord) AS first FROM ann GROUP BY 1, 2, 3)"""


def _patches(spark, sf_dir):
    a = annotations(spark, sf_dir).where("ord % 6 < 3")
    return a.select("doc_id", "page", "name", (F.col("ord") % 5 * 1_000_000 + F.col("ord")).alias("ordinal"), F.when(F.col("ord") % 2 == 0, F.concat(F.lit("p"), F.col("ord").cast("string"))).alias("author"), F.when(F.col("ord") % 3 == 0, F.col("x") + 1).alias("x"))


@query(f"""WITH {_PATCH} SELECT doc_id, page, name, ord, CASE WHEN ord = first THEN coalesce(p.author, ann.author) ELSE ann.author END AS author, CASE WHEN ord = first THEN coalesce(p.x, ann.x) ELSE ann.x END AS x FROM ann JOIN firsts USING (doc_id, page, name) LEFT JOIN last USING (doc_id, page, name)""")
def annotation_patch(spark, sf_dir):
    return A.patched(annotations(spark, sf_dir), _patches(spark, sf_dir), ["author", "x"]).select("doc_id", "page", "name", "ord", "author", "x")


@query(f"""WITH {_PATCH} SELECT doc_id, page, name, ord, CASE WHEN ord = first AND p IS NOT NULL THEN p.author ELSE ann.author END AS author, CASE WHEN ord = first AND p IS NOT NULL THEN p.x ELSE ann.x END AS x FROM ann JOIN firsts USING (doc_id, page, name) LEFT JOIN last USING (doc_id, page, name)""")
def annotation_update(spark, sf_dir):
    return A.replaced(annotations(spark, sf_dir), _patches(spark, sf_dir), ["author", "x"]).select("doc_id", "page", "name", "ord", "author", "x")


@query(f"WITH {ANN}, u AS (SELECT doc_id, page + 1 AS page, name FROM ann WHERE ord % 6 < 3) SELECT doc_id, page, name FROM u ANTI JOIN ann USING (doc_id, page, name)")
def annotation_update_antijoin(spark, sf_dir):
    a = annotations(spark, sf_dir)
    return A.missing(a, a.where("ord % 6 < 3").select("doc_id", (F.col("page") + 1).alias("page"), "name"))


@query(f"WITH {ANN}, g AS (SELECT doc_id, page, name, min(ord) AS ord FROM ann WHERE (doc_id, page, name) IN (SELECT doc_id, page, name FROM ann WHERE ord % 10 = 0) GROUP BY 1, 2, 3) SELECT doc_id, page, name, ord FROM ann ANTI JOIN g USING (doc_id, page, name, ord)")
def annotation_remove(spark, sf_dir):
    a = annotations(spark, sf_dir)
    return A.removed(a, a.where("ord % 10 = 0")).select("doc_id", "page", "name", "ord")


@query(f"WITH {ANN}, e AS (SELECT *, CASE ord % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'update' ELSE 'remove' END AS action FROM ann), l AS (SELECT doc_id, page, name, arg_max(action, ord) AS action, arg_max(x, ord) AS x, min(ord) AS ord FROM e GROUP BY 1, 2, 3) SELECT doc_id, page, name, ord, x FROM l WHERE action <> 'remove'")
def annotation_fold(spark, sf_dir):
    action = F.when(F.col("ord") % 3 == 0, "add").when(F.col("ord") % 3 == 1, "update").otherwise("remove")
    return A.folded_edits(annotations(spark, sf_dir).withColumns({"action": action, "seq": F.col("ord")}), ["x"])


@query(f"WITH {ANN} SELECT DISTINCT doc_id, page FROM ann WHERE NOT (ephemeral AND ord % 8 = 0)")
def annotation_dirty_pages(spark, sf_dir):
    edits = annotations(spark, sf_dir).withColumns({"was_ephemeral": F.col("ephemeral"), "is_ephemeral": F.col("ord") % 8 == 0})
    return A.dirty_pages(edits)


@query(f"WITH {ANN}, n AS (SELECT doc_id, page, NULL AS name, ord FROM ann WHERE ord % 20 = 0), l AS (SELECT doc_id, page, max(ord) AS last FROM ann WHERE ord % 20 <> 0 GROUP BY 1, 2), p AS (SELECT n.doc_id, n.page, coalesce(last, -1) + row_number() OVER (PARTITION BY n.doc_id, n.page ORDER BY ord) AS ord FROM n LEFT JOIN l ON n.doc_id = l.doc_id AND n.page = l.page) SELECT doc_id, page, sha256(doc_id || ':' || page || ':' || ord) AS name, ord FROM p UNION ALL SELECT doc_id, page, name, ord FROM ann WHERE ord % 20 <> 0")
def annotation_add(spark, sf_dir):
    a = annotations(spark, sf_dir).select("doc_id", "page", "name", "ord")
    return A.added(a.where("ord % 20 != 0"), a.where("ord % 20 = 0").withColumn("name", F.lit(None).cast("string"))).select("doc_id", "page", "name", "ord")



def _bounds():
    return A.rect(F.col("x"), F.col("y"), F.col("width"), F.col("height"))


def _points():
    at = lambda k: A.point(F.col("x") + F.col("width") * k / 4, F.col("y") + F.col("height") * k / 2)
    return F.array(at(0), at(1), at(3))


_PTS = "unnest([0, 1, 2]) AS i, unnest([struct_pack(x := x, y := y), struct_pack(x := x + width * 1 / 4, y := y + height * 1 / 2), struct_pack(x := x + width * 3 / 4, y := y + height * 3 / 2)]) AS p"


@query(f"WITH {ANN}, q AS (SELECT ord, x, y, {_PTS} FROM ann) SELECT ord, CAST(i AS BIGINT) AS i, round(x + 3, 6) AS bx, round(y - 2, 6) AS byy, round(p.x + 3, 6) AS px, round(p.y - 2, 6) AS py FROM q")
def annotation_offset(spark, sf_dir):
    dx, dy = F.lit(3.0), F.lit(-2.0)
    moved = annotations(spark, sf_dir).select("ord", A.moved_rect(_bounds(), dx, dy).alias("b"), F.posexplode(A.moved_points(_points(), dx, dy)).alias("i", "p"))
    return moved.select("ord", F.col("i").cast("long").alias("i"), *(F.round(c, 6).alias(n) for c, n in (("b.x", "bx"), ("b.y", "byy"), ("p.x", "px"), ("p.y", "py"))))


@query(f"""WITH {ANN}, q AS (SELECT *, {_PTS} FROM ann) SELECT ord, CAST(i AS BIGINT) AS i, round(10 + CASE WHEN width > 0 THEN (p.x - x) / width ELSE 0 END * 200, 6) AS px, round(20 + CASE WHEN height > 0 THEN (p.y - y) / height ELSE 0 END * 100, 6) AS py FROM q""")
def annotation_resize(spark, sf_dir):
    new = A.rect(F.lit(10.0), F.lit(20.0), F.lit(200.0), F.lit(100.0))
    sized = annotations(spark, sf_dir).select("ord", F.posexplode(A.resized_points(_points(), _bounds(), new)).alias("i", "p"))
    return sized.select("ord", F.col("i").cast("long").alias("i"), F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"))


_HANDLES = ("n", "ne", "e", "se", "s", "sw", "w", "nw")


@query(f"""WITH {ANN}, h AS (SELECT *, [{', '.join(f"'{h}'" for h in _HANDLES)}][ord % 8 + 1] AS handle, 15 - ord % 40 AS dx, 10 - ord % 30 AS dy FROM ann),
    r AS (SELECT ord, handle, x + CASE WHEN contains(handle, 'w') THEN dx ELSE 0 END AS x, width + CASE WHEN contains(handle, 'w') THEN -dx WHEN contains(handle, 'e') THEN dx ELSE 0 END AS w, y + CASE WHEN contains(handle, 'n') THEN dy ELSE 0 END AS y, height + CASE WHEN contains(handle, 'n') THEN -dy WHEN contains(handle, 's') THEN dy ELSE 0 END AS h FROM h)
    SELECT ord, handle, round(CASE WHEN w < 2 THEN x + w - 2 ELSE x END, 6) AS x, round(CASE WHEN h < 2 THEN y + h - 2 ELSE y END, 6) AS y, round(greatest(w, 2), 6) AS width, round(greatest(h, 2), 6) AS height FROM r""")
def annotation_resize_handles(spark, sf_dir):
    handle = F.element_at(F.array(*map(F.lit, _HANDLES)), (F.col("ord") % 8 + 1).cast("int"))
    moved = annotations(spark, sf_dir).withColumn("handle", handle)
    r = A.resized_bounds(_bounds(), F.col("handle"), (F.lit(15) - F.col("ord") % 40).cast("double"), (F.lit(10) - F.col("ord") % 30).cast("double"))
    return moved.select("ord", "handle", r.alias("r")).select("ord", "handle", *(F.round(f"r.{c}", 6).alias(c) for c in ("x", "y", "width", "height")))


@query(f"WITH {ANN} SELECT doc_id, page, count(*) AS n_points, min(x) AS x, min(y) AS y, round(max(x) - min(x), 6) AS width, round(max(y) - min(y), 6) AS height FROM ann WHERE kind IN ('square', 'ink') GROUP BY doc_id, page, kind HAVING CASE WHEN kind = 'square' THEN max(x) > min(x) AND max(y) > min(y) ELSE count(*) >= 2 END")
def bounding_rect(spark, sf_dir):
    strokes = annotations(spark, sf_dir).where("kind IN ('square', 'ink')").select("doc_id", "page", F.col("kind").alias("tool"), F.col("ord").alias("seq"), "x", "y")
    shapes = A.drawn(strokes, ["doc_id", "page"])
    return shapes.select("doc_id", "page", F.size("points").cast("long").alias("n_points"), F.col("bounds.x").alias("x"), F.col("bounds.y").alias("y"), F.round("bounds.width", 6).alias("width"), F.round("bounds.height", 6).alias("height"))


@query(f"WITH {ANN}, t AS (SELECT ord, (ord % 4) * 90 AS turn, x, y FROM ann) SELECT ord, CASE turn WHEN 90 THEN y WHEN 180 THEN -x WHEN 270 THEN -y ELSE x END AS dx, CASE turn WHEN 90 THEN -x WHEN 180 THEN -y WHEN 270 THEN x ELSE y END AS dy FROM t")
def unrotated_moves(spark, sf_dir):
    moved = A.unrotated(F.col("x"), F.col("y"), F.col("ord") % 4 * 90)
    return annotations(spark, sf_dir).select("ord", moved.alias("m")).select("ord", F.col("m.x").alias("dx"), F.col("m.y").alias("dy"))


@query(f"WITH {ANN}, b AS (SELECT a.ord, abs(a.x - b.x) < 0.1 AND abs(a.y - b.y) < 0.1 AND abs(a.width - b.width) < 0.1 AND abs(a.height - b.height) < 0.1 AS same FROM ann a JOIN ann b ON b.ord = a.ord + 1) SELECT * FROM b")
def bounds_match(spark, sf_dir):
    a = annotations(spark, sf_dir).select("ord", _bounds().alias("a"))
    following = annotations(spark, sf_dir).select((F.col("ord") - 1).alias("ord"), _bounds().alias("b"))
    return a.join(following, "ord").select("ord", A.same_bounds(F.col("a"), F.col("b")).alias("same"))


@query("""WITH RECURSIVE c AS (SELECT user_id AS doc_id, event_id AS id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events), r AS (SELECT doc_id, id AS name, CASE WHEN id % 4 > 0 THEN before END AS parent_name FROM c),
    t AS (SELECT doc_id, name, name AS thread, 0 AS depth FROM r WHERE parent_name IS NULL UNION ALL SELECT r.doc_id, r.name, t.thread, t.depth + 1 FROM r JOIN t ON r.doc_id = t.doc_id AND r.parent_name = t.name)
    SELECT doc_id, name, thread, depth, least(depth, 3) AS shown_depth FROM t""")
def reply_threads(spark, sf_dir):
    from pyspark.sql import Window as W

    before = F.lag("event_id").over(W.partitionBy("user_id").orderBy("event_id"))
    comments = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("name"), before.alias("before")).select("doc_id", "name", F.when(F.col("name") % 4 > 0, F.col("before")).alias("parent_name"))
    return A.replies(comments)


_KINDS = ("xyz", "fit", "fitH", "fitV", "fitB", "fitBH", "fitBV", "fitR")


@query(f"""WITH {ANN}, d AS (SELECT ord, [{', '.join(f"'{k}'" for k in _KINDS)}][ord % 8 + 1] AS kind, page - 3 AS page_index, x, CASE WHEN ord % 3 > 0 THEN y END AS y, x / 100 - 1 AS zoom FROM ann)
    SELECT ord, greatest(1, least(page_index + 1, 80)) AS page, CASE WHEN kind IN ('xyz', 'fitV', 'fitBV') THEN x END AS scroll_x, CASE WHEN kind IN ('xyz', 'fitH', 'fitBH') THEN y END AS scroll_y, CASE WHEN kind = 'xyz' AND zoom > 0 THEN zoom END AS zoom FROM d""")
def navigation_targets(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("ord") % 8 + 1).cast("int"))
    t = A.navigation_target(kind, F.col("page") - 3, F.lit(80), F.col("x"), F.when(F.col("ord") % 3 > 0, F.col("y")), F.col("x") / 100 - 1)
    return annotations(spark, sf_dir).select("ord", t.alias("t")).select("ord", "t.*")


@query(f"""WITH {ANN}, r AS (SELECT ord, floor((x - 50) * 2 + 0.5) AS l, floor(y * 2 + 0.5) AS t, floor(width * 2 + 0.5) AS w, floor(height * 2 + 0.5) AS h, width, height FROM ann),
    c AS (SELECT ord, greatest(l, 0) AS l, greatest(t, 0) AS t, least(l + w, 600) AS rt, least(t + h, 400) AS b, width > 0 AND height > 0 AS ok FROM r)
    SELECT ord, CASE WHEN ok AND rt > l AND b > t THEN CAST(l AS BIGINT) END AS x, CASE WHEN ok AND rt > l AND b > t THEN CAST(t AS BIGINT) END AS y, CASE WHEN ok AND rt > l AND b > t THEN CAST(rt - l AS BIGINT) END AS width, CASE WHEN ok AND rt > l AND b > t THEN CAST(b - t AS BIGINT) END AS height FROM c""")
def region_crop(spark, sf_dir):
    r = A.region(F.col("x") - 50, F.col("y"), F.col("width"), F.col("height"), 2.0, F.lit(600).cast("long"), F.lit(400).cast("long"))
    return annotations(spark, sf_dir).select("ord", r.alias("r")).select("ord", "r.x", "r.y", "r.width", "r.height")


@query("""WITH l AS (SELECT DISTINCT lang || s AS locale FROM documents, (VALUES ('-XX'), (''), ('-BR'), ('-CN')) AS v(s)), x AS (SELECT locale FROM l UNION SELECT * FROM (VALUES ('zh-Hans'), ('zh-TW'), ('pt'), ('pt-PT'), ('it'), ('')))
    SELECT locale, CASE WHEN locale IN ('en', 'zh-CN', 'zh-TW', 'ja', 'ko', 'es', 'fr', 'de', 'pt-BR', 'ar', 'ru') THEN locale WHEN split_part(locale, '-', 1) = 'zh' THEN 'zh-CN' WHEN split_part(locale, '-', 1) = 'pt' THEN 'pt-BR' WHEN split_part(locale, '-', 1) IN ('en', 'ja', 'ko', 'es', 'fr', 'de', 'ar', 'ru') THEN split_part(locale, '-', 1) ELSE 'en' END AS resolved FROM x""")
def locale_resolve(spark, sf_dir):
    suffixes = F.array(*map(F.lit, ("-XX", "", "-BR", "-CN")))
    locales = table(spark, sf_dir, "documents").select("lang").distinct().select(F.explode(F.transform(suffixes, lambda s: F.concat("lang", s))).alias("locale"))
    few = spark.createDataFrame([("zh-Hans",), ("zh-TW",), ("pt",), ("pt-PT",), ("it",), ("",)], "locale string")
    return locales.union(few).distinct().select("locale", B.resolve_locale(F.col("locale")).alias("resolved"))


@query("SELECT event_id, 'Page ' || event_id || ' of ' || user_id || ' {other}' AS text FROM events")
def interpolate(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", B.interpolate(F.lit("Page {page} of {total} {other}"), {"page": F.col("event_id"), "total": F.col("user_id")}).alias("text"))


@query("SELECT event_id, user_id || ':' || event_id || ':' || event_type || ':' || printf('%.4f', value / 4) AS key FROM events")
def render_key(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", B.render_key(F.col("user_id"), F.col("event_id"), F.col("event_type"), F.col("value") / 4).alias("key"))


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN encode('PK' || text) WHEN 1 THEN encode('GIF89' || text) WHEN 2 THEN encode('BM' || text) WHEN 3 THEN encode('BA') WHEN 4 THEN encode('PK') ELSE encode(coalesce(text, '')) END AS c FROM documents)
    SELECT doc_id, octet_length(c) >= 4 AND hex(c)[1:4] = '504B' AS is_zip, CASE WHEN hex(c)[1:6] = '474946' THEN 'gif' WHEN hex(c)[1:4] IN ('424D', '4241') THEN 'bmp' ELSE 'unknown' END AS image FROM d""")
def detect_format(spark, sf_dir):
    m, t = F.col("doc_id") % 6, F.coalesce("text", F.lit(""))
    content = F.when(m == 0, F.concat(F.lit("PK"), t)).when(m == 1, F.concat(F.lit("GIF89"), t)).when(m == 2, F.concat(F.lit("BM"), t)).when(m == 3, "BA").when(m == 4, "PK").otherwise(t).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", content.alias("c")).select("doc_id", B.is_zip(F.col("c")).alias("is_zip"), B.image_format(F.col("c")).alias("image"))


@query("""SELECT page_id, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' OR suffix(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') THEN 'document.pdf' ELSE list_extract(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), -1) END AS filename FROM pages""")
def default_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", B.default_filename(F.col("url"), F.lit("pdf")).alias("filename"))


@query("SELECT p_partkey, printf('#%02x%02x%02x', CAST(floor((p_size % 7) / 6.0 * 255 + 0.5) AS INTEGER), CAST(floor((p_size % 5) / 4.0 * 255 + 0.5) AS INTEGER), CAST(floor((p_size % 3) / 2.0 * 255 + 0.5) AS INTEGER)) AS hex, 'rgb(' || CAST(floor((p_size % 7) / 6.0 * 255 + 0.5) AS INTEGER) || ', ' || CAST(floor((p_size % 5) / 4.0 * 255 + 0.5) AS INTEGER) || ', ' || CAST(floor((p_size % 3) / 2.0 * 255 + 0.5) AS INTEGER) || ')' AS rgb FROM part")
def colors(spark, sf_dir):
    r, g, b = (F.col("p_size") % n / float(n - 1) for n in (7, 5, 3))
    return table(spark, sf_dir, "part").select("p_partkey", B.hex_color(r, g, b).alias("hex"), B.rgba(r, g, b).alias("rgb"))


_VALUES = ("0", "false", "off", "1", "on", "FF00ff", "auto", "12345", "zzzzzz", "center", "end", "both", "thick", "dashDot", "heading 3", "Heading  0", "heading x")


@query(f"""WITH v AS (SELECT DISTINCT [{', '.join(f"'{x}'" for x in _VALUES)}, NULL][p_partkey % {len(_VALUES) + 1} + 1] AS v FROM part)
    SELECT v, CASE WHEN v IS NULL THEN true ELSE v NOT IN ('0', 'false', 'off') END AS toggled, CASE WHEN regexp_full_match(v, '[0-9A-Fa-f]{{6}}') THEN CAST(('0x' || v[1:2])::INTEGER || ',' || ('0x' || v[3:4])::INTEGER || ',' || ('0x' || v[5:6])::INTEGER AS VARCHAR) END AS color,
    CASE WHEN v IN ('center') THEN 'center' WHEN v IN ('right', 'end') THEN 'right' WHEN v IN ('both', 'distribute', 'justify') THEN 'justify' ELSE 'left' END AS align, CASE WHEN v IN ('thick', 'single') THEN 'single' WHEN v = 'dashDot' THEN 'dashed' ELSE 'none' END AS border,
    CASE WHEN regexp_full_match(lower(trim(v)), 'heading [ ]*[0-9]+') THEN greatest(CAST(regexp_extract(v, '([0-9]+)$', 1) AS INTEGER) - 1, 0) END AS heading FROM v""")
def property_values(spark, sf_dir):
    at = (F.col("p_partkey") % (len(_VALUES) + 1) + 1).cast("int")
    v = table(spark, sf_dir, "part").select(F.element_at(F.array(*map(F.lit, _VALUES), F.lit(None)), at).alias("v")).distinct()
    c = F.col("v")
    return v.select("v", B.toggle_on(c).alias("toggled"), F.array_join(B.parse_color(c), ",").alias("color"), B.parse_align(c).alias("align"), B.parse_border(c).alias("border"), B.heading_level(c).alias("heading"))
