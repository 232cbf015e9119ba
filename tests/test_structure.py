import random

from docflow.functions import labels as B
from docflow.operators import layout as L
from docflow.operators import structure as S
from pyspark.sql import functions as F


def test_spreads(spark):
    docs = spark.createDataFrame([("a", 6)], "doc_id string, page_count int")
    rows = sorted(L.spreads(docs, "odd-left").collect(), key=lambda r: r.spread_index)
    assert [(r.slot0, r.slot1) for r in rows] == [(1, None), (3, 2), (5, 4), (None, 6)]
    docs = spark.createDataFrame([("a", 5), ("b", 0)], "doc_id string, page_count int")
    rows = sorted(L.spreads(docs, "odd-right").collect(), key=lambda r: r.spread_index)
    assert [(r.slot0, r.slot1) for r in rows] == [(None, 1), (2, 3), (4, 5)]


def test_spread_sizes(spark):
    pages = spark.createDataFrame([("a", i, 612.0, 792.0, 0) for i in range(3)], "doc_id string, page_index int, width double, height double, rotation int")
    first = L.spread_layouts(pages, "single").orderBy("spread_index").first()
    assert (first.top, first.width, first.height) == (20.0, 816.0, 1056.0)
    assert [r.width for r in L.spread_layouts(pages, "double").collect()] == [816.0 * 2 + 10] * 2
    assert L.spread_layouts(pages, "single", user_rotation=90).first().width == 1056.0


def test_visible_range(spark):
    layouts = spark.createDataFrame([("a", i, 220.0 * i, 100.0, 200.0) for i in range(5)], "doc_id string, spread_index int, top double, width double, height double")
    assert tuple(L.visible_range(layouts, F.lit(200.0), 500.0, 1).first()) == ("a", 0, 4)
    assert tuple(L.visible_range(layouts, F.lit(200.0), 500.0, 0).first()) == ("a", 0, 3)


def _tree(entries, level):
    """Depths by recursion over (level, place)."""
    depths, at = {}, 0

    def build(level, depth):
        nonlocal at
        while at < len(entries) and entries[at] >= level:
            depths[at] = depth
            at += 1
            build(level + 1, depth + 1)

    build(level, 0)
    return depths


def test_outline_random(spark):
    rnd = random.Random(1)
    docs = {d: [rnd.randrange(6) for _ in range(rnd.randrange(1, 15))] for d in range(60)}
    rows = [(d, i, lv, "t") for d, lvs in docs.items() for i, lv in enumerate(lvs)] + [(0, 99, 0, "  ")]
    got = {(r.doc_id, r.idx): r.depth for r in S.outline(spark.createDataFrame(rows, "doc_id int, idx int, level int, title string")).collect()}
    assert got == {(d, i): depth for d, lvs in docs.items() for i, depth in _tree(lvs, min(lvs)).items()}


def test_numbering_random(spark):
    rnd = random.Random(2)
    levels = [(1, i, rnd.randrange(4), "decimal", f"%{i + 1}.") for i in range(4)]
    items = [(d, i, rnd.randrange(1, 4), rnd.randrange(6)) for d in range(20) for i in range(40)]
    numbers = [(1, 1), (2, 1)]
    got = {(r.doc_id, r.idx): (r["count"], r.label) for r in S.numbered(spark.createDataFrame(items, "doc_id int, idx int, num_id int, ilvl int"), spark.createDataFrame(numbers, "num_id int, abstract_id int"), spark.createDataFrame(levels, "abstract_id int, ilvl int, start int, fmt string, level_text string")).collect()}
    want, counters = {}, {}
    for d, i, num, level in items:
        if num not in (1, 2) or level > 3:
            want[d, i] = (None, "")
            continue
        start = levels[level][2]
        counters[d, num, level] = counters.get((d, num, level), max(start - 1, 0)) + 1
        for deeper in range(level + 1, 9):
            counters.pop((d, num, deeper), None)
        want[d, i] = (counters[d, num, level], f"{counters[d, num, level]}. ")
    assert got == want


def test_pagination_random(spark):
    rnd = random.Random(4)
    height, rows, want = 100.0, [], {}
    for d in range(30):
        y = 0.0
        for i in range(30):
            page = max(0, int((y + 0.25) // height))
            want[d, i] = page
            if rnd.random() < 0.15:
                rows.append((d, i, "break", 0.0, 0.0, None))
                y = (page + 1) * height
                continue
            images = [float(rnd.randrange(0, 120)) for _ in range(rnd.randrange(3))] if d % 2 else None
            h = float(rnd.randrange(1, 60))
            rows.append((d, i, "paragraph", h, 0.0, images))
            for image in images or ():
                if image >= 1:
                    p = max(0, int((y + 0.25) // height))
                    if y - p * height + image > height >= image:
                        y = (p + 1) * height
                    y += image
            y += h
    df = spark.createDataFrame(rows, "doc_id int, idx long, kind string, height double, space_before double, images array<double>")
    assert {(r.doc_id, r.idx): r.page for r in S.paginated_with_images(df, height).collect()} == want
    plain = {(r.doc_id, r.idx): r.page for r in S.paginated(df.where("doc_id % 2 = 0"), height).collect()}
    assert plain == {k: v for k, v in want.items() if k[0] % 2 == 0}


def test_inheritance_ends(spark):
    """33 styles count, cycles and missing bases end the chain."""
    rows = [(1, f"s{i}", f"s{i + 1}", "deep" if i == at else None) for i in range(60) for at in (32,)]
    rows += [(1, "a", "b", None), (1, "b", "a", "x"), (1, "c", "nowhere", None)]
    got = {r.style_id: r.font for r in S.inherited(spark.createDataFrame(rows, "doc_id int, style_id string, based_on string, font string"), ["font"]).collect()}
    assert got["s0"] == "deep" and got["s32"] == "deep" and got["s33"] is None and got["a"] == "x" and got["c"] is None
    rows = [(1, f"s{i}", f"s{i + 1}", "deep" if i == 33 else None) for i in range(60)]
    got = {r.style_id: r.font for r in S.inherited(spark.createDataFrame(rows, "doc_id int, style_id string, based_on string, font string"), ["font"]).collect()}
    assert got["s0"] is None and got["s1"] == "deep"


def test_labels(spark):
    df = spark.createDataFrame([(4,), (1999,), (0,), (257,)], "n int")
    assert [r[0] for r in df.select(B.roman(F.col("n"), True)).collect()] == ["IV", "MCMXCIX", "0", "CCLVII"]
    assert df.select(B.letter(F.col("n"))).collect()[3][0] == "a"


def test_levels_beyond(spark):
    """Levels that lists do not have get no label and do not fail; an outline may be of any depth."""
    items = spark.createDataFrame([(1, i, 1, v) for i, v in enumerate([0, 9, -1, 0, None, 40])], "doc_id int, idx int, num_id int, ilvl int")
    levels = spark.createDataFrame([(1, v, 1, "decimal", "%1.") for v in (0, 9, -1)], "abstract_id int, ilvl int, start int, fmt string, level_text string")
    got = {r.idx: (r["count"], r.label) for r in S.numbered(items, spark.createDataFrame([(1, 1)], "num_id int, abstract_id int"), levels).collect()}
    assert got == {0: (1, "1. "), 1: (None, ""), 2: (None, ""), 3: (2, "2. "), 4: (None, ""), 5: (None, "")}
    deep = spark.createDataFrame([(1, i, i, "t") for i in range(30)] + [(1, 30, 12, "t"), (1, 31, 0, "t")], "doc_id int, idx int, level int, title string")
    found = {r.idx: (r.depth, r.parent_idx) for r in S.outline(deep).collect()}
    assert found == {**{i: (i, i - 1 if i else None) for i in range(30)}, 30: (12, 11), 31: (0, None)}
