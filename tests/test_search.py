import random

import pytest
from pyspark.sql import functions as F

from docflow.operators import search as S


def pages(spark, *texts):
    return spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "doc_id int, page_index int, text string")


def hits(df):
    return sorted((r.page_index, r.char_offset, r.length) for r in df.collect())


@pytest.mark.parametrize(
    "texts, query, options, want",
    [
        (["Hello world"], "", {}, []),
        (["Hello world"], "   ", {}, []),
        (["Hello world"], "world", {}, [(0, 6, 5)]),
        (["Hello world, hello world"], "world", {}, [(0, 6, 5), (0, 19, 5)]),
        (["Hello World"], "world", {"case_sensitive": True}, []),
        (["Hello world", "Hello again"], "Hello", {}, [(0, 0, 5), (1, 0, 5)]),
        (["• Paragraph"], "Paragraph", {"fuzzy": True}, [(0, 2, 9)]),
        (["Paragraph one"], "• Paragraph", {"fuzzy": True}, [(0, 0, 9)]),
        (["Patient assessment complete"], "· Patient assessment", {"fuzzy": True}, [(0, 0, 18)]),
        (["state-of-the-art"], "stateoftheart", {"fuzzy": True}, []),
        (["investigator’s assessment"], "investigator's", {"fuzzy": True}, [(0, 0, 14)]),
        (["“state—of–art”"], '"state-of-art"', {"fuzzy": True}, [(0, 0, 14)]),
        (["investigator’s"], "investigator's", {}, []),
        (["aaaa", None, ""], "aa", {}, [(0, 0, 2), (0, 1, 2), (0, 2, 2)]),
        (["a.b\\E(c", "a.b\\E(c"], ".b\\E(", {"page_range": (1, 5)}, [(1, 1, 5)]),
    ],
)
def test_vectors(spark, texts, query, options, want):
    assert hits(S.search(pages(spark, *texts), query, **options)) == want


@pytest.mark.parametrize("mark", "•·◦▪‣⁃●■")
def test_list_markers(spark, mark):
    assert len(hits(S.search(pages(spark, f"{mark} Item"), f"{mark} Item", fuzzy=True))) == 1


def test_random_overlaps(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab. é😀\n") for _ in range(rnd.randrange(40))) for _ in range(60)]
    for query in ("a", "aa", "ab.", "😀", "b\n"):
        want = [(i, k, len(query)) for i, t in enumerate(texts) for k in range(len(t)) if t.startswith(query, k)]
        assert hits(S.search(pages(spark, *texts), query)) == sorted(want)


def test_context(spark):
    row = S.search(pages(spark, "first line\nThis is a test sentence for search context"), "test", context=True).first()
    assert (row.before, row.match, row.after) == ("This is a ", "test", " sentence for search…")


def test_rects(spark):
    glyphs = [(0.0, 0.0, 5.0, 10.0, 0.0), (5.0, 0.0, 5.0, 12.0, 0.0), (0.0, 20.0, 5.0, 10.0, 0.0)]
    df = spark.createDataFrame([(glyphs,), ([],)], "g array<struct<x:double,y:double,advance:double,font_size:double,angle:double>>")
    two, none = (r[0] for r in df.select(S.match_rects(F.col("g"))).collect())
    assert [tuple(round(v, 6) for v in (r.x, r.y, r.width, r.height)) for r in two] == [(0.0, -9.6, 10.0, 12.0), (0.0, 12.0, 5.0, 10.0)] and none == []


def test_page_text(spark):
    runs = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None), (2, 1, "")], "page int, ord int, text string")
    assert [tuple(r) for r in S.page_text(runs, ["page"]).collect()] == [(1, "ab")]
