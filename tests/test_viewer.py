import random

from docflow.operators import activity as A
from docflow.operators import viewer as V


def test_undo_redo_random(spark):
    rnd = random.Random(6)
    rows, want = [], {}
    for key in range(30):
        undo, redo = [], []
        for seq in range(rnd.randrange(80)):
            action = rnd.choice(["edit", "edit", "edit", "undo", "redo"])
            rows.append((key, seq, action, seq))
            if action == "edit":
                undo.append(seq)
                undo, redo = undo[-5:], []
            elif action == "undo" and undo:
                redo.append(undo.pop())
            elif action == "redo" and redo:
                undo.append(redo.pop())
            want[key] = (undo[:], redo[:])
    got = {r.key: (r.undo, r.redo) for r in V.undo_redo(spark.createDataFrame(rows, "key int, seq int, action string, entry long"), "key", "seq", 5).collect()}
    assert got == want


def test_throttle_random(spark):
    rnd = random.Random(8)
    rows, want = [], []
    for key in range(20):
        last = None
        for t in sorted(rnd.sample(range(5000), 40)):
            rows.append((key, t))
            if last is None or t - last >= 300:
                last = t
                want.append((key, t))
    got = A.throttled(spark.createDataFrame(rows, "key int, ms long"), "key", "ms", 300)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_queue_order(spark):
    rows = [(0, 1, "thumbnail", 1, 9), (0, 2, "fontUsageCheck", 1, 5), (0, 3, "text", 1, 5), (0, 4, "page", 1, 5), (0, 5, "preview", 1, 30), (0, 6, "preview", 2, 5), (0, 7, "annotation", 1, 6), (0, 8, "page", 1, 5)]
    queue = spark.createDataFrame([(*r, 1, 5, None, None) for r in rows], "client int, seq int, kind string, doc int, page int, focus_doc int, focus_page int, thumb_doc int, thumb_page int")
    assert [r.seq for r in A.queue_order(queue, "client", "seq").orderBy("position").collect()] == [4, 8, 3, 7, 5, 6, 2, 1]
