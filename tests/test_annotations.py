"""Reply threads of any depth."""

from docflow.operators.annotations import replies


def test_long_threads(spark):
    chain = [(1, k, k - 1 if k else None) for k in range(200)]
    rest = [(2, 0, None), (2, 1, 0), (2, 7, 8), (2, 8, 9), (2, 9, 7), (2, 10, 7), (2, 20, 20), (2, 30, 99), (2, 31, 30)]  # a thread, cycles, a missing parent
    got = {(r.doc_id, r.name): (r.thread, r.depth, r.shown_depth) for r in replies(spark.createDataFrame(chain + rest, "doc_id long, name long, parent_name long")).collect()}
    assert got == {(1, k): (0, k, min(k, 3)) for k in range(200)} | {(2, 0): (0, 0, 0), (2, 1): (0, 1, 1)}
