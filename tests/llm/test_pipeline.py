"""The pipeline's stages, one after the other, against a brute-force version of each on what the one before kept."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tests.llm.test_small import bands_brute, base_spans, measured_brute, near_brute
from tokenizers import Tokenizer

import corpus_pipeline
from docflow.llm import pii

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, after = docs.columns, []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        after.append(docs.collect())
        assert number == 4 or docs.columns == columns
    start = spark.read.parquet(f"{SF}/documents.parquet").collect()

    good = [r for r, kept in zip(start, bands_brute(measured_brute([(r.doc_id, r.text, r.lang) for r in start]))) if kept]
    assert Counter(after[0]) == Counter(good)

    best = defaultdict(lambda: -1)
    for r in good:
        best[r.text] = max(best[r.text], r.doc_id)
    single = [r for r in good if best[r.text] == r.doc_id]
    assert Counter(after[1]) == Counter(single)

    kept = {r.doc_id: r for r, (_, n, least) in zip(single, near_brute([tuple(r) for r in single])) if r.doc_id == least}
    assert {r.doc_id for r in after[2]} == set(kept) and Counter(after[2]) == Counter(kept.values())

    masked = {r.doc_id: r.text for r in after[3]}
    assert set(masked) == set(kept)
    for doc_id, row in kept.items():
        spans, text, at = base_spans(row.text), "", 0
        if "[TERM]" in masked[doc_id]:
            continue
        for begin, _, end, kind in spans:
            if end > at:
                text += row.text[at : max(at, begin)] + (pii.MASKS[kind] if begin >= at else "")
                at = end
        assert masked[doc_id] == text + row.text[at:]

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = sorted(after[4], key=lambda r: (r.sequence_id, r.offset))
    place = 0
    for r in pieces:
        assert r.sequence_id * 2048 + r.offset == place
        place += r.length
        ids = np.array([*tokenizer.encode(masked[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    covered = Counter()
    for r in pieces:
        covered[r.doc_id] += r.length
    assert covered == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in masked.items()}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len(corpus_pipeline.STAGES) == 5
