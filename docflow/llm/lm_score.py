"""Language-model scores: prediction by partial matching over bytes, and a smoothed word model as its base.

The model is a byte-context trie of ORDER levels and the root, counted over all training texts. A symbol is coded in the
longest context that has seen it; every context that has not gives an escape (method C: distinct symbols over occurrences
plus distinct symbols), and symbols that a longer context has seen are excluded from the shorter ones. Below the root all
remaining byte values are alike. Counting, the trie's levels, escapes and exclusions are grouped sums and joins, so the
model may grow with the corpus: no task and no driver ever holds it. What is trained is static, so the code length of a
window of ORDER + 1 bytes is one number, computed once.

Blocks: each task of the first pass counts the words and byte windows of its documents (a block). After counts and code
lengths are joined over the corpus, each block gets back the entries of its own dictionary, so a scoring task holds no
more than its block has distinct words and windows.

A text is lower-cased (A-Z), starts in a context of zero bytes and ends with a zero byte, which is scored, too. A text is
held out if crc32 of its doc_id as text leaves 1 modulo 5.

Defined results: null text counts as empty (one token, the end); a null doc_id reads as the empty string, so it trains;
repeated rows are counted and scored each; with no training text all counts are zero; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.shared import arrow_schema, id_of, materialize, slices, table_of, text_of, tidy

ORDER = 3
FOLDS, HELD_OUT = 5, 1
BATCH_BYTES = 1 << 20
#: Distinct words that a counting task gathers before it writes them.
MOST_WORDS = 600_000
#: The end of a text as a token; no word is empty.
END = b""
DOC, WORD, GRAM = 2, 0, 1
BLOCKS = table_of("block int, kind int, doc_id long, text binary, word binary, gram long, n long")
SCORES = table_of("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of ORDER + 1 bytes of the texts (padded), and where each text's windows start."""
    pad, sizes = b"\0" * ORDER, np.array([len(t) + 1 for t in texts], np.int64)
    flat = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\0")), np.uint8).astype(np.uint32)
    gram = flat[: len(flat) - ORDER].copy()
    for k in range(1, ORDER + 1):
        gram = (gram << np.uint32(8)) | flat[k : len(flat) - ORDER + k]
    ends = np.cumsum(sizes + ORDER)
    starts = ends - sizes - ORDER
    inside = np.ones(len(flat), bool)  # windows that run over a text's end are none
    for k in range(ORDER):
        inside[ends - 1 - k] = False
    return gram[inside[: len(gram)]], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def blocks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text), and the dictionaries of their blocks with training counts; in the shared folder."""
    arrow = arrow_schema(BLOCKS)

    def table(block, kind, rows, **columns):
        filled = {"block": pa.array([block] * rows, pa.int32()), "kind": pa.array([kind] * rows, pa.int32()), **columns}
        return pa.RecordBatch.from_arrays([filled.get(f.name, pa.nulls(rows, f.type)) for f in arrow], schema=arrow)

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        counts: Counter[bytes] = Counter()
        other: set[bytes] = set()
        grams: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys, numbers = (np.concatenate(x) for x in zip(*grams))
            order = np.argsort(keys, kind="stable")
            keys, numbers = keys[order], numbers[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(numbers, first)

        def words():
            for found in (counts, dict.fromkeys(other - counts.keys(), 0)):
                if found:
                    yield table(block, WORD, len(found), word=pa.array(found.keys(), pa.binary()), n=pa.array(found.values(), pa.int64()))
            counts.clear()
            other.clear()

        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                ids, texts = batch.column("doc_id").to_pylist(), [t.lower() for t in batch.column("text").cast(pa.binary()).to_pylist()]
                yield table(block, DOC, len(ids), doc_id=batch.column("doc_id"), text=pa.array(texts, pa.binary()))
                train: tuple[list, list] = ([], [])
                for doc_id, text in zip(ids, texts):
                    out = held_out(doc_id)
                    train[out].append(text)
                    (other if out else counts).update(text.split())
                    (other if out else counts).update((END,))
                for out, own in enumerate(train):
                    if own:
                        keys, numbers = np.unique(windows(own)[0], return_counts=True)
                        grams.append((keys, numbers * (1 - out)))
                if len(grams) >= 32:
                    grams[:] = [merged()]
                if len(counts) + len(other) > MOST_WORDS:
                    yield from words()
        yield from words()
        if grams:
            keys, numbers = merged()
            for at in range(0, len(keys), 1 << 17):
                part = slice(at, at + (1 << 17))
                yield table(block, GRAM, len(keys[part]), gram=pa.array(keys[part].astype(np.int64)), n=pa.array(numbers[part].astype(np.int64)))

    return materialize(docs.mapInArrow(tidy(run), BLOCKS), "lm-blocks")


def code_lengths(grams: DataFrame) -> DataFrame:
    """gram, log10 of the probability of its last byte after the others. grams: gram, n (training count, may be 0)."""
    last, low = lambda k: F.col("gram").bitwiseAND((1 << (8 * (k + 1))) - 1), F.col("gram").bitwiseAND(255)
    context = lambda k: F.shiftright(last(k), 8)
    # level k: every context of k bytes with the symbols it has seen
    levels = {}
    for k in range(ORDER, -1, -1):
        source = grams.where("n > 0") if k == ORDER else levels[k + 1]
        levels[k] = materialize(source.groupBy(last(k).alias("gram")).agg(F.sum("n").alias("n")), f"lm-level{k}")
    out = grams.select("gram", F.col("n").alias(f"n{ORDER}"))
    nodes = {}
    for k in range(ORDER, -1, -1):
        seen = levels[k].select(context(k).alias(f"c{k}"), "n", last(k - 1).alias("shorter") if k else F.lit(0).alias("shorter"))
        if k:  # what the context has seen is excluded one level below
            seen = seen.join(levels[k - 1].select(F.col("gram").alias("shorter"), F.col("n").alias("below")), "shorter")
        else:
            seen = seen.withColumn("below", F.lit(0))
        nodes[k] = seen.groupBy(f"c{k}").agg(F.sum("n").alias(f"t{k}"), F.count("*").alias(f"q{k}"), F.sum("below").alias(f"e{k}"))
        out = out.withColumn(f"c{k}", context(k))
        if k < ORDER:
            out = out.withColumn("__g", last(k)).join(levels[k].select(F.col("gram").alias("__g"), F.col("n").alias(f"n{k}")), "__g", "left").drop("__g")
        out = out.join(nodes[k], f"c{k}", "left")
    of = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double")

    def coded(k: int) -> Column:
        """log10 probability at level k after escapes from all levels above, whose symbols are excluded."""
        if k < 0:
            return -F.log10(F.lit(256.0) - of("q0"))
        above = (of(f"e{k + 1}"), of(f"q{k + 1}")) if k < ORDER else (F.lit(0.0), F.lit(0.0))
        total, distinct = of(f"t{k}") - above[0], of(f"q{k}") - above[1]
        escape = F.when(distinct > 0, F.log10(distinct / (total + distinct))).otherwise(0.0)
        return F.when(of(f"n{k}") > 0, F.log10(of(f"n{k}") / (total + distinct))).otherwise(escape + coded(k - 1))

    return out.select("gram", coded(ORDER).alias("bits"))


class Lookup:
    """Values by 32-bit key, open addressing in arrays; looks up whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint32(32 - max(8, int(4 * len(keys)).bit_length()))
        size = 1 << (32 - int(self.shift))
        self.keys, self.values, used = np.zeros(size, np.uint32), np.zeros(size), np.zeros(size, bool)
        at, left = self.slot(keys), np.arange(len(keys))
        while len(left):
            free = left[~used[at[left]]]
            self.keys[at[free]] = keys[free]
            used[at[free]] = True
            placed = np.zeros(len(keys), bool)
            placed[left] = used[at[left]] & (self.keys[at[left]] == keys[left])
            self.values[at[placed]] = values[placed]
            left = left[~placed[left]]
            at[left] = (at[left] + 1) & (size - 1)
        self.used = used

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot(keys)
        wrong = np.flatnonzero((self.keys[at] != keys) | ~self.used[at])
        while len(wrong):
            if not self.used[at[wrong]].all():
                raise KeyError("a window is not in its block's dictionary")
            at[wrong] = (at[wrong] + 1) & (len(self.keys) - 1)
            wrong = wrong[self.keys[at[wrong]] != keys[wrong]]
        return self.values[at]


class Counts:
    """Numbers by word, held as 128-bit digests in arrays with open addressing: 33 bytes a slot, against 200 for a word in a dictionary."""

    def __init__(self, digests: np.ndarray, numbers: np.ndarray):
        size = 1 << max(4, int(2 * len(digests)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.numbers, self.used = np.zeros((size, 2), np.uint64), np.zeros(size, np.int64), np.zeros(size, bool)
        at, left = (digests[:, 0] & self.mask).astype(np.int64), np.arange(len(digests))
        while len(left):
            free = left[~self.used[at[left]]]
            self.keys[at[free]] = digests[free]  # of several in one slot the last stays
            self.used[at[free]] = True
            placed = (self.keys[at[left]] == digests[left]).all(axis=1)
            self.numbers[at[left[placed]]] = numbers[left[placed]]
            left = left[~placed]
            at[left] = (at[left] + 1) & (size - 1)

    @staticmethod
    def digests(words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)

    def __getitem__(self, words: list[bytes]) -> np.ndarray:
        """The numbers of words, 0 for those that are not there."""
        digests, found = self.digests(words), np.zeros(len(words), np.int64)
        at, left = (digests[:, 0] & self.mask).astype(np.int64), np.arange(len(words))
        while len(left):
            left = left[self.used[at[left]]]
            same = (self.keys[at[left]] == digests[left]).all(axis=1)
            found[left[same]] = self.numbers[at[left[same]]]
            left = left[~same]
            at[left] = (at[left] + 1) & (len(self.used) - 1)
        return found


def scored(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The columns of SCORES, one row for each row of docs."""
    stored = blocks(docs.select(id_of(doc_id).alias("doc_id"), text_of(text).alias("text")))
    words = materialize(stored.where(F.col("kind") == WORD).groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "lm-words")
    grams = materialize(stored.where(F.col("kind") == GRAM).groupBy("gram").agg(F.sum("n").alias("n")), "lm-grams")
    lengths = materialize(code_lengths(grams), "lm-lengths")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_blocks = (stored.agg(F.max("block")).first()[0] or 0) + 1
    known = stored.where(F.col("kind") == WORD).select("block", "word").join(words, "word").select("block", F.lit(WORD).alias("kind"), "word", "n")
    coded = stored.where(F.col("kind") == GRAM).select("block", "gram").join(lengths, "gram").select("block", F.lit(GRAM).alias("kind"), "gram", "bits")
    own = stored.where(F.col("kind") == DOC).select("block", "kind", "doc_id", "text")
    dealt = known.unionByName(coded, True).unionByName(own, True).repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block", "kind").select("block", "kind", "word", "n", "gram", "bits", "doc_id", "text")
    arrow = arrow_schema(SCORES)
    unseen = np.log10(total + 0.5 * (distinct + 1))

    def run(batches):
        current, words, numbers, keys, values, counts, lookup = None, [], [], [], [], None, None
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                kinds, blocks_ = batch.column("kind").to_numpy(), batch.column("block").to_numpy()
                edges = np.flatnonzero((np.diff(kinds) != 0) | (np.diff(blocks_) != 0)) + 1
                for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(kinds)]):
                    part, kind = batch.slice(start, end - start), int(kinds[start])
                    if blocks_[start] != current:
                        current, words, numbers, keys, values, counts, lookup = blocks_[start], [np.empty((0, 2), np.uint64)], [np.empty(0, np.int64)], [], [], None, None
                    if kind == WORD:
                        words.append(Counts.digests(part.column("word").to_pylist()))
                        numbers.append(part.column("n").to_numpy())
                    elif kind == GRAM:
                        keys.append(part.column("gram").to_numpy().astype(np.uint32))
                        values.append(part.column("bits").to_numpy())
                    else:
                        if lookup is None:
                            counts, lookup = Counts(np.concatenate(words), np.concatenate(numbers)), Lookup(np.concatenate(keys), np.concatenate(values))
                            words, numbers, keys, values = [], [], [], []
                        ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                        found, starts = windows(texts)
                        scores = np.add.reduceat(lookup[found], starts)
                        tokens = [(*t.split(), END) for t in texts]
                        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
                        firsts = np.cumsum(sizes) - sizes
                        c = counts[[w for t in tokens for w in t]]
                        known, base = np.add.reduceat((c > 0).astype(np.int64), firsts), np.add.reduceat(np.log10(c + 0.5) - unseen, firsts)
                        columns = (ids, [held_out(i) for i in ids], sizes, known, np.full(len(ids), total, np.int64), base, scores, np.fromiter(map(len, texts), np.int64, len(texts)))
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow)], schema=arrow)

    return dealt.mapInArrow(tidy(run), SCORES)
