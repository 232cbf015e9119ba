"""Token counts under a unigram model, by dynamic programming that pre-tokens share through a trie.

The pieces are those of a public vocabulary. Where its file gives no probabilities (a merge vocabulary), a piece's
log-probability follows the Zipf-Mandelbrot law of its rank, -log(rank + 2.7). A pre-token (a word with the word mark in
front) is cut into the pieces of greatest total; a character that no piece covers counts as its UTF-8 bytes.

The best total of a prefix depends on nothing that follows, so the distinct pre-tokens of a batch are put into a trie and
each node's forward score and token count are computed once, from its ancestors. The trie is walked in sorted order:
only the branch from the root to the current node is held, and what a pre-token's end (its terminal) has is stored in a
bounded cache. Rows stay where they are; nothing is shuffled.

Of equal totals the cut with fewer tokens counts. Defined results: null and empty texts have 0; repeated rows are counted
each; a null doc_id is passed on; words of any length are handled.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from docflow.llm.shared import arrow_schema, id_of, slices, table_of, text_of, tidy

MARK = "▁"
BATCH_BYTES = 8 << 20
CACHE_WORDS = 400_000
COUNTS = table_of("doc_id long, n_pretokens long, n_tokens long, n_byte_tokens long")


class UnigramTrie:
    """Terminal counts (tokens, of them bytes) of pre-tokens; one instance lives in each Python worker."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 10.0
        self.tails: dict[str, int] = {}  # by last character: the longest piece that ends so
        for piece in scores:
            self.tails[piece[-1]] = max(self.tails.get(piece[-1], 0), len(piece))
        self.terminals: dict[str, tuple[int, int]] = {}

    def insert(self, words: list[str]) -> None:
        """Adds the terminals of sorted distinct words."""
        # the current branch: for each prefix length the best (total, -tokens, -byte tokens)
        branch, path, scores, tails, terminals = [(0.0, 0, 0)], "", self.scores, self.tails, self.terminals
        for word in words:
            marked = MARK + word
            shared = 0
            for a, b in zip(path, marked):
                if a != b:
                    break
                shared += 1
            del branch[shared + 1 :]
            for end in range(shared + 1, len(marked) + 1):
                last = marked[end - 1]
                n = len(last.encode("utf-8", "surrogatepass"))
                total, tokens, raw = branch[end - 1]
                best = (total + n * self.byte, tokens - n, raw - n)
                for start in range(max(0, end - tails.get(last, 0)), end):
                    score = scores.get(marked[start:end])
                    if score is not None:
                        before = branch[start]
                        found = (before[0] + score, before[1] - 1, before[2])
                        if found > best:
                            best = found
                branch.append(best)
            path = marked
            terminals[word] = (-branch[-1][1], -branch[-1][2])

    def count(self, texts: list[str]) -> list[tuple[int, int, int]]:
        split = [[w.decode() for w in t.encode().split()] for t in texts]
        if len(self.terminals) > CACHE_WORDS:
            self.terminals.clear()
        self.insert(sorted({w for words in split for w in words} - self.terminals.keys()))
        get, out = self.terminals.__getitem__, []
        for words in split:
            found = list(map(get, words))
            out.append((len(words), sum([x[0] for x in found]), sum([x[1] for x in found])))
        return out


@lru_cache(2)
def trie(path: str) -> UnigramTrie:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    normal.sort(key=lambda i: (-model.get_score(i), i))
    return UnigramTrie({model.id_to_piece(i): -math.log(rank + 2.7) for rank, i in enumerate(normal)})


def counted(docs: DataFrame, vocabulary_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The columns of COUNTS, one row for each row of docs."""
    arrow = arrow_schema(COUNTS)

    def run(batches):
        model = trie(vocabulary_path)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                rows = model.count(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in zip(*rows))], schema=arrow)

    return docs.select(id_of(doc_id).alias("doc_id"), text_of(text).alias("text")).mapInArrow(tidy(run, trie.cache_clear), COUNTS)
