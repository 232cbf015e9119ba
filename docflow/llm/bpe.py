"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts of a batch are laid end to end as one array of code points. A table gives each code point a class; class and
look-ahead give each position a transition function over four states, packed into one byte (two bits a state). An
associative scan composes the functions block-wise, so no regular expression is run, and the states with the classes of
the neighbours tell where pre-tokens start. The slices go through a bounded cache to pair merging; the offsets of the
slices are kept, so any pre-token can be decoded by itself.

States: 0 free (an apostrophe here starts a token), 1 a symbol run or a pending space is open (an apostrophe joins it),
2 / 3 inside a contraction that needs one / two more letters.

Defined results: null text counts as empty; an empty text has no ids (its ids_sha256 is the digest of the empty string);
repeated rows are encoded each; null doc_id is passed on; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docflow.llm.shared import arrow_schema, id_of, slices, table_of, text_of, tidy

LETTER, NUMBER, SPACE, BLANK, SYMBOL, QUOTE = range(6)
# The code points with the Unicode property White_Space, as inclusive ranges.
WHITE_SPACE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
# The contractions of the split pattern, by the number of letters after the apostrophe.
SHORT, LONG = "stmd", ("re", "ve", "ll")
#: Bytes of text that are laid out as one array.
BATCH_BYTES = 1 << 20
#: Pre-tokens whose merges a Python worker remembers, and the longest of them in characters.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48
#: Bytes up to which a pre-token's pairs are searched one by one.
SHORT_PIECE = 32


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class by code point. Letters and numbers are those of the Unicode version that tiktoken was built with."""
    points = np.concatenate([np.arange(0x80, 0xD800, dtype=np.uint32), np.arange(0xE000, 0x110000, dtype=np.uint32)])
    every = points.tobytes().decode("utf-32-le")
    table = np.full(0x110000, SYMBOL, np.uint8)
    single = {bytes([i]): i for i in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        members = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = members.decode_bytes(members.encode_ordinary(every))
        table[np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)] = kind
    for first, last, kind in ((0x30, 0x39, NUMBER), (0x41, 0x5A, LETTER), (0x61, 0x7A, LETTER), *((a, b, BLANK) for a, b in WHITE_SPACE)):
        table[first : last + 1] = kind
    table[0x20], table[0x27] = SPACE, QUOTE
    return table


def packed(*targets: int) -> int:
    return sum(t << (2 * s) for s, t in enumerate(targets))


IDENTITY = packed(0, 1, 2, 3)
OF_CLASS = np.array([packed(0, 0, 0, 2), packed(0, 0, 0, 0), packed(1, 1, 1, 1), packed(0, 0, 0, 0), packed(1, 1, 1, 1), packed(1, 1, 1, 1)], np.uint8)
QUOTE_SHORT, QUOTE_LONG = packed(2, 1, 1, 1), packed(3, 1, 1, 1)


@lru_cache(1)
def composition() -> np.ndarray:
    """table[f << 8 | g]: first f, then g."""
    f, g = np.meshgrid(np.arange(256, dtype=np.uint16), np.arange(256, dtype=np.uint16), indexing="ij")
    out = np.zeros((256, 256), np.uint16)
    for s in range(4):
        out |= ((g >> (2 * ((f >> (2 * s)) & 3))) & 3) << (2 * s)
    return out.astype(np.uint8).ravel()


def scanned(functions: np.ndarray, lane: int = 128) -> np.ndarray:
    """Inclusive prefix compositions of packed transition functions (an associative scan, lanes side by side)."""
    table, n = composition(), len(functions)
    if n <= lane:
        out, total = np.empty(n, np.uint8), IDENTITY
        for i, f in enumerate(functions.tolist()):
            out[i] = total = int(table[total << 8 | f])
        return out
    lanes = -(-n // lane)
    padded = np.full(lanes * lane, IDENTITY, np.uint8)
    padded[:n] = functions
    steps = np.ascontiguousarray(padded.reshape(lanes, lane).T)
    total = steps[0]
    for j in range(1, lane):
        total = table[(total.astype(np.uint16) << 8) | steps[j]]
        steps[j] = total
    before = np.empty(lanes, np.uint8)
    before[0] = IDENTITY
    before[1:] = scanned(np.ascontiguousarray(total[:-1]), lane) if lanes > 1 else IDENTITY
    for j in range(lane):
        steps[j] = table[(before.astype(np.uint16) << 8) | steps[j]]
    return np.ascontiguousarray(steps.T).ravel()[:n]


def token_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions at which pre-tokens start. text_starts: where the (not empty) texts start in points, ascending, first 0."""
    n = len(points)
    kind = class_table()[points]
    functions = OF_CLASS[kind]
    last = np.zeros(n, bool)  # last position of a text
    last[text_starts[1:] - 1] = True
    last[n - 1] = True
    quotes = np.flatnonzero(kind == QUOTE)
    quotes = quotes[~last[quotes]]
    one = points[quotes + 1]
    functions[quotes[np.isin(one, [ord(c) for c in SHORT])]] = QUOTE_SHORT
    more = quotes[~last[quotes + 1]]
    one, two = points[more + 1], points[np.minimum(more + 2, n - 1)]
    for pair in LONG:
        functions[more[(one == ord(pair[0])) & (two == ord(pair[1]))]] = QUOTE_LONG
    functions[text_starts] = (functions[text_starts] & 3) * 0b01010101  # whatever came before, a text starts in state 0
    state = scanned(functions) & 3
    before, earlier = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    before[1:], earlier[2:] = state[:-1], state[:-2]
    first = np.zeros(n, bool)
    first[text_starts] = True
    earlier[text_starts[text_starts + 1 < n] + 1] = 0
    before[text_starts] = earlier[text_starts] = 0
    previous, following = np.empty(n, np.uint8), np.empty(n, np.uint8)
    previous[0], previous[1:] = BLANK, kind[:-1]
    following[-1], following[:-1] = BLANK, kind[1:]
    white, white_before = (kind == SPACE) | (kind == BLANK), (previous == SPACE) | (previous == BLANK)
    group, group_before = np.where(kind == QUOTE, SYMBOL, kind), np.where(previous == QUOTE, SYMBOL, previous)
    start = np.where(white, ~white_before | ((following < SPACE) | (following > BLANK)) & ~last, (group != group_before) & (previous != SPACE))
    start |= earlier == 2
    start &= before < 2
    return np.flatnonzero(start | first)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Pair merging, lowest rank first and leftmost on ties: by search in a short list, with a heap (n log n) in a long one."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n <= SHORT_PIECE:
        get, none = ranks.get, len(ranks) << 8
        parts = [piece[i : i + 1] for i in range(n)]
        pairs = [get(piece[i : i + 2], none) for i in range(n - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return [ranks[p] for p in parts]
    end, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not alive[i] or middle >= n or end[middle] != stop:
            continue
        alive[middle], end[i] = False, stop
        if stop < n:
            left[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := left[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encodes and decodes with one rank file; one instance lives in each Python worker."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.cache: dict[str, tuple[list[int], str]] = {}

    def piece(self, piece: str) -> tuple[list[int], str]:
        ids = merged(piece.encode(), self.ranks)
        got = ids, ",".join(map(str, ids))
        if len(piece) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[piece] = got
        return got

    def pieces(self, texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        """For each text the offsets (code points) of its pre-tokens, and the pre-tokens."""
        big = "".join(texts)
        if not big:
            yield from (([], []) for _ in texts)
            return
        lengths = np.array([len(t) for t in texts], np.int64)
        begins = np.concatenate([[0], np.cumsum(lengths)])
        starts = token_starts(np.frombuffer(big.encode("utf-32-le", "surrogatepass"), np.uint32), begins[:-1][lengths > 0])
        cuts = np.searchsorted(starts, begins)
        at = starts.tolist()
        at.append(len(big))
        for k, text in enumerate(texts):
            mine = at[cuts[k] : cuts[k + 1] + 1]
            if text:
                mine[-1] = int(begins[k + 1])
                offset = int(begins[k])
                yield [a - offset for a in mine[:-1]], [big[a:b] for a, b in zip(mine, mine[1:])]
            else:
                yield [], []

    def encoded(self, texts: list[str]) -> Iterator[tuple[list[int], list[tuple[list[int], str]]]]:
        for offsets, pieces in self.pieces(texts):
            get, slow = self.cache.get, self.piece
            yield offsets, [get(p) or slow(p) for p in pieces]

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, ranks_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids array<int>, piece_starts array<int> (code points), piece_tokens array<int> (ids up to each piece's end)."""
    schema = table_of("doc_id long, ids array<int>, piece_starts array<int>, piece_tokens array<int>")
    arrow = arrow_schema(schema)

    def run(batches):
        coder = codec(ranks_path)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                ids, starts, ends = [], [], []
                for offsets, got in coder.encoded(batch.column("text").to_pylist()):
                    ids.append([i for x in got for i in x[0]])
                    starts.append(offsets)
                    ends.append(np.cumsum([len(x[0]) for x in got]).astype(np.int32).tolist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.list_(pa.int32())) for x in (ids, starts, ends))], schema=arrow)

    return docs.select(id_of(doc_id).alias("doc_id"), text_of(text).alias("text")).mapInArrow(tidy(run, codec.cache_clear), schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, content binary: the bytes of the ids."""
    schema = table_of("doc_id long, content binary")
    arrow = arrow_schema(schema)

    def run(batches):
        coder = codec(ranks_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([coder.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())], schema=arrow)

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run, codec.cache_clear), schema)


def round_trip(docs: DataFrame, ranks_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, n_pieces. Encodes, then decodes the ids, in one pass."""
    schema = table_of("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_pieces long")
    arrow = arrow_schema(schema)

    def run(batches):
        coder = codec(ranks_path)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                rows = []
                for offsets, got in coder.encoded(batch.column("text").to_pylist()):
                    ids = [i for x in got for i in x[0]]
                    listed = ",".join([x[1] for x in got])
                    rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest(), len(offsets)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, f.type) for x, f in zip(zip(*rows), list(arrow)[1:]))], schema=arrow)

    return docs.select(id_of(doc_id).alias("doc_id"), text_of(text).alias("text")).mapInArrow(tidy(run, codec.cache_clear), schema)
