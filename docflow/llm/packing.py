"""Concatenate-and-cut packing of tokenised documents into windows of fixed length.

First pass: each task tokenises its documents and writes their ids to the shared folder, with the place of each document
in the task's own stream. The tasks' token totals give, by a prefix sum, where each stream begins in the corpus's stream.
Second pass: with that base every document knows its global place, so windows of `length` tokens are cut without looking
at any other document; a document that crosses windows gives one boundary record (piece) for each. No document is
shuffled. Only the last window of all can be short.

Strings of added tokens in a text (`special`) are those tokens, as the tokenizers library reads them unless it is told
otherwise; without `special` they are ordinary text.

Defined results: null text counts as empty and packs as its end token alone; texts of any length are cut into as many
pieces as they need; repeated rows are packed each, in the order of the table; null doc_id is passed on; columns other
than the two named are not read, so their names cannot clash; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.llm.shared import arrow_schema, id_of, materialize, slices, table_of, text_of, tidy

LENGTH = 2048
BATCH_BYTES = 4 << 20
STREAM = table_of("part long, local_start long, doc_id long, n_tokens long, ids binary")
PIECES = table_of("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def added_tokens(tokenizer_path: str) -> tuple[tuple[str, int], ...]:
    """The added tokens that a tokenizer file lists, as (string, id)."""
    return tuple((t["content"], t["id"]) for t in json.loads(Path(tokenizer_path).read_text())["added_tokens"])


@lru_cache(2)
def encoder(ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()) -> tiktoken.Encoding:
    from docflow.llm.bpe import load_ranks

    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens=dict(special))


def tokenised(docs: DataFrame, ranks_path: str, pattern: str, end_id: int, special: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """First pass, written to the shared folder: part (the task), local_start, doc_id, n_tokens, ids (little-endian 16 bit)."""
    arrow = arrow_schema(STREAM)

    def run(batches):
        from pyspark import TaskContext

        part, at, coder = TaskContext.get().partitionId(), 0, encoder(ranks_path, pattern, special)
        named = {name for name, _ in special}
        end = np.array([end_id], "<u2")
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                starts, counts, ids = [], [], []
                for text in batch.column("text").to_pylist():
                    got = np.concatenate([coder.encode_to_numpy(text, allowed_special=named, disallowed_special=()).astype("<u2"), end])
                    starts.append(at)
                    counts.append(len(got))
                    ids.append(got.tobytes())
                    at += len(got)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int64()), pa.array(starts, pa.int64()), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], schema=arrow)

    return materialize(docs.mapInArrow(tidy(run, encoder.cache_clear), STREAM), "packing-stream")


def pack(docs: DataFrame, ranks_path: str, pattern: str, length: int = LENGTH, end_id: int = 1, special: tuple[tuple[str, int], ...] = (), text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds ids binary."""
    stream = tokenised(docs.select(id_of(doc_id).alias("doc_id"), text_of(text).alias("text")), ranks_path, pattern, end_id, special)
    # 16 bytes for each task of the first pass, whatever the documents hold: that bounds what comes to the driver
    totals = dict(stream.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", "n").toLocalIterator())
    bases = np.zeros(max(totals, default=-1) + 2, np.int64)
    for part, n in totals.items():
        bases[part + 1] = n
    bases = np.cumsum(bases)
    schema = T.StructType([*PIECES.fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    arrow = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for part, local, document, n, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "local_start", "doc_id", "n_tokens", "ids"))):
                place, start = int(bases[part]) + local, 0
                values = np.frombuffer(ids, "<u2").astype("<u4")
                while start < n:
                    window, offset = divmod(place + start, length)
                    size = min(length - offset, n - start)
                    cut = values[start : start + size].tobytes()
                    rows.append((document, start, size, zlib.crc32(cut), n, window, offset, *([cut] if with_ids else [])))
                    start += size
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)

    return stream.mapInArrow(tidy(run), schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed windows: sequence_id, n_tokens, ids binary, doc_ids in order. A group is bounded by the window length."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    return pieces.groupBy("sequence_id").agg(ordered.alias("p")).select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))
