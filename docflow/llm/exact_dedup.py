"""Exact duplicates with a log-structured merge index.

One pass gives each row a number and the digest of its text. Memtables: each task gathers (digest, id, row) entries up to a
bound, sorts them by digest and flushes them as one sorted run, where the rows of a block that share a digest are one
entry, so a text of which there are very many copies is one entry for each block. Compaction merges the runs by ranges of
digests: each range's parts of all runs meet in digest order and pass through one sweep, which keeps of each digest the
smallest (or, by parameter, the largest) identifier. The compacted index is again sorted runs, one for each range, with a
Bloom filter for each part of a file; `holding` consults these before it reads a run.

Hits are the rows whose digest the index counts twice or more, exactly: there is no filter whose size would have to grow
with the table. They are sent to the blocks that hold them, and only their texts travel. They are verified by grouping on
the bytes themselves, combined before the shuffle; texts that share a digest but differ are then told apart by their bytes.

Defined results: null text counts as empty; empty texts equal each other; texts of any length are handled whole, one batch
of bounded bytes at a time; rows that repeat both doc_id and text are copies too, and exactly one of them (the first
written) is kept; a null doc_id loses against any other and is kept only in a group that has no other; an empty table
gives an empty result; other columns pass through whatever their names, but for those that begin with two underscores.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.llm.shared import BLOCK, ROW, arrow_schema, at_rows, by_block, discard, id_of, materialize, numbered, slices, table_of, text_of, tidy

#: Entries of a memtable before it is flushed.
MEMTABLE_ENTRIES = 1 << 17
BATCH_BYTES = 8 << 20

#: Entries of runs: of a digest's rows in a block the best one, and how many there are.
RUNS = table_of("digest binary, block int, doc_id long, row long, n long")


def sha256_digest(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def digested(docs: DataFrame, text: str, digest=sha256_digest) -> DataFrame:
    """docs with __digest."""
    source = docs if dict(docs.dtypes)[text] == "string" else docs.withColumn("__text", text_of(text))
    read = text if source is docs else "__text"
    schema = T.StructType([*source.schema.fields, T.StructField("__digest", T.BinaryType())])
    arrow = arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, read, BATCH_BYTES):
                found = [digest(t or b"") for t in batch.column(batch.schema.get_field_index(read)).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], schema=arrow)

    return source.mapInArrow(tidy(run), schema).drop(*({"__text"} - set(docs.columns)))


def _combined(entries: pa.Table, keys: list[str]) -> pa.Table:
    """Sorted entries with neighbours of equal keys as one: the first of them, with the sum of their numbers."""
    n = entries.num_rows
    if n < 2:
        return entries
    new = np.zeros(n - 1, bool)
    for key in keys:
        column = entries[key]
        new |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy()
    starts = np.concatenate([[0], np.flatnonzero(new) + 1])
    total = np.add.reduceat(entries["n"].to_numpy(), starts)
    return entries.take(starts).set_column(entries.schema.get_field_index("n"), "n", pa.array(total, pa.int64()))


def flush_runs(table: DataFrame, keep: str = "smallest", memtable: int = MEMTABLE_ENTRIES) -> DataFrame:
    """The sorted runs of a numbered table(doc_id, __digest), written to the shared folder."""
    arrow = arrow_schema(RUNS)
    order = [("digest", "ascending"), ("block", "ascending"), ("doc_id", "ascending" if keep == "smallest" else "descending"), ("row", "ascending")]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flushed():
            entries = pa.Table.from_batches(held)
            entries = entries.take(pc.sort_indices(entries, sort_keys=order, null_placement="at_end"))
            return _combined(entries, ["digest", "block"]).cast(arrow).combine_chunks().to_batches()

        for batch in batches:
            held.append(pa.RecordBatch.from_arrays(batch.columns, names=arrow.names))
            if sum(b.num_rows for b in held) >= memtable:
                yield from flushed()
                held.clear()
        if held:
            yield from flushed()

    entries = table.select("__digest", BLOCK, "doc_id", ROW, F.lit(1).cast("long"))
    return materialize(entries.mapInArrow(tidy(run), RUNS), "dedup-runs")


def compacted(runs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The index, written as sorted runs with filters: digest, keep_id, keep_row (the row that stays), group_size."""
    ranges = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prefix = F.conv(F.rpad(F.hex(F.substring("digest", 1, 4)), 8, "0"), 16, 10).cast("long")
    # a null doc_id is last either way; of rows that tie in doc_id the first stays
    best = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    dealt = runs.repartitionById(ranges, F.shiftright(prefix * ranges, 32).cast("int")).sortWithinPartitions("digest", best, "row")
    schema = table_of("digest binary, keep_id long, keep_row long, group_size long")
    arrow = arrow_schema(schema)

    def sweep(batches):
        last = None  # the digest that may go on in the next batch
        for batch in batches:
            entries = pa.Table.from_batches([batch])
            entries = _combined(pa.concat_tables([last, entries]) if last is not None else entries, ["digest"])
            last = entries.slice(entries.num_rows - 1)
            yield from _named(entries.slice(0, entries.num_rows - 1))
        if last is not None:
            yield from _named(last)

    def _named(entries):
        return entries.select(["digest", "doc_id", "row", "n"]).rename_columns(arrow.names).cast(arrow).to_batches()

    found = dealt.select(*RUNS.names).mapInArrow(tidy(sweep), schema)
    return materialize(found, "dedup-index", **{"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"})


def holding(index: DataFrame, digests: list[bytes]) -> DataFrame:
    """The index's entries of some digests; runs are read only where their range and filter admit one of them."""
    return index.where(F.col("digest").isin([bytearray(d) for d in digests]))


def copies(table: DataFrame, keep: str = "smallest", memtable: int = MEMTABLE_ENTRIES, text: str = "text") -> DataFrame:
    """One row for each row of a numbered table(doc_id, text, __digest) that has copies: BLOCK, ROW, keep_id, keep_row, group_size, collided.

    collided: the digest is that of another text, too.
    """
    spark = table.sparkSession
    runs = flush_runs(table, keep, memtable)
    index = compacted(runs, keep)
    hits = runs.select("digest", F.col("block").alias(BLOCK)).distinct().join(index.where("group_size > 1"), "digest").withColumnRenamed("digest", "__digest")
    hits = materialize(hits, "dedup-hits")
    key = (BLOCK, "__digest")
    with by_block(spark):
        # byte verification: copies combine in each task before their text is shuffled
        texts = at_rows(table.select(*key, text_of(text).alias("__text")), hits.select(*key), "left_semi", key).groupBy("__digest", "__text").agg(F.count("*").alias("n"))
        collided = materialize(texts.groupBy("__digest").agg(F.count("*").alias("texts")).where("texts > 1").select("__digest"), "dedup-collisions")
        plain = at_rows(table.select(*key, ROW), hits, "inner", key)
        if collided.isEmpty():
            return materialize(plain.select(BLOCK, ROW, "keep_id", "keep_row", "group_size", F.lit(False).alias("collided")), "dedup-copies")
        # the exact way for digests that are shared by different texts: group on the bytes
        shared = hits.join(collided, "__digest", "left_semi").select(*key)
        again = materialize(at_rows(table.select(*key, ROW, "doc_id", text_of(text).alias("__text")), shared, "left_semi", key), "dedup-verify")
        best, sign = (F.min, 1) if keep == "smallest" else (F.max, -1)
        rank = F.struct(F.col("doc_id").isNull().cast("int") * sign, F.col("doc_id"), (F.col(ROW) * sign).alias("row"))
        exact = materialize(again.groupBy("__digest", "__text").agg(best(rank).alias("best"), F.count("*").alias("group_size")), "dedup-exact")  # as a table, so that the join can be split at a text with many rows
        told = again.join(exact, ["__digest", "__text"]).select(BLOCK, ROW, F.col("best.doc_id").alias("keep_id"), (F.col("best.row") * sign).alias("keep_row"), "group_size", F.lit(True).alias("collided"))
        return materialize(plain.join(collided, "__digest", "left_anti").select(BLOCK, ROW, "keep_id", "keep_row", "group_size", F.lit(False).alias("collided")).unionByName(told), "dedup-copies")


def resolve(docs: DataFrame, keep: str = "smallest", text: str = "text", doc_id: str = "doc_id", digest=sha256_digest, memtable: int = MEMTABLE_ENTRIES) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, digest (binary), collided (its digest is that of another text, too)."""
    table = numbered(digested(docs.select(id_of(doc_id).alias("doc_id"), text_of(text).alias("text")), "text", digest), "dedup-rows")
    found = copies(table, keep, memtable)
    with by_block(docs.sparkSession):
        told = at_rows(table.select(BLOCK, ROW, "doc_id", "__digest"), found, "left")
        one = told.select("doc_id", F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col(ROW) == F.col("keep_row"), F.lit(True)).alias("kept"), F.col("__digest").alias("digest"), F.coalesce("collided", F.lit(False)).alias("collided"))
        result = materialize(one, "dedup-resolved")
    discard(table, found)
    return result


def deduplicate(docs: DataFrame, keep: str = "smallest", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with the columns of docs. Only the texts of copies are shuffled, to verify them."""
    own = digested(docs.withColumn("__id", id_of(doc_id)), text)
    table = numbered(own, "dedup-rows")
    ready = table.withColumnRenamed("doc_id", "__doc_id") if doc_id != "doc_id" and "doc_id" in docs.columns else table
    found = copies(ready.withColumn("doc_id", F.col("__id")), keep, text=text)
    with by_block(docs.sparkSession):
        result = materialize(at_rows(table, found.where(F.col(ROW) != F.col("keep_row")).select(BLOCK, ROW), "left_anti").select(docs.columns), "dedup-kept")
    discard(table, found)
    return result
