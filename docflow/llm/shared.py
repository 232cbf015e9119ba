"""Storage and batching helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.sources.storage import shared_root


#: Columns of numbered tables: a row's number, and the block (the writing task) that is in the number's upper bits.
ROW, BLOCK = "__row", "__block"
#: The lower bits of monotonically_increasing_id count the rows of a task.
ROW_BITS = 33


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/docflow/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """SQL settings (dots as __) for the plans that are made and run inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def numbered(docs: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """docs with ROW and BLOCK as a table in the shared folder, in buckets of BLOCK; no row is moved to write it.

    What is found out about some rows is sent to the rows' blocks (see `at_rows`), however large those are.
    """
    cores, size = docs.sparkSession.sparkContext.defaultParallelism, int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # by the planner's estimate of the size, where it has one; a block is about as large as a file split
    buckets = min(100_000, 32 * cores, max(4 * cores, size >> 25 if size < 1 << 60 else 0))
    return in_blocks(docs.withColumn(ROW, F.monotonically_increasing_id()).withColumn(BLOCK, F.spark_partition_id()), name, buckets, compression)


def in_blocks(rows: DataFrame, name: str, buckets: int, compression: str = "zstd") -> DataFrame:
    """rows(BLOCK, ROW, ...), which lie by block already, as a table with as many buckets."""
    spark, path = rows.sparkSession, fresh_path(rows.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    with settings(spark, spark__sql__maxConcurrentOutputFileWriters="2"):  # a task has one bucket only, so it need not sort
        rows.write.bucketBy(buckets, BLOCK).option("path", path).option("compression", compression).saveAsTable(table)
    found = spark.table(table)
    found._table, found._path, found._buckets = table, path, buckets
    return found


def located(frame: DataFrame, row: str = ROW) -> DataFrame:
    """frame with ROW and BLOCK by the row numbers in a column."""
    return frame.withColumnRenamed(row, ROW).withColumn(BLOCK, F.shiftright(ROW, ROW_BITS).cast("int"))


def at_rows(table: DataFrame, facts: DataFrame, how: str, keys: tuple[str, ...] = (BLOCK, ROW)) -> DataFrame:
    """A numbered table joined to facts about rows (or other keys within blocks). Run inside `by_block`, only the facts are shuffled.

    The facts are dealt by block whatever they come from: those that were grouped by row would keep their partitioning, and
    where it has more partitions than the table has buckets, the table would be shuffled to it.
    """
    return table.join(facts.repartition(BLOCK).hint("shuffle_hash"), list(keys), how)


def by_block(spark: SparkSession):
    """Inside, joins on a block and more need no other partitioning than the table's, which is by block."""
    return settings(spark, spark__sql__requireAllClusterKeysForCoPartition="false")


def materialize(df: DataFrame, name: str, compression: str = "zstd", **options: str) -> DataFrame:
    """Write df to the shared folder and return a DataFrame that reads it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(compression=compression, **options).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._path = path
    return found


def is_table(df: DataFrame) -> bool:
    """Whether df reads a table of `materialize` or `numbered`, as it was written."""
    return hasattr(df, "_path")


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `materialize` and `numbered` that nothing will read again."""
    for df in tables:
        if name := getattr(df, "_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path := getattr(df, "_path", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def text_of(column: str = "text"):
    """The text with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_of(column: str = "doc_id"):
    return F.col(column).cast("long")


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices whose texts hold about most_bytes at most; a longer text stands alone."""
    array = batch.column(batch.schema.get_field_index(column))
    lengths = pc.binary_length(array).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start, batch.num_rows - start)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def chunks(rows: Iterator, n: int) -> Iterator[list]:
    rows = iter(rows)
    while block := list(itertools.islice(rows, n)):
        yield block


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "binary": T.BinaryType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "array<int>": T.ArrayType(T.IntegerType()), "array<long>": T.ArrayType(T.LongType())}


def tidy(run, *forget):
    """run (batches -> batches), after which its caches are forgotten and freed memory goes back to the system.

    Python workers live on between tasks; what an earlier operator has kept must not add to what a later one needs.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            for clear in forget:
                clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def table_of(columns: str) -> T.StructType:
    """A schema from "name type, ..."; unlike DDL parsing it needs no session, so workers can import modules that use it."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])
