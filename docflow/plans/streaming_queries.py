"""Streaming queries: the events table is read as a stream, run through once, and the sink's rows are the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.operators import search as S
from docflow.plans.activity_queries import EVENTS, MS
from docflow.plans.registry import query, table
from docflow.streaming import streams


def _root(spark: SparkSession) -> str:
    from docflow.sources.storage import shared_root

    return f"{shared_root(spark)}/docflow/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{sf_dir}/event[s].parquet")
    return stream.select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("page"), F.expr(MS).alias("ms"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns the sink's rows."""
    spark, root = stream.sparkSession, _root(stream.sparkSession)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{root}/out").outputMode(mode)
    else:  # the last micro-batch holds the whole result
        writer = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/out")).outputMode(mode)
    writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query(f"WITH {EVENTS}, s AS (SELECT event_id // 2 AS op, ts, event_type FROM e WHERE event_id % 2 = 0), f AS (SELECT event_id // 2 AS op, ts AS end_time, value FROM e WHERE event_id % 2 = 1) SELECT op, ts, event_type, end_time, value FROM s JOIN f USING (op) WHERE end_time BETWEEN ts AND ts + INTERVAL 1 HOUR")
def stream_perf_pairs(spark, sf_dir):
    log = events(spark, sf_dir).withColumns({"op": F.floor(F.col("event_id") / 2), "at": F.col("ts").cast("timestamp")})
    starts = log.where("event_id % 2 = 0").select("op", "at", F.col("ts"), "event_type")
    again = events(spark, sf_dir).withColumns({"op": F.floor(F.col("event_id") / 2), "at": F.col("ts").cast("timestamp")})
    ends = again.where("event_id % 2 = 1").select("op", "at", "value", F.col("ts").alias("end_ts"))
    return finished(streams.pairs(starts, ends, "op", "at").select("op", "ts", "event_type", F.col("end_ts").alias("end_time"), "value"))


@query(f"""WITH {EVENTS}, m AS (SELECT user_id, page // 34 AS part, ms, lag(page // 34) OVER w AS lp, lag(ms) OVER w AS lm FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms))
    SELECT user_id, CAST(sum(CASE WHEN lp IS NULL OR lp <> part OR ms - lm >= 86400000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS entry, part, ms FROM m""")
def stream_undo_coalesce(spark, sf_dir):
    edits = events(spark, sf_dir).select("user_id", F.floor(F.col("page") / 34).alias("part"), "ms")
    return finished(streams.coalesced_edits(edits, "user_id", "part", "ms", 86_400_000))


@query(f"WITH {EVENTS}, g AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM e) SELECT user_id, event_id, event_type FROM g WHERE event_type IS DISTINCT FROM b")
def stream_changes(spark, sf_dir):
    return finished(streams.changes(events(spark, sf_dir).select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type"))


@query(f"""WITH RECURSIVE {EVENTS}, o AS (SELECT user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms) AS k FROM e),
    t AS (SELECT user_id, k, ms, ms AS passed FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, o.ms, CASE WHEN o.ms - t.passed >= 21600000 THEN o.ms ELSE t.passed END FROM t JOIN o ON o.user_id = t.user_id AND o.k = t.k + 1)
    SELECT DISTINCT user_id, passed AS ms FROM t""")
def stream_throttle(spark, sf_dir):
    return finished(streams.throttled(events(spark, sf_dir).select("user_id", "ms"), "user_id", "ms", 21_600_000))


@query("SELECT event_type, count(*) AS count, round(sum(value), 6) AS total, min(value) AS min, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY 1")
def stream_perf_summary(spark, sf_dir):
    return finished(streams.summary(events(spark, sf_dir), "event_type", "value"), "complete").withColumn("total", F.round("total", 6))


@query("WITH h AS (SELECT event_id AS doc_id, unnest(list_filter(range(length(event_type)), lambda i: substr(event_type, i + 1, 1) = 'i')) AS p FROM events) SELECT doc_id, CAST(p AS INTEGER) AS char_offset, 1 AS length FROM h")
def stream_search(spark, sf_dir):
    pages = events(spark, sf_dir).select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("text"))
    return finished(S.search(pages, "i"))
