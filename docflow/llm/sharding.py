"""Immutable shards, size-tiered compaction, and versioned manifests.

Arrivals are appended as small shards (Parquet files that are never changed). A manifest lists the live shards of a
version; a commit renames a finished manifest to the next version's name, which fails if another writer was first; it is
then made anew on that writer's manifest. A compaction commits only while all shards that it replaces are live.
Compaction puts shards of similar size into tiers (powers of `fanout`); whenever a tier holds `fanout` shards they count
as merged into one, which may fill the next tier. This cascade is planned on the manifest alone, so every row is
rewritten once a compaction, straight into its final shard, of about `target_bytes` at most. Shards that have reached
half of the target are left alone. The plan is made in lanes of bounded size, and carried out in waves: each wave moves a
bounded number of shards and commits. What was replaced is deleted later, beyond an age (`vacuum`).

Defined results: no row and no column is changed, whatever their values (nulls, empty and long texts, ties, repeated rows);
appending an empty table adds no shard; compacting what has nothing to merge commits nothing. Column names that begin
with two underscores and "shard" are the operator's own.
"""

from __future__ import annotations

import json
import math
import time

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docflow.llm.shared import discard, fresh_path, materialize, table_of

ROWS_PER_SHARD = 2_000
TARGET_BYTES = 128 << 20
FANOUT = 8
#: The smallest tier's size.
BASE_BYTES = 1 << 20
#: Shards in a lane of the plan, and in a wave. A wave's plan is broadcast: at most WAVE rows of a path and a number.
LANE, WAVE = 1024, 8192
#: Times that a commit is tried, and the age below which `vacuum` deletes nothing.
COMMIT_TRIES, GRACE_S = 20, 24 * 3600.0
#: One of so many rows comes in the query's second arrival.
ARRIVALS = 8
MANIFEST = table_of("path string, bytes long, rows long, version long")


def tier_of(size: int, fanout: int = FANOUT) -> int:
    return max(0, int(math.log(max(size, 1) / BASE_BYTES, fanout))) if size > BASE_BYTES else 0


def cascade(shards: list[tuple[str, int]], target: int = TARGET_BYTES, fanout: int = FANOUT) -> list[list[str]]:
    """The shards that are merged, as groups of paths; (path, bytes) in any order."""
    tiers: dict[int, list[tuple[int, str, list[str]]]] = {}
    for path, size in shards:
        if 2 * size < target:
            tiers.setdefault(tier_of(size, fanout), []).append((size, path, [path]))
    done: list[list[str]] = []
    tier = 0
    while tiers and tier <= max(tiers):
        runs = sorted(tiers.get(tier, []))
        while len(runs) >= fanout:
            size, members = 0, []
            while runs and len(members) < fanout and (not members or size + runs[0][0] <= target):
                members.append(runs.pop(0))
                size += members[-1][0]
            if len(members) < 2:
                break
            paths = [p for m in members for p in m[2]]
            # a merge counts in a tier above its parts', or is finished
            if 2 * size >= target:
                done.append(paths)
            else:
                tiers.setdefault(max(tier + 1, tier_of(size, fanout)), []).append((size, min(paths), paths))
        tiers[tier] = runs
        tier += 1
    return sorted(sorted(g) for g in done + [m[2] for runs in tiers.values() for m in runs] if len(g) > 1)


class ShardStore:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or fresh_path(spark, "shards")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *(p for p in parts if p)]))

    def _read_text(self, name: str) -> str | None:
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path("manifest")):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in self._fs.listStatus(self._path("manifest")) if s.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, bytes, rows and the version that made each live shard."""
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{(versions[-1] if version is None else version):08d}")

    def schema(self) -> T.StructType | None:
        text = self._read_text("schema.json")
        return T.StructType.fromJson(json.loads(text)) if text else None

    def _commit(self, change) -> int:
        """Commits change(newest manifest, next version) and returns its version; begins again on the newest manifest where another writer was first.

        change returns the new live shards, or None to give up (then None is returned).
        """
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._fs.mkdirs(self._path("manifest"))
        for _ in range(COMMIT_TRIES):
            base = (self.versions() or [0])[-1]
            live = change(self.manifest(base) if base else self.spark.createDataFrame([], MANIFEST), base + 1)
            if live is None:
                return None
            draft = fresh_path(self.spark, "manifest-draft").rsplit("/", 1)[1]
            live.coalesce(8).write.parquet(f"{self.root}/draft/{draft}")
            try:
                context.rename(self._path("draft", draft), self._path("manifest", f"v{base + 1:08d}"), none)  # fails where that version exists
            except Py4JJavaError as e:
                if not self._fs.exists(self._path("manifest", f"v{base + 1:08d}")):
                    raise  # not another writer's doing
                self._fs.delete(self._path("draft", draft), True)
                last = e
                continue
            return base + 1
        raise RuntimeError(f"{COMMIT_TRIES} commits in a row were lost to other writers") from last

    def _written(self, folder: str, version: int) -> DataFrame:
        """Manifest rows of the files in a folder of data. Reads file footers only."""
        files = self.spark.read.schema(self.schema()).parquet(f"{self.root}/data/{folder}").select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("bytes"))
        return files.groupBy("p", "bytes").agg(F.count("*").alias("rows")).select(F.regexp_extract("p", "/data/(.*)$", 1).alias("path"), "bytes", "rows", F.lit(version).cast("long").alias("version"))

    def append(self, rows: DataFrame, rows_per_shard: int = ROWS_PER_SHARD) -> int:
        """Adds the rows as new small shards and returns the version that has them."""
        if (known := self.schema()) is None:
            stream = self._fs.create(self._path("schema.json"), False)
            stream.write(bytearray(rows.schema.json().encode()))
            stream.close()
        elif known.simpleString() != rows.schema.simpleString():
            raise ValueError(f"the store has {known.simpleString()}, the arrival {rows.schema.simpleString()}")
        folder = f"arrival-{fresh_path(self.spark, 'x')[-32:]}"
        rows.write.option("maxRecordsPerFile", rows_per_shard).option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
        return self._commit(lambda live, version: live.unionByName(self._written(folder, version)))

    def plan(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> DataFrame:
        """path, lane, number: the merges, numbered within lanes. A lane's shards are a bounded group."""
        live = self.manifest()
        lanes = max(1, -(-live.count() // LANE))
        schema = table_of("path string, lane long, number long")

        def planned(shards: pd.DataFrame) -> pd.DataFrame:
            groups = cascade(list(zip(shards["path"], shards["bytes"])), target, fanout)
            lane = int(shards["lane"].iloc[0])
            return pd.DataFrame([(p, lane, k) for k, g in enumerate(groups) for p in g], columns=["path", "lane", "number"])

        return live.withColumn("lane", F.pmod(F.xxhash64("path"), F.lit(lanes))).groupBy("lane").applyInPandas(planned, schema)

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> int:
        """Carries the plan out, wave by wave, and returns the last version. A wave that meets a shard which is not live any more is planned anew."""
        while True:
            plan = materialize(self.plan(target, fanout), "shard-plan")
            lanes = (plan.agg(F.max("lane")).first()[0] or 0) + 1
            lost = [not self._merged(plan.where(F.col("lane").between(at, at + WAVE // LANE - 1))) for at in range(0, lanes, WAVE // LANE)]
            discard(plan)
            if not any(lost):
                return (self.versions() or [0])[-1]

    def _merged(self, plan: DataFrame) -> bool:
        """One wave: writes its merges and commits them, if all it moves is still live then."""
        groups: dict[tuple, list[str]] = {}
        for row in plan.collect():  # WAVE // LANE lanes of about LANE shards: a bounded number of paths, as any reader of these files lists
            groups.setdefault((row["lane"], row["number"]), []).append(row["path"])
        if not groups:
            return True
        folder = f"merge-{fresh_path(self.spark, 'x')[-32:]}"
        moved = self.spark.createDataFrame([(p, k) for k, g in enumerate(groups.values()) for p in g], table_of("__shard_path string, __shard int"))
        shards = self.spark.read.schema(self.schema()).parquet(*(f"{self.root}/data/{p}" for g in groups.values() for p in g))
        named = shards.withColumn("__shard_path", F.regexp_extract("_metadata.file_path", "/data/(.*)$", 1)).join(F.broadcast(moved), "__shard_path").drop("__shard_path")  # one wave's paths
        # dealt by the number of its merge, one task writes one shard
        dealt = named.repartitionById(len(groups), F.col("__shard")).drop("__shard")
        dealt.write.option("compression", "zstd").parquet(f"{self.root}/data/{folder}")

        def change(live: DataFrame, version: int) -> DataFrame | None:
            if not moved.join(live, F.col("path") == F.col("__shard_path"), "left_anti").isEmpty():
                return None  # another compaction has moved some of them: its rows are in the manifest already
            rest = live.join(moved, F.col("path") == F.col("__shard_path"), "left_anti")
            return rest.unionByName(self._written(folder, version))

        if self._commit(change) is None:
            self._fs.delete(self._path("data", folder), True)
            return False
        return True

    def read(self, version: int | None = None, with_shard: bool = False) -> DataFrame:
        """The rows of a version; with_shard adds __shard_path."""
        paths = [row["path"] for row in self.manifest(version).select("path").toLocalIterator()]
        if not paths:
            empty = self.spark.createDataFrame([], self.schema() or T.StructType())
            return empty.withColumn("__shard_path", F.lit(None).cast("string")) if with_shard else empty
        rows = self.spark.read.schema(self.schema()).parquet(*(f"{self.root}/data/{p}" for p in paths))
        return rows.withColumn("__shard_path", F.regexp_extract("_metadata.file_path", "/data/(.*)$", 1)) if with_shard else rows

    def vacuum(self, min_age_s: float = GRACE_S) -> int:
        """Deletes what is older than min_age_s: data files that the newest manifest does not list, and earlier manifests; returns how many files went.

        The age keeps what a reader of an earlier version still needs, and what a writer has written but not committed yet.
        """
        before = (time.time() - min_age_s) * 1000
        versions, gone = self.versions(), 0
        if not versions:
            return 0
        live = self.manifest(versions[-1])
        for folder in self._fs.listStatus(self._path("data")):
            name = folder.getPath().getName()
            files = [f for f in self._fs.listStatus(folder.getPath()) if f.getPath().getName().endswith(".parquet") and f.getModificationTime() <= before]
            if not files:
                continue
            held = {r["path"] for r in live.where(F.col("path").startswith(f"{name}/")).select("path").toLocalIterator()}  # one write's files
            for file in files:
                if f"{name}/{file.getPath().getName()}" not in held:
                    self._fs.delete(file.getPath(), False)
                    gone += 1
        for version in versions[:-1]:
            path = self._path("manifest", f"v{version:08d}")
            if self._fs.getFileStatus(path).getModificationTime() <= before:
                self._fs.delete(path, True)
        return gone


def sharded(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Appends docs to a new store in two arrivals (a large and a small one) and compacts after each. Per row: doc_id, shard, shard_rows, shard_bytes, tier, version."""
    store = ShardStore(docs.sparkSession)
    small = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(ARRIVALS)) == 0
    for arrival in (docs.where(~small), docs.where(small)):
        store.append(arrival)
        store.compact()
        store.vacuum(0)  # nobody else reads or writes this store
    rows = store.read(with_shard=True).select(F.col(doc_id).cast("long").alias("doc_id"), F.col("__shard_path").alias("path"))
    shards = store.manifest()
    tier = F.greatest(F.lit(0), F.floor(F.log(float(FANOUT), F.col("bytes") / BASE_BYTES))).cast("long")
    return rows.join(shards, "path").select("doc_id", F.col("path").alias("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), tier.alias("tier"), "version")
