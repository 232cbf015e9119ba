"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders that were chosen where the session names none, by application.
_CHOSEN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset and all runs on one machine, a local folder is chosen."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        application = spark.sparkContext.applicationId
        if application not in _CHOSEN:
            _CHOSEN[application] = tempfile.mkdtemp(prefix="docflow-")
        root = _CHOSEN[application]
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what is used again is not computed again, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/docflow/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
