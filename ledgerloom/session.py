"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Sessions of a busy key are merged before the exchange.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Repeated years in one payload: the last one wins.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

#: For stages stored in buckets of documents.
BUCKET_CONF = {
    # They are joined on (document, row) where they lie.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # In Spark 4.1 a union claims the partitioning of bucketed scans that are turned off behind it.
    "spark.sql.unionOutputPartitioning": "false",
    # A stored stage takes several times its files' size in memory: joins must not broadcast it through the driver for its files' sake.
    "spark.sql.sources.fileCompressionFactor": "4.0",
}

_work: dict[str, str] = {}


def tune(spark: SparkSession, more: dict[str, str] | None = None) -> SparkSession:
    """Apply the run-time settings the operators rely on; cluster sizing is left to the cluster."""
    for key, value in (RUNTIME_CONF | (more or {})).items():
        spark.conf.set(key, value)
    # The few Python functions travel with the plan, so executors need no copy of this package.
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    return spark


def work_dir(spark: SparkSession) -> str:
    """A folder of this session under spark.checkpoint.dir, which all executors share.

    Where the setting is absent, local mode sets a temporary folder; a cluster has to name one.
    """
    app = spark.sparkContext.applicationId
    if app not in _work:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None and spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="ledgerloom-")
            spark.conf.set("spark.checkpoint.dir", base)
        if base is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _work[app] = os.path.join(base, f"ledgerloom-{uuid.uuid4().hex}")
    return _work[app]


def stored_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write a stage boundary in hash buckets of a key and read it back: joins and sums by that key need no exchange.

    A task reads a bucket as a stream; the number of buckets goes with the input.
    """
    spark = df.sparkSession
    name = f"stage_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", os.path.join(work_dir(spark), name)).format("parquet").saveAsTable(name))
    return spark.table(name)


def materialise(df: DataFrame, name: str | None = None, partition_by: tuple[str, ...] = (), options: dict[str, str] | None = None) -> DataFrame:
    """Write a stage boundary as Parquet and read it back, so that later stages restart from it.

    For frames that several branches of a plan use; without a name the folder is a new one. `options` are the writer's.
    """
    spark = df.sparkSession
    path = os.path.join(work_dir(spark), name or uuid.uuid4().hex)
    df.write.mode("overwrite").options(**(options or {})).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
