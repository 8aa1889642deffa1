"""Session construction and reliable materialisation."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "driftline", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators rely on.

    Adaptive execution supplies three things the plans count on: runtime
    broadcast of small sides (bounded by ``autoBroadcastJoinThreshold``),
    splitting of skewed join partitions, and coalescing of small shuffles.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a master without executors of its own may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) \
        or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # local-cluster has executors
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="driftline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so lost executors cost nothing."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def is_materialised(df: DataFrame) -> bool:
    """Whether a frame reads nothing but checkpoints, so that using it twice costs little."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return all(leaves.apply(i).getClass().getSimpleName() == "LogicalRDD"
               for i in range(leaves.size()))
