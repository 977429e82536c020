"""Session settings and the checkpoint folder shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Skewed keys are handled by the runtime re-planner: it splits hot join
# partitions, also where an aggregate sits on top of the join.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a live session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(name: str = "ledgerloom", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints, as named by ``spark.checkpoint.dir``.

    A temporary folder is used only on a local master, where every task runs on
    this machine; on a cluster an unset folder is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-ckpt-")
    context.setCheckpointDir(folder)
    return folder


def stable(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage once and read it from there.

    Used where two branches must see identical rows (generated ids, iterations)
    and where lineage would otherwise grow. Survives the loss of executors.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it from there.

    For long iterations: a checkpoint keeps the constraints that the plan implied
    about its columns, and those multiply from round to round.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
