"""Session defaults, checkpointing and stage tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# folders of our own for local sessions, removed when the interpreter ends
_LOCAL_CHECKPOINTS: dict[str, tempfile.TemporaryDirectory] = {}


def get_spark(app: str = "provloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings every operator assumes: UTC, AQE with skew joins, Arrow."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.checkpoint.compress", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session: ``spark.checkpoint.dir`` names a shared folder on a
    cluster; only where it is unset (tests, laptops) a folder of our own is used."""
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if current := sc.getCheckpointDir():
        return current
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        if sc.applicationId not in _LOCAL_CHECKPOINTS:
            _LOCAL_CHECKPOINTS[sc.applicationId] = tempfile.TemporaryDirectory(
                prefix="provloom-ckpt-", ignore_cleanup_errors=True
            )
        conf = _LOCAL_CHECKPOINTS[sc.applicationId].name
    sc.setCheckpointDir(conf)
    return conf


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a table of their own below ``spark.checkpoint.dir``: as safe as a checkpoint, but compressed by column,
    and a reader takes the columns that it names. For large tables that are read more than once."""
    path = shared_folder(df.sparkSession, "rows")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; every call has one of its own."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage_table(df_fn, spark: SparkSession, path: str, refresh: bool = False) -> DataFrame:
    """Result of a stage: read back when there is a table at ``path``, else computed and saved. A job's
    files come into the folder when it is committed, so a table that can be read is complete."""
    if not refresh:
        try:
            return spark.read.parquet(path)
        except AnalysisException:  # no folder, or no files in it yet
            pass
    df_fn().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the workers, for sessions whose workers cannot import it from a shared path."""
    folder = os.path.dirname(os.path.abspath(__file__))
    held = tempfile.mkdtemp(prefix="provloom-zip-")
    name = shutil.make_archive(os.path.join(held, "provloom"), "zip", os.path.dirname(folder), os.path.basename(folder))
    spark.sparkContext.addPyFile(name)


def own_columns(df: DataFrame) -> DataFrame:
    """The same columns under ids of their own, so that two sides derived from one input can meet in
    a cogroup."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def no_rows(*names):
    """An empty pandas frame that converts to any column type."""
    import pandas as pd

    return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
