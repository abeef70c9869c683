"""Session settings the jobs rely on, and reliable materialisation of shared results."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Wall-clock logs are kept zone-free; every conversion to an instant is done in UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs a later step its partitioning.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Stored intermediate results go when the frames that read them do.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # No stack walk per column expression while a plan is built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # A panel compiles some hundred expressions; the default cache of 100 would recompile them.
    "spark.sql.codegen.cache.maxEntries": "2000",
    "spark.ui.enabled": "false",
}

SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "steadypace", **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` uses ``__`` for dots in setting names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in extra.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="steadypace-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it on reliable storage, so that several consumers can read it
    and a lost executor does not repeat the work behind it. The shuffle files of that work go at once, not when
    the driver happens to collect its garbage: until then every step of a job would add its own."""
    spark = df.sparkSession
    _ensure_checkpoint_dir(spark)
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        # The setting holds for plans made under it, so for this one and its shuffles alone.
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def release(spark: SparkSession) -> None:
    """Let stored results that nothing refers to any more go now; they go when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
