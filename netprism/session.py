"""Session helpers.

The library never creates its own cluster: every function takes the caller's
``SparkSession``.  ``local_session`` is for tests, the bench and examples only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on for results that do not depend on the
# machine: UTC wall clock, adaptive execution for skew and partition sizing.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "netprism", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("NETPRISM_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is (a cluster session without one is an error).  Only in local mode with
    nothing configured (tests, a laptop) a fresh local folder is taken.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                               "(checkpoints must survive lost executors)")
        # local mode (tests, a laptop): a private folder is fine
        configured = tempfile.mkdtemp(prefix="netprism-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint folder for written intermediates."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    import uuid

    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


#: Shuffle files of a query made under this setting go when it has ended, not when the driver's garbage is collected.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written once to ``path`` (a fresh folder under the checkpoint folder by default) and read back.

    Unlike ``checkpoint`` the copy is compressed, its readers scan only their columns, and the shuffles that made it
    take no disk afterwards."""
    spark, path = df.sparkSession, path or scratch_path(df.sparkSession, name)
    before = spark.conf.get(_CLEAN_UP, None)
    names = [f"c{i}" for i in range(len(df.columns))]  # any names a table may have
    if before is not None:
        spark.conf.set(_CLEAN_UP, "true")
    try:
        plain = df.toDF(*names)
        schema = plain.schema
        plain.write.option("compression", "zstd").parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(schema).parquet(path).toDF(*df.columns)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a written intermediate that nothing reads any more, in whatever store Spark wrote it to."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
