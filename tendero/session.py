"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings every job relies on. They can be set on a running session,
# so a job submitted to an existing cluster session gets them too.
RUNTIME_CONF = {
    # day boundaries of prices and histories are UTC days
    "spark.sql.session.timeZone": "UTC",
    # one hot key may hold a third of a fact table: let AQE split its partition,
    # also where the split costs one more exchange for a later aggregate
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", app: str = "tendero", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        # test tables are small: let an exchange of a few MB still use all cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # no call-site lookup for every column expression: plans build faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())


def scratch_base(spark: SparkSession) -> str:
    """The folder of this application's scratch tables.

    It lies in the shared folder named by ``spark.checkpoint.dir``, which every
    executor can reach. Only a local session, whose executors are the driver, may
    leave it unset and gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tendero.localScratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tendero-")
        spark.conf.set("spark.tendero.localScratch", base)
    return f"{base.rstrip('/')}/tendero/{spark.sparkContext.applicationId}"


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder for staged tables and stream checkpoints."""
    return f"{scratch_base(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application has staged. Call it when its results are written:
    a result that is not yet computed may still read a staged table."""
    remove(spark, scratch_base(spark))


def file_system(spark: SparkSession, path: str):
    """The file system of a path and the path itself, as the cluster sees them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a file or folder on the cluster's file system; nothing there is no error."""
    fs, at = file_system(spark, path)
    return fs.delete(at, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    fs, at = file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
