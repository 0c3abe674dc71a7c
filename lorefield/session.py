"""Session helpers: table access, shared checkpoint folder and partition spreading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``<sf_dir>/<name>.parquet``; column pruning and filters are left to Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Removes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FOLDERS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if the session names one.

    A temporary folder is used only where the setting is absent and the session runs in one process, as in local
    tests. On a cluster without the setting there is no folder that every executor sees, so this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jsc.get() if jsc.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "lorefield-shared")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, for tables that are written and read again.

    All of a session's scratch tables lie in one folder, which goes when the session's JVM ends.
    """
    root = checkpoint_dir(spark).rstrip("/")
    app = spark.sparkContext.applicationId
    if _FOLDERS.get(app) != root:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/lorefield-{app}")
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(folder)
        system.deleteOnExit(folder)
        _FOLDERS[app] = root
    return f"{root}/lorefield-{app}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage like ``checkpoint()``, survives the loss of executors, and stays columnar, so later
    reads still prune columns. Shuffle files of the write go with it instead of staying until the
    driver happens to collect its garbage, so only one step's shuffles lie on the disks at a time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``materialise`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Rebalance ``df`` when its scan has fewer partitions than the cluster has cores.

    Meant before CPU-heavy Python stages over few input splits; large inputs pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores * factor)
    return df
