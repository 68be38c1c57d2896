"""Session helpers: a local builder for tests and benches, and lineage cuts that survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster, use the session that the cluster provides."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    ship(session)
    return session


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once for each application, wherever the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_graphloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="graphloom-package-"), "graphloom_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("graphloom", os.path.relpath(path, package)))
    context.addPyFile(archive)
    context._graphloom_shipped = True


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a local master may leave it unset and gets a scratch folder of
    this machine; on a cluster, whose executors don't share one, that raises."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get(CHECKPOINT_KEY)
        if not shared and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write df as a table in the shared folder, a folder for each value of `partition_by`, and read it back.

    The plan that made it is gone, so a lost executor costs a read and no recomputation, iterations keep small plans, and
    later joins know the table's size.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over at least the cluster's cores by hash of a key, where its scan has fewer partitions (few or small files);
    otherwise as it is. For work in Python that costs more than a shuffle of its input."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote, once nothing lazy reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("cut-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
