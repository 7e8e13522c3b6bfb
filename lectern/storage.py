"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``.

    Only where none is set and driver and executors are one process (tests, a laptop) a local temporary folder is set instead.
    """
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not known:
        if not _local(context.master):
            raise ValueError(f"spark.checkpoint.dir is not set: a cluster ({context.master}) needs a folder that all its machines share")
        known = tempfile.mkdtemp(prefix="lectern-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(known)
    return known


#: Where it is set as a frame is made, Spark deletes what an action on it has shuffled as soon as the action is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_once(df: DataFrame) -> DataFrame:
    """The frame for one action, with which its shuffle files go; else they stay until the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return df.select("*")
    finally:
        if before is None:
            conf.unset(_CLEANUP)
        else:
            conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; what was shuffled for it goes."""
    shared_dir(df.sparkSession)
    return written_once(df).checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a new Parquet table of the shared folder, which takes a fraction of a checkpoint's space."""
    folder = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def drop_cut(df: DataFrame) -> None:
    """Delete what ``cut`` has written for a frame that nothing reads any more."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRDD" and plan.rdd().getCheckpointFile().isDefined():
        delete_folder(df.sparkSession, plan.rdd().getCheckpointFile().get())


class Cuts:
    """Cuts that go together, when what they led to is cut itself."""

    def __init__(self) -> None:
        self._held: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self._held.append(cut(df))
        return self._held[-1]

    def drop(self) -> None:
        while self._held:
            drop_cut(self._held.pop())


def spread(df: DataFrame) -> DataFrame:
    """The frame over all cores: a file that Spark can't split is dealt out anew; inputs of enough splits stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
