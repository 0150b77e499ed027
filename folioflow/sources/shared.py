"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; on a single machine that names none, a new temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='folioflow-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows from a table that is written now: what reads them needs nothing of how they were made."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(df: DataFrame, label: str) -> DataFrame:
    """The same in a new folder of the shared one."""
    return written(df, f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark writes to, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def spread(df: DataFrame, tasks: int = 3) -> DataFrame:
    """Work on texts costs far more than moving them once: where the input's files give fewer tasks than there are
    cores, rows are dealt to `tasks` times as many. Larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks * cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given documents, with tasks for all cores: a small file is one row group, which is one task."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
