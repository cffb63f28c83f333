"""Session defaults, table access, shared folders and lineage cuts used by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tallyweave", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume: UTC, ANSI and AQE on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a session whose executors run on this machine may leave it unset and gets a temporary
    folder; elsewhere an unset folder is an error, since no executor would find what another wrote.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("tallyweave.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyweave-")
        spark.conf.set("tallyweave.shared.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for a written table."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stable(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` by a checkpoint in the shared folder, which survives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores, where a small file gives fewer; a table of many splits stays as it is, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
