"""Session factory and the shared folder that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "cartloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; `master` only where spark-submit gives none."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a session on one machine (a local master, as in tests) gets a folder of its own; on a cluster that is an error,
    as a folder of one machine would lose the parts that the others write.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cartloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back: a short lineage that outlives any executor.

    The table is deleted by `discard`, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cartloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, fs = _file(spark, path)
    fs.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._cartloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame made by `cut`."""
    path = getattr(df, "_cartloom_path", None)
    if path:
        target, fs = _file(df.sparkSession, path)
        fs.delete(target, True)


def spread(scan: DataFrame) -> DataFrame:
    """A table scan with work for all cores: a table of few files is dealt out, one of many splits is left as it is.

    Only for scans (their number of partitions is known without running anything) before costly work per row.
    """
    width = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= width else scan.repartition(width)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
