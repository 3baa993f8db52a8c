"""Event handling on Structured Streaming: every event once, an append-only log, windows with late data.

Streams read new files of a folder and stop when all that is there has been read (availableNow), so a run is a batch that
remembers where it was; its checkpoint lies in the shared folder.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.session import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A stream of the Parquet files at `path` (a file or a folder); the last letter is made a pattern, which either matches."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def handle_once(stream: DataFrame, key: str, order: list[str], log: str, checkpoint: str) -> DataFrame:
    """Appends the first event of each key to `log`; an event delivered again, in any batch or run, changes nothing.

    Within a batch the first by `order` counts. Which keys have been seen is kept in the state store (a row per key, in the
    checkpoint), so a batch costs what it holds, not what the log does: a key is new where its first arrival is this batch's.
    A batch that is repeated after a failure has its old time and replaces what it wrote (its folder is named by the batch
    number), so the log has each key once.
    """
    spark = stream.sparkSession
    columns = [c for c in stream.columns if c != key]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    arrived = stream.where(F.col(key).isNotNull()).withColumn("_at", F.current_timestamp())
    seen = arrived.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct("_at", *order)).alias("_e"), F.min("_at").alias("_first"), F.max("_at").alias("_last"))

    def handle(batch: DataFrame, number: int) -> None:
        new = batch.where("_first = _last").select(key, "_e.*").select(*stream.columns)
        new.write.mode("overwrite").parquet(f"{log}/batch={number}")

    query = seen.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return read_log(spark, log, stream.schema)


def read_log(spark: SparkSession, log: str, schema) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(log).select(*schema.fieldNames())


def call_with_retries(call, request, waits: tuple[float, ...] = (0.2, 0.5), timeout: float = 5.0, final: tuple[int, ...] = (422,)):
    """(status, answer) of call(request, timeout), for a service that a task of mapInPandas asks.

    A failed call (an exception, or a status of 500 or more) is repeated after each of `waits` seconds; a status in `final` is never.
    The last failure is (0, its text) or the status. Each call has `timeout` seconds, which it is handed.
    """
    for wait in (*waits, None):
        try:
            status, answer = call(request, timeout)
        except Exception as error:
            status, answer = 0, str(error)
        if status in final or 0 < status < 500 or wait is None:
            return status, answer
        time.sleep(wait)


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, keys: list[str], log: str, checkpoint: str) -> DataFrame:
    """Counts per window and key, with a watermark that bounds the state. An extension; windows still open at the end are kept too."""
    spark = stream.sparkSession
    counts = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))

    def handle(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").alias("start"), *keys, "n", F.lit(number).alias("batch_no")).write.mode("overwrite").parquet(f"{log}/batch={number}")

    query = counts.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    updates = spark.read.parquet(log)
    return updates.groupBy("start", *keys).agg(F.max_by("n", "batch_no").alias("n"))


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/cartloom/{name}-{uuid.uuid4().hex}"
