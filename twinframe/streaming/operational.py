"""Live values: a stream of events becomes the latest value of each operational element."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream over Parquet files of events (event_id, ts, user_id, event_type, value, props) that arrive under path."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest(events: DataFrame) -> DataFrame:
    """The last value and event of each user by time, ties by event: works on a table and, in update mode, on a stream."""
    order = F.struct("ts", "event_id")
    return events.groupBy("user_id").agg(F.max_by("value", order).alias("value"), F.max_by("event_type", order).alias("event_type"), F.max("ts").alias("ts"), F.max_by("event_id", order).alias("event_id"))


def windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by tumbling window and type; in a stream, windows close when the watermark passes them."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def upsert(table: DataFrame, changes: DataFrame) -> DataFrame:
    """table, of latest, with changes put in; the later row of a user wins, by the same order."""
    return latest(table.unionByName(changes))


ROW = "user_id long, value double, event_type string, ts timestamp, event_id long"


def current(spark: SparkSession, path: str) -> DataFrame:
    """The latest values that the batches under path have left: of each user's rows, one a batch at most, the last."""
    return latest(spark.read.schema(f"{ROW}, batch long").parquet(f"{path}/values").drop("batch"))


def compact(spark: SparkSession, path: str, upto: int) -> None:
    """Puts the batches up to a number into one, that number's; to be called between batches, and safe to call again."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/values")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    old = sorted(n for s in fs.listStatus(folder) if s.isDirectory() and (n := int(s.getPath().getName().removeprefix("batch="))) <= upto)
    if len(old) < 2:
        return
    aside, moved = f"{path}/aside", spark._jvm.org.apache.hadoop.fs.Path
    latest(spark.read.schema(ROW).parquet(*(f"{path}/values/batch={n}" for n in old))).write.mode("overwrite").parquet(aside)
    # a row that stands in two batches counts once, so a halt between these steps changes no value
    fs.delete(moved(f"{path}/values/batch={old[-1]}"), True)
    fs.rename(moved(aside), moved(f"{path}/values/batch={old[-1]}"))
    for n in old[:-1]:
        fs.delete(moved(f"{path}/values/batch={n}"), True)


def run(events: DataFrame, path: str, checkpoint: str, compact_every: int = 100):
    """Starts keeping the latest values under path: a batch of k users writes k rows, under its own number, so a batch that runs again writes the same. `current` reads them.

    Every compact_every batches those before are put into one.
    """

    def write(batch: DataFrame, number: int) -> None:
        if number and number % compact_every == 0:
            compact(batch.sparkSession, path, number - 1)
        latest(batch).select(*(c.split()[0] for c in ROW.split(", "))).write.mode("overwrite").parquet(f"{path}/values/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").start()
