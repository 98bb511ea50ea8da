"""Streaming operators: windowed counts, sliding rates, deduplication and idempotent sinks.

All take a streaming or a batch frame; lateness is bounded by watermarks, so
state is bounded too. A window is given off once the watermark has passed it. A
stream that has come to its end is closed by a heartbeat, a row without values far in
the future: it moves the watermark past all windows that are still open.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesselar.storage import place_for

HEARTBEAT = "2200-01-01 00:00:00"


@dataclass
class Source:
    """A stream of event files and the folder in which its heartbeat may appear."""

    stream: DataFrame
    heartbeats: str
    schema: StructType

    def close(self) -> None:
        spark = self.stream.sparkSession
        row = spark.range(1).select(*(F.lit(HEARTBEAT if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in self.schema))
        row.write.mode("append").parquet(self.heartbeats)


def source(spark: SparkSession, path: str, pattern: str, files_per_trigger: int = 16) -> Source:
    """Parquet files of a folder as a stream; ``pattern`` is a glob of file names. Event times without zone are read in the session's."""
    schema = spark.read.parquet(f"{path}/{pattern}").schema
    beats = place_for(spark, "heartbeats")
    spark.createDataFrame([], schema).write.parquet(beats)
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    both = read.option("pathGlobFilter", pattern).parquet(path).unionByName(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(beats))
    return Source(both.withColumn("ts", F.col("ts").cast("timestamp")), beats, schema)


def read_stream(spark: SparkSession, path: str, pattern: str, files_per_trigger: int = 16) -> DataFrame:
    """The event files alone."""
    schema = spark.read.parquet(f"{path}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """(start, by, n, total) of each window once it is complete."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sliding_rate(events: DataFrame, width: str = "60 seconds", step: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """(start, n): events in each sliding window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of runs of events without a longer gap."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once; its copies within the lateness are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def run_to_table(stream: DataFrame, name: str, mode: str = "append", closing: Source | None = None) -> DataFrame:
    """Run a stream over what is there and give the rows it wrote; with ``closing`` the source's last windows too.

    Each batch goes to a folder named by its number, so a batch that is run again
    after a failure replaces its own rows.
    """
    spark = stream.sparkSession
    place = place_for(spark, f"stream-{name}")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/batch={number}")

    def run() -> None:
        writer = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{place}/state")
        writer.trigger(availableNow=True).start().awaitTermination()

    run()
    if closing:
        closing.close()
        run()
    return spark.read.schema(stream.schema.add("batch", "integer")).parquet(f"{place}/rows").drop("batch")
