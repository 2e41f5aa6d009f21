"""Re-index as files change: a stream of source files becomes versions of their declarations and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import java

FILE = "project string, path string, content string, mtime bigint, size bigint"


def watch(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of file rows (Parquet) that arrive in a folder."""
    return spark.readStream.schema(FILE).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def reindex(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Parse new files as they arrive and append their rows; the sink's log makes each batch count once.

    Parsing is a map over files, so that the stream holds no state; it ends when all that has arrived is read.
    """
    rows = java.parsed_versions(files)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest(rows: DataFrame) -> DataFrame:
    """Of each path the rows of its last version."""
    newest = rows.groupBy("path").agg(F.max(F.struct("mtime", "size")).alias("_v")).select("path", "_v.mtime", "_v.size")
    return rows.join(newest, ["path", "mtime", "size"], "left_semi").dropDuplicates(["path"])


def event_counts(events: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Events by window and kind; those later than the watermark no longer count. Works on streams and on tables."""
    ts = F.col("ts").cast("timestamp")
    return (events.withColumn("ts", ts).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
            .agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total"))
