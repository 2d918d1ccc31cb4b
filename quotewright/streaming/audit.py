"""The audit sink: verdicts and ids, never a user's text; in batches and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ["ts", "request_id", "stage", "verdict", "detail_json"]
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def audit_rows(matches: DataFrame, request: str, stage: str, ts) -> DataFrame:
    """One row per request: its verdicts in order and the ids of its records as JSON, without any text."""
    per = matches.groupBy(request).agg(F.array_sort(F.collect_list(F.struct("span_no", "verdict", "record_id"))).alias("spans"))
    return per.select(ts.cast("string").alias("ts"), F.col(request).cast("string").alias("request_id"), F.lit(stage).alias("stage"), F.element_at("spans", 1).verdict.alias("verdict"), F.to_json(F.struct(F.transform("spans", lambda s: s.verdict).alias("verdicts"), F.transform("spans", lambda s: s.record_id).alias("record_ids"))).alias("detail_json"))


def event_audit(events: DataFrame) -> DataFrame:
    """Events as audit rows."""
    return events.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("event_id").cast("string").alias("request_id"), F.col("event_type").alias("stage"), F.when(F.col("value").isNull(), "none").when(F.col("value") < 0, "negative").otherwise("recorded").alias("verdict"), F.col("props").alias("detail_json"))


def append(rows: DataFrame, path: str) -> None:
    rows.select(*COLUMNS).write.mode("append").parquet(path)


def stream(spark: SparkSession, directory: str, glob: str, path: str, checkpoint: str):
    """Read new event files once and append their audit rows. Each batch writes its own folder, so a batch that runs again
    after a loss replaces what it wrote and no row is doubled."""
    events = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).parquet(directory)

    def write(batch: DataFrame, number: int) -> None:
        batch.select(*COLUMNS).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return event_audit(events).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total: events per window, batch or stream; rows later than `late` are left out of a
    stream only."""
    watched = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late) if events.isStreaming else events.withColumn("at", F.col("ts").cast("timestamp"))
    return watched.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
