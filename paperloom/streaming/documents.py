"""The same stages over streams: files landing in a directory, and event-time windows over the trace (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators import personal


def read_landing(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they land; the schema is given, as a stream can't infer it."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def redacted(stream: DataFrame, text: str = "text") -> DataFrame:
    """Recognised values replaced by their labels, and how many there were: stateless, row by row."""
    hits = F.transform(personal.recognised(F.col(text)), lambda h, i: F.struct(h["value"].alias("value"), personal.label(h["entity"]).alias("label"), i.alias("seq")))
    marked = stream.withColumn("_hits", hits)
    return marked.withColumns({text: personal.redact(F.col(text), F.col("_hits")), "pii_count": F.size("_hits")}).drop("_hits")


def latency_windows(trace: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Steps, errors and mean latency of each agent in tumbling windows; steps later than the watermark are left out, a
    step sent again within it counts once."""
    once = trace.withWatermark("ts", late).dropDuplicatesWithinWatermark(["trace_id"])
    out = once.groupBy(F.window("ts", size).alias("w"), "agent_name").agg(F.count("*").alias("steps"), F.count_if("error_occurred").alias("errors"), F.avg("latency_ms").alias("mean_latency_ms"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "agent_name", "steps", "errors", "mean_latency_ms")


def for_each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Any batch stage on micro-batches, exactly once by epoch where `work` writes idempotently."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(work)
    return (writer.trigger(availableNow=True) if once else writer).start()
