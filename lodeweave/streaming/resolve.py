"""Streams: titles resolved batch by batch, an idempotent sink, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions import text
from lodeweave.operators import decide
from lodeweave.plans.frames import hints


def with_signals(titles: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, title and expected_id (null) with all signals."""
    t = titles.select("query_id", "title", F.lit(None).cast("string").alias("expected_id"), *text.signals(F.col("title")))
    t = t.join(hints(t, catalog, "color"), "query_id", "left").join(hints(t, catalog, "series"), "query_id", "left")
    empty = F.array().cast("array<string>")
    return t.withColumns({"color_hints": F.coalesce("color_hints", empty), "series_hints": F.coalesce("series_hints", empty)})


def resolve_stream(titles: DataFrame, catalog: DataFrame, path: str, checkpoint: str):
    """Resolve a stream of (query_id, title); each micro-batch goes to its own folder, so a replay overwrites itself.

    Ranking within a query isn't allowed on an unbounded stream, hence ``foreachBatch``.
    """

    def sink(batch: DataFrame, number: int) -> None:
        signals = with_signals(batch.dropDuplicates(["query_id"]), catalog).persist()
        rows = decide.resolve(signals, catalog)
        rows.select("query_id", "title", "status", "reason", "confidence", F.when(F.col("status") == "matched", F.col("top_id")).alias("doc_id")).write.mode("overwrite").parquet(f"{path}/batch={number}")
        signals.unpersist()

    return titles.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


def _timed(events: DataFrame) -> DataFrame:
    """Event times without a zone are taken as UTC."""
    return events if events.isStreaming and events.schema["ts"].dataType.typeName() == "timestamp" else events.withColumn("ts", F.col("ts").cast("timestamp"))


def once(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark, which later operators of the query share."""
    return _timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, key: str | None = "event_id", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events of each kind by window, each ``key`` once; events later than ``late`` behind the watermark are left out."""
    marked = once(events, key, late) if key else _timed(events).withWatermark("ts", late)
    return marked.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
