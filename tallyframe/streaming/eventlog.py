"""The consultant event log as an append-only stream.

New JSON-lines files dropped into the log folder are picked up by a file-source
stream; the counts behind the summary (strategies per goal, business type and email) are
maintained as streaming state and written with ``foreachBatch`` or to any
Structured Streaming sink. The checkpoint lives under ``spark.checkpoint.dir``, so
a restarted query resumes from where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import checkpoint_dir
from tallyframe.sources.eventlog import EVENT_SCHEMA, append_events


def event_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(folder).withColumn("ts", F.try_to_timestamp(F.col("timestamp")))


def strategy_counts_stream(events: DataFrame) -> DataFrame:
    """Running counts of strategy events per (goal, business type), emails approximately;
    complete mode. ``strategy_state_stream`` is the exact form."""
    s = events.filter(F.col("event") == "strategy_generated")
    return s.groupBy(F.coalesce(F.col("goal_label"), F.lit("")).alias("goal_label"),
                     F.coalesce(F.col("business_type"), F.lit("")).alias("business_type")).agg(
        F.count(F.lit(1)).alias("strategies"),
        F.approx_count_distinct(F.when(F.col("email") != "", F.col("email"))).alias("approx_unique_emails"))


def strategy_state_stream(events: DataFrame) -> DataFrame:
    """Running counts of strategy events per (goal, business type, email). The state is keyed by
    the email too: it spreads over the tasks also where one goal holds most events, and distinct
    emails of any grouping are exact (``strategy_counts``, ``strategy_totals``)."""
    s = events.filter(F.col("event") == "strategy_generated")
    return s.groupBy(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("goal_label", "business_type", "email")]).agg(
        F.count(F.lit(1)).alias("strategies"))


def strategy_counts(state: DataFrame) -> DataFrame:
    """Strategies and distinct non-empty emails per (goal, business type), from the state."""
    return state.groupBy("goal_label", "business_type").agg(
        F.sum("strategies").alias("strategies"), F.count_if(F.col("email") != "").alias("unique_emails"))


def strategy_totals(state: DataFrame) -> DataFrame:
    """One row as ``sources.eventlog.strategy_log_summary`` gives it, from the state."""
    def top(c: str) -> F.Column:
        per = state.filter(F.col(c) != "").groupBy(c).agg(F.sum("strategies").alias("n"))
        return F.coalesce(per.agg(F.min_by(c, F.struct(-F.col("n"), F.col(c)))).scalar(), F.lit("\u2014"))

    emails = state.filter(F.col("email") != "").select("email").distinct().agg(F.count(F.lit(1))).scalar()
    return state.agg(F.coalesce(F.sum("strategies"), F.lit(0)).alias("total_strategies")).select(
        "total_strategies", emails.alias("unique_emails"), top("goal_label").alias("top_goal"),
        top("business_type").alias("top_biz"))


def daily_events_stream(events: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Events per day and type with a watermark, so late files up to ``watermark``
    are still counted and old state is dropped (append mode)."""
    return (events.withWatermark("ts", watermark)
            .groupBy(F.window("ts", "1 day"), "event").agg(F.count(F.lit(1)).alias("events")))


def start_summary(spark: SparkSession, folder: str, query_name: str = "strategy_counts", sink: str = "memory",
                  trigger_once: bool = False, counts=strategy_counts_stream):
    """Start the running summary; ``sink='memory'`` exposes it as a temp view. With
    ``counts=strategy_state_stream`` that is the state for ``strategy_counts`` and
    ``strategy_totals``."""
    q = (counts(event_stream(spark, folder)).writeStream.outputMode("complete")
         .format(sink).queryName(query_name)
         .option("checkpointLocation", f"{checkpoint_dir(spark)}/stream-{query_name}"))
    if trigger_once:
        q = q.trigger(availableNow=True)
    return q.start()


def start_append(events: DataFrame, path: str, name: str, trigger_once: bool = False):
    """Write a stream of events to the log, each micro-batch as a named batch: one that is
    repeated after a restart replaces itself, so each record is in the log once."""
    q = (events.writeStream.foreachBatch(lambda rows, n: append_events(rows, path, f"{name}-{n}")).queryName(name)
         .option("checkpointLocation", f"{checkpoint_dir(events.sparkSession)}/stream-{name}"))
    if trigger_once:
        q = q.trigger(availableNow=True)
    return q.start()
