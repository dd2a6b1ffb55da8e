"""The consultant event log: JSON-lines source and append sink, and its summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("business_type", T.StringType()),
    T.StructField("goal_label", T.StringType()),
    T.StructField("timeframe", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("strategy_snippet", T.StringType()),
    T.StructField("goal_questions", T.ArrayType(T.StringType())),
])


def read_event_log(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """JSON lines (or one JSON array per file with ``multiline``) with a fixed schema, batch
    folders included; ``ts`` is the parsed ISO-8601 timestamp."""
    df = (spark.read.schema(EVENT_SCHEMA).option("multiLine", multiline).option("recursiveFileLookup", True).json(path))
    return df.withColumn("ts", F.try_to_timestamp(F.col("timestamp")))


def append_events(events: DataFrame, path: str, batch: str | None = None) -> None:
    """Append records as JSON lines (one file per task; readers take the folder). Texts are
    stored whole; a reader that wants a snippet cuts it. A named ``batch`` has a folder of its
    own that a repeated write replaces: a job or stream that starts again and writes its batch
    once more leaves each record once. Without a name, a repeated write adds its records again."""
    cols = [F.col(f.name).cast(f.dataType).alias(f.name)
            if f.name in events.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields]
    rows = events.select(*cols).write
    if batch is None:
        rows.mode("append").json(path)
    else:
        rows.mode("overwrite").json(f"{path}/batch-{batch}")


def strategy_log_summary(log: DataFrame) -> DataFrame:
    """Over ``strategy_generated`` events: count, distinct non-empty emails, most
    common goal and business type (ties: smallest value; '—' when none)."""
    s = log.filter(F.col("event") == "strategy_generated")

    def top(c: str) -> F.Column:
        per = (s.filter(F.col(c).isNotNull() & (F.col(c) != "")).groupBy(c).agg(F.count(F.lit(1)).alias("n")))
        return F.coalesce(per.agg(F.min_by(c, F.struct(-F.col("n"), F.col(c)))).scalar(), F.lit("—"))

    return s.agg(
        F.count(F.lit(1)).alias("total_strategies"),
        F.count_distinct(F.when(F.col("email") != "", F.col("email"))).alias("unique_emails"),
    ).select("total_strategies", "unique_emails", top("goal_label").alias("top_goal"),
             top("business_type").alias("top_biz"))


def strategy_entries(log: DataFrame) -> DataFrame:
    """The strategy events, newest first."""
    return log.filter(F.col("event") == "strategy_generated").orderBy(F.col("timestamp").desc())
