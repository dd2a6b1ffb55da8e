"""Intermediate tables in the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import checkpoint_dir


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it. The lineage is
    cut there: a lost executor costs a re-read, not a re-run, and every later use sees the
    same rows."""
    path = f"{checkpoint_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> int:
    """Partitions for keyed work, as the session is set for its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: str, by: int):
    """crc32 of the id's decimal text modulo ``by`` (null ids: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def fresh(names: list[str], columns: list[str]) -> list[str]:
    """``names`` with so many underscores before each that none of ``columns`` is called so."""
    taken, prefix = {c.lower() for c in columns}, ""
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]
