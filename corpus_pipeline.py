"""A training-corpus pipeline of five stages, each with one operator of ``tallyframe.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
reread as the next one's docs. All but the last return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, jaccard_join, mixing, quality, sharding
from tallyframe.llm.queries import SEED, SHARDS
from tallyframe.llm.store import documents, fresh, keep, table


def _hash(docs: DataFrame) -> Column:
    """Hash of all columns of a row. Map columns, which Spark does not hash, by their JSON."""
    maps = [f.name for f in docs.schema.fields if "map<" in f.dataType.simpleString()]
    return F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if c in maps else F.col(f"`{c}`") for c in docs.columns])


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the least id (rows without an
    id come last). Ids need not be unique or known: equal texts are one node, named by their
    hash, and rows are told apart by the hash of all their columns. Of rows equal in all columns
    one stays. Texts without words are in no group. Further columns may have any name and type;
    very long texts count whole; an empty table gives an empty result."""
    row, node = fresh(["row", "node"], docs.columns)
    keyed = docs.select("*", _hash(docs).alias(row), F.xxhash64("text").alias(node))
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0d]"), F.lit(False))
    slim = keyed.filter(has_words).select(F.col("doc_id").alias("id"), "text", F.col(row).alias("row"), F.col(node).alias("node"))
    texts = keep(slim.select("node", "text").groupBy("node").agg(F.first("text").alias("text")), "texts")
    found = keep(jaccard_join.classes(texts, jaccard_join.Similarity(words=5, percent=80), id_col="node"), "classes")
    rows = keep(slim.groupBy("row", "node").agg(F.min("id").alias("id"), F.count("*").alias("n")), "rows")
    # One row a text, then one a group: no join meets all rows of a text or group.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "node", "n")).alias("first")
    by_text = rows.groupBy("node").agg(first)
    stays = keep(by_text.join(found, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("first").alias("first"))
                 .select("first.row", "first.node", "first.n"), "stays")
    several = stays.filter("n > 1").select("row", "node")
    gone = rows.join(stays, ["row", "node"], "left_anti").select("row", "node").unionAll(several)

    def named(df: DataFrame) -> DataFrame:
        return df.select(F.col("row").alias(row), F.col("node").alias(node))

    one = keyed.join(named(several), [row, node], "left_semi").dropDuplicates([row, node])
    return keyed.join(named(gone), [row, node], "left_anti").select(*_columns(docs)).unionAll(one.select(*_columns(docs)))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts stay, very long ones are searched
    whole, repeated rows share their fate, and an empty table (of either) changes nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), short_items=True)


def _placed(docs: DataFrame, found: DataFrame, order: list[str], extra: list[str]) -> tuple[DataFrame, list[str]]:
    """``docs`` joined with ``found`` (id, hash: a row's id and hash, and ``extra``), row by row:
    the nth of the rows of an id and hash gets the nth of ``found`` in ``order``. Also the names
    that ``extra`` has in it, which no column of ``docs`` has."""
    names = fresh(["hash", "nth", "id", "other", "other_nth", *extra], docs.columns)
    own, nth, key, other, other_nth = names[:5]
    rows = docs.withColumn(own, _hash(docs)).withColumn(nth, F.row_number().over(W.partitionBy(own, "doc_id").orderBy(F.lit(0))))
    found = found.select(F.col("id").alias(key), F.col("hash").alias(other),
                         F.row_number().over(W.partitionBy("id", "hash").orderBy(*order)).alias(other_nth),
                         *[F.col(c).alias(n) for c, n in zip(extra, names[5:])])
    on = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(other)) & (F.col(nth) == F.col(other_nth))
    return rows.join(found, on), names[5:]


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows that it takes twice are there twice. Texts
    without words are taken 0 words: as often as their source's complete epochs say. Null
    sources are one source, rows equal in all columns are documents of their own, further
    columns may have any name and type, and an empty table gives an empty result."""
    slim = docs.select("doc_id", "text", "source", _hash(docs).alias("hash"))
    mix = mixing.mix(mixing.measure(slim, keep_columns=["hash"]))
    taken = mix.select(F.col("doc_id").alias("id"), "hash", "copies")
    rows, (copies,) = _placed(docs, taken, [F.desc("copies")], ["copies"])
    rows = rows.filter(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return rows.select(*_columns(docs))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot, in the order of a seeded permutation. Columns of
    these two names are replaced, others may have any name and type; rows equal in all columns
    may swap places; an empty table gives an empty result."""
    docs = docs.drop("shard", "slot")
    slim = docs.select(F.col("doc_id").alias("id"), _hash(docs).alias("hash"))
    placed = sharding.shard(slim, [F.col("id").asc_nulls_last(), F.col("hash")], SHARDS, SEED)
    rows, (shard, slot) = _placed(docs, placed, ["shard", "slot"], ["shard", "slot"])
    return rows.select(*_columns(docs), F.col(shard).alias("shard"), F.col(slot).alias("slot"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates),
          ("benchmark_decontamination", benchmark_decontamination), ("source_mixing", source_mixing),
          ("sharding", shards)]

# The quality and mixing stages rest on a language model and on sampling keys.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
