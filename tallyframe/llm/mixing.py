"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets are filled like water: a source gets its share by weight, never more than
``max_epochs`` times its own size, and what it cannot take is shared among the others. With
the sources sorted by size over weight, the level follows from prefix sums, so no loop runs.

A source whose target is ``e`` sizes and a rest takes ``e`` complete epochs of every
document; the rest is a weighted sample without replacement: each document draws the
exponential key ``-ln(u) / quality`` (``u`` from a hash of its id, so reruns agree), and
documents are taken in key order until the prefix sum of their sizes meets the budget. The
document that crosses it is taken if that ends nearer to the target.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.order import running
from tallyframe.llm.store import keep
from tallyframe.llm.text import SPACE, per_doc, pieces, sums_between, words


def measure(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
            keep_columns: list[str] = ()) -> DataFrame:
    """(doc_id, source, size, quality, draw): words of the whole text, a quality weight in
    (0, 1] (share of letters and digits among the non-space bytes, all of UTF-8's multi-byte
    characters counted as letters, floored at 0.05), and the hash the sampling key is drawn
    from (of id and text, so repeated rows draw alike and differing ones don't), and
    ``keep_columns``."""
    own = list(keep_columns)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()),
                           T.StructField("draw", T.LongType()), *[docs.schema[c] for c in own],
                           T.StructField("size", T.LongType()), T.StructField("quality", T.DoubleType())])
    letter = np.zeros(256, bool)
    letter[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

    def run(batches):
        for b in batches:
            for p in pieces(b.column("text")):
                _, _, doc = words(p)
                solid = sums_between(~SPACE[p.buf], p.offs)
                good = sums_between(letter[p.buf], p.offs)
                cut = b.slice(p.lo, p.n)
                yield pa.RecordBatch.from_arrays(
                    [cut.column("doc_id"), cut.column("source"), cut.column("draw"), *[cut.column(c) for c in own],
                     pa.array(per_doc(doc, p.n).astype(np.int64)),
                     pa.array(np.maximum(0.05, good / np.maximum(solid, 1)))],
                    ["doc_id", "source", "draw", *own, "size", "quality"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
                        F.col(text).alias("text"), *own)
            .withColumn("draw", F.xxhash64("doc_id", "text", F.lit(17)))
            .select("doc_id", "source", "draw", "text", *own).mapInArrow(run, schema))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): sources in code-point order
    (null last) weigh ``weights``, repeating; together they get ``share`` of all sizes."""
    ranked = running(sources.withColumn("_one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()],
                     "_one", "_rank").drop("_one")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                        (F.col("_rank") % len(weights) + 1).cast("int"))
    # Sums of small dyadic weights and of integers are exact, whatever the order of adding.
    sized = (ranked.withColumn("_w", pick).withColumn("_ratio", F.col("source_size") / F.col("_w"))
             .withColumn("_wl", (F.col("_w") * 1024).cast("long")))
    order = [F.col("_ratio"), F.col("_rank")]
    filled = running(sized, order, "source_size", "_below", total="_all")
    filled = running(filled, order, "_wl", "_wbelow", total="_wall")
    # A source is full if the level at its own ratio, with all before it full, is not enough.
    left = F.lit(float(share)) * F.col("_all") - F.lit(float(max_epochs)) * F.col("_below")
    level = left * 1024.0 / (F.col("_wall") - F.col("_wbelow"))
    full = F.col("_w") * level >= F.lit(float(max_epochs)) * F.col("source_size")
    marked = filled.withColumn("_full", full).withColumn("_level", level)
    # The first source that is not full sets the level for it and all that follow.
    common = marked.filter(~F.col("_full")).agg(F.min_by("_level", F.struct("_ratio", "_rank"))).first()[0]
    return marked.select(
        "source", "source_size",
        F.when(F.col("_full"), F.lit(float(max_epochs)) * F.col("source_size"))
        .otherwise(F.col("_w") * F.lit(float(common or 0.0))).alias("target"))


def mix(measured: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5,
        max_epochs: int = 2) -> DataFrame:
    """``measured`` (see ``measure``) plus source_size, target (of its source), copies (how
    often the mix takes it) and taken (words of that, repeats counted).

    Null texts have size 0 and are taken 0 words; null sources are one source; repeated rows
    are documents of their own. An empty table gives an empty result."""
    rows = keep(measured, "measured")
    by_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    by_source = by_source.withColumnRenamed("source", "_src")
    u = (F.shiftrightunsigned(F.col("draw"), 11).cast("double") + 1.0) / float(1 << 53)
    keyed = rows.withColumn("_key", -F.log(u) / F.col("quality"))
    order = [F.col("_key"), F.col("doc_id").asc_nulls_last(), F.col("draw"), F.col("size")]
    summed = running(keyed, order, "size", "_before", by="source")
    joined = summed.join(by_source, F.col("source").eqNullSafe(F.col("_src")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    # Taken while the sum after it stays nearer to the budget than the sum before it.
    inside = F.col("_before") + F.col("size") / 2.0 <= rest
    copies = (epochs + F.when(inside & (rest > 0), 1).otherwise(0)).cast("int")
    given = [c for c in measured.columns if c != "quality"]
    return joined.select(*given, "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).cast("long").alias("taken"))

