"""Merkle manifest of a dataset, with a proof for every row.

Rows are leaves, in order within their group; ``FANOUT`` consecutive nodes become one parent
until a single node, the group's subroot, remains; the subroots, ordered by group, likewise
become the root. Parents are built by a slot pivot: conditional aggregates over the rows of a
parent spread its children into ``FANOUT`` columns. All columns concatenated give the parent's
digest; without the row's own column they are its siblings.

``HEIGHT`` levels share one shuffle: rows are dealt by the number of their ancestor ``HEIGHT``
levels up, and every level in between is an aggregate over windows that this dealing and its
sort order already satisfy. A task never gathers more than ``FANOUT ** HEIGHT`` rows of a key,
whatever a group holds, and each pass hands on that many times fewer rows. Going down again,
a node's proof is its own steps and its ancestor's, by one join a pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm.order import running
from tallyframe.llm.store import keep

FANOUT = 3
HEIGHT = 5   # levels to one shuffle


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for a null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _climb(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """``nodes`` (_group, _at: place, _of: nodes of the group, _digest) plus _up (digest of the
    ancestor ``height`` levels up) and _steps (siblings before and after on the way there).
    A group's only node is its own parent, without a step."""
    ups = [f"_up{i}" for i in range(height, 0, -1)]
    slots = [f"_slot{s}" for s in range(fanout)]
    out = nodes.selectExpr("*", "_digest AS _up", *[f"_at div {fanout ** i} AS _up{i}" for i in range(height, 0, -1)])
    for level in range(height):
        nth = f"(_at div {fanout ** level}) % {fanout}"
        keys = ", ".join(["_group", *ups[:height - level]])
        # The rows under one child agree in its digest.
        out = out.selectExpr("*", *[f"max(CASE WHEN {nth} = {s} THEN _up END) OVER (PARTITION BY {keys}) AS {slots[s]}" for s in range(fanout)])
        before = ", ".join(f"CASE WHEN {nth} > {s} THEN {slots[s]} END" for s in range(fanout))
        after = ", ".join(f"CASE WHEN {nth} < {s} THEN {slots[s]} END" for s in range(fanout))
        more = f"_of > {fanout ** level}"
        out = out.selectExpr(
            *[c for c in out.columns if c != "_up" and c not in slots],
            f"CASE WHEN {more} THEN sha2(concat_ws('', {', '.join(slots)}), 256) ELSE _up END AS _up",
            f"CASE WHEN {more} THEN named_struct('before', concat_ws('', {before}), 'after', concat_ws('', {after})) END AS _step{level}")
    steps = ", ".join(f"_step{i}" for i in range(height))
    return out.selectExpr(*[f"`{c}`" for c in nodes.columns], "_up", f"filter(array({steps}), s -> s IS NOT NULL) AS _steps",
                          f"_up{height} AS _block")


def _tops(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """``nodes`` plus _top (digest of their group's last node) and _path (steps to it)."""
    most = nodes.agg(F.max("_of")).first()[0] or 0
    passes, width = [nodes], fanout ** height
    while most > 1:
        block = _climb(passes[-1], fanout, height).filter(F.col("_at") % width == 0)
        passes.append(keep(block.select("_group", F.col("_block").alias("_at"), F.ceil(F.col("_of") / F.lit(width)).alias("_of"),
                                        F.col("_up").alias("_digest")), "nodes"))
        most = -(-most // width)
    step = "array<struct<before:string,after:string>>"
    above = passes[-1].select("*", F.col("_digest").alias("_top"), F.array().cast(step).alias("_path"))
    for level in reversed(passes[:-1]):
        known = above.select(F.col("_group").alias("_g"), F.col("_at").alias("_a"), "_top", "_path")
        above = (_climb(level, fanout, height)
                 .join(known, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_a")))
                 .select(*level.columns, "_top", F.concat("_steps", "_path").alias("_path")))
        if level is not passes[0]:
            above = keep(above, "paths")
    return above


def manifest(rows: DataFrame, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """``rows`` (group, key, leaf, and any further columns) plus subroot, root and steps: for
    each level on the way to the root the siblings before and after, concatenated.

    Within a group leaves ascend by key (null keys first), rows of one key by their digest, so
    repeated rows are leaves of their own that may change places unseen. Groups ascend by their
    bytes, a null group first. Columns named like the new ones are replaced; an empty table
    gives an empty result."""
    rows = rows.drop("subroot", "root", "steps")
    given = [c for c in rows.columns if c not in ("group", "leaf")]
    one = F.lit(1).cast("long").alias("_one")
    leaves = rows.select(F.col("group").alias("_group"), F.col("leaf").alias("_digest"), *given, one)
    order = [F.col("key").asc_nulls_first(), F.col("_digest")]
    ranked = keep(running(leaves, order, "_one", "_at", by="_group", total="_of").drop("_one"), "leaves")
    found = _tops(ranked, fanout, height)
    groups = keep(_tops_of_groups(found), "subroots")
    roots = _tops(running(groups.select(F.lit(0).alias("_group"), "_name", "_digest", one),
                          [F.col("_name").asc_nulls_first()], "_one", "_at", total="_of").drop("_one"), fanout, height)
    roots = roots.select(F.col("_name"), F.col("_top").alias("root"), F.col("_path").alias("_rest"))
    return (found.join(roots, F.col("_group").eqNullSafe(F.col("_name")))
            .select(F.col("_group").alias("group"), F.col("_digest").alias("leaf"), *given, F.col("_top").alias("subroot"),
                    "root", F.concat("_path", "_rest").alias("steps")))


def _tops_of_groups(found: DataFrame) -> DataFrame:
    return found.filter("_at = 0").select(F.col("_group").alias("_name"), F.col("_top").alias("_digest"))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def documents_manifest(docs: DataFrame) -> DataFrame:
    """Manifest of documents (doc_id, source, lang, n_chars, text) by source, and the check of
    a tampered copy: rows whose id's crc32 is even lose their text's line breaks, and each
    row's tampered leaf is folded with the original siblings.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. Null values have
    a leaf of their own (``-``), empty and very long texts are hashed whole, and a null id is
    not tampered with. Other columns of ``docs`` are not read."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = digest(*[field(F.col(c)) for c in fields])
    cut = F.replace("text", F.lit("\n"), F.lit(""))
    other = digest(*[field(cut if c == "text" else F.col(c)) for c in fields])
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    rows = docs.select(F.col("source").alias("group"), F.col("doc_id").alias("key"), leaf.alias("leaf"),
                       F.when(even & F.contains("text", F.lit("\n")), other).alias("tampered"))
    out = manifest(rows).withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("steps")))
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
