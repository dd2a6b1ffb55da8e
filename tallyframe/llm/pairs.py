"""Candidate pairs from shared keys, verified against the texts.

Members of a key's group are first compared with one of them, its pivot: a group of near
copies, however large, takes one comparison a member, and the links join it to one component.
What such stars may miss are links between members of different components. The groups that
still have several components are dealt out as blocks of members, and the task of two blocks
(mostly of one and the same) compares the members that are of different components and of sizes
that allow a link.

Short texts go there whole, and a member is compared with all others at once by the numbers of
their common hashes. A link makes two components one, which are not compared any more. Long texts stay
behind: a member is a sketch, the counts of its set's hashes in 2 ** ``sketch_bits`` buckets, whose
differences add up to no more than the sets'. Each member's ``NEAREST`` others by sketch are
compared first, and then, of the components that are left, all pairs that the sketches do not
rule out. So every two linked texts end in one component.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm.graph import components
from tallyframe.llm.store import keep, tasks
from tallyframe.llm.text import U, pieces

BUCKET = 256  # members compared with one copy of a pivot's text
BLOCK = 1 << 18   # hashes of a block of a group's members
MEMBERS = 1 << 11 # members of a block, as sketches
NEAREST = 4       # others by sketch that a member is compared with first


class SetJoin(Protocol):
    """What is joined: texts are linked at ``percent`` of their sets' union in common."""

    percent: int
    sketch_bits: int   # 0: texts are so short that they need no sketch

    def sets(self, piece) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (hash, document) of a piece of texts, sorted by document, then hash."""


def compared(texts: DataFrame, pairs: DataFrame, sim: SetJoin) -> DataFrame:
    """The pairs (a, b) of nodes with linked, n (size of the set of b) and its sketch, if any.
    ``texts``: (node, text). Each text is sent once for each pair it is a member of, and once for each ``BUCKET`` members as a pivot, so a pivot of many is met by many tasks. Of
    rows that share an id, the most similar pivot row counts."""
    pairs = pairs.select("a", "b").distinct()
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / BUCKET).alias("salts"))
    salted = keep(pairs.join(load, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("long"))
                  .drop("salts"), "pairs")
    wanted = (salted.select(F.col("b").alias("node"), "a", "salt", F.lit(1).alias("role"))
              .unionAll(salted.select(F.col("a").alias("node"), "a", "salt", F.lit(0).alias("role")).distinct()))
    # The pairs grow with the corpus: they are never broadcast, whatever their size here.
    sent = (texts.join(wanted.hint("merge"), "node").repartition(tasks(texts.sparkSession), "a", "salt")
            .sortWithinPartitions("a", "salt", "role"))

    def run(batches):
        key, pivots, top = None, [], U(64 - sim.sketch_bits)
        for batch in batches:
            a, salt, role, node = (batch.column(c).to_numpy() for c in ("a", "salt", "role", "node"))
            got: list[tuple] = []
            for p in pieces(batch.column("text")):
                h, d = sim.sets(p)
                cut = np.searchsorted(d, np.arange(p.n + 1))
                for i in range(p.n):
                    at = p.lo + i
                    own = h[cut[i]:cut[i + 1]]
                    if (a[at], salt[at]) != key:
                        key, pivots = (a[at], salt[at]), []
                    if role[at] == 0:
                        pivots.append(own.copy())
                        continue
                    common, m = max(((_common(pivot, own), len(pivot)) for pivot in pivots), default=(0, 0),
                                    key=lambda x: x[0] / max(x[1] + len(own) - x[0], 1))
                    linked = common > 0 and 100 * common >= sim.percent * (m + len(own) - common)
                    sketch = b""
                    if sim.sketch_bits:
                        counts = np.bincount((own >> top).astype(np.int64), minlength=1 << sim.sketch_bits)
                        sketch = np.minimum(counts, 255).astype(np.uint8).tobytes()
                    got.append((a[at], node[at], linked, len(own), sketch))
            columns = zip(*got) if got else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    names = ["a", "b", "linked", "n", "sketch"]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
    return sent.select("a", "salt", "role", "node", "text").mapInArrow(
        run, "a long, b long, linked boolean, n long, sketch binary")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    if len(x) == 0:
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


def linked_components(keyed: DataFrame, texts: DataFrame, sim: SetJoin) -> DataFrame:
    """(node, component) of all nodes with links, from rows (key, node, slack): linked texts
    share a key. Of its keys of one slack, a node may forget the ``slack // 2`` most frequent
    (linked nodes share more than that). Nodes without a link are not in the result."""
    group = W.partitionBy("key")
    shared = keep(keyed.withColumn("n", F.count("*").over(group)).withColumn("low", F.min("node").over(group))
                  .withColumn("high", F.max("node").over(group)).filter("low < high")
                  .select("key", "node", "slack", "n"), "shared")
    often = W.partitionBy("node", "slack").orderBy(F.desc("n"), "key")
    rare = (shared.withColumn("rank", F.when(F.col("slack") > 1, F.dense_rank().over(often)))
            .filter("slack <= 1 or rank > slack div 2"))
    stars = (rare.withColumn("pivot", F.min("node").over(group)).withColumn("last", F.max("node").over(group))
             .filter("pivot < last and node != pivot").select("key", "node", "pivot").distinct())
    return linked_stars(keep(stars, "stars"), texts, sim)


def linked_stars(stars: DataFrame, texts: DataFrame, sim: SetJoin, copies: bool = False) -> DataFrame:
    """(node, component) of all nodes with links, from distinct rows (key, node, pivot): the
    members of a key's group, and one of them that is the pivot and has no row itself. With
    ``copies`` all texts of a node are the same, and one is taken, of the candidates only."""
    # The texts of candidates, by far not all, are set apart once for all comparisons.
    wanted = stars.select("node").unionAll(stars.select(F.col("pivot").alias("node"))).distinct()
    texts = texts.join(wanted.hint("merge"), "node")
    texts = keep(texts.groupBy("node").agg(F.first("text").alias("text")) if copies else texts, "texts")
    first = keep(compared(texts, stars.select(F.col("pivot").alias("a"), F.col("node").alias("b")), sim), "compared")
    found = keep(components(first.filter("linked").select("a", "b")), "components")

    # A node may have several texts, and is a member with each of them.
    size = first.select(F.col("b").alias("node"), "n", "sketch").distinct()
    label = found.withColumnRenamed("component", "label")
    labelled = (stars.join(size, "node").join(label, "node", "left")
                .select("key", "node", F.coalesce("label", "node").alias("label"), F.col("n").alias("size"), "sketch"))
    if not sim.sketch_bits:
        return _with(found, keep(_in_groups(labelled, texts, sim), "links"))
    labelled = keep(labelled.join(_groups(labelled).select("key"), "key", "left_semi"), "mixed")
    near = keep(_by_sketch(labelled, sim, NEAREST), "near")
    found = _with(found, keep(compared(texts, near, sim).filter("linked").select("a", "b"), "links"))
    label = found.withColumnRenamed("component", "to")
    labelled = labelled.join(label, "node", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
    pairs = keep(_by_sketch(labelled, sim).join(near, ["a", "b"], "left_anti"), "cross")
    return _with(found, keep(compared(texts, pairs, sim).filter("linked").select("a", "b"), "links"))


def _with(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``found`` and links (a, b) make."""
    if links.isEmpty():
        return found
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return keep(components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionAll(links)), "components")


def _groups(labelled: DataFrame) -> DataFrame:
    """(key, n, total) of the groups with several labels, members and their sizes' sum, of distinct
    rows (key, node, label, size, sketch). Keys of the same nodes are one group."""
    return (labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("n"),
                                        F.bit_xor(F.xxhash64("node", "size", "sketch")).alias("name"), F.sum("size").alias("total"))
            .filter("least < most").groupBy("name", "n").agg(F.min_by(F.struct("key", "total"), "key").alias("one"))
            .select("one.key", "n", "one.total"))


def _tiles(labelled: DataFrame, blocks: str) -> DataFrame:
    """The rows of the groups with several labels, each in a block (own) of so many as ``blocks`` says,
    once for each pair of blocks (x, y) that has its own one."""
    blocks = F.greatest(F.ceil(F.expr(blocks)).cast("int"), F.lit(1))
    rows = (labelled.join(_groups(labelled).select("key", blocks.alias("blocks")), "key")
            .withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    return rows.select(*labelled.columns, "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))


def _in_groups(labelled: DataFrame, texts: DataFrame, sim: SetJoin) -> DataFrame:
    """Links (a, b), a < b, that join the components (label) which links between members of a
    key's group join, from rows (key, node, label, size, sketch)."""
    names = ["key", "x", "y", "own", "node", "label"]
    members = _tiles(labelled, f"total / {BLOCK}").select(*names)
    sent = (texts.join(members.hint("merge"), "node").repartition(tasks(texts.sparkSession), "key", "x", "y")
            .sortWithinPartitions("key", "x", "y"))

    def run(batches):
        tile, got = None, []
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in names]
            links = []
            for p in pieces(batch.column("text")):
                h, d = sim.sets(p)
                cut = np.searchsorted(d, np.arange(p.n + 1))
                for i in range(p.n):
                    key, x, y, side, node, label = (int(c[p.lo + i]) for c in rows)
                    if (key, x, y) != tile:
                        links += _tile(got, sim.percent, tile is not None and tile[1] != tile[2])
                        tile, got = (key, x, y), []
                    got.append((h[cut[i]:cut[i + 1]].copy(), node, label, side))
            yield _links(links)
        yield _links(_tile(got, sim.percent, tile is not None and tile[1] != tile[2]))

    return sent.select(*names, "text").mapInArrow(run, "a long, b long").distinct()


def _by_sketch(labelled: DataFrame, sim: SetJoin, nearest: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of members of a key's group that have different labels and may be linked
    by their sizes and sketches; of each member only the ``nearest`` larger ones, if given."""
    names = ["key", "x", "y", "own", "node", "label", "size", "sketch"]
    sent = (_tiles(labelled, f"n / {MEMBERS}").select(*names).repartition(tasks(labelled.sparkSession), "key", "x", "y")
            .sortWithinPartitions("key", "x", "y", "size"))
    width = 1 << sim.sketch_bits

    def run(batches):
        rest = None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, own]) if rest is not None else own
            tile = np.stack([rows.column(c).to_numpy() for c in names[:3]])
            cut = np.append(0, np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) + 1)
            for lo, hi in zip(cut[:-1], cut[1:]):   # the last one may go on
                yield _links(_possible(rows.slice(lo, hi - lo), sim.percent, width, nearest))
            rest = rows.slice(cut[-1])
        if rest is not None:
            yield _links(_possible(rest, sim.percent, width, nearest))

    return sent.mapInArrow(run, "a long, b long").distinct()


def _possible(rows: pa.Table, percent: int, width: int, nearest: int | None) -> list[tuple[int, int]]:
    """Pairs of the rows of a tile, which ascend by size, as ``_by_sketch`` gives them."""
    if rows.num_rows < 2:
        return []
    x, y, side, node, label, size = (rows.column(c).to_numpy() for c in ("x", "y", "own", "node", "label", "size"))
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, width).astype(np.int16)
    most = np.searchsorted(size, size * 100 // percent, side="right")
    out = []
    for i in np.flatnonzero(size[:-1] > 0):
        at = np.flatnonzero(label[i + 1:most[i]] != label[i]) + i + 1
        if x[0] != y[0]:
            at = at[side[at] != side[i]]
        differ = np.abs(sketch[at] - sketch[i]).sum(axis=1)
        may = differ * (100 + percent) <= (100 - percent) * (size[i] + size[at])
        at, differ = at[may], differ[may]
        if nearest and len(at) > nearest:
            at = at[np.argsort(differ, kind="stable")[:nearest]]
        out += [(int(min(node[i], node[j])), int(max(node[i], node[j]))) for j in at]
    return out


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _tile(members: list[tuple], percent: int, two: bool) -> list[tuple[int, int]]:
    """Links (a, b), a < b, between members (set, node, label, side), enough to join the labels that
    links join. With ``two`` only members of different sides are compared."""
    members = sorted((m for m in members if len(m[0])), key=lambda m: len(m[0]))
    if len(members) < 2:
        return []
    size = np.array([len(m[0]) for m in members])
    node, label, side = (np.array([m[k] for m in members]) for k in (1, 2, 3))
    _, code, count = np.unique(np.concatenate([m[0] for m in members]), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(members)), size)
    common = count[code] > 1    # the others are in no two sets
    code, doc = code[common], doc[common]
    cut = np.searchsorted(doc, np.arange(len(members) + 1))
    most = np.searchsorted(size, size * 100 // percent, side="right")
    mine, out = np.zeros(len(count), bool), []
    for i in range(len(members) - 1):
        other = label[i + 1:most[i]] != label[i]
        if two:
            other &= side[i + 1:most[i]] != side[i]
        if not other.any():
            continue
        last = i + int(np.flatnonzero(other)[-1]) + 2
        mine[code[cut[i]:cut[i + 1]]] = True
        total = np.append(0, np.cumsum(mine[code[cut[i + 1]:cut[last]]]))
        mine[code[cut[i]:cut[i + 1]]] = False
        at = cut[i + 1:last + 1] - cut[i + 1]
        both = total[at[1:]] - total[at[:-1]]
        linked = other[:last - i - 1] & (both > 0) & (100 * both >= percent * (size[i] + size[i + 1:last] - both))
        for j in np.flatnonzero(linked) + i + 1:
            if label[j] != label[i]:
                out.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
                label[label == label[j]] = label[i]
    return out
