"""N-gram Jaccard join by PartEnum signatures.

A text's set is its distinct word shingles. Sets are cut into bands of sizes ``[l, u]`` with
``u = l / threshold``: two sets at or above the threshold lie in the same band or in
neighbouring ones, and differ in at most ``k = (1 - threshold) / threshold * u`` shingles, with
``u`` of the lower band. For each such instance the shingle domain is cut, by hash, into more
than ``k`` partitions. A difference spoils one partition, so similar sets agree on a whole
partition at least, and the hash of a set's part in it is a signature that both have. Small
sets have few partitions, which would be weak; there the domain is cut into ``k + 2`` parts
and every subset of two is a signature (``k`` differences leave two untouched).

Empty partitions would link sets that have nothing in common. There are more partitions than
``k + 1``, so that similar sets agree on several, and a set that has no more empty ones than
the surplus gives no signature for them; only a set with more empty ones gives all. What
surplus is left says how many signatures similar sets share at least, ``c``. So each set may
forget its ``c - 1`` most frequent signatures: the rarest one that two similar sets share is
never among those. That takes out the signatures that common passages make.

Sets that share a signature are verified by their exact sets (64-bit shingle hashes).
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.pairs import linked_components
from tallyframe.llm.text import LOWER, U, SpanHash, mix, pieces, shingle_sets, words

UNNAMED = 1 << 62   # names of rows without an id start here
ENUMERATE = 2   # differences up to which subsets of two partitions are enumerated


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``words`` words; linked at ``percent`` of the union in common."""

    words: int = 5
    percent: int = 80
    sketch_bits: int = 6

    def bands(self, most: int) -> np.ndarray:
        """Lower ends of the bands up to size ``most``, and one more."""
        out = [1]
        while out[-1] <= most:
            out.append(out[-1] * 100 // self.percent + 1)
        return np.array(out + [out[-1] * 100 // self.percent + 1], np.int64)

    def differences(self, upper: np.ndarray) -> np.ndarray:
        return upper * (100 - self.percent) // self.percent

    def partitions(self, k: np.ndarray) -> np.ndarray:
        spare = np.maximum(1, -(-(k + 1) // (10 if self.percent >= 85 else 4)))
        return np.where(k == 0, 1, np.where(k <= ENUMERATE, k + 2, k + 1 + spare))

    def sets(self, p) -> tuple[np.ndarray, np.ndarray]:
        low = type(p)(p.lo, p.hi, LOWER[p.buf], p.offs)
        start, end, doc = words(low)
        return shingle_sets(SpanHash(low.buf)(start, end), doc, p.n, self.words)


def signatures(sim: Similarity, h: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, document, slack) of sets given as sorted (hash, document). ``slack`` is
    twice the number of signatures of this kind that the set may forget, plus one for those of
    the lower band's instance."""
    size = np.bincount(d, minlength=n)
    if len(h) == 0:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int32)
    low = sim.bands(int(size.max()))
    band = np.searchsorted(low, size, side="right") - 1      # -1: an empty set
    upper = low[1:] - 1
    out_s, out_d, out_f = [], [], []
    for back in (0, 1):                                      # the own band's instance, the lower one's
        instance = band - back
        use = instance >= 0
        k = sim.differences(upper[np.maximum(instance, 0)])
        parts = np.where(use, sim.partitions(k), 0)
        first = np.cumsum(parts) - parts
        keep = use[d]
        hh, dd = h[keep], d[keep]
        part = (((mix(hh + U(0x2545F4914F6CDD1D)) >> U(32)) * parts[dd].astype(U)) >> U(32)).astype(np.int64)
        cell = first[dd] + part
        total = int(parts.sum())
        sums = np.zeros(total, U)
        np.add.at(sums, cell, mix(hh ^ U(0x9FB21C651E98DF25)))
        empty = np.bincount(cell, minlength=total) == 0
        doc = np.repeat(np.arange(n), parts)
        nth = np.arange(total) - first[doc]
        sums = mix(sums + mix((instance[doc] << 24 | nth).astype(U)))   # a band has fewer than 2 ** 24 partitions
        small = (k[doc] > 0) & (k[doc] <= ENUMERATE)
        spare = parts - k - 1 - np.bincount(doc[empty], minlength=n)     # below 0: empty ones are given too
        give = ~small & (~empty | (spare[doc] < 0))
        out_s.append(sums[give])
        out_d.append(doc[give])
        out_f.append(np.maximum(spare, 0)[doc[give]] * 2 + back)
        for kk in range(1, ENUMERATE + 1):
            docs = np.flatnonzero(use & (k == kk))
            for i, j in combinations(range(kk + 2), 2):
                out_s.append(mix(sums[first[docs] + i] * U(3) + sums[first[docs] + j] + U(kk)))
                out_d.append(docs)
                out_f.append(np.full(len(docs), back))
    return np.concatenate(out_s), np.concatenate(out_d), np.concatenate(out_f).astype(np.int32)


def signature_rows(texts: DataFrame, sim: Similarity) -> DataFrame:
    """(key, node, slack) of (node, text). Within a batch, texts of equal sets give the signatures of
    the first of them only, and one key of their own that links them to it."""
    def run(batches):
        for b in batches:
            node = b.column("node").to_numpy()
            seen: dict = {}
            for p in pieces(b.column("text")):
                h, d = sim.sets(p)
                size = np.bincount(d, minlength=p.n)
                one, two = np.zeros(p.n, U), np.zeros(p.n, U)
                np.add.at(one, d, mix(h))
                np.add.at(two, d, mix(h ^ U(0xD1B54A32D192ED03)))
                first = np.zeros(p.n, bool)
                keys, nodes = [], []
                for i in np.flatnonzero(size):
                    mine = (int(size[i]), int(one[i]), int(two[i]))
                    to = seen.setdefault(mine, int(node[p.lo + i]))
                    first[i] = to == node[p.lo + i]
                    if not first[i]:
                        key = mix(np.array([mine[1] ^ (mine[2] >> 1) ^ (to & (1 << 64) - 1)], U))[0].view(np.int64)
                        keys += [key, key]
                        nodes += [to, int(node[p.lo + i])]
                use = first[d]
                s, doc, slack = signatures(sim, h[use], d[use], p.n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([s.view(np.int64), np.array(keys, np.int64)])),
                     pa.array(np.concatenate([node[p.lo + doc], np.array(nodes, np.int64)])),
                     pa.array(np.concatenate([slack, np.zeros(len(nodes), np.int32)]))], ["key", "node", "slack"])

    return texts.mapInArrow(run, "key long, node long, slack int")


def classes(docs: DataFrame, sim: Similarity, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, component) of the documents that are linked with others: the least id that links
    reach. Texts without words and rows without ``id_col`` are linked with nothing; rows with the
    same one are one node."""
    texts = (docs.select(F.col(id_col).cast("long").alias("node"), F.col(text).cast("string").alias("text"))
             .filter("node is not null and text is not null"))
    return linked_components(signature_rows(texts, sim), texts, sim)


def join(docs: DataFrame, sim: Similarity) -> DataFrame:
    """One row per document of (doc_id, text): doc_id, n_shingles (null and wordless texts: 0)
    and component_id (the least id that links reach, its own if it is linked with nothing). A row
    without an id takes part under a name made of its text, beyond all ids (which are below
    2 ** 62): it can link two others, and gets their component_id; null if it reaches no id. Rows
    with the same id are one node. Long texts are one set like others. An empty table gives an
    empty result."""
    unnamed = F.lit(UNNAMED) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .withColumn("node", F.coalesce("doc_id", unnamed)))
    found = classes(rows, sim, id_col="node").withColumnRenamed("node", "of")

    def count(batches):
        for b in batches:
            for p in pieces(b.column("text")):
                size = np.bincount(sim.sets(p)[1], minlength=p.n).astype(np.int64)
                mine = b.slice(p.lo, p.n)
                yield pa.RecordBatch.from_arrays([mine.column("doc_id"), mine.column("node"), pa.array(size)],
                                                 ["doc_id", "node", "n_shingles"])

    sizes = rows.mapInArrow(count, "doc_id long, node long, n_shingles long")
    named = F.when((F.col("component") < UNNAMED) | F.col("doc_id").isNotNull(), F.col("component"))
    return (sizes.join(found, F.col("node") == F.col("of"), "left")
            .select("doc_id", "n_shingles", F.coalesce(named, "doc_id").alias("component_id")))
