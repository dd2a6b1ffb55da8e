"""Sharding, mixing and the pipeline against plain versions."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyframe.llm import jaccard_join, mixing, queries, sharding

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_is_a_bijection(n):
    got = sharding.permute(np.arange(n), n, 7)
    assert sorted(got.tolist()) == list(range(n))
    if n >= 1000:
        assert got.tolist() != list(range(n)) and abs(np.corrcoef(np.arange(n), got)[0, 1]) < 0.1
        assert got.tolist() != sharding.permute(np.arange(n), n, 8).tolist()


def test_sharding_query(spark):
    rows = queries.op8_sharding(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    by = defaultdict(list)
    order = sorted(docs)
    place = dict(zip(order, sharding.permute(np.arange(len(docs)), len(docs), queries.SEED)))
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        assert (r.shard, r.slot) == (place[r.doc_id] % 24, place[r.doc_id] // 24)
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = queries.op8_sharding(spark, SF).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)


def test_sharding_edges(spark):
    rows = [(None, "a"), (None, "a"), (1, None), (1, "x"), (1, "x")]
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, shard int, slot int").repartition(2)
    got = sharding.shard(df, [F.col("doc_id").asc_nulls_last(), F.col("text")], 2).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    assert sharding.shard(df.limit(0), [F.col("doc_id")], 2).collect() == []


def plain_targets(sizes):
    """The excess over twice a source's size goes to the others by weight, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        room = sum(weight[s] for s in order if s not in full)
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / room for s in order}
        above = {s for s in order if target[s] > 2 * sizes[s]}
        if not above:
            return target
        full |= above


def check_mix(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    want = plain_targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        epochs = int(r.target // r.source_size) if r.source_size else 0
        assert r.copies in (epochs, epochs + 1)
        taken[r.source] += r.taken
    for s, t in taken.items():
        largest = max(r.size for r in rows if r.source == s)
        assert abs(t - want[s]) <= largest / 2 + 1


def test_mixing_query(spark):
    rows = queries.op9_mixing(spark, SF).collect()
    check_mix(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op9_mixing(spark, SF).collect()))


def test_mixing_edges(spark):
    data = [(i, "w " * (i % 7 + 1), "ab"[i % 2]) for i in range(60)]
    data += [(100, None, "c"), (101, "", "c"), (102, "x y", None), (None, "z", None), (102, "x y", None), (103, "long " * 30_000, "é")]
    df = spark.createDataFrame([(*r, 1.0) for r in data], "doc_id long, text string, source string, quality double")
    rows = mixing.mix(mixing.measure(df)).collect()
    assert len(rows) == len(data)
    check_mix(rows)
    assert mixing.mix(mixing.measure(df.limit(0))).collect() == []


def test_better_documents_are_taken_more_often(spark):
    df = spark.createDataFrame([(i, ("good words here " if i % 2 else "## ** $$ ") * 5, "s") for i in range(600)],
                               "doc_id long, text string, source string")
    rows = mixing.mix(mixing.measure(df), share=0.5).collect()
    n = Counter(r.doc_id % 2 for r in rows if r.copies)
    assert n[1] > 2 * n[0]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    base = rows[0][1] + " " + rows[1][1]
    rows += [(9001, None, "en", "s", 0), (9002, "", None, None, 0), (9003, base, "en", None, 1),
             (9004, base + " more", None, "s", 1), rows[5], (None, rows[7][1], "en", "src1", 1)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


def test_pipeline_stages(spark, docs):
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF).cache()
        before, after = Counter(map(tuple, kept.collect())), Counter(tuple(r)[:5] for r in out.collect())
        assert out.columns[:5] == docs.columns and set(after) <= set(before)
        if name == "near_duplicates":
            left = jaccard_join.join(out, jaccard_join.Similarity(5, 80)).collect()
            assert all(r.component_id == r.doc_id for r in left)
        if name == "source_mixing":
            assert max(after[k] / before[k] for k in after) <= 2
        if name == "sharding":
            assert after == before
        kept = out
    assert {"shard", "slot"} <= set(kept.columns)


def test_near_duplicates_keeps_one_row_of_each_group(spark):
    """Repeated rows, null ids and ids shared by different texts."""
    base = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"}
    rows = [(1, base["a"])] * 3 + [(2, base["a"])]                      # repeated rows and another id
    rows += [(None, base["b"])] * 3 + [(None, base["b"] + " tail")]     # no id at all
    rows += [(None, base["c"]), (7, base["c"] + " tail")]               # the row with an id stays
    rows += [(5, base["d"]), (6, base["d"] + " tail"), (6, base["e"])]  # 6 is an id of a clean text too
    rows += [(8, base["f"])] + [(9, None)] * 2 + [(None, " ")]
    df = spark.createDataFrame([(d, t, "en", "web", 0) for d, t in rows], COLUMNS).repartition(3)
    out = corpus_pipeline.near_duplicates(spark, df, SF)
    assert out.columns == df.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    groups = Counter(t[0] if t and t.strip() else t for _, t in left)
    assert groups == {"a": 1, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1, None: 2, " ": 1}
    assert {(1, base["a"]), (7, base["c"] + " tail"), (5, base["d"]), (6, base["e"]), (8, base["f"])} <= set(left)


def test_pipeline_stages_keep_columns_of_any_name_and_type(spark, docs):
    """Names that the stages use themselves, and a map, come through unchanged."""
    names = ["low", "high", "byte_low", "_lang", "_h", "_t", "_nth", "_q_bits", "_q__of_low", "row", "node", "hash", "nth", "id",
             "other", "copies", "draw", "size", "quality", "_one", "_row", "_part", "target"]
    odd = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)], F.create_map(F.lit("k"), F.col("doc_id")).alias("m"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        plain, out = stage(spark, kept, SF), stage(spark, odd, SF)
        want = Counter(r.doc_id for r in plain.collect())
        rows = out.collect()
        assert [c for c in out.columns if c not in ("shard", "slot")] == odd.columns
        assert Counter(r.doc_id for r in rows) == want or name == "sharding" or name == "source_mixing"
        assert all(tuple(r[n] for n in names) == tuple(range(len(names))) and r["m"] == {"k": r.doc_id} for r in rows if r.doc_id is not None)
        assert len(rows) > 0


def test_pipeline_stages_on_an_empty_table(spark):
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
