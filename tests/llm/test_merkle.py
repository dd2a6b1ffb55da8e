"""The Merkle manifest against a plain tree."""

from __future__ import annotations

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from tallyframe.llm import merkle, queries

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def h(s):
    return sha256(s.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves, fanout=3):
    """The top and, for each leaf, its siblings (before, after) level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, p in enumerate(paths):
            run = at[i] // fanout * fanout
            p.append(("".join(level[run:at[i]]), "".join(level[at[i] + 1:run + fanout])))
            at[i] //= fanout
        level = [h("".join(level[i:i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], paths


def plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars), as a sorted list of result rows."""
    by = defaultdict(list)
    for d, t, la, s, n in rows:
        by[s].append(((d is not None, d or 0), leaf_of((d, s, la, n, t)), (d, t, la, s, n)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: x[:2])
        trees[s] = plain_tree([x[1] for x in by[s]])
    root, above = plain_tree([trees[s][0] for s in order]) if order else (None, [])
    out = []
    for k, s in enumerate(order):
        for (_, leaf, (d, t, la, _, n)), path in zip(by[s], trees[s][1]):
            steps = path + above[k]
            even = d is not None and zlib.crc32(str(d).encode()) % 2 == 0
            x = leaf_of((d, s, la, n, t.replace("\n", "") if even and t is not None else t))
            for before, after in steps:
                x = h(before + x + after)
            out.append((d, leaf, trees[s][0], root, h("".join(b + a for b, a in steps)), x, x == root))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_against_plain_tree(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    out = got(queries.op13_merkle_manifest(spark, SF))
    assert out == plain_manifest(rows)
    assert {r[-1] for r in out} == {True, False}


@pytest.mark.parametrize("n", [1, 4, 82])
def test_group_sizes(spark, n):
    """Runs of one node, groups of one leaf beside deeper ones, several passes."""
    rows = [(i, f"a\nb{i}", "en", "big", 3) for i in range(n)] + [(1000 + i, "x", "en", f"s{i}", 1) for i in range(n % 5)]
    assert got(merkle.documents_manifest(spark.createDataFrame(rows, COLUMNS).repartition(3))) == plain_manifest(rows)


@pytest.mark.parametrize("fanout,height", [(2, 3), (4, 2)])
def test_other_shapes(spark, fanout, height):
    leaves = [(None if i % 2 else "g", i, h(str(i))) for i in range(41)]
    out = merkle.manifest(spark.createDataFrame(leaves, "group string, key long, leaf string"), fanout, height).collect()
    tops = [plain_tree([x[2] for x in leaves if x[0] == g], fanout)[0] for g in (None, "g")]
    root, _ = plain_tree(tops, fanout)
    assert {r.root for r in out} == {root} and len(out) == 41
    for r in out:
        x = r.leaf
        for s in r.steps:
            x = h(s.before + x + s.after)
        assert x == root and r.subroot == tops[r.group == "g"]


def test_nulls_ties_repeats_long_texts_and_names(spark):
    rows = [(None, None, None, None, None), (None, "a\nb", "en", None, 3), (None, "a\nb", "en", None, 3), (1, "", "", "", 0),
            (1, "", "", "", 0), (1, "z", "", "", 0), (2, "é\n" * 200_000, "fr", "é", 5), (3, "\n", "fr", "z", 1), (-7, "q\nq", None, "z", None)]
    df = spark.createDataFrame([(*r, "x", 5, {"k": 1}) for r in rows], COLUMNS + ", leaf string, _at long, steps map<string,int>")
    assert got(merkle.documents_manifest(df.repartition(4))) == plain_manifest(rows)


def test_empty_table(spark):
    assert got(merkle.documents_manifest(spark.createDataFrame([], COLUMNS))) == []
