"""Joins and deduplication against brute force, with nulls, empties, repeats and ties."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tallyframe.llm import jaccard_join, line_dedup, queries, suffix_dedup

DOCS = "doc_id long, text string, shard int, key string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS).repartition(parts)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def words_of(text):
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode()) if w]


def shingle_set(text, k):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    w = [x.translate(lower) for x in words_of(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute_join(rows, k, percent):
    """Rows of one id are one node, a row without an id is a node of its own."""
    nodes = [(0, d) if d is not None else (1, i) for i, (d, _) in enumerate(rows)]
    sets = [shingle_set(t, k) for _, t in rows]
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in zip(nodes, sets):
        for b, y in zip(nodes, sets):
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    least = [find(n) for n in nodes]
    return sorted(((d, len(x), n[1] if n[0] == 0 else None) for (d, _), x, n in zip(rows, sets, least)), key=str)


@pytest.mark.parametrize("k,percent,seed", [(3, 90, 1), (5, 80, 2)])
def test_jaccard_join_equals_brute_force(spark, k, percent, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeABé") for _ in range(rng.randint(1, 4))) for _ in range(200)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 8, 15, 30, 60, 150, 400]))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < .3:
                base = w
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    rows += [(900, None), (901, ""), (902, " \n"), (None, rows[0][1]), (rows[5][0], rows[9][1]),
             (903, rows[0][1].upper())]
    got = jaccard_join.join(frame(spark, rows), jaccard_join.Similarity(k, percent))
    assert sorted_rows(got) == brute_join(rows, k, percent)


def test_jaccard_join_of_a_passage_group(spark):
    """Many texts share a passage that makes no two of them similar; copies still join."""
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, passage + " " + " ".join(f"w{rng.randrange(9000)}" for _ in range(50))) for i in range(120)]
    rows += [(500 + i, rows[i % 7][1] + " tail") for i in range(60)]
    got = jaccard_join.join(frame(spark, rows), jaccard_join.Similarity(5, 80))
    assert sorted_rows(got) == brute_join(rows, 5, 80)


def test_jaccard_join_takes_the_most_similar_row_of_a_pivot(spark):
    """Two rows share the pivot's id: one equals the other text, one only holds it."""
    small = " ".join(f"s{i}" for i in range(52))
    rows = [(1, small + " " + " ".join(f"b{i}" for i in range(900))), (1, small), (2, small)]
    got = jaccard_join.join(frame(spark, rows), jaccard_join.Similarity(3, 90))
    assert sorted_rows(got) == brute_join(rows, 3, 90) == sorted([(1, 950, 1), (1, 50, 1), (2, 50, 1)], key=str)


def test_jaccard_join_by_way_of_rows_without_ids(spark):
    """1 and 2 are linked through a row without an id only; two more such rows reach no id."""
    w = [f"w{i}" for i in range(102)]
    near = lambda n, tail: " ".join(w[:102 - n] + [f"{tail}{i}" for i in range(n)])
    rows = [(1, near(4, "a")), (None, " ".join(w)), (2, " ".join(["z"] * 4 + w[4:])), (None, "x y z u v"),
            (None, "x y z u v"), (None, None), (None, ""), (3, None)]
    got = sorted_rows(jaccard_join.join(frame(spark, rows), jaccard_join.Similarity(3, 90)))
    assert got == brute_join(rows, 3, 90)
    assert [r[2] for r in got if r[1] > 50] == [1, 1, 1]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert jaccard_join.join(empty, jaccard_join.Similarity()).collect() == []
    assert suffix_dedup.suffix_dedup(empty).collect() == []
    assert line_dedup.line_dedup(empty).collect() == []


def brute_suffix(rows, window):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = collections.Counter(b[i:i + window] for _, b in texts for i in range(len(b) - window + 1))
    out = []
    for d, b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if seen[b[i:i + window]] > 1:
                gone[i:i + window] = [True] * window
        left = bytes(x for x, y in zip(b, gone) if not y)
        n_spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), n_spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("spread", [False, True])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, spread):
    if spread:  # every group is too large for one task
        monkeypatch.setattr(suffix_dedup, "GROUP", 3)
        monkeypatch.setattr(suffix_dedup, "CHUNK", 200)
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(50)]

    def para(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    shared = [para(rng.choice([30, 60, 90])) for _ in range(12)]
    rows = [(i, " ".join(rng.choice([para(20), rng.choice(shared), rng.choice(shared)[rng.randint(0, 60):]])
                         for _ in range(rng.randint(1, 5)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "aaaa" * 200), (103, "ab" * 300), (7, rows[7][1]), (None, rows[3][1]),
             (None, None), (104, "x" * 199)]
    assert sorted_rows(suffix_dedup.suffix_dedup(frame(spark, rows))) == brute_suffix(rows, 200)


def test_suffix_dedup_text(spark):
    rows = [(1, "é" * 150 + "tail one"), (2, "é" * 150 + "other")]
    kept = {r.doc_id: r.kept for r in suffix_dedup.suffix_dedup(frame(spark, rows), with_text=True).collect()}
    assert kept == {1: "tail one", 2: "other"}


def line_set(line):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in line.encode())
    return frozenset(b[i:i + 8] for i in range(len(b) - 7)) or frozenset([b])


def brute_lines(rows):
    every = [(d is None, d or 0, no, line, i) for i, (d, t) in enumerate(rows)
             for no, line in enumerate((t or "").split("\n")) if line.strip(" \t\n\r\x0b\x0c")]
    texts = sorted({x[3] for x in every})
    sets, parent = [line_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                parent[find(i)] = find(j)
    label = {t: find(i) for i, t in enumerate(texts)}
    winners, stay = {}, set()
    for none, d, no, line, i in sorted(every):
        if winners.setdefault(label[line], (none, d, no)) == (none, d, no):
            stay.add((i, no))
    out = []
    for i, (d, t) in enumerate(rows):
        parts = (t or "").split("\n")
        has = [bool(x.strip(" \t\n\r\x0b\x0c")) for x in parts]
        left = [x for no, x in enumerate(parts) if not has[no] or (i, no) in stay]
        out.append((d, sum(has), len(parts) - len(left), None if t is None else "\n".join(left)))
    return sorted(out, key=str)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 12, 40]))) for _ in range(60)]

    def near(line):  # an edit that leaves the similarity well above or well below the limit
        return line + rng.choice(["", "", "!", " " + " ".join(rng.choice(vocabulary) for _ in range(40))])

    rows = [(i, "\n".join(near(rng.choice(base)) if rng.random() < .8 else "  " for _ in range(rng.randint(1, 6))))
            for i in range(80)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "x"), (None, rows[0][1])]
    df = frame(spark, rows)
    want = brute_lines(rows)
    assert sorted_rows(line_dedup.line_dedup(df, with_text=True)) == want
    assert sorted_rows(line_dedup.line_dedup(df)) == [r[:3] for r in want]


def test_op10_gives_the_texts_that_are_left(spark, tmp_path):
    rows = [(1, "one long line of words\n\nanother line here"), (2, "one long line of words\nthird"), (3, None), (4, ""),
            (None, "third\n \nfourth")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_removed", "kept")
    assert sorted_rows(got) == brute_lines(rows)
    assert {r.doc_id: r.kept for r in got.collect()} == {
        1: "one long line of words\n\nanother line here", 2: "third", 3: None, 4: "", None: " \nfourth"}


def test_line_texts_are_made_one_for_candidates_only(spark, monkeypatch):
    """No aggregate over the texts of all lines; a line of many batches is one text all the same."""
    from tallyframe.llm import pairs
    line, kept, keep = "a line that many documents have word for word", [], pairs.keep
    rows = [(i, f"{line}{'!' * (i % 2)}\nown {i} {hashlib.sha256(str(i).encode()).hexdigest()}") for i in range(40)]

    def seen(df, name):
        out = keep(df, name)
        if name == "texts":
            kept.extend(r.text for r in out.collect())
        return out

    monkeypatch.setattr(pairs, "keep", seen)
    df = frame(spark, rows).repartition(8)
    assert "Aggregate" not in line_dedup.line_texts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted_rows(line_dedup.line_dedup(df, with_text=True)) == brute_lines(rows)
    assert sorted(kept) == [line, line + "!"]
    odd = [(1, "\u00a0\n\x1f\n \t\x0b\x0c\r\n\u2003x"), (2, "\x85\n\x1c \n")]
    assert sorted_rows(line_dedup.line_dedup(frame(spark, odd), with_text=True)) == brute_lines(odd)


def pair_links(texts, sim):
    """Components by brute force of (node, text)."""
    sets, parent = {n: shingle_set(t, sim.words) for n, t in texts}, {n: n for n, _ in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= sim.percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    groups = {}
    for n in parent:
        groups.setdefault(find(n), []).append(n)
    return {n: least for least, members in groups.items() if len(members) > 1 for n in members}


@pytest.mark.parametrize("block,bits", [(1 << 18, 0), (1500, 0), (1500, 6)])
def test_a_group_near_the_limit_is_compared_without_its_pairs(spark, monkeypatch, block, bits):
    """Members of one key that are not quite similar: the links that its pivot does not show are
    found, also between blocks, and of short texts no table of about their square is written."""
    from tallyframe.llm import pairs
    monkeypatch.setattr(pairs, "BLOCK", block)
    monkeypatch.setattr(pairs, "MEMBERS", block // 25)
    common = " ".join(f"c{i}" for i in range(31))
    texts = [(n, f"{common} " + " ".join(f"o{n}x{i}" for i in range(4))) for n in range(200)]
    texts += [(1000 + n, t.replace(f"o{n}x0", f"p{n}")) for n, t in texts[50:60]]
    rows, keep = [], pairs.keep

    def seen(df, name):
        out = keep(df, name)
        rows.append((out.count(), name))
        return out

    monkeypatch.setattr(pairs, "keep", seen)
    df = spark.createDataFrame(texts, "node long, text string")
    keyed = df.selectExpr("1L as key", "node", "0 as slack").unionAll(df.selectExpr("2L as key", "node", "0 as slack"))
    sim = jaccard_join.Similarity(words=1, percent=80, sketch_bits=bits)
    found = pairs.linked_components(keyed, df, sim).collect()
    assert {r.node: r.component for r in found} == pair_links(texts, sim)
    assert len(found) == 20
    assert bits or max(rows)[0] <= 2 * len(texts), max(rows)


def test_line_dedup_moves_no_row_a_band_key(spark):
    """Keys move packed: of lines that share nothing no key becomes a row."""
    rows = [(i, "\n".join(hashlib.sha256(f"{i} {j}".encode()).hexdigest() for j in range(20))) for i in range(50)]
    rows += [(100, rows[0][1].replace("\n", "!\n")), (None, "x"), (7, None)]
    df = frame(spark, rows)
    scanned = line_dedup.scan(df.selectExpr("doc_id", "text", "xxhash64(doc_id, text) as rid")).collect()
    keys = [r for r in scanned if r.kind == line_dedup.KEYS]
    nodes = {r.y for r in keys} | {r.z for r in keys}
    assert 0 < len(nodes) <= 40
    assert [r.y for r in scanned if r.kind == line_dedup.GONE] == [19]
    places = [x for r in scanned if r.kind == line_dedup.PLACES for x in np.frombuffer(r.packed, line_dedup.PLACE)]
    assert len(places) == 50 * 20 + 19 + 1   # the last line of document 100 is that of document 0
    assert sorted_rows(line_dedup.line_dedup(df, with_text=True)) == brute_lines(rows)


def test_line_dedup_of_repeated_rows(spark):
    """Rows that repeat id and text lose the same lines, also those of one batch."""
    rows = [(1, "first line of all\nsecond line here"), (2, "second line here\nown line of two\nown line of two"), (None, "third\nthird")]
    df = frame(spark, rows + rows)
    want = [(1, 2, 0, "first line of all\nsecond line here"), (2, 3, 2, "own line of two"), (None, 2, 1, "third")]
    for n in (1, 3):
        got = line_dedup.line_dedup(df.repartition(n), with_text=True)
        assert sorted_rows(got) == sorted(want + want, key=str)
