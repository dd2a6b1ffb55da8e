"""Packing: ids against the tokenizer's own file, places against the rules, counts against
lower bounds, plain best fit and exhaustive search."""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import packing, queries

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a\nb", "<|endoftext|> x", " 　 tabs\t\t\tend  ", "don't I'LL we've", "é​\U0001f600" * 50, "12.5e9!!??" * 9]


@pytest.fixture(scope="module")
def plain_ids():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts, plain_ids, capacity=2048):
    """rows: one per piece; texts: one per document, in any order of equal ids."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 1 <= r.length <= capacity and 0 <= r.ids_crc32 < 1 << 32
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for doc, text in texts:
        ids = np.array(plain_ids(text), "<u4")
        start, stop, piece = 0, (len(ids) - 1) % capacity + 1, 0
        while start < len(ids):
            want[doc].append((piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
            start, stop, piece = stop, stop + capacity, piece + 1
    assert {d: sorted(p) for d, p in pieces.items()} == {d: sorted(p) for d, p in want.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def plain_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else capacity) - n)
    return len(room)


def uses_of(count, found):
    got = np.zeros(len(count), np.int64)
    for one, times in found:
        assert times > 0 and sum(length * n for length, n in one) < len(count)
        for length, n in one:
            got[length] += n * times
    assert (got == count).all()
    return sum(times for _, times in found)


def test_query(spark, plain_ids):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op12_best_fit_packing(spark, SF).collect()
    n = check(rows, docs, plain_ids)
    lengths = [r.length for r in rows]
    assert n <= plain_best_fit(lengths, 2048) and n <= -(-sum(lengths) // 2048) + 2
    again = queries.op12_best_fit_packing(spark, SF).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_odd_texts_repeats_and_names(spark, plain_ids):
    docs = [(i % 5 if i else None, t) for i, t in enumerate(ODD + ODD)] + [(7, "word " * 60_000)]
    df = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, length int, sequence_id string").repartition(3)
    check(packing.packed_documents(df).collect(), docs, plain_ids)
    check(packing.packed_documents(df, capacity=3).collect(), docs, plain_ids, capacity=3)


def test_sequences_hold_the_ids(spark, plain_ids):
    docs = [(i, "some text " * i) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = packing.sequences(packing.packed_documents(df, capacity=32, with_ids=True)).collect()
    assert all(len(r.ids) <= 32 for r in rows)
    assert sorted(i for r in rows for i in r.ids) == sorted(i for _, t in docs for i in plain_ids(t))


def test_empty_table_and_bad_lengths(spark):
    assert packing.packed_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    bad = spark.createDataFrame([(1, 9)], "doc_id long, length long")
    with pytest.raises(ValueError):
        packing.pack(bad, [F.col("doc_id")], capacity=8)


def test_few_sequences_at_every_size():
    """Near the lower bound, and the work does not grow with the counts."""
    rng = np.random.default_rng(5)
    count = np.bincount(np.minimum(rng.geometric(1 / 120, 6000), 511), minlength=513)
    for times in (1, 40, 10**7):
        found = packing.solve(count * times, 512)
        n = uses_of(count * times, found)
        least = -(-int((count * times * np.arange(513)).sum()) // 512)
        assert n <= max(least + 3, least * 1.001) and len(found) <= packing.ROUNDS * packing.PER_ROUND + 2 * 512


def test_lengths_that_do_not_fill(spark):
    """Where sizes alone would mislead: halves and a bit, thirds, and one length only."""
    for lengths, capacity, want in (([51] * 40, 100, 40), ([34] * 60, 100, 30), ([60] * 30 + [40] * 30, 100, 30),
                                    ([50] * 7, 100, 4), ([100] * 3 + [1] * 250, 100, 6)):
        count = np.bincount(lengths, minlength=capacity + 1)
        assert uses_of(count, packing.solve(count, capacity)) == want


def test_against_exhaustive_search():
    capacity = 12

    @lru_cache(None)
    def least(items):
        if not items:
            return 0
        best = len(items)
        rest = items[1:]
        for mask in range(1 << len(rest)):   # what shares the longest one's sequence
            inside = [rest[i] for i in range(len(rest)) if mask >> i & 1]
            if items[0] + sum(inside) <= capacity:
                best = min(best, 1 + least(tuple(rest[i] for i in range(len(rest)) if not mask >> i & 1)))
        return best

    rng = np.random.default_rng(3)
    for _ in range(12):
        items = tuple(sorted(rng.integers(1, 13, 8).tolist(), reverse=True))
        count = np.bincount(items, minlength=capacity + 1)
        got = uses_of(count, packing.solve(count, capacity))
        assert least(items) <= got <= least(items) + 1
