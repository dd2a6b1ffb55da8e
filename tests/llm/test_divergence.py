"""The divergence audit against SQL, a plain recount and planted collisions."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.llm import divergence

COLUMNS = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top=50):
    docs = [(t or "", la or "", s or "") for t, la, s in rows]
    seen, own = defaultdict(Counter), defaultdict(Counter)
    for t, la, s in docs:
        words = TERM.findall(t.translate(LOWER))
        seen[la].update(set(words))
        own[la, s].update(words)
    out = []
    for la in {d[1] for d in docs}:
        kept = [w for w, n in seen[la].items() if n >= least]
        groups = sorted({d[2] for d in docs if d[1] == la})

        def share(count):
            total = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 5) // (total + 5 * len(kept)) for w in kept}

        p = {s: share(own[la, s]) for s in groups}
        q = share(sum((own[la, s] for s in groups), Counter()))
        for s in groups:
            far = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in groups if o != s]
            up = [(p[s][w] - q[w], w) for w in kept if own[la, s][w] and p[s][w] > q[w]]
            for part, items, most in (("pair", far, None), ("term", up, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(la, s, part, item, value, i + 1) for i, (value, item) in enumerate(items[:most])]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


def made(seed=1, docs=300):
    rng = np.random.default_rng(seed)
    words = [f"W{a}{b}é" if a in "aeiou" else f"{a}{b}" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"]
    rows = []
    for i in range(docs):
        lang, source = ["en", "de", None, ""][i % 7 % 4], f"s{min(i % 9, 5)}"
        some = rng.choice(words, rng.integers(0, 60), p=np.arange(len(words), 0, -1) / (len(words) * (len(words) + 1) / 2))
        rows.append((" 3".join(some), lang, source))
    return rows + [(None, "en", "empty"), ("", "xx", None), ("12 [] ~", "xx", "z"), ("Same same", None, "s1"), ("Same same", None, "s1")]


@pytest.fixture
def frame(spark):
    def make(rows):
        return spark.createDataFrame([(i, *r, 4, "x") for i, r in enumerate(rows)], COLUMNS + ", slot int, _one string").repartition(3)
    return make


def test_against_plain(frame):
    rows = made()
    assert got(divergence.audit(frame(rows), least=4)) == plain(rows, 4)


def test_small_shards_rounds_blocks_and_tiles(frame, monkeypatch):
    """The bounds on memory change the path, not the result."""
    for name, value in dict(SHARD=8, ROUND_BYTES=2000, CELLS=30, DISTINCT=20, BLOCK=16, TILE=2).items():
        monkeypatch.setattr(divergence, name, value)
    rows = made(2)
    assert got(divergence.audit(frame(rows), least=4, top=3)) == plain(rows, 4, top=3)


def test_nothing_kept_and_empty_table(frame, spark):
    rows = [("a b", "en", "s"), ("c", "en", "t"), (None, None, None)]
    assert got(divergence.audit(frame(rows))) == plain(rows, 30) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
    assert got(divergence.audit(spark.createDataFrame([], COLUMNS))) == []


def test_long_text(frame):
    rows = [("Long wörd " * 200_000 + "x" * 300_000, "en", "a")] * 2 + [("long other", "en", "b")] * 3
    assert got(divergence.audit(frame(rows), least=2)) == plain(rows, 2)


@pytest.mark.parametrize("n", [1, 2, 5, 600])
def test_perfect_hash_is_minimal(n):
    keys = pa.array([f"k{i}".encode() for i in range(n)])
    seeds, at = divergence.perfect_hash(keys)
    assert sorted(at.tolist()) == list(range(n)) and len(seeds) == -(-n // divergence.BUCKET)


def test_unknown_terms_are_refused_by_their_bytes():
    class Row:
        lang, shard, shards, first = "en", 0, 1, 7

    keys = pa.array([f"k{i}".encode() for i in range(100)])
    seeds, at = divergence.perfect_hash(keys)
    Row.seeds, Row.terms, Row.n = seeds.tolist(), keys.take(pa.array(at)).to_pylist(), 100
    look = divergence.Lookup([Row])
    words = pa.array([f"k{i}".encode() for i in range(5000)], pa.large_binary())
    slots = look.slots("en", words)
    assert sorted(slots[:100].tolist()) == list(range(7, 107)) and (slots[100:] == -1).all()
    assert (look.slots("de", words) == -1).all() and look.width("en") == (7, 107)
