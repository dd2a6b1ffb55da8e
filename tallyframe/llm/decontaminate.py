"""Benchmark decontamination: a BM25 index of test items, searched with every passage.

The items are indexed once: every posting carries its term's BM25 contribution divided by the
item's self score (the score of its own terms), so one threshold fits all items: a passage
that holds the whole item scores 1. Items are numbered by length and cut into blocks; each
term has its largest contribution in each block (block-max). An item's weakest terms, which
add up to ``SLACK`` at most, cannot lift it over the threshold alone; so only blocks whose
bounds over the other terms reach the threshold less ``SLACK`` have their items scored, from
the heaviest term on: an item whose ``HEAD`` heaviest terms leave it short of the threshold,
even with all others, is dropped there. That is the WAND pivot, taken for many passages at
once: nothing above the threshold is lost, and frequent words cost nothing where no item is
near. Passages, blocks and pairs are taken in runs of some ``CELLS`` steps, so the working
arrays stay small however many items a part has.
Each item found is verified on the text: the share of the item's distinct word ``SHINGLE``-
grams that the passage holds, for the question and for the answer. A text of fewer words has
no such gram: its words, in their order, anywhere in the passage are all of it.

A passage is a whole document and its words are case-folded, with punctuation cut off. The
index is broadcast in parts of at most ``PART_WORDS`` item words; a larger benchmark costs
more passes over the documents, not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.order import running
from tallyframe.llm.store import keep
from tallyframe.llm.text import LOWER, SPACE, U, SpanHash, mix, pieces, shingle_sets, shingles, spans

THRESHOLD = 0.5
OVERLAP = 0.6
SLACK = 0.2
SHINGLE = 5
K1, B = 1.2, 0.75
BLOCK_ITEMS = 8
HEAD = 8
CELLS = 1 << 20
PART_WORDS = 2_000_000

_WORD = ~SPACE
_WORD[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = False


def tokens(p):
    """(hash, document) of the folded words of a piece, in text order."""
    low = LOWER[p.buf]
    start, end, doc = spans(type(p)(p.lo, p.hi, low, p.offs), _WORD[low])
    return SpanHash(low)(start, end), doc


@dataclass
class Index:
    """Block bounds by term; postings and shingles of questions and answers by item."""

    item_ids: np.ndarray
    no_id: np.ndarray
    terms: np.ndarray          # sorted hashes
    first: np.ndarray          # of each item's postings, heaviest first; one more than items
    term: np.ndarray           # posting: term number
    weight: np.ndarray         # posting: contribution over the item's self score
    rest: np.ndarray           # of each item: sum of the weights behind its HEAD first
    bfirst: np.ndarray         # of each term's blocks; one more than terms
    block: np.ndarray
    bmax: np.ndarray
    parts: tuple               # (sorted shingles, first of each item's, their places) for question, answer
    short: tuple               # (words of each item if fewer than a shingle has, else 0; hash of them) for both
    n_blocks: int


def _joined(questions, answers) -> list[str]:
    as_list = (lambda x: x if isinstance(x, list) else x.to_pylist())
    return [(q or "") + "\n" + (a or "") for q, a in zip(as_list(questions), as_list(answers))]


def build(item_ids: np.ndarray, no_id: np.ndarray, questions: list, answers: list, n_items: int, mean_len: float, df: dict) -> Index:
    """The index of one part of the items; ``n_items`` and ``mean_len`` are of all parts."""
    n = len(item_ids)
    both = _joined(questions, answers)
    lengths = np.array([len(t) for t in both])
    order = np.lexsort((item_ids, lengths))  # like lengths share a block
    item_ids, no_id = item_ids[order], no_id[order]

    def hashed(texts):
        h, d = [], []
        for p in pieces(pa.array([texts[i] or "" for i in order], pa.large_string())):
            a, b = tokens(p)
            h.append(a), d.append(b + p.lo)
        return (np.concatenate(h), np.concatenate(d)) if h else (np.zeros(0, U), np.zeros(0, np.int64))

    h, d = hashed(both)
    terms, at = np.unique(h, return_inverse=True)
    key, tf = np.unique(at * n + d, return_counts=True)
    term, item = key // max(n, 1), key % max(n, 1)
    dl = np.bincount(d, minlength=n)
    counts = np.array([df[int(x)] for x in terms.view(np.int64)])
    idf = np.log(1 + (n_items - counts + 0.5) / (counts + 0.5))
    w = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[item] / max(mean_len, 1e-9)))
    w = w / np.maximum(np.bincount(item, weights=w, minlength=n), 1e-12)[item]
    blocks = item // BLOCK_ITEMS
    n_blocks = int(blocks.max()) + 1 if len(blocks) else 0
    # An item's weakest terms, SLACK of its score together, need not be looked at to find it.
    weak = np.lexsort((w, item))
    upto = np.cumsum(w[weak])
    start = np.searchsorted(item[weak], np.arange(n))
    upto -= np.concatenate([[0.0], upto])[start][item[weak]]
    strong = weak[upto > SLACK]
    bkey, bat = np.unique(term[strong] * max(n_blocks, 1) + blocks[strong], return_inverse=True)
    bmax = np.zeros(len(bkey))
    np.maximum.at(bmax, bat, w[strong])
    heavy = np.lexsort((term, -w, item))
    first = np.searchsorted(item[heavy], np.arange(n + 1))
    nth = np.arange(len(heavy)) - first[item[heavy]]
    rest = np.bincount(item[heavy], weights=np.where(nth < HEAD, 0.0, w[heavy]), minlength=n)
    edges = np.arange(len(terms) + 1)
    parts, short = [], []
    for texts in (questions, answers):
        th, td = hashed(texts)
        count = np.bincount(td, minlength=n)
        words, whole = np.where(count < SHINGLE, count, 0), np.zeros(n, U)
        for m in range(1, SHINGLE):
            wh, wd, _ = shingles(th, td, m)
            one = words[wd] == m
            whole[wd[one]] = wh[one]
        short.append((words, whole))
        sh, sd = shingle_sets(th, td, n, SHINGLE)
        distinct, place = np.unique(sh, return_inverse=True)
        parts.append((distinct, np.searchsorted(sd, np.arange(n + 1)), place))
    return Index(item_ids, no_id, terms, first, term[heavy], w[heavy], rest, np.searchsorted(bkey // max(n_blocks, 1), edges),
                 bkey % max(n_blocks, 1), bmax, tuple(parts), tuple(short), n_blocks)


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from ``lo`` to before ``hi`` of each entry, and which entry each is of."""
    size = hi - lo
    of = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size - lo, size), of


def _runs(size: np.ndarray):
    """Slices of neighbours whose sizes add up to ``CELLS`` at most, or of one entry."""
    upto = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + CELLS, side="right")) - 1)
        yield slice(lo, hi)
        lo = hi


def search(index: Index, term: np.ndarray, doc: np.ndarray, n: int, threshold: float):
    """Runs of (doc, item, score), together all pairs with a common term at or above the
    threshold, from distinct (term, doc) in the order of the documents."""
    if len(term) == 0 or index.n_blocks == 0:
        return
    items = np.minimum(np.arange(index.n_blocks + 1) * BLOCK_ITEMS, len(index.item_ids))
    first = np.searchsorted(doc, np.arange(n + 1))
    upto = np.concatenate([[0], np.cumsum(index.bfirst[term + 1] - index.bfirst[term])])
    for docs in _runs(upto[first[1:]] - upto[first[:-1]] + index.n_blocks + len(index.terms) // 8 + 1):
        lo, k = docs.start, docs.stop - docs.start
        t, d = term[first[lo]:first[docs.stop]], doc[first[lo]:first[docs.stop]] - lo
        at, of = _expand(index.bfirst[t], index.bfirst[t + 1])
        bound = np.bincount(d[of] * index.n_blocks + index.block[at], weights=index.bmax[at], minlength=k * index.n_blocks)
        has = np.zeros((k, len(index.terms)), bool)
        has[d, t] = True
        open_ = np.flatnonzero(bound >= threshold - SLACK - 1e-9)
        block = open_ % index.n_blocks
        for some in _runs(index.first[items[block + 1]] - index.first[items[block]]):
            b = block[some]
            item, of = _expand(items[b], items[b + 1])
            d = (open_[some] // index.n_blocks)[of]
            from_, to = index.first[item], index.first[item + 1]
            at, of = _expand(from_, np.minimum(to, from_ + HEAD))
            score = np.bincount(of, weights=index.weight[at] * has[d[of], index.term[at]], minlength=len(item))
            near = score + index.rest[item] >= threshold - 2e-9
            item, d = item[near], d[near]
            at, of = _expand(from_[near], to[near])
            common = has[d[of], index.term[at]]
            at, of = at[common], of[common]
            score = np.bincount(of, weights=index.weight[at], minlength=len(item))
            hit = (score >= threshold - 1e-9) & (np.bincount(of, minlength=len(item)) > 0)
            if hit.any():
                yield d[hit] + lo, item[hit], score[hit]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
            item_id: str = "item_id", question: str = "text", answer: str | None = None,
            threshold: float = THRESHOLD, overlap: float = OVERLAP, short_items: bool = False) -> DataFrame:
    """(doc_id, item_id, score, overlap, answer_overlap) for every document and test item with
    a score and a share of the question's shingles (and of the answer's, if there is an
    answer column with a text) that reach the limits.

    Null and empty texts match nothing; neither do items without a word. An answer of fewer
    words than a shingle is found wherever a document has these words in this order; so is a
    question with ``short_items``, without it only in a document that has no other words. Repeated documents and items match each by themselves,
    null ids included. An empty table on either side gives an empty result."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = [_part(rows, part, threshold, overlap, short_items) for part in parts_of(benchmark, item_id, question, answer)]
    schema = "doc_id long, item_id long, score double, overlap double, answer_overlap double"
    if not out:
        return docs.sparkSession.createDataFrame([], schema)
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD,
          overlap: float = OVERLAP, short_items: bool = False, **columns) -> DataFrame:
    """The rows of ``docs`` without a match, in one pass per index part; no shuffle of texts."""
    for index in parts_of(benchmark, **{"item_id": "item_id", "question": "text", "answer": None, **columns}):
        docs = _without(docs, text, index, threshold, overlap, short_items)
    return docs


def parts_of(benchmark: DataFrame, item_id: str, question: str, answer: str | None) -> Iterator[Index]:
    """Indexes of the items in parts of bounded size, made one at a time. Document frequencies
    and lengths are of all items, whatever the parts."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(question).cast("string").alias("q"),
                             (F.col(answer).cast("string") if answer else F.lit(None).cast("string")).alias("a"))
    size = F.coalesce(F.length("q"), F.lit(0)) + F.coalesce(F.length("a"), F.lit(0)) + 1
    # A word takes two characters at least, so this bounds the words of a part.
    numbered = running(items.withColumn("_size", size.cast("long")),
                       [F.col("item_id").asc_nulls_last(), F.col("q"), F.col("a")], "_size", "_before")
    numbered = keep(numbered.withColumn("part", F.floor(F.col("_before") / (2 * PART_WORDS))), "benchmark")
    schema = T.StructType([T.StructField("term", T.LongType()), T.StructField("words", T.LongType())])

    def count(batches):
        for b in batches:
            both = pa.array(_joined(b.column("q"), b.column("a")), pa.large_string())
            for p in pieces(both):
                h, d = tokens(p)
                seen, at = np.unique(h, return_inverse=True)
                key = np.unique(at * p.n + d)
                df = np.bincount(key // p.n, minlength=len(seen))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(seen, U(0)).view(np.int64)), pa.array(np.append(df, len(h)).astype(np.int64))],
                    ["term", "words"])

    stats = keep(numbered.select("q", "a").mapInArrow(count, schema).groupBy("term").agg(F.sum("words").alias("words")),
                 "terms")  # term 0 holds the number of all words
    n_items = numbered.count()
    total = stats.filter("term = 0").select("words").first()
    for row in numbered.select("part").distinct().orderBy("part").collect():
        part = numbered.filter(F.col("part") == row.part).select("item_id", "q", "a").toArrow()
        own = [tokens(p)[0] for p in pieces(pa.array(_joined(part.column("q"), part.column("a")), pa.large_string()))]
        terms = numbered.sparkSession.createDataFrame(pa.table({"term": np.unique(np.concatenate(own)).view(np.int64)}))
        df = stats.join(terms, "term", "left_semi").toArrow()
        d = dict(zip(df.column("term").to_pylist(), df.column("words").to_pylist()))
        ids = part.column("item_id").to_pylist()
        no_id = np.array([x is None for x in ids], bool)
        yield build(np.array([x or 0 for x in ids], np.int64), no_id, part.column("q").to_pylist(), part.column("a").to_pylist(), n_items,
                    (total.words if total else 0) / max(n_items, 1), d)


def _anywhere(h: np.ndarray, doc: np.ndarray, d: np.ndarray, words: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """For pairs of a document and a sequence of few words (their number and hash): 1.0 where the
    document has them side by side."""
    found = np.zeros(len(d))
    for m in np.unique(words):
        wh, wd, _ = shingles(h, doc, int(m))
        one = np.flatnonzero(words == m)
        found[one] = np.isin(mix(whole[one] ^ mix(d[one].astype(U))), mix(wh ^ mix(wd.astype(U))))
    return found


def _find(index: Index, p, threshold: float, overlap: float, short_items: bool):
    """Verified matches of a piece, in runs: (document, item, score, overlap, answer overlap)."""
    h, doc = tokens(p)
    at = np.minimum(np.searchsorted(index.terms, h), max(len(index.terms) - 1, 0))
    known = index.terms[at] == h if len(index.terms) else np.zeros(len(h), bool)
    key = np.unique(doc[known] * len(index.terms) + at[known])
    for d, item, score in search(index, key % max(len(index.terms), 1), key // max(len(index.terms), 1), p.n, threshold):
        hit = np.zeros(p.n, bool)
        hit[d] = True
        use = hit[doc]
        sh, sd = shingle_sets(h[use], doc[use], p.n, SHINGLE)
        got = []
        for (shingle, first, place), (words, whole), anywhere in zip(index.parts, index.short, (short_items, True)):
            # The item's shingles are looked up among those of the document.
            at = np.minimum(np.searchsorted(shingle, sh), max(len(shingle) - 1, 0))
            known = shingle[at] == sh if len(shingle) else np.zeros(len(sh), bool)
            held = np.append(sd[known] * len(shingle) + at[known], np.iinfo(np.int64).max)
            total = first[item + 1] - first[item]
            found = np.zeros(len(d), np.int64)
            for some in _runs(total):
                a, of = _expand(first[item[some]], first[item[some] + 1])
                want = d[some][of] * len(shingle) + place[a]
                found[some] = np.bincount(of[held[np.searchsorted(held, want)] == want], minlength=some.stop - some.start)
            share = np.where(total > 0, found / np.maximum(total, 1), np.nan)
            few = np.flatnonzero(words[item] > 0) if anywhere else np.zeros(0, np.int64)
            share[few] = _anywhere(h[use], doc[use], d[few], words[item[few]], whole[item[few]])
            got.append(share)
        q, a = got
        good = (np.where(np.isnan(q), 0, q) >= overlap) & (np.isnan(a) | (a >= overlap))
        yield d[good], item[good], score[good], q[good], a[good]


def _part(rows: DataFrame, index: Index, threshold: float, overlap: float, short_items: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for b in batches:
            ids = b.column("doc_id")
            for p in pieces(b.column("text")):
                for d, item, score, q, a in _find(shared.value, p, threshold, overlap, short_items):
                    item_ids, no_id = shared.value.item_ids[item], shared.value.no_id[item]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(d + p.lo)), pa.array(item_ids, mask=no_id), pa.array(score), pa.array(q),
                         pa.array(a, mask=np.isnan(a))], ["doc_id", "item_id", "score", "overlap", "answer_overlap"])

    return rows.mapInArrow(run, "doc_id long, item_id long, score double, overlap double, answer_overlap double")


def _without(docs: DataFrame, text: str, index: Index, threshold: float, overlap: float,
             short_items: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for b in batches:
            stay = np.ones(b.num_rows, bool)
            for p in pieces(b.column(text)):
                for d, *_ in _find(shared.value, p, threshold, overlap, short_items):
                    stay[d + p.lo] = False
            yield b.filter(pa.array(stay))

    return docs.mapInArrow(run, docs.schema)
