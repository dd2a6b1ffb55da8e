"""A modified Kneser-Ney model of word pairs, counted over all texts, and what it says of each.

A word is hashed with its language into one of ``2 ** CELL`` cells, a pair is the code of two
cells (the first word of a text follows a start mark of its language). What a model needs for
each word (how often it is followed, by how many words, how many come before it) is thus
bounded and broadcast. The pairs are not bounded, they grow with the corpus: they are never in
one place. Tasks send them as sorted arrays of codes, each pair once a task, and Spark deals
them over ranges of codes; the task of a range holds one sorted array of the counts.

Counting deals pairs by their first word, so a word's followers meet in one task, each pair at
most once from each task before. Scoring deals them by a mixed code, with the documents that
have them: a word that is everywhere is spread over all ranges. What comes back is a sum for
each document, not a row for each pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.store import keep, tasks
from tallyframe.llm.text import U, SpanHash, mix, pieces, words

CELL = 21
CODE = 2 * CELL
MASK = (1 << CELL) - 1
STEP = 1 << 19      # bytes of texts whose working arrays a task holds at a time
WORDS = 1_200_000   # words that a task gathers before it sends their pairs
DOCS = 1 << 16      # documents that it gathers
FINE = 4            # ranges of the scoring for each task: they are dealt more evenly
DEAL = 64           # tasks of the scoring by range at most: each gives a sum for each document
UNIT = 4096         # parts of a bit that are added up, as whole numbers: in any order the sum is the same
HELD = 32_000_000   # sums that such a task holds
_ODD = 0x9E3779B97F5 | 1
_BACK = pow(_ODD, -1, 1 << CODE)
_ALL = U((1 << CODE) - 1)


def _mixed(code: np.ndarray) -> np.ndarray:
    """A code for a code, one to one, that spreads the pairs of a word."""
    x = (code ^ (code >> U(CELL))) * U(_ODD) & _ALL
    return x ^ (x >> U(CELL))


def _unmixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(CELL))) * U(_BACK) & _ALL
    return x ^ (x >> U(CELL))


def _squeezed(x: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of unsigned numbers, byte by byte of all, compressed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width])
    return pa.compress(planes.reshape(-1), codec="zstd", asbytes=True)


def _spelled(data: bytes, n: int, width: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd"), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def _pack(x: np.ndarray) -> bytes:
    """Ascending codes."""
    return _squeezed(np.diff(x, prepend=U(0)), 6)


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_spelled(data, n, 6), dtype=U)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, lengths) of the runs of equal values."""
    first = np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))
    return first, np.diff(first, append=len(x))


def _summed(codes: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first, _ = _runs(code)
    return code[first], np.add.reduceat(n, first) if len(first) else n


def _edges(n: int, bits: int) -> np.ndarray:
    """Lower ends of ``n`` ranges of numbers of ``bits`` bits, and one more."""
    return np.array([(i << bits) // n for i in range(n + 1)], U)


def _seed(lang: str) -> np.uint64:
    return U(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


def pairs(p, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code, document) of every word of a piece with the one before it."""
    start, end, doc = words(p)
    if not len(start):
        return np.zeros(0, U), np.zeros(0, np.int64)
    seeds = {lang: _seed(lang) for lang in set(langs)}
    seed = np.array([seeds[lang] for lang in langs], U)
    shift = U(64 - CELL)
    cell = mix(SpanHash(p.buf)(start, end) ^ seed[doc]) >> shift
    before = np.empty(len(cell), U)
    before[1:] = cell[:-1]
    first, _ = _runs(doc)
    before[first] = mix(seed[doc[first]]) >> shift
    return before << U(CELL) | cell, doc


def _gathered(batches, columns: list[str]):
    """For each language of about ``WORDS`` words of a task's texts: (language, codes, numbers of
    documents, their values of ``columns``)."""
    held: dict = {}

    def given():
        for lang, (codes, docs, values) in held.items():
            yield lang, np.concatenate(codes), np.concatenate(docs), [np.concatenate(v) for v in zip(*values)]

    size = rows = 0
    for b in batches:
        langs = b.column("lang").to_pylist()
        own = [b.column(c).to_numpy() for c in columns]
        for p in pieces(b.column("text"), STEP):
            for lo in range(p.lo, p.hi, DOCS):
                hi = min(p.hi, lo + DOCS)
                cut = type(p)(lo, hi, p.buf[p.offs[lo - p.lo]:p.offs[hi - p.lo]], p.offs[lo - p.lo:hi - p.lo + 1] - p.offs[lo - p.lo])
                if rows and (size >= WORDS or rows + cut.n > DOCS):
                    yield from given()
                    held, size, rows = {}, 0, 0
                code, doc = pairs(cut, langs[lo:hi])
                names, which = np.unique(np.array(langs[lo:hi], object).astype(str), return_inverse=True)
                for i, lang in enumerate(names):
                    mine = np.flatnonzero(which == i)
                    place = np.zeros(cut.n, np.int64)
                    codes, docs, values = held.setdefault(str(lang), ([], [], []))
                    place[mine] = np.arange(len(mine)) + sum(len(v[0]) for v in values)
                    here = which[doc] == i
                    codes.append(code[here])
                    docs.append(place[doc[here]])
                    values.append([mine, *[c[lo:hi][mine] for c in own]])
                size, rows = size + len(code), rows + cut.n
    yield from given()


def _counted(rows: DataFrame, ranges: int) -> DataFrame:
    """(range, lang, n, codes, counts): the pairs of (lang, text), once for what a task gathers,
    cut by ranges of the first word."""
    edges = _edges(ranges, CELL) << U(CELL)

    def run(batches):
        for lang, code, _, _ in _gathered(batches, []):
            code = np.sort(code)
            first, n = _runs(code)
            code = code[first]
            at = np.searchsorted(code, edges)
            some = np.flatnonzero(np.diff(at))
            if len(some):
                parts = [slice(at[r], at[r + 1]) for r in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array([lang] * len(some)), pa.array([s.stop - s.start for s in parts], pa.int32()),
                     pa.array([_pack(code[s]) for s in parts]), pa.array([_squeezed(n[s], 4) for s in parts])],
                    ["range", "lang", "n", "codes", "counts"])

    return rows.select("lang", "text").mapInArrow(run, "range int, lang string, n int, codes binary, counts binary")


def _grouped(batches, keys: tuple):
    """The rows of each key in turn, of rows sorted by the keys."""
    key, rows = None, []
    for b in batches:
        for row in b.to_pylist():
            mine = tuple(row[k] for k in keys)
            if rows and mine != key:
                yield key, rows
                rows = []
            key = mine
            rows.append(row)
    if rows:
        yield key, rows


STATS = "kind int, range int, lang string, n int, codes binary, counts binary"
FOLLOWED, BEFORE, MET = 0, 1, 2   # of a word: its followers' counts; how many words come before it; counts of counts


def _word_stats(counted: DataFrame, ranges: int) -> DataFrame:
    """What is known of words when the pairs of a first word have met (``kind``): five numbers
    a first word; how many first words of the range a second word has; how many pairs were
    met once, twice, three and four times."""
    edges = _edges(ranges, CELL)

    def run(batches):
        for (of, lang), rows in _grouped(batches, ("range", "lang")):
            code, n = _summed([_unpack(r["codes"], r["n"]) for r in rows], [_spelled(r["counts"], r["n"], 4) for r in rows])
            first, size = _runs(code >> U(CELL))
            figures = [np.add.reduceat(x.astype(U), first) for x in (n, n == 1, n == 2, n > 2)]
            out = [(FOLLOWED, of, lang, len(first), _pack(code[first] >> U(CELL)), _squeezed(np.concatenate(figures), 6)),
                   (MET, of, lang, 4, b"", _squeezed(np.array([(n == k).sum() for k in (1, 2, 3, 4)], U), 6))]
            second = np.sort(code & U(MASK))
            at, size = _runs(second)
            second = second[at]
            cut = np.searchsorted(second, edges)
            out += [(BEFORE, int(r), lang, int(cut[r + 1] - cut[r]), _pack(second[cut[r]:cut[r + 1]]), _squeezed(size[cut[r]:cut[r + 1]], 4))
                    for r in np.flatnonzero(np.diff(cut))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), _TYPES)], _NAMES)

    return (counted.repartition(ranges, "range").sortWithinPartitions("range", "lang")).mapInArrow(run, STATS)


_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
_NAMES = ["kind", "range", "lang", "n", "codes", "counts"]


def _met(stats: DataFrame, ranges: int) -> DataFrame:
    """``stats`` with the rows of kind ``BEFORE`` added up: one a range and language."""
    def run(batches):
        for (kind, r, lang), rows in _grouped(batches, ("kind", "range", "lang")):
            if kind == BEFORE:
                code, n = _summed([_unpack(x["codes"], x["n"]) for x in rows], [_spelled(x["counts"], x["n"], 4) for x in rows])
                rows = [dict(zip(_NAMES, (BEFORE, r, lang, len(code), _pack(code), _squeezed(n, 6))))]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], t) for c, t in zip(_NAMES, _TYPES)], _NAMES)

    return stats.repartition(ranges, "kind", "range").sortWithinPartitions("kind", "range", "lang").mapInArrow(run, STATS)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from how many counts are
    1, 2, 3 and 4. Where a corpus lacks one of them, 0.5 (never all of a count)."""
    if not (n1 and n2 and n3 and n4):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, np.array([0, 0.05, 0.05, 0.05]), np.array([0, 0.95, 1.9, 2.85]))


def fit(docs: DataFrame) -> dict:
    """The model of the words of (lang, text): by cell how often a word is followed (``total``),
    the weight that it gives to the lower order (``back``) and how many different words come
    before it (``before``); by language its discounts, number of different pairs and the
    lower order's discounts, weight and number of words. The cells bound all of it; their figures are
    packed (``opened``)."""
    ranges = tasks(docs.sparkSession)
    stats = keep(_met(_word_stats(_counted(docs, ranges), ranges), ranges), "words")
    total, back, before = (np.zeros(1 << CELL, np.float32) for _ in range(3))
    met: dict = {}
    for r in stats.filter(F.col("kind") == MET).toLocalIterator():
        met[r.lang] = met.get(r.lang, 0) + _spelled(bytes(r.counts), 4, 6)
    langs = {lang: {"pair": discounts(*(int(x) for x in n)), "seen": []} for lang, n in met.items()}
    for r in stats.filter(F.col("kind") == FOLLOWED).toLocalIterator():
        cell = _unpack(bytes(r.codes), r.n).astype(np.int64)
        c, *n = _spelled(bytes(r.counts), 4 * r.n, 6).reshape(4, r.n)
        total[cell] += c
        back[cell] += sum(x * d for x, d in zip(n, langs[r.lang]["pair"][1:]))
    back /= np.maximum(total, 1)
    for r in stats.filter(F.col("kind") == BEFORE).toLocalIterator():
        n = _spelled(bytes(r.counts), r.n, 6)
        before[_unpack(bytes(r.codes), r.n).astype(np.int64)] += n
        langs[r.lang]["seen"].append(np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6).astype(np.int64))
        langs[r.lang]["pairs"] = langs[r.lang].get("pairs", 0) + int(n.sum())
    for own in langs.values():
        seen = sum(own.pop("seen"))
        own["word"] = discounts(*(int(x) for x in seen[1:5]))
        own["words"] = int(seen.sum())
        own["rest"] = float((own["word"][[1, 2, 3, 3, 3]] * seen[1:]).sum()) / own["pairs"]
    return {"total": _shut(total), "back": _shut(back), "before": _shut(before), "langs": langs}


def _shut(x: np.ndarray) -> bytes:
    """An array of 32-bit figures by cell, for the broadcast."""
    return _squeezed(x.view(np.uint32), 4)


def opened(model: dict) -> dict:
    return model | {k: _spelled(model[k], 1 << CELL, 4).astype(np.uint32).view(np.float32) for k in ("total", "back", "before")}


def costs(model: dict, lang: str, code: np.ndarray, n: np.ndarray, own_n: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """-log2 of the probability of each pair's second word after its first, and of the lower order's, which
    does not know the first; ``n``: the pair's count, ``own_n``: how many of these are left out."""
    own = model["langs"][lang]
    first, second = (code >> U(CELL)).astype(np.int64), (code & U(MASK)).astype(np.int64)
    met = model["before"][second].astype(np.float64)
    lower = (met - own["word"][np.minimum(met, 3).astype(np.int64)]) / own["pairs"] + own["rest"] / own["words"]
    n = n.astype(np.int64) - own_n
    seen = (n - own["pair"][np.minimum(n, 3)]) / np.maximum(model["total"][first] - own_n, 1)
    return -np.log2(np.minimum(seen + model["back"][first] * lower, 1)), -np.log2(lower)


def _sent(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, lang, batch, n, met, size, codes, counts, docs, one, two): what a task gathers of a language is
    a batch. Its pairs, cut by ranges of mixed codes, with the documents that have them; and once
    (a range below 0) the documents' names."""
    edges = _edges(ranges, CODE)
    names = ["range", "lang", "batch", "n", "met", "size", "codes", "counts", "docs", "one", "two"]
    types = [pa.int32(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5]

    def run(batches):
        for lang, code, doc, (_, one, two) in _gathered(batches, ["one", "two"]):
            if not len(code):
                continue
            # A batch is named by its documents in their order.
            h = hashlib.blake2b(one.tobytes() + two.tobytes() + lang.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            both = np.sort(_mixed(code) << U(16) | doc.astype(U))
            code = both >> U(16)
            first, n = _runs(code)
            doc = both & U(DOCS - 1)
            at = np.searchsorted(code[first], edges)
            place = np.append(first, len(code))
            out = [(-1 - h[0], lang, h, len(one), 0, 0, None, None, None, one.tobytes(), two.tobytes())]
            for r in np.flatnonzero(np.diff(at)):
                s = slice(at[r], at[r + 1])
                d = doc[place[at[r]]:place[at[r + 1]]]
                out.append((int(r), lang, h, len(one), int(s.stop - s.start), len(d), _pack(code[first[s]]),
                            _squeezed(n[s], 4), _squeezed(d, 2), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)

    return docs.select("lang", "text", "one", "two").mapInArrow(
        run, "range int, lang string, batch binary, n int, met int, size int, codes binary, counts binary, docs binary, "
             "one binary, two binary")


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(one, two, pair, single): the bits that the model needs for all words of the texts named
    (one, two), each after the one before it, and by itself; ``docs``: (lang, text, one, two). A
    text's own pairs are left out of their counts, else a pair that only it has would pass for one
    that its language knows. Rows that share a name have one text."""
    ranges = tasks(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def summed(batches):
        held: dict = {}
        size, known = 0, None
        for key, rows in _grouped(batches, ("range", "lang")):
            if key[0] < 0:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.binary()) for c in ("batch", "one", "two")]
                                                 + [pa.nulls(len(rows), pa.binary())], names)
                continue
            known = known or opened(shared.value)
            codes = [_unpack(r["codes"], r["met"]) for r in rows]
            counts = [_spelled(r["counts"], r["met"], 4) for r in rows]
            code, n = _summed(codes, counts)
            plain = _unmixed(code)
            for r, c, k in zip(rows, codes, counts):
                at = np.repeat(np.searchsorted(code, c), k.astype(np.int64))
                doc = _spelled(r["docs"], r["size"], 2).astype(np.int64)
                first, own = _runs(at << 16 | doc)
                at, doc = at[first], doc[first]
                sums = np.stack([np.bincount(doc, np.rint(cost * UNIT) * own, minlength=r["n"]).astype(np.int64)
                                 for cost in costs(known, key[1], plain[at], n[at], own)])
                if r["batch"] in held:
                    held[r["batch"]] += sums
                else:
                    held[r["batch"]] = sums
                    size += r["n"]
            if size > HELD:
                yield from given(held)
                held, size = {}, 0
        yield from given(held)

    def given(held):
        for batch, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (batch, None, None, _squeezed(sums.reshape(-1), 6))], names)

    def named(batches):
        for _, rows in _grouped(batches, ("batch",)):
            copies = [r for r in rows if r["one"] is not None]  # batches of the same texts in one order are one
            one, two = (np.frombuffer(copies[0][c], np.int64) for c in ("one", "two"))
            sums = sum(_spelled(r["sums"], 2 * len(one), 6) for r in rows if r["sums"] is not None) / (UNIT * len(copies))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one, two, *sums.reshape(2, -1))], ["one", "two", "pair", "single"])

    names = ["batch", "one", "two", "sums"]
    met = (_sent(docs, FINE * ranges).repartition(min(ranges, DEAL), "range").sortWithinPartitions("range", "lang")
           .mapInArrow(summed, "batch binary, one binary, two binary, sums binary"))
    return (met.repartition(ranges, "batch").sortWithinPartitions("batch")
            .mapInArrow(named, "one long, two long, pair double, single double")
            .groupBy("one", "two").agg(F.avg("pair").alias("pair"), F.avg("single").alias("single")))
