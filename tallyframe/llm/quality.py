"""Quality rules with n-gram perplexity bands.

Every text gets counts (words, symbols, repeated lines and passages) and its perplexity by a
modified Kneser-Ney model of the word pairs of its language (``word_model``), which is counted
over all texts and grows with them. ``pair_bits`` is the mean cost of a word after the one before
it, a text's own pairs left out of the counts. ``order_bits`` is how many bits less that is than the cost
of the words by themselves: in a text whose words are in order, the word before tells something
of the next one; in shuffled words it misleads.

Marks and broken words need a closer look, so two more figures are over bytes. ``bits`` is the mean
cost of a byte by a Kneser-Ney model over byte classes (64 of them, ``CLASSES``), of which ``ORDER``
make a gram. One language's model has ``64 ** ORDER`` grams at most, whatever the corpus: that
bounds what is broadcast. Each task counts its grams, Spark adds the counts. The grams of
a language are kept as sorted arrays of gram codes with one log-probability each, and tasks
look a gram up by its rank among those of its context (``Costs``). Languages are scored in blocks of at most
``BLOCK`` grams, so many languages cost more passes, not more memory.
What is rare in good texts costs more there, what a mark
repeats costs less. So ``byte_bits`` is the mean cost of a word's bytes each by
itself, every byte value with a code of its own. The ``TRIM`` most costly of a document's words
are left out of it: a number, an address or a quoted name does not make a text junk.

The limits come from exact counts over all documents of a language that pass the base rules.
``bits`` and ``byte_bits`` have bands about their medians, in robust deviations (``LOW``, ``HIGH``,
``BYTES``). ``pair_bits`` may lie ``PAIRS`` distances to the upper quartile above its median; there is no
lower limit, as copies cost little. ``order_bits`` must not be below 0, or, where that is lower (a
language of few texts knows few pairs), ``ORDERS`` distances to the lower quartile below its median.
Null languages are a language of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import word_model
from tallyframe.llm.store import fresh, keep
from tallyframe.llm.text import SPACE, SpanHash, U, per_doc, pieces, shingles, spans, sums_between, words

STEP = 1 << 19       # bytes of texts whose working arrays a task holds at a time
ORDER = 4
BITS = 6
BLOCK = 24_000_000
BIN = 0.002
LEAST = 0.01         # bits: a deviation counts as this at least, for languages of a few equal texts
LOW = 6.0            # below the median, in robust deviations
HIGH = 10.0          # above it: texts with foreign words or names are still good texts
BYTES = 5.0          # on either side of the median of byte_bits
TRIM = 0.1
PAIRS = 6.0          # above the median of pair_bits, in distances from it to the upper quartile
ORDERS = 2.5         # below the median of order_bits, in distances from it to the lower quartile


def _classes() -> np.ndarray:
    c = np.full(256, 40, np.uint32)               # other punctuation
    c[[9, 11, 12, 13, 32]] = 1
    c[10] = 2
    c[97:123] = np.arange(3, 29)                  # a-z
    c[65:91] = 29                                 # A-Z
    c[48:58] = 30
    for chars, k in ((b".", 31), (b",", 32), (b"'\"-", 33), (b"!?", 34), (b";:", 35), (b"()[]{}", 36),
                     (b"|", 37), (b"<>", 38), (b"#*$%&", 39)):
        c[list(chars)] = k
    c[[*range(0, 9), *range(14, 32), 127]] = 41
    c[0xC2], c[0xC3] = 42, 43
    c[0xC4:0xCA], c[0xCA:0xE0], c[0xE0:0xF0], c[0xF0:] = 44, 45, 46, 47
    c[0x80:0xC0] = 48 + (np.arange(0x80, 0xC0) & 15)
    c[0xC0:0xC2] = 44
    return c


CLASSES = _classes()


def _key(lang: str):
    """A language's name with a mark before it, so that null has a name too."""
    return F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit(""))


def grams(p, order: int = ORDER) -> np.ndarray:
    """The gram that ends at each byte; before a document stand start symbols (class 0)."""
    c = CLASSES[p.buf]
    code = c.copy()
    n = len(c)
    since = np.arange(n) - np.repeat(p.offs[:-1], np.diff(p.offs))
    for back in range(1, min(order, n + 1)):
        part = np.zeros(n, np.uint32)
        part[back:] = c[:n - back]
        part[since < back] = 0
        code |= part << np.uint32(BITS * back)
    return code


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all texts; each task adds up its own before the shuffle."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.IntegerType()),
                           T.StructField("n", T.LongType())])

    def added(parts):
        code = np.concatenate([c for c, _ in parts])
        n = np.concatenate([k for _, k in parts])
        code, at = np.unique(code, return_inverse=True)
        return code, np.bincount(at, weights=n).astype(np.int64)

    def rows(held):
        for lang, parts in held.items():
            code, n = added(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int32)), pa.array(n)], ["lang", "gram", "n"])

    def run(batches):
        held: dict = {}
        size = 0
        for b in batches:
            for p in pieces(b.column("text"), STEP):
                code = grams(p, order)
                langs, which = np.unique(np.array(b.column("lang").slice(p.lo, p.n).to_pylist(), object).astype(str), return_inverse=True)
                which = np.repeat(which, np.diff(p.offs))
                for i, lang in enumerate(map(str, langs)):
                    got = np.unique(code[which == i], return_counts=True)
                    size += len(got[0])
                    held.setdefault(lang, []).append(got)
                if size > 2_000_000:
                    held = {k: [added(v)] for k, v in held.items()}
                    size = sum(len(v[0][0]) for v in held.values())
                    if size > 1_000_000:
                        yield from rows(held)
                        held, size = {}, 0
        yield from rows(held)

    return (docs.select(_key("lang").alias("lang"), "text").mapInArrow(run, schema)
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def byte_counts(docs: DataFrame) -> DataFrame:
    """(lang, byte, n) over all texts; a task gives 256 rows for a language and batch at most."""
    def run(batches):
        for b in batches:
            langs = np.array(b.column("lang").to_pylist(), object)
            held: dict = {}
            for p in pieces(b.column("text"), STEP):
                own = langs[p.lo:p.hi]
                for lang in set(own):
                    got = np.bincount(p.buf[np.repeat(own == lang, np.diff(p.offs))], minlength=256)
                    held[lang] = held.get(lang, 0) + got
            for lang, n in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * 256, pa.string()), pa.array(np.arange(256, dtype=np.int32)),
                                                  pa.array(n.astype(np.int64))], ["lang", "byte", "n"])

    return (docs.select(_key("lang").alias("lang"), "text").mapInArrow(run, "lang string, byte int, n long")
            .groupBy("lang", "byte").agg(F.sum("n").alias("n")))


def byte_costs(n: np.ndarray) -> np.ndarray:
    """-log2 probability of each byte value, from the counts of all 256; none is impossible."""
    return -np.log2((n + 1) / (n.sum() + 256))


def word_bits(p, cost: np.ndarray) -> np.ndarray:
    """The mean of ``cost`` (one a byte) over the words of each document, without the ``TRIM``
    costliest of them; not a number for a document without words."""
    start, end, doc = words(p)
    upto = np.zeros(len(cost) + 1)
    np.cumsum(cost, out=upto[1:])
    total, size = upto[end] - upto[start], end - start
    n = np.bincount(doc, minlength=p.n)
    order = np.lexsort((-np.round(total / np.maximum(size, 1), 6), doc))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order)) - (np.cumsum(n) - n)[doc[order]]
    stay = rank >= np.floor(TRIM * n)[doc]
    sizes = np.bincount(doc[stay], size[stay], minlength=p.n)
    return np.where(sizes > 0, np.bincount(doc[stay], total[stay], minlength=p.n) / np.maximum(sizes, 1), np.nan)


def _discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more. Where a corpus lacks
    the counts they are made from, 0.5 (never all of a count)."""
    return word_model.discounts(*(int((n == k).sum()) for k in (1, 2, 3, 4)))


def kneser_ney(code: np.ndarray, n: np.ndarray, order: int = ORDER) -> list[tuple]:
    """From sorted grams and counts, for each order 1..``order``: (sorted grams, their
    probabilities, sorted contexts, the weight each context gives to the next lower order).
    The highest order counts occurrences, lower orders count distinct left neighbours."""
    levels = [(code.astype(np.int64), n.astype(np.int64))]
    for m in range(order - 1, 0, -1):
        levels.append(np.unique(levels[-1][0] & ((1 << BITS * m) - 1), return_counts=True))
    levels.reverse()
    out, below = [], None
    for m, (g, c) in enumerate(levels, 1):
        d = _discounts(c)
        context, at = np.unique(g >> BITS, return_inverse=True)
        total = np.bincount(at, weights=c)
        cut = d[np.minimum(c, 3)]
        back = np.bincount(at, weights=cut) / total
        if m == 1:
            lower = np.full(len(g), 1.0 / (1 << BITS))
        else:
            lower = below[1][np.searchsorted(below[0], g & ((1 << BITS * (m - 1)) - 1))]
        p = (c - cut) / total[at] + back[at] * lower
        out.append((g, p, context, back))
        below = (g, p)
    return out


class Costs:
    """-log2 probability of any gram code, from the sorted arrays of a model: an unseen gram
    costs the weights of its contexts times the longest seen suffix.

    The grams of the highest order stay in their sorted array. For each context a word of bits
    says which symbols follow it; the number of bits below a symbol's, past the context's first
    gram, is the gram's place. So a model takes a few MB, not a table of all possible grams."""

    def __init__(self, model, order: int = ORDER):
        cost = np.full(1 << BITS, 1.0 / (1 << BITS))
        for m, (g, p, context, back) in enumerate(model[:-1], 1):
            if m > 1:
                weight = np.ones(1 << BITS * (m - 1), np.float32)
                weight[context] = back
                cost = _spread(cost, weight, m)
            else:
                cost = cost * back[0]
            cost = cost.astype(np.float32)
            cost[g] = p
        g, p, context, back = model[-1]
        n = 1 << BITS * (order - 1)
        self.lower = cost
        self.weight = np.ones(n, np.float32)
        self.weight[context] = back
        self.own = -np.log2(p.astype(np.float32))
        self.first = np.searchsorted(g >> BITS, np.arange(n)).astype(np.int32)
        self.follow = np.zeros(n, U)
        np.bitwise_or.at(self.follow, g >> BITS, U(1) << (g & ((1 << BITS) - 1)).astype(U))

    def __call__(self, code: np.ndarray) -> np.ndarray:
        context, symbol = code >> BITS, (code & ((1 << BITS) - 1)).astype(U)
        follow = self.follow[context]
        place = self.first[context] + np.bitwise_count(follow & ((U(1) << symbol) - U(1)))
        out = self.own[np.minimum(place, len(self.own) - 1)]
        miss = np.flatnonzero((follow >> symbol & U(1)) == 0)
        out[miss] = -np.log2(self.weight[context[miss]] * self.lower[code[miss] & (len(self.lower) - 1)])
        return out


def _spread(lower: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """Cost of each order-``m`` gram by backing off: its context's weight times its suffix."""
    if m == 2:
        return (weight[:, None] * lower[None, :]).reshape(-1)
    first = 1 << BITS
    rest = 1 << BITS * (m - 2)
    # gram = first symbol, middle, last; context = first + middle; suffix = middle + last
    return (weight.reshape(first, rest, 1) * lower.reshape(1, rest, first)).reshape(-1)


REMEMBER = 16   # languages whose costs a task holds, of a few MB each

METRICS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()),
           ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()),
           ("bits", T.DoubleType()), ("byte_bits", T.DoubleType())]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


def _repeats(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (doc, hash): does it occur twice or more; is it equal to an earlier one."""
    order = np.lexsort((h, doc))  # stable: equal ones stay in text order
    a, d = h[order], doc[order]
    same = np.zeros(len(a) + 1, bool)
    same[1:-1] = (a[1:] == a[:-1]) & (d[1:] == d[:-1])
    twice, later = np.empty(len(a), bool), np.empty(len(a), bool)
    twice[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return twice, later


def base_counts(p) -> dict[str, np.ndarray]:
    """The counts of ``METRICS`` up to ``base_failed``, by document of a piece."""
    space = SPACE[p.buf]
    start, end, doc = words(p)
    out = {"n_words": per_doc(doc, p.n).astype(np.int64),
           "word_chars": sums_between(~space & ~_CONTINUES[p.buf], p.offs),
           "n_symbols": sums_between(_SYMBOL[p.buf], p.offs)}
    hashed = SpanHash(p.buf)
    ls, le, ld = spans(p, p.buf != 10)
    solid = np.zeros(len(p.buf) + 1, np.int64)
    np.cumsum(~space, out=solid[1:])
    has = solid[le] > solid[ls]
    ls, le, ld = ls[has], le[has], ld[has]
    out["n_dup_lines"] = per_doc(ld[_repeats(hashed(ls, le), ld)[1]], p.n).astype(np.int64)
    h, d, at = shingles(hashed(start, end), doc, 5)
    first = at[_repeats(h, d)[0]]
    covered = np.zeros(len(start) + 1, np.int64)
    np.add.at(covered, first, 1)
    np.add.at(covered, np.minimum(first + 5, len(start)), -1)
    out["n_repeat_words"] = per_doc(doc[np.cumsum(covered[:-1]) > 0], p.n).astype(np.int64)
    out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    return out


def annotate(docs: DataFrame, models: dict, prefix: str = "", lang: str = "lang", text: str = "text") -> DataFrame:
    """``docs`` without the text, plus the columns of ``METRICS`` (named with ``prefix``), for the rows whose
    language is in ``models`` (language -> arrays of ``kneser_ney`` and ``byte_costs``). ``bits``
    is the mean cost of a byte, to six places; null for an empty text. ``byte_bits`` is that of
    ``word_bits``; null for a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    made = [prefix + name for name, _ in METRICS]
    docs = docs.drop(*made)
    schema = T.StructType([f for f in docs.schema.fields if f.name != text] + [T.StructField(prefix + n, t) for n, t in METRICS])
    stay = [c for c in docs.columns if c != text]
    names = stay + made

    def run(batches):
        costs: dict = {}
        for b in batches:
            langs_all = ["" if x is None else "=" + x for x in b.column(lang).to_pylist()]
            for p in pieces(b.column(text), STEP):
                out = base_counts(p)
                code = grams(p)
                total = np.zeros(p.n)
                langs = np.array(langs_all[p.lo:p.hi], object)
                sizes = np.diff(p.offs)
                for one in set(langs):
                    if one not in costs:
                        if len(costs) >= REMEMBER:
                            costs.pop(next(iter(costs)))
                        costs[one] = Costs(shared.value[one][0])
                    own = langs == one
                    acc = np.zeros(len(code) + 1)
                    mine = np.flatnonzero(np.repeat(own, sizes))
                    acc[mine + 1] = costs[one](code[mine])
                    np.cumsum(acc, out=acc)
                    total[own] = (acc[p.offs[1:]] - acc[p.offs[:-1]])[own]
                bits = pa.array(np.round(total / np.maximum(sizes, 1), 6), mask=sizes == 0)
                here, which = np.unique(langs.astype(str), return_inverse=True)
                single = np.stack([shared.value[str(one)][1] for one in here])[np.repeat(which, sizes), p.buf]
                each = np.round(word_bits(p, single), 6)
                cut = b.slice(p.lo, p.n)
                yield pa.RecordBatch.from_arrays(
                    [cut.column(c) for c in stay] + [pa.array(out[n]) for n, _ in METRICS[:-2]]
                    + [bits, pa.array(each, mask=np.isnan(each))], names)

    return docs.filter(_key(lang).isin(*models)).mapInArrow(run, schema)


def fit(docs: DataFrame) -> list[dict]:
    """The models of all languages of ``docs`` (columns lang, text), in blocks of at most
    ``BLOCK`` grams (one language at least)."""
    counts = keep(gram_counts(docs), "grams")
    sizes = counts.groupBy("lang").count().orderBy("lang").collect()  # one row a language
    singles: dict = {}
    for lang, byte, n in byte_counts(docs).collect():  # 256 rows a language
        singles.setdefault(lang, np.zeros(256, np.int64))[byte] = n
    blocks: list[list[str]] = []
    room = 0
    for lang, size in sizes:
        if not blocks or size > room:
            blocks.append([])
            room = BLOCK
        blocks[-1].append(lang)
        room -= size
    out = []
    for block in blocks:
        models = {}
        for lang in block:
            # At most 64 ** ORDER rows.
            got = counts.filter(F.col("lang") == lang).select("gram", "n").toArrow()
            code, n = got.column("gram").to_numpy(), got.column("n").to_numpy()
            order = np.argsort(code)
            models[lang] = kneser_ney(code[order], n[order]), byte_costs(singles[lang])
        out.append(models)
    return out


def bands(scored: DataFrame, prefix: str = "") -> DataFrame:
    """(lang, low, high, byte_low, byte_high, pair_high, order_low) from the figures of all documents that
    pass the base rules."""
    good = scored.filter(~F.col(prefix + "base_failed") & F.col(prefix + "bits").isNotNull())

    def spread(a: str, b: str):
        return F.greatest(F.lit(LEAST), BIN * (F.col(b) - F.col(a)))

    pair = _quartiles(good, prefix + "pair_bits").select("_lang", (BIN * F.col("q2") + PAIRS * spread("q2", "q3")).alias("pair_high"))
    order = _quartiles(good, prefix + "order_bits").select(
        "_lang", F.least(F.lit(0.0), BIN * F.col("q2") - ORDERS * spread("q1", "q2")).alias("order_low"))
    return (_band(good, prefix + "bits", LOW, HIGH, "low", "high")
            .join(_band(good, prefix + "byte_bits", BYTES, BYTES, "byte_low", "byte_high"), "_lang")
            .join(pair, "_lang").join(order, "_lang"))


def _bins(good: DataFrame, figure: str) -> DataFrame:
    return good.groupBy(_key("lang").alias("_lang"), F.round(F.col(figure) / BIN).cast("long").alias("bin")).count()


def _quartiles(good: DataFrame, figure: str) -> DataFrame:
    """(lang, q1, q2, q3): the bins of the quartiles of one figure, by exact counts."""
    counted = (_bins(good, figure).withColumn("_upto", F.sum("count").over(W.partitionBy("_lang").orderBy("bin")))
               .withColumn("_all", F.sum("count").over(W.partitionBy("_lang"))))
    return counted.groupBy("_lang").agg(*[F.min(F.when(F.col("_upto") * 4 >= F.col("_all") * i, F.col("bin"))).alias(f"q{i}")
                                          for i in (1, 2, 3)])


def _band(good: DataFrame, figure: str, below: float, above: float, low: str, high: str) -> DataFrame:
    """(lang, low, high) of one figure, each counted in a bin of ``BIN`` bits: median and
    median absolute deviation by exact counts."""
    bins = _bins(good, figure)

    def median(df: DataFrame, value: str) -> DataFrame:
        w = W.partitionBy("_lang").orderBy(value)
        return (df.withColumn("_upto", F.sum("count").over(w))
                .withColumn("_all", F.sum("count").over(W.partitionBy("_lang")))
                .filter(F.col("_upto") * 2 >= F.col("_all")).groupBy("_lang").agg(F.min(value).alias("m")))

    mid = median(bins, "bin").withColumnRenamed("m", "mid")
    away = (bins.join(mid, "_lang").withColumn("away", F.abs(F.col("bin") - F.col("mid")))
            .groupBy("_lang", "mid", "away").agg(F.sum("count").alias("count")))
    dev = median(away, "away").withColumnRenamed("m", "dev")
    unit = F.greatest(F.lit(LEAST), F.lit(1.4826 * BIN) * F.col("dev"))
    return mid.join(dev, "_lang").select("_lang", (F.col("mid") * BIN - below * unit).alias(low),
                                         (F.col("mid") * BIN + above * unit).alias(high))


def judge(scored: DataFrame, limits: DataFrame, prefix: str = "") -> DataFrame:
    """``scored`` plus ``<prefix>kept``: base rules passed and all figures inside their bands.
    No other column of ``scored`` may be called like a limit with the prefix and ``_of_``."""
    own = {c: f"{prefix}_of_{c}" for c in limits.columns}
    limits = limits.withColumnsRenamed(own)
    inside = (F.col(prefix + "bits").between(F.col(own["low"]), F.col(own["high"]))
              & F.col(prefix + "byte_bits").between(F.col(own["byte_low"]), F.col(own["byte_high"]))
              & (F.col(prefix + "pair_bits") <= F.col(own["pair_high"])) & (F.col(prefix + "order_bits") >= F.col(own["order_low"])))
    return (scored.join(limits, _key("lang") == F.col(own["_lang"]), "left")
            .withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & F.coalesce(inside, F.lit(False)))
            .drop(*own.values()))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _scored(docs: DataFrame) -> DataFrame:
    """(lang, text) and further columns of ``docs``, its name (one, two) by language and text: without the text, with
    the columns of ``METRICS``, ``pair_bits``, the mean bits a word of the model of word pairs, and
    ``order_bits``, how many less these are than without the word before; to four places, null
    for a text without words."""
    blocks = fit(docs) or [{"": (kneser_ney(np.zeros(1, np.int64), np.ones(1, np.int64)), byte_costs(np.zeros(256, np.int64)))}]
    scored = keep(union([annotate(docs, m) for m in blocks]), "quality")
    slim = docs.select(_key("lang").alias("lang"), "text", "one", "two")
    found = keep(word_model.score(slim, word_model.fit(slim)), "pairs")
    found = found.select(F.col("one").alias("_one"), F.col("two").alias("_two"), "pair", "single")
    on = (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two"))
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    return keep(scored.join(found, on, "left").withColumns({
        "pair_bits": F.round(F.col("pair") / words, 4), "order_bits": F.round((F.col("single") - F.col("pair")) / words, 4)})
        .drop("_one", "_two", "pair", "single"), "scored")


def _named(docs: DataFrame, one: str = "one", two: str = "two") -> DataFrame:
    """``docs`` with a name of 128 bits by language and text, in two columns. Rows with the same have the same figures."""
    text = F.col("text").cast("string")
    return docs.withColumns({one: F.xxhash64(_key("lang"), text), two: F.xxhash64(F.lit(1), text, _key("lang"))})


def quality(docs: DataFrame) -> DataFrame:
    """One row per document of (doc_id, lang, text): doc_id, lang, the columns of ``METRICS``,
    ``pair_bits``, ``order_bits``, ``perplexity`` (2 to the power of ``pair_bits``) and ``kept``. Null and empty
    texts have no words and fail the base rules. Further columns of ``docs`` are ignored; an empty table gives an empty result."""
    docs = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    scored = _scored(_named(docs)).drop("one", "two").withColumn("perplexity", F.pow(F.lit(2.0), "pair_bits"))
    return judge(scored, bands(scored))


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (any columns besides lang and text) that ``quality`` keeps. Null, empty
    and wordless texts fail the base rules, very long ones are scored whole, repeated rows are
    judged alike, ties with a limit are inside it, and an empty table gives an empty result."""
    slim = _named(docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    scored = _scored(slim)
    good = judge(scored, F.broadcast(bands(scored))).filter("kept").select("one", "two").distinct()  # one row a language is sent
    one, two = fresh(["one", "two"], docs.columns)
    return (_named(docs, one, two).join(good.withColumnsRenamed({"one": one, "two": two}).hint("merge"), [one, two], "left_semi")
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
