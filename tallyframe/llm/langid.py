"""Language identification with bit-sliced Bloom filters of character n-grams.

The filters of all languages lie side by side: slot ``s`` holds one bit per language, so the
AND of a gram's ``HASHES`` slots is the set of languages whose filter holds it, found in one
look-up for all languages at once. A language's filter holds the grams that are at least
``RATIO`` times as common in it as in the language where they are most common, which leaves
out stray foreign words. A text's score for a language is the share of its grams that the
filter holds, corrected for the filter's false positives: ``(hits - f * n) / (1 - f)`` with
``f`` its fill raised to the number of hashes. The best language wins; ties go to the one
with more training grams.

The filters take ``2 ** LOG2_SLOTS`` times one byte per eight languages, whatever the corpus:
that is the bound on what is broadcast. Grams are ``GRAM`` bytes of the lower-cased text,
ASCII characters other than letters read as spaces, with spaces before and after the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.store import keep
from tallyframe.llm.text import U, mix, pieces

GRAM = 4
LOG2_SLOTS = 22
HASHES = 3
RATIO = 0.1
LEAST = 3          # occurrences a gram needs in a language
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[[i for i in range(128) if not 97 <= i <= 122]] = 32


def _grams(p) -> tuple[np.ndarray, np.ndarray]:
    """(gram, document) of a piece of lower-cased texts. Each text stands between spaces, one
    fewer than a gram is long, so that no gram reaches into two texts and a text of one letter
    has some; grams of spaces alone are left out."""
    pad, sizes = GRAM - 1, np.diff(p.offs)
    doc = np.repeat(np.arange(p.n), sizes + pad)  # of the gram that starts at each place
    out = np.full(len(doc) + pad, 32, np.uint32)
    out[np.arange(len(p.buf)) + pad * (1 + np.repeat(np.arange(p.n), sizes))] = _FOLD[p.buf]
    code = np.zeros(len(doc), np.uint32)
    for i in range(GRAM):
        code |= out[i:len(doc) + i] << np.uint32(8 * (GRAM - 1 - i))
    real = code != 0x20202020
    return code[real], doc[real]


def _lower(col):
    return pc.utf8_lower(pc.fill_null(col.cast(pa.large_string()), ""))


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text); tasks add up their own grams first."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()),
                           T.StructField("n", T.LongType())])

    def added(parts):
        code = np.concatenate([c for c, _ in parts])
        n = np.concatenate([k for _, k in parts])
        code, at = np.unique(code, return_inverse=True)
        return code, np.bincount(at, weights=n).astype(np.int64)

    def rows(held):
        for lang, parts in held.items():
            code, n = added(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)),
                                              pa.array(n)], ["lang", "gram", "n"])

    def run(batches):
        held: dict = {}
        size = 0
        for b in batches:
            for p in pieces(_lower(b.column("text"))):
                code, doc = _grams(p)
                langs = np.array(b.column("lang").slice(p.lo, p.n).to_pylist(), object)
                which = langs[doc]
                for lang in set(langs):
                    got = np.unique(code[which == lang], return_counts=True)
                    size += len(got[0])
                    held.setdefault(lang, []).append(got)
                if size > 2_000_000:
                    held = {k: [added(v)] for k, v in held.items()}
                    size = sum(len(v[0][0]) for v in held.values())
                    if size > 1_000_000:
                        yield from rows(held)
                        held, size = {}, 0
        yield from rows(held)

    return docs.mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def slots(gram: np.ndarray) -> list[np.ndarray]:
    h = mix(gram.astype(U) + U(0x9E3779B97F4A7C15))
    a, b = h & U(0xFFFFFFFF), (h >> U(32)) | U(1)
    return [((a + U(i) * b) & U((1 << LOG2_SLOTS) - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass
class Filters:
    langs: list[str]                # by training grams, most first
    planes: list[np.ndarray]        # one byte per slot for each eight languages
    false: np.ndarray               # rate of false positives by language

    def hits(self, gram: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Grams of each document that each language's filter holds."""
        out = np.zeros((n, len(self.langs)), np.int64)
        at = slots(gram)
        for k, plane in enumerate(self.planes):
            found = plane[at[0]]
            for a in at[1:]:
                found = found & plane[a]
            for bit in range(min(8, len(self.langs) - 8 * k)):
                out[:, 8 * k + bit] = np.bincount(doc[(found >> bit) & 1 == 1], minlength=n)
        return out


def fit(labelled: DataFrame) -> Filters:
    """Filters from all rows of (lang, text) whose lang is not null. Distinct languages may be
    many; only (language, training grams) and the filters' set slots come to the driver, as
    planes of fixed size made by the tasks."""
    counts = keep(gram_counts(labelled.filter(F.col("lang").isNotNull())), "grams")
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").collect()
    langs = [r.lang for r in sizes]
    planes = [np.zeros(1 << LOG2_SLOTS, np.uint8) for _ in range(-(-len(langs) // 8))]
    if langs:
        total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
        rate = counts.join(F.broadcast(total), "lang").withColumn("rate", F.col("n") / F.col("total"))
        best = F.max("rate").over(W.partitionBy("gram"))
        chosen = (rate.withColumn("best", best).filter((F.col("rate") >= RATIO * F.col("best")) & (F.col("n") >= LEAST))
                  .select("lang", "gram"))
        number = {lang: i for i, lang in enumerate(langs)}
        width = len(langs)

        def partial(batches):
            own: dict[int, np.ndarray] = {}
            for b in batches:
                which = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
                for i in set(which):
                    bits = own.setdefault(int(i), np.zeros(1 << LOG2_SLOTS, bool))
                    for a in slots(b.column("gram").to_numpy()[which == i]):
                        bits[a] = True
            for i, bits in own.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["lang", "bits"])

        # Grams by hash of language and a few salts, so tasks make few and bounded filters.
        parts = (chosen.repartition(min(32, 2 * width), "lang", F.pmod(F.col("gram"), F.lit(4)))
                 .mapInArrow(partial, "lang int, bits binary"))
        for r in parts.toLocalIterator():  # one filter at a time
            bits = np.unpackbits(np.frombuffer(r.bits, np.uint8))
            planes[r.lang // 8] |= bits << np.uint8(r.lang % 8)
    false = np.array([np.mean((planes[i // 8] >> (i % 8)) & 1) ** HASHES for i in range(len(langs))])
    return Filters(langs, planes, false)


def predict(docs: DataFrame, model: Filters) -> DataFrame:
    """``docs`` (doc_id, held_out, text) -> doc_id, held_out, lang_pred, score.

    Texts that are null or have no letter are ``und`` with score 0; so is every text if no
    language was learned. A text with letters but no gram that any filter holds goes to the
    language with most training grams, score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, held_out boolean, lang_pred string, score double"

    def run(batches):
        m = shared.value
        names = np.array(m.langs + [UNKNOWN], object)
        for b in batches:
            texts = b.column("text")
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            for p in pieces(_lower(texts)):
                has = letters[p.lo:p.hi]
                cut = b.slice(p.lo, p.n)
                if m.langs:
                    gram, doc = _grams(p)
                    n = np.bincount(doc, minlength=p.n)[:, None]
                    share = np.clip((m.hits(gram, doc, p.n) - m.false * n) / (1 - m.false) / np.maximum(n, 1), 0, 1)
                    best = share.argmax(axis=1)  # the first of equals: most training grams
                    score = np.where(has, share[np.arange(p.n), best], 0.0)
                    pred = names[np.where(has, best, len(m.langs))]
                else:
                    pred, score = np.full(p.n, UNKNOWN, object), np.zeros(p.n)
                yield pa.RecordBatch.from_arrays(
                    [cut.column("doc_id"), cut.column("held_out"), pa.array(pred.tolist(), pa.string()), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)
