"""Source divergence audit: how a source's use of terms differs from the other sources' of its
language, and from the language as a whole.

1. Exact frequency filter: a term's documents are counted by language; terms of too few go.
2. Each language's kept terms are dealt by hash into shards of about ``SHARD`` terms, and each
   shard gets a minimal perfect hash (hash and displace: a bucket's seed sends its terms to
   free places; a bucket of one term names its place outright). Shards follow one another, so
   a language's terms have dense slots from 0.
3. Recount: shards are broadcast, at most ``ROUND_BYTES`` at a time (more shards mean more
   passes over the texts, not more memory). A found slot counts only if the key stored there
   equals the term, byte for byte. A task counts in dense arrays, one for each group it meets,
   and hands them on when they reach ``CELLS``.
4. Divergences are sums over blocks of slots, in whole numbers throughout.

Terms are compared as bytes everywhere; hashes only say where to look.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm.order import running
from tallyframe.llm.store import keep
from tallyframe.llm.text import LOWER, Piece, SpanHash, U, mix, pieces, spans

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

SHARD = 2048               # terms of a shard, on average
BUCKET = 4                 # terms of a seed, on average
ROUND_BYTES = 64 << 20     # of shards broadcast at a time
CELLS = 1 << 22            # counts a task holds
DISTINCT = 1 << 18         # rows a task holds before it hands on its document counts
BLOCK = 4096               # slots of a divergence task
TILE = 32                  # groups of a divergence task, twice
SCALE = 1_000_000_000
SMOOTH = 5

_SEED = U(0x9E3779B97F4A7C15)


def terms(p: Piece) -> tuple[pa.Array, np.ndarray]:
    """All terms of a piece, A-Z lower-cased, as an Arrow array, and their documents."""
    inside = LETTER[p.buf]
    start, end, doc = spans(p, inside)
    size = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=size[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(size), pa.py_buffer(LOWER[p.buf[inside]])]), doc


def _coded(column) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _hash(keys: pa.Array) -> np.ndarray:
    """64-bit hashes of an Arrow array of byte strings."""
    keys = keys.cast(pa.large_binary())
    offsets = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset:keys.offset + len(keys) + 1]
    data = keys.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(keys) else np.zeros(0, np.uint8)
    return SpanHash(buf)(offsets[:-1] - offsets[0], offsets[1:] - offsets[0])


def document_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term) of the terms in at least ``least`` of a language's documents."""

    def merged(tables):
        return pa.concat_tables(tables).group_by(["lang", "term"]).aggregate([("n", "sum")]).rename_columns(["lang", "term", "n"])

    def run(batches):
        held, rows = [], 0
        for b in batches:
            langs, names = _coded(b.column("lang"))
            for p in pieces(b.column("text")):
                found, doc = terms(p)
                if not len(found):
                    continue
                code, words = _coded(found)
                seen = np.unique(doc * len(words) + code)   # a document counts a term once
                pair, n = np.unique(langs[p.lo + seen // len(words)] * len(words) + seen % len(words), return_counts=True)
                held.append(pa.table({"lang": names.take(pa.array(pair // len(words))),
                                      "term": words.take(pa.array(pair % len(words))).cast(pa.binary()), "n": n.astype(np.int64)}))
                rows += len(n)
                if rows > DISTINCT:
                    one = merged(held)
                    held, rows = [one], one.num_rows
                    if rows > DISTINCT // 2:
                        yield from one.to_batches()
                        held, rows = [], 0
        if held:
            yield from merged(held).to_batches()

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, term binary, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term")


def perfect_hash(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of a minimal perfect hash of distinct ``keys``, and the key of each place. A seed
    below zero is the place of a bucket's only key."""
    n = len(keys)
    h = _hash(keys)
    if len(np.unique(h)) < n:
        raise ValueError("two terms of a shard have one 64-bit hash")
    bucket = _bucket(h, n)
    size = np.bincount(bucket, minlength=-(-n // BUCKET))
    seeds, at = np.zeros(len(size), np.int64), np.full(n, -1, np.int64)
    for b in np.argsort(-size, kind="stable"):
        if size[b] == 0:
            break
        mine = np.flatnonzero(bucket == b)
        if size[b] == 1:
            place = int(np.flatnonzero(at < 0)[0])
            seeds[b], at[place] = -place - 1, mine[0]
            continue
        tried = 0
        while True:
            seed = np.arange(tried, tried + 64)
            place = _place(h[mine][:, None], seed[None, :], n)
            free = (at[place] < 0).all(0)
            line = np.sort(place, 0)
            ok = np.flatnonzero(free & (line[1:] != line[:-1]).all(0))
            if len(ok):
                seeds[b] = seed[ok[0]]
                at[place[:, ok[0]]] = mine
                break
            tried += 64
    return seeds, at


def _shard(h: np.ndarray, n) -> np.ndarray:
    return (mix(h ^ U(0xA0761D6478BD642F)) % np.asarray(n).astype(U)).astype(np.int64)


def _bucket(h: np.ndarray, n) -> np.ndarray:
    return (mix(h ^ U(0xD1B54A32D192ED03)) % (np.asarray(-(-n // BUCKET)).astype(U))).astype(np.int64)


def _place(h: np.ndarray, seed: np.ndarray, n) -> np.ndarray:
    return (mix(h + (seed.astype(U) + U(1)) * _SEED) % np.asarray(n).astype(U)).astype(np.int64)


def shards(kept: DataFrame) -> DataFrame:
    """(lang, shard, shards, slots, n, seeds, terms, first, bytes, size): the shards of each
    language's terms with their perfect hashes, ``first`` the slot of a shard's place 0 and
    ``slots`` the language's number of terms."""
    sizes = (kept.groupBy("lang").agg(F.count("*").alias("slots"))
             .withColumn("shards", F.ceil(F.col("slots") / F.lit(SHARD))).withColumnRenamed("lang", "_lang"))
    sized = kept.join(sizes, F.col("lang") == F.col("_lang")).select("lang", "term", "shards", "slots")

    def deal(batches):
        for b in batches:
            if b.num_rows:
                shard = _shard(_hash(b.column("term")), b.column("shards").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard)], [*b.schema.names, "shard"])

    dealt = sized.mapInArrow(deal, "lang string, term binary, shards long, slots long, shard long")

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("term")
        keys = table["term"].combine_chunks()
        seeds, at = perfect_hash(keys)
        placed = keys.take(pa.array(at))
        size = int(pc.sum(pc.binary_length(keys)).as_py()) + 16 * len(keys) + 8 * len(seeds) + 64
        row = {c: table[c][:1] for c in ("lang", "shard", "shards", "slots")}
        return pa.table(row | {"n": pa.array([len(keys)], pa.int64()), "seeds": pa.array([seeds.tolist()], pa.list_(pa.int64())),
                               "terms": pa.array([placed.to_pylist()], pa.list_(pa.binary())), "size": pa.array([size], pa.int64())})

    built = keep(dealt.groupBy("lang", "shard").applyInArrow(
        build, "lang string, shard long, shards long, slots long, n long, seeds array<long>, terms array<binary>, size long"), "shards")
    place = running(built.select("lang", "shard", "n"), [F.col("shard")], "n", "first", by="lang")
    total = running(built.select("lang", "shard", "size"), [F.col("lang"), F.col("shard")], "size", "bytes").drop("size")
    return keep(built.join(place.drop("n"), ["lang", "shard"]).join(total, ["lang", "shard"]), "placed")


class Lookup:
    """Slots of terms, by language, in some of the shards. ``rows`` are sorted (lang, shard)."""

    def __init__(self, rows: list):
        self.langs, self.modulus, self.where = {}, [], []
        seeds, keys, n, first = [], [], [], []
        for r in rows:
            if r.lang not in self.langs:
                self.langs[r.lang] = len(self.modulus)
                self.modulus.append(r.shards)
                self.where.append(np.full(r.shards, -1, np.int64))
            self.where[-1][r.shard] = len(n)
            seeds.append(np.array(r.seeds, np.int64))
            keys.append(pa.array([bytes(t) for t in r.terms], pa.large_binary()))
            n.append(r.n)
            first.append(r.first)
        self.n, self.first = np.array(n, np.int64), np.array(first, np.int64)
        self.seeds, self.keys = np.concatenate(seeds), pa.concat_arrays(keys)
        self.seed_at = np.cumsum([0, *map(len, seeds)])[:-1]
        self.key_at = np.cumsum([0, *n])[:-1]

    def slots(self, lang: str, words: pa.Array) -> np.ndarray:
        """Slot of each word in its language, -1 if it has none here."""
        out = np.full(len(words), -1, np.int64)
        k = self.langs.get(lang)
        if k is None or not len(words):
            return out
        h = _hash(words)
        shard = self.where[k][_shard(h, self.modulus[k])]
        some = np.flatnonzero(shard >= 0)
        shard, h = shard[some], h[some]
        seed = self.seeds[self.seed_at[shard] + _bucket(h, self.n[shard])]
        place = np.where(seed < 0, -seed - 1, _place(h, np.maximum(seed, 0), self.n[shard]))
        same = pc.equal(self.keys.take(pa.array(self.key_at[shard] + place)), words.take(pa.array(some)))
        ok = same.to_numpy(zero_copy_only=False).astype(bool)
        out[some[ok]] = (self.first[shard] + place)[ok]
        return out

    def width(self, lang: str) -> tuple[int, int]:
        """First slot of the language's shards held here, and the first beyond them."""
        mine = self.where[self.langs[lang]]
        mine = mine[mine >= 0]
        return int(self.first[mine].min()), int((self.first[mine] + self.n[mine]).max())


def recount(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """(lang, source, slot, n): each group's occurrences of the kept terms it has."""
    spark = docs.sparkSession
    schema = "lang string, source string, slot long, n long"
    total = placed.agg(F.max(F.col("bytes") + F.col("size"))).first()[0] or 0
    counted = spark.createDataFrame([], schema)
    for k in range(-(-total // ROUND_BYTES)):
        mine = placed.filter(F.floor(F.col("bytes") / F.lit(ROUND_BYTES)) == k)
        rows = mine.orderBy("lang", "shard").collect()   # at most ROUND_BYTES and one shard
        if rows:
            counted = counted.unionAll(_counted(docs, spark.sparkContext.broadcast(Lookup(rows)), schema))
    # Dealt by slot, so that what follows by slot needs no further exchange.
    return counted.repartition("lang", "slot").groupBy("lang", "source", "slot").agg(F.sum("n").alias("n"))


def _counted(docs: DataFrame, shared, schema: str) -> DataFrame:
    def run(batches):
        look: Lookup = shared.value
        span = {lang: look.width(lang) for lang in look.langs}
        held: dict[tuple[str, str], np.ndarray] = {}   # group: dense counts of the slots held here

        def hand_on():
            for (lang, source), counts in held.items():
                at = np.flatnonzero(counts)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()),
                         pa.array(at + span[lang][0]), pa.array(counts[at])], ["lang", "source", "slot", "n"])
            held.clear()

        for b in batches:
            langs, lang_names = _coded(b.column("lang"))
            sources, source_names = _coded(b.column("source"))
            lang_names, source_names = lang_names.to_pylist(), source_names.to_pylist()
            for p in pieces(b.column("text")):
                found, doc = terms(p)
                if not len(found):
                    continue
                code, words = _coded(found)
                group = (langs * len(source_names) + sources)[p.lo + doc]
                cell, n = np.unique(group * len(words) + code, return_counts=True)   # ordered by group
                group, code = cell // len(words), cell % len(words)
                slot, known = np.full(len(words), -1, np.int64), None
                cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    lang, source = divmod(int(group[lo]), len(source_names))
                    name = lang_names[lang]
                    if name not in span:
                        continue
                    if lang != known:   # groups of a language follow one another
                        last = int(np.searchsorted(group, (lang + 1) * len(source_names)))
                        used = np.unique(code[lo:last])
                        slot[used], known = look.slots(name, words.take(pa.array(used))), lang
                    at = np.arange(lo, hi)[slot[code[lo:hi]] >= 0]
                    key = (name, source_names[source])
                    if key not in held:
                        width = span[name][1] - span[name][0]
                        if held and sum(map(len, held.values())) + width > CELLS:
                            yield from hand_on()
                        held[key] = np.zeros(width, np.int64)
                    held[key][slot[code[at]] - span[name][0]] += n[at]
        yield from hand_on()

    return docs.select("lang", "source", "text").mapInArrow(run, schema)


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) for a < b, numbers of groups of a language: the sum over all slots of
    the distance of their p. A task has a block of slots of two tiles of groups; a row of slot
    -1 brings a group's p of an absent term, so groups without terms take part."""
    tile, tiles = F.floor(F.col("number") / F.lit(TILE)), F.ceil(F.col("sources") / F.lit(TILE))
    blocks = F.greatest(F.ceil(F.col("slots") / F.lit(BLOCK)), F.lit(1))
    heads = groups.select("lang", "number", "sources", "slots", F.lit(-1).cast("long").alias("slot"), F.col("absent").alias("p"),
                          F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    rows = heads.unionByName(cells.select("lang", "number", "sources", "slots", "slot", "p",
                                          F.floor(F.col("slot") / F.lit(BLOCK)).alias("block")))
    rows = rows.select("lang", "block", tile.alias("tile"), "number", "slot", "slots", "p",
                       F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("other"))
    rows = rows.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).drop("tile", "other")

    def measure(table: pa.Table) -> pa.Table:
        col = {c: table[c].to_numpy() for c in ("number", "slot", "slots", "p", "block", "low", "high")}
        start, low, high = int(col["block"][0]) * BLOCK, col["low"][0], col["high"][0]
        width = max(0, min(BLOCK, int(col["slots"][0]) - start))
        head = col["slot"] < 0
        order = np.argsort(col["number"][head])
        number, absent = col["number"][head][order], col["p"][head][order]
        p = np.repeat(absent[:, None], width, 1)
        p[np.searchsorted(number, col["number"][~head]), col["slot"][~head] - start] = col["p"][~head]
        mine, others = np.flatnonzero(number // TILE == low), np.flatnonzero(number // TILE == high)
        a, b, value = [], [], []
        for i in mine:
            to = others[others > i]
            a.append(np.full(len(to), number[i]))
            b.append(number[to])
            value.append(np.abs(p[to] - p[i]).sum(1))
        a, b, value = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (a, b, value))
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(a), pa.string()), "a": a, "b": b, "value": value})

    parts = rows.groupBy("lang", "block", "low", "high").applyInArrow(measure, "lang string, a long, b long, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) over ``docs`` (text, lang, source; null reads as
    empty, and the empty language and source are groups like others).

    Each group gives each kept term of its language p = 1 + floor(SCALE (n + SMOOTH) / (N +
    SMOOTH V)), from n occurrences of N in V kept terms. Part ``pair``: the other sources of the
    language by the sum of the distances of their p (0 where no term is kept). Part ``term``:
    the ``top`` terms that occur and have more p here than in the whole language. Empty and very
    long texts, groups without terms and repeated rows count as they are; an empty table gives
    an empty result. Other columns are not read."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    placed = shards(keep(document_counts(docs, least), "kept"))
    cells = recount(docs, placed).withColumn("total", F.sum("n").over(W.partitionBy("lang", "slot")))
    cells = keep(cells, "cells")

    names = docs.select("lang", "source").distinct()
    names = running(names.withColumn("_one", F.lit(1).cast("long")), [F.col("source")], "_one", "number", by="lang", total="sources")
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    langs = sums.groupBy("lang").agg(F.sum("own").alias("all"))
    slots = placed.groupBy("lang").agg(F.max("slots").alias("slots"))
    groups = names.drop("_one").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").join(slots, "lang", "left")
    groups = groups.fillna(0, ["own", "all", "slots"])

    def share(n: str, of: str) -> str:   # wider than a long: SCALE times a count
        return (f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + {SMOOTH} as decimal(20,0))) div "
                f"cast({of} + {SMOOTH} * slots as decimal(20,0))")

    groups = keep(groups.withColumn("absent", F.expr(f"CASE WHEN slots > 0 THEN {share('0', 'own')} ELSE 0 END")), "groups")
    full = keep(cells.join(groups, ["lang", "source"]).select(
        "lang", "source", "number", "sources", "slots", "slot", F.expr(share("n", "own")).alias("p"),
        F.expr(share("total", "all")).alias("q")), "shares")

    pairs = keep(_pairs(full, groups), "pairs")
    both = pairs.unionAll(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = groups.select("lang", "number", "source")
    both = (both.join(name.select("lang", F.col("number").alias("a"), "source"), ["lang", "a"])
            .join(name.select("lang", F.col("number").alias("b"), F.col("source").alias("item")), ["lang", "b"])
            .select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"))
    by_rank = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # Ranks by value alone come first: only their terms need be looked up.
    first = (full.filter("p > q").select("lang", "source", "slot", (F.col("p") - F.col("q")).alias("value"))
             .withColumn("_rank", F.rank().over(by_value)).filter(F.col("_rank") <= top).drop("_rank"))
    words = (placed.select("lang", "first", F.posexplode("terms").alias("_at", "_term"))
             .select("lang", (F.col("first") + F.col("_at")).alias("slot"), F.col("_term").cast("string").alias("item")))
    rising = (first.join(words, ["lang", "slot"]).select("lang", "source", F.lit("term").alias("part"), "item", "value")
              .withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= top))
    return both.withColumn("rank", F.row_number().over(by_rank)).unionByName(rising)
