"""Repeated passages by a depth-limited radix sort of suffixes.

Every window of ``window`` bytes that starts anywhere else too is removed. Windows are
compared by most-significant-digit passes, each of which only carries what the one before
left undecided:

1. The leading digit of a window is the ``DIGIT``-byte string in it with the smallest hash
   (the leftmost of equals). It depends on the window's bytes alone, so equal windows agree on
   it and on its place. Neighbouring windows share it: about 1.5 % of all suffixes stand for
   all of them, one row for each run of windows with the same leading string.
   Spark groups the rows by it; groups of one are unique and dropped.
2. The next digit is the whole stretch of text that a run covers. Runs of the same stretch are
   repeated as a whole; they are combined within each task before the shuffle, so the many
   copies of a common passage meet as a few rows.
3. Runs left over share a leading string with another run but not their whole stretch: one end
   of a repeated passage. Their text is fetched, and the windows in it are sorted by the hash
   of all their bytes; equal neighbours are exactly the repeated windows. A group of more than
   ``GROUP`` runs is not gathered in one task: its windows go through a distributed count.

Strings are compared by 64-bit hashes within a group of equal leading strings. Rows are known
by a 64-bit hash of id and text: rows that repeat both are the same text twice, and all their
windows are repeated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm.store import keep, tasks
from tallyframe.llm.text import U, SpanHash, buffers, pieces

WINDOW = 200
DIGIT = 64
GROUP = 100_000
CHUNK = 2_000_000  # windows sorted at a time

_UNIQUE, _REPEATED, _DONE = 0, 1, 2


def runs(p, window: int = WINDOW, digit: int = DIGIT):
    """Runs of windows with the same leading string: (its hash, hash of the stretch, document,
    first window's start in the document, windows, bytes before the leading string)."""
    n, wide = len(p.buf), window - digit + 1
    z = np.zeros(0, np.int64)
    if n < window:
        return z.astype(U), z.astype(U), z, z, z, z
    sizes = np.diff(p.offs)
    ends = np.repeat(p.offs[1:], sizes)          # end of the document of each byte
    hashed = SpanHash(p.buf)
    at = np.arange(n)
    h = hashed(at, np.minimum(at + digit, n))
    low = U((1 << int(n).bit_length()) - 1)
    order = np.full(-(-n // wide) * wide + wide, ~U(0), U)
    order[:n] = np.where(at + digit <= ends, (h & ~low) | at.astype(U), ~U(0))
    blocks = order.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    x = np.flatnonzero(at + window <= ends)      # starts of windows
    lead = (np.minimum(behind[x], ahead[x + wide - 1]) & low).astype(np.int64)
    if len(x) == 0:
        return z.astype(U), z.astype(U), z, z, z, z
    new = np.ones(len(x), bool)
    new[1:] = lead[1:] != lead[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(x)))
    x, lead = x[first], lead[first]
    doc = p.doc_of(x)
    return h[lead], hashed(x, x + count - 1 + window), doc, x - p.offs[doc], count, lead - x


def _pack(start, count, before):
    return start << 16 | count << 8 | before


def _unpack(packed):
    return packed >> 16, (packed >> 8) & 255, packed & 255


def run_table(rows: DataFrame, window: int) -> DataFrame:
    """(lead, stretch, rid, packed, state) of all runs of (rid, text). Of stretches that occur
    twice or more in a batch one row goes on, marked; the others are done."""
    schema = "lead long, stretch long, rid long, packed long, state int"

    def run(batches):
        for b in batches:
            got = [[] for _ in range(4)]
            rids = b.column("rid").to_numpy()
            for p in pieces(b.column("text")):
                lead, stretch, doc, start, count, before = runs(p, window)
                for held, x in zip(got, (lead, stretch, rids[p.lo + doc], _pack(start, count, before))):
                    held.append(x)
            if not got[0]:
                continue
            lead, stretch, rid, packed = (np.concatenate(x) for x in got)
            order = np.lexsort((stretch, lead))
            a, s = lead[order], stretch[order]
            same = np.zeros(len(a) + 1, bool)
            same[1:-1] = (a[1:] == a[:-1]) & (s[1:] == s[:-1])
            state = np.where(same[:-1], _DONE, np.where(same[1:], _REPEATED, _UNIQUE)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(s.view(np.int64)), pa.array(rid[order]), pa.array(packed[order]),
                 pa.array(state)], ["lead", "stretch", "rid", "packed", "state"])

    return rows.mapInArrow(run, schema)


def _stretches(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(lead, rid, packed, open, text): the bytes of each wanted run."""
    def run(batches):
        for b in batches:
            buf, offs = buffers(b.column("text"))
            lists = b.column("runs")
            parent = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            packed = flat.field("packed").to_numpy()
            start, count, _ = _unpack(packed)
            begin = offs[parent] + start
            size = count - 1 + window
            for lo in range(0, len(packed), 20_000):
                s, k = begin[lo:lo + 20_000], size[lo:lo + 20_000]
                ends = np.cumsum(k)
                take = np.arange(ends[-1]) - np.repeat(ends - k, k) + np.repeat(s, k)
                text = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)),
                                                                   pa.py_buffer(np.ascontiguousarray(buf[take]))])
                part = flat.slice(lo, len(k))
                yield pa.RecordBatch.from_arrays(
                    [part.field("lead"), pa.array(b.column("rid").to_numpy()[parent[lo:lo + 20_000]]),
                     part.field("packed"), part.field("open"), text], ["lead", "rid", "packed", "open", "text"])

    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("lead", "packed", "open")).alias("runs"))  # one text's
    return rows.join(lists, "rid").mapInArrow(run, "lead long, rid long, packed long, open boolean, text binary")


def _window_hashes(texts, packed: np.ndarray, window: int):
    """(hash, run, number in the run) of all windows of the runs."""
    buf, offs = buffers(texts)
    _, count, _ = _unpack(packed)
    which = np.repeat(np.arange(len(packed)), count)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    x = offs[which] + nth
    return SpanHash(buf)(x, x + window), which, nth


def _intervals(which, nth, hit, start):
    """Maximal stretches of neighbouring hit windows: (run, first start, last start)."""
    w, x = which[hit], nth[hit] + start[which[hit]]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (x[1:] != x[:-1] + 1)
    first = np.flatnonzero(new)
    return w[first], x[first], x[np.append(first[1:], len(w)) - 1] if len(w) else x


def boundary_windows(stretches: DataFrame, window: int) -> DataFrame:
    """(rid, first, last, hash) of the stretches, grouped by leading string. Repeated windows
    come as (rid, first start, last start, null); every window of a group of more than ``GROUP``
    runs as (rid, start, start, hash)."""
    def decide(table):
        """Rows of whole groups."""
        packed = table.column("packed").to_numpy()
        start, _, _ = _unpack(packed)
        open_ = table.column("open").to_numpy(zero_copy_only=False)
        h, which, nth = _window_hashes(table.column("text"), packed, window)
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = np.zeros(len(s) + 1, bool)
        same[1:-1] = s[1:] == s[:-1]
        hit = np.empty(len(s), bool)
        hit[order] = same[:-1] | same[1:]
        run, first, last = _intervals(which, nth, hit & open_[which], start)
        return rows(table.column("rid").to_numpy()[run], first, last, None)

    def spread(table):
        packed = table.column("packed").to_numpy()
        start, _, _ = _unpack(packed)
        h, which, nth = _window_hashes(table.column("text"), packed, window)
        x = start[which] + nth
        return rows(table.column("rid").to_numpy()[which], x, x, h.view(np.int64))

    def rows(rid, first, last, h):
        return pa.RecordBatch.from_arrays(
            [pa.array(rid), pa.array(first), pa.array(last), pa.nulls(len(rid), pa.int64()) if h is None else pa.array(h)],
            ["rid", "first", "last", "hash"])

    def run(batches):
        held: list = []       # rows of groups not yet decided
        size, large = 0, None  # large: the leading string of a group that is being spread
        for b in batches:
            while b.num_rows:
                lead = b.column("lead").to_numpy()
                if large is not None:
                    n = int(np.searchsorted(lead != large, True)) if lead[0] == large else 0
                    if n:
                        yield spread(b.slice(0, n))
                    b = b.slice(n)
                    if b.num_rows:
                        large = None
                    continue
                held.append(b)
                size += b.num_rows
                b = b.slice(b.num_rows)
                if size * window // 2 < CHUNK:
                    continue
                whole = pa.concat_batches(held)
                lead = whole.column("lead").to_numpy()
                cut = int(np.flatnonzero(lead != lead[-1])[-1]) + 1 if (lead != lead[-1]).any() else 0
                if cut:
                    yield decide(whole.slice(0, cut))
                held, size = [whole.slice(cut)], whole.num_rows - cut
                if size > GROUP:
                    large = lead[-1]
                    for lo in range(cut, whole.num_rows, 10_000):
                        yield spread(whole.slice(lo, min(10_000, whole.num_rows - lo)))
                    held, size = [], 0
        if size:
            yield decide(pa.concat_batches(held))

    spread_out = stretches.repartition(tasks(stretches.sparkSession), "lead").sortWithinPartitions("lead")
    return spread_out.mapInArrow(run, "rid long, first long, last long, hash long")


def repeated(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rid, first, last): starts of runs of windows that occur elsewhere, from (rid, text)."""
    table = keep(run_table(rows, window), "runs")
    group, same = W.partitionBy("lead"), W.partitionBy("lead", "stretch")
    met = (table.filter(F.col("state") != _DONE)
           .withColumn("again", (F.count("*").over(same) > 1) | (F.max("state").over(same) == _REPEATED))
           .withColumn("nth", F.row_number().over(same.orderBy("rid", "packed")))
           .withColumn("some_open", F.max(~F.col("again")).over(group))
           .withColumn("group", F.sum((F.col("nth") == 1).cast("int")).over(group)))
    needed = F.col("some_open") & (F.col("group") > 1) & (F.col("nth") == 1)
    met = keep(met.withColumn("fetch", needed).filter(F.col("again") | F.col("fetch"))
               .select("lead", "rid", "packed", "again", "fetch"), "met")
    fetched = (met.filter("fetch").withColumn("open", ~F.col("again")).drop("again", "fetch"))
    bounds = keep(boundary_windows(_stretches(rows, fetched, window), window), "bounds")
    whole = (table.filter(F.col("state") == _DONE).select("rid", "packed")
             .unionAll(met.filter("again").select("rid", "packed")))
    start = F.shiftright("packed", 16)
    count = F.shiftright("packed", 8).bitwiseAND(255)
    hot = bounds.filter(F.col("hash").isNotNull())
    twice = hot.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    return (whole.select("rid", start.alias("first"), (start + count - 1).alias("last"))
            .unionAll(bounds.filter(F.col("hash").isNull()).select("rid", "first", "last"))
            .unionAll(hot.join(twice, "hash").select("rid", "first", "last")))


def suffix_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining text) of
    each document of (doc_id, text).

    A null text counts as empty; texts shorter than the window lose nothing; repeated rows of
    any id (null ids too) count as texts of their own. An empty table gives an empty result.
    ``kept`` may be cut inside a character; such bytes are replaced when it is read as text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text"))
    found = (repeated(rows.select("rid", "text"), window).groupBy("rid")
             .agg(F.collect_list(F.struct("first", "last")).alias("cuts")))  # one text's
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if with_text else "")

    def run(batches):
        for b in batches:
            buf, offs = buffers(b.column("text"))
            cuts = b.column("cuts")
            lists = cuts.offsets.to_numpy() if len(cuts) else np.zeros(1, np.int32)
            flat = cuts.values
            first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy()
            nulls = cuts.is_null().to_numpy(zero_copy_only=False)
            removed, spans, digest, texts = [], [], [], []
            for i in range(b.num_rows):
                text = buf[offs[i]:offs[i + 1]]
                if nulls[i]:
                    removed.append(0), spans.append(0)
                    left = text.tobytes()
                else:
                    step = np.zeros(len(text) + 1, np.int64)
                    np.add.at(step, first[lists[i]:lists[i + 1]], 1)
                    np.add.at(step, last[lists[i]:lists[i + 1]] + window, -1)
                    out = np.cumsum(step[:-1]) > 0
                    removed.append(int(out.sum()))
                    spans.append(int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()))
                    left = text[~out].tobytes()
                digest.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    texts.append(left.decode("utf-8", "replace"))
            arrays = [b.column("doc_id"), pa.array(np.diff(offs)), pa.array(removed, pa.int64()),
                      pa.array(spans, pa.int64()), pa.array(digest, pa.string())] + ([pa.array(texts, pa.string())] if with_text else [])
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in fields.split(", ")])

    return rows.join(found, "rid", "left").mapInArrow(run, fields)
