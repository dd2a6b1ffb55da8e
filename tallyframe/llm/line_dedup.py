"""Fuzzy line deduplication by MinHash.

A line's set is its distinct shingles of ``SHINGLE`` bytes (A-Z lowered; a shorter line is its
own shingle). One-permutation MinHash takes one hash per shingle: it falls into one of ``BANDS
* ROWS`` bins, the least of each bin is the signature, and bins without a shingle borrow from
others in a fixed random order. Lines that agree on the ``ROWS`` values of any band are
candidates (at a similarity of 0.8 with probability 0.995), verified by their exact Jaccard
similarity, and joined to components by distributed union-find. Of each component the first
line stays, by document id, then place. Equal lines are one node throughout: a line
that is in a third of all documents is one entry a batch.

Lines and their band keys are far more than what they have in common with others, so they move
as packed arrays, not as rows: ``scan`` deals the keys and the places of lines over the tasks,
and only keys that several lines have, and lines that are elsewhere too, become rows.

Lines are the parts of a text between line feeds that have a character besides white space;
other lines are kept as they are and not counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.pairs import linked_stars
from tallyframe.llm.store import keep, tasks
from tallyframe.llm.text import LOWER, SPACE, U, SpanHash, mix, pieces

SHINGLE = 8
BANDS, ROWS = 10, 4
PERCENT = 80
SIEVE = 27   # bits of a hash by which lines that are no candidates are left out, nearly all of them
KEYS, PLACES, GONE = range(3)   # kinds of rows
PLACE = np.dtype([("node", "<i8"), ("none", "?"), ("doc_id", "<i8"), ("rid", "<i8"), ("line_no", "<i8")])


def lines(p):
    """(start, end, document, number in the document) of the lines with a character."""
    if p.n == 0:
        return (np.zeros(0, np.int64),) * 4
    feed = np.flatnonzero(p.buf == 10)
    start = np.sort(np.concatenate([p.offs[:-1], feed + 1]))
    end = np.sort(np.concatenate([p.offs[1:], feed]))
    many = 1 + np.diff(np.searchsorted(feed, p.offs))
    doc = np.repeat(np.arange(p.n), many)
    no = np.arange(len(start)) - np.repeat(np.cumsum(many) - many, many)
    has = end > start
    # Few lines begin with white space; those are read whole.
    look = np.flatnonzero(has)[SPACE[p.buf[start[has]]]]
    if len(look):
        solid = np.zeros(len(p.buf) + 1, np.int64)
        np.cumsum(~SPACE[p.buf], out=solid[1:])
        has[look] = solid[end[look]] > solid[start[look]]
    return start[has], end[has], doc[has], no[has]


def shingles(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of all shingles of the lines, repeated ones included."""
    low = np.concatenate([LOWER[buf], np.zeros(SHINGLE, np.uint8)])
    load = np.ndarray((len(buf) + 1,), "<u8", low, strides=(1,))
    size = end - start
    n = np.maximum(size - SHINGLE + 1, 1)
    line = np.repeat(np.arange(len(start)), n)
    at = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n) + start[line]
    h = load[at]
    short = size[line] < SHINGLE
    if short.any():
        cut = U(64) - size[line[short]].astype(U) * U(8)
        h[short] = (h[short] << cut) >> cut
    return mix(h + U(0x9E3779B97F4A7C15)), line


def bands(h: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """Band keys (line by band) of the lines' shingles."""
    k = BANDS * ROWS
    cell = line * k + (((h >> U(32)) * U(k)) >> U(32)).astype(np.int64)
    least = np.full(n * k, ~U(0), U)
    np.minimum.at(least, cell, mix(h))
    least = least.reshape(n, k)
    hole = least == ~U(0)
    line_of, bin_of = np.nonzero(hole)
    turn = 0
    while len(line_of):
        turn += 1
        source = (mix((bin_of + 1024 * turn).astype(U)) % U(k)).astype(np.int64)
        full = ~hole[line_of, source]
        at = line_of[full], bin_of[full]
        least[at] = mix(least[line_of[full], source[full]] + U(turn))
        line_of, bin_of = line_of[~full], bin_of[~full]
    out = np.zeros((n, BANDS), U)
    for r in range(ROWS):
        out = mix(out + least[:, r::ROWS])
    return mix(out + np.arange(BANDS, dtype=U) * U(0xD1B54A32D192ED03))


class LineJoin:
    """Lines as texts of their own (none has a line feed)."""

    percent = PERCENT
    sketch_bits = 0

    def sets(self, p):
        some = np.flatnonzero(np.diff(p.offs) > 0)
        h, line = shingles(p.buf, p.offs[some], p.offs[some + 1])
        d = some[line]
        code = d.astype(U) << U(42) | h >> U(22)   # sorts faster than two keys
        order = np.argsort(code)
        code, h, d = code[order], h[order], d[order]
        if p.n >= 1 << 22 or ((code[1:] == code[:-1]) & (h[1:] != h[:-1])).any():
            order = np.lexsort((h, d))
            h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        return h[new], d[new]


def _node(p, start, end):
    return SpanHash(p.buf)(start, end).view(np.int64)


def _dealt(values: np.ndarray, bucket: np.ndarray, n: int):
    """(bucket, bytes) of ``values`` by ``bucket`` below ``n``."""
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n + 1))
    values = values[order]
    for i in np.flatnonzero(np.diff(cut)):
        yield int(i), values[cut[i]:cut[i + 1]].tobytes()


def _firsts(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each node, and the places that come after a node's first one."""
    order = np.lexsort((place["line_no"], place["rid"], place["doc_id"], place["none"], place["node"]))
    place = place[order]
    new = np.ones(len(place), bool)
    new[1:] = place["node"][1:] != place["node"][:-1]
    first = place[new]
    own = first[np.cumsum(new) - 1]
    return first, place[(place["rid"] != own["rid"]) | (place["line_no"] != own["line_no"])]


def _stars(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, node, pivot) of the keys of several nodes: the pivot is the least of them. A
    group is named by its nodes, so keys of the same nodes are one group."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[new], node[new]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    group = np.add.reduceat(mix(node.view(U)), start) if len(key) else np.zeros(0, U)
    several = np.repeat(size > 1, size)
    several[start] = False
    return np.repeat(group.view(np.int64), size)[several], node[several], np.repeat(node[start], size)[several]


def scan(rows: DataFrame) -> DataFrame:
    """What the lines of (rid, doc_id, text) have in common, as rows of three kinds: KEYS (x: group,
    y: node, z: pivot) of the nodes that share a band key, PLACES (packed: the first place of each
    node), GONE (x: rid, y: line_no) of the lines that an earlier one equals."""
    n = tasks(rows.sparkSession)

    def read(batches):
        for b in batches:
            rid = b.column("rid").to_numpy()
            none = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            doc_id = b.column("doc_id").fill_null(0).to_numpy()
            seen, places, keys, nodes = np.zeros(0, np.int64), [], [], []
            for p in pieces(b.column("text")):
                start, end, doc, no = lines(p)
                node = _node(p, start, end)
                place = np.empty(len(node), PLACE)
                at = doc + p.lo
                place["node"], place["none"], place["doc_id"], place["rid"], place["line_no"] = node, none[at], doc_id[at], rid[at], no
                places.append(place)
                own, first = np.unique(node, return_index=True)
                first = np.sort(first[~np.isin(own, seen, assume_unique=True)])
                seen = np.concatenate([seen, node[first]])
                if len(first):
                    h, line = shingles(p.buf, start[first], end[first])
                    keys.append(bands(h, line, len(first)).reshape(-1))
                    nodes.append(np.repeat(node[first], BANDS))
            first, gone = _firsts(np.concatenate(places)) if places else (np.zeros(0, PLACE),) * 2
            out = [(PLACES, i, x) for i, x in _dealt(first, (first["node"].view(U) % U(n)).astype(np.int64), n)]
            if keys:
                both = np.stack([np.concatenate(keys).view(np.int64), np.concatenate(nodes)], axis=1)
                out += [(KEYS, i, x) for i, x in _dealt(both, (both[:, 0].view(U) % U(n)).astype(np.int64), n)]
            if len(gone):
                pair = np.stack([gone["rid"], gone["line_no"]], axis=1)
                out += [(GONE, i, x) for i, x in _dealt(pair, (pair[:, 0].view(U) % U(n)).astype(np.int64), n)]
            kind, bucket, packed = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(packed, pa.binary())],
                                             ["kind", "bucket", "packed"])

    def merge(batches):
        got: list[list[bytes]] = [[], [], []]
        for b in batches:
            for kind, packed in zip(b.column("kind").to_pylist(), b.column("packed").to_pylist()):
                got[kind].append(packed)
        keys, gone = (np.frombuffer(b"".join(got[k]), np.int64).reshape(-1, 2) for k in (KEYS, GONE))
        first, more = _firsts(np.frombuffer(b"".join(got[PLACES]), PLACE))
        group, node, pivot = _stars(keys[:, 0], keys[:, 1])
        yield _rows(KEYS, group, node, pivot)
        yield _rows(GONE, np.concatenate([gone[:, 0], more["rid"]]), np.concatenate([gone[:, 1], more["line_no"]]))
        step = 1 << 16
        blobs = [first[i:i + step].tobytes() for i in range(0, len(first), step)]
        none = pa.nulls(len(blobs), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([PLACES] * len(blobs), pa.int32()), none, none, none, pa.array(blobs, pa.binary())], NAMES)

    dealt = rows.mapInArrow(read, "kind int, bucket int, packed binary").repartitionById(n, "bucket")
    return dealt.select("kind", "packed").mapInArrow(merge, "kind int, x long, y long, z long, packed binary")


NAMES = ["kind", "x", "y", "z", "packed"]


def _rows(kind: int, x: np.ndarray, y: np.ndarray, z: np.ndarray | None = None) -> pa.RecordBatch:
    z = pa.nulls(len(x), pa.int64()) if z is None else pa.array(z)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(np.ascontiguousarray(x)),
                                       pa.array(np.ascontiguousarray(y)), z, pa.nulls(len(x), pa.binary())], NAMES)


class Sieve:
    """A bit for each hash of some nodes: lets these through, and few others."""

    def __init__(self, nodes: DataFrame):
        cell = F.col("node").bitwiseAND((1 << SIEVE) - 1)
        words = (nodes.select(F.shiftright(cell, 6).alias("word"), F.expr("shiftleft(1L, cast(node & 63 as int))").alias("bit"))
                 .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
        bits = np.zeros(1 << SIEVE - 6, U)
        bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(U)
        self.bits = nodes.sparkSession.sparkContext.broadcast(bits.tobytes())

    def __call__(self, node: np.ndarray) -> np.ndarray:
        bits = np.frombuffer(self.bits.value, U)
        cell = node.view(U) & U((1 << SIEVE) - 1)
        return (bits[(cell >> U(6)).astype(np.int64)] >> (cell & U(63)) & U(1)).astype(bool)


def line_texts(rows: DataFrame, sieve: Sieve | None = None) -> DataFrame:
    """(node, text) of the lines that ``sieve`` lets through, once for each batch that has the line."""
    def run(batches):
        for b in batches:
            seen = np.zeros(0, np.int64)
            for p in pieces(b.column("text")):
                start, end, _, _ = lines(p)
                node = _node(p, start, end)
                if sieve:
                    some = sieve(node)
                    node, start, end = node[some], start[some], end[some]
                node, first = np.unique(node, return_index=True)
                new = ~np.isin(node, seen, assume_unique=True)
                seen = np.concatenate([seen, node[new]])
                if new.any():
                    yield _texts(p, start[first[new]], end[first[new]], node[new])

    return rows.select("text").mapInArrow(run, "node long, text string")


def _texts(p, start: np.ndarray, end: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    ends = np.cumsum(end - start)
    take = np.arange(ends[-1]) - np.repeat(ends - (end - start), end - start) + np.repeat(start, end - start)
    text = pa.Array.from_buffers(pa.string(), len(node), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)),
                                                          pa.py_buffer(np.ascontiguousarray(p.buf[take]))])
    return pa.RecordBatch.from_arrays([pa.array(node), text], ["node", "text"])


def places(scanned: DataFrame, sieve: Sieve) -> DataFrame:
    """(node, first) of the nodes that ``sieve`` lets through."""
    def run(batches):
        for b in batches:
            for packed in b.column("packed").to_pylist():
                first = np.frombuffer(packed, PLACE)
                first = first[sieve(np.ascontiguousarray(first["node"]))]
                columns = [pa.array(np.ascontiguousarray(first[c])) for c in PLACE.names]
                yield pa.RecordBatch.from_arrays(columns, list(PLACE.names))

    found = scanned.filter(F.col("kind") == PLACES).select("packed")
    return (found.mapInArrow(run, "node long, none boolean, doc_id long, rid long, line_no long")
            .select("node", F.struct("none", "doc_id", "rid", "line_no").alias("first")))


def removed(rows: DataFrame) -> DataFrame:
    """(rid, line_no) of the lines of (rid, doc_id, text) that are not the first of their component;
    some may come more than once."""
    scanned = keep(scan(rows), "lines")
    stars = keep(scanned.filter(F.col("kind") == KEYS).select(F.col("x").alias("key"), F.col("y").alias("node"), F.col("z").alias("pivot"))
                 .distinct(), "stars")
    sieve = Sieve(stars.select("node").unionAll(stars.select(F.col("pivot").alias("node"))))
    found = linked_stars(stars, line_texts(rows, sieve), LineJoin(), copies=True)
    linked = keep(places(scanned, sieve).join(found, "node").select("component", "first"), "places")
    stays = linked.groupBy("component").agg(F.min("first").alias("stays"))
    later = linked.join(stays, "component").filter("first != stays").select("first.rid", "first.line_no")
    return later.unionAll(scanned.filter(F.col("kind") == GONE).select(F.col("x").alias("rid"), F.col("y").alias("line_no")))


def line_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document of (doc_id, text): doc_id, n_lines, n_removed (and ``kept``, the
    text without the removed lines; null for a null text).

    Null and empty texts have no lines. Rows that repeat id and text are the same document and
    lose the same lines; null ids come last. An empty table gives an empty result."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text"))
    gone = removed(rows).groupBy("rid").agg(F.collect_set("line_no").alias("gone"))  # one text's
    if not with_text:
        gone = gone.select("rid", F.size("gone").cast("long").alias("n_gone"))
        counted = rows.mapInArrow(_counted, "doc_id long, rid long, n_lines long")
        return (counted.join(gone, "rid", "left")
                .select("doc_id", "n_lines", F.coalesce("n_gone", F.lit(0).cast("long")).alias("n_removed")))

    def run(batches):
        for b in batches:
            n = np.concatenate([np.zeros(0, np.int64)] + [np.bincount(lines(p)[2], minlength=p.n) for p in pieces(b.column("text"))])
            every = b.column("gone").to_pylist()
            kept = b.column("text").cast(pa.binary()).to_pylist()
            for i, gone in enumerate(every):
                if gone:
                    gone = set(gone)
                    kept[i] = b"\n".join(x for no, x in enumerate(kept[i].split(b"\n")) if no not in gone)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array([len(x or ()) for x in every], pa.int64()),
                                              pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_removed", "kept"])

    # The lists are small beside the texts, which need no sort this way.
    return (rows.join(gone.hint("shuffle_hash"), "rid", "left").select("doc_id", "text", "gone")
            .mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept string"))


def _counted(batches):
    for b in batches:
        n = np.concatenate([np.zeros(0, np.int64)] + [np.bincount(lines(p)[2], minlength=p.n) for p in pieces(b.column("text"))])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rid"), pa.array(n, pa.int64())], ["doc_id", "rid", "n_lines"])
