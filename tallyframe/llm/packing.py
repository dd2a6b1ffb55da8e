"""Best-fit packing of documents into sequences by a configuration linear program.

Documents become token ids and an end id; only longer ones than a sequence are cut. What is
packed is the histogram of piece lengths: one count for each length up to the capacity, so the
program is as large as the capacity and not as the corpus. A configuration is a multiset of
lengths that fits a sequence; the program covers every length's count with as few as it can.

Multiplicative weights solve it: a length's price is its size times a factor that shrinks as
the length gets covered, a knapsack dynamic program finds the dearest configurations, and each
takes a share of what its lengths still lack. Rounding keeps whole uses of each configuration;
what is left over (bounded by the number of configurations) goes by best fit on counts: equal
sequences are one entry, however many they are. Prices start slightly above proportion, so
small lengths are spared for the end.

Configurations lay out the sequences. A piece's rank among the pieces of its length then gives
its sequence and place by one binary search in a table whose size the rounds bound.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.order import running
from tallyframe.llm.store import keep
from tallyframe.llm.token_counts import MOST_TOKENS, read_vocabulary

CAPACITY = 2048
# The byte-level vocabulary of 50,257 ids as ranks; its one special token has none here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 0

ROUNDS = 400        # prices tried
PER_ROUND = 100     # configurations taken at one price
STEP = 0.2          # share of its scarcest length that a configuration takes
RATE = 0.1          # how far coverage moves a price
SLACK = 0.0005      # a configuration this far below the dearest is as good
SPARE = 0.02        # prices grow with the length to the power of one and this

Configuration = tuple[tuple[int, int], ...]   # (length, how often)


def _knapsack(lengths: np.ndarray, price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to ``capacity``: the best worth, and the length to take first (-1: as
    with one less). Of equal worth the longest is taken."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    back, worth = lengths[::-1], price[::-1]
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        skip = len(lengths) - fit[room]
        if skip < len(lengths):
            value = best[room - back[skip:]] + worth[skip:]
            at = int(value.argmax())
            if value[at] > best[room]:
                best[room], take[room] = value[at], len(lengths) - 1 - skip - at
    return best, take


def _configuration(first: int, lengths: np.ndarray, take: np.ndarray, step: np.ndarray, capacity: int) -> Counter:
    """The dearest configuration that holds ``lengths[first]``, by index of length."""
    found, room = Counter({first: 1}), int(step[capacity - lengths[first]])
    while room > 0:
        found[int(take[room])] += 1
        room = int(step[room - lengths[take[room]]])
    return found


def relaxed(count: np.ndarray, capacity: int) -> dict[Configuration, float]:
    """Configurations and how often each is used, not rounded, by multiplicative weights.
    ``count[n]`` pieces have the length ``n``; no length is covered beyond its count."""
    lengths = np.flatnonzero(count[:capacity + 1])
    want = count[lengths].astype(float)
    left, uses = want.copy(), defaultdict(float)
    for _ in range(ROUNDS):
        open_ = np.flatnonzero(left > 0)
        if not len(open_):
            break
        some = lengths[open_]
        price = (some / capacity) ** (1 + SPARE) * np.exp(RATE * (left[open_] / want[open_] - 1))
        best, take = _knapsack(some, price, capacity)
        step = np.maximum.accumulate(np.where(take >= 0, np.arange(capacity + 1), 0))
        worth = price + best[capacity - some]
        order = np.argsort(-worth, kind="stable")
        taken = 0
        for first in order[worth[order] >= (1 - SLACK) * best[capacity]]:
            one = _configuration(int(first), some, take, step, capacity)
            at, times = open_[list(one)], np.fromiter(one.values(), float)
            room = (left[at] / times).min()
            if room <= 0:
                continue
            amount = min(STEP * (want[at] / times).min(), room)
            left[at] -= amount * times
            left[at[left[at] < 1e-9 * want[at]]] = 0
            uses[tuple(sorted((int(some[i]), n) for i, n in one.items()))] += amount
            taken += 1
            if taken == PER_ROUND:
                break
    return uses


def best_fit(count: np.ndarray, capacity: int) -> dict[Configuration, int]:
    """Best fit of the longest first, on counts: sequences with the same contents are one entry.
    Each length splits one entry at most, so the work grows with the lengths, not the pieces."""
    room: dict[int, Counter] = defaultdict(Counter)   # space left: contents, how many
    spaces: list[int] = []

    def put(space: int, contents: Configuration, n: int) -> None:
        if n:
            if not room[space]:
                bisect.insort(spaces, space)
            room[space][contents] += n

    for length in map(int, np.flatnonzero(count)[::-1]):
        n = int(count[length])
        while n:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):   # new sequences, full of this length
                each = capacity // length
                put(capacity - each * length, ((length, each),), n // each)
                if n % each:
                    put(capacity - n % each * length, ((length, n % each),), 1)
                break
            space = spaces[at]
            contents, many = room[space].popitem()
            if not room[space]:
                spaces.pop(at)
            into = min(n, many)
            put(space, contents, many - into)
            held = dict(contents)
            held[length] = held.get(length, 0) + 1
            put(space - length, tuple(sorted(held.items())), into)
            n -= into
    done: Counter = Counter()
    for entries in room.values():
        done.update(entries)
    return done


def solve(count: np.ndarray, capacity: int) -> list[tuple[Configuration, int]]:
    """Configurations and whole uses that hold every piece of the histogram exactly once."""
    count = count.astype(np.int64).copy()
    whole: Counter = Counter()
    if len(count) > capacity and count[capacity]:
        whole[((capacity, 1),)] = int(count[capacity])
        count[capacity] = 0
    for one, times in sorted(relaxed(count, capacity).items()):
        times = min([int(times + 1e-6), *[int(count[length]) // n for length, n in one]])
        if times > 0:
            whole[one] += times
            for length, n in one:
                count[length] -= times * n
    whole.update(best_fit(count, capacity))
    return sorted(whole.items())


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END,
                 with_ids: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document: its ids and the end
    id, cut only if longer than ``capacity``, into pieces of that length after a first one that
    may be shorter. Null and empty texts are the end id alone; repeated rows count each by
    themselves; a very long text is held whole, with its ids, by one task."""
    tokens = read_vocabulary(vocabulary)
    if len(tokens) > MOST_TOKENS:
        raise ValueError(f"a vocabulary of more than {MOST_TOKENS} tokens is not broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        import tiktoken
        ranks = {t: i for i, t in enumerate(shared.value)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            out: list[list] = [[] for _ in fields]
            for doc, value in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = np.array([*encode(value.as_py() or ""), end], "<u4")
                start, stop, piece = 0, (len(ids) - 1) % capacity + 1, 0
                while start < len(ids):
                    part = ids[start:stop]
                    row = [doc, piece, start, stop - start, zlib.crc32(part.tobytes())] + [part.astype(np.int64)] * with_ids
                    for column, x in zip(out, row):
                        column.append(x)
                    start, stop, piece = stop, stop + capacity, piece + 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], fields)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def pack(pieces: DataFrame, order: list[Column], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length``, 1 to ``capacity``) plus ``sequence_id`` and ``offset``: each
    sequence is filled from 0 without gaps. ``order`` makes the pieces of one length
    comparable; pieces equal in it may swap places. Columns of those two names are replaced;
    an empty table gives an empty result."""
    pieces = keep(pieces.drop("sequence_id", "offset"), "pieces")
    seen = pieces.groupBy("length").agg(F.count("*").alias("n"))
    bad = seen.filter(F.col("length").isNull() | (F.col("length") < 1) | (F.col("length") > capacity))
    if bad.limit(1).count():
        raise ValueError(f"lengths must be from 1 to {capacity}")
    count = np.zeros(capacity + 1, np.int64)
    for row in seen.collect():   # one row a length
        count[row.length] = row.n
    # Where the pieces of a length go, as runs of their ranks, numbered through all lengths.
    runs, first = defaultdict(list), 0
    for one, times in solve(count, capacity):
        place = 0
        for length, n in one:
            runs[length].append((first, n, place, times))
            place += n * length
        first += times
    begin, base, each, places = [], [], [], []
    before = np.concatenate([[0], np.cumsum(count)])
    for length in sorted(runs):
        at = int(before[length])
        for sequence, n, place, times in runs[length]:
            for column, x in zip((begin, base, each, places), (at, sequence, n, place)):
                column.append(x)
            at += n * times
    table = [np.array(c, np.int64) for c in (before, begin, base, each, places)]
    shared = pieces.sparkSession.sparkContext.broadcast(table)
    ranked = running(pieces.withColumn("_one", F.lit(1).cast("long")), order, "_one", "_rank", by="length").drop("_one")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        before, begin, base, each, places = shared.value
        for b in batches:
            if b.num_rows == 0:
                continue
            length = b.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            number = before[length] + b.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(begin, number, side="right") - 1
            nth = number - begin[at]
            names = [n for n in b.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [b.column(n) for n in names] + [pa.array(base[at] + nth // each[at]), pa.array(places[at] + nth % each[at] * length)],
                names + ["sequence_id", "offset"])

    return ranked.select(*pieces.columns, "_rank").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) of pieces packed with their ids; a group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return (packed.groupBy("sequence_id").agg(parts.alias("parts"))
            .select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids")))


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents (see ``token_pieces``) with their places (see ``pack``)."""
    pieces = token_pieces(docs, capacity, vocabulary, with_ids=with_ids)
    return pack(pieces, [F.col("doc_id").asc_nulls_last(), F.col("piece"), F.col("ids_crc32")], capacity)
