"""Token counts by a linear longest-match automaton.

The vocabulary (byte strings) is a trie. Every node has a failure link and the number of
tokens that greedy longest match pops when it follows that link, so a word is read once, byte
by byte, without backing up and without building its pieces: a byte either goes down the trie
or pops tokens along failure links. What is left at a word's end pops along the links to the
root. A word that the vocabulary cannot spell is one unknown token.

A text is cut into words with the space before them, and runs of the remaining white space,
which together are all its bytes; longest match runs in each from the left. Within a task each
distinct word is read once: words are looked up by 64-bit hash in a table of bounded size.
The automaton is broadcast; its size is that of the vocabulary file, a documented parameter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.text import SPACE, U, SpanHash, pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
REMEMBER = 1_000_000   # words a task keeps the counts of
MOST_TOKENS = 1_000_000


@dataclass
class Automaton:
    keys: np.ndarray     # sorted node * 256 + byte
    child: np.ndarray
    fail: np.ndarray     # by node; -1: the vocabulary cannot go on
    pops: np.ndarray     # tokens popped on the failure link
    end: np.ndarray      # tokens popped at a word's end; -1: cannot be spelled


def read_vocabulary(path: str) -> list[bytes]:
    """Tokens of a file of base64 strings with ranks."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


def build(vocabulary: Iterable[bytes]) -> Automaton:
    """The automaton of the vocabulary; empty tokens are ignored, repeated ones count once."""
    down: list[dict[int, int]] = [{}]
    token = [False]
    n = 0
    for word in vocabulary:
        if not word:
            continue
        n += 1
        if n > MOST_TOKENS:
            raise ValueError(f"a vocabulary of more than {MOST_TOKENS} tokens is not broadcast")
        at = 0
        for byte in word:
            if byte not in down[at]:
                down[at][byte] = len(down)
                down.append({})
                token.append(False)
            at = down[at][byte]
        token[at] = True
    fail, pops = [-1] * len(down), [0] * len(down)
    level = [0]
    while level:  # breadth first: links go to shallower nodes
        following = []
        for u in level:
            for byte, v in down[u].items():
                following.append(v)
                if token[v]:
                    fail[v], pops[v] = 0, 1
                elif u:
                    at, popped = fail[u], pops[u]
                    while at >= 0 and byte not in down[at]:
                        popped += pops[at]
                        at = fail[at]
                    if at >= 0:
                        fail[v], pops[v] = down[at][byte], popped
        level = following
    end = [0] * len(down)
    for v in range(1, len(down)):
        at, popped = v, 0
        while at > 0:
            popped += pops[at]
            at = fail[at]
        end[v] = popped if at == 0 else -1
    edges = sorted((u << 8 | byte, v) for u, d in enumerate(down) for byte, v in d.items())
    keys, child = zip(*edges) if edges else ((), ())
    return Automaton(np.array(keys, np.int64), np.array(child, np.int64), np.array(fail, np.int64),
                     np.array(pops, np.int64), np.array(end, np.int64))


def lengths(a: Automaton, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Tokens of each span, all spans read side by side."""
    order = np.argsort(start - end, kind="stable")  # longest first: those still open are a prefix
    first, size = start[order], (end - start)[order]
    count = np.zeros(len(order), np.int64)
    state = np.zeros(len(order), np.int64)
    lost = np.zeros(len(order), bool)
    last = len(a.keys) - 1
    for t in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -t, side="left"))  # spans longer than t
        todo = np.flatnonzero(~lost[:n])
        byte = buf[first[todo] + t].astype(np.int64)
        while len(todo):
            key = state[todo] << 8 | byte
            at = np.minimum(np.searchsorted(a.keys, key), max(last, 0))
            ok = a.keys[at] == key if last >= 0 else np.zeros(len(key), bool)
            state[todo[ok]] = a.child[at[ok]]
            todo, byte = todo[~ok], byte[~ok]
            count[todo] += a.pops[state[todo]]
            state[todo] = a.fail[state[todo]]
            gone = state[todo] < 0
            lost[todo[gone]] = True
            todo, byte = todo[~gone], byte[~gone]
    left = a.end[np.where(lost, 0, state)]
    out = np.empty(len(order), np.int64)
    out[order] = np.where(lost | (left < 0), 1, count + left)
    return out


def pretokens(p) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document): words with a space right before them, runs of other white space."""
    n = len(p.buf)
    z = np.zeros(0, np.int64)
    if n == 0:
        return z, z, z
    space = SPACE[p.buf]
    begins = np.zeros(n + 1, bool)
    begins[p.offs] = True
    begins = begins[:-1]
    follows = np.zeros(n, bool)   # a word starts right after this byte, in the same document
    follows[:-1] = ~space[1:] & ~begins[1:]
    lead = space & follows & (p.buf == 32)
    kind = space & ~lead          # the byte belongs to a run of white space
    cut = begins | lead
    cut[1:] |= (kind[1:] != kind[:-1]) & ~lead[:-1]
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], n), p.doc_of(start)


def token_counts(docs: DataFrame, vocabulary: Iterable[bytes], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_words, n_tokens) by document; words include runs of white space.
    Null and empty texts have none. Repeated rows count each by themselves; an empty table
    gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(build(vocabulary))

    def run(batches):
        known, sizes = np.zeros(0, U), np.zeros(0, np.int64)
        for b in batches:
            for p in pieces(b.column("text")):
                start, end, doc = pretokens(p)
                h, first, which = np.unique(SpanHash(p.buf)(start, end), return_index=True, return_inverse=True)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                seen = known[at] == h if len(known) else np.zeros(len(h), bool)
                size = np.empty(len(h), np.int64)
                size[seen] = sizes[at[seen]]
                new = first[~seen]
                size[~seen] = lengths(shared.value, p.buf, start[new], end[new])
                if len(known) + len(new) > REMEMBER:
                    known, sizes = h, size
                elif len(new):
                    both = np.concatenate([known, h[~seen]])
                    order = np.argsort(both, kind="stable")
                    known, sizes = both[order], np.concatenate([sizes, size[~seen]])[order]
                cut = b.slice(p.lo, p.n)
                yield pa.RecordBatch.from_arrays(
                    [cut.column("doc_id"), pa.array(np.diff(p.offs)),
                     pa.array(np.bincount(doc, minlength=p.n).astype(np.int64)),
                     pa.array(np.bincount(doc, weights=size[which], minlength=p.n).astype(np.int64))],
                    ["doc_id", "n_bytes", "n_words", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_words long, n_tokens long")
