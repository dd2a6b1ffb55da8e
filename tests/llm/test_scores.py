"""Counting and scoring operators against plain versions and held-out rows."""

from __future__ import annotations

import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.llm import decontaminate, langid, quality, queries, token_counts, toxicity, word_model
from tallyframe.llm.text import SpanHash, pieces

SF = "/root/testdata/sf0.01"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def brute_counts(text):
    w = words_of(text)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines, seen = 0, set()
    for line in (text or "").split("\n"):
        if words_of(line):
            lines += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), lines, len(covered), failed)


def test_base_counts(spark):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "a", "é ü\n\né ü\n x\n x", "# * $ % & | < >", "\x85\xa0  "]
    for _ in range(60):
        texts.append("".join(rng.choice(["ab ", "c", "é ", "\n", "x y z w v\n", "# ", "\t"]) for _ in range(rng.randint(1, 90))))
    df = spark.createDataFrame([(i, t, "en" if i % 3 else None, 1) for i, t in enumerate(texts)],
                               "doc_id long, text string, lang string, kept int")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_counts(t)
        assert not (r.base_failed and r.kept)
    assert quality.quality(df.limit(0)).collect() == []


def test_kneser_ney_sums_to_one(monkeypatch):
    """Every context's probabilities add up to one, in the arrays and in the look-up table,
    and seen grams equal the textbook recursion."""
    monkeypatch.setattr(quality, "BITS", 2)
    rng = random.Random(3)
    seq = [rng.choice([0, 1, 1, 2, 3, 3]) for _ in range(300)]
    c = Counter(seq[i] << 4 | seq[i + 1] << 2 | seq[i + 2] for i in range(298))
    code = np.array(sorted(c), np.int64)
    model = quality.kneser_ney(code, np.array([c[int(x)] for x in code]), 3)
    table = 2.0 ** -quality.Costs(model, 3)(np.arange(64))
    assert np.allclose(table.reshape(-1, 4).sum(axis=1), 1, atol=1e-5)

    def p(level, gram, context):
        counts = levels[level]
        d = quality._discounts(np.array(list(counts.values())))
        mine = {g: n for g, n in counts.items() if g >> 2 == context} if level else counts
        lower = p(level - 1, gram & ((1 << 2 * level) - 1), (gram & ((1 << 2 * level) - 1)) >> 2) if level else 0.25
        if not mine:
            return lower
        total = sum(mine.values())
        cut = sum(d[min(n, 3)] for n in mine.values()) / total
        return (max(0, mine.get(gram, 0) - d[min(mine.get(gram, 0), 3)]) / total) + cut * lower

    two = Counter({g: 0 for g in ()})
    for g in c:
        two[g & 15] += 1
    one = Counter()
    for g in two:
        one[g & 3] += 1
    levels = [one, two, c]
    for gram in range(64):
        assert table[gram] == pytest.approx(p(2, gram, gram >> 2), rel=1e-4)


def test_quality_keeps_good_and_counts_grow(spark):
    got = queries.op5_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert np.mean([r.kept for r in good]) > 0.95
    assert np.mean([r.kept for r in bad]) < np.mean([r.kept for r in good]) - 0.3
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    all_grams, half = quality.gram_counts(docs), quality.gram_counts(docs.filter("doc_id % 2 = 0"))
    assert all_grams.agg({"n": "sum"}).first()[0] == docs.selectExpr("sum(octet_length(text))").first()[0]
    assert all_grams.count() > half.count()


def test_quality_rejects_junk_of_every_language(spark):
    """Junk that passes the base rules (menus, marks on every word, shouting) is rejected in each language,
    while good texts stay."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = [r for r in queries.op5_quality(spark, SF).join(labels, "doc_id").join(docs, "doc_id").collect() if not r.base_failed]
    for lang in {r.lang for r in rows}:
        assert [r.doc_id for r in rows if r.lang == lang and r.quality == 0 and r.kept] == []
        assert np.mean([r.kept for r in rows if r.lang == lang and r.quality == 1]) > 0.9


def test_quality_blocks_of_languages(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 150")
    want = sorted(map(tuple, quality.quality(docs).collect()))
    monkeypatch.setattr(quality, "BLOCK", 1)
    assert sorted(tuple(r) for r in quality.quality(docs).collect()) == want
    kept = {r.doc_id for r in quality.filtered(docs).collect()}
    assert kept == {r[0] for r in want if r[-1]}


def _prose(rng, n, vocabulary=400, follow=3):
    """Texts of a made-up language: each word is followed by one of ``follow`` others."""
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    after = {w: [rng.choice(words) for _ in range(follow)] for w in words}
    out = []
    for _ in range(n):
        text = [rng.choice(words)]
        while len(text) < 120:
            text.append(rng.choice(after[text[-1]]) if rng.random() < .8 else rng.choice(words))
        out.append(text)
    return out


def test_quality_rejects_shuffled_words(spark):
    """The model sees the order of words, in each language, though the shuffled texts are counted too."""
    rng = random.Random(11)
    rows, shuffled = [], set()
    for lang in ("en", None):
        for text in _prose(rng, 150):
            rows.append((len(rows), lang, " ".join(text)))
            if len(rows) % 15 == 0:
                shuffled.add(len(rows))
                rows.append((len(rows), lang, " ".join(rng.sample(text, len(text)))))
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    for lang in ("en", None):
        ids = [i for i, own, _ in rows if own == lang]
        assert [i for i in ids if i in shuffled and got[i].kept] == []
        assert np.mean([got[i].kept for i in ids if i not in shuffled]) > 0.9
    assert all(r.perplexity == pytest.approx(2 ** r.pair_bits) for r in got.values())
    assert {r.doc_id for r in quality.filtered(df).collect()} == {i for i, r in got.items() if r.kept}


def test_word_pairs_equal_plain_kneser_ney(spark, monkeypatch):
    """Sums of the dealt arrays against the recursion over all pairs, a text's own ones left out; null and
    wordless texts, repeated rows, several languages and batches."""
    monkeypatch.setattr(word_model, "DOCS", 16)
    rng = random.Random(12)
    texts = [(lang, " ".join(rng.choice("ab cd ef gh ij kl mn op qr é".split()) for _ in range(rng.randint(1, 40))))
             for lang in ("en", "de", "") for _ in range(25)]
    texts += [("en", None), ("en", " \n"), ("de", ""), texts[0], texts[0], ("en", texts[30][1])]
    df = spark.createDataFrame([(a, t, i if i < 78 else 0, 7) for i, (a, t) in enumerate(texts[:80])] + [("en", texts[80][1], 99, 7)],
                               "lang string, text string, one long, two long").repartition(3)
    got = {r.one: r for r in word_model.score(df, word_model.fit(df)).collect()}
    for lang in ("en", "de", ""):
        docs = [["<s>", *words_of(t)] for a, t in texts if a == lang]
        n = Counter(x for d in docs for x in zip(d, d[1:]))
        before = Counter(w for _, w in n)
        d2, d1 = (word_model.discounts(*(list(c.values()).count(k) for k in (1, 2, 3, 4))) for c in (n, before))
        for i, (a, t) in enumerate(texts):
            if a != lang or not words_of(t):
                continue
            w = ["<s>", *words_of(t)]
            own, pair, single = Counter(zip(w, w[1:])), 0, 0
            for (v, x), k in own.items():
                follow = {y: c for (u, y), c in n.items() if u == v}
                total = sum(follow.values())
                back = sum(d2[min(c, 3)] for c in follow.values()) / total
                lower = ((before[x] - d1[min(before[x], 3)]) / len(n)
                         + sum(d1[min(c, 3)] for c in before.values()) / len(n) / len(before))
                c = n[v, x] - k
                pair -= k * np.log2(min((c - d2[min(c, 3)]) / max(total - k, 1) + back * lower, 1))
                single -= k * np.log2(lower)
            r = got[i if i < 78 else 0 if i < 80 else 99]
            assert (r.pair, r.single) == pytest.approx((pair, single), rel=1e-3)
    assert all(got[i].pair == got[i].single == 0 for i in {75, 76, 77} & set(got))
    assert word_model.score(df.limit(0), word_model.fit(df.limit(0))).collect() == []


def test_language_id_held_out(spark):
    rows = queries.op1_language_id(spark, SF).join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_edges(spark):
    train = spark.createDataFrame([("en", "the cat and the dog " * 5), ("de", "der hund und die katze " * 5), (None, "x"),
                                   ("fr", None)], "lang string, text string")
    model = langid.fit(train)
    texts = [None, "", "123 !?", "the", "DER UND", "a", "щ", "the cat " * 50_000]
    df = spark.createDataFrame([(i, False, t, "z") for i, t in enumerate(texts)] + [(None, None, "und", "z")],
                               "doc_id long, held_out boolean, text string, lang_pred string")
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3
    assert (got[3].lang_pred, got[4].lang_pred, got[7].lang_pred, got[None].lang_pred) == ("en", "de", "en", "de")
    assert {got[5].lang_pred, got[6].lang_pred} <= {"en", "de", "fr"}
    none = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}


def test_bloom_filters_hold_every_gram():
    gram = np.random.default_rng(1).integers(0, 1 << 32, 5000)
    plane = np.zeros(1 << langid.LOG2_SLOTS, np.uint8)
    for a in langid.slots(gram):
        plane[a] |= 4
    hits = langid.Filters(["a", "b", "c"], [plane], np.zeros(3)).hits(gram, np.zeros(5000, np.int64), 1)
    assert hits.tolist() == [[0, 0, 5000]]


def test_toxicity_held_out(spark):
    rows = queries.op3_toxicity(spark, SF).collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([p > n for p in pos for n in neg]) > 0.9


def test_toxicity_edges(spark):
    rows = [("you idiot", 1, 1), ("a fine day", 0, 2), ("idiot clown", 1, 3), ("good day", 0, 4), (None, 0, 5), ("x", None, 6)]
    train = spark.createDataFrame(rows * 20, "text string, toxic int, draw long")
    df = spark.createDataFrame([(1, True, None, 0), (2, True, "", 0), (None, None, "idiot", 0), (4, True, "fine day " * 20_000, 0)],
                               "doc_id long, held_out boolean, text string, score int")
    got = {r.doc_id: r for r in toxicity.score(df, toxicity.fit(train)).collect()}
    assert got[1].score == got[2].score
    assert got[None].predicted == 1 and got[4].predicted == 0
    assert {r.predicted for r in toxicity.score(df, toxicity.fit(train.limit(0))).collect()} == {0}


def greedy(word, vocabulary, longest):
    n = i = 0
    while i < len(word):
        for j in range(min(len(word), i + longest), i, -1):
            if word[i:j] in vocabulary:
                break
        else:
            return 1
        n, i = n + 1, j
    return n


def test_token_automaton_equals_greedy():
    rng = random.Random(1)
    for _ in range(200):
        vocabulary = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 12))}
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9))) for _ in range(30)]
        ends = np.cumsum([len(w) for w in words])
        got = token_counts.lengths(token_counts.build(vocabulary), np.frombuffer(b"".join(words), np.uint8),
                                   ends - [len(w) for w in words], ends)
        assert got.tolist() == [greedy(w, vocabulary, 5) for w in words]


def test_token_counts_of_texts(spark):
    vocabulary = token_counts.read_vocabulary(token_counts.VOCABULARY)
    known, longest = set(vocabulary), max(map(len, vocabulary))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).collect()]
    texts += [None, "", " a  b\n\n c ", "\n", "  x", "é\x00\x85"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "a", 0)],
                               "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_counts.token_counts(df, vocabulary).collect()}
    for i, t in enumerate(texts):
        parts = re.findall(rb" ?[^ \t-\r]+|(?:(?! [^ \t-\r])[ \t-\r])+", (t or "").encode())
        assert b"".join(parts) == (t or "").encode()
        assert (got[i].n_words, got[i].n_tokens) == (len(parts), sum(greedy(w, known, longest) for w in parts))
    assert token_counts.token_counts(df.limit(0), vocabulary).collect() == []


def brute_matches(docs, items, threshold, overlap):
    def tokens(t):
        return [w for w in re.split(rb"[\x00-\x20!-/:-@\[-`{-~]+".replace(rb"\x00-\x20", rb"\x20\x09-\x0d"),
                                    re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) if w]

    texts = {i: tokens(t) for i, t in items}
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    df = Counter(w for t in texts.values() for w in set(t))

    def weight(w, t):
        tf = t.count(w)
        return np.log(1 + (n - df[w] + .5) / (df[w] + .5)) * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(t) / mean))

    def grams(t):
        return {tuple(t[i:i + 5]) for i in range(len(t) - 4)} if len(t) >= 5 else ({tuple(t)} if t else set())

    out = set()
    for d, text in docs:
        t = tokens(text)
        have, mine = set(t), grams(t)
        for i, item in texts.items():
            whole = sum(weight(w, item) for w in set(item))
            if item and sum(weight(w, item) for w in set(item) if w in have) >= threshold * whole - 1e-9:
                if len(grams(item) & mine) >= overlap * len(grams(item)):
                    out.add((d, i))
    return out


def test_decontamination_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_WORDS", 300)  # several index parts
    rng = random.Random(6)
    vocabulary = [f"w{int(rng.paretovariate(.6))}" for _ in range(4000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 20, 40])))) for i in range(60)]
    items += [(90, None), (91, ""), (92, items[0][1]), (-5, items[3][1]), (None, items[4][1])]
    docs = []
    for d in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if d % 3 == 0:
            own = items[rng.randrange(60)][1].split()
            if d % 2:
                own[rng.randrange(len(own))] = "changed"
            w[len(w) // 2:len(w) // 2] = [own[0].upper() + ",", *own[1:]]
        docs.append((d, " ".join(w)))
    docs += [(300, None), (301, ""), (302, items[1][1]), (303, (docs[0][1] + " ") * 300)]
    df = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(df, bench).collect()}
    assert got == brute_matches(docs, items, decontaminate.THRESHOLD, decontaminate.OVERLAP)
    left = {r.doc_id for r in decontaminate.clean(df, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.matches(df, bench.limit(0)).collect() == []
    assert decontaminate.matches(df.limit(0), bench).collect() == []


def test_decontamination_memory_is_bounded(monkeypatch):
    """Neither the items of a part nor the documents of a piece times items set the working memory."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(20)) for _ in range(3000)]
    texts = [items[d] if d % 10 == 0 else " ".join(rng.choice(vocabulary) for _ in range(20)) for d in range(1500)]
    h, d = decontaminate.tokens(next(pieces(pa.array(items, pa.large_string()))))
    terms, df = np.unique(np.array(sorted({*zip(h.tolist(), d.tolist())}), np.uint64)[:, 0], return_counts=True)
    index = decontaminate.build(np.arange(3000), np.zeros(3000, bool), items, [None] * 3000, 3000, 20.0,
                                dict(zip(terms.view(np.int64).tolist(), df.tolist())))
    for cells in (1 << 20, 1 << 17):
        monkeypatch.setattr(decontaminate, "CELLS", cells, raising=False)
        got = set()
        tracemalloc.start()
        for p in pieces(pa.array(texts, pa.large_string())):
            for found in decontaminate._find(index, p, decontaminate.THRESHOLD, decontaminate.OVERLAP, True):
                got |= {(int(x) + p.lo, int(index.item_ids[y])) for x, y in zip(found[0], found[1])}
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got == {(i, i) for i in range(0, 1500, 10)}
        assert peak < 150e6


def test_decontamination_checks_answers(spark):
    bench = spark.createDataFrame([(1, "what is the tallest known tree on earth today", "the coast redwood called hyperion in the park"),
                                   (2, "some other question about rivers and lakes", None)], "id long, q string, a string")
    docs = spark.createDataFrame([(1, "so what is the tallest known tree on earth today then"),
                                  (2, "what is the tallest known tree on earth today the coast redwood called hyperion in the park"),
                                  (3, "some other question about rivers and lakes")], "doc_id long, text string")
    got = decontaminate.matches(docs, bench, item_id="id", question="q", answer="a", threshold=.3)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(2, 1), (3, 2)}


def test_decontamination_finds_short_answers_and_items(spark):
    bench = spark.createDataFrame([(1, "what is the capital city of France today", "Paris"),
                                   (2, "what is six times seven plus nothing", "forty two"), (3, "zebra quagga okapi", None)],
                                  "id long, q string, a string")
    filler = " some more words that say nothing at all"
    texts = ["So what is the capital city of France today? It is Paris, of course." + filler,
             "So what is the capital city of France today? Nobody knows." + filler,
             "what is six times seven plus nothing: Forty-two" + filler, "what is six times seven plus nothing: two forty" + filler,
             "a zebra, quagga, okapi" + filler, "zebra okapi quagga" + filler, "zebra quagga", "okapi"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    columns = dict(item_id="id", question="q", answer="a", threshold=.3)
    got = decontaminate.matches(docs, bench, short_items=True, **columns).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 1), (2, 2), (4, 3)}
    assert all(r.overlap == 1 and r.answer_overlap in (1, None) for r in got)
    left = decontaminate.clean(docs, bench, short_items=True, **columns).collect()
    assert {r.doc_id for r in left} == {1, 3, 5, 6, 7}
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench, **columns).collect()} == {(0, 1), (2, 2)}


def test_pieces_and_hashes():
    texts = ["ab", None, "", "x" * 50, "ab", "é"]
    got = list(pieces(pa.array(texts), 10))
    assert [(p.lo, p.hi) for p in got][0][0] == 0 and got[-1].hi == 6
    assert b"".join(p.buf.tobytes() for p in got) == "".join(t or "" for t in texts).encode()
    h = SpanHash(np.frombuffer(b"abcabc", np.uint8))(np.array([0, 3, 0]), np.array([3, 6, 2]))
    assert h[0] == h[1] != h[2]
