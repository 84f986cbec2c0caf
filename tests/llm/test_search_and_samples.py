"""Ranked search, importance resampling and language identification against plain versions of them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from orderlens.llm import language, ranked, resample, words

# columns whose names the operators use inside
SCHEMA = ("doc_id bigint, text string, lang string, part int, place string, n int, query string, rank int, "
          "terms string, score int, n_words int, buckets int, rows int, item_id string")
SOME = "the cat sat on the mat while The Dog ran to 42 été gärten".split()


def made_texts(seed=3, n=120):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(SOME) for _ in range(rng.randrange(1, 60))) for _ in range(n)]
    copies = [texts[0]] * 40  # ties
    odd = [None, "", " \t.,", "Cat-cat_CAT\x00dog", "日本 cat日", "x" * 50, " ".join(SOME) * 400]
    return texts + copies + odd


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(made_texts())]
    rows += [(None, "cat mat dog"), (7, "cat cat"), (7, "cat cat")]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(
        [(i, t, None, 1, "p", 2, "q", 3, "t", 4, 5, 6, 7, "x") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, "the cat", 0), (2, "dog dog été unknown", 0), (3, None, 0), (4, "nothingatall", 0), (5, "42 The gärten mat", 0),
         (5, "cat", 0), (None, "mat", 0)], "item_id bigint, text string, score int")


def test_words_are_those_of_the_pattern(monkeypatch):
    monkeypatch.setattr(words, "PIECE", 16)
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for text in made_texts():
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        got = [w.decode() for piece in words.word_pieces(text) for w in piece]
        assert got == pattern.findall(lowered)


# ---- ranked search ----


def plain_ranking(docs, items, k):
    found = [(i, Counter(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))))
             for i, t in docs]
    some = [c for _, c in found if c]
    n_docs, n_terms = len(some), sum(c.total() for c in some)
    df = Counter(t for c in some for t in c)
    out = []
    for item, text in items:
        asked = Counter(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        scores = []
        for i, c in found:
            m = 75 + 25 * c.total() * n_docs // n_terms
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, times in asked.items() if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_postings, block_chars", [(1 << 20, 1 << 20), (50, 40)])
def test_ranking_equals_brute_force(spark, docs, items, empty, slice_postings, block_chars):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    asked = [(r["item_id"], r["text"]) for r in items.collect()]
    got = ranked.ranked(docs, items, 20, block_chars, slice_postings)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranking(rows, asked, 20)
    assert ranked.ranked(empty, items).count() == 0
    assert ranked.ranked(docs, items.where("false")).count() == 0


def random_slice(seed, n=3000, terms=12):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, terms, n)
    which = np.concatenate([rng.choice(terms, s, replace=False) for s in sizes]).astype(np.int32)
    tf = rng.zipf(2.0, len(which)).clip(max=40).astype(np.int32)
    lengths = rng.integers(40, 4000, n)
    ids = rng.permutation(10 * n)[:n].astype(np.int64)
    weights = rng.integers(200, 9000, terms)
    return ids, lengths, sizes, which, tf, weights


def test_tables_give_range_maxima():
    part = ranked.Slice(*random_slice(1), 3000, 6_000_000)
    rng = np.random.default_rng(2)
    for t in range(12):
        lo, hi = part.start[t], part.start[t + 1]
        a = rng.integers(lo, hi + 1, 200)
        b = np.minimum(hi, a + rng.integers(0, 400, 200))
        value, at = part.peaks(a[:, None], b[:, None])
        for i, j, v, p in zip(a, b, value[:, 0], at[:, 0]):
            want = part.impact[i:j]
            assert v == (want.max() if j > i else 0)
            if j > i:
                assert p == i + want.argmax()  # the first of equal ones


def test_search_prunes_and_stays_exact():
    part = ranked.Slice(*random_slice(4), 3000, 6_000_000)
    terms, times = np.array([0, 3, 7, 9]), np.array([1, 2, 1, 1])
    best = ranked.Best(10)
    scored = ranked.search(part, terms, times, best)
    full = np.zeros(part.n, dtype=np.int64)
    for t, q in zip(terms, times):
        at = slice(part.start[t], part.start[t + 1])
        np.add.at(full, part.doc[at], q * part.impact[at])
    order = np.lexsort((part.ids, -full))[:10]
    assert best.scores.tolist() == full[order].tolist() and best.ids.tolist() == part.ids[order].tolist()
    assert 10 <= scored < part.n / 4
    # a second search with what was found opens nothing but ties
    assert ranked.search(part, terms, times, best) < scored


# ---- importance resampling ----


def plain_resample(docs, target, percent, least):
    def words_of(text):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)

    def counted(text):
        w = words_of(text)
        return Counter(zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1))

    raw, goal = Counter(), Counter()
    for _, t in docs:
        raw.update(counted(t))
    for t in target:
        goal.update(counted(t))
    s_all, t_all = raw.total(), goal.total()
    gain = {b: math.floor(1000 * math.log((goal[b] + 1) * (s_all + 10000) / ((raw[b] + 1) * (t_all + 10000)))) for b in raw}
    rows = []
    for i, t in docs:
        c = counted(t)
        weight = sum(gain[b] * n for b, n in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, c.total(), weight, score, len(words_of(t)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = percent * len(able) // 100
    out = [(*r[:4], k if k <= drawn else None) for k, r in enumerate(able, 1)]
    return sorted(out + [(*r[:4], None) for r in rows if not r[4]], key=str)


def test_resampling_equals_brute_force(spark, docs, items, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    target = [r["text"] for r in items.collect()]
    for percent, least in ((5, 20), (40, 3)):
        got = resample.resample(docs, items, percent, least)
        assert dict(got.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
        assert sorted(map(tuple, got.collect()), key=str) == plain_resample(rows, target, percent, least)
    assert resample.resample(empty, items).count() == 0
    assert resample.resample(docs, items.where("false")).count() == len(rows)


def test_runs_cross_pieces(monkeypatch):
    text = "one two three four five six seven eight nine ten"
    whole = [r for _, r in resample.run_hashes(text)]
    monkeypatch.setattr(words, "PIECE", 5)
    pieces = [r for _, r in resample.run_hashes(text)]
    assert len(pieces) > 3
    for n in range(3):
        assert [x for r in pieces for x in r[n]] == whole[0][n]
    assert whole[0][2][0] == zlib.crc32(b"one two three")


# ---- language identification ----


def made_language_rows():
    rng = random.Random(5)
    parts = {"aa": ["ka", "ko", "ki", "to"], "bb": ["sch", "ung", "ä", "ei"], "cc": ["ción", "os", "el", "ñ"]}
    rows = []
    for i in range(600):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 80)))
        rows.append((i, text, lang if i % 5 else None, lang))
    return rows


def test_language_is_found_on_held_out_rows(spark, empty):
    rows = made_language_rows()
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 --", "cc"), (None, "ka ko", "aa"), (1003, "ka ko " * 40_000, None)]
    table = spark.createDataFrame([r[:3] for r in rows] + odd + odd[-1:], "doc_id bigint, text string, lang string") \
        .selectExpr("*", "'x' AS score", "1 AS place", "2 AS rows", "true AS held_out", "'y' AS lang_pred")
    got = language.languages(table).collect()
    assert len(got) == len(rows) + 6
    by = {r["doc_id"]: r for r in got}
    for i, _, _, lang in rows:
        assert by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(by[i]["lang_pred"], lang) for i, _, _, lang in rows if by[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) > 100
    for i in (1000, 1001, 1002):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[1003]["lang_pred"] == "aa" and by[None]["lang_pred"] == "aa" and not by[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in got)
    # labels of held-out rows and unlabelled tables
    assert language.languages(empty).count() == 0
    unlabelled = language.languages(table.withColumn("lang", table["lang"].substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang, '') AS lang"))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_held_out_labels_change_nothing(spark):
    rows = made_language_rows()[:200]
    wrong = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang, _ in rows]
    schema = "doc_id bigint, text string, lang string"
    a, b = (sorted(map(tuple, language.languages(spark.createDataFrame(x, schema), 40).collect()))
            for x in ([r[:3] for r in rows], wrong))
    assert a == b


def test_scorer_equals_the_filters_and_gradients_the_differences():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcä ü"), 700)) for _ in range(6)]
    net = language.train(texts, ["x", "y"] * 3)
    rows = np.concatenate([language.windows_of(language.data_of(t)) for t in texts])
    plain = np.maximum(net.answers(rows).max(axis=1), 0)
    assert np.allclose(language.Scorer(net).pooled(rows), plain, atol=1e-4)
    # the filters themselves, place by place
    x = np.pad(rows, ((0, 0), (0, 3)))
    width, f = 3, language.FILTERS + 1
    want = [max(sum(net.table[j, x[r, i + j], f] for j in range(width)) for i in range(language.WINDOW)) for r in range(3)]
    assert np.allclose(np.maximum(np.array(want) + net.bias[f], 0), plain[:3, f], atol=1e-4)
    labels, share = np.arange(len(rows)) % 2, np.ones(len(rows))
    net = language.Network(net.names, *(p.astype(np.float64) for p in (net.table, net.bias, net.weight, net.offset)))

    def loss():
        p = language.softmax(np.maximum(net.answers(rows).max(axis=1), 0) @ net.weight + net.offset)
        return -np.log(p[np.arange(len(labels)), labels]).mean()

    grads = language._gradients(net, rows, labels, share)
    for param, grad in ((net.weight, grads[2]), (net.bias, grads[1]), (net.table, grads[0] * language.reach()[:, None, :])):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old = param[at]
        param[at] = old + 1e-5
        up = loss()
        param[at] = old - 1e-5
        down = loss()
        param[at] = old
        assert abs((up - down) / 2e-5 - grad[at]) < 1e-3 * abs(grad[at])
