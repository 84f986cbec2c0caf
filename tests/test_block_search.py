import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.operators import block_search as B
from orderlens.operators import retrieval as R

WORDS = [f"w{i}" for i in range(60)]


def made_rows(seed=1, n=400):
    rng = np.random.default_rng(seed)
    chance = 1 / np.arange(1, 61) ** 0.8
    rows = []
    for i in range(n):
        words = rng.choice(WORDS, rng.integers(0, 12), replace=False, p=chance / chance.sum()).tolist()
        rows.append((i, words, rng.random(len(words)).tolist(), float(len(words))))
    rows += [(n + i, *rows[5][1:]) for i in range(100)]  # a fifth of the rows are copies
    return rows


def made_queries(seed=2, n=12):
    rng = np.random.default_rng(seed)
    return {q: {w: float(x) for w, x in zip(rng.choice([*WORDS, "unseen"], 6, replace=False), rng.random(6) + 0.1)}
            for q in range(n)}


def plain(rows, queries, k, overlap):
    out = {}
    for q, asked in queries.items():
        scored = []
        for i, words, weights, size in rows:
            if overlap:
                o = len(set(words) & set(asked))
                score = o + o / (1 + np.sqrt(size)) if o else 0
            else:
                score = sum(asked.get(w, 0) * x for w, x in zip(words, weights))
            if score > 0:
                scored.append((-round(score, 9), i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("overlap", [False, True])
@pytest.mark.parametrize("slice_words, query_words", [(1 << 20, 1 << 20), (200, 20)])
def test_best_rows_equal_brute_force(spark, overlap, slice_words, query_words):
    rows, queries = made_rows(), made_queries()
    frame = spark.createDataFrame(rows, "id bigint, words array<string>, weights array<double>, size double").repartition(3)
    asked = spark.createDataFrame(
        [(q, w, 1.0 if overlap else x) for q, a in queries.items() for w, x in a.items()],
        "query_id bigint, word string, weight double")
    used = frame.drop("weights") if overlap else frame.drop("size")
    got = B.best_rows(used, asked, 5, B.overlap_score if overlap else B.weighted_sum, query_words, slice_words)
    mine = {}
    for r in got.orderBy("query_id", "rank").collect():
        mine.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    want = plain(rows, queries, 5, overlap)
    assert {q: [i for i, _ in v] for q, v in mine.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    for q, v in want.items():
        assert [s for _, s in mine[q]] == pytest.approx([s for _, s in v])


def test_ids_may_be_texts_or_structs(spark):
    frame = spark.createDataFrame([("b", ["x"]), ("a", ["x", "y"]), ("c", ["x"])], "id string, words array<string>")
    asked = spark.createDataFrame([(1, "x", 1.0)], "query_id int, word string, weight double")
    assert [r["id"] for r in B.best_rows(frame, asked, 2).orderBy("rank").collect()] == ["a", "b"]
    pair = frame.select(F.struct(F.length("id").alias("n"), "id").alias("id"), "words")
    assert [tuple(r["id"]) for r in B.best_rows(pair, asked, 2).orderBy("rank").collect()] == [(1, "a"), (1, "b")]
    assert B.best_rows(frame.where("false"), asked, 2).count() == 0
    assert B.best_rows(frame, asked.where("false"), 2).count() == 0


@pytest.mark.parametrize("score", [B.weighted_sum, B.overlap_score])
def test_blocks_stay_closed(score):
    """Rare words decide: most entries of the common ones are never read, and nothing is lost."""
    rng = np.random.default_rng(3)
    n = 20_000
    sets = [np.flatnonzero(rng.random(n) < p) for p in (0.9, 0.8, 0.003, 0.002, 0.002, 0.003)]
    row = np.concatenate(sets)
    word = np.repeat(np.arange(6), [len(s) for s in sets])
    weight = np.ones(len(row)) if score is B.overlap_score else rng.random(len(row)) * np.repeat([0.1, 0.1, 1, 1, 1, 1], [len(s) for s in sets])
    sizes = rng.integers(6, 30, n).astype(float)
    part = B.Blocks(row, word, weight, list(range(n)), sizes, 6, score)
    best = B.Best(4, [])
    read = part.search(np.arange(6), np.ones(6), best)
    total = np.bincount(row, weight, n)
    scores = np.where(total > 0, np.round(score(total, sizes), B.SCORE_DIGITS), 0)
    want = np.lexsort((np.arange(n), -scores))[:4]
    assert [i for _, i in best.found] == want.tolist()
    assert read < len(row) / 4
    assert part.search(np.arange(6), np.ones(6), best) <= read  # what was found prunes from the start


def plan(df):
    return df._jdf.queryExecution().toString()


def test_no_pairs_are_shuffled(spark):
    docs = spark.createDataFrame([(i, f"alpha beta gamma{i % 7}", "s") for i in range(50)], "id bigint, text string, source string")
    asked = spark.createDataFrame([(1, "alpha gamma3")], "query_id bigint, text string")
    index, vocabulary = R.tfidf_index(docs, [])
    assert index.count() == 50 and index.columns == ["id", "words", "weights"]
    text = plan(R.tfidf_search(asked, index, vocabulary, []))
    # what is left is the ranking of k rows per task and query
    assert "Join" not in text and text.count("Window") >= 1 and "WindowGroupLimit" in text
