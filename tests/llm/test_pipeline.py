"""The whole corpus pipeline over the smallest tables."""

from collections import defaultdict

import corpus_pipeline
from orderlens.llm import toxicity

SF = "/root/testdata/sf0.001"


def test_all_stages_together(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    # ten toxic rows to learn from are few: what the operator itself rejects has to go
    scores = toxicity.toxicity(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    toxic = {r["doc_id"] for r in scores.where("predicted = 1").collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = corpus_pipeline.run(spark, SF).collect()
    kept = {r["doc_id"] for r in rows}
    assert kept <= set(docs) and len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)
    assert toxic
    # toxic documents go, and of equal texts one stays
    assert not kept & toxic
    copies = defaultdict(set)
    for i, text in docs.items():
        copies[text].add(i)
    # (line dedup empties later copies: one empty document stands for all of them)
    assert sum(max(0, len(same & kept) - 1) for same in copies.values()) <= 1
    # documents that hold a benchmark item word by word go
    leaking = {i for i, t in docs.items() if t and any(" ".join(x.split()) in " ".join(t.split()) for x in items)}
    assert not kept & leaking
    # what is labelled clean, has no copy and no item stays
    single = {i for same in copies.values() if len(same) == 1 for i in same}
    good = (clean & single) - leaking - toxic
    assert len(kept & good) >= 0.9 * len(good) > 10
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= 2048


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
