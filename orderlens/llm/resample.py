"""Importance resampling towards a target distribution over hashed word n-grams.

A 256-byte table lowers and blanks separators, ``bytes.split`` yields the words, and chained
``zlib.crc32`` seeds extend a run of words by one word without joining it.  Runs of one to
three words are the features, their CRC modulo ``BUCKETS`` the buckets.  A Counter reduces a
document to one number for each bucket it meets; these rows are stored, so that no text is
read twice.  The two histograms, of the raw texts and of the target, are ``BUCKETS`` numbers
each, whatever the corpus; their log ratio is the gain of a bucket and the sum of gains the
weight of a document.  Gumbel noise from a hash of the document's id makes the highest scores
a draw without replacement.

The draw is ranked over range partitions with offsets, so no task sorts all documents.

Defined results: a null or empty text has no feature and weight 0; a missing doc_id is hashed
as the empty text and ranks after others of its score; repeated rows are documents of their
own; with an empty raw table there is no row, with an empty target every gain compares with a
flat distribution; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import stored, with_local_place
from orderlens.llm.words import word_pieces

BUCKETS = 10_000
LONGEST_RUN = 3
SEED = 42
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
PERCENT = 5


def run_hashes(text: str | None, longest: int = LONGEST_RUN) -> Iterator[tuple[int, list[list[int]]]]:
    """(words, CRCs of the runs that end in them, one list for each run length) of the pieces of a text.

    The CRC of a run is that of the run one word shorter, carried on over a blank and the next word.
    """
    last: list[list[int]] = [[] for _ in range(longest)]  # of each length, the run that ends in the last word
    for words in word_pieces(text):
        if not words:
            continue
        spaced = [b" " + w for w in words]
        runs = [list(map(crc32, words))]
        for n in range(1, longest):
            # a run of n + 1 words that ends in word i goes on from the run of n words that ends in word i - 1
            before = last[n - 1] + runs[n - 1]
            first = len(words) + 1 - len(before)
            runs.append(list(map(crc32, islice(spaced, first, None), before)) if first < len(words) else [])
        for n in range(longest):
            last[n] = runs[n][-1:]
        yield len(words), runs


def features(texts: DataFrame, *keep: str, buckets: int = BUCKETS) -> DataFrame:
    """n_words, n_features and the bucket counts of every row, beside the columns ``keep``.

    ``buckets`` and ``counts`` hold unsigned 32-bit little-endian numbers, one for each bucket met,
    so that a row is bounded by the number of buckets however long its text is.
    """

    def count(batches):
        for batch in batches:
            words, total, met, times = [], [], [], []
            for text in batch.pop("text"):
                n, seen = 0, Counter()
                for m, runs in run_hashes(text):
                    n += m
                    at = np.fromiter(chain.from_iterable(runs), dtype=np.uint32)
                    seen.update((at % np.uint32(buckets)).tolist())
                words.append(n)
                total.append(seen.total())
                met.append(np.fromiter(seen.keys(), dtype="<u4", count=len(seen)).tobytes())
                times.append(np.fromiter(seen.values(), dtype="<u4", count=len(seen)).tobytes())
            yield batch.assign(n_words=words, n_features=total, buckets=met, counts=times)

    kept = "".join(f"{name} {texts.schema[name].dataType.simpleString()}, " for name in keep)
    return texts.select(*keep, "text").mapInPandas(
        count, f"{kept}n_words bigint, n_features bigint, buckets binary, counts binary"
    )


def _histogram(counted: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs; every task sends one row for each bucket it has met."""

    def add(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            at = np.frombuffer(b"".join(batch["buckets"]), dtype="<u4")
            np.add.at(total, at, np.frombuffer(b"".join(batch["counts"]), dtype="<u4"))
        met = np.nonzero(total)[0]
        yield pd.DataFrame({"bucket": met, "n": total[met]})

    found = (
        counted.select("buckets", "counts").mapInPandas(add, "bucket bigint, n bigint")
        .groupBy("bucket").agg(F.sum("n").alias("n"))
    )
    out = np.zeros(buckets, dtype=np.int64)
    for row in found.collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of target to raw frequency of each bucket."""
    k, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k))))
        for s, t in zip(raw.tolist(), target.tolist())
    ], dtype=np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from a hash of seed and id."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(counted: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and n_words of every row of ``features``."""

    def weigh(batches):
        for batch in batches:
            ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"].astype(object)]
            weight = [
                int(gain[np.frombuffer(b, dtype="<u4")] @ np.frombuffer(n, dtype="<u4").astype(np.int64))
                for b, n in zip(batch["buckets"], batch["counts"])
            ]
            yield pd.DataFrame({
                "doc_id": pd.array(ids, dtype="Int64"), "n_features": batch["n_features"], "weight": weight,
                "score": [w + noise(i, seed) for w, i in zip(weight, ids)], "n_words": batch["n_words"],
            })

    schema = "doc_id bigint, n_features bigint, weight bigint, score bigint, n_words bigint"
    return counted.select("doc_id", "n_words", "n_features", "buckets", "counts").mapInPandas(weigh, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document's features, weight and score, and the rank of those drawn.

    ``docs`` has doc_id and text, ``target`` text.  Of the N documents with ``least_words``
    words, the floor(percent * N / 100) with the highest score are drawn.
    """
    counted = stored(features(docs, "doc_id", buckets=buckets), "features")
    gain = gains(_histogram(counted, buckets), _histogram(features(target, buckets=buckets), buckets))
    scored = stored(weighted(counted, gain, seed), "weights")
    able = F.col("n_words") >= least_words
    placed = with_local_place(
        scored.where(able).drop("n_words"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), label="ranked-weights"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range partition
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
    )
    drawn = placed.count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    rank = F.col("before") + F.col("place") + 1
    ranked = placed.join(F.broadcast(parts), "part").select(
        *columns, F.when(rank <= drawn, rank).cast("bigint").alias("rank")
    )
    return ranked.unionByName(
        scored.where(~able).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    )
