"""Top-k search over rows of weighted words, pruned by the maxima of blocks.

Rows stay where they are: a task reads its own rows in slices and keeps, for each query, the k
best it has found.  In a slice the rows are cut into blocks, and every word that is asked for
has its largest weight in each block.  Summed over a query's words these maxima bound the
score of every row of a block.  Blocks are opened from the highest bound down, their rows
scored exactly, and the rest is left closed once its bound is below the k-th best score; what
one slice has found prunes the next.  What leaves a task is k rows for each query, so neither
pairs of queries and rows nor the words of the corpus are shuffled.

The words of a block of queries travel to the tasks: queries come in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.session import staged

#: Rows of a block, words of the rows of a slice (about 40 bytes each).
BLOCK_ROWS, SLICE_WORDS = 16, 1 << 20
#: Query words that go to the tasks at once.
QUERY_WORDS = 200_000
#: Digits that scores are compared by; sums in another order differ behind them.
SCORE_DIGITS = 9


def weighted_sum(total: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The score of a row: the sum itself."""
    return total


def overlap_score(total: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words in common, and the more for a short row.

    As a bound: a row with ``total`` words in common has at least as many words itself.
    """
    return total + total / (1 + np.sqrt(np.maximum(total, size)))


@dataclass
class Best:
    """The k best (score, id) of a query, ties to the smaller id."""

    k: int
    found: list[tuple[float, object]]

    def least(self) -> float:
        """No row below this score can enter."""
        return self.found[-1][0] if len(self.found) == self.k else 0.0

    def add(self, scores: np.ndarray, ids: list) -> None:
        self.found = sorted([*self.found, *zip(scores.tolist(), ids)], key=lambda f: (-f[0], f[1]))[: self.k]


class Blocks:
    """The asked words of some rows by (word, row), and their maxima by (word, block)."""

    def __init__(self, row: np.ndarray, word: np.ndarray, weight: np.ndarray, ids: list, sizes: np.ndarray,
                 words: int, score: Callable = weighted_sum, block_rows: int = BLOCK_ROWS):
        by = np.lexsort((row, word))
        self.row, self.weight, word = row[by], weight[by], word[by]
        self.ids, self.sizes, self.score = ids, sizes, score
        self.blocks = -(-len(ids) // block_rows)
        key = word.astype(np.int64) * self.blocks + self.row // block_rows
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        self.start = np.append(first, len(key))
        self.peak = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.block = key[first] % max(1, self.blocks)
        self.of_word = np.searchsorted(key[first] // max(1, self.blocks), np.arange(words + 1))
        self.least_size = np.minimum.reduceat(sizes, np.arange(0, len(ids), block_rows)) if len(ids) else sizes

    def search(self, words: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Add the best rows for one query; returns how many word entries were read."""
        lists = [np.arange(self.of_word[w], self.of_word[w + 1]) for w in words]
        entry = np.concatenate(lists) if lists else np.empty(0, np.int64)
        if not len(entry):
            return 0
        times = np.repeat(weights, [len(x) for x in lists])
        block = self.block[entry]
        bound = self.score(np.bincount(block, times * self.peak[entry], self.blocks), self.least_size)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        read, at, width = 0, 0, 4
        slack = 10.0 ** -SCORE_DIGITS
        while at < len(order) and bound[order[at]] + slack >= best.least():
            chosen = np.zeros(self.blocks, dtype=bool)
            chosen[order[at:at + width]] = True
            mine = chosen[block]
            start, size = self.start[entry[mine]], np.diff(self.start)[entry[mine]]
            ends = np.cumsum(size)
            place = np.repeat(start - ends + size, size) + np.arange(ends[-1])
            read += len(place)
            rows, which = np.unique(self.row[place], return_inverse=True)
            total = np.bincount(which, np.repeat(times[mine], size) * self.weight[place])
            scores = np.round(self.score(total, self.sizes[rows]), SCORE_DIGITS)
            enter = (scores >= best.least()) & (scores > 0)
            if enter.sum() > best.k:  # the k-th best and all that tie with it, in the order of ids
                enter &= scores >= np.partition(scores[enter], -best.k)[-best.k]
            best.add(scores[enter], [self.ids[r] for r in rows[enter]])
            at, width = at + width, 2 * width
        return read


def best_rows(rows: DataFrame, queries: DataFrame, k: int, score: Callable = weighted_sum,
              query_words: int = QUERY_WORDS, slice_words: int = SLICE_WORDS) -> DataFrame:
    """query_id, id, score and rank of the k best rows of every query with a score above 0.

    ``rows`` has id, words (array of distinct strings), weights (array, or absent: 1 each) and
    size (for ``score``, or absent); ``queries`` has query_id, word and weight, one row a word.
    """
    spark = rows.sparkSession
    asked = staged(queries.select("query_id", "word", F.col("weight").cast("double").alias("weight")), "query-words")
    blocks = max(1, -(-asked.count() // query_words))
    types = {n: rows.schema["id"].dataType if n == "id" else queries.schema["query_id"].dataType for n in ("query_id", "id")}
    schema = f"query_id {types['query_id'].simpleString()}, id {types['id'].simpleString()}, score double"
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()
        if len(block):
            part = staged(_search_block(block, rows, k, score, schema, slice_words), "best-rows")
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _search_block(block: pd.DataFrame, rows: DataFrame, k: int, score: Callable, schema: str, slice_words: int) -> DataFrame:
    words = sorted(block["word"].unique())
    number = pd.Series(range(len(words)), index=words)
    asked = [
        (query, number[part["word"]].to_numpy(), part["weight"].to_numpy())
        for query, part in block.groupby("query_id", sort=True)
    ]
    shared = rows.sparkSession.sparkContext.broadcast((words, asked))
    have = set(rows.columns)
    read = rows.select("id", "words", *(c for c in ("weights", "size") if c in have))
    # Spark turns an Arrow struct into rows of the declared type
    out = [(f.name, f.dataType) for f in rows.sparkSession.createDataFrame([], schema).schema]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        words, asked = shared.value
        known = pa.array(words, pa.string())
        best = [Best(k, []) for _ in asked]

        def finish(held):
            ids = [i for b in held for i in _ids(b.column("id"))]
            sizes = np.concatenate([_numbers(b, "size") for b in held])
            row, word, weight, at = [], [], [], 0
            for b in held:
                entries = b.column("words")
                lengths = np.diff(entries.offsets.to_numpy())
                found = pc.fill_null(pc.index_in(entries.flatten().cast(pa.string()), known), -1).to_numpy()
                hit = found >= 0
                row.append((at + np.repeat(np.arange(len(lengths)), lengths))[hit])
                word.append(found[hit])
                weight.append(b.column("weights").flatten().to_numpy()[hit] if "weights" in have else np.ones(hit.sum()))
                at += len(b)
            part = Blocks(np.concatenate(row), np.concatenate(word), np.concatenate(weight), ids, sizes, len(words), score)
            for (_, terms, weights), b in zip(asked, best):
                part.search(terms, weights, b)

        held, size = [], 0
        for b in batches:
            if len(b):
                held.append(b)
                size += len(b.column("words").flatten())
            if size >= slice_words:
                finish(held)
                held, size = [], 0
        if held:
            finish(held)
        for (query, _, _), b in zip(asked, best):
            if b.found:
                values = [[query] * len(b.found), [i for _, i in b.found], [s for s, _ in b.found]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, to_arrow_type(t)) for v, (_, t) in zip(values, out)], names=[n for n, _ in out])

    return read.mapInArrow(run, schema)


def _ids(column: pa.Array) -> list:
    """Ids that compare as Spark compares them: numbers, texts, or tuples for structs."""
    if pa.types.is_struct(column.type):
        return list(zip(*(column.field(i).to_pylist() for i in range(column.type.num_fields))))
    return column.to_pylist()


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False) if name in batch.schema.names else np.zeros(len(batch))

