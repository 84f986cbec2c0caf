"""Ranked lexical search by range maxima over posting lists.

Documents are read in slices.  A slice has one posting list for each term that is asked for,
in document order, with the term's impact in each document, and a sparse table that gives the
largest impact between any two places of a list.  For a query, an interval of documents is
bounded by the sum of its terms' largest impacts inside it.  The intervals with the highest
bounds are opened first: each is split at the document of its largest single impact, this
document is scored exactly, and the intervals left and right of it get bounds of their own.  An
interval is given up once its bound cannot beat the k-th best document found so far; what a
task has found in one slice prunes the next.

Scores are whole numbers: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its impact
in a document w * ((10^9 tf) div (1000 tf + 12 m)) with m = 75 + ((25 n N) div L).

Queries go to the tasks in blocks of bounded size, each block reads the documents once.

Defined results: a null text has no term; items without a hit give no row; two rows with one
item_id are two queries, each ranked on its own; repeated documents are ranked each, ties by
ascending doc_id, a missing doc_id last; empty tables give no row; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import stored
from orderlens.llm.words import word_pieces

TOP_K = 20
#: Characters of queries that go to the tasks at once.
BLOCK_CHARS = 1 << 21
#: Postings of a slice: its sparse tables take some 60 bytes each.
SLICE_POSTINGS = 1 << 20
#: Intervals opened in one step at most.
WIDEST = 512
NO_ID = np.iinfo(np.int64).max


def terms_of(text: str | None) -> Counter:
    """Each term of a whole text and how often it occurs."""
    found: Counter = Counter()
    for words in word_pieces(text):
        found.update(words)
    return found


class Slice:
    """The posting lists of some documents, in one array by (term, document), and their maxima."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray,
                 counts: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        """``sizes[i]`` entries of ``terms`` and ``counts`` (tf) belong to document i, which has
        ``lengths[i]`` terms; ``weights`` are by term.  A missing id is ``NO_ID``."""
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.n = ids[order], len(ids)
        doc = np.repeat(place, sizes)
        by = np.lexsort((doc, terms))
        self.doc, term, tf = doc[by], terms[by].astype(np.int64), counts[by].astype(np.int64)
        self.key = term * self.n + self.doc
        longest = int(lengths.max(initial=0))
        if 25 * longest * n_docs < 1 << 63:
            m = 75 + 25 * lengths.astype(np.int64) * n_docs // max(1, n_terms)
        else:  # beyond 64 bits
            m = np.array([75 + 25 * int(n) * n_docs // max(1, n_terms) for n in lengths], dtype=np.int64)
        self.impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[order][self.doc]))
        self.start = np.searchsorted(term, np.arange(len(weights) + 1))
        self._tables()

    def _tables(self) -> None:
        """``table[j, i]``: the first place of the largest impact among the 2**j places from i."""
        p = len(self.doc)
        longest = int(np.diff(self.start).max(initial=0))
        self.table = np.empty((max(1, longest.bit_length()), p), dtype=np.int32)
        self.table[0] = np.arange(p)
        for j in range(1, len(self.table)):
            half = 1 << (j - 1)
            left, right = self.table[j - 1, :p - half], self.table[j - 1, half:]
            self.table[j, :p - half] = np.where(self.impact[left] >= self.impact[right], left, right)
            self.table[j, p - half:] = self.table[j - 1, p - half:]  # never asked for
        self.flat = self.table.ravel()
        self.log = np.zeros(longest + 1, dtype=np.int64)
        for j in range(1, longest.bit_length()):
            self.log[1 << j:] = j

    def peaks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest impact, its first place) among the places a to b - 1 of a list; 0 if there is none."""
        p, size = len(self.doc), b - a
        level = self.log[size]
        row = level * p
        left = self.flat[row + np.minimum(a, p - 1)]
        right = self.flat[row + np.maximum(b - (1 << level), 0)]
        first, second = self.impact[left], self.impact[right]
        swap = second > first
        return np.where(size > 0, np.where(swap, second, first), 0), np.where(swap, right, left)


class Best:
    """The k best (score, id) found so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]

    def may_enter(self, bounds: np.ndarray, least_ids: np.ndarray) -> np.ndarray:
        """Which intervals, by their bound and smallest id, may hold a better document."""
        if len(self.scores) < self.k:
            return bounds > 0
        last, last_id = self.scores[-1], self.ids[-1]
        return (bounds > last) | ((bounds == last) & (least_ids < last_id))


def search(part: Slice, terms: np.ndarray, times: np.ndarray, best: Best) -> int:
    """Add the best documents of a slice for one query; returns how many were scored."""
    some = part.start[terms] < part.start[terms + 1]
    terms, times = terms[some], times[some]
    if not len(terms):
        return 0
    base = terms.astype(np.int64) * part.n
    p = len(part.doc)

    def opened(a, b, low):
        value, at = part.peaks(a, b)
        value = value * times
        top = value.argmax(axis=1)
        return value.sum(axis=1), part.doc[at[np.arange(len(at)), top]], a, b, low

    nodes = opened(part.start[terms][None, :], part.start[terms + 1][None, :], np.zeros(1, dtype=np.int64))
    width, scored = 8, 0
    while True:
        keep = best.may_enter(nodes[0], part.ids[np.minimum(nodes[4], part.n - 1)])
        if not keep.any():
            return scored
        if not keep.all():
            nodes = tuple(x[keep] for x in nodes)
        bound = nodes[0]
        rest = None
        if len(bound) > width:
            order = np.argpartition(-bound, width)
            rest = tuple(x[order[width:]] for x in nodes)
            nodes = tuple(x[order[:width]] for x in nodes)
        _, split, a, b, low = nodes
        wanted = base + split[:, None]
        at = np.searchsorted(part.key, wanted)
        here = part.key[np.minimum(at, p - 1)] == wanted
        score = (np.where(here, part.impact[np.minimum(at, p - 1)], 0) * times).sum(axis=1)
        best.add(score, part.ids[split])
        scored += len(split)
        nodes = opened(
            np.concatenate([a, at + here]), np.concatenate([at, b]), np.concatenate([low, split + 1])
        )
        if rest is not None:
            nodes = tuple(np.concatenate([x, y]) for x, y in zip(rest, nodes))
        width = min(WIDEST, 2 * width)


def _postings(docs: DataFrame, numbers) -> DataFrame:
    """doc_id, n (terms with repeats), and number and tf of each asked term, as 32-bit numbers."""

    def read(batches):
        number = numbers.value
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch["text"]:
                found = terms_of(text)
                n.append(found.total())
                met = found.keys() & number.keys()
                terms.append(np.fromiter((number[t] for t in met), dtype="<i4", count=len(met)).tobytes())
                counts.append(np.fromiter((found[t] for t in met), dtype="<i4", count=len(met)).tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n": n, "terms": terms, "counts": counts})

    return docs.select("doc_id", "text").mapInPandas(read, "doc_id bigint, n bigint, terms binary, counts binary")


def _document_counts(postings: DataFrame, size: int) -> np.ndarray:
    """In how many documents each asked term occurs."""

    def add(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["terms"]), dtype="<i4"), minlength=size)
        met = np.nonzero(total)[0]
        yield pd.DataFrame({"term": met, "df": total[met]})

    out = np.zeros(size, dtype=np.int64)
    found = postings.select("terms").mapInPandas(add, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    for row in found.collect():  # at most one row for each term of the block of queries
        out[row["term"]] = row["df"]
    return out


def _search_block(block: pd.DataFrame, docs: DataFrame, k: int, slice_postings: int) -> DataFrame:
    """query, item_id, doc_id, score: the k best of every task for each query of a block."""
    spark = docs.sparkSession
    asked = [terms_of(t) for t in block["text"]]
    number = {t: i for i, t in enumerate(sorted(set().union(*asked)))}
    postings = stored(_postings(docs, spark.sparkContext.broadcast(number)), "postings")
    totals = postings.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["docs"], totals["terms"] or 0
    weights = np.array([
        math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        for df in _document_counts(postings, len(number)).tolist()
    ], dtype=np.int64)
    queries = [
        (q, None if pd.isna(i) else int(i), np.array([number[t] for t in found], dtype=np.int64),
         np.array(list(found.values()), dtype=np.int64))
        for q, i, found in zip(block["query"].tolist(), block["item_id"].astype(object), asked)
    ]
    shared = spark.sparkContext.broadcast((weights, queries))

    def run(batches):
        weights, queries = shared.value
        found = [Best(k) for _ in queries]

        def finish(parts):
            ids = np.concatenate([b["doc_id"].astype("Int64").fillna(NO_ID).to_numpy(dtype=np.int64) for b in parts])
            rows = pd.concat([b[["n", "terms", "counts"]] for b in parts])
            part = Slice(
                ids, rows["n"].to_numpy(dtype=np.int64), rows["terms"].map(len).to_numpy() // 4,
                np.frombuffer(b"".join(rows["terms"]), dtype="<i4"),
                np.frombuffer(b"".join(rows["counts"]), dtype="<i4"), weights, n_docs, n_terms,
            )
            if len(part.doc):
                for (_, _, terms, times), best in zip(queries, found):
                    search(part, terms, times, best)

        held, size = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                size += int(batch["terms"].map(len).sum()) // 4
            if size >= slice_postings:
                finish(held)
                held, size = [], 0
        if held:
            finish(held)
        for (q, item_id, _, _), best in zip(queries, found):
            ids = pd.array(best.ids, dtype="Int64")
            ids[best.ids == NO_ID] = pd.NA
            yield pd.DataFrame({
                "query": q, "item_id": pd.array([item_id] * len(ids), dtype="Int64"), "doc_id": ids, "score": best.scores,
            })

    return postings.mapInPandas(run, "query bigint, item_id bigint, doc_id bigint, score bigint")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP_K, block_chars: int = BLOCK_CHARS,
           slice_postings: int = SLICE_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest score above 0 of every item."""
    asked = stored(
        items.select("item_id", "text").where(F.length("text") > 0)
        .withColumn("query", F.monotonically_increasing_id()), "queries",
    )
    chars = asked.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).toPandas()
        if len(block) or found is None and b == blocks - 1:
            part = stored(_search_block(block, docs, k, slice_postings), "ranked")
            found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score")
    )
