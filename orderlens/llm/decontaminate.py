"""Benchmark decontamination by latent semantic retrieval.

Documents are read in blocks of words; a passage is a run of blocks about as long as the
item it is compared with.  A distributed randomised SVD of the passages' TF-IDF matrix over
the words of the benchmark gives a latent space: every task adds its part of A'A times a
random matrix, and the sum's orthonormal basis spans the leading directions.  Passages whose
latent cosine with an item is high enough are candidates.  A candidate counts as a leak if
the longest common subsequence of its words and the item's covers most of the item, or half
of it together with nearly all of the answer, so that paraphrases that keep the order of
half the words are found.  The answer is a column of that name, or else the item's end.

All passages of all documents enter the counts, the SVD and the search.  The benchmark is
the query set; it is taken in blocks of ``ITEMS_AT_ONCE`` items, whose words bound what is
sent to the tasks.

Defined results: one row per (doc_id, item) with its best passage; rows of equal doc_id are
compared each and reported once, at their best; null and empty texts and items leak nothing;
items of fewer than ``LEAST_WORDS`` words are not looked for, those of more than
``PART_WORDS`` by any of their parts; a document without doc_id is
reported under a null id; empty tables give no row; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import row_key, spare_names, stored

BLOCK = 8
#: Passage widths in blocks, and the longest item in words that each is used for.
WIDTHS = ((3, 20), (5, 40), (8, 1 << 30))
WIDEST = WIDTHS[-1][0]
LATENT, EXTRA = 56, 8
COSINE = 0.62
LCS_SHARE, LCS_SHARE_WITH_ANSWER, ANSWER_SHARE = 0.7, 0.5, 0.8
ANSWER_WORDS = 8
LEAST_WORDS = 8
#: Longer items are looked for in parts of at most so many words, as many as the widest passage has.
PART_WORDS = WIDEST * BLOCK
ITEMS_AT_ONCE = 4_000
#: Items of one matrix product.
ITEMS_TOGETHER = 256
#: Words whose latent rows are gathered at once; longer texts are read in overlapping stretches.
WORDS_AT_ONCE = 1 << 15
SEED = 5

FOUND_SCHEMA = "doc_id bigint, item_id bigint, share double, answer_share double, cosine double, at_word bigint"

# Signs that are not part of a word at its edges.
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’‚…–—·¿¡"


def words_of(text: str | None) -> list[str]:
    """Lower-case words without punctuation around them."""
    return [w for w in (t.strip(EDGES) for t in (text or "").lower().split()) if w]


def word_numbers(texts, vocabulary: dict[str, int]) -> list[np.ndarray]:
    """The word numbers of each text: the vocabulary's, or its size for any other word.

    Lower-casing looks no further than a token, so each distinct token of the texts is read once.
    """
    cut = pc.utf8_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
    coded, other = cut.flatten().dictionary_encode(), len(vocabulary)
    tokens = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    number = np.array([vocabulary.get(w, other) if (w := t.lower().strip(EDGES)) else -1 for t in tokens], dtype="<i4")
    ids = number[coded.indices.to_numpy()]
    words = ids >= 0
    at = np.append(0, np.cumsum(words))[np.append(0, np.cumsum(pc.list_value_length(cut).to_numpy()))].tolist()
    ids = ids[words]
    return [ids[a:b] for a, b in zip(at, at[1:])]


def lcs_length(places: dict, n: int, words) -> int:
    """Length of the longest common subsequence; ``places[w]`` has bit i if item word i is w."""
    full = (1 << n) - 1
    row = full
    for w in words:
        m = places.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def places_of(words) -> dict:
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def numbered(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(doc_id, ids): the word numbers of every text, stored, so that texts are read once."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"),
                                "ids": [ids.tobytes() for ids in word_numbers(batch["text"], vocabulary)]})

    return stored(docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, ids binary"), "word-numbers")


def _chunks(rows, pad: int, overlap: int = 0):
    """Some ten thousand words at a time: (row, offset, first block) of each stretch, and the ids.

    Every stretch starts a block and is followed by ``WIDEST`` blocks of ``pad``, so that no
    passage runs from one text into the next.
    """
    where, parts, held = [], [], 0
    for row, data in enumerate(rows):
        ids = np.frombuffer(data, dtype="<i4")
        for at in range(0, max(len(ids), 1), WORDS_AT_ONCE):
            part = ids[at:at + WORDS_AT_ONCE + overlap]
            if not len(part):
                continue
            room = -(-len(part) // BLOCK) * BLOCK + WIDEST * BLOCK
            where.append((row, at, held // BLOCK))
            parts.append(np.concatenate([part, np.full(room - len(part), pad, dtype=np.int32)]))
            held += room
            if held > WORDS_AT_ONCE:
                yield where, np.concatenate(parts)
                where, parts, held = [], [], 0
    if held:
        yield where, np.concatenate(parts)


def _block_sums(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Sums of the rows of the words of each block, added word by word."""
    words = np.ascontiguousarray(ids.reshape(-1, BLOCK).T)
    out = rows.take(words[0], axis=0)
    for own in words[1:]:
        out += rows.take(own, axis=0)
    return out


def _windows(sums: np.ndarray, width: int) -> np.ndarray:
    """Sums over each run of ``width`` blocks; those past the end are left out."""
    n = len(sums) - width + 1
    out = sums[:n].copy()
    for k in range(1, width):
        out += sums[k:n + k]
    return out


def word_weights(words: DataFrame, v: int) -> np.ndarray:
    """Inverse block frequency of each of ``v`` words."""

    def count(batches):
        seen, blocks = np.zeros(v + 2, dtype=np.int64), 0
        for batch in batches:
            for _, ids in _chunks(batch["ids"], v + 1):
                block = np.sort(ids.reshape(-1, BLOCK), axis=1)
                first = np.ones(block.shape, dtype=bool)
                first[:, 1:] = block[:, 1:] != block[:, :-1]
                seen += np.bincount(block[first], minlength=v + 2)
                blocks += len(ids) // BLOCK
        at = np.nonzero(seen[:v])[0]
        yield pd.DataFrame({"w": np.append(at, -1), "n": np.append(seen[at], blocks)})

    rows = words.select("ids").mapInPandas(count, "w bigint, n bigint").groupBy("w").agg(
        F.sum("n").alias("n")).collect()  # words of one block of items
    number = {r["w"]: r["n"] for r in rows}
    return np.array([log((1 + number.get(-1, 0)) / (1 + number.get(i, 0))) + 0.1 for i in range(v)])


def latent_basis(words: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Orthonormal basis (words x LATENT) of the leading right singular space of the passages."""
    v = len(weights)
    draw = np.random.default_rng(SEED).standard_normal((v, LATENT + EXTRA))
    shared = words.sparkSession.sparkContext.broadcast(_rows(draw * weights[:, None]))
    width = WIDTHS[1][0]

    def multiply(batches):
        turned = shared.value
        out = np.zeros((v, turned.shape[1]))
        for batch in batches:
            for _, ids in _chunks(batch["ids"], v + 1):
                passages = _windows(_block_sums(turned, ids), width)
                # each block gets back the sum of the passages over it
                padded = np.zeros((len(passages) + 2 * (width - 1), passages.shape[1]), dtype=np.float32)
                padded[width - 1:width - 1 + len(passages)] = passages
                given = _windows(padded, width)
                inside = np.nonzero(ids < v)[0]
                inside = inside[np.argsort(ids[inside], kind="stable")]
                own = ids[inside]
                if len(own):
                    starts = np.nonzero(np.append(True, own[1:] != own[:-1]))[0]
                    out[own[starts]] += np.add.reduceat(given[inside // BLOCK], starts, axis=0)
        at = np.nonzero(out.any(axis=1))[0]
        if len(at):  # an empty column would have no lists in it
            yield pd.DataFrame({"w": at, "row": list(out[at])})

    sums = words.select("ids").mapInPandas(multiply, "w bigint, row array<double>").groupBy("w").agg(
        F.array(*[F.sum(F.col("row")[k]) for k in range(LATENT + EXTRA)]).alias("row"))
    product = np.zeros((v, LATENT + EXTRA))
    for r in sums.collect():  # words of one block of items
        product[r["w"]] = r["row"]
    left, size, _ = np.linalg.svd(product * weights[:, None], full_matrices=False)
    basis = np.zeros((v, LATENT))
    basis[:, :min(LATENT, left.shape[1])] = (left * (size > 1e-9))[:, :LATENT]
    return basis


def _rows(matrix: np.ndarray) -> np.ndarray:
    """With rows of zeros for words outside and for padding."""
    return np.vstack([matrix, np.zeros((2, matrix.shape[1]))]).astype(np.float32)


def _search(docs: DataFrame, items: list[tuple[int, list[str], list[str]]]) -> DataFrame:
    """Leaks of one block of items: (item_id, words, words of the answer)."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws, answer in items for w in [*ws, *answer]}))}
    v = len(vocabulary)
    words = numbered(docs, vocabulary)
    weights = word_weights(words, v)
    turned = _rows(latent_basis(words, weights) * weights[:, None])
    coded = [(i, [vocabulary[w] for w in ws], [vocabulary[w] for w in answer]) for i, ws, answer in items]
    shared = docs.sparkSession.sparkContext.broadcast((turned, coded))

    def find(batches):
        turned, items = shared.value
        items = [(i, ids, answer, places_of(ids), places_of(answer)) for i, ids, answer in items]
        groups = []
        for k, (width, longest) in enumerate(WIDTHS):
            shortest = WIDTHS[k - 1][1] if k else 0
            fitting = [i for i in items if shortest < len(i[1]) <= longest]
            for at in range(0, len(fitting), ITEMS_TOGETHER):
                own = fitting[at:at + ITEMS_TOGETHER]
                points = np.array([turned[ids].sum(axis=0) for _, ids, *_ in own])
                norm = np.linalg.norm(points, axis=1, keepdims=True)
                member = np.zeros((v + 2, len(own)), dtype=np.uint8)
                for i, (_, ids, *_) in enumerate(own):
                    member[ids, i] = 1
                lengths = np.array([len(i[1]) for i in own])
                groups.append((
                    width, own, np.ascontiguousarray((points / np.where(norm > 0, norm, 1)).T, dtype=np.float32),
                    member, np.ceil(LCS_SHARE_WITH_ANSWER * lengths), lengths - member.sum(axis=0, dtype=np.int64)))

        def leaks_in(where, ids):
            sums = _block_sums(turned, ids)
            firsts = np.array([w[2] for w in where])
            for width, own, points, member, least, repeats in groups:
                passages = _windows(sums, width)
                norm = np.sqrt(np.einsum("ij,ij->i", passages, passages))[:, None]
                cosine = (passages / np.where(norm > 0, norm, 1)) @ points
                # words of the passage and a block on each side that the item has, 80 at most:
                # no common subsequence is longer
                common = _windows(np.pad(_block_sums(member, ids), ((1, 1), (0, 0))), width + 2)
                # a passage below the bound neither counts nor stands for its neighbour
                near = (cosine >= COSINE) & (common >= np.minimum(least, 255).astype(np.uint8))
                p, i = np.divmod(np.flatnonzero(near), len(own))
                if not len(p):
                    continue
                # of passages one block apart the nearer one stands for both
                here = cosine[p, i]
                best = np.ones(len(p), dtype=bool)
                for beside in (np.maximum(p - 1, 0), np.minimum(p + 1, len(cosine) - 1)):
                    best &= ~near[beside, i] | (here >= cosine[beside, i])
                p, i, here = p[best], i[best], here[best]
                span = np.arange(-BLOCK, (width + 1) * BLOCK)
                for at in range(0, len(p), 4096):
                    q, j = p[at:at + 4096], i[at:at + 4096]
                    around = np.sort(ids[np.clip(q[:, None] * BLOCK + span, 0, len(ids) - 1)], axis=1)
                    # the same bound by different words, the item's own repeats added
                    first = np.ones(around.shape, dtype=np.uint8)
                    first[:, 1:] = around[:, 1:] != around[:, :-1]
                    told_apart = (member[around, j[:, None]] * first).sum(axis=1, dtype=np.int64)
                    for c in np.nonzero(told_apart + repeats[j] >= least[j])[0]:
                        item_id, words, answer, word_places, answer_places = own[j[c]]
                        read = ids[max(0, int(q[c]) - 1) * BLOCK:(int(q[c]) + width + 1) * BLOCK].tolist()
                        share = lcs_length(word_places, len(words), read) / len(words)
                        if share < LCS_SHARE_WITH_ANSWER:
                            continue
                        told = lcs_length(answer_places, len(answer), read) / len(answer)
                        if share >= LCS_SHARE or told >= ANSWER_SHARE:
                            # a passage may start in the padding before its text
                            row, offset, first = where[np.searchsorted(firsts, q[c] + width - 1, side="right") - 1]
                            yield (row, item_id, share, told, float(here[at + c]),
                                   offset + max(0, int(q[c] - first)) * BLOCK)

        for batch in batches:
            rows = [
                (batch["doc_id"].iloc[row], *rest)
                for where, ids in _chunks(batch["ids"], v + 1, (WIDEST + 2) * BLOCK)
                for row, *rest in leaks_in(where, ids)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share", "answer_share", "cosine", "at_word"]) \
                .astype({"doc_id": "Int64", "item_id": "int64"})

    return words.mapInPandas(find, FOUND_SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and the figures of the best passage, one row per leak."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    listed = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        "item_id", "text", answer.alias("answer"))
    groups = max(1, -(-listed.count() // ITEMS_AT_ONCE))
    blocks = []
    for g in range(groups):
        rows = listed.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect()
        items = []
        for r in sorted(rows, key=lambda r: r["item_id"]):
            ws = words_of(r["text"])
            if len(ws) >= LEAST_WORDS:
                told, parts = words_of(r["answer"]) or ws[-ANSWER_WORDS:], -(-len(ws) // PART_WORDS)
                cuts = [len(ws) * k // parts for k in range(parts + 1)]
                items += [(r["item_id"], ws[a:b], told) for a, b in zip(cuts, cuts[1:])]
        if items:
            blocks.append(_search(docs, items))
    # a list of rows, an empty one too, would start Python workers of its own beside those of the search
    none = [f"cast(null as {kind}) as {name}" for name, kind in map(str.split, FOUND_SCHEMA.split(", "))]
    found = reduce(DataFrame.union, blocks) if blocks else docs.sparkSession.range(0).selectExpr(*none)
    best = F.struct("share", "answer_share", "cosine", (-F.col("at_word")).alias("at"))
    return stored(found, "leak-passages").groupBy("doc_id", "item_id").agg(F.max(best).alias("b")).select(
        "doc_id", "item_id", F.col("b.share").alias("lcs_share"), F.col("b.answer_share").alias("answer_share"),
        F.col("b.cosine").alias("cosine"), (-F.col("b.at")).alias("at_word"),
    )


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that leak an item; each row is judged by its own text."""
    key, bad = spare_names(docs, "row_key", "leaking")
    keyed = docs.select(row_key().alias("doc_id"), "text")
    found = stored(leaks(keyed, benchmark).select(F.col("doc_id").alias(bad)).distinct(), "leaking")
    # a shuffle join at every size: leaks grow with the input
    return docs.withColumn(key, row_key()).join(
        found.hint("merge"), F.col(key) == F.col(bad), "left_anti"
    ).select(*docs.columns)
