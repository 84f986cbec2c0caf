"""Words and word pairs of a corpus, numbered in blocks of texts.

A task cuts its texts into blocks and counts terms as numbers of the block's own list, so a
word is spelt once in a block however many texts hold it.  The lists are met in buckets of
terms, where each term gets its number of texts; what goes back to a block is that number
for each place of its list.  So no row for each text and term is ever shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions import text as X
from orderlens.session import staged

#: Words of a block of texts; characters whose terms share a bucket.
BLOCK_WORDS, BUCKET_CHARS = 1 << 20, 1 << 23

# Lists of numbers travel as bytes and terms as lines: a list of a thousand elements is one value.
_LISTS = "bucket int, terms string, copies binary"
_FOUND = "block bigint, bucket int, texts binary, places binary, terms string, listed array<struct<term: string, df: int>>"


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)


def _of_pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first * np.uint64(0x9E3779B97F4A7C15) + second
    return mixed ^ (mixed >> np.uint64(29))


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def _lines(terms: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Terms, which hold no line break, as one text for each list."""
    return pc.binary_join(_lists(terms, sizes), "\n")


def _terms(column: pa.ChunkedArray, sizes: np.ndarray) -> pa.Array:
    """The terms of all lists, whose sizes are known: an empty one reads like one empty term."""
    return pc.split_pattern(column.combine_chunks().filter(pa.array(sizes > 0)).cast(pa.string()), "\n").flatten()


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Numbers in lists of the given sizes, as bytes."""
    offsets = (4 * np.append(0, np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype("<i4"))])


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, and the size of each."""
    held = column.combine_chunks().cast(pa.binary())
    ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset:held.offset + len(held) + 1]
    data = held.buffers()[2]
    values = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.empty(0, np.uint8)
    return np.frombuffer(values.tobytes(), "<i4").astype(np.int64), np.diff(ends) // 4


def _steps(owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rising places of each owner as the first and the steps from there."""
    step = np.diff(place, prepend=0)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    step[first] = place[first]
    return step


def _places(step: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What ``_steps`` was made of."""
    upto, some = np.cumsum(step), sizes[sizes > 0]
    first = np.cumsum(some) - some
    return upto - np.repeat(upto[first] - step[first], some)


def _counted(group: np.ndarray, value: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, value, copies) of each distinct pair, by group."""
    keys, copies = np.unique(group * max(1, values) + value, return_counts=True)
    return keys // max(1, values), keys % max(1, values), copies


def number_terms(text: np.ndarray, row: np.ndarray, words: pa.Array, buckets: int):
    """Terms of a block: (text, place, copies) entries by text, and its list of terms by bucket.

    ``text`` and ``row`` number the text and the row that each word is of; a pair lies in one row.
    """
    encoded = words.dictionary_encode()
    code, spelt = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary
    n = len(spelt)
    hashed = _hashes(spelt)
    near = np.flatnonzero(row[1:] == row[:-1])
    pairs, pair = np.unique(code[near] * max(1, n) + code[near + 1], return_inverse=True)
    first, second = pairs // max(1, n), pairs % max(1, n)
    terms = pa.concat_arrays([spelt, pc.binary_join_element_wise(spelt.take(pa.array(first)), spelt.take(pa.array(second)), " ")])
    bucket = (np.concatenate([hashed, _of_pairs(hashed[first], hashed[second])]) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    w, p = _counted(text, code, n), _counted(text[near], pair, len(pairs))
    owner, at, copies = (np.concatenate(x) for x in zip((w[0], place[w[1]], w[2]), (p[0], place[n + p[1]], p[2])))
    order = np.argsort(owner * len(by) + at)
    return (owner[order], at[order], copies[order]), terms.take(pa.array(by)), bucket[by]


def term_blocks(texts: DataFrame, key: str, stop_words: list[str], buckets: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of two kinds, staged: a text (block, key, places, counts), or a bucket of a block's terms.

    Rows of one key are one text, and lie in one block.
    """
    kind = texts.schema[key].dataType
    rows = (
        texts.where(F.col("text").isNotNull()).select(F.col(key).alias("id"), "text")
        .repartition("id").sortWithinPartitions("id")
        .select("id", X.content_words(F.col("text"), stop_words).alias("words"))
    )
    schema = f"block bigint, id {kind.simpleString()}, places binary, counts binary, {_LISTS}"

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        block, id_type = TaskContext.get().partitionId() << 32, to_arrow_type(kind)
        types = [pa.int64(), id_type, pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.binary()]
        names = ["block", "id", "places", "counts", "bucket", "terms", "copies"]

        def batch(n, **columns):
            return pa.RecordBatch.from_arrays(
                [columns[c].cast(t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names=names)

        def finish(table, ids):
            words = table.column("words").combine_chunks()
            lengths = np.diff(words.offsets.to_numpy())
            starts = np.array([True, *(a != b for a, b in zip(ids, ids[1:]))])
            row = np.repeat(np.arange(len(lengths)), lengths)
            text = np.repeat(np.cumsum(starts) - 1, lengths)
            flat = words.flatten().cast(pa.string())
            if not len(flat):
                return
            (owner, place, copies), terms, bucket = number_terms(text, row, flat, buckets)
            some, sizes = np.unique(owner, return_counts=True)
            keys = table.column("id").combine_chunks().take(pa.array(np.flatnonzero(starts)[some]))
            yield batch(len(some), block=pa.array(np.full(len(some), block)), id=keys,
                        places=_packed(_steps(owner, place), sizes), counts=_packed(copies, sizes))
            used, sizes = np.unique(bucket, return_counts=True)
            yield batch(len(used), block=pa.array(np.full(len(used), block)), bucket=pa.array(used),
                        terms=_lines(terms, sizes), copies=_packed(np.bincount(place, minlength=len(terms)), sizes))

        held, ids, size = [], [], 0
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            ids += b.column("id").to_pylist()
            size += len(b.column("words").flatten())
            if size >= block_words:
                cut = len(ids)
                while cut and ids[cut - 1] == ids[-1]:  # more rows of the last text may follow
                    cut -= 1
                if cut:
                    table = pa.Table.from_batches(held)
                    yield from finish(table.slice(0, cut), ids[:cut])
                    block += 1
                    held, ids = table.slice(cut).combine_chunks().to_batches(), ids[cut:]
                    size = sum(len(h.column("words").flatten()) for h in held)
        if held:
            yield from finish(pa.Table.from_batches(held), ids)

    return staged(rows.mapInArrow(run, schema), "term-blocks")


def in_buckets(terms: DataFrame, buckets: int) -> DataFrame:
    """Terms (distinct) with their bucket."""

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            spelt = b.column("term").cast(pa.string())
            parts = pd.Series(spelt.to_pylist()).str.split(" ", n=1, expand=True).reindex(columns=[0, 1])
            hashed, pair = _hashes(pa.array(parts[0], pa.string())), parts[1].notna().to_numpy()
            hashed[pair] = _of_pairs(hashed[pair], _hashes(pa.array(parts[1][pair], pa.string())))
            yield pa.RecordBatch.from_arrays(
                [pa.array((hashed % np.uint64(buckets)).astype(np.int32)), spelt], names=["bucket", "term"])

    return terms.select("term").mapInArrow(run, "bucket int, term string")


def text_counts(blocks: DataFrame, asked: DataFrame | None) -> DataFrame:
    """For each block and bucket, how many texts hold each of its terms; staged.

    ``places`` and ``terms`` name the terms among ``asked`` (bucket, term), or all.  A row without
    a block has those terms of its bucket in ``listed``, with their numbers of texts.
    """
    lists = blocks.where(F.col("bucket").isNotNull()).select("block", "bucket", "terms", "copies")
    every = asked is None

    names = ["block", "bucket", "texts", "places", "terms", "listed"]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.list_(pa.struct([("term", pa.string()), ("df", pa.int32())]))]

    def count(left: pa.Table, right: pa.Table | None) -> pa.Table:
        copies, sizes = _numbers(left.column("copies"))
        encoded = _terms(left.column("terms"), sizes).dictionary_encode()
        code, known = encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary
        total = np.bincount(code, copies, len(known)).astype(np.int64)
        wanted = (np.ones(len(known), bool) if right is None else
                  pc.is_in(known, right.column("term").combine_chunks().cast(pa.string())).to_numpy(zero_copy_only=False))
        ends = np.cumsum(sizes)
        hit = np.flatnonzero(wanted[code])
        owner = np.searchsorted(ends, hit, side="right")
        each = np.bincount(owner, minlength=len(sizes))
        once = np.flatnonzero(wanted)
        listed = pa.StructArray.from_arrays([known.take(pa.array(once)), pa.array(total[once], pa.int32())], ["term", "df"])
        n, bucket = len(sizes), left.column("bucket").combine_chunks()
        columns = [
            left.column("block").combine_chunks(), bucket, _packed(total[code], sizes),
            _packed(hit - (ends - sizes)[owner], each), _lines(known.take(pa.array(code[hit])), each), pa.nulls(n, types[-1]),
        ]
        of_bucket = [pa.nulls(1, types[0]), bucket.slice(0, 1), *[pa.nulls(1, t) for t in types[2:-1]], _lists(listed, [len(once)])]
        return pa.Table.from_arrays([pa.concat_arrays([c.cast(t), o]) for c, o, t in zip(columns, of_bucket, types)], names=names)

    empty = pa.table([pa.nulls(0, t) for t in types], names=names)
    if every:
        found = lists.groupBy("bucket").applyInArrow(lambda left: count(left, None), _FOUND)
    else:
        found = lists.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(
            lambda left, right: count(left, right) if len(left) else empty, _FOUND)
    return staged(found, "text-counts")


def unit_weights(blocks: DataFrame, counts: DataFrame, total: int, every: bool) -> DataFrame:
    """id, words and weights of each text: (1 + ln n) * idf, scaled by all its terms to unit length.

    Of the words those that ``counts`` names are listed; a text with none is left out unless ``every``.
    """
    texts = blocks.where(F.col("bucket").isNull()).select("block", "id", "places", "counts")
    known = counts.where(F.col("block").isNotNull())
    schema = f"id {blocks.schema['id'].dataType.simpleString()}, words array<string>, weights array<double>"

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        texts, sizes = _numbers(right.column("texts"))
        idf = np.log((1.0 + total) / (1.0 + texts)) + 1
        at, each = _numbers(right.column("places"))
        number = np.full(len(idf), -1)
        number[np.repeat(np.cumsum(sizes) - sizes, each) + at] = np.arange(len(at))
        spelt = _terms(right.column("terms"), each)
        steps, lengths = _numbers(left.column("places"))
        place, n = _places(steps, lengths), _numbers(left.column("counts"))[0]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        weight = (1.0 + np.log(n.astype(float))) * idf[place]
        norm = np.sqrt(np.bincount(owner, weight * weight, len(lengths)))
        shown = number[place] >= 0
        size = np.bincount(owner[shown], minlength=len(lengths))
        words = _lists(spelt.take(pa.array(number[place][shown])), size)
        weights = pa.ListArray.from_arrays(words.offsets, pa.array((weight / norm[owner])[shown]))
        out = pa.table({"id": left.column("id"), "words": words, "weights": weights})
        return out if every else out.filter(pa.array(size > 0))

    return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(weigh, schema)
