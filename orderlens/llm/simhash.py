"""SimHash near-duplicates with a Gray-order hierarchical index.

A document's fingerprint has bit b set if more than half of its shingle hashes have it.
Fingerprints link at ``RADIUS`` or fewer differing bits; documents linked by any chain form
a component, named by its smallest doc_id.

Equal fingerprints are one class, so copies cost one row.  Two fingerprints within 4 bits
agree on at least one of five bit blocks: the upper nodes of the index are the masked
patterns "these bits of block i", and only members of one upper node are compared.  Inside
a node fingerprints stand in Gray order, where neighbours differ in few bits; runs of them
form lower nodes that keep the bits all members share, and a pair of nodes is dropped with
everything below it once their shared bits differ in more than ``RADIUS`` places.  A node
with more than ``SLICE`` members is cut in slices, and each pair of slices is a task of its
own.  Every upper node reports a spanning forest of its links, not all pairs.

Defined results: null and word-less texts have fingerprint 0 and link like any other; a
repeated row gives one result row each; rows without doc_id get the component of their
fingerprint, null if no row in it has an id; an empty table gives no row; other columns of
the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import hash_partitions, row_key, spare_names, stored
from orderlens.llm.graph import components

WORDS = 4
SEED = 42
RADIUS = 4
#: Bits of each block; one more block than RADIUS, so that one of them always agrees.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
SLICE = 2048
FANOUT = 8


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned 64-bit SimHash of one text.  Only A-Z are lowered, only ASCII space splits."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    width = min(words, len(tokens))
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = (ends - [len(t) + 1 for t in tokens])[: len(tokens) - width + 1].tolist()
    stops = (ends - 1)[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    half, count = len(hashes), np.zeros(64, dtype=np.int64)
    for at in range(0, half, 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > half, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": fps.view(np.int64)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, fp bigint")


def gray_rank(fp: str) -> Column:
    """The place of a fingerprint in the Gray sequence: each bit is the parity of those above."""
    rank = F.col(fp)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank


class GrayIndex:
    """Levels of nodes over Gray-ordered fingerprints: shared bits, and which bits are shared."""

    def __init__(self, fps: np.ndarray):
        self.levels = [(fps, np.full(len(fps), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64))]
        low, high = fps, fps
        while len(low) > FANOUT:
            starts = np.arange(0, len(low), FANOUT)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            self.levels.append((low, ~(low ^ high)))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``nodes``, child) for every child one level down."""
        child = nodes[:, None] * FANOUT + np.arange(FANOUT)
        ok = child < len(self.levels[level - 1][0])
        return np.nonzero(ok)[0], child[ok]


def linked(left: GrayIndex, right: GrayIndex, radius: int, same: bool):
    """Index pairs within ``radius``, walking both trees from the top and pruning whole nodes."""
    depth = min(len(left.levels), len(right.levels)) - 1
    tops = [np.arange(len(x.levels[depth][0])) for x in (left, right)]
    work = [(depth, np.repeat(tops[0], len(tops[1])), np.tile(tops[1], len(tops[0])))]
    while work:
        level, i, j = work.pop()
        if same:
            i, j = i[i <= j], j[i <= j]
        bits_i, shared_i = (x[i] for x in left.levels[level])
        bits_j, shared_j = (x[j] for x in right.levels[level])
        near = np.bitwise_count((bits_i ^ bits_j) & shared_i & shared_j) <= radius
        i, j = i[near], j[near]
        if level == 0:
            yield (i[i < j], j[i < j]) if same else (i, j)
            continue
        for at in range(0, len(i), 1 << 14):  # bounded work in memory
            a, b = i[at:at + (1 << 14)], j[at:at + (1 << 14)]
            pair, a = left.children(level, a)
            b = b[pair]
            pair, b = right.children(level, b)
            work.append((level - 1, a[pair], b))


def spanning_links(fps: np.ndarray, side: np.ndarray, cross: bool, radius: int):
    """A spanning forest of the links of one upper node, or of two slices of it."""
    if cross:
        first, second = np.nonzero(side == side.min())[0], np.nonzero(side != side.min())[0]
        found = linked(GrayIndex(fps[first]), GrayIndex(fps[second]), radius, False)
        found = ((first[i], second[j]) for i, j in found)
    else:
        index = GrayIndex(fps)
        found = linked(index, index, radius, True)
    root = np.arange(len(fps))
    for i, j in found:
        while True:  # each link pulls both ends to the smaller root
            low = np.minimum(root[i], root[j])
            if (root[i] == low).all() and (root[j] == low).all():
                break
            now = root.copy()
            np.minimum.at(now, root[i], low)
            np.minimum.at(now, root[j], low)
            while (now[now] != now).any():
                now = now[now]
            root = now
    tied = np.nonzero(root != np.arange(len(fps)))[0]
    return fps[tied], fps[root[tied]]


def links_between(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect every pair within ``radius``."""
    blocks = F.array(*[
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", at).bitwiseAND(
            F.lit((1 << width) - 1)).alias("bits"))
        for k, (at, width) in enumerate(BLOCKS)
    ])
    nodes = classes.select("fp", F.explode(blocks).alias("n")).select("fp", "n.block", "n.bits")
    large = stored(
        nodes.groupBy("block", "bits").agg(
            F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices")
        ).where(F.col("slices") > 1), "large-nodes",
    )
    side = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
    tiles = (
        nodes.join(large, ["block", "bits"], "left")
        .withColumn("slices", F.coalesce("slices", F.lit(1)))
        .withColumn("side", side)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .withColumns({"lo": F.least("side", "other"), "hi": F.greatest("side", "other")})
    )
    key = ["block", "bits", "lo", "hi"]

    def run(batches):
        def report(part: pd.DataFrame):
            a, b = [], []
            fps = part["fp"].to_numpy().view(np.uint64)
            side = part["side"].to_numpy()
            ids = part[key].to_numpy()
            cuts = np.nonzero((ids[1:] != ids[:-1]).any(axis=1))[0] + 1
            for start, stop in zip([0, *cuts], [*cuts, len(part)] if len(part) else []):
                cross = ids[start, 2] != ids[start, 3]
                own = side[start:stop]
                if stop - start < 2 or cross and own.min() == own.max():
                    continue
                x, y = spanning_links(fps[start:stop], own, cross, radius)
                a.append(x)
                b.append(y)
            a = np.concatenate(a) if a else np.empty(0, np.uint64)
            b = np.concatenate(b) if b else np.empty(0, np.uint64)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        kept = None  # rows of the node that the next batch may go on with: two slices at most
        for batch in batches:
            if not len(batch):
                continue
            part = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            last = (part[key] == part[key].iloc[-1]).all(axis=1).to_numpy()
            kept = part[last]
            yield report(part[~last])
        if kept is not None:
            yield report(kept)

    n = hash_partitions(classes.sparkSession)
    return (
        tiles.withColumn("gray", gray_rank("fp")).select("fp", "side", "gray", *key)
        .repartition(n, *key).sortWithinPartitions(*key, "gray")
        .mapInPandas(run, "a bigint, b bigint")
    )


def _components(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, component) of every fingerprint in ``prints``."""
    if radius > RADIUS:
        raise ValueError(f"the blocks find links of up to {RADIUS} bits")
    classes = stored(prints.select("fp").distinct(), "fp-classes")
    parts = stored(components(links_between(classes, radius)), "components")
    return stored(
        classes.join(parts, F.col("fp") == F.col("node"), "left")
        .select("fp", F.coalesce("component", "fp").alias("component")), "named-classes",
    )


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    named = _components(prints, radius)
    # the smallest id of each fingerprint first: copies fold in their own tasks
    least = stored(
        prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(named, "fp")
        .groupBy("component").agg(F.min("least").alias("component_id")), "least-ids",
    )
    names = named.join(least, "component").select("fp", "component_id")
    return prints.join(names, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Exactly one row of each component of ``docs``.

    It is the row with the smallest doc_id, a missing one last; of several texts under that id the
    one with the smallest hash, of repeated rows any one.
    """
    key, own = spare_names(docs, "row_key", "own_key")
    # the row's key takes the place of the id; ids come back by it
    rows = stored(docs.select("doc_id", row_key().alias("key")).distinct(), "row-keys")
    prints = stored(fingerprints(docs.select(row_key().alias("doc_id"), "text"), words), "fingerprints")
    named = _components(prints, radius)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    chosen = stored(
        prints.groupBy(F.col("doc_id").alias("key"), "fp").agg(F.count(F.lit(1)).alias("copies"))
        .join(named, "fp").join(rows, "key")
        .groupBy("component").agg(F.min_by(F.struct("key", "copies"), order).alias("row"))
        .select(F.col("row.key").alias(own), F.col("row.copies").alias("copies")), "chosen-rows",
    )
    keyed = docs.withColumn(key, row_key())

    def rows_of(which: DataFrame) -> DataFrame:
        # a shuffle join at every size: what stays grows with the input
        return keyed.join(which.select(own).hint("merge"), F.col(key) == F.col(own), "left_semi")

    once = rows_of(chosen.where(F.col("copies") == 1)).select(*docs.columns)
    repeated = chosen.where(F.col("copies") > 1)
    if repeated.isEmpty():
        return once
    return once.unionByName(rows_of(repeated).dropDuplicates([key]).select(*docs.columns))
