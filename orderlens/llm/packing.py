"""Best-fit packing with exact-complement hashing.

Documents become token ids plus an end id; only documents longer than a sequence are cut,
the remainder first, then whole sequences.  What matters for packing is how many pieces
there are of each length, at most ``capacity`` numbers: they come to the driver, and the
plan made of them says which lengths share sequences and how often.  Sums of one, two and
three available lengths are indexed, combinations that exactly fill the gap beside a piece
are used up as often as all their lengths are available, and what is left goes best-fit.

Pieces meet the plan by their rank among pieces of the same length.  A rank is the piece's
place in its task plus the pieces of earlier tasks, so no length, however common, has to be
ranked in one task.

Defined results: a null or empty text is the end id alone; repeated rows and rows without
doc_id are packed like any other; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.chunks import ChunkEncoder, grouped
from orderlens.llm.common import stored

CAPACITY = 2048
END_ID = 0
#: (length, ranks from, ranks to, first sequence, offset): piece ``from + i`` of that length
#: stands at ``offset`` in sequence ``first + i``.
Slot = tuple[int, int, int, int, int]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """Places for ``counts[length]`` pieces of each length, in as few sequences as it can."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    bins: list[tuple[tuple[int, ...], int]] = []  # lengths together, times

    def use(*lengths: int) -> None:
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(left[x]) // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
        bins.append((lengths, times))

    open_bins: list[tuple[int, tuple[int, ...], int]] = []
    for length in range(capacity, 0, -1):
        while left[length]:
            others = _complement(left, length, capacity - length)
            if others is None:
                break
            use(length, *others)
        # no exact fill from here on: lengths only become scarcer
    for length in np.nonzero(left)[0][::-1].tolist():
        n = int(left[length])
        while n:
            # the fullest open sequences with room come first
            fit = min((b for b in open_bins if b[0] >= length), default=None)
            if fit is None:
                per = capacity // length
                if n >= per:
                    times = n // per
                    open_bins.append((capacity - per * length, (length,) * per, times))
                    n -= times * per
                else:
                    open_bins.append((capacity - n * length, (length,) * n, 1))
                    n = 0
                continue
            open_bins.remove(fit)
            room, inside, times = fit
            per = room // length
            full = min(times, n // per)
            if full:
                open_bins.append((room - per * length, inside + (length,) * per, full))
                n -= full * per
            elif n:
                open_bins.append((room - n * length, inside + (length,) * n, 1))
                full, n = 1, 0
            if times > full:
                open_bins.append((room, inside, times - full))
    bins += [(inside, times) for _, inside, times in open_bins]

    slots: list[Slot] = []
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in bins:
        offset = 0
        for length in lengths:
            start = used.get(length, 0)
            slots.append((length, start, start + times, sequence, offset))
            used[length] = start + times
            offset += length
        sequence += times
    return slots


def _complement(left: np.ndarray, length: int, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to ``gap``, the largest first."""
    if gap == 0:
        return ()
    have = left.copy()
    have[length] -= 1
    if gap < len(have) and have[gap] > 0:
        return (gap,)
    some = have > 0

    def pair(total: int, free: np.ndarray) -> tuple[int, int] | None:
        top = np.arange(total - 1, (total - 1) // 2, -1)
        ok = free[top] & free[total - top]
        if total % 2 == 0 and have[total // 2] == 1:
            ok &= top != total // 2
        found = np.nonzero(ok)[0]
        return (int(top[found[0]]), int(total - top[found[0]])) if len(found) else None

    two = pair(gap, some)
    if two:
        return two
    for first in np.nonzero(some[:gap - 1])[0][::-1].tolist():
        have[first] -= 1
        two = pair(gap - first, have > 0)
        have[first] += 1
        if two:
            return (first, *two)
    return None


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first may be shorter."""
    head = n % capacity or capacity
    return [(0, head)] + [(at, capacity) for at in range(head, n, capacity)]


def _pieces(docs: DataFrame, encoder: Callable[[], ChunkEncoder], end_id: int, capacity: int,
            keep_ids: bool) -> DataFrame:
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, "
              "place bigint") + (", ids binary" if keep_ids else "")

    def run(batches):
        part, seen, encode = TaskContext.get().partitionId(), {}, encoder()
        for batch in grouped(batches):
            rows = []
            for doc_id, ids in zip(batch["doc_id"].astype(object), encode.encode(batch["text"])):
                ids += end
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                for no, (start, length) in enumerate(cut_pieces(len(ids) // 4, capacity)):
                    data = ids[4 * start:4 * (start + length)]
                    place = seen[length] = seen.get(length, -1) + 1
                    row = (doc_id, no, start, length, zlib.crc32(data), part, place)
                    rows.append(row + ((data,) if keep_ids else ()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place", "ids"]
            out = pd.DataFrame(rows, columns=names[: 7 + keep_ids])
            yield out.astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, schema)


def pack(docs: DataFrame, vocabulary: str, spaces: bool = True, end_id: int = END_ID,
         capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and offset; ``keep_ids`` adds the ids themselves."""
    pieces = stored(
        _pieces(docs, lambda: ChunkEncoder.shared(vocabulary, spaces), end_id, capacity, keep_ids),
        "pieces",
    )
    per_task = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select(
        "length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in
              pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = np.array(sorted(plan(counts, capacity)), dtype=np.int64).reshape(-1, 5)
    # at most a few slots per length; ranks of a length lie side by side
    key = slots[:, 0] * (1 << 45) + slots[:, 1]
    shared = docs.sparkSession.sparkContext.broadcast((key, slots))

    def place(batches):
        key, slots = shared.value
        for batch in batches:
            rank = batch.pop("rank").to_numpy()
            at = np.searchsorted(key, batch["length"].to_numpy() * (1 << 45) + rank, side="right") - 1
            batch["sequence_id"] = slots[at, 3] + rank - slots[at, 1]
            batch["offset"] = slots[at, 4]
            yield batch

    columns = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    ids = ", ids binary" if keep_ids else ""
    return (
        pieces.join(offsets, ["length", "part"])
        .withColumn("rank", F.col("before") + F.col("place"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "rank")
        .mapInPandas(place, f"{columns}{ids}, sequence_id bigint, offset bigint")
    )
