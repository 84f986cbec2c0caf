"""Proportional stratified interleaving: shards that all match the mixture of sources.

Rows are shuffled by a seeded hash within each source, a row's fractional rank there is
(rank + 1/2) / rows of the source, and the order by fractional rank is cut in equal pieces.
Any stretch of that order holds every source in proportion, so every shard does.

Ranks never need one task per source: a range sort gives each row a partition and a place,
and a small table of rows per (source, partition) turns places into ranks.

Defined results: a null source is a source of its own; a null text has size 8 and the crc of
the empty text; a null id is shuffled as the text "null"; repeated rows each get their own
slot; an empty table gives no row; further columns of the input do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import stored, whole_text, with_local_place

SHARDS = 24
ROW_OVERHEAD = 8
SEED = "shard-seed-1"


def shuffle_key(seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _rank_in_source(rows: DataFrame) -> DataFrame:
    """``rank`` of each row within its source and the ``rows`` of the source."""
    placed = with_local_place(
        rows, F.col("source").asc_nulls_first(), "key", "doc_id", "size", "text_crc32",
        label="shuffled-sources",
    )
    counts = placed.groupBy("source", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("place").alias("first_place")
    )
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select(
        F.col("source").alias("s"), F.col("part").alias("p"), "first_place",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("source")).alias("rows"),
    ), "source-offsets")
    return placed.join(
        offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))
    ).withColumn("rank", F.col("before") + F.col("place") - F.col("first_place")).drop(
        "s", "p", "first_place", "before", "part", "place"
    )


def _global_position(ranked: DataFrame) -> DataFrame:
    """``position`` in the order by fractional rank, and ``total``."""
    placed = with_local_place(
        ranked.withColumn("fraction", (F.col("rank") + 0.5) / F.col("rows")),
        "fraction", F.col("source").asc_nulls_first(), "rank", label="interleaved",
    )
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the sort
    offsets = counts.select(
        F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(Window.orderBy("part").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    return placed.join(F.broadcast(offsets), F.col("part") == F.col("p")).withColumn(
        "position", F.col("before") + F.col("place")
    )


def interleaved_shards(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """Shard and slot of every row; shard sizes differ by one row at most."""
    text = whole_text()
    rows = docs.select(
        "doc_id", "source",
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        shuffle_key(seed).alias("key"),
    )
    placed = _global_position(_rank_in_source(rows))
    shard = F.expr(f"position * {shards} div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("position") - first).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"),
        F.col("slot").cast("bigint"), F.lit(None).cast("int").alias("grown_shard"), "source",
    )
