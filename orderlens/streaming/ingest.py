"""Incremental ingest: chronological slices, state, and a stream into gold tables.

A slice is found by a keyset filter on (purchase time, order id), so a run reads
forward from its watermark instead of sorting and skipping what it already has.
The stream rebuilds exactly the orders a micro-batch touches, whichever of the
child tables brought the change, and upserts them.
"""

from __future__ import annotations

import functools
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orderlens.functions import scalar as S
from orderlens.operators.features import feature_table
from orderlens.operators.order_level import build_order_level
from orderlens.operators.quantiles import with_global_rank
from orderlens.schemas import FEATURES_TABLE, ORDERS_TABLE
from orderlens.session import passing_stages, release_shuffles, staged
from orderlens.sources import snapshots
from orderlens.sources.writers import key_part, merge_rows, period_part, read_upserted, upsert_table

DEFAULT_BATCH_SIZE = 2000
#: Cells of time that are counted at once, and rows that one task may put in order.
TIME_CELLS, SMALL_CELL = 4_096, 100_000
ORDER_CHILDREN = ("items", "payments", "reviews")
#: Children are cut to exactly the changed orders up to this share of all orders.
CUT_SHARE = 0.25
#: Size of a filter of many changed orders: bits for each, the most in all (8 MB), words in a row.
FILTER_BITS, MOST_BITS, FILTER_WORDS = 16, 1 << 26, 256


@dataclass(frozen=True)
class IngestState:
    """How far the chronological read has come."""

    cursor: int = 0  # orders ingested
    runs: int = 0
    last_purchase_ts: str | None = None  # latest purchase time of the last batch
    key_ts: str | None = None  # sort key of the last ingested order
    key_id: str | None = None


_STATE_SCHEMA = (
    "cursor bigint, runs bigint, last_purchase_ts string, key_ts string, key_id string"
)


def load_state(spark: SparkSession, path: str) -> IngestState:
    """The saved state, or a fresh one."""
    if not snapshots.exists(spark, path):
        return IngestState()
    row = spark.read.schema(_STATE_SCHEMA).json(path).first()
    return IngestState(**row.asDict()) if row else IngestState()


def save_state(spark: SparkSession, path: str, state: IngestState) -> None:
    """Save after the load; a crash in between repeats a batch, which upserts the same rows."""
    spark.createDataFrame([tuple(asdict(state).values())], _STATE_SCHEMA).coalesce(1).write.mode(
        "overwrite"
    ).json(path)


def _purchase_time():
    return S.parse_timestamp(F.col("order_purchase_timestamp"))


def pending_orders(orders: DataFrame, state: IngestState) -> DataFrame:
    """Orders behind the state's key in (time, id) order; unknown times come last."""
    if state.key_id is None:
        return orders
    moment = _purchase_time()
    beyond_id = F.col("order_id") > F.lit(state.key_id).cast(orders.schema["order_id"].dataType)
    if state.key_ts is None:
        return orders.where(moment.isNull() & beyond_id)
    mark = F.lit(state.key_ts).cast("timestamp_ntz")
    return orders.where(moment.isNull() | (moment > mark) | ((moment == mark) & beyond_id))


def slice_end(pending: DataFrame, batch_size: int) -> Row | None:
    """(micros, order_id) of the ``batch_size``-th pending order by (time, id); None if there are fewer.

    Orders are counted by time in ``TIME_CELLS`` cells, the cell that holds the rank is counted
    again in finer ones, until it holds few rows or a single moment.  Only the rows of that cell
    are put in order: few ones at once, many orders of one moment in ranges over the cluster.
    """
    keys = pending.select(F.unix_micros(_purchase_time().cast("timestamp")).alias("t"), "order_id")
    t = F.col("t")
    span = keys.agg(F.count(F.lit(1)).alias("n"), F.count("t").alias("timed"), F.min("t").alias("low"),
                    F.max("t").alias("high")).first()
    if span["n"] < batch_size:
        return None
    rank, size = batch_size, span["timed"]
    if rank > size:  # among orders of unknown time, which come last
        rank, size, inside = rank - size, span["n"] - size, t.isNull()
    else:
        low, high = span["low"], span["high"]
        while low < high and size > SMALL_CELL:
            width = -(-(high - low + 1) // TIME_CELLS)
            counts = keys.where(t.between(low, high)).groupBy(F.floor((t - low) / width).cast("bigint").alias("cell")) \
                .agg(F.count(F.lit(1)).alias("n")).collect()  # at most TIME_CELLS rows
            for cell, n in sorted((r["cell"], r["n"]) for r in counts):
                if rank <= n:
                    low, high, size = low + cell * width, min(high, low + (cell + 1) * width - 1), n
                    break
                rank -= n
        inside = t.between(low, high)
    cell = keys.where(inside)
    if size <= SMALL_CELL:
        return cell.orderBy("t", "order_id").limit(rank).orderBy(F.desc("t"), F.desc("order_id")).first()
    return with_global_rank(cell, "order_id").where(F.col("rank") == rank).select("t", "order_id").first()


def next_slice(
    orders: DataFrame, state: IngestState, batch_size: int = DEFAULT_BATCH_SIZE
) -> tuple[DataFrame, IngestState]:
    """The next ``batch_size`` orders by (time, id), and the state after them.

    Time unknown sorts last.  An empty slice leaves the watermark as it is.  A slice is all
    pending orders up to its end key: a filter, whatever its size.
    """
    pending = pending_orders(orders, state)
    end = slice_end(pending, batch_size)
    t = F.unix_micros(_purchase_time().cast("timestamp"))
    batch = pending
    if end is not None:
        upto = F.col("order_id") <= F.lit(end["order_id"])
        timed = t.isNotNull() if end["t"] is None else (t < end["t"]) | ((t == end["t"]) & upto)
        batch = pending.where(timed | (t.isNull() & upto) if end["t"] is None else timed)
    moment = _purchase_time()
    batch = batch.orderBy(moment.asc_nulls_last(), "order_id")
    key = F.struct(moment.isNull().alias("unknown"), moment.alias("ts"), F.col("order_id"))
    seen = batch.agg(
        F.count(F.lit(1)).alias("n"),
        F.date_format(F.max(moment), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("watermark"),
        F.max(key).alias("key"),
    ).select(
        "n", "watermark",
        F.date_format("key.ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("key_ts"),
        F.col("key.order_id").cast("string").alias("key_id"),
    ).first()
    if seen["n"] == 0:
        return batch, IngestState(**{**asdict(state), "runs": state.runs + 1})
    return batch, IngestState(
        cursor=state.cursor + seen["n"], runs=state.runs + 1,
        last_purchase_ts=seen["watermark"], key_ts=seen["key_ts"], key_id=seen["key_id"],
    )


def remaining(orders: DataFrame, state: IngestState) -> DataFrame:
    """One row: how many orders are still waiting."""
    return pending_orders(orders, state).agg(F.count(F.lit(1)).alias("remaining"))


def changed_orders(*deltas: DataFrame) -> DataFrame:
    """Ids of the orders any of the deltas touches: a late review changes its order too."""
    ids = [d.where(F.col("order_id").isNotNull()).select("order_id") for d in deltas]
    return functools.reduce(DataFrame.unionByName, ids).distinct()


def restrict(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The nine tables cut down to the given orders.

    The id list is staged, so its real size decides whether the big child tables
    are filtered by broadcast, without shuffling them, or by a shuffle join.  The build joins
    what is rolled up to the orders that are left, so for a large share of the orders the
    children need not be cut exactly, which would shuffle every raw line once more: a filter
    of the ids drops most lines of other orders where they are read.
    """
    ids = staged(ids, "changed-orders")
    cut = dict(tables)
    cut["orders"] = tables["orders"].join(ids, "order_id", "left_semi")
    changed = ids.count()
    if changed > CUT_SHARE * tables["orders"].count():
        among = key_filter(ids, changed)
        for name in ORDER_CHILDREN:
            # other types hash otherwise
            if tables[name].schema["order_id"].dataType == ids.schema["order_id"].dataType:
                cut[name] = tables[name].where(among)
        return cut
    for name in ORDER_CHILDREN:
        cut[name] = tables[name].join(ids, "order_id", "left_semi")
    customers = staged(cut["orders"].select("customer_id").distinct(), "changed-customers")
    cut["customers"] = tables["customers"].join(customers, "customer_id", "left_semi")
    return cut


def key_filter(ids: DataFrame, n: int, key: str = "order_id") -> Column:
    """Whether a row's key may be among ``n`` ids: true for each of them and for few others.

    The ids set bits of a table of bounded size, at most ``MOST_BITS``.  It is staged as one row
    and enters as a scalar, so the rows that are tested stay where they are.
    """
    size = min(MOST_BITS, max(64 * FILTER_WORDS, 1 << (FILTER_BITS * n - 1).bit_length()))
    slot = F.pmod(F.xxhash64(key), F.lit(size))
    word, bit = F.floor(slot / 64).cast("bigint"), F.pmod(slot, F.lit(64)).cast("int")
    unset = ids.sparkSession.range(size // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = (
        ids.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bits"))
        .unionByName(unset).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        .groupBy(F.floor(F.col("word") / FILTER_WORDS).alias("line"))
        .agg(F.array_sort(F.collect_list(F.struct("word", "bits")))["bits"].alias("line_bits"))
        .agg(F.array_sort(F.collect_list(F.struct("line", "line_bits")))["line_bits"].alias("table"))
    )
    table = staged(words, "changed-bits").scalar()
    own = F.get(F.get(table, F.floor(word / FILTER_WORDS).cast("int")), F.pmod(word, F.lit(FILTER_WORDS)).cast("int"))
    return F.getbit(own, bit) == 1


def ingest_orders(
    tables: dict[str, DataFrame], ids: DataFrame, root: str, period: str = "yyyy-MM",
    batch: tuple[str, int] | None = None,
) -> dict[str, int]:
    """Rebuild the given orders and upsert both gold tables; returns their row counts.

    ``batch`` names the stream and its batch, which a table takes once.  Stages and shuffle files
    go as soon as the tables have the rows, so a long row of batches needs the disk of one.
    """
    spark, part = ids.sparkSession, period_part(pattern=period)
    with passing_stages(spark):
        level = staged(build_order_level(restrict(tables, ids)), "slice")
        release_shuffles(spark)
        features = feature_table(level, "order_purchase_timestamp")
        counts = {}
        for name, rows in ((ORDERS_TABLE, level), (FEATURES_TABLE, features)):
            with passing_stages(spark):
                counts[name] = upsert_table(rows, f"{root}/{name}", part=part, batch=batch)
        return counts


def run_increment(
    spark: SparkSession, tables: dict[str, DataFrame], root: str,
    batch_size: int = DEFAULT_BATCH_SIZE,
) -> IngestState:
    """One scheduled run: next slice, upsert, then save the state."""
    path = f"{root}/ingest_state"
    state = load_state(spark, path)
    batch, advanced = next_slice(tables["orders"], state, batch_size)
    if advanced.cursor > state.cursor:
        ingest_orders(tables, batch.select("order_id"), root)
    save_state(spark, path, advanced)
    return advanced


def arrivals_path(root: str, name: str) -> str:
    return f"{root}/arrivals/{name}"


def with_arrivals(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> dict[str, DataFrame]:
    """The tables with the rows that streams stored in place of those of the same orders."""
    current = dict(tables)
    for name in ("orders", *ORDER_CHILDREN):
        path = arrivals_path(root, name)
        if snapshots.load(spark, path) is not None:
            current[name] = merge_rows(tables[name], read_upserted(spark, path))
    return current


def load_batch(
    rows: DataFrame, name: str, tables: dict[str, DataFrame], root: str, batch: tuple[str, int],
    period: str = "yyyy-MM",
) -> bool:
    """Take one batch of a table's rows in; returns whether there was anything to do."""
    spark = rows.sparkSession
    paths = [arrivals_path(root, name), f"{root}/{ORDERS_TABLE}", f"{root}/{FEATURES_TABLE}"]
    if all(s is not None and s.has(batch) for s in (snapshots.load(spark, p) for p in paths)):
        return False
    with passing_stages(spark):
        rows = staged(rows, "arrivals")
        if rows.isEmpty():
            return False
        with passing_stages(spark):
            upsert_table(rows, paths[0], part=key_part(), batch=batch)
        ingest_orders(with_arrivals(spark, tables, root), changed_orders(rows), root, period, batch)
    return True


def stream_ingest(
    spark: SparkSession, source: str, name: str, tables: dict[str, DataFrame], root: str,
    checkpoint: str, files_per_trigger: int = 1, period: str = "yyyy-MM",
) -> StreamingQuery:
    """Follow a folder of Parquet files of one table and keep the gold tables current.

    ``name`` is the table the files belong to.  A micro-batch holds all rows that its orders
    have in that table: they replace older ones in the arrivals stored under ``root``, and
    the orders are rebuilt from ``tables`` with all arrivals, those of other streams
    included, and upserted.  The stream's checkpoint is the ingest state.  Every table keeps
    the last batch of each stream, so a batch that is replayed after some tables have taken it
    reaches only the others; one that all have taken does nothing, and so does an empty one.
    """
    schema = tables[name].schema
    arrivals = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .parquet(source)
    )

    def load(batch: DataFrame, batch_id: int) -> None:
        load_batch(batch, name, tables, root, (checkpoint, batch_id), period)

    return (
        arrivals.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
