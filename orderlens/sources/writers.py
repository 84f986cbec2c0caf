"""Sinks: gold tables, keyed upserts, CSV copies, digest and queue exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.functions import scalar as S
from orderlens.operators.risk import action_queue_export
from orderlens.session import staged
from orderlens.sources import snapshots
from orderlens.sources.snapshots import PART


def replace_table(df: DataFrame, path: str, part: Column | None = None, key: str = "order_id") -> int:
    """Replace a whole table; a second run leaves the same rows.  Returns the count.

    With ``part`` the table is a series of snapshots that ``upsert_table`` continues, and readers
    see the old rows until the new ones are complete.
    """
    spark = df.sparkSession
    if part is None:
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path).count()
    former = _snapshot_to_continue(spark, path)
    snapshot = snapshots.write(df.withColumn(PART, _partition(part)), path, former, None, key)
    snapshots.forget(spark, path)
    return snapshots.read(spark, path, snapshot).count()


def merge_rows(
    stored: DataFrame, incoming: DataFrame, key: str = "order_id", order: str | None = None
) -> DataFrame:
    """Stored rows without the incoming keys, plus the incoming rows.

    With ``order`` a key that comes twice in the batch keeps its last row only.
    Incoming rows with a null key are appended and replace nothing.
    """
    batch = incoming if order is None else last_per_key(incoming, key, order)
    keys = batch.where(F.col(key).isNotNull()).select(key).distinct()
    return stored.join(keys, key, "left_anti").unionByName(batch, allowMissingColumns=True)


def last_per_key(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the highest ``order`` per key; rows without a key all stay.

    ``max_by`` combines on the map side, so copies of a hot key never meet.
    """
    row = F.struct(*[F.col(c) for c in batch.columns])
    latest = (
        batch.where(F.col(key).isNotNull()).groupBy(key)
        .agg(F.max_by(row, F.col(order)).alias("row")).select("row.*")
    )
    return latest.unionByName(batch.where(F.col(key).isNull()))


def _snapshot_to_continue(spark: SparkSession, path: str) -> snapshots.Snapshot | None:
    found = snapshots.load(spark, path)
    if found is None and snapshots.exists(spark, path):
        # its files would be hidden by the snapshots
        raise ValueError(f"{path} is not partitioned by {PART} in snapshots; rebuild it with replace_table(..., part)")
    return found


def _partition(part: Column) -> Column:
    return F.coalesce(part.cast("string"), F.lit("unknown"))


def period_part(moment: str = "order_purchase_timestamp", pattern: str = "yyyy-MM") -> Column:
    """Partition value of an order table: the period of purchase, a month by default."""
    return F.coalesce(F.date_format(moment, pattern), F.lit("unknown"))


def key_part(key: str = "order_id", parts: int = 16) -> Column:
    """Partition value of a table without a natural one: a hash slot of the key."""
    return F.coalesce(F.pmod(F.xxhash64(key), F.lit(parts)).cast("string"), F.lit("unknown"))


def upsert_table(
    incoming: DataFrame, path: str, key: str = "order_id", part: Column | None = None,
    order: str | None = None, batch: tuple[str, int] | None = None,
) -> int:
    """Merge a batch into a partitioned table; returns its row count.

    Only the partitions the batch touches are read and rewritten: those of its own rows and
    those holding older rows of its keys.  Orders arrive by purchase time, so a batch touches a
    month or two of a table of any age.  The result is the table's next snapshot: readers see
    the table before or after the batch, and a job that dies half way changes nothing.

    ``batch`` names a stream and the number of its batch; one that the table already has is
    not merged again.  An empty batch leaves the rows as they are, and a new table readable.
    """
    spark = incoming.sparkSession
    former = _snapshot_to_continue(spark, path)
    if former is not None and former.has(batch):
        return snapshots.read(spark, path, former).count()
    if order is not None:
        incoming = last_per_key(incoming, key, order)
    rows = incoming.withColumn(PART, _partition(part if part is not None else key_part(key)))
    if former is None:  # read once, by the write
        snapshot = snapshots.write(rows, path, None, None, key, batch)
        return snapshots.read(spark, path, snapshot).count()
    rows = staged(rows, "batch")
    if rows.isEmpty():
        snapshot = former if batch is None else snapshots.note(spark, path, former, batch)
        return snapshots.read(spark, path, snapshot).count()
    stored = snapshots.read(spark, path, former)
    keys = rows.where(F.col(key).isNotNull()).select(key).distinct()
    older = stored.select(key, PART).join(keys, key, "left_semi").select(PART)
    # partition names only: bounded by the table's partition count
    touched = [snapshots.folder(spark, r[0]) for r in rows.select(PART).union(older).distinct().collect()]
    kept = snapshots.read(spark, path, former, touched).join(keys, key, "left_anti")
    merged = kept.unionByName(rows, allowMissingColumns=True)
    snapshot = snapshots.write(merged, path, former, touched, key, batch)
    snapshots.forget(spark, path)
    return snapshots.read(spark, path, snapshot).count()


def read_upserted(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """An upserted table without its partition column, as it is now or was at a snapshot."""
    snapshot = snapshots.load(spark, path, version)
    if snapshot is None:
        raise FileNotFoundError(f"no table at {path}")
    return snapshots.read(spark, path, snapshot).drop(PART)


def storage_form(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text, for text sinks; booleans keep true / false / null."""
    return df.select(*[
        S.iso_timestamp(F.col(name)).alias(name) if dtype.startswith("timestamp") else F.col(name)
        for name, dtype in df.dtypes
    ])


def write_csv_copy(df: DataFrame, path: str) -> None:
    """CSV copy of a table, one file per partition."""
    storage_form(df).write.mode("overwrite").option("header", "true").option(
        "escape", '"'
    ).csv(path)


def write_digest(digest: DataFrame, root: str, generated_at: str) -> None:
    """Digest rows as JSON, kept by generation time and as ``latest``."""
    stamp = generated_at.replace(":", "").replace("-", "")
    digest.write.mode("overwrite").json(f"{root}/generated_at={stamp}")
    digest.write.mode("overwrite").json(f"{root}/latest")


def write_action_queue(queue: DataFrame, path: str) -> None:
    """The action queue as CSV, every cell quoted."""
    (
        action_queue_export(queue).write.mode("overwrite")
        .option("header", "true").option("quoteAll", "true").option("escape", '"')
        .option("emptyValue", "").csv(path)
    )


def read_back_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sink as text columns; an empty cell stays empty text."""
    return spark.read.option("header", "true").option("escape", '"').option(
        "emptyValue", ""
    ).csv(path).na.fill("")
