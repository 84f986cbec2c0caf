"""What several training-data operators share: inputs, staging, Arrow batches, global positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.session import scratch_path, staged

# Rows of one Arrow batch: a thousand texts of a few thousand characters are a few MB.
BATCH_ROWS = "1000"
BATCH_BYTES = str(16 << 20)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, with Arrow batches kept small enough for whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, null as the empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    return staged(df, label)


def stored_path(df: DataFrame, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key() -> Column:
    """A hash of doc_id and text: rows that agree in both are one document."""
    return F.xxhash64("doc_id", "text")


def hash_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_partitions(df: DataFrame) -> int:
    """As many partitions as the scan of a table has, and one per core at least."""
    return max(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)


def with_local_place(df: DataFrame, *order: Column | str, label: str) -> DataFrame:
    """Rows in range partitions by ``order``, stored with their partition and place there.

    ``part`` numbers the partitions in order and ``place`` the rows of each from 0, so a
    global position is a place plus the rows of earlier partitions.  No task holds more
    than one range.
    """
    n = hash_partitions(df.sparkSession)
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    return stored(
        placed.withColumn("_n", number).withColumns({
            "part": F.shiftright("_n", 33).cast("int"),
            "place": F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)),
        }).drop("_n"),
        label,
    )


