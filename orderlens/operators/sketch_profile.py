"""A data profile that follows a table's writes: mergeable sketches for each partition.

Of every partition and column the sketch table keeps the number of rows and missing
values, a distinct-count sketch, and for numbers a quantile sketch, moments and range.
A refresh reads only the partitions whose files have changed since; the profile of the
whole table is a merge of sketches and reads no row of it.

Counts, means and ranges are exact.  The distinct sketch has a standard error below one
percent, a quantile's rank is off by about half a percent at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.functions import scalar as S
from orderlens.operators.profile import DESCRIBED
from orderlens.sources import snapshots
from orderlens.sources.snapshots import PART

DISTINCT_LG_K = 14
QUANTILE_K = 1_000
SKETCHED = (
    f"{PART} string, source string, column_name string, dtype string, n_rows bigint, "
    "n_missing bigint, distinct_sketch binary, n bigint, mean double, squares double, "
    "min double, max double, quantile_sketch binary"
)


def sketches(df: DataFrame, described: Sequence[str] = tuple(DESCRIBED)) -> DataFrame:
    """One row per partition value in ``part`` and column.

    All columns fold in one pass, map-side first: no value is shuffled, only sketches.
    ``squares`` is the sum of squared distances from the partition's mean.
    """
    rows, types = "_rows", {c: t for c, t in df.dtypes if c != PART}
    folded: list[Column] = [F.count(F.lit(1)).alias(rows)]
    for c in types:
        folded.append(F.struct(
            F.count(c).alias("known"),
            F.hll_sketch_agg(F.col(c).cast("string"), DISTINCT_LG_K).alias("distinct"),
        ).alias(f"_d_{c}"))
    for c in described:
        value = F.col(c).cast("double")
        folded.append(F.struct(
            F.count(value).alias("n"), F.avg(value).alias("mean"),
            (F.var_pop(value) * F.count(value)).alias("squares"),
            F.min(value).alias("min"), F.max(value).alias("max"),
            F.kll_sketch_agg_double(value, QUANTILE_K).alias("quantiles"),
        ).alias(f"_q_{c}"))
    nothing = F.lit(None)

    def line(c: str) -> Column:
        own = F.col(f"_d_{c}")
        number = F.col(f"_q_{c}") if c in described else None

        def part(name: str, kind: str) -> Column:
            return (nothing if number is None else number[name]).cast(kind)

        return F.struct(
            F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"),
            F.col(rows).alias("n_rows"), (F.col(rows) - own["known"]).alias("n_missing"),
            own["distinct"].alias("distinct_sketch"), part("n", "bigint").alias("n"),
            *[part(x, "double").alias(x) for x in ("mean", "squares", "min", "max")],
            part("quantiles", "binary").alias("quantile_sketch"),
        )

    wide = df.groupBy(PART).agg(*folded)
    return wide.select(PART, F.inline(F.array(*[line(c) for c in types])))


def refresh(
    spark: SparkSession, table: str, path: str, described: Sequence[str] = tuple(DESCRIBED)
) -> list[str]:
    """Bring the sketch table at ``path`` up to a snapshot table; returns the partitions read.

    A sketch remembers the write its partition came from.  Partitions of another write are
    read again, those that are gone lose their sketches, the rest stays as it is.  A table
    whose columns or types have changed is read whole.
    """
    now = snapshots.load(spark, table)
    if now is None:
        raise FileNotFoundError(f"no table at {table}")
    former = snapshots.load(spark, path)
    known: dict[str, str] = {}
    if former is not None:
        stored = snapshots.read(spark, path, former)
        columns = {(r[0], r[1]) for r in stored.select("column_name", "dtype").distinct().collect()}
        current = snapshots.read(spark, table, now, [])
        if not former.parts or columns == {x for x in current.dtypes if x[0] != PART}:
            # one row per partition
            known = {
                snapshots.folder(spark, r[0]): r[1]
                for r in stored.select(PART, "source").distinct().collect()
            }
    changed = sorted(p for p, write in now.parts.items() if known.get(p) != write)
    gone = [p for p in (former.parts if former else {}) if p not in now.parts]
    stale = [p for p in (former.parts if former else {}) if p in set(changed)]
    if former is not None and not changed and not gone:
        return []
    writes = {snapshots.value(spark, p): now.parts[p] for p in changed}
    pairs = F.create_map(*[F.lit(x) for pair in writes.items() for x in pair]) if writes else None
    source = F.lit(None) if pairs is None else pairs[F.col(PART)]
    rows = snapshots.read(spark, table, now, changed)
    fresh = sketches(rows, [c for c in described if c in rows.columns]).select(
        PART, source.cast("string").alias("source"),
        *[f.split()[0] for f in SKETCHED.split(", ")[2:]],
    )
    snapshots.write(fresh, path, former, [*stale, *gone], "column_name")
    snapshots.forget(spark, path)
    return changed


def stored_sketches(spark: SparkSession, path: str) -> DataFrame:
    """The sketch table as it is now."""
    snapshot = snapshots.load(spark, path)
    if snapshot is None:
        raise FileNotFoundError(f"no sketches at {path}")
    return snapshots.read(spark, path, snapshot)


def quality_profile(stored: DataFrame) -> DataFrame:
    """Type, missing values and estimated distinct values per column, merged."""
    return stored.groupBy("column_name").agg(
        F.max("dtype").alias("dtype"), F.sum("n_rows").alias("n_rows"),
        F.sum("n_missing").alias("n_missing"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("n_unique"),
    ).select(
        "column_name", "dtype", "n_missing",
        S.percent(F.col("n_missing"), F.col("n_rows")).alias("pct_missing"), "n_unique",
    )


def describe(stored: DataFrame) -> DataFrame:
    """Count, mean, sd, min, quartiles (by rank, not interpolated) and max, merged.

    Squared distances add up after each partition's mean is moved to the common one.
    """
    numbers = stored.where(F.col("quantile_sketch").isNotNull())
    merged = numbers.groupBy("column_name").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("total"),
        F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("quantile_sketch"))).alias("q"),
    ).withColumn("mean", F.col("total") / F.nullif(F.col("n"), F.lit(0)))
    spread = (
        numbers.alias("a").join(merged.select("column_name", F.col("mean").alias("all")), "column_name")
        .groupBy("column_name")
        .agg(F.sum(F.col("squares") + F.col("n") * F.pow(F.col("mean") - F.col("all"), F.lit(2.0)))
             .alias("squares"))
    )

    def quartile(p: float) -> Column:
        return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("q", F.lit(p)))

    return merged.join(spread, "column_name", "left").select(
        F.col("column_name").alias("metric"), "n", "mean",
        F.sqrt(F.col("squares") / F.nullif(F.col("n") - 1, F.lit(0))).alias("sd"), "min",
        *[quartile(p).alias(name) for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))],
        "max",
    )
