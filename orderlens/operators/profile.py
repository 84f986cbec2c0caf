"""Data-quality profile and the exploration figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions import scalar as S
from orderlens.operators.quantiles import exact_quantiles

# The numeric columns described, and the lateness histogram.
DESCRIBED = [
    "n_items", "total_price", "total_freight", "total_payment_value", "max_installments",
    "actual_delivery_days", "estimated_delivery_days", "delivery_vs_estimate_days",
    "review_score",
]
LATENESS_CLIP = 40.0
LATENESS_BINS = 60


def quality_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, missing values and distinct values per column.

    The exact form counts distinct (column, value) pairs, so a column's values
    are spread over the cluster; ``approximate`` keeps one sketch per column.
    """
    types = dict(df.dtypes)
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        for c in df.columns
    ])))
    if approximate:
        counted = pairs.groupBy("column_name").agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("value").isNull()).alias("n_missing"),
            F.approx_count_distinct("value").alias("n_unique"),
        )
    else:
        counted = (
            pairs.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("copies"))
            .groupBy("column_name")
            .agg(
                F.sum("copies").alias("n_rows"),
                F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("copies"))), F.lit(0))
                .alias("n_missing"),
                F.count("value").alias("n_unique"),
            )
        )
    dtype = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return counted.select(
        "column_name", dtype[F.col("column_name")].alias("dtype"), "n_missing",
        S.percent(F.col("n_missing"), F.col("n_rows")).alias("pct_missing"), "n_unique",
    )


def describe(df: DataFrame, columns: Sequence[str] = tuple(DESCRIBED)) -> DataFrame:
    """Count, mean, sd, min, exact quartiles and max per numeric column."""
    moments = df.agg(F.array(*[
        F.struct(
            F.lit(c).alias("metric"), F.count(c).alias("n"), F.avg(c).alias("mean"),
            F.stddev_samp(F.col(c).cast("double")).alias("sd"),
            F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
        )
        for c in columns
    ]).alias("m")).select(F.inline("m"))
    quartiles = (
        exact_quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75])
        .groupBy("metric")
        .agg(*[
            F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name)
            for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
        ])
    )
    return moments.join(quartiles, "metric", "left").select(
        "metric", "n", "mean", "sd", "min", "q25", "q50", "q75", "max"
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each known value of a column occurs."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def sanity_counts(order_level: DataFrame) -> DataFrame:
    """Negative durations, orders without delivery, orders without review."""
    return order_level.agg(
        F.count_if(F.col("actual_delivery_days") < 0).alias("negative_durations"),
        F.count_if(F.col("order_delivered_customer_date").isNull()).alias("no_delivery"),
        F.count_if(F.col("review_score").isNull()).alias("no_review"),
    )


def lateness_histogram(order_level: DataFrame) -> DataFrame:
    """Sixty equal bins over the clipped lateness of delivered orders.

    Empty bins are shown; the last bin includes its upper edge.
    """
    lateness = F.col("delivery_vs_estimate_days")
    clipped = order_level.where(
        (F.col("order_status") == "delivered") & lateness.isNotNull()
    ).select(
        F.least(F.greatest(lateness, F.lit(-LATENESS_CLIP)), F.lit(LATENESS_CLIP)).alias("days")
    )
    bounds = clipped.agg(
        F.struct(F.min("days").alias("low"), F.max("days").alias("high")).alias("b")
    ).scalar()
    width = (bounds["high"] - bounds["low"]) / LATENESS_BINS
    bin_no = F.least(
        F.floor((F.col("days") - bounds["low"]) / F.nullif(width, F.lit(0.0))),
        F.lit(LATENESS_BINS - 1),
    )
    counted = clipped.groupBy(F.coalesce(bin_no, F.lit(0)).alias("bin")).agg(
        F.count(F.lit(1)).alias("orders")
    )
    bins = clipped.sparkSession.range(LATENESS_BINS).withColumnRenamed("id", "bin")
    return bins.join(counted, "bin", "left").select(
        "bin", (bounds["low"] + F.col("bin") * width).alias("bin_start"),
        F.coalesce("orders", F.lit(0)).alias("orders"),
    )


def delivery_headline(order_level: DataFrame) -> DataFrame:
    """Late rate and median actual and promised days of delivered orders."""
    delivered = order_level.where(F.col("order_status") == "delivered")
    medians = exact_quantiles(
        delivered,
        {c: F.col(c) for c in ("actual_delivery_days", "estimated_delivery_days")},
        [0.5],
    ).agg(
        F.struct(*[
            F.max(F.when(F.col("metric") == m, F.col("quantile"))).alias(m)
            for m in ("actual_delivery_days", "estimated_delivery_days")
        ]).alias("m")
    ).scalar()
    return delivered.agg(
        F.count(F.lit(1)).alias("delivered"),
        (F.avg(S.late_flag_two_valued(F.col("delivery_vs_estimate_days")).cast("int")) * 100)
        .alias("late_rate_pct"),
    ).select(
        "delivered", "late_rate_pct",
        medians["actual_delivery_days"].alias("median_actual_days"),
        medians["estimated_delivery_days"].alias("median_estimated_days"),
    )


def score_by_lateness(order_level: DataFrame) -> DataFrame:
    """Mean review score of on-time and late deliveries."""
    return (
        order_level.where(F.col("order_status") == "delivered")
        .groupBy(
            S.late_flag_two_valued(F.col("delivery_vs_estimate_days")).alias("is_late_two_valued")
        )
        .agg(F.avg("review_score").alias("mean_score"), F.count("review_score").alias("reviews"))
    )
