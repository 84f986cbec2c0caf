"""Customer segments, spend tiers and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions import scalar as S
from orderlens.operators.quantiles import exact_median, exact_quantiles, with_global_rank

# The grid's cells and the tier names.
GRID_CELLS = [
    # high value, repeat, key, name, recommended action
    (True, True, "champions", "Champions",
     "Reward loyalty and protect against churn."),
    (True, False, "high_value_firsttimers", "High-value first-timers",
     "Win back with a targeted second-purchase offer."),
    (False, True, "loyal_regulars", "Loyal regulars",
     "Nurture the relationship and grow basket size."),
    (False, False, "one_time_buyers", "One-time buyers",
     "Activate: turn the first order into a second."),
]
TIER_NAMES = ["Budget", "Standard", "Premium", "VIP"]


def order_value():
    """What an order is worth: paid value, falling back to item price, then 0."""
    return F.coalesce(F.col("total_payment_value"), F.col("total_price"), F.lit(0.0))


def customer_rollup(order_level: DataFrame) -> DataFrame:
    """Orders and lifetime spend per person."""
    return (
        order_level.where(F.col("customer_unique_id").isNotNull())
        .groupBy(F.col("customer_unique_id").alias("customer"))
        .agg(F.count(F.lit(1)).alias("orders"), F.sum(order_value()).alias("spend"))
    )


def value_loyalty_grid(customers: DataFrame) -> DataFrame:
    """Four cells by median spend and repeat purchase; an empty cell shows zeros."""
    spark = customers.sparkSession
    high = F.col("spend") >= exact_median(customers, F.col("spend"))
    cells = (
        customers.groupBy(high.alias("high_value"), (F.col("orders") > 1).alias("repeat"))
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.sum("spend").alias("spend"),
            F.sum("orders").alias("orders"),
        )
    )
    totals = cells.agg(
        F.struct(F.sum("customers").alias("customers"), F.sum("spend").alias("spend")).alias("t")
    ).scalar()
    named = spark.createDataFrame(
        GRID_CELLS, "high_value boolean, repeat boolean, key string, name string, action string"
    )
    none = F.lit(0)
    return named.join(cells, ["high_value", "repeat"], "left").select(
        "key", "name", "action",
        F.coalesce("customers", none).alias("customers"),
        S.percent(F.coalesce("customers", none), totals["customers"]).alias("share_pct"),
        F.coalesce(F.col("spend") / F.col("customers"), F.lit(0.0)).alias("avg_spend"),
        F.coalesce(F.col("orders") / F.col("customers"), F.lit(0.0)).alias("avg_orders"),
        S.percent(F.coalesce("spend", F.lit(0.0)), totals["spend"]).alias("revenue_share_pct"),
    )


def spend_tiers(customers: DataFrame) -> DataFrame:
    """Customers and revenue share per spend quartile.

    The three cut ranks and the spend found there settle the tiers: customers
    below a cut value lie below the cut, and of those tied on it exactly as many
    as the rank leaves room for.  No customer is ranked one by one.
    """
    shares = [0.25, 0.5, 0.75]
    cuts = exact_quantiles(customers, {"spend": F.col("spend")}, shares)
    cut_list = cuts.agg(
        F.sort_array(F.collect_list(F.struct("probability", "rank", "lower_value", "below", "n")))
        .alias("cuts")  # three rows
    ).scalar()
    cut = [F.get(cut_list, F.lit(i)) for i in range(3)]
    totals = customers.agg(
        F.coalesce(F.sum("spend"), F.lit(0.0)).alias("total"),
        *[
            F.coalesce(F.sum(F.when(F.col("spend") < c["lower_value"], F.col("spend"))), F.lit(0.0))
            .alias(f"under_{i}")
            for i, c in enumerate(cut)
        ],
    )
    upto_spend = [F.lit(0.0)] + [
        F.col(f"under_{i}") + (c["rank"] - c["below"]) * c["lower_value"]
        for i, c in enumerate(cut)
    ] + [F.col("total")]
    upto_rank = [F.lit(0)] + [c["rank"] for c in cut] + [cut[0]["n"]]
    tiers = F.array(*[
        F.struct(
            F.lit(i + 1).alias("tier_no"),
            F.lit(name).alias("tier"),
            (upto_rank[i + 1] - upto_rank[i]).cast("bigint").alias("customers"),
            S.percent(upto_spend[i + 1] - upto_spend[i], F.col("total"))
            .alias("revenue_share_pct"),
        )
        for i, name in enumerate(TIER_NAMES)
    ])
    return totals.select(F.inline(tiers))


def spend_ranks(customers: DataFrame) -> DataFrame:
    """Every customer's spend rank (ties by customer) and quartile tier."""
    ranked = with_global_rank(customers, "spend", "customer", rank="spend_rank")
    n = ranked.agg(F.count(F.lit(1))).scalar()
    tier = F.greatest(
        F.lit(1), F.ceil(F.lit(4) * (F.col("spend_rank") - 1) / F.nullif(n - 1, F.lit(0)))
    )
    return ranked.withColumn("tier_no", F.coalesce(tier, F.lit(1)).cast("bigint"))


def top_categories(order_level: DataFrame, k: int = 8) -> DataFrame:
    """The k categories with the highest revenue."""
    return (
        order_level.where(F.col("main_category").isNotNull())
        .groupBy(F.col("main_category").alias("category"))
        .agg(F.count(F.lit(1)).alias("orders"), F.sum(order_value()).alias("revenue"))
        .orderBy(F.col("revenue").desc(), "category")
        .limit(k)
    )


def top_states(order_level: DataFrame, k: int = 8) -> DataFrame:
    """The k states with the most distinct customers, and their average spend."""
    return (
        order_level.where(F.col("customer_state").isNotNull())
        .groupBy(F.col("customer_state").alias("state"))
        .agg(
            F.count_distinct("customer_unique_id").alias("customers"),
            F.sum(order_value()).alias("spend"),
        )
        .orderBy(F.col("customers").desc(), "state")
        .limit(k)
        .select(
            "state", "customers",
            F.coalesce(F.col("spend") / F.nullif(F.col("customers"), F.lit(0)), F.lit(0.0))
            .alias("avg_spend"),
        )
    )


def segment_summary(customers: DataFrame) -> DataFrame:
    """Customers, orders, repeat rate and average order value."""
    return customers.agg(
        F.count(F.lit(1)).alias("customers"),
        F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"),
        S.percent(F.count_if(F.col("orders") > 1), F.count(F.lit(1))).alias("repeat_rate_pct"),
        F.coalesce(F.sum("spend") / F.nullif(F.sum("orders"), F.lit(0)), F.lit(0.0))
        .alias("avg_order_value"),
    )
