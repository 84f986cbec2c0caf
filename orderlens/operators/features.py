"""Model features and labels as projections of the order-level table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions import scalar as S
from orderlens.schemas import (
    DERIVED_NUMERIC,
    LABEL_OF,
    ORDER_TIME_CATEGORICAL,
    ORDER_TIME_NUMERIC,
    OUTCOME_NUMERIC,
    model_inputs,
)


def calendar_parts(moment: Column) -> dict[str, Column]:
    """Month, day of week (Monday = 0), hour and weekend flag."""
    return {
        "purchase_month": F.month(moment),
        "purchase_dow": F.weekday(moment),
        "purchase_hour": F.hour(moment),
        "purchase_is_weekend": S.weekend_flag(moment),
    }


def derived_features() -> dict[str, Column]:
    """The six features computed from order-level columns."""
    parts = calendar_parts(F.col("order_purchase_timestamp"))
    parts["freight_ratio"] = S.freight_ratio(F.col("total_price"), F.col("total_freight"))
    parts["cross_state_shipment"] = S.cross_state(
        F.col("customer_state"), F.col("main_seller_state")
    )
    return {name: parts[name] for name in DERIVED_NUMERIC}


def label_columns() -> dict[str, Column]:
    """Late, low review (null without a score), and the complaint proxy."""
    score = F.col("review_score")
    failed = F.col("order_status").isin("canceled", "unavailable")
    return {
        "is_late": F.col("is_late"),
        "low_review": score <= 2,
        "is_complaint": F.coalesce(failed, F.lit(False)) | F.coalesce(score == 1, F.lit(False)),
        "order_status": F.col("order_status"),
    }


def engineer_features(order_level: DataFrame) -> DataFrame:
    """Six derived features, the passed-through numerics and the categoricals."""
    passed = [c for c in ORDER_TIME_NUMERIC if c not in DERIVED_NUMERIC]
    return order_level.select(
        "order_id",
        *[expr.alias(name) for name, expr in derived_features().items()],
        *passed,
        *ORDER_TIME_CATEGORICAL,
    )


def add_labels(order_level: DataFrame) -> DataFrame:
    """The three targets and the status, keyed by order."""
    return order_level.select(
        "order_id", *[expr.alias(name) for name, expr in label_columns().items()]
    )


def feature_table(order_level: DataFrame, *extra: str) -> DataFrame:
    """Features beside labels.  Both come from the same row: no join is needed."""
    passed = [c for c in ORDER_TIME_NUMERIC if c not in DERIVED_NUMERIC]
    return order_level.select(
        "order_id",
        *[expr.alias(name) for name, expr in derived_features().items()],
        *passed,
        *ORDER_TIME_CATEGORICAL,
        *[expr.alias(name) for name, expr in label_columns().items()],
        *extra,
    )


def scoring_frame(order_level: DataFrame, *extra: str) -> DataFrame:
    """Features, labels and outcome straight from the order-level rows, join-free."""
    outcome = [c for c in OUTCOME_NUMERIC if c != "is_late_int"]
    return feature_table(order_level, *outcome, *extra).withColumn(
        "is_late_int", F.col("is_late").cast("int").cast("double")
    )


def with_outcome(features: DataFrame, order_level: DataFrame, *extra: str) -> DataFrame:
    """The same for two stored tables: features with the outcome columns joined on."""
    outcome = [c for c in OUTCOME_NUMERIC if c != "is_late_int"]
    joined = features.join(order_level.select("order_id", *outcome, *extra), "order_id", "left")
    return joined.withColumn("is_late_int", S.tri_state(F.col("is_late")).cast("int").cast("double"))


def modeling_rows(frame: DataFrame, model: str) -> DataFrame:
    """Delivered orders with a known label, as 0.0 / 1.0 in ``label``."""
    numeric, categorical = model_inputs(model)
    label = F.col(LABEL_OF[model])
    return (
        frame.where((F.col("order_status") == "delivered") & label.isNotNull())
        .select(
            "order_id",
            *[F.col(c).cast("double").alias(c) for c in numeric],
            *categorical,
            label.cast("int").cast("double").alias("label"),
        )
    )


def derive_missing(orders: DataFrame) -> DataFrame:
    """Fill features a caller left out but whose inputs are present.

    A time that does not parse leaves the calendar parts to imputation, and the
    cross-state flag needs both states, unlike the one computed for training.
    """
    present = set(orders.columns)

    def given(name: str, dtype: str) -> Column:
        return F.col(name) if name in present else F.lit(None).cast(dtype)

    moment = S.parse_timestamp(given("order_purchase_timestamp", "string"))
    parts = calendar_parts(moment)
    parts["purchase_is_weekend"] = F.when(moment.isNotNull(), parts["purchase_is_weekend"])
    price = S.safe_double(given("total_price", "double"))
    freight = S.safe_double(given("total_freight", "double"))
    parts["freight_ratio"] = F.when(
        price.isNotNull() & freight.isNotNull() & (price + freight != 0), freight / (price + freight)
    )
    parts["cross_state_shipment"] = S.cross_state_if_known(
        given("customer_state", "string"), given("main_seller_state", "string")
    )
    return orders.withColumns({
        name: F.coalesce(S.safe_double(given(name, "double")), expr.cast("double"))
        for name, expr in parts.items()
    })


def model_input(orders: DataFrame, model: str, key: str = "order_id") -> DataFrame:
    """Exactly the model's columns, in order: safe numbers and non-blank categories."""
    numeric, categorical = model_inputs(model)
    present = set(orders.columns)
    return orders.select(
        key,
        *[
            (S.safe_double(F.col(c)) if c in present else F.lit(None).cast("double")).alias(c)
            for c in numeric
        ],
        *[
            (S.blank_to_null(F.col(c)) if c in present else F.lit(None).cast("string")).alias(c)
            for c in categorical
        ],
    )


def cap_batch(orders: DataFrame, max_orders: int | None) -> DataFrame:
    """At most ``max_orders`` uploaded rows; None (the default use) keeps them all."""
    return orders if max_orders is None else orders.limit(max_orders)
