"""Score every order and publish what the team works from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.operators import features, forecast, models, profile, risk, segments, sketch_profile
from orderlens.schemas import DASHBOARD_MONTH_MIN, FORECAST_MONTH_MIN
from orderlens.session import staged
from orderlens.sources.writers import write_action_queue, write_digest

DISPLAYED = (
    "order_purchase_timestamp", "review_score",
)


def score_orders(level: DataFrame, trained: dict[str, models.RiskModel]) -> DataFrame:
    """All delivered orders with both probabilities, flags and levels; written once."""
    frame = features.scoring_frame(level, *DISPLAYED).where(F.col("order_status") == "delivered")
    both = models.score_with_both(frame, trained["delay"], trained["low_review"])
    return staged(
        risk.with_risk(both, trained["delay"].threshold, trained["low_review"].threshold), "scored"
    )


def score_uploads(uploads: DataFrame, trained: dict[str, models.RiskModel]) -> DataFrame:
    """Caller-supplied orders: ids filled in, features derived, imputed and scored."""
    rows = features.derive_missing(risk.with_row_ids(uploads))
    # the low-review inputs contain the delay model's
    inputs = features.model_input(rows, "low_review")
    both = models.score_with_both(inputs, trained["delay"], trained["low_review"])
    return risk.with_risk(both, trained["delay"].threshold, trained["low_review"].threshold)


def dashboard(level: DataFrame, scored: DataFrame, trained: dict[str, models.RiskModel]) -> dict[str, DataFrame]:
    """The dashboard's tables."""
    queue = risk.action_queue(scored)
    return {
        "summary": risk.dashboard_summary(
            scored, level, trained["delay"].threshold, trained["low_review"].threshold),
        "risk_distribution": risk.risk_distribution(scored),
        "orders_over_time": forecast.monthly_orders(level, DASHBOARD_MONTH_MIN),
        "orders": risk.display_row(scored),
        "action_queue": queue.withColumns({
            "playbook": risk.playbook(), "routes": risk.routes(), "message": risk.outreach_text(),
        }),
        "roi": risk.roi(scored),
        "funnel": risk.funnel(scored, level, queue),
    }


def segment_tables(level: DataFrame) -> dict[str, DataFrame]:
    """Customer segments and top lists."""
    customers = staged(segments.customer_rollup(level), "customers")
    return {
        "summary": segments.segment_summary(customers),
        "grid": segments.value_loyalty_grid(customers),
        "tiers": segments.spend_tiers(customers),
        "top_states": segments.top_states(level),
        "top_categories": segments.top_categories(level),
    }


def forecast_tables(level: DataFrame) -> dict[str, DataFrame]:
    """Monthly history with projection, and its headline; fails on too little history."""
    monthly = staged(forecast.monthly_orders(level, FORECAST_MONTH_MIN), "monthly")
    forecast.require_history(monthly)
    return {"series": forecast.forecast_series(monthly), "summary": forecast.forecast_summary(monthly)}


def profile_tables(level: DataFrame) -> dict[str, DataFrame]:
    """Data quality and exploration figures."""
    return {
        "quality": profile.quality_profile(level),
        "describe": profile.describe(level),
        "sanity": profile.sanity_counts(level),
        "lateness": profile.lateness_histogram(level),
        "headline": profile.delivery_headline(level),
        "score_by_lateness": profile.score_by_lateness(level),
    }


def merged_profile_tables(stored: DataFrame) -> dict[str, DataFrame]:
    """Quality and description from the stored sketches alone."""
    return {"quality": sketch_profile.quality_profile(stored), "describe": sketch_profile.describe(stored)}


def digest(
    level: DataFrame, scored: DataFrame | None, root: str, generated_at: str, k: int = 10
) -> DataFrame:
    """Counts and the top at-risk orders as one JSON document; works without models."""
    labels = features.add_labels(level)
    if scored is None:
        counts = labels.agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.count_if(F.col("order_status") == "delivered").alias("delivered_orders"),
            F.count_if("is_late").alias("late_deliveries"),
            F.count_if("low_review").alias("low_reviews"),
        )
        top = risk.recent_late_orders(level, k)
    else:
        counts = risk.digest_counts(labels, scored)
        top = risk.top_at_risk(scored, k)
    listed = top.agg(F.collect_list(F.struct("*")).alias("t")).scalar()  # k rows
    document = counts.select(
        F.lit(generated_at).alias("generated_at"),
        F.lit(scored is not None).alias("models_loaded"),
        F.struct(*counts.columns).alias("counts"), listed.alias("top_at_risk"),
    )
    write_digest(document, root, generated_at)
    return document


def export_queue(scored: DataFrame, path: str) -> None:
    """The action queue as a CSV export."""
    write_action_queue(risk.action_queue(scored), path)
