"""Monthly order volume and its trend projection.

The monthly table has one row per calendar month, so everything after the first
grouped count works on a few hundred rows whatever the number of orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.schemas import FORECAST_HORIZON, FORECAST_WINDOW

MIN_MONTHS = 4


class NotEnoughHistory(ValueError):
    """Fewer than four months are left to fit the trend on."""


def monthly_orders(orders: DataFrame, min_orders: int) -> DataFrame:
    """Orders per purchase month; months under the minimum are dropped."""
    bought = F.col("order_purchase_timestamp")
    return (
        orders.where(bought.isNotNull())
        .groupBy(F.trunc(bought.cast("date"), "month").alias("month"))
        .agg(F.count(F.lit(1)).alias("orders"))
        .where(F.col("orders") >= min_orders)
    )


def _fit_window(monthly: DataFrame, window: int) -> DataFrame:
    """The last ``window`` kept months with their position 0 … w-1."""
    newest = Window.orderBy(F.col("month").desc())  # one row per month
    kept = monthly.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= window)
    oldest = Window.orderBy("month")
    return kept.select("month", "orders", (F.row_number().over(oldest) - 1).alias("x"))


def trend(monthly: DataFrame, window: int = FORECAST_WINDOW) -> DataFrame:
    """One row: slope, intercept, residual spread and half-width of the band."""
    points = _fit_window(monthly, window)
    x, y = F.col("x").cast("double"), F.col("orders").cast("double")
    line = points.agg(
        F.struct(
            F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
            F.count(F.lit(1)).alias("w"), F.avg(y).alias("mean"), F.max("month").alias("last_month"),
            F.max_by("orders", "month").alias("last_orders"),
        ).alias("line")
    ).scalar()
    residual = y - (line["slope"] * x + line["intercept"])
    fitted = points.agg(F.stddev_samp(residual).alias("spread"))
    spread = F.when(line["w"] > 2, F.coalesce(F.col("spread"), F.lit(0.0))).otherwise(F.lit(0.0))
    return fitted.select(
        line["slope"].alias("slope"), line["intercept"].alias("intercept"), line["w"].alias("w"),
        spread.alias("residual_sd"),
        F.greatest(1.96 * spread, 0.08 * line["mean"]).alias("band"),
        line["last_month"].alias("last_month"), line["last_orders"].alias("last_orders"),
    )


def forecast_series(
    monthly: DataFrame, window: int = FORECAST_WINDOW, horizon: int = FORECAST_HORIZON
) -> DataFrame:
    """History and projection; the last actual is also the first forecast point.

    Empty when fewer than four months are known.
    """
    fitted = trend(monthly, window)
    last_month = monthly.agg(F.max("month")).scalar()
    is_last = F.col("month") == last_month
    seeded = F.when(is_last, F.col("orders"))
    history = monthly.select(
        "month", F.col("orders").alias("actual"), seeded.alias("forecast"),
        seeded.alias("lower"), seeded.alias("upper"),
    )
    step = F.col("step")
    expected = F.greatest(
        F.col("slope") * (F.col("w") - 1 + step) + F.col("intercept"), F.lit(0.0)
    )
    projection = (
        fitted.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
        .select(
            F.add_months("last_month", step).alias("month"),
            F.lit(None).cast("bigint").alias("actual"),
            F.bround(expected).cast("bigint").alias("forecast"),
            F.bround(F.greatest(expected - F.col("band"), F.lit(0.0))).cast("bigint").alias("lower"),
            F.bround(expected + F.col("band")).cast("bigint").alias("upper"),
        )
    )
    enough = monthly.agg(F.count(F.lit(1))).scalar() >= MIN_MONTHS
    return history.unionByName(projection).where(enough)


def month_over_month(monthly: DataFrame) -> DataFrame:
    """Each month's change against the previous kept month, as a share."""
    before = F.lag("orders").over(Window.orderBy("month"))  # one row per month
    return monthly.select("month", "orders", ((F.col("orders") - before) / before).alias("change"))


def forecast_summary(
    monthly: DataFrame, window: int = FORECAST_WINDOW, horizon: int = FORECAST_HORIZON
) -> DataFrame:
    """Headline figures of the projection."""
    growth = month_over_month(_fit_window(monthly, window)).agg(F.avg("change")).scalar()
    projected = forecast_series(monthly, window, horizon).where(F.col("actual").isNull()).agg(
        F.struct(
            F.sum("forecast").alias("total"), F.min_by("forecast", "month").alias("next_orders"),
            F.min("month").alias("next_month"),
        ).alias("p")
    ).scalar()
    months = monthly.agg(F.count(F.lit(1))).scalar()
    return trend(monthly, window).where(months >= MIN_MONTHS).select(
        months.alias("history_months"),
        F.date_format("last_month", "yyyy-MM").alias("last_month"),
        F.col("last_orders").cast("bigint").alias("last_orders"),
        F.lit(horizon).cast("bigint").alias("horizon_months"),
        F.date_format(projected["next_month"], "yyyy-MM").alias("next_month"),
        projected["next_orders"].alias("next_orders"),
        projected["total"].alias("projected_total"),
        (F.coalesce(growth, F.lit(0.0)) * 100).alias("avg_mom_growth_pct"),
        F.bround(F.col("slope")).cast("bigint").alias("trend_per_month"),
    )


def require_history(monthly: DataFrame) -> None:
    """Strict mode: fail instead of returning an empty projection."""
    if len(monthly.limit(MIN_MONTHS).take(MIN_MONTHS)) < MIN_MONTHS:
        raise NotEnoughHistory("not enough monthly history to forecast")
