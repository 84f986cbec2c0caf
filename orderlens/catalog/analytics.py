"""Queries over segments, forecast and the data profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlens.catalog.core import order_level, query
from orderlens.catalog.orders import r
from orderlens.functions import scalar as S
from orderlens.operators import forecast, profile, segments, sketch_profile
from orderlens.operators.order_level import with_delivery_metrics
from orderlens.schemas import DASHBOARD_MONTH_MIN, FORECAST_MONTH_MIN
from orderlens.session import scratch_path, staged
from orderlens.sources import writers
from orderlens.sources.driver_tables import view


def customers(spark, sf_dir):
    """The customer roll-up, written once because its readers scan it repeatedly."""
    return staged(segments.customer_rollup(order_level(spark, sf_dir)), "customers")


@query("a6_customer_rollup", """
    SELECT customer, CAST(orders AS BIGINT) AS orders, round(spend, 4) AS spend
    FROM customer_rollup
""")
def customer_rollup(spark, sf_dir):
    return segments.customer_rollup(order_level(spark, sf_dir)).select(
        "customer", "orders", r("spend")
    )


@query("a9_value_loyalty_grid", """
    WITH m AS (SELECT quantile_cont(spend, 0.5) AS median, sum(spend) AS total, count(*) AS n
               FROM customer_rollup),
    marked AS (SELECT spend >= median AS high_value, orders > 1 AS repeat, spend, orders
               FROM customer_rollup, m),
    cells(high_value, repeat, key, name, action) AS (VALUES
        (TRUE, TRUE, 'champions', 'Champions',
         'Reward loyalty and protect against churn.'),
        (TRUE, FALSE, 'high_value_firsttimers', 'High-value first-timers',
         'Win back with a targeted second-purchase offer.'),
        (FALSE, TRUE, 'loyal_regulars', 'Loyal regulars',
         'Nurture the relationship and grow basket size.'),
        (FALSE, FALSE, 'one_time_buyers', 'One-time buyers',
         'Activate: turn the first order into a second.'))
    SELECT c.key, c.name, c.action, CAST(count(k.spend) AS BIGINT) AS customers,
           round(count(k.spend) * 100.0E0 / (SELECT n FROM m), 4) AS share_pct,
           round(coalesce(avg(k.spend), 0), 4) AS avg_spend,
           round(coalesce(avg(k.orders), 0), 4) AS avg_orders,
           round(coalesce(sum(k.spend), 0) * 100.0E0 / (SELECT total FROM m), 4)
               AS revenue_share_pct
    FROM cells c LEFT JOIN marked k ON k.high_value = c.high_value AND k.repeat = c.repeat
    GROUP BY c.key, c.name, c.action
""")
def value_loyalty_grid(spark, sf_dir):
    return segments.value_loyalty_grid(customers(spark, sf_dir)).select(
        "key", "name", "action", "customers", r("share_pct"), r("avg_spend"), r("avg_orders"),
        r("revenue_share_pct"),
    )


_RANKED = """
    ranked AS (SELECT customer, spend, row_number() OVER (ORDER BY spend, customer) AS r,
                      count(*) OVER () AS n FROM customer_rollup),
    tiered AS (SELECT customer, spend, r, greatest(1, CAST(ceil(4.0E0 * (r - 1)
                      / nullif(n - 1, 0)) AS BIGINT)) AS tier_no FROM ranked)
"""


@query("a10_spend_tiers", f"""
    WITH {_RANKED}
    SELECT CAST(tier_no AS BIGINT) AS tier_no,
           CASE tier_no WHEN 1 THEN 'Budget' WHEN 2 THEN 'Standard' WHEN 3 THEN 'Premium'
                ELSE 'VIP' END AS tier,
           CAST(count(*) AS BIGINT) AS customers,
           round(sum(spend) * 100.0E0 / (SELECT sum(spend) FROM customer_rollup), 4)
               AS revenue_share_pct
    FROM tiered GROUP BY tier_no
""")
def spend_tiers(spark, sf_dir):
    return segments.spend_tiers(customers(spark, sf_dir)).select(
        F.col("tier_no").cast("bigint").alias("tier_no"), "tier", "customers",
        r("revenue_share_pct"),
    )


@query("w3_spend_ranks", f"""
    WITH {_RANKED}
    SELECT customer, round(spend, 4) AS spend, CAST(r AS BIGINT) AS spend_rank,
           CAST(tier_no AS BIGINT) AS tier_no FROM tiered
""")
def spend_ranks(spark, sf_dir):
    return segments.spend_ranks(customers(spark, sf_dir)).select(
        "customer", r("spend"), "spend_rank", "tier_no"
    )


@query("a7_top_categories", """
    SELECT main_category AS category, CAST(count(*) AS BIGINT) AS orders,
           round(sum(coalesce(total_payment_value, total_price, 0)), 2) AS revenue
    FROM order_level WHERE main_category IS NOT NULL GROUP BY main_category
    ORDER BY sum(coalesce(total_payment_value, total_price, 0)) DESC, category LIMIT 8
""")
def top_categories(spark, sf_dir):
    return segments.top_categories(order_level(spark, sf_dir)).select(
        "category", "orders", r("revenue", 2)
    )


@query("a8_top_states", """
    SELECT customer_state AS state, CAST(count(DISTINCT customer_unique_id) AS BIGINT) AS customers,
           round(sum(coalesce(total_payment_value, total_price, 0))
                 / count(DISTINCT customer_unique_id), 4) AS avg_spend
    FROM order_level WHERE customer_state IS NOT NULL GROUP BY customer_state
    ORDER BY customers DESC, state LIMIT 8
""")
def top_states(spark, sf_dir):
    return segments.top_states(order_level(spark, sf_dir)).select(
        "state", "customers", r("avg_spend")
    )


@query("a11_segment_summary", """
    SELECT CAST(count(*) AS BIGINT) AS customers, CAST(sum(orders) AS BIGINT) AS orders,
           round(count(*) FILTER (WHERE orders > 1) * 100.0E0 / count(*), 4) AS repeat_rate_pct,
           round(sum(spend) / sum(orders), 4) AS avg_order_value
    FROM customer_rollup
""")
def segment_summary(spark, sf_dir):
    return segments.segment_summary(
        segments.customer_rollup(order_level(spark, sf_dir))
    ).select("customers", "orders", r("repeat_rate_pct"), r("avg_order_value"))


_MONTHS = """
    SELECT CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS month,
           count(*) AS orders FROM v_orders WHERE order_purchase_timestamp IS NOT NULL GROUP BY 1
"""


@query("a12_monthly_orders", f"""
    SELECT strftime(month, '%Y-%m') AS month, CAST(orders AS BIGINT) AS orders,
           orders >= {FORECAST_MONTH_MIN} AS kept_for_forecast
    FROM ({_MONTHS}) m WHERE orders >= {DASHBOARD_MONTH_MIN}
""")
def monthly(spark, sf_dir):
    return forecast.monthly_orders(view(spark, sf_dir, "v_orders"), DASHBOARD_MONTH_MIN).select(
        F.date_format("month", "yyyy-MM").alias("month"), "orders",
        (F.col("orders") >= FORECAST_MONTH_MIN).alias("kept_for_forecast"),
    )


@query("w5_month_over_month", f"""
    SELECT strftime(month, '%Y-%m') AS month, CAST(orders AS BIGINT) AS orders,
           round((orders - lag(orders) OVER (ORDER BY month)) * 1.0E0
                 / lag(orders) OVER (ORDER BY month), 6) AS change
    FROM ({_MONTHS}) m WHERE orders >= {FORECAST_MONTH_MIN}
""")
def month_over_month(spark, sf_dir):
    kept = forecast.monthly_orders(view(spark, sf_dir, "v_orders"), FORECAST_MONTH_MIN)
    return forecast.month_over_month(kept).select(
        F.date_format("month", "yyyy-MM").alias("month"), "orders", r("change", 6)
    )


_TREND = f"""
    kept AS (SELECT * FROM ({_MONTHS}) m WHERE orders >= {FORECAST_MONTH_MIN}),
    win AS (SELECT month, orders, row_number() OVER (ORDER BY month) - 1 AS x
            FROM (SELECT * FROM kept ORDER BY month DESC LIMIT 9) last9),
    line AS (SELECT regr_slope(orders, x) AS slope, regr_intercept(orders, x) AS icpt,
                    count(*) AS w, avg(orders) AS mean, max(month) AS last_month,
                    max_by(orders, month) AS last_orders FROM win),
    band AS (SELECT greatest(1.96E0 * CASE WHEN max(w) > 2
                       THEN stddev_samp(orders - (slope * x + icpt)) ELSE 0 END,
                    0.08E0 * max(mean)) AS band FROM win, line),
    steps AS (SELECT unnest(range(1, 7)) AS step),
    future AS (SELECT CAST(last_month + to_months(CAST(step AS INT)) AS DATE) AS month,
                      greatest(slope * (w - 1 + step) + icpt, 0) AS yhat, band
               FROM steps, line, band WHERE (SELECT count(*) FROM kept) >= 4)
"""


@query("a13_forecast_series", f"""
    WITH {_TREND}
    SELECT strftime(month, '%Y-%m') AS month, CAST(orders AS BIGINT) AS actual,
           CAST(CASE WHEN month = (SELECT max(month) FROM kept) THEN orders END AS BIGINT)
               AS forecast,
           CAST(CASE WHEN month = (SELECT max(month) FROM kept) THEN orders END AS BIGINT)
               AS lower,
           CAST(CASE WHEN month = (SELECT max(month) FROM kept) THEN orders END AS BIGINT)
               AS upper
    FROM kept WHERE (SELECT count(*) FROM kept) >= 4
    UNION ALL
    SELECT strftime(month, '%Y-%m'), NULL, CAST(round_even(yhat, 0) AS BIGINT),
           CAST(round_even(greatest(yhat - band, 0), 0) AS BIGINT),
           CAST(round_even(yhat + band, 0) AS BIGINT)
    FROM future
""")
def forecast_series(spark, sf_dir):
    kept = forecast.monthly_orders(view(spark, sf_dir, "v_orders"), FORECAST_MONTH_MIN)
    return forecast.forecast_series(kept).select(
        F.date_format("month", "yyyy-MM").alias("month"), "actual", "forecast", "lower", "upper"
    )


@query("a14_forecast_summary", f"""
    WITH {_TREND},
    moved AS (SELECT (orders - lag(orders) OVER (ORDER BY month)) * 1.0E0
                     / lag(orders) OVER (ORDER BY month) AS change FROM win)
    SELECT CAST((SELECT count(*) FROM kept) AS BIGINT) AS history_months,
           strftime(last_month, '%Y-%m') AS last_month,
           CAST(last_orders AS BIGINT) AS last_orders, CAST(6 AS BIGINT) AS horizon_months,
           strftime((SELECT min(month) FROM future), '%Y-%m') AS next_month,
           CAST((SELECT min_by(round_even(yhat, 0), month) FROM future) AS BIGINT)
               AS next_orders,
           CAST((SELECT sum(round_even(yhat, 0)) FROM future) AS BIGINT) AS projected_total,
           round((SELECT avg(change) FROM moved) * 100, 4) AS avg_mom_growth_pct,
           CAST(round_even(slope, 0) AS BIGINT) AS trend_per_month
    FROM line WHERE (SELECT count(*) FROM kept) >= 4
""")
def forecast_summary(spark, sf_dir):
    kept = forecast.monthly_orders(view(spark, sf_dir, "v_orders"), FORECAST_MONTH_MIN)
    return forecast.forecast_summary(kept).select(
        "history_months", "last_month", "last_orders", "horizon_months", "next_month",
        "next_orders", "projected_total", r("avg_mom_growth_pct"), "trend_per_month",
    )


_PROFILED = [
    ("order_id", "bigint"), ("order_status", "string"), ("n_items", "bigint"),
    ("main_category", "string"), ("customer_state", "string"), ("review_score", "int"),
    ("is_late", "boolean"), ("max_installments", "int"), ("primary_payment_type", "string"),
    ("customer_zip_code_prefix", "int"),
]


@query("a22_quality_profile", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, "
    f"CAST(count(*) - count({c}) AS BIGINT) AS n_missing, "
    f"round((count(*) - count({c})) * 100.0E0 / count(*), 4) AS pct_missing, "
    f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique FROM order_level"
    for c, t in _PROFILED
))
def quality_profile(spark, sf_dir):
    level = order_level(spark, sf_dir).select(*[c for c, _ in _PROFILED])
    return profile.quality_profile(level).select(
        "column_name", "dtype", "n_missing", r("pct_missing"), "n_unique"
    )


_SKETCHED = [c for c, _ in _PROFILED] + [
    c for c in profile.DESCRIBED if c not in dict(_PROFILED)
] + ["order_purchase_timestamp"]


@query("a22_merged_profile", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS n_missing, "
    f"round((count(*) - count({c})) * 100.0E0 / count(*), 4) AS pct_missing, "
    "TRUE AS unique_within_3_pct, "
    + (f"CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 4) AS mean, "
       f"round(stddev_samp({c}), 4) AS sd, round(CAST(min({c}) AS DOUBLE), 4) AS min, "
       f"round(CAST(max({c}) AS DOUBLE), 4) AS max FROM order_level" if c in profile.DESCRIBED else
       "CAST(NULL AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS sd, "
       "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max FROM order_level")
    for c in _SKETCHED
))
def merged_profile(spark, sf_dir):
    """A table filled by two writes; its profile is merged from sketches after each."""
    level = staged(order_level(spark, sf_dir).select(*_SKETCHED), "profiled")
    table, path = scratch_path(spark, "profiled-table"), scratch_path(spark, "sketches")
    shipped = F.col("order_status").eqNullSafe("shipped")
    for batch in (level.where(~shipped), level.where(shipped)):
        writers.upsert_table(batch, table, part=writers.period_part(pattern="yyyy"))
        sketch_profile.refresh(spark, table, path)
    stored = sketch_profile.stored_sketches(spark, path)
    exact = profile.quality_profile(level).select("column_name", F.col("n_unique").alias("distinct"))
    within = F.abs(F.col("n_unique") - F.col("distinct")) <= 0.03 * F.col("distinct")
    return (
        sketch_profile.quality_profile(stored).join(exact, "column_name")
        .join(sketch_profile.describe(stored).withColumnRenamed("metric", "column_name"), "column_name", "left")
        .select(
            "column_name", "n_missing", r("pct_missing"), within.alias("unique_within_3_pct"),
            "n", r("mean"), r("sd"), r("min"), r("max"),
        )
    )


@query("a23_describe", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS metric, CAST(count({c}) AS BIGINT) AS n, round(avg({c}), 4) AS mean, "
    f"round(stddev_samp({c}), 4) AS sd, round(CAST(min({c}) AS DOUBLE), 4) AS min, "
    f"round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25, "
    f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS q50, "
    f"round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75, "
    f"round(CAST(max({c}) AS DOUBLE), 4) AS max FROM order_level"
    for c in profile.DESCRIBED
))
def describe(spark, sf_dir):
    level = staged(order_level(spark, sf_dir).select(*profile.DESCRIBED), "described")
    return profile.describe(level).select(
        "metric", "n", *[r(c) for c in ("mean", "sd", "min", "q25", "q50", "q75", "max")]
    )


@query("a24_value_counts", """
    SELECT 'order_status' AS column_name, order_status AS value, CAST(count(*) AS BIGINT) AS n
    FROM order_level WHERE order_status IS NOT NULL GROUP BY order_status
    UNION ALL
    SELECT 'review_score', CAST(review_score AS VARCHAR), CAST(count(*) AS BIGINT)
    FROM order_level WHERE review_score IS NOT NULL GROUP BY review_score
""")
def value_counts(spark, sf_dir):
    level = order_level(spark, sf_dir)
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
        for c in ("order_status", "review_score")
    ])
    both = level.select(F.inline(pairs)).where(F.col("value").isNotNull())
    return both.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


@query("a25_sanity_counts", """
    SELECT CAST(count(*) FILTER (WHERE actual_delivery_days < 0) AS BIGINT) AS negative_durations,
           CAST(count(*) FILTER (WHERE order_delivered_customer_date IS NULL) AS BIGINT)
               AS no_delivery,
           CAST(count(*) FILTER (WHERE review_score IS NULL) AS BIGINT) AS no_review
    FROM order_level
""")
def sanity_counts(spark, sf_dir):
    return profile.sanity_counts(order_level(spark, sf_dir))


@query("a26_lateness_histogram", """
    WITH c AS (SELECT least(greatest(delivery_vs_estimate_days, -40.0E0), 40.0E0) AS days
               FROM order_level WHERE order_status = 'delivered'
               AND delivery_vs_estimate_days IS NOT NULL),
    b AS (SELECT min(days) AS low, (max(days) - min(days)) / 60 AS width FROM c),
    n AS (SELECT least(CAST(floor((days - low) / width) AS BIGINT), 59) AS bin, count(*) AS orders
          FROM c, b GROUP BY 1)
    SELECT CAST(g.bin AS BIGINT) AS bin, round(low + g.bin * width, 4) AS bin_start,
           CAST(coalesce(n.orders, 0) AS BIGINT) AS orders
    FROM (SELECT unnest(range(0, 60)) AS bin) g CROSS JOIN b LEFT JOIN n ON n.bin = g.bin
""")
def lateness_histogram(spark, sf_dir):
    # the order table alone carries the lateness: no join to the other tables
    orders = with_delivery_metrics(view(spark, sf_dir, "v_orders"))
    return profile.lateness_histogram(orders).select("bin", r("bin_start"), "orders")


@query("a27_delivery_headline", """
    SELECT CAST(count(*) AS BIGINT) AS delivered,
           round(avg(CASE WHEN coalesce(delivery_vs_estimate_days > 0, FALSE) THEN 100.0E0
                          ELSE 0 END), 4) AS late_rate_pct,
           round(quantile_cont(actual_delivery_days, 0.5), 4) AS median_actual_days,
           round(quantile_cont(estimated_delivery_days, 0.5), 4) AS median_estimated_days
    FROM order_level WHERE order_status = 'delivered'
""")
def delivery_headline(spark, sf_dir):
    orders = with_delivery_metrics(view(spark, sf_dir, "v_orders"))
    return profile.delivery_headline(orders).select(
        "delivered", r("late_rate_pct"), r("median_actual_days"), r("median_estimated_days")
    )


@query("a27_score_by_lateness", """
    SELECT coalesce(delivery_vs_estimate_days > 0, FALSE) AS is_late_two_valued,
           round(avg(review_score), 4) AS mean_score,
           CAST(count(review_score) AS BIGINT) AS reviews
    FROM order_level WHERE order_status = 'delivered' GROUP BY 1
""")
def score_by_lateness(spark, sf_dir):
    return profile.score_by_lateness(order_level(spark, sf_dir)).select(
        "is_late_two_valued", r("mean_score"), "reviews"
    )


@query("p6_eda_late_by_status", """
    SELECT order_status, CAST(count(*) AS BIGINT) AS orders,
           CAST(count(*) FILTER (WHERE coalesce(order_delivered_customer_date
                > order_estimated_delivery_date, FALSE)) AS BIGINT) AS late_orders
    FROM v_orders GROUP BY order_status
""")
def late_by_status(spark, sf_dir):
    late = S.late_flag_two_valued(F.col("delivery_vs_estimate_days"))
    return (
        with_delivery_metrics(view(spark, sf_dir, "v_orders")).groupBy("order_status")
        .agg(F.count(F.lit(1)).alias("orders"), F.count_if(late).alias("late_orders"))
    )
