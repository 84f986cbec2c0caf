"""Queries over scored orders.

The probabilities are the deterministic stand-in of ``catalog.relations`` so that
the rules after the models can be checked value by value; the model queries live
in ``catalog.modelling``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlens.catalog.core import order_level, query
from orderlens.catalog.orders import r
from orderlens.catalog.relations import DELAY_STAND_IN, REVIEW_STAND_IN
from orderlens.functions import scalar as S
from orderlens.operators import features, risk
from orderlens.operators.order_level import item_lines, with_delivery_metrics
from orderlens.session import scratch_path, staged
from orderlens.sources.driver_tables import order_tables, view
from orderlens.sources.writers import read_back_csv, write_action_queue


def score_stand_in(orders):
    """Delivered orders with stand-in probabilities, flags and levels."""
    return risk.with_risk(
        orders.where(F.col("order_status") == "delivered").withColumns({
            risk.DELAY_P: F.expr(DELAY_STAND_IN), risk.REVIEW_P: F.expr(REVIEW_STAND_IN),
        })
    )


def scored(spark, sf_dir):
    """Scored orders with their order-level attributes."""
    return score_stand_in(order_level(spark, sf_dir))


def scored_orders_only(spark, sf_dir):
    """Scored orders for the rules that read nothing but the probabilities."""
    return score_stand_in(view(spark, sf_dir, "v_orders"))


@query("p16_flags_and_levels", """
    SELECT order_id, round(delay_probability, 4) AS delay_probability, delay_flag, delay_risk,
           round(low_review_probability, 4) AS low_review_probability, low_review_flag,
           low_review_risk FROM scored
""")
def flags_and_levels(spark, sf_dir):
    return scored_orders_only(spark, sf_dir).select(
        "order_id", r(risk.DELAY_P), "delay_flag", "delay_risk", r(risk.REVIEW_P),
        "low_review_flag", "low_review_risk",
    )


_PRIORITY = """CASE WHEN delay_risk = 'high' OR low_review_risk = 'high' THEN 'high'
    WHEN delay_risk = 'medium' OR low_review_risk = 'medium' THEN 'medium' END"""
_PLAYBOOK = f"""CASE WHEN delay_risk = 'high' THEN '{risk.PLAY_EXPEDITE}'
    WHEN low_review_risk = 'high' THEN '{risk.PLAY_APOLOGY}'
    WHEN delay_risk = 'medium' THEN '{risk.PLAY_CONFIRM}' ELSE '{risk.PLAY_CHECK_IN}' END"""
_ACTION = f"""CASE WHEN delay_risk = 'high' THEN '{risk.ACTION_EXPEDITE}'
    WHEN low_review_risk = 'high' THEN '{risk.ACTION_SUPPORT}'
    WHEN delay_risk = 'medium' THEN '{risk.ACTION_CONFIRM}'
    WHEN low_review_risk = 'medium' THEN '{risk.ACTION_CHECK_IN}'
    ELSE '{risk.ACTION_NONE}' END"""


@query("p17_p18_p19_priority_and_actions", f"""
    SELECT order_id, {_PRIORITY} AS priority, {_PLAYBOOK} AS playbook,
           {_ACTION} AS recommended_action FROM scored
""")
def priority_and_actions(spark, sf_dir):
    return scored_orders_only(spark, sf_dir).select(
        "order_id", risk.priority().alias("priority"), risk.playbook().alias("playbook"),
        risk.recommended_action().alias("recommended_action"),
    )


_ROUTES = """concat(CASE WHEN low_review_risk IN ('high', 'medium') THEN 'support,' ELSE '' END,
    'email,sheets',
    CASE WHEN delay_risk = 'high' OR low_review_risk = 'high' THEN ',slack' ELSE '' END)"""


@query("p20_routes", f"""
    SELECT order_id, {_ROUTES} AS routes,
           CAST(len(string_split({_ROUTES}, ',')) AS BIGINT) AS n_routes FROM scored
""")
def routes(spark, sf_dir):
    return scored_orders_only(spark, sf_dir).select(
        "order_id", F.array_join(risk.routes(), ",").alias("routes"),
        F.size(risk.routes()).cast("bigint").alias("n_routes"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _text_case(texts: dict[str, str], fill: bool) -> str:
    def one(text: str) -> str:
        if not fill:
            return _quoted(text)
        return (f"replace(replace({_quoted(text)}, '{{what}}', what), '{{where}}', wherein)")

    return (f"CASE WHEN delay_risk IN ('high', 'medium') THEN {one(texts['delay'])} "
            f"WHEN low_review_risk IN ('high', 'medium') THEN {one(texts['review'])} "
            f"ELSE {one(texts['none'])} END")


@query("p21_outreach_text", f"""
    SELECT order_id, {_text_case(risk.DETAILED_TEXTS, True)} AS message,
           {_text_case(risk.PLAIN_TEXTS, False)} AS template
    FROM (SELECT *, coalesce(' of ' || replace(main_category, '_', ' '), '') AS what,
                 coalesce(' in ' || customer_state, '') AS wherein FROM scored) s
""")
def outreach(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "order_id", risk.outreach_text().alias("message"),
        risk.outreach_template().alias("template"),
    )


@query("p14_derived_at_scoring", """
    SELECT order_id, CAST(month(order_purchase_timestamp) AS DOUBLE) AS purchase_month,
           CAST(isodow(order_purchase_timestamp) - 1 AS DOUBLE) AS purchase_dow,
           CAST(hour(order_purchase_timestamp) AS DOUBLE) AS purchase_hour,
           CASE WHEN isodow(order_purchase_timestamp) >= 6 THEN 1.0E0 ELSE 0.0E0 END
               AS purchase_is_weekend,
           round(CASE WHEN n_items IS NOT NULL AND total_price + total_freight <> 0
                 THEN total_freight / (total_price + total_freight) END, 6) AS freight_ratio,
           CASE WHEN customer_state IS NOT NULL AND main_seller_state IS NOT NULL
                THEN CASE WHEN customer_state <> main_seller_state THEN 1.0E0 ELSE 0.0E0 END END
               AS cross_state_shipment
    FROM order_level
""")
def derived_at_scoring(spark, sf_dir):
    uploads = order_level(spark, sf_dir).select(
        "order_id", S.iso_timestamp(F.col("order_purchase_timestamp")).alias(
            "order_purchase_timestamp"),
        "total_price", "total_freight", "customer_state", "main_seller_state",
    )
    return features.derive_missing(uploads).select(
        "order_id", "purchase_month", "purchase_dow", "purchase_hour", "purchase_is_weekend",
        r("freight_ratio", 6), "cross_state_shipment",
    )


@query("p15_model_input", """
    SELECT order_id, CAST(n_items AS DOUBLE) AS n_items, round(total_price, 2) AS total_price,
           round(approval_delay_hours, 4) AS approval_delay_hours, main_category,
           nullif(CASE WHEN main_category = 'large' THEN '' ELSE primary_payment_type END, '')
               AS primary_payment_type
    FROM features
""")
def model_input(spark, sf_dir):
    table = features.feature_table(order_level(spark, sf_dir))
    # as a caller would send it: numbers as text, blanks for what is not known
    sent = table.select(
        "order_id",
        F.col("n_items").cast("string").alias("n_items"),
        F.coalesce(F.col("total_price").cast("string"), F.lit("n/a")).alias("total_price"),
        F.coalesce(F.col("approval_delay_hours"), F.lit(float("nan"))).alias("approval_delay_hours"),
        "main_category",
        F.when(F.col("main_category") == "large", "").otherwise(F.col("primary_payment_type"))
        .alias("primary_payment_type"),
    )
    return features.model_input(sent, "delay").select(
        "order_id", "n_items", r("total_price", 2), r("approval_delay_hours"), "main_category",
        "primary_payment_type",
    )


@query("p22_row_ids", """
    SELECT CASE WHEN order_status = 'delivered' THEN CAST(order_id AS VARCHAR)
                WHEN order_status = 'shipped' THEN 'alt-' || order_id ELSE 'row' END AS id_kind,
           CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS distinct_ids
    FROM v_orders GROUP BY 1
""")
def row_ids(spark, sf_dir):
    orders = view(spark, sf_dir, "v_orders")
    uploads = orders.select(
        F.when(F.col("order_status") == "delivered", F.col("order_id").cast("string"))
        .otherwise("").alias("order_id"),
        F.when(F.col("order_status") == "shipped", F.concat(F.lit("alt-"), "order_id")).alias("id"),
    )
    kind = F.when(F.col("order_id").startswith("row-"), "row").otherwise(F.col("order_id"))
    # the generated ids depend on the scan order; what must hold is that they are distinct
    return (
        risk.with_row_ids(uploads).groupBy(kind.alias("id_kind"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("order_id").alias("distinct_ids"))
    )


@query("p23_display_rows", """
    SELECT CAST(order_id AS VARCHAR) AS order_id, customer_state, main_category,
           CAST(n_items AS DOUBLE) AS n_items, round(total_price, 2) AS total_price,
           round(estimated_delivery_days, 2) AS estimated_delivery_days,
           round(actual_delivery_days, 2) AS actual_delivery_days,
           CAST(review_score AS DOUBLE) AS review_score,
           strftime(order_purchase_timestamp, '%Y-%m-%d') AS purchase_date,
           round(delay_probability, 4) AS delay_probability, delay_risk, delay_flag,
           round(low_review_probability, 4) AS low_review_probability, low_review_risk,
           low_review_flag
    FROM scored
""")
def display_rows(spark, sf_dir):
    return risk.display_row(scored(spark, sf_dir))


@query("p25_late_indicator", """
    SELECT order_id, CAST(CASE WHEN delivery_vs_estimate_days > 0 THEN 1
                               WHEN delivery_vs_estimate_days <= 0 THEN 0 END AS BIGINT)
               AS is_late_int FROM order_level
""")
def late_indicator(spark, sf_dir):
    rows = with_delivery_metrics(view(spark, sf_dir, "v_orders"))
    return rows.select(
        "order_id",
        risk.late_indicator(F.col("delivery_vs_estimate_days")).cast("bigint").alias("is_late_int"),
    )


@query("a15_risk_distribution", """
    WITH e(bucket, low, high) AS (VALUES ('0–10%', -0.01, 0.1), ('10–20%', 0.1, 0.2),
        ('20–30%', 0.2, 0.3), ('30–50%', 0.3, 0.5), ('50%+', 0.5, 1.01))
    SELECT bucket,
           CAST((SELECT count(*) FROM scored WHERE delay_probability > e.low
                 AND delay_probability <= CAST(e.high AS DOUBLE)) AS BIGINT) AS delay,
           CAST((SELECT count(*) FROM scored WHERE low_review_probability > e.low
                 AND low_review_probability <= CAST(e.high AS DOUBLE)) AS BIGINT) AS low_review
    FROM e
""")
def risk_distribution(spark, sf_dir):
    return risk.risk_distribution(scored_orders_only(spark, sf_dir))


@query("a16_dashboard_summary", """
    SELECT CAST((SELECT count(*) FROM order_level) AS BIGINT) AS total_orders,
           CAST((SELECT count(*) FROM order_level WHERE order_status = 'delivered') AS BIGINT)
               AS delivered_orders,
           CAST(count(*) AS BIGINT) AS scored_orders,
           round(avg(CASE WHEN delay_flag THEN 100.0E0 ELSE 0 END), 4) AS delay_at_risk_pct,
           round(avg(CASE WHEN low_review_flag THEN 100.0E0 ELSE 0 END), 4)
               AS low_review_at_risk_pct,
           CAST(count(*) FILTER (WHERE delay_risk = 'high' OR low_review_risk = 'high') AS BIGINT)
               AS high_risk_orders,
           round(avg(delay_probability), 6) AS avg_delay_probability,
           0.1529E0 AS delay_threshold, 0.2407E0 AS low_review_threshold
    FROM scored
""")
def dashboard_summary(spark, sf_dir):
    orders = view(spark, sf_dir, "v_orders")
    return risk.dashboard_summary(score_stand_in(orders), orders).select(
        "total_orders", "delivered_orders", "scored_orders", r("delay_at_risk_pct"),
        r("low_review_at_risk_pct"), "high_risk_orders", r("avg_delay_probability", 6),
        "delay_threshold", "low_review_threshold",
    )


@query("a17_batch_summary", """
    SELECT CAST(count(*) AS BIGINT) AS orders,
           CAST(count(*) FILTER (WHERE delay_flag) AS BIGINT) AS delay_at_risk,
           CAST(count(*) FILTER (WHERE low_review_flag) AS BIGINT) AS low_review_at_risk,
           CAST(count(*) FILTER (WHERE delay_risk = 'high' OR low_review_risk = 'high') AS BIGINT)
               AS high_risk,
           round(avg(CASE WHEN delay_flag THEN 100.0E0 ELSE 0 END), 4) AS delay_at_risk_pct,
           round(avg(CASE WHEN low_review_flag THEN 100.0E0 ELSE 0 END), 4)
               AS low_review_at_risk_pct
    FROM scored
""")
def batch_summary(spark, sf_dir):
    return risk.batch_summary(scored_orders_only(spark, sf_dir)).select(
        "orders", "delay_at_risk", "low_review_at_risk", "high_risk", r("delay_at_risk_pct"),
        r("low_review_at_risk_pct"),
    )


@query("a18_digest_counts", """
    SELECT CAST(count(*) AS BIGINT) AS total_orders,
           CAST(count(*) FILTER (WHERE order_status = 'delivered') AS BIGINT) AS delivered_orders,
           CAST(count(*) FILTER (WHERE is_late) AS BIGINT) AS late_deliveries,
           CAST(count(*) FILTER (WHERE low_review) AS BIGINT) AS low_reviews,
           CAST((SELECT count(*) FROM scored WHERE delay_flag) AS BIGINT) AS delay_at_risk,
           round((SELECT avg(CASE WHEN delay_flag THEN 100.0E0 ELSE 0 END) FROM scored), 4)
               AS delay_at_risk_pct,
           CAST((SELECT count(*) FROM scored WHERE low_review_flag) AS BIGINT)
               AS low_review_at_risk,
           round((SELECT avg(CASE WHEN low_review_flag THEN 100.0E0 ELSE 0 END) FROM scored), 4)
               AS low_review_at_risk_pct,
           CAST((SELECT count(*) FROM scored
                 WHERE greatest(delay_probability, low_review_probability) >= 0.5) AS BIGINT)
               AS high_risk_orders
    FROM features
""")
def digest_counts(spark, sf_dir):
    level = order_level(spark, sf_dir)
    return risk.digest_counts(
        features.add_labels(level), scored_orders_only(spark, sf_dir)
    ).select(
        "total_orders", "delivered_orders", "late_deliveries", "low_reviews", "delay_at_risk",
        r("delay_at_risk_pct"), "low_review_at_risk", r("low_review_at_risk_pct"),
        "high_risk_orders",
    )


_GROUPS = "\nUNION ALL\n".join(
    f"""SELECT * FROM (SELECT '{c}' AS dimension, {c} AS "group", CAST(count(*) AS BIGINT) AS orders,
        CAST(count(*) FILTER (WHERE delay_risk <> 'low' OR low_review_risk <> 'low') AS BIGINT)
        AS at_risk FROM scored WHERE {c} IS NOT NULL GROUP BY {c}
        ORDER BY at_risk DESC, {c} LIMIT 5) t"""
    for c in ("main_category", "customer_state")
)


@query("a19_risk_by_group", _GROUPS)
def risk_by_group(spark, sf_dir):
    rows = scored(spark, sf_dir)
    parts = [
        risk.risk_by_group(rows, c).select(F.lit(c).alias("dimension"), "*")
        for c in ("main_category", "customer_state")
    ]
    return parts[0].unionByName(parts[1])


@query("a20_roi", """
    WITH b AS (SELECT round(avg(CASE WHEN total_price > 0 THEN total_price END)) AS order_value,
                      count(*) FILTER (WHERE delay_risk <> 'low') AS delay_at_risk,
                      count(*) FILTER (WHERE low_review_risk <> 'low') AS review_at_risk
               FROM scored),
    c AS (SELECT *, round(review_at_risk * 0.35E0) AS reviews_prevented,
                 round(delay_at_risk * 0.35E0) AS delays_caught FROM b)
    SELECT order_value, CAST(delay_at_risk AS BIGINT) AS delay_at_risk,
           CAST(review_at_risk AS BIGINT) AS review_at_risk,
           CAST(reviews_prevented AS BIGINT) AS reviews_prevented,
           CAST(delays_caught AS BIGINT) AS delays_caught,
           round(reviews_prevented * order_value * 1.5E0, 2) AS review_value,
           round(delays_caught * 18.0E0, 2) AS delay_value,
           round(reviews_prevented * order_value * 1.5E0 + delays_caught * 18.0E0, 2)
               AS total_value
    FROM c
""")
def roi(spark, sf_dir):
    return risk.roi(scored(spark, sf_dir)).select(
        "order_value", "delay_at_risk", "review_at_risk", "reviews_prevented", "delays_caught",
        r("review_value", 2), r("delay_value", 2), r("total_value", 2),
    )


_QUEUE = f"""
    queue AS (SELECT *, {_PRIORITY} AS priority,
                     CASE WHEN {_PRIORITY} = 'high' THEN 1000 ELSE 0 END
                     + greatest(delay_probability, low_review_probability) AS urgency
              FROM scored WHERE {_PRIORITY} IS NOT NULL
              ORDER BY urgency DESC, order_id LIMIT 24)
"""


@query("k3_action_queue", f"""
    WITH {_QUEUE}
    SELECT order_id, priority, round(urgency, 6) AS urgency, {_PLAYBOOK} AS playbook FROM queue
""")
def action_queue(spark, sf_dir):
    return risk.action_queue(scored_orders_only(spark, sf_dir)).select(
        "order_id", "priority", r("urgency", 6), risk.playbook().alias("playbook")
    )


@query("a21_funnel", f"""
    WITH {_QUEUE}
    SELECT CAST((SELECT count(*) FROM v_orders) AS BIGINT) AS scanned,
           CAST(greatest((SELECT count(*) FROM queue), round(
               (SELECT avg(CASE WHEN delay_risk <> 'low' OR low_review_risk <> 'low' THEN 1.0E0
                           ELSE 0 END) FROM scored) * (SELECT count(*) FROM v_orders))) AS BIGINT)
               AS flagged,
           CAST((SELECT count(*) FROM queue) AS BIGINT) AS queued
""")
def funnel(spark, sf_dir):
    orders = view(spark, sf_dir, "v_orders")
    rows = score_stand_in(orders)
    return risk.funnel(rows, orders, risk.action_queue(rows))


@query("j14_open_queue", f"""
    WITH {_QUEUE},
    resolved AS (SELECT DISTINCT order_id FROM v_reviews WHERE review_score >= 4)
    SELECT q.order_id, q.priority, CAST((SELECT round(100.0E0 * count(*) / 24) FROM queue x
                WHERE x.order_id IN (SELECT order_id FROM resolved)) AS BIGINT) AS coverage_pct
    FROM queue q WHERE q.order_id NOT IN (SELECT order_id FROM resolved)
""")
def open_queue(spark, sf_dir):
    queue = risk.action_queue(scored_orders_only(spark, sf_dir))
    # stand-in for the action log: orders whose buyer ended up satisfied
    resolved = view(spark, sf_dir, "v_reviews").where(F.col("review_score") >= 4)
    share = risk.coverage(queue, resolved).select("coverage_pct").scalar()
    return risk.open_queue(queue, resolved).select(
        "order_id", "priority", share.alias("coverage_pct")
    )


@query("k1_top_at_risk", """
    SELECT order_id, customer_state, main_category, round(total_price, 2) AS total_price,
           round(delay_probability, 4) AS delay_probability,
           round(low_review_probability, 4) AS low_review_probability,
           round(greatest(delay_probability, low_review_probability), 4) AS combined_risk
    FROM scored
    ORDER BY greatest(delay_probability, low_review_probability) DESC, order_id LIMIT 10
""")
def top_at_risk(spark, sf_dir):
    return risk.top_at_risk(scored(spark, sf_dir))


@query("k2_recent_late_orders", """
    SELECT order_id, customer_state, main_category, round(total_price, 2) AS total_price,
           strftime(order_purchase_timestamp, '%Y-%m-%d') AS purchase_date
    FROM order_level WHERE is_late ORDER BY order_purchase_timestamp DESC, order_id LIMIT 10
""")
def recent_late(spark, sf_dir):
    return risk.recent_late_orders(order_level(spark, sf_dir))


@query("k4_sorted_orders", """
    SELECT order_id, round(delay_probability, 4) AS delay_probability,
           round(total_price, 2) AS total_price, n_items IS NULL AS price_unknown FROM scored
""")
def sorted_orders(spark, sf_dir):
    return risk.sorted_orders(scored(spark, sf_dir), "total_price").select(
        "order_id", r(risk.DELAY_P), r("total_price", 2),
        F.col("n_items").isNull().alias("price_unknown"),
    )


@query("k5_top_uploads", f"""
    SELECT order_id, round(greatest(delay_probability, low_review_probability), 6)
               AS top_probability, {_ACTION} AS recommended_action
    FROM scored ORDER BY greatest(delay_probability, low_review_probability) DESC, order_id
    LIMIT 8
""")
def top_uploads(spark, sf_dir):
    return risk.ranked_uploads(scored_orders_only(spark, sf_dir), 8).select(
        "order_id", r("top_probability", 6), "recommended_action"
    )


@query("k8_ranked_uploads", f"""
    SELECT order_id, round(greatest(delay_probability, low_review_probability), 6)
               AS top_probability, {_ACTION} AS recommended_action FROM scored
""")
def ranked_uploads(spark, sf_dir):
    return risk.ranked_uploads(scored_orders_only(spark, sf_dir)).select(
        "order_id", r("top_probability", 6), "recommended_action"
    )


@query("k7_batch_cap", """
    SELECT CAST(least(1000, (SELECT count(*) FROM v_orders)) AS BIGINT) AS capped_orders,
           CAST((SELECT count(*) FROM v_orders) AS BIGINT) AS all_orders
""")
def batch_cap(spark, sf_dir):
    orders = view(spark, sf_dir, "v_orders")
    capped = features.cap_batch(orders, 1000).agg(F.count(F.lit(1))).scalar()
    return features.cap_batch(orders, None).agg(F.count(F.lit(1)).alias("all_orders")).select(
        capped.alias("capped_orders"), "all_orders"
    )


@query("j13_scored_with_uploads", """
    WITH uploads AS (
        SELECT order_id, category AS main_category, seller_state AS customer_state FROM (
            SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY order_item_id DESC,
                       product_id DESC, seller_id DESC, price DESC) AS rn FROM item_lines) x
        WHERE rn = 1)
    SELECT s.order_id, round(s.delay_probability, 4) AS delay_probability,
           coalesce(u.main_category, 'unknown') AS main_category,
           coalesce(u.customer_state, 'unknown') AS customer_state
    FROM scored s LEFT JOIN uploads u ON u.order_id = s.order_id
""")
def scored_with_uploads(spark, sf_dir):
    t = order_tables(spark, sf_dir)
    lines = item_lines(t["items"], t["products"], t["category_translation"], t["sellers"])
    uploads = lines.select(
        "order_id", F.col("product_category_name_english").alias("main_category"),
        F.col("seller_state").alias("customer_state"),
        F.struct("order_item_id", "product_id", "seller_id", "price").alias("position"),
    )
    rows = score_stand_in(t["orders"]).select(
        "order_id", risk.DELAY_P, F.lit(None).cast("string").alias("main_category"),
        F.lit(None).cast("string").alias("customer_state"),
    )
    return risk.join_uploads(rows, uploads, "position").select(
        "order_id", r(risk.DELAY_P), "main_category", "customer_state"
    )


@query("s13_order_lookup", """
    SELECT order_id, delay_risk, low_review_risk FROM scored
    WHERE order_id = (SELECT max(order_id) FROM scored)
""")
def order_lookup(spark, sf_dir):
    rows = scored_orders_only(spark, sf_dir)
    wanted = rows.agg(F.max("order_id")).scalar()
    return rows.where(F.col("order_id") == wanted).select(
        "order_id", "delay_risk", "low_review_risk"
    )


@query("s10_action_queue_export", f"""
    WITH {_QUEUE}
    SELECT CAST(order_id AS VARCHAR) AS order_id, priority, delay_risk,
           printf('%.3f', delay_probability) AS delay_prob, low_review_risk,
           printf('%.3f', low_review_probability) AS low_review_prob,
           coalesce(customer_state, '') AS state, coalesce(main_category, '') AS category,
           {_PLAYBOOK} AS recommended_action,
           concat(CASE WHEN low_review_risk IN ('high', 'medium')
                       THEN 'Zendesk / Gorgias | ' ELSE '' END,
                  'Gmail / Outlook | Google Sheets',
                  CASE WHEN delay_risk = 'high' OR low_review_risk = 'high'
                       THEN ' | Slack' ELSE '' END) AS routes_to
    FROM queue
""")
def queue_export(spark, sf_dir):
    path = scratch_path(spark, "action-queue")
    write_action_queue(risk.action_queue(scored(spark, sf_dir)), path)
    return read_back_csv(spark, path)


@query("x8_order_book_text", """
    WITH top8 AS (SELECT *, greatest(delay_probability, low_review_probability) AS tp
                  FROM scored ORDER BY tp DESC, order_id LIMIT 8),
    cats AS (SELECT main_category AS g, count(*) AS n, count(*) FILTER (
                 WHERE delay_risk <> 'low' OR low_review_risk <> 'low') AS k
             FROM scored WHERE main_category IS NOT NULL GROUP BY 1 ORDER BY k DESC, g LIMIT 5),
    states AS (SELECT customer_state AS g, count(*) AS n, count(*) FILTER (
                 WHERE delay_risk <> 'low' OR low_review_risk <> 'low') AS k
             FROM scored WHERE customer_state IS NOT NULL GROUP BY 1 ORDER BY k DESC, g LIMIT 5),
    s AS (SELECT count(*) AS n, count(*) FILTER (WHERE delay_flag) AS d,
                 count(*) FILTER (WHERE low_review_flag) AS l,
                 count(*) FILTER (WHERE delay_risk = 'high' OR low_review_risk = 'high') AS h
          FROM scored)
    SELECT 'Order book, scored just now by the calibrated models:' || chr(10)
        || '- Orders scored: ' || n || chr(10)
        || '- Delay at-risk: ' || d || ' ('
        || regexp_replace(printf('%.1f', d * 100.0E0 / n), '\\.0$', '') || '%)' || chr(10)
        || '- Low-review at-risk: ' || l || ' ('
        || regexp_replace(printf('%.1f', l * 100.0E0 / n), '\\.0$', '') || '%)' || chr(10)
        || '- High risk on either model: ' || h || chr(10) || chr(10)
        || 'Highest-risk orders:' || chr(10)
        || (SELECT string_agg('- ' || order_id || ': delay '
               || printf('%.1f', delay_probability * 100) || '% (' || delay_risk
               || '), low-review ' || printf('%.1f', low_review_probability * 100) || '% ('
               || low_review_risk || ')', chr(10) ORDER BY tp DESC, order_id) FROM top8)
        || chr(10) || chr(10) || 'At-risk by category (at-risk / total):' || chr(10)
        || (SELECT string_agg('- ' || g || ': ' || k || '/' || n, chr(10) ORDER BY k DESC, g)
            FROM cats)
        || chr(10) || chr(10) || 'At-risk by customer state (at-risk / total):' || chr(10)
        || (SELECT string_agg('- ' || g || ': ' || k || '/' || n, chr(10) ORDER BY k DESC, g)
            FROM states) AS text
    FROM s
""")
def order_book_text(spark, sf_dir):
    rows = scored(spark, sf_dir).select(
        "order_id", "main_category", "customer_state", risk.DELAY_P, risk.REVIEW_P,
        "delay_risk", "delay_flag", "low_review_risk", "low_review_flag",
    )
    return risk.order_book_text(staged(rows, "scored"))
