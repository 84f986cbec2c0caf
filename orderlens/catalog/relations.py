"""Shared relations of the SQL twins, in dependency order."""

from __future__ import annotations

from orderlens.schemas import DELAY_THRESHOLD, LOW_REVIEW_THRESHOLD
from orderlens.sources.driver_tables import STAR_TABLES, VIEW_SQL

_PLAIN = {t: t for t in STAR_TABLES}

RELATIONS: dict[str, str] = {name: sql.format(**_PLAIN) for name, sql in VIEW_SQL.items()}

RELATIONS["centroids"] = """
    SELECT geolocation_zip_code_prefix AS zip_prefix, avg(geolocation_lat) AS lat,
           avg(geolocation_lng) AS lng
    FROM v_geolocation WHERE geolocation_zip_code_prefix IS NOT NULL GROUP BY 1
"""

RELATIONS["item_lines"] = """
    SELECT i.order_id, i.order_item_id, i.product_id, i.seller_id, i.price, i.freight_value,
           t.product_category_name_english AS category, p.product_weight_g,
           p.product_length_cm * p.product_height_cm * p.product_width_cm AS volume,
           s.seller_state, s.seller_zip_code_prefix
    FROM v_items i
    LEFT JOIN v_products p ON p.product_id = i.product_id
    LEFT JOIN v_category_translation t ON t.product_category_name = p.product_category_name
    LEFT JOIN v_sellers s ON s.seller_id = i.seller_id
"""

RELATIONS["item_rollup"] = """
    SELECT order_id, count(order_item_id) AS n_items, count(DISTINCT seller_id) AS n_sellers,
           count(DISTINCT product_id) AS n_products,
           coalesce(sum(price), 0) AS total_price,
           coalesce(sum(freight_value), 0) AS total_freight,
           avg(product_weight_g) AS avg_product_weight_g,
           max(product_weight_g) AS max_product_weight_g,
           avg(volume) AS avg_product_volume_cm3
    FROM item_lines WHERE order_id IS NOT NULL GROUP BY order_id
"""

RELATIONS["category_mode"] = """
    SELECT order_id, category AS main_category FROM (
        SELECT order_id, category,
               row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, category) AS rn
        FROM item_lines WHERE category IS NOT NULL GROUP BY order_id, category
    ) ranked WHERE rn = 1
"""

RELATIONS["state_mode"] = """
    SELECT order_id, seller_state AS main_seller_state FROM (
        SELECT order_id, seller_state,
               row_number() OVER (PARTITION BY order_id ORDER BY count(*) DESC, seller_state) AS rn
        FROM item_lines WHERE seller_state IS NOT NULL GROUP BY order_id, seller_state
    ) ranked WHERE rn = 1
"""

RELATIONS["payment_totals"] = """
    SELECT order_id, coalesce(sum(payment_value), 0) AS total_payment_value,
           count(payment_sequential) AS n_payments,
           max(payment_installments) AS max_installments
    FROM v_payments WHERE order_id IS NOT NULL GROUP BY order_id
"""

RELATIONS["payment_main"] = """
    SELECT order_id, payment_type AS primary_payment_type FROM (
        SELECT order_id, payment_type,
               row_number() OVER (PARTITION BY order_id ORDER BY payment_value DESC,
                                  payment_sequential, payment_type DESC) AS rn
        FROM v_payments
    ) ranked WHERE rn = 1
"""

RELATIONS["review_latest"] = """
    SELECT order_id, review_score, review_creation_date FROM (
        SELECT order_id, review_score, review_creation_date,
               row_number() OVER (PARTITION BY order_id
                   ORDER BY review_answer_timestamp DESC NULLS FIRST, review_id DESC,
                            review_score DESC, review_creation_date DESC NULLS LAST) AS rn
        FROM v_reviews
    ) ranked WHERE rn = 1
"""

RELATIONS["order_base"] = """
    SELECT o.*, c.customer_unique_id, c.customer_zip_code_prefix, c.customer_city,
           c.customer_state, g.lat AS cust_lat, g.lng AS cust_lng
    FROM v_orders o
    LEFT JOIN v_customers c ON c.customer_id = o.customer_id
    LEFT JOIN centroids g ON g.zip_prefix = c.customer_zip_code_prefix
"""

RELATIONS["line_distance"] = """
    SELECT l.order_id,
           2 * 6371.0E0 * asin(sqrt(least(greatest(
               power(sin((radians(g.lat) - radians(b.cust_lat)) / 2), 2)
               + cos(radians(b.cust_lat)) * cos(radians(g.lat))
               * power(sin((radians(g.lng) - radians(b.cust_lng)) / 2), 2), 0), 1))) AS km
    FROM item_lines l
    JOIN order_base b ON b.order_id = l.order_id
    JOIN centroids g ON g.zip_prefix = l.seller_zip_code_prefix
    WHERE b.cust_lat IS NOT NULL
"""

RELATIONS["order_distance"] = """
    SELECT order_id, avg(km) AS customer_seller_distance_km FROM line_distance GROUP BY order_id
"""

def _days(start: str, end: str, unit: str = "86400.0E0") -> str:
    return f"(epoch({end}) - epoch({start})) / {unit}"


RELATIONS["order_level"] = f"""
    SELECT b.*, i.n_items, i.n_sellers, i.n_products, i.total_price, i.total_freight,
           i.avg_product_weight_g, i.max_product_weight_g, i.avg_product_volume_cm3,
           cm.main_category, sm.main_seller_state, pt.total_payment_value, pt.n_payments,
           pt.max_installments, pm.primary_payment_type, r.review_score,
           r.review_creation_date, d.customer_seller_distance_km,
           {_days('order_purchase_timestamp', 'order_delivered_customer_date')}
               AS actual_delivery_days,
           {_days('order_purchase_timestamp', 'order_estimated_delivery_date')}
               AS estimated_delivery_days,
           {_days('order_estimated_delivery_date', 'order_delivered_customer_date')}
               AS delivery_vs_estimate_days,
           {_days('order_purchase_timestamp', 'order_approved_at', '3600.0E0')}
               AS approval_delay_hours,
           CASE WHEN order_delivered_customer_date IS NULL THEN NULL
                ELSE coalesce(order_delivered_customer_date > order_estimated_delivery_date,
                              FALSE) END AS is_late
    FROM order_base b
    LEFT JOIN item_rollup i ON i.order_id = b.order_id
    LEFT JOIN category_mode cm ON cm.order_id = b.order_id
    LEFT JOIN state_mode sm ON sm.order_id = b.order_id
    LEFT JOIN payment_totals pt ON pt.order_id = b.order_id
    LEFT JOIN payment_main pm ON pm.order_id = b.order_id
    LEFT JOIN review_latest r ON r.order_id = b.order_id
    LEFT JOIN order_distance d ON d.order_id = b.order_id
"""

RELATIONS["features"] = """
    SELECT order_id, month(order_purchase_timestamp) AS purchase_month,
           isodow(order_purchase_timestamp) - 1 AS purchase_dow,
           hour(order_purchase_timestamp) AS purchase_hour,
           CASE WHEN isodow(order_purchase_timestamp) >= 6 THEN 1 ELSE 0 END
               AS purchase_is_weekend,
           total_freight / nullif(coalesce(total_price, 0) + coalesce(total_freight, 0), 0)
               AS freight_ratio,
           CASE WHEN customer_state = main_seller_state THEN 0 ELSE 1 END
               AS cross_state_shipment,
           estimated_delivery_days, approval_delay_hours, n_items, n_sellers, n_products,
           total_price, total_freight, avg_product_weight_g, max_product_weight_g,
           avg_product_volume_cm3, max_installments, n_payments, customer_seller_distance_km,
           main_category, primary_payment_type, customer_state, main_seller_state,
           is_late, review_score <= 2 AS low_review,
           (order_status IN ('canceled', 'unavailable')) OR coalesce(review_score = 1, FALSE)
               AS is_complaint,
           order_status
    FROM order_level
"""


def _level(p: str, threshold: float) -> str:
    return (f"CASE WHEN {p} >= {max(2 * threshold, 0.5)} THEN 'high' "
            f"WHEN {p} >= {threshold} THEN 'medium' ELSE 'low' END")


# A deterministic stand-in score per delivered order, so that everything after the
# models can be checked exactly.
DELAY_STAND_IN = "(order_id * 7919 % 1000) / 1000.0E0"
REVIEW_STAND_IN = "(order_id * 104729 % 997) / 997.0E0"

RELATIONS["scored"] = f"""
    SELECT *, {_level('delay_probability', DELAY_THRESHOLD)} AS delay_risk,
           {_level('low_review_probability', LOW_REVIEW_THRESHOLD)} AS low_review_risk,
           delay_probability >= {DELAY_THRESHOLD} AS delay_flag,
           low_review_probability >= {LOW_REVIEW_THRESHOLD} AS low_review_flag
    FROM (SELECT order_id, order_purchase_timestamp, customer_state, main_category, total_price,
                 n_items, estimated_delivery_days, actual_delivery_days, review_score, is_late,
                 {DELAY_STAND_IN} AS delay_probability,
                 {REVIEW_STAND_IN} AS low_review_probability
          FROM order_level WHERE order_status = 'delivered') d
"""

RELATIONS["customer_rollup"] = """
    SELECT customer_unique_id AS customer, count(*) AS orders,
           sum(coalesce(total_payment_value, total_price, 0)) AS spend
    FROM order_level WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id
"""

# Labelled scores of both models, for the metrics.
RELATIONS["labelled"] = """
    SELECT 'delay' AS model, s.order_id, CAST(f.is_late AS INT) AS label,
           s.delay_probability AS score
    FROM scored s JOIN features f ON f.order_id = s.order_id WHERE f.is_late IS NOT NULL
    UNION ALL
    SELECT 'low_review', s.order_id, CAST(f.low_review AS INT), s.low_review_probability
    FROM scored s JOIN features f ON f.order_id = s.order_id WHERE f.low_review IS NOT NULL
"""

RELATIONS["curve"] = """
    SELECT model, score, pos, neg,
           sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
           sum(pos) OVER (PARTITION BY model) AS all_pos,
           sum(neg) OVER (PARTITION BY model) AS all_neg
    FROM (SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos,
                 count(*) FILTER (WHERE label = 0) AS neg FROM labelled GROUP BY model, score) c
    WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
"""

RELATIONS["best_cut"] = """
    SELECT model, score AS threshold, f1 FROM (
        SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, score) AS rn FROM (
            SELECT model, score, 2.0E0 * tp / (all_pos + tp + fp) AS f1 FROM curve) f) g
    WHERE rn = 1
"""

RELATIONS["rank_metrics"] = """
    SELECT model, sum(pos * (all_neg - fp + neg / 2.0E0)) / max(all_pos * all_neg) AS roc_auc,
           sum(pos * 1.0E0 / all_pos * tp / (tp + fp)) AS pr_auc
    FROM curve GROUP BY model
"""

RELATIONS["cut_counts"] = """
    SELECT l.model, c.cut, c.threshold,
           count(*) FILTER (WHERE score >= c.threshold AND label = 1) AS tp,
           count(*) FILTER (WHERE score >= c.threshold AND label = 0) AS fp,
           count(*) FILTER (WHERE score < c.threshold AND label = 1) AS fn,
           count(*) FILTER (WHERE score < c.threshold AND label = 0) AS tn
    FROM labelled l JOIN (
        SELECT model, 'tuned' AS cut, threshold FROM best_cut
        UNION ALL SELECT model, 'half', 0.5E0 FROM best_cut) c ON c.model = l.model
    GROUP BY l.model, c.cut, c.threshold
"""

RELATIONS["point_metrics"] = """
    SELECT *, coalesce(tp * 1.0E0 / nullif(tp + fp, 0), 0) AS precision,
           coalesce(tp * 1.0E0 / nullif(tp + fn, 0), 0) AS recall,
           coalesce(2.0E0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
           (tp + tn) * 1.0E0 / (tp + fp + fn + tn) AS accuracy
    FROM cut_counts
"""
