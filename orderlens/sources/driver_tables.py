"""The nine order tables, derived from the star-schema test tables.

One text per view, valid in Spark SQL and in ANSI SQL alike, so the test oracle
and the Spark queries start from the same rows.  Only this shim knows the test
tables; the operators work on any source of the nine tables.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

VIEW_SQL: dict[str, str] = {
    # customer_id identifies the order's customer record; customer_unique_id the
    # person.  Guests order once, registered customers several times.
    "v_orders": """
        SELECT o.o_orderkey AS order_id,
               o.o_orderkey AS customer_id,
               CASE o.o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
                    ELSE 'canceled' END AS order_status,
               o.o_orderdate + INTERVAL '1' HOUR * CAST(o.o_orderkey % 24 AS INT)
                   AS order_purchase_timestamp,
               CASE WHEN o.o_orderkey % 97 = 0 THEN NULL
                    ELSE o.o_orderdate + INTERVAL '1' HOUR
                         * CAST(o.o_orderkey % 24 + o.o_custkey % 48 AS INT) END
                   AS order_approved_at,
               CASE WHEN o.o_orderstatus <> 'P' THEN o.o_orderdate + INTERVAL '1' DAY
                         * CAST(1 + o.o_orderkey % 3 AS INT) END
                   AS order_delivered_carrier_date,
               CASE WHEN o.o_orderstatus = 'F' THEN o.o_orderdate + INTERVAL '1' DAY
                         * CAST(q.max_quantity AS INT) END
                   AS order_delivered_customer_date,
               o.o_orderdate + INTERVAL '1' DAY
                   * (20 + 10 * CAST(substr(o.o_orderpriority, 1, 1) AS INT))
                   AS order_estimated_delivery_date
        FROM {orders} o
        LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS max_quantity
                   FROM {lineitem} GROUP BY l_orderkey) q
          ON q.l_orderkey = o.o_orderkey
    """,
    "v_customers": """
        SELECT o.o_orderkey AS customer_id,
               CASE WHEN o.o_orderkey % 10 < 6 THEN -1 - o.o_orderkey
                    ELSE o.o_custkey END AS customer_unique_id,
               CASE WHEN c.c_custkey % 41 = 0 THEN NULL
                    ELSE CAST(c.c_custkey % 500 AS INT) END AS customer_zip_code_prefix,
               c.c_mktsegment AS customer_city,
               n.n_name AS customer_state
        FROM {orders} o
        LEFT JOIN {customer} c ON c.c_custkey = o.o_custkey
        LEFT JOIN {nation} n ON n.n_nationkey = c.c_nationkey
    """,
    "v_items": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id,
               l_partkey AS product_id, l_suppkey AS seller_id,
               l_shipdate AS shipping_limit_date,
               l_extendedprice AS price, l_extendedprice * l_tax AS freight_value
        FROM {lineitem}
    """,
    "v_payments": """
        SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential,
               l_returnflag AS payment_type,
               CAST(round(l_discount * 100) AS INT) + 1 AS payment_installments,
               l_extendedprice * (1 + l_tax) AS payment_value
        FROM {lineitem}
    """,
    "v_reviews": """
        SELECT l_linenumber AS review_id, l_orderkey AS order_id,
               CAST(1 + (l_partkey + l_suppkey) % 5 AS INT) AS review_score,
               l_shipdate - INTERVAL '1' DAY AS review_creation_date,
               CASE WHEN l_linenumber = 7 THEN NULL ELSE l_shipdate END
                   AS review_answer_timestamp
        FROM {lineitem} WHERE l_linestatus = 'F'
    """,
    "v_products": """
        SELECT p_partkey AS product_id, p_type AS product_category_name,
               p_size * 100.0E0 AS product_weight_g, p_size * 1.0E0 AS product_length_cm,
               (p_size % 7 + 1) * 1.0E0 AS product_height_cm,
               (p_size % 11 + 1) * 1.0E0 AS product_width_cm
        FROM {part}
    """,
    "v_category_translation": """
        SELECT DISTINCT p_type AS product_category_name,
               lower(p_type) AS product_category_name_english
        FROM {part} WHERE p_type <> 'PROMO'
    """,
    "v_sellers": """
        SELECT s_suppkey AS seller_id,
               CAST(s_suppkey * 7 % 500 AS INT) AS seller_zip_code_prefix,
               s_name AS seller_city, n_name AS seller_state
        FROM {supplier} LEFT JOIN {nation} ON n_nationkey = s_nationkey
    """,
    "v_geolocation": """
        SELECT CAST(c_custkey % 500 AS INT) AS geolocation_zip_code_prefix,
               -33.0E0 + (c_custkey * 37 % 3800) / 100.0E0 AS geolocation_lat,
               -73.0E0 + (c_custkey * 53 % 3800) / 100.0E0 AS geolocation_lng
        FROM {customer}
    """,
}

STAR_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

LOGICAL_NAMES = {
    "orders": "v_orders", "customers": "v_customers", "items": "v_items",
    "payments": "v_payments", "reviews": "v_reviews", "products": "v_products",
    "sellers": "v_sellers", "geolocation": "v_geolocation",
    "category_translation": "v_category_translation",
}


@functools.cache
def _star_table(spark: SparkSession, application: str, path: str) -> DataFrame:
    return spark.read.parquet(path)


def star_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet test tables; its schema is read once per session."""
    return _star_table(spark, spark.sparkContext.applicationId, f"{sf_dir}/{name}.parquet")


@functools.cache
def _view(spark: SparkSession, application: str, sf_dir: str, name: str) -> DataFrame:
    sql = VIEW_SQL[name]
    inputs = {t: star_table(spark, sf_dir, t) for t in STAR_TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **inputs)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived order table."""
    return _view(spark, spark.sparkContext.applicationId, sf_dir, name)


def order_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All nine order tables, keyed by logical name."""
    return {logical: view(spark, sf_dir, name) for logical, name in LOGICAL_NAMES.items()}
