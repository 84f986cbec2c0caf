"""Queries over the order-level build, features and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlens.catalog.core import order_level, query
from orderlens.functions import scalar as S
from orderlens.operators import features, order_level as build
from orderlens.schemas import ORDER_TIMESTAMPS, model_inputs
from orderlens.sources.driver_tables import order_tables, view


def r(column: str, digits: int = 4):
    return F.round(F.col(column), digits).alias(column)


def big(column: str):
    return F.col(column).cast("bigint").alias(column)


@query("s2_full_scan", """
    SELECT CAST(count(*) AS BIGINT) AS line_rows, round(sum(l_extendedprice), 2) AS price_sum,
           CAST(sum(l_linenumber) AS BIGINT) AS number_sum FROM lineitem
""")
def full_scan(spark, sf_dir):
    return view(spark, sf_dir, "v_items").agg(
        F.count(F.lit(1)).alias("line_rows"),
        F.round(F.sum("price"), 2).alias("price_sum"),
        F.sum("order_item_id").cast("bigint").alias("number_sum"),
    )


@query("a1_item_rollup", """
    SELECT order_id, CAST(n_items AS BIGINT) AS n_items, CAST(n_sellers AS BIGINT) AS n_sellers,
           CAST(n_products AS BIGINT) AS n_products, round(total_price, 2) AS total_price,
           round(total_freight, 4) AS total_freight,
           round(avg_product_weight_g, 4) AS avg_product_weight_g,
           round(max_product_weight_g, 4) AS max_product_weight_g,
           round(avg_product_volume_cm3, 4) AS avg_product_volume_cm3
    FROM item_rollup
""")
def item_rollup(spark, sf_dir):
    t = order_tables(spark, sf_dir)
    items = build.order_items(t["items"], t["products"], t["category_translation"], t["sellers"])
    return items.select(
        "order_id", "n_items", "n_sellers", "n_products", r("total_price", 2),
        r("total_freight"), r("avg_product_weight_g"), r("max_product_weight_g"),
        r("avg_product_volume_cm3"),
    )


@query("a2_modal_values", """
    SELECT i.order_id, main_category, main_seller_state FROM item_rollup i
    LEFT JOIN category_mode c ON c.order_id = i.order_id
    LEFT JOIN state_mode s ON s.order_id = i.order_id
""")
def modal_values(spark, sf_dir):
    t = order_tables(spark, sf_dir)
    items = build.order_items(t["items"], t["products"], t["category_translation"], t["sellers"])
    return items.select("order_id", "main_category", "main_seller_state")


@query("a3_payment_rollup", """
    SELECT order_id, round(total_payment_value, 4) AS total_payment_value,
           CAST(n_payments AS BIGINT) AS n_payments,
           CAST(max_installments AS BIGINT) AS max_installments FROM payment_totals
""")
def payment_rollup(spark, sf_dir):
    return build.payment_rollup(view(spark, sf_dir, "v_payments")).select(
        "order_id", r("total_payment_value"), "n_payments", big("max_installments")
    )


@query("w1_main_payment_type", "SELECT order_id, primary_payment_type FROM payment_main")
def main_payment_type(spark, sf_dir):
    return build.payment_rollup(view(spark, sf_dir, "v_payments")).select(
        "order_id", "primary_payment_type"
    )


@query("w2_latest_review", """
    SELECT order_id, CAST(review_score AS BIGINT) AS review_score,
           strftime(review_creation_date, '%Y-%m-%d %H:%M:%S') AS review_creation_date
    FROM review_latest
""")
def latest_review(spark, sf_dir):
    return build.latest_review(view(spark, sf_dir, "v_reviews")).select(
        "order_id", big("review_score"),
        F.date_format("review_creation_date", "yyyy-MM-dd HH:mm:ss").alias("review_creation_date"),
    )


@query("a4_zip_centroids", """
    SELECT CAST(zip_prefix AS BIGINT) AS zip_prefix, round(lat, 6) AS lat, round(lng, 6) AS lng
    FROM centroids
""")
def zip_centroids(spark, sf_dir):
    return build.geo_centroids(view(spark, sf_dir, "v_geolocation")).select(
        big("zip_prefix"), r("lat", 6), r("lng", 6)
    )


@query("j1_products_translated", """
    SELECT p.product_id, t.product_category_name_english, p.product_weight_g,
           p.product_length_cm * p.product_height_cm * p.product_width_cm AS product_volume_cm3
    FROM v_products p LEFT JOIN v_category_translation t
      ON t.product_category_name = p.product_category_name
""")
def products_translated(spark, sf_dir):
    t = order_tables(spark, sf_dir)
    return build.translated_products(t["products"], t["category_translation"])


@query("j2_j3_item_lines", """
    SELECT order_id, CAST(order_item_id AS BIGINT) AS order_item_id, product_id, seller_id, price,
           round(freight_value, 4) AS freight_value, category AS product_category_name_english,
           product_weight_g, volume AS product_volume_cm3, seller_state,
           CAST(seller_zip_code_prefix AS BIGINT) AS seller_zip_code_prefix
    FROM item_lines
""")
def item_lines(spark, sf_dir):
    t = order_tables(spark, sf_dir)
    return build.item_lines(
        t["items"], t["products"], t["category_translation"], t["sellers"]
    ).select(
        "order_id", big("order_item_id"), "product_id", "seller_id", "price",
        r("freight_value"), "product_category_name_english", "product_weight_g",
        "product_volume_cm3", "seller_state", big("seller_zip_code_prefix"),
    )


@query("j4_orders_customers", """
    SELECT order_id, customer_unique_id, customer_state, order_status,
           CAST(customer_zip_code_prefix AS BIGINT) AS customer_zip_code_prefix
    FROM order_base
""")
def orders_customers(spark, sf_dir):
    t = order_tables(spark, sf_dir)
    return t["orders"].join(t["customers"], "customer_id", "left").select(
        "order_id", "customer_unique_id", "customer_state", "order_status",
        big("customer_zip_code_prefix"),
    )


@query("j5_order_level", """
    SELECT order_id, order_status, customer_unique_id, customer_state,
           CAST(n_items AS BIGINT) AS n_items, CAST(n_sellers AS BIGINT) AS n_sellers,
           round(total_price, 2) AS total_price, round(total_freight, 4) AS total_freight,
           main_category, main_seller_state,
           round(total_payment_value, 4) AS total_payment_value, primary_payment_type,
           CAST(review_score AS BIGINT) AS review_score, is_late,
           round(actual_delivery_days, 6) AS actual_delivery_days,
           round(customer_seller_distance_km, 4) AS customer_seller_distance_km
    FROM order_level
""")
def order_level_table(spark, sf_dir):
    return order_level(spark, sf_dir).select(
        "order_id", "order_status", "customer_unique_id", "customer_state", "n_items",
        "n_sellers", r("total_price", 2), r("total_freight"), "main_category",
        "main_seller_state", r("total_payment_value"), "primary_payment_type",
        big("review_score"), "is_late", r("actual_delivery_days", 6),
        r("customer_seller_distance_km"),
    )


@query("j6_customer_centroids", """
    SELECT order_id, CAST(customer_zip_code_prefix AS BIGINT) AS customer_zip_code_prefix,
           round(cust_lat, 6) AS cust_lat, round(cust_lng, 6) AS cust_lng FROM order_base
""")
def customer_centroids(spark, sf_dir):
    t = order_tables(spark, sf_dir)
    centroids = build.geo_centroids(t["geolocation"])
    return (
        t["orders"].join(t["customers"], "customer_id", "left")
        .join(
            centroids.withColumnRenamed("zip_prefix", "customer_zip_code_prefix"),
            "customer_zip_code_prefix", "left",
        )
        .select("order_id", big("customer_zip_code_prefix"),
                F.round("lat", 6).alias("cust_lat"), F.round("lng", 6).alias("cust_lng"))
    )


@query("j7_a5_order_distance", """
    SELECT order_id, round(customer_seller_distance_km, 4) AS customer_seller_distance_km
    FROM order_level
""")
def order_distance(spark, sf_dir):
    return order_level(spark, sf_dir).select("order_id", r("customer_seller_distance_km"))


@query("p4_haversine_centroid_spread", """
    SELECT CAST(g.geolocation_zip_code_prefix AS BIGINT) AS zip_prefix, round(avg(
        2 * 6371.0E0 * asin(sqrt(least(greatest(
            power(sin((radians(c.lat) - radians(g.geolocation_lat)) / 2), 2)
            + cos(radians(g.geolocation_lat)) * cos(radians(c.lat))
            * power(sin((radians(c.lng) - radians(g.geolocation_lng)) / 2), 2), 0), 1)))), 4)
        AS mean_km
    FROM v_geolocation g JOIN centroids c ON c.zip_prefix = g.geolocation_zip_code_prefix
    GROUP BY 1
""")
def centroid_spread(spark, sf_dir):
    points = view(spark, sf_dir, "v_geolocation")
    centroids = build.geo_centroids(points)
    km = S.haversine_km(
        F.col("geolocation_lat"), F.col("geolocation_lng"), F.col("lat"), F.col("lng")
    )
    return (
        points.withColumnRenamed("geolocation_zip_code_prefix", "zip_prefix")
        .join(centroids, "zip_prefix")
        .groupBy(F.col("zip_prefix").cast("bigint").alias("zip_prefix"))
        .agg(F.round(F.avg(km), 4).alias("mean_km"))
    )


@query("j12_fan_out_check", """
    SELECT CAST((SELECT count(*) FROM v_orders) AS BIGINT) AS orders_in,
           CAST(count(*) AS BIGINT) AS rows_out,
           CAST(count(DISTINCT order_id) AS BIGINT) AS distinct_orders,
           CAST(count(*) - count(DISTINCT order_id) AS BIGINT) AS repeated_orders
    FROM order_level
""")
def fan_out_check(spark, sf_dir):
    return build.fan_out_report(order_level(spark, sf_dir), view(spark, sf_dir, "v_orders"))


@query("p1_parsed_timestamps", """
    SELECT order_id, CAST(epoch(order_purchase_timestamp) AS BIGINT) AS purchased,
           CAST(epoch(order_approved_at) AS BIGINT) AS approved,
           CAST(epoch(order_delivered_carrier_date) AS BIGINT) AS handed_over,
           CAST(epoch(order_delivered_customer_date) AS BIGINT) AS delivered,
           CAST(epoch(order_estimated_delivery_date) AS BIGINT) AS promised
    FROM v_orders
""")
def parsed_timestamps(spark, sf_dir):
    as_text = view(spark, sf_dir, "v_orders").withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ORDER_TIMESTAMPS}
    )
    parsed = build.parse_order_timestamps(as_text)
    names = ("purchased", "approved", "handed_over", "delivered", "promised")
    return parsed.select(
        "order_id",
        *[F.unix_seconds(F.col(c).cast("timestamp")).alias(n)
          for c, n in zip(ORDER_TIMESTAMPS, names)],
    )


@query("p3_product_volume", """
    SELECT product_id, round(product_length_cm * product_height_cm * product_width_cm, 4)
               AS product_volume_cm3 FROM v_products
""")
def product_volume(spark, sf_dir):
    t = order_tables(spark, sf_dir)
    return build.translated_products(t["products"], t["category_translation"]).select(
        "product_id", r("product_volume_cm3")
    )


@query("p5_p6_delivery_metrics", """
    SELECT order_id, round((epoch(order_delivered_customer_date)
                            - epoch(order_purchase_timestamp)) / 86400.0E0, 6)
               AS actual_delivery_days,
           round((epoch(order_estimated_delivery_date)
                  - epoch(order_purchase_timestamp)) / 86400.0E0, 6) AS estimated_delivery_days,
           round((epoch(order_delivered_customer_date)
                  - epoch(order_estimated_delivery_date)) / 86400.0E0, 6)
               AS delivery_vs_estimate_days,
           round((epoch(order_approved_at) - epoch(order_purchase_timestamp)) / 3600.0E0, 6)
               AS approval_delay_hours,
           CASE WHEN order_delivered_customer_date IS NULL THEN NULL
                ELSE order_delivered_customer_date > order_estimated_delivery_date END AS is_late,
           coalesce(order_delivered_customer_date > order_estimated_delivery_date, FALSE)
               AS is_late_two_valued
    FROM v_orders
""")
def delivery_metrics(spark, sf_dir):
    return build.with_delivery_metrics(view(spark, sf_dir, "v_orders")).select(
        "order_id", r("actual_delivery_days", 6), r("estimated_delivery_days", 6),
        r("delivery_vs_estimate_days", 6), r("approval_delay_hours", 6), "is_late",
        S.late_flag_two_valued(F.col("delivery_vs_estimate_days")).alias("is_late_two_valued"),
    )


@query("p2_p24_tri_state_labels", """
    SELECT order_id, CASE WHEN order_delivered_customer_date IS NULL THEN NULL
                          ELSE order_delivered_customer_date > order_estimated_delivery_date END
               AS is_late,
           CASE WHEN order_delivered_customer_date IS NULL THEN NULL
                WHEN order_delivered_customer_date > order_estimated_delivery_date THEN 1.0E0
                ELSE 0.0E0 END AS is_late_int
    FROM v_orders
""")
def tri_state_labels(spark, sf_dir):
    rows = build.with_delivery_metrics(view(spark, sf_dir, "v_orders"))
    # the spellings a row store hands back: words for some rows, digits for others
    stored = F.when(F.col("order_status") == "delivered", F.initcap(F.col("is_late").cast("string"))) \
        .otherwise(F.col("is_late").cast("int").cast("string"))
    flag = S.tri_state(stored)
    return rows.select(
        "order_id", flag.alias("is_late"), flag.cast("int").cast("double").alias("is_late_int")
    )


@query("p7_calendar_parts", """
    SELECT order_id, CAST(month(order_purchase_timestamp) AS BIGINT) AS purchase_month,
           CAST(isodow(order_purchase_timestamp) - 1 AS BIGINT) AS purchase_dow,
           CAST(hour(order_purchase_timestamp) AS BIGINT) AS purchase_hour,
           CAST(CASE WHEN isodow(order_purchase_timestamp) >= 6 THEN 1 ELSE 0 END AS BIGINT)
               AS purchase_is_weekend
    FROM v_orders
""")
def calendar(spark, sf_dir):
    parts = features.calendar_parts(F.col("order_purchase_timestamp"))
    return view(spark, sf_dir, "v_orders").select(
        "order_id", *[e.cast("bigint").alias(n) for n, e in parts.items()]
    )


@query("p8_p9_ratio_and_cross_state", """
    SELECT order_id, round(freight_ratio, 6) AS freight_ratio,
           CAST(cross_state_shipment AS BIGINT) AS cross_state_shipment FROM features
""")
def ratio_and_cross_state(spark, sf_dir):
    return features.engineer_features(order_level(spark, sf_dir)).select(
        "order_id", r("freight_ratio", 6), big("cross_state_shipment")
    )


_FEATURE_SQL = ", ".join(
    f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in model_inputs("delay")[0]
)


@query("p10_features", f"""
    SELECT order_id, {_FEATURE_SQL}, main_category, primary_payment_type, customer_state,
           main_seller_state FROM features
""")
def feature_projection(spark, sf_dir):
    numeric, categorical = model_inputs("delay")
    return features.engineer_features(order_level(spark, sf_dir)).select(
        "order_id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in numeric], *categorical
    )


@query("p12_labels", "SELECT order_id, is_late, low_review, is_complaint, order_status FROM features")
def labels(spark, sf_dir):
    return features.add_labels(order_level(spark, sf_dir))


@query("j8_feature_table", """
    SELECT order_id, CAST(n_items AS BIGINT) AS n_items, round(freight_ratio, 6) AS freight_ratio,
           main_category, is_late, low_review, is_complaint, order_status FROM features
""")
def feature_label_table(spark, sf_dir):
    return features.feature_table(order_level(spark, sf_dir)).select(
        "order_id", "n_items", r("freight_ratio", 6), "main_category", "is_late", "low_review",
        "is_complaint", "order_status",
    )


@query("p11_model_columns", "\nUNION ALL\n".join(
    f"SELECT '{model}' AS model, CAST({i} AS BIGINT) AS position, '{name}' AS feature, "
    f"CAST((SELECT count({name}) FROM (SELECT f.*, o.actual_delivery_days, "
    f"o.delivery_vs_estimate_days, CAST(f.is_late AS INT) AS is_late_int FROM features f "
    f"JOIN order_level o ON o.order_id = f.order_id) x) AS BIGINT) AS known_rows"
    for model in ("delay", "low_review")
    for i, name in enumerate(sum(model_inputs(model), []))
))
def model_columns(spark, sf_dir):
    level = order_level(spark, sf_dir)
    frame = features.with_outcome(features.feature_table(level), level)
    lists = {m: sum(model_inputs(m), []) for m in ("delay", "low_review")}
    counted = frame.agg(*[F.count(c).alias(c) for c in lists["low_review"]])
    rows = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(i).cast("bigint").alias("position"),
                 F.lit(c).alias("feature"), F.col(c).alias("known_rows"))
        for m, names in lists.items() for i, c in enumerate(names)
    ])
    return counted.select(F.inline(rows))


@query("p13_populations", """
    SELECT model, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(y) AS BIGINT) AS positives FROM (
        SELECT 'delay' AS model, CAST(is_late AS INT) AS y FROM features
        WHERE order_status = 'delivered' AND is_late IS NOT NULL
        UNION ALL
        SELECT 'low_review', CAST(low_review AS INT) FROM features
        WHERE order_status = 'delivered' AND low_review IS NOT NULL) p
    GROUP BY model
""")
def populations(spark, sf_dir):
    level = order_level(spark, sf_dir)
    labelled = F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(c).cast("int").alias("y"))
        for m, c in (("delay", "is_late"), ("low_review", "low_review"))
    ])
    return (
        features.add_labels(level).where(F.col("order_status") == "delivered")
        .select(F.inline(labelled)).where(F.col("y").isNotNull())
        .groupBy("model")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("y").cast("bigint").alias("positives"))
    )


@query("j9_features_with_outcome", """
    SELECT f.order_id, round(o.actual_delivery_days, 6) AS actual_delivery_days,
           round(o.delivery_vs_estimate_days, 6) AS delivery_vs_estimate_days,
           CASE WHEN f.is_late THEN 1.0E0 WHEN NOT f.is_late THEN 0.0E0 END AS is_late_int,
           strftime(o.order_purchase_timestamp, '%Y-%m-%d') AS purchase_date,
           CAST(o.review_score AS BIGINT) AS review_score
    FROM features f JOIN order_level o ON o.order_id = f.order_id
""")
def features_with_outcome(spark, sf_dir):
    level = order_level(spark, sf_dir)
    joined = features.with_outcome(
        features.feature_table(level), level, "order_purchase_timestamp", "review_score"
    )
    return joined.select(
        "order_id", r("actual_delivery_days", 6), r("delivery_vs_estimate_days", 6),
        "is_late_int",
        F.date_format("order_purchase_timestamp", "yyyy-MM-dd").alias("purchase_date"),
        big("review_score"),
    )
