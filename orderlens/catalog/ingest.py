"""Queries over sources, sinks and incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlens.catalog.core import order_level, query
from orderlens.catalog.orders import big, r
from orderlens.operators import features
from orderlens.operators.order_level import build_order_level, with_delivery_metrics
from orderlens.schemas import FEATURES_TABLE, ORDERS_TABLE, RAW_FILES, RAW_SCHEMAS
from orderlens.session import scratch_path, staged
from orderlens.sources import readers, writers
from orderlens.sources.driver_tables import order_tables, star_table, view
from orderlens.streaming import ingest


def write_raw_csv(spark, sf_dir):
    """The nine derived tables as raw CSV files, in a fresh folder."""
    root = scratch_path(spark, "raw-csv")
    for name, df in order_tables(spark, sf_dir).items():
        cells = [
            F.col(f.name).cast("string").alias(f.name) if f.name in df.columns
            else F.lit(None).cast("string").alias(f.name)
            for f in RAW_SCHEMAS[name]
        ]
        file_name = RAW_FILES[name].replace("*", "raw")
        df.select(*cells).write.option("header", "true").option("escape", '"').csv(
            f"{root}/{file_name}"
        )
    return root


_RAW_COUNTS = {
    "orders": ("order_id", "v_orders"), "customers": ("customer_id", "v_customers"),
    "items": ("price", "v_items"), "payments": ("payment_value", "v_payments"),
    "reviews": ("review_score", "v_reviews"), "products": ("product_weight_g", "v_products"),
    "sellers": ("seller_zip_code_prefix", "v_sellers"),
    "geolocation": ("geolocation_lat", "v_geolocation"),
    "category_translation": ("product_category_name", "v_category_translation"),
}


@query("s1_csv_scan", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows, "
    + (f"round(sum(CAST({c} AS DOUBLE)), 2)" if t != "category_translation"
       else f"CAST(sum(length({c})) AS DOUBLE)")
    + f" AS check_sum FROM {v}"
    for t, (c, v) in _RAW_COUNTS.items()
))
def csv_scan(spark, sf_dir):
    tables = readers.read_raw_tables(spark, write_raw_csv(spark, sf_dir))
    parts = []
    for name, (column, _) in _RAW_COUNTS.items():
        value = F.length(column) if name == "category_translation" else F.col(column)
        parts.append(tables[name].agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"),
            F.round(F.sum(value.cast("double")), 2).alias("check_sum"),
        ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("s3_pruned_filtered_scan", """
    SELECT order_id, order_status FROM v_orders WHERE order_status = 'delivered'
""")
def pruned_scan(spark, sf_dir):
    path = scratch_path(spark, "orders")
    view(spark, sf_dir, "v_orders").write.parquet(path)
    return readers.read_columns(
        readers.read_table(spark, path), "order_id", "order_status", status="delivered"
    )


@query("s4_lookup_by_ids", """
    SELECT order_id, round(total_price, 2) AS total_price FROM item_rollup
    WHERE order_id IN (SELECT order_id FROM v_reviews WHERE review_score = 1)
""")
def lookup_by_ids(spark, sf_dir):
    wanted = view(spark, sf_dir, "v_reviews").where(F.col("review_score") == 1)
    totals = view(spark, sf_dir, "v_items").groupBy("order_id").agg(
        F.coalesce(F.sum("price"), F.lit(0.0)).alias("total_price")
    )
    return readers.lookup(totals, wanted, "total_price").select("order_id", r("total_price", 2))


@query("s5_full_replace", """
    SELECT CAST(count(*) AS BIGINT) AS first_count, CAST(count(*) AS BIGINT) AS second_count,
           CAST(count(DISTINCT order_id) AS BIGINT) AS orders FROM v_orders
""")
def full_replace(spark, sf_dir):
    path = scratch_path(spark, "replace")
    orders = view(spark, sf_dir, "v_orders")
    first = writers.replace_table(orders, path)
    second = writers.replace_table(orders, path)
    return spark.read.parquet(path).agg(
        F.lit(first).cast("bigint").alias("first_count"),
        F.lit(second).cast("bigint").alias("second_count"),
        F.count_distinct("order_id").alias("orders"),
    )


@query("s6_upsert", """
    SELECT order_id, CASE WHEN order_status = 'canceled' THEN 'canceled*' ELSE order_status END
               AS order_status FROM v_orders
""")
def upsert(spark, sf_dir):
    path = scratch_path(spark, "upsert")
    orders = view(spark, sf_dir, "v_orders").select(
        "order_id", "order_status", "order_purchase_timestamp"
    )
    part = writers.period_part(pattern="yyyy")
    writers.upsert_table(
        orders.where(F.col("order_status") != "shipped"), path, part=part
    )
    # second batch: new keys, and keys that replace stored rows
    second = orders.where(F.col("order_status").isin("shipped", "canceled")).withColumn(
        "order_status",
        F.when(F.col("order_status") == "canceled", "canceled*").otherwise(F.col("order_status")),
    )
    writers.upsert_table(second, path, part=part)
    return writers.read_upserted(spark, path).select("order_id", "order_status")


@query("j11_stored_without_incoming", """
    SELECT order_id, order_status FROM v_orders
    WHERE order_id NOT IN (SELECT order_id FROM v_reviews)
""")
def stored_without_incoming(spark, sf_dir):
    stored = view(spark, sf_dir, "v_orders").select("order_id", "order_status")
    incoming = view(spark, sf_dir, "v_reviews").select("order_id").distinct()
    return stored.join(incoming, "order_id", "left_anti")


@query("u1_union_all", """
    SELECT kind, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS value FROM (
        SELECT 'item' AS kind, price AS value FROM v_items
        UNION ALL SELECT 'payment', payment_value FROM v_payments) u GROUP BY kind
""")
def union_all(spark, sf_dir):
    items = view(spark, sf_dir, "v_items").select(
        F.lit("item").alias("kind"), F.col("price").alias("value"))
    payments = view(spark, sf_dir, "v_payments").select(
        F.col("payment_value").alias("value"), F.lit("payment").alias("kind"))
    return items.unionByName(payments).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value")
    )


@query("s7_s8_csv_copy", """
    SELECT CAST(order_id AS VARCHAR) AS order_id,
           strftime(order_purchase_timestamp, '%Y-%m-%dT%H:%M:%S') AS order_purchase_timestamp,
           CASE WHEN order_delivered_customer_date IS NULL THEN NULL
                WHEN order_delivered_customer_date > order_estimated_delivery_date THEN 'true'
                ELSE 'false' END AS is_late
    FROM v_orders
""")
def csv_copy(spark, sf_dir):
    path = scratch_path(spark, "copy")
    writers.write_csv_copy(with_delivery_metrics(view(spark, sf_dir, "v_orders")), path)
    return spark.read.option("header", "true").csv(path).select(
        "order_id", "order_purchase_timestamp", "is_late"
    )


@query("s9_digest_json", """
    SELECT order_status, CAST(count(*) AS BIGINT) AS orders, CAST(2 AS BIGINT) AS copies
    FROM v_orders GROUP BY order_status
""")
def digest_json(spark, sf_dir):
    root = scratch_path(spark, "digest")
    counts = view(spark, sf_dir, "v_orders").groupBy("order_status").agg(
        F.count(F.lit(1)).alias("orders"))
    writers.write_digest(counts, root, "2024-01-01T00:00:00")
    schema = "order_status string, orders bigint"
    stamped = spark.read.schema(schema).json(f"{root}/generated_at=20240101T000000")
    latest = spark.read.schema(schema).json(f"{root}/latest")
    return stamped.unionByName(latest).groupBy("order_status", "orders").agg(
        F.count(F.lit(1)).alias("copies")
    )


@query("s11_uploaded_orders", """
    SELECT CAST(order_id AS VARCHAR) AS order_id, round(total_price, 2) AS total_price,
           CAST(n_items AS DOUBLE) AS n_items, main_category FROM order_level
""")
def uploaded_orders(spark, sf_dir):
    path = scratch_path(spark, "upload")
    order_level(spark, sf_dir).select(
        "order_id", F.concat(F.lit(" "), F.col("total_price").cast("string")).alias(" total_price"),
        "n_items", "main_category",
    ).write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").csv(path)
    uploads = readers.read_uploaded_orders(spark, path)
    return uploads.select(
        "order_id", F.round(readers.upload_number(uploads, "total_price"), 2).alias("total_price"),
        readers.upload_number(uploads, "n_items").alias("n_items"), "main_category",
    )


@query("s12_corpus_json", """
    SELECT source, CAST(count(*) AS BIGINT) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars
    FROM documents GROUP BY source
""")
def corpus_json(spark, sf_dir):
    path = scratch_path(spark, "corpus")
    star_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "text", "source"
    ).write.json(path)
    return readers.read_corpus(spark, path, one_per_line=True).groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).cast("bigint").alias("chars")
    )


@query("i1_i2_chronological_slices", """
    SELECT order_id, CAST(ceil(r / ceil(n / 4.0E0)) AS BIGINT) AS slice FROM (
        SELECT order_id, count(*) OVER () AS n, row_number() OVER (
            ORDER BY order_purchase_timestamp ASC NULLS LAST, order_id) AS r FROM v_orders) s
""")
def chronological_slices(spark, sf_dir):
    orders = view(spark, sf_dir, "v_orders")
    size = -(-orders.count() // 4)
    state, slices = ingest.IngestState(), None
    while True:
        batch, advanced = ingest.next_slice(orders, state, size)
        if advanced.cursor == state.cursor:
            return slices
        part = batch.select("order_id", F.lit(advanced.runs).cast("bigint").alias("slice"))
        slices = part if slices is None else slices.unionByName(part)
        state = advanced


@query("i3_remaining", """
    SELECT CAST(greatest(count(*) - 2000, 0) AS BIGINT) AS remaining FROM v_orders
""")
def remaining(spark, sf_dir):
    orders = view(spark, sf_dir, "v_orders")
    _, state = ingest.next_slice(orders, ingest.IngestState())
    return ingest.remaining(orders, state)


@query("i4_stream_replay", """
    SELECT o.order_id, o.order_status, CAST(o.n_items AS BIGINT) AS n_items,
           round(o.total_price, 2) AS total_price, o.main_category, o.primary_payment_type,
           CAST(o.review_score AS BIGINT) AS review_score, o.is_late, f.is_complaint
    FROM order_level o JOIN features f ON f.order_id = o.order_id
""")
def stream_replay(spark, sf_dir):
    source, root = scratch_path(spark, "arrivals"), scratch_path(spark, "gold")
    tables = order_tables(spark, sf_dir)
    # files in purchase-time order, so that micro-batches arrive chronologically
    tables["orders"].repartitionByRange(3, "order_purchase_timestamp").write.parquet(source)
    # nothing is known of the orders but what arrives
    known = {**tables, "orders": tables["orders"].where("false")}
    ingest.stream_ingest(
        spark, source, "orders", known, root, scratch_path(spark, "stream"), period="yyyy"
    ).awaitTermination()
    level = writers.read_upserted(spark, f"{root}/{ORDERS_TABLE}")
    labels = writers.read_upserted(spark, f"{root}/{FEATURES_TABLE}")
    return level.join(labels.select("order_id", "is_complaint"), "order_id").select(
        "order_id", "order_status", "n_items", r("total_price", 2), "main_category",
        "primary_payment_type", big("review_score"), "is_late", "is_complaint",
    )


@query("i4_late_reviews_update", """
    SELECT order_id, CAST(review_score AS BIGINT) AS review_score FROM order_level
""")
def late_reviews(spark, sf_dir):
    root = scratch_path(spark, "gold")
    tables = order_tables(spark, sf_dir)
    early = {**tables, "reviews": tables["reviews"].where(F.col("review_answer_timestamp").isNull())}
    part = writers.period_part(pattern="yyyy")
    level = staged(build_order_level(early), "level")  # both gold tables are written from it
    writers.upsert_table(level, f"{root}/{ORDERS_TABLE}", part=part)
    features_now = features.feature_table(level, "order_purchase_timestamp")
    writers.upsert_table(features_now, f"{root}/{FEATURES_TABLE}", part=part)
    # the answered reviews arrive later and change their orders
    answered = tables["reviews"].where(F.col("review_answer_timestamp").isNotNull())
    ingest.ingest_orders(tables, ingest.changed_orders(answered), root, period="yyyy")
    return writers.read_upserted(spark, f"{root}/{ORDERS_TABLE}").select(
        "order_id", big("review_score")
    )
