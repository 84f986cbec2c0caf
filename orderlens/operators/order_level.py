"""One row per order out of the nine raw tables.

Shuffle budget: customers meet orders on ``customer_id``; every child table is
reduced to one row per ``order_id`` before it is joined, so the final joins are
co-partitioned on ``order_id``.  Item lines are shuffled once by order; an order
with more lines than one row may gather is folded by value over the cluster
instead, so no list or window holds a hot order's lines.  No dimension is
broadcast by hint: the optimizer broadcasts those whose size statistics allow it
and splits skewed partitions of the sort-merge joins otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions import scalar as S
from orderlens.schemas import ORDER_TIMESTAMPS
from orderlens.session import staged


def geo_centroids(geolocation: DataFrame) -> DataFrame:
    """Mean latitude and longitude per zip prefix."""
    return (
        geolocation.where(F.col("geolocation_zip_code_prefix").isNotNull())
        .groupBy(F.col("geolocation_zip_code_prefix").alias("zip_prefix"))
        .agg(F.avg("geolocation_lat").alias("lat"), F.avg("geolocation_lng").alias("lng"))
    )


def translated_products(products: DataFrame, category_translation: DataFrame) -> DataFrame:
    """Products with the English category and the volume."""
    return products.join(category_translation, "product_category_name", "left").select(
        "product_id",
        "product_category_name_english",
        "product_weight_g",
        (F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm"))
        .alias("product_volume_cm3"),
    )


def item_lines(
    items: DataFrame, products: DataFrame, category_translation: DataFrame, sellers: DataFrame
) -> DataFrame:
    """Item lines with their product's and seller's attributes."""
    columns = ("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value")
    return (
        items.where(F.col("order_id").isNotNull()).select(*columns)
        .join(translated_products(products, category_translation), "product_id", "left")
        .join(
            sellers.select("seller_id", "seller_state", "seller_zip_code_prefix"),
            "seller_id", "left",
        )
    )


#: Lines of an order that one row may gather; larger orders are folded by value over the cluster.
GATHERED_LINES = 1_000


def order_items(
    items: DataFrame, products: DataFrame, category_translation: DataFrame, sellers: DataFrame,
    centroids: DataFrame | None = None, gathered_lines: int = GATHERED_LINES,
) -> DataFrame:
    """Counts, money, physical attributes and modal values per order.

    With ``centroids``, ``seller_points`` lists the places an order ships from with their
    numbers of lines.  The dimensions are staged, so that their real sizes decide how they
    are joined.
    """
    lines = items.where(F.col("order_id").isNotNull())
    shippers = sellers.select("seller_id", "seller_state", F.col("seller_zip_code_prefix").alias("zip_prefix"))
    if centroids is not None:
        shippers = shippers.join(centroids, "zip_prefix", "left")
    shippers = staged(shippers, "shippers")
    goods = staged(translated_products(products, category_translation), "products")
    large = staged(
        lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > gathered_lines).select("order_id"), "large-orders",
    )
    if large.isEmpty():
        return gathered_rollup(lines, goods, shippers)
    return gathered_rollup(lines.join(large, "order_id", "left_anti"), goods, shippers).unionByName(
        item_rollup(item_groups(lines.join(large, "order_id", "left_semi"), goods, shippers))
    )


def gathered_rollup(lines: DataFrame, goods: DataFrame, shippers: DataFrame) -> DataFrame:
    """The roll-up of orders with few lines: one shuffle, the values of an order in short lists."""
    with_places = "lat" in shippers.columns
    known = (
        lines.select("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value")
        .join(goods, "product_id", "left").join(shippers, "seller_id", "left")
        # rows, not partial lists, are shuffled: the lines of an order are scattered here
        .repartition("order_id")
    )

    def modal(values: Column) -> Column:
        """The most frequent value; ties go to the smallest."""
        counted = F.transform(F.array_distinct(values), lambda v: F.struct(
            (-F.size(F.filter(values, lambda x: x == v))).alias("rarity"), v.alias("value")))
        return F.array_min(counted)["value"]

    place = F.struct("lat", "lng", F.lit(1).cast("bigint").alias("lines"))
    points = [F.collect_list(F.when(
        F.col("lat").isNotNull() & F.col("lng").isNotNull(), place
    )).alias("seller_points")] if with_places else []
    return known.groupBy("order_id").agg(
        F.count("order_item_id").alias("n_items"),
        F.size(F.collect_set(F.col("seller_id").cast("string"))).cast("bigint").alias("n_sellers"),
        F.size(F.collect_set(F.col("product_id").cast("string"))).cast("bigint").alias("n_products"),
        F.coalesce(F.sum("price").cast("double"), F.lit(0.0)).alias("total_price"),
        F.coalesce(F.sum("freight_value").cast("double"), F.lit(0.0)).alias("total_freight"),
        F.avg(F.col("product_weight_g").cast("double")).alias("avg_product_weight_g"),
        F.max(F.col("product_weight_g").cast("double")).alias("max_product_weight_g"),
        F.avg(F.col("product_volume_cm3").cast("double")).alias("avg_product_volume_cm3"),
        modal(F.collect_list(F.col("product_category_name_english").cast("string"))).alias("main_category"),
        modal(F.collect_list(F.col("seller_state").cast("string"))).alias("main_seller_state"),
        *points,
    )


def item_groups(lines: DataFrame, goods: DataFrame, shippers: DataFrame) -> DataFrame:
    """Item lines folded to one row per (order, product, seller), with what ``item_rollup`` reads.

    The lines are folded first, so the dimensions meet counted rows instead of raw lines.
    """
    folded = lines.groupBy("order_id", "product_id", "seller_id").agg(
        F.count(F.lit(1)).alias("copies"), F.count("order_item_id").alias("lines"),
        F.sum("price").alias("price"), F.sum("freight_value").alias("freight"),
    )
    return folded.join(goods, "product_id", "left").join(shippers, "seller_id", "left")


# What a group of lines counts for: its product carries the figures, its place the
# coordinates, the other kinds are only counted.
_PRODUCT, _SELLER, _CATEGORY, _STATE, _PLACE = range(5)


def item_rollup(groups: DataFrame) -> DataFrame:
    """The roll-up of orders of any size.

    The rows of ``item_groups`` are folded to one row per (order, kind, value), which
    spreads a hot order over the cluster and needs fixed-width buffers only; distinct and
    modal values per order are then plain counts and a minimum over those rows.  With
    places, ``seller_points`` lists them with their numbers of lines; it is bounded by
    the number of zip prefixes.
    """
    with_places = "lat" in groups.columns
    copies = F.col("copies")
    figures = {
        "lines": F.col("lines"), "price": F.col("price"), "freight": F.col("freight"),
        "weight": F.col("product_weight_g") * copies, "volume": F.col("product_volume_cm3") * copies,
        "weights": F.when(F.col("product_weight_g").isNotNull(), copies),
        "volumes": F.when(F.col("product_volume_cm3").isNotNull(), copies),
        "max_weight": F.col("product_weight_g"),
    }
    place = {"lat": F.col("lat"), "lng": F.col("lng")} if with_places else {}

    def cell(kind: int, value: Column) -> Column:
        own = {_PRODUCT: figures, _PLACE: place}.get(kind, {})
        carried = [
            (own[name] if name in own else F.lit(None)).cast("double").alias(name)
            for name in [*figures, *place]
        ]
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), "copies", *carried)

    kinds = [
        cell(_PRODUCT, F.col("product_id")), cell(_SELLER, F.col("seller_id")),
        cell(_CATEGORY, F.col("product_category_name_english")), cell(_STATE, F.col("seller_state")),
    ]
    if with_places:
        kinds.append(cell(_PLACE, F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.col("zip_prefix"))))
    cells = groups.select("order_id", F.inline(F.array(*kinds))).where(
        (F.col("kind") == _PRODUCT) | F.col("value").isNotNull()
    )
    folded = cells.groupBy("order_id", "kind", "value").agg(
        F.sum("copies").alias("copies"), F.max("max_weight").alias("max_weight"),
        *[F.sum(c).alias(c) for c in figures if c != "max_weight"],
        *[F.max(c).alias(c) for c in place],
    )

    def distinct(kind: int) -> Column:
        return F.count_if((F.col("kind") == kind) & F.col("value").isNotNull())

    def modal(kind: int) -> Column:
        """The most frequent value; ties go to the smallest."""
        own = F.col("kind") == kind
        rarity = F.struct(-F.col("copies"), F.col("value"))
        return F.min_by(F.when(own, F.col("value")), F.when(own, rarity))

    points = [F.collect_list(F.when(
        F.col("kind") == _PLACE, F.struct("lat", "lng", F.col("copies").alias("lines"))
    )).alias("seller_points")] if with_places else []
    return folded.groupBy("order_id").agg(
        F.sum("lines").cast("bigint").alias("n_items"),
        distinct(_SELLER).alias("n_sellers"),
        distinct(_PRODUCT).alias("n_products"),
        F.coalesce(F.sum("price"), F.lit(0.0)).alias("total_price"),
        F.coalesce(F.sum("freight"), F.lit(0.0)).alias("total_freight"),
        (F.sum("weight") / F.nullif(F.sum("weights"), F.lit(0.0))).alias("avg_product_weight_g"),
        F.max("max_weight").alias("max_product_weight_g"),
        (F.sum("volume") / F.nullif(F.sum("volumes"), F.lit(0.0))).alias("avg_product_volume_cm3"),
        modal(_CATEGORY).alias("main_category"),
        modal(_STATE).alias("main_seller_state"),
        *points,
    )


def mean_distance_km(cust_lat, cust_lng, points):
    """Line-weighted mean distance to the seller points; unknown ones are skipped."""
    legs = F.filter(
        F.transform(
            points,
            lambda p: F.struct(
                S.haversine_km(cust_lat, cust_lng, p["lat"], p["lng"]).alias("km"),
                p["lines"].cast("double").alias("lines"),
            ),
        ),
        lambda leg: leg["km"].isNotNull(),
    )
    weighted = F.aggregate(legs, F.lit(0.0), lambda acc, leg: acc + leg["km"] * leg["lines"])
    weight = F.aggregate(legs, F.lit(0.0), lambda acc, leg: acc + leg["lines"])
    return weighted / F.nullif(weight, F.lit(0.0))


def payment_rollup(payments: DataFrame) -> DataFrame:
    """Payment totals and the type of the largest payment per order."""
    largest_first = F.struct(
        F.col("payment_value"),
        -F.col("payment_sequential"),
        F.col("payment_type"),
    )
    return (
        payments.where(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(
            F.coalesce(F.sum("payment_value"), F.lit(0.0)).alias("total_payment_value"),
            F.count("payment_sequential").alias("n_payments"),
            F.max("payment_installments").alias("max_installments"),
            F.max_by("payment_type", largest_first).alias("primary_payment_type"),
        )
    )


def latest_review(reviews: DataFrame) -> DataFrame:
    """The latest-answered review per order; an unanswered one counts as latest."""
    answered = S.parse_timestamp(F.col("review_answer_timestamp"))
    created = S.parse_timestamp(F.col("review_creation_date"))
    recency = F.struct(
        answered.isNull().cast("int"), answered, F.col("review_id"), F.col("review_score"),
        created,
    )
    chosen = F.struct(F.col("review_score"), created.alias("review_creation_date"))
    return (
        reviews.where(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(F.max_by(chosen, recency).alias("review"))
        .select("order_id", "review.review_score", "review.review_creation_date")
    )


def parse_order_timestamps(orders: DataFrame) -> DataFrame:
    """The five order timestamps, parsed; what does not parse becomes null."""
    return orders.withColumns({c: S.parse_timestamp(F.col(c)) for c in ORDER_TIMESTAMPS})


def with_delivery_metrics(orders: DataFrame) -> DataFrame:
    """Durations in days and hours, and the three-valued late flag."""
    bought = F.col("order_purchase_timestamp")
    delivered = F.col("order_delivered_customer_date")
    promised = F.col("order_estimated_delivery_date")
    lateness = S.days_between(promised, delivered)
    return orders.withColumns({
        "actual_delivery_days": S.days_between(bought, delivered),
        "estimated_delivery_days": S.days_between(bought, promised),
        "delivery_vs_estimate_days": lateness,
        "approval_delay_hours": S.hours_between(bought, F.col("order_approved_at")),
        "is_late": S.late_flag(delivered, lateness),
    })


def build_order_level(tables: dict[str, DataFrame]) -> DataFrame:
    """Join the nine tables into one row per order."""
    # Reduced once to one row per zip prefix and staged: the joins below then see
    # its real (small) size instead of that of all raw points.
    centroids = staged(geo_centroids(tables["geolocation"]), "centroids")
    items = order_items(
        tables["items"], tables["products"], tables["category_translation"], tables["sellers"], centroids
    )
    base = (
        parse_order_timestamps(tables["orders"])
        .join(tables["customers"], "customer_id", "left")
        .join(
            centroids.select(
                F.col("zip_prefix").alias("customer_zip_code_prefix"),
                F.col("lat").alias("cust_lat"), F.col("lng").alias("cust_lng"),
            ),
            "customer_zip_code_prefix", "left",
        )
    )
    joined = (
        base.join(items, "order_id", "left")
        .join(payment_rollup(tables["payments"]), "order_id", "left")
        .join(latest_review(tables["reviews"]), "order_id", "left")
    )
    distance = mean_distance_km(F.col("cust_lat"), F.col("cust_lng"), F.col("seller_points"))
    return with_delivery_metrics(
        joined.withColumn("customer_seller_distance_km", distance).drop("seller_points")
    )


class FanOutError(ValueError):
    """The order-level table lost or repeated orders."""


def fan_out_report(order_level: DataFrame, orders: DataFrame) -> DataFrame:
    """One row: orders in, rows out, distinct keys, keys that occur twice or more."""
    out = (
        order_level.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows_out"),
            F.count(F.lit(1)).alias("distinct_orders"),
            F.count_if(F.col("n") > 1).alias("repeated_orders"),
        )
    )
    orders_in = orders.agg(F.count(F.lit(1)).alias("orders_in"))
    return out.select(orders_in.scalar().alias("orders_in"), "*")


def assert_no_fan_out(order_level: DataFrame, orders: DataFrame) -> None:
    """Fail the job when the build did not keep exactly one row per order."""
    row = fan_out_report(order_level, orders).first()
    if row["repeated_orders"] or row["rows_out"] != row["orders_in"]:
        raise FanOutError(f"order-level fan-out: {row.asDict()}")
