import math

import pytest
from pyspark.sql import functions as F

from nine_tables import ROWS, tables
from orderlens.functions import scalar as S
from orderlens.operators import features, order_level as build
from orderlens.schemas import model_inputs


@pytest.fixture(scope="module")
def level(spark):
    return build.build_order_level(tables(spark)).persist()


@pytest.fixture(scope="module")
def rows(level):
    return {r["order_id"]: r for r in level.collect()}


def test_one_row_per_order(spark, level, rows):
    assert len(rows) == len(ROWS["orders"]) == level.count()
    build.assert_no_fan_out(level, tables(spark)["orders"])
    with pytest.raises(build.FanOutError):
        build.assert_no_fan_out(level.union(level), tables(spark)["orders"])


def test_item_rollup(rows):
    assert (rows["o2"]["n_items"], rows["o2"]["n_sellers"], rows["o2"]["n_products"]) == (2, 1, 2)
    assert rows["o2"]["total_price"] == 80.0
    assert rows["o2"]["avg_product_weight_g"] == 1000.0
    assert rows["o2"]["max_product_weight_g"] == 1500.0
    assert rows["o2"]["avg_product_volume_cm3"] == 1500.0
    # no items: unknown, not zero
    assert rows["o4"]["n_items"] is None and rows["o4"]["total_price"] is None


def test_sum_of_nothing_known_is_zero(rows):
    assert rows["o5"]["total_payment_value"] == 0.0
    assert rows["o5"]["avg_product_weight_g"] is None


def test_ties_go_to_the_smallest(rows):
    assert rows["o6"]["main_category"] == "furniture"
    assert rows["o6"]["main_seller_state"] == "RJ"
    assert rows["o2"]["primary_payment_type"] == "voucher"  # earliest of equal payments


def test_unanswered_review_wins(rows):
    assert rows["o2"]["review_score"] == 1


def test_distance(rows):
    assert 330 < rows["o1"]["customer_seller_distance_km"] < 390
    assert rows["o3"]["customer_seller_distance_km"] == pytest.approx(0, abs=1e-6)
    # unknown places give an unknown distance, never 0 km
    for order in ("o4", "o5", "o6", "o7"):
        assert rows[order]["customer_seller_distance_km"] is None


def test_distance_weighs_lines_and_matches_formula(spark):
    t = tables(spark)
    extra = spark.createDataFrame(
        [("o2", 3, "p1", "s2", None, 1.0, 1.0)], t["items"].schema)
    t["items"] = t["items"].unionByName(extra)
    got = build.build_order_level(t).where("order_id = 'o2'").first()

    def km(a, b):
        (la, na), (lb, nb) = [(math.radians(x), math.radians(y)) for x, y in (a, b)]
        h = (math.sin((lb - la) / 2) ** 2
             + math.cos(la) * math.cos(lb) * math.sin((nb - na) / 2) ** 2)
        return 2 * 6371.0 * math.asin(math.sqrt(h))

    sp, rio = (-23.55, -46.63), (-22.90, -43.17)
    assert got["customer_seller_distance_km"] == pytest.approx((2 * km(rio, sp) + 0) / 3)


def test_late_flag_is_three_valued(rows):
    assert rows["o1"]["is_late"] is False
    assert rows["o2"]["is_late"] is True
    assert rows["o3"]["is_late"] is None
    assert rows["o4"]["is_late"] is False  # delivered, no estimate
    assert rows["o1"]["actual_delivery_days"] == 6.0
    assert rows["o1"]["approval_delay_hours"] == 2.0
    assert rows["o4"]["approval_delay_hours"] is None  # approval time did not parse


def test_features(level):
    got = {r["order_id"]: r for r in features.engineer_features(level).collect()}
    assert got["o1"]["purchase_dow"] == 1 and got["o1"]["purchase_hour"] == 10  # a Tuesday
    assert got["o2"]["purchase_is_weekend"] == 1
    assert got["o5"]["purchase_is_weekend"] == 0 and got["o5"]["purchase_month"] is None
    assert got["o5"]["cross_state_shipment"] == 1  # unknown differs
    assert got["o3"]["cross_state_shipment"] == 0
    assert got["o6"]["freight_ratio"] is None  # zero total
    assert all(0 <= r["freight_ratio"] <= 1 for r in got.values() if r["freight_ratio"] is not None)


def test_labels(level):
    got = {r["order_id"]: r for r in features.add_labels(level).collect()}
    assert [got[o]["low_review"] for o in ("o1", "o2", "o3", "o4")] == [False, True, False, None]
    assert [got[o]["is_complaint"] for o in ("o1", "o2", "o3", "o5", "o7")] == [
        False, True, True, False, True]


def test_feature_lists():
    assert [len(x) for x in model_inputs("delay")] == [19, 4]
    assert [len(x) for x in model_inputs("low_review")] == [22, 4]
    with pytest.raises(ValueError):
        model_inputs("other")


def test_join_free_frame_equals_the_joined_one(level):
    table = features.feature_table(level)
    joined = features.with_outcome(table, level)
    direct = features.scoring_frame(level).select(*joined.columns)
    assert joined.exceptAll(direct).count() == direct.exceptAll(joined).count() == 0


def test_hot_order_is_folded(spark):
    """A third of all lines in one order: same figures, computed by partial aggregates."""
    t = tables(spark)
    hot = spark.range(20000).select(
        F.lit("o1").alias("order_id"), F.col("id").cast("int").alias("order_item_id"),
        F.when(F.col("id") % 2 == 0, "p1").otherwise("p2").alias("product_id"),
        F.when(F.col("id") % 4 == 0, "s1").otherwise("s2").alias("seller_id"),
        F.lit(None).cast("string").alias("shipping_limit_date"),
        F.lit(1.0).alias("price"), F.lit(0.5).alias("freight_value"),
    )
    t["items"] = t["items"].unionByName(hot)
    row = build.build_order_level(t).where("order_id = 'o1'").first()
    assert (row["n_items"], row["n_sellers"], row["n_products"]) == (20001, 2, 2)
    assert row["total_price"] == 20100.0 and row["main_category"] == "toys"
    assert row["main_seller_state"] == "RJ"


def test_derive_missing(spark):
    sent = spark.createDataFrame(
        [("a", "2018-02-03T22:00:00", "10", "5", "SP", "RJ", None),
         ("b", "rubbish", "0", "0", "", "RJ", "7"), ("c", None, None, "5", "SP", None, None)],
        "order_id string, order_purchase_timestamp string, total_price string, "
        "total_freight string, customer_state string, main_seller_state string, "
        "purchase_month string",
    )
    got = {r["order_id"]: r for r in features.derive_missing(sent).collect()}
    assert (got["a"]["purchase_month"], got["a"]["purchase_is_weekend"]) == (2.0, 1.0)
    assert got["a"]["freight_ratio"] == pytest.approx(1 / 3)
    assert got["a"]["cross_state_shipment"] == 1.0
    assert got["b"]["purchase_month"] == 7.0  # given values stay
    assert got["b"]["purchase_dow"] is None and got["b"]["freight_ratio"] is None
    assert got["b"]["cross_state_shipment"] is None and got["c"]["cross_state_shipment"] is None


def test_scalar_edges(spark):
    df = spark.createDataFrame(
        [("True",), ("0",), ("1.0",), ("false",), ("maybe",), (None,)], "v string")
    assert [r[0] for r in df.select(S.tri_state(F.col("v"))).collect()] == [
        True, False, True, False, None, None]
    nums = spark.createDataFrame([("1.5",), ("NaN",), ("x",), ("",)], "v string")
    assert [r[0] for r in nums.select(S.safe_double(F.col("v"))).collect()] == [
        1.5, None, None, None]


def _items(spark, extra=(), **options):
    t = tables(spark)
    items = t["items"].unionByName(spark.createDataFrame(list(extra), t["items"].schema))
    products = t["products"].unionByName(t["products"].where("product_id = 'p2'"))  # a key that comes twice
    centroids = build.geo_centroids(t["geolocation"])
    return build.order_items(items, products, t["category_translation"], t["sellers"], centroids, **options)


def test_orders_of_any_size_fold_alike(spark):
    extra = [("o8", i, f"p{1 + i % 3}", f"s{1 + i % 2}", None, 0.5 * i, 0.25) for i in range(40)]
    extra += [("o8", None, None, None, None, None, None)]

    def figures(**options):
        out = {}
        for r in _items(spark, extra, **options).collect():
            row = r.asDict(recursive=True)
            points = {}
            for p in row.pop("seller_points"):
                points[p["lat"], p["lng"]] = points.get((p["lat"], p["lng"]), 0) + p["lines"]
            out[r["order_id"]] = (row, points)
        return out

    gathered, spread, mixed = figures(), figures(gathered_lines=0), figures(gathered_lines=5)
    assert gathered.keys() == spread.keys() == mixed.keys() and "o8" in gathered
    for order, (row, points) in gathered.items():
        assert row == pytest.approx(spread[order][0]) and row == pytest.approx(mixed[order][0])
        assert points == spread[order][1] == mixed[order][1]


def test_lines_are_shuffled_once_by_order_and_not_multiplied(spark, capsys):
    _items(spark).explain()
    plan = capsys.readouterr().out
    assert "Generate" not in plan  # one row per line and kind would follow
    assert plan.count("Exchange hashpartitioning(order_id") == 1
