import pytest
from pyspark.sql import functions as F

from orderlens.operators import features, risk

SCHEMA = ("order_id string, customer_state string, main_category string, total_price double, "
          "delay_probability double, low_review_probability double")


def scored(spark, rows):
    return risk.with_risk(spark.createDataFrame(rows, SCHEMA), 0.2, 0.3)


@pytest.fixture(scope="module")
def book(spark):
    return scored(spark, [
        ("a", "SP", "toys", 100.0, 0.9, 0.1),
        ("b", "RJ", "bed_bath", None, 0.3, 0.1),
        ("c", None, "toys", 0.0, 0.1, 0.7),
        ("d", "SP", None, 50.0, 0.1, 0.4),
        ("e", "AM", "toys", 30.0, 0.05, 0.05),
    ])


def by_id(df):
    return {r["order_id"]: r for r in df.collect()}


def test_levels_and_actions(book):
    got = by_id(book.withColumns({
        "priority": risk.priority(), "play": risk.playbook(),
        "action": risk.recommended_action(), "routes": risk.routes(),
    }))
    assert [got[o]["delay_risk"] for o in "abcde"] == ["high", "medium", "low", "low", "low"]
    assert [got[o]["low_review_risk"] for o in "abcde"] == ["low", "low", "high", "medium", "low"]
    assert [got[o]["priority"] for o in "abcde"] == ["high", "medium", "high", "medium", None]
    assert got["a"]["play"] == risk.PLAY_EXPEDITE and got["d"]["play"] == risk.PLAY_CHECK_IN
    assert got["d"]["action"] == risk.ACTION_CHECK_IN and got["e"]["action"] == risk.ACTION_NONE
    assert got["a"]["routes"] == ["email", "sheets", "slack"]
    assert got["c"]["routes"] == ["support", "email", "sheets", "slack"]
    assert got["e"]["routes"] == ["email", "sheets"]


def test_high_needs_at_least_half(spark):
    row = risk.with_risk(
        spark.createDataFrame([("a", None, None, None, 0.45, 0.62)], SCHEMA), 0.1, 0.3).first()
    assert (row["delay_risk"], row["low_review_risk"]) == ("medium", "high")


def test_messages(book):
    got = by_id(book.withColumns({"m": risk.outreach_text(), "t": risk.outreach_template()}))
    assert "order of bed bath to make sure it reaches you in RJ as" in got["b"]["m"]
    assert got["d"]["m"].startswith("Hi! Thank you for your order. We want")
    assert got["e"]["m"].startswith("Hi! Thanks for your order of toys — it's on track")
    assert "{" not in "".join(r["m"] + r["t"] for r in got.values())


def test_bins_are_right_closed(spark):
    rows = [(str(i), None, None, None, p, p) for i, p in enumerate([0.0, 0.1, 0.2, 0.21, 0.5, 1.0])]
    got = {r["bucket"]: r["delay"] for r in risk.risk_distribution(scored(spark, rows)).collect()}
    assert got == {"0–10%": 2, "10–20%": 1, "20–30%": 1, "30–50%": 1, "50%+": 1}


def test_summaries(book, spark):
    got = risk.batch_summary(book).first()
    assert (got["orders"], got["delay_at_risk"], got["low_review_at_risk"], got["high_risk"]) == (
        5, 2, 2, 2)
    assert got["delay_at_risk_pct"] == pytest.approx(40)
    empty = risk.batch_summary(book.limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0, 0.0, 0.0)


def test_roi_uses_positive_prices(book):
    got = risk.roi(book).first()
    assert got["order_value"] == 60.0  # mean of 100, 50 and 30
    assert (got["delay_at_risk"], got["review_at_risk"]) == (2, 2)
    assert (got["reviews_prevented"], got["delays_caught"]) == (1, 1)
    assert got["total_value"] == pytest.approx(1 * 60 * 1.5 + 18)
    scaled = risk.roi(book, scale=F.lit(10.0)).first()
    assert scaled["delay_at_risk"] == 20


def test_queue_coverage_and_funnel(book, spark):
    queue = risk.action_queue(book)
    assert [r["order_id"] for r in queue.collect()] == ["a", "c", "d", "b"]
    log = spark.createDataFrame([("a",), ("a",), ("zzz",)], "order_id string")
    assert [r["order_id"] for r in risk.open_queue(queue, log).orderBy("order_id").collect()] == [
        "b", "c", "d"]
    assert risk.coverage(queue, log).first()["coverage_pct"] == 25
    assert risk.coverage(queue.limit(0), log).first()["coverage_pct"] == 0
    row = risk.funnel(book, spark.range(50), queue).first()
    assert (row["scanned"], row["flagged"], row["queued"]) == (50, 40, 4)


def test_groups_leave_unknown_out(book):
    got = [(r["group"], r["at_risk"], r["orders"])
           for r in risk.risk_by_group(book, "customer_state").collect()]
    assert got == [("SP", 2, 2), ("RJ", 1, 1), ("AM", 0, 1)]


def test_sort_with_unknown_values(book):
    down = [r["order_id"] for r in risk.sorted_orders(book, "total_price").collect()]
    up = [r["order_id"] for r in risk.sorted_orders(book, "total_price", False).collect()]
    assert down == ["a", "d", "e", "c", "b"] and up == ["b", "c", "e", "d", "a"]


def test_row_ids(spark):
    sent = spark.createDataFrame(
        [("A", None), (None, "B"), (None, None), ("", "")], "order_id string, id string"
    ).coalesce(1)
    assert [r["order_id"] for r in risk.with_row_ids(sent).collect()] == ["A", "B", "row-3", "row-4"]
    many = spark.range(1000).select(F.lit(None).cast("string").alias("order_id")).repartition(7)
    ids = {r["order_id"] for r in risk.with_row_ids(many).collect()}
    assert ids == {f"row-{i}" for i in range(1, 1001)}


def test_uploads_last_row_wins(book, spark):
    uploads = spark.createDataFrame(
        [("a", "old", "XX", 1), ("a", "new", None, 2)],
        "order_id string, main_category string, customer_state string, n int")
    got = by_id(risk.join_uploads(book, uploads, "n"))
    assert (got["a"]["main_category"], got["a"]["customer_state"]) == ("new", "unknown")
    assert got["b"]["main_category"] == "unknown"


def test_order_book_text(book):
    text = risk.order_book_text(book).first()["text"]
    lines = text.split("\n")
    assert lines[1] == "- Orders scored: 5"
    assert lines[2] == "- Delay at-risk: 2 (40%)"
    assert lines[7] == "- a: delay 90.0% (high), low-review 10.0% (low)"
    assert "- toys: 2/3" in lines and "- SP: 2/2" in lines


def test_cap_is_optional(spark):
    assert features.cap_batch(spark.range(30), 10).count() == 10
    assert features.cap_batch(spark.range(30), None).count() == 30
