import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderlens.operators import evaluation as E
from orderlens.operators import forecast, profile, segments
from orderlens.operators import quantiles
from orderlens.operators.quantiles import exact_quantiles, with_global_rank


def frame(spark, values, name="v"):
    return spark.createDataFrame(pd.DataFrame({name: np.asarray(values, dtype="float64")}))


@pytest.mark.parametrize("n", [1, 2, 5, 7, 1000])
def test_small_quantiles(spark, n):
    values = np.random.default_rng(n).normal(size=n).round(2)
    got = exact_quantiles(frame(spark, values), {"v": F.col("v")}, [0.0, 0.25, 0.5, 0.9, 1.0])
    for row in got.collect():
        assert row["quantile"] == pytest.approx(np.quantile(values, row["probability"]))


@pytest.mark.parametrize("shape", ["spread", "hot", "narrow", "constant"])
def test_bracketed_quantiles(spark, shape):
    """Above the bracket limit, whatever the distribution; a third of rows share a value."""
    rng = np.random.default_rng(3)
    n = 60_000
    values = {
        "spread": rng.lognormal(3, 2, n),
        "hot": np.where(rng.random(n) < 0.34, 7.0, rng.normal(7, 3, n)),
        "narrow": 1e6 + rng.random(n),
        "constant": np.full(n, 2.5),
    }[shape]
    df = frame(spark, values).repartition(6)
    got = exact_quantiles(df, {"v": F.col("v")}, [0.1, 0.25, 0.5, 0.75, 0.99]).collect()
    ordered = np.sort(values)
    for row in got:
        assert row["quantile"] == pytest.approx(np.quantile(values, row["probability"]))
        assert row["lower_value"] == ordered[row["rank"] - 1]
        assert row["below"] == (values < row["lower_value"]).sum()


def test_nulls_are_skipped(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,)], "v double")
    row = exact_quantiles(df, {"v": F.col("v")}, [0.5]).first()
    assert (row["n"], row["quantile"]) == (2, 1.5)


def test_global_rank(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"spend": np.where(rng.random(5000) < 0.4, 0.0, rng.random(5000).round(3)),
                        "customer": rng.permutation(5000)})
    got = with_global_rank(spark.createDataFrame(pdf).repartition(5), "spend", "customer").toPandas()
    want = pdf.sort_values(["spend", "customer"]).reset_index(drop=True)
    got = got.sort_values("rank").reset_index(drop=True)
    assert list(got["rank"]) == list(range(1, 5001))
    assert list(got["customer"]) == list(want["customer"])


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BRACKET_MARGIN", 1e-5)
    monkeypatch.setattr(quantiles, "MORE_RANKS", 0)
    values = [float(v * v) for v in range(500)]
    got = exact_quantiles(frame(spark, values), {"v": F.col("v")}, [0.1, 0.5])
    assert {r["probability"]: r["quantile"] for r in got.collect()} == pytest.approx(
        {p: np.quantile(values, p) for p in (0.1, 0.5)})


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 10, 11])
def test_spend_tiers_follow_first_rank_quartiles(spark, n):
    spend = np.array([0.0] * (n // 2) + list(np.arange(1, n - n // 2 + 1) * 10.0))
    pdf = pd.DataFrame({"customer": np.arange(n), "orders": 1, "spend": spend})
    customers = spark.createDataFrame(pdf)
    got = {r["tier"]: r for r in segments.spend_tiers(customers).collect()}
    order = np.argsort(spend, kind="stable")
    rank = np.empty(n, dtype=int)
    rank[order] = np.arange(1, n + 1)
    tier = np.maximum(1, np.ceil(4 * (rank - 1) / max(n - 1, 1))).astype(int)
    for i, name in enumerate(segments.TIER_NAMES, 1):
        assert got[name]["customers"] == (tier == i).sum()
        share = 100 * spend[tier == i].sum() / spend.sum() if spend.sum() else 0
        assert got[name]["revenue_share_pct"] == pytest.approx(share)
    ranked = segments.spend_ranks(customers).toPandas()
    assert sorted(ranked["tier_no"]) == sorted(tier)


def test_grid_shows_all_cells(spark):
    customers = spark.createDataFrame(
        [("a", 2, 100.0), ("b", 1, 90.0), ("c", 1, 10.0), ("d", 1, 5.0)],
        "customer string, orders bigint, spend double")
    got = {r["key"]: r for r in segments.value_loyalty_grid(customers).collect()}
    assert len(got) == 4
    assert got["champions"]["customers"] == 1 and got["loyal_regulars"]["customers"] == 0
    assert got["loyal_regulars"]["avg_spend"] == 0.0
    assert sum(r["share_pct"] for r in got.values()) == pytest.approx(100)
    assert got["one_time_buyers"]["revenue_share_pct"] == pytest.approx(15 / 205 * 100)


def months(spark, counts):
    rows = [(f"2018-{m:02d}-05 00:00:00",) for m, c in enumerate(counts, 1) for _ in range(c)]
    return spark.createDataFrame(rows, "t string").select(
        F.col("t").cast("timestamp_ntz").alias("order_purchase_timestamp"))


def test_forecast(spark):
    counts = [10, 2, 12, 15, 14, 18, 21, 20, 25, 24, 28]
    kept = forecast.monthly_orders(months(spark, counts), 5)
    assert kept.count() == 10
    series = {r["month"].strftime("%Y-%m"): r for r in forecast.forecast_series(kept).collect()}
    y = np.array([c for c in counts if c >= 5][-9:], dtype=float)
    slope, intercept = np.polyfit(np.arange(9), y, 1)
    spread = (y - (slope * np.arange(9) + intercept)).std(ddof=1)
    band = max(1.96 * spread, 0.08 * y.mean())
    assert series["2018-11"]["forecast"] == 28 and series["2018-10"]["forecast"] is None
    for i in range(1, 7):
        month = f"2018-{11 + i:02d}" if 11 + i <= 12 else f"2019-{i - 1:02d}"
        expected = slope * (8 + i) + intercept
        assert series[month]["forecast"] == round(expected)
        assert series[month]["upper"] == round(expected + band)
    summary = forecast.forecast_summary(kept).first()
    assert summary["trend_per_month"] == round(slope)
    assert summary["avg_mom_growth_pct"] == pytest.approx(np.mean(np.diff(y) / y[:-1]) * 100)
    assert summary["projected_total"] == sum(
        round(max(0, slope * (8 + i) + intercept)) for i in range(1, 7))


def test_forecast_needs_four_months(spark):
    short = forecast.monthly_orders(months(spark, [9, 9, 9]), 5)
    assert forecast.forecast_series(short).count() == 0
    with pytest.raises(forecast.NotEnoughHistory):
        forecast.require_history(short)


def test_histogram_edges(spark):
    days = [-100.0, -40.0, 0.0, 39.999, 40.0, 200.0]
    df = spark.createDataFrame(
        [("delivered", d) for d in days] + [("shipped", 1.0), ("delivered", None)],
        "order_status string, delivery_vs_estimate_days double")
    got = [r["orders"] for r in profile.lateness_histogram(df).orderBy("bin").collect()]
    want, _ = np.histogram(np.clip(days, -40, 40), bins=60)
    assert got == list(want)


def test_quality_profile(spark):
    df = spark.createDataFrame([(1, "a"), (None, "a"), (1, "b")], "x int, y string")
    got = {r["column_name"]: r for r in profile.quality_profile(df).collect()}
    assert (got["x"]["n_missing"], got["x"]["n_unique"], got["x"]["dtype"]) == (1, 1, "int")
    assert (got["y"]["n_missing"], got["y"]["n_unique"]) == (0, 2)
    sketched = {r["column_name"]: r for r in profile.quality_profile(df, approximate=True).collect()}
    assert sketched["y"]["n_unique"] == 2


def brute_metrics(y, s):
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (
        len(pos) * len(neg))
    ap, last, best = 0.0, 0.0, (-1.0, None)
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        p, r = y[hit].mean(), (y[hit].sum() / y.sum())
        ap += (r - last) * p
        last = r
        f1 = 2 * p * r / (p + r) if p + r else 0.0
        if f1 >= best[0] - 1e-12:
            best = (max(f1, best[0]), t)
    return auc, ap, ((s - y) ** 2).mean(), best


def test_metrics_against_brute_force(spark):
    rng = np.random.default_rng(11)
    s = rng.random(800).round(2)
    s[rng.random(800) < 0.33] = 0.11  # one hot score
    y = (rng.random(800) < 0.2 + 0.5 * s).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s}))
    auc, ap, brier, (f1, cut) = brute_metrics(y, s)
    rank = E.ranking_metrics(df).first()
    assert rank["roc_auc"] == pytest.approx(auc)
    assert rank["pr_auc"] == pytest.approx(ap)
    assert rank["brier"] == pytest.approx(brier)
    best = E.best_threshold(df).first()
    assert (best["threshold"], best["f1"]) == (pytest.approx(cut), pytest.approx(f1))
    point = E.point_metrics(df, float(cut)).first()
    assert point["f1"] == pytest.approx(f1)
    assert point["tp"] + point["fn"] == y.sum()


def test_zero_division_is_zero(spark):
    df = spark.createDataFrame([(0.0, 0.1), (0.0, 0.2)], "label double, score double")
    row = E.point_metrics(df, 0.9).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_split_is_stratified_and_stable(spark):
    df = spark.range(2000).select(
        F.col("id").alias("order_id"), (F.col("id") % 10 == 0).cast("double").alias("label"))
    one = E.stratified_split(df.repartition(3))
    two = E.stratified_split(df.repartition(7))
    assert one.exceptAll(two).count() == 0
    counts = {(r["label"], r["split"]): r["count"]
              for r in one.groupBy("label", "split").count().collect()}
    for label, n in ((0.0, 1800), (1.0, 200)):
        assert abs(counts[label, "test"] - 0.2 * n) <= 1
        assert abs(counts[label, "validation"] - 0.16 * n) <= 1


def test_most_frequent_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert E.most_frequent(E.category_frequencies(df, ["c"])).first()["category"] == "a"
