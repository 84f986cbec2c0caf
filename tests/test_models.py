import pytest
from pyspark.sql import functions as F

from orderlens.operators import features, models, risk
from orderlens.operators import evaluation as E
from orderlens.plans import scoring, training
from orderlens.schemas import model_inputs

SMALL = models.TrainSettings(trees=40, depth=3, learning_rate=0.1)


def synthetic_frame(spark, n=3000):
    """Orders whose lateness depends on the promise and the distance."""
    numeric = model_inputs("low_review")[0]
    noise = {c: F.rand(i + 1) for i, c in enumerate(numeric)}
    base = spark.range(n).select(
        F.col("id").alias("order_id"), *[e.alias(c) for c, e in noise.items()])
    base = base.withColumns({
        "estimated_delivery_days": F.round(5 + 35 * F.col("estimated_delivery_days")),
        "customer_seller_distance_km": F.when(F.rand(77) > 0.1, 3000 * F.col("customer_seller_distance_km")),
        "main_category": F.element_at(F.array(*[F.lit(c) for c in ("toys", "beds", "rare")]),
                                      F.when(F.rand(78) < 0.01, 3).otherwise((F.rand(79) * 2 + 1).cast("int"))),
        "primary_payment_type": F.when(F.rand(80) > 0.2, "boleto"),
        "customer_state": F.lit("SP"), "main_seller_state": F.lit("RJ"),
    })
    late = F.rand(1005) < F.when(F.col("estimated_delivery_days") < 15, 0.6).otherwise(0.1)
    return base.withColumns({
        "is_late": late, "order_status": F.lit("delivered"),
        "low_review": F.rand(1006) < F.when(F.col("actual_delivery_days") > 0.7, 0.5).otherwise(0.1),
    })


@pytest.fixture(scope="module")
def trained(spark):
    rows = features.modeling_rows(synthetic_frame(spark).persist(), "delay").persist()
    model, report = models.train(rows, "delay", SMALL)
    return rows, model, report.first()


def test_report_properties(trained):
    _, model, r = trained
    assert r["roc_auc"] > 0.6 and r["pr_auc"] > r["base_rate"]
    assert r["brier"] <= r["uncalibrated_brier"]
    assert r["n_test"] + r["train_size"] + r["val_size"] == 3000
    assert model.metadata["calibration_method"] == "isotonic"
    assert len(model.metadata["numeric_features"]) == 19


def test_scores_are_probabilities_and_survive_saving(spark, trained, tmp_path):
    rows, model, _ = trained
    model.save(str(tmp_path / "m"))
    loaded = models.RiskModel.load(spark, str(tmp_path / "m"))
    assert loaded.threshold == model.threshold
    one, two = model.score(rows, "p"), loaded.score(rows, "p")
    assert one.exceptAll(two).count() == 0
    low, high = one.agg(F.min("p"), F.max("p")).first()
    assert 0 <= low < high <= 1
    assert one.drop("p").exceptAll(rows).count() == 0  # the caller's values are untouched


def test_tight_promise_is_riskier_and_unseen_values_score(spark, trained):
    _, model, _ = trained
    sent = spark.createDataFrame(
        [("tight", "3", "unseen", ""), ("generous", "38", "toys", "boleto"), ("bare", None, None, None)],
        "order_id string, estimated_delivery_days string, main_category string, "
        "primary_payment_type string")
    rows = features.model_input(features.derive_missing(sent), "delay")
    got = {r["order_id"]: r["p"] for r in model.score(rows, "p").collect()}
    assert got["tight"] > got["generous"]
    assert all(0 <= p <= 1 for p in got.values())


def test_imputation(spark):
    df = spark.createDataFrame(
        [(1.0, "a"), (None, "a"), (2.0, None), (9.0, "b")], "x double, c string")
    fitted = models.fit_imputation(df, ["x"], ["c"], 2)
    assert fitted.medians == {"x": 2.0} and fitted.modes == {"c": "a"}
    assert fitted.frequent == {"c": ["a"]}
    got = [tuple(r) for r in fitted.apply(df).collect()]
    assert got == [(1.0, "a"), (2.0, "a"), (2.0, "a"), (9.0, models.POOLED)]


def test_importance_finds_the_cause(trained):
    rows, model, _ = trained
    got = models.mean_shap(model, rows).orderBy(F.col("importance").desc()).collect()
    assert [r["feature"] for r in got].count("num__estimated_delivery_days") == 1
    assert got[0]["feature"] == "num__estimated_delivery_days" and got[0]["importance"] > 0.05
    assert {r["feature"] for r in got} == set(model.base.names())


def test_drivers(spark):
    details = spark.createDataFrame(
        [("o1", {"total_freight": "5.0", "customer_state": "SP", "main_category": None})],
        "order_id string, features map<string,string>")
    importance = spark.createDataFrame(
        [("num__total_freight", 0.5), ("cat__customer_state_SP", 0.9), ("num__n_items", 0.1)],
        "feature string, importance double")
    row = models.drivers(details, importance, k=6).first()
    assert [tuple(d) for d in row["delay_drivers"]] == [
        ("customer_state_SP", 0.9, "SP"), ("total_freight", 0.5, "5.0"), ("n_items", 0.1, None)]
    assert [d["feature"] for d in row["low_review_drivers"]] == models.LOW_REVIEW_DRIVERS


def test_upload_scoring_end_to_end(spark, trained):
    rows, model, _ = trained
    low = models.RiskModel("low_review", model.imputation, model.base, model.folds, model.metadata)
    low.imputation = models.Imputation(
        {**model.imputation.medians, "actual_delivery_days": 0.0,
         "delivery_vs_estimate_days": 0.0, "is_late_int": 0.0},
        model.imputation.modes, model.imputation.frequent)
    uploads = spark.createDataFrame(
        [(None, "3"), ("x", "30")], "order_id string, estimated_delivery_days string")
    scored = scoring.score_uploads(uploads, {"delay": model, "low_review": low}).persist()
    assert {r["order_id"] for r in scored.collect()} == {"row-1", "x"}
    summary = risk.batch_summary(scored).first()
    assert summary["orders"] == 2 and summary["delay_at_risk"] == scored.where("delay_flag").count()
