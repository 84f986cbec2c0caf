"""Splits, imputation values and exact metrics of a binary classifier.

Ranking metrics work on one row per distinct score, built with map-side
aggregation; the running totals over scores are bucketed (``running_totals``), so
no task ever sorts all predictions.  Columns: ``label`` (0/1) and ``score``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.operators.quantiles import exact_quantiles, running_totals

SEED = 42
TEST_SHARE = 0.2
VALIDATION_SHARE = 0.2  # of what the test set leaves


def unit_hash(key: str, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16 ** 12)


def stratified_split(df: DataFrame, key: str = "order_id", seed: int = SEED) -> DataFrame:
    """``split``: test 20 %, validation 20 % of the rest, exact within each label.

    The cut points are exact order statistics of the hashed key per label, so the
    strata are exact and any partitioning gives the same split.
    """
    hashed = df.withColumn("_u", unit_hash(key, seed))
    shares = [TEST_SHARE, TEST_SHARE + (1 - TEST_SHARE) * VALIDATION_SHARE]
    metrics = {
        f"label_{y}": F.when(F.col("label") == y, F.col("_u")) for y in (0, 1)
    }
    found = exact_quantiles(hashed, metrics, shares).groupBy().agg(
        F.map_from_entries(F.collect_list(F.struct(  # two labels, two shares
            F.concat_ws("/", "metric", F.round("probability", 2).cast("string")), "lower_value",
        ))).alias("cuts")
    ).scalar()

    def cut(share: float) -> Column:
        name = F.concat(F.lit("label_"), F.col("label").cast("int").cast("string"),
                        F.lit(f"/{round(share, 2)}"))
        return found[name]

    split = (
        F.when(F.col("_u") <= cut(shares[0]), "test")
        .when(F.col("_u") <= cut(shares[1]), "validation").otherwise("train")
    )
    return hashed.withColumn("split", split).drop("_u")


def seeded_sample(df: DataFrame, k: int, key: str = "order_id", seed: int = SEED) -> DataFrame:
    """k rows by hashed key: the same rows under any partitioning."""
    return (
        df.withColumn("_u", unit_hash(key, seed)).orderBy("_u", key).limit(k).drop("_u")
    )


def sampled_features(
    sample: DataFrame, features: DataFrame, key: str = "order_id", seed: int = SEED
) -> DataFrame:
    """Feature rows of a sample, numbered in the order of the draw."""
    rows = features.join(sample.select(key), key, "left_semi")
    return rows.withColumn("draw", unit_hash(key, seed)).orderBy("draw", key)


def median_values(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The exact median per numeric column."""
    return exact_quantiles(train, {c: F.col(c) for c in columns}, [0.5]).select(
        F.col("metric").alias("feature"), F.col("quantile").alias("median")
    )


def category_frequencies(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each known category occurs, per column."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category"))
        for c in columns
    ])
    return (
        train.select(F.inline(pairs)).where(F.col("category").isNotNull())
        .groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n"))
    )


def most_frequent(frequencies: DataFrame) -> DataFrame:
    """The most frequent category per column; ties go to the smallest."""
    top = F.struct(F.col("n"), F.col("category"))
    peak = frequencies.groupBy("feature").agg(F.max("n").alias("n"))
    return (
        frequencies.join(peak, ["feature", "n"])
        .groupBy("feature").agg(F.min("category").alias("category"), F.max(top["n"]).alias("n"))
    )


def class_weight(train: DataFrame) -> DataFrame:
    """Negatives per positive."""
    positives = F.count_if(F.col("label") == 1)
    return train.agg(
        F.count_if(F.col("label") == 0).alias("negatives"), positives.alias("positives"),
        (F.count_if(F.col("label") == 0) / F.greatest(positives, F.lit(1))).alias("pos_weight"),
    )


def score_counts(scored: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score."""
    return scored.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"),
        F.count_if(F.col("label") == 0).alias("neg"),
    )


def operating_curve(scored: DataFrame) -> DataFrame:
    """Per distinct score as threshold: precision, recall, F1 and what AUC needs."""
    curve = running_totals(score_counts(scored), "score", "pos", "neg")
    totals = scored.agg(F.struct(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"),
    ).alias("t")).scalar()
    tp, fp = F.col("pos_at_or_above"), F.col("neg_at_or_above")
    return curve.select(
        "score", "pos", "neg", "neg_above", tp.alias("tp"), fp.alias("fp"),
        totals["pos"].alias("all_pos"), totals["neg"].alias("all_neg"),
        (tp / (tp + fp)).alias("precision"),
        (tp / F.nullif(totals["pos"], F.lit(0))).alias("recall"),
        F.coalesce(2.0 * tp / F.nullif(totals["pos"] + tp + fp, F.lit(0)), F.lit(0.0)).alias("f1"),
    )


def best_threshold(scored: DataFrame) -> DataFrame:
    """The threshold with the highest F1; the lowest one on a tie."""
    curve = operating_curve(scored)
    return curve.agg(
        F.max_by("score", F.struct(F.col("f1"), -F.col("score"))).alias("threshold"),
        F.max("f1").alias("f1"),
    ).select(F.coalesce("threshold", F.lit(0.5)).alias("threshold"), "f1")


def ranking_metrics(scored: DataFrame) -> DataFrame:
    """ROC-AUC (ties count half), step-wise average precision, and Brier score."""
    squared = scored.agg(
        F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2.0))).alias("brier")
    ).scalar()
    # every positive beats the negatives below it and half of those beside it
    beaten = F.col("pos") * (
        F.col("all_neg") - F.col("neg_above") - F.col("neg") + F.col("neg") / 2.0
    )
    return operating_curve(scored).agg(
        (F.sum(beaten) / F.nullif(F.max("all_pos") * F.max("all_neg"), F.lit(0))).alias("roc_auc"),
        F.sum(F.col("pos") / F.nullif(F.col("all_pos"), F.lit(0)) * F.col("precision"))
        .alias("pr_auc"),
    ).select("roc_auc", "pr_auc", squared.alias("brier"))


def point_metrics(scored: DataFrame, threshold: Column | float) -> DataFrame:
    """Confusion matrix and its ratios at one threshold; an empty ratio is 0."""
    cut = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    hit, positive = F.col("score") >= cut, F.col("label") == 1
    counts = scored.agg(
        F.count_if(hit & positive).alias("tp"), F.count_if(hit & ~positive).alias("fp"),
        F.count_if(~hit & positive).alias("fn"), F.count_if(~hit & ~positive).alias("tn"),
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), "tn", "fp", "fn", "tp",
    )


def majority_baseline(scored: DataFrame) -> DataFrame:
    """Always predicting the majority class."""
    base = F.avg("label")
    return scored.agg(base.alias("base_rate"), F.count(F.lit(1)).alias("n_test")).select(
        "n_test", "base_rate",
        F.greatest("base_rate", 1 - F.col("base_rate")).alias("baseline_accuracy"),
        F.when(F.col("base_rate") >= 0.5, 1.0).otherwise(0.0).alias("baseline_recall"),
        F.lit(0.5).alias("baseline_auc"),
    )


def report(scored: DataFrame, model: str, threshold: Column | float) -> DataFrame:
    """One row with every metric of one model."""
    cut = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    rank = ranking_metrics(scored).select(F.struct("*").alias("r")).scalar()
    tuned = point_metrics(scored, cut).select(F.struct("*").alias("p")).scalar()
    half = point_metrics(scored, 0.5).select(F.struct("*").alias("h")).scalar()
    columns = ("precision", "recall", "f1", "accuracy")
    return majority_baseline(scored).select(
        F.lit(model).alias("model"), "n_test", "base_rate",
        *[rank[c].alias(c) for c in ("roc_auc", "pr_auc", "brier")],
        cut.alias("threshold"),
        *[tuned[c].alias(c) for c in (*columns, "tn", "fp", "fn", "tp")],
        *[half[c].alias(f"{c}_at_half") for c in columns],
        "baseline_accuracy", "baseline_recall", "baseline_auc",
    )
