"""Training, calibration and bulk scoring of the two risk models.

Imputation values, class weight and thresholds are exact and read all rows, and so do
forests (``TrainSettings.fit_rows`` can ask for a share); isotonic fits are Spark ML's.  Random choices differ from other libraries, so the properties (ranking above
chance, calibration that does not hurt) are what holds.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.operators import boosting
from orderlens.operators import evaluation as E
from orderlens.schemas import LABEL_OF, model_inputs
from orderlens.session import staged

POOLED = "(infrequent)"


@dataclass(frozen=True)
class TrainSettings:
    """Fixed values of the full training; tests pass smaller ones."""

    trees: int = 300
    depth: int = 5
    learning_rate: float = 0.08
    row_share: float = 0.9
    column_share: float = 0.9
    l2: float = 1.0
    bins: int = 256
    fit_rows: int | None = None  # None: all
    min_category_rows: int = 50
    folds: int = 3
    seed: int = E.SEED

    @property
    def boosting(self) -> boosting.BoostSettings:
        return boosting.BoostSettings(
            trees=self.trees, depth=self.depth, learning_rate=self.learning_rate,
            row_share=self.row_share, column_share=self.column_share, l2=self.l2,
            bins=self.bins, seed=self.seed,
        )


@dataclass(frozen=True)
class Imputation:
    """What replaces missing values, and which categories stand on their own."""

    medians: dict[str, float]
    modes: dict[str, str]
    frequent: dict[str, list[str]] = field(default_factory=dict)

    @property
    def levels(self) -> dict[str, list[str]]:
        """The categories that inputs can take once applied."""
        return {c: [*known, POOLED] for c, known in self.frequent.items()}

    def apply(self, df: DataFrame) -> DataFrame:
        """Fill missing values and pool infrequent categories; unseen ones stay unseen."""
        filled = {
            c: F.coalesce(F.col(c).cast("double"), F.lit(float(m))) for c, m in self.medians.items()
        }
        for c, mode in self.modes.items():
            value = F.coalesce(F.col(c), F.lit(mode))
            filled[c] = F.when(value.isin(self.frequent[c]), value).otherwise(F.lit(POOLED))
        return df.withColumns(filled)


def fit_imputation(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], min_rows: int
) -> Imputation:
    """Exact medians, modes and the categories with enough rows (one row each)."""
    medians = {r["feature"]: r["median"] for r in E.median_values(train, numeric).collect()}
    frequencies = staged(E.category_frequencies(train, categorical), "frequencies")
    modes = {r["feature"]: r["category"] for r in E.most_frequent(frequencies).collect()}
    frequent: dict[str, list[str]] = {c: [] for c in categorical}
    for row in frequencies.where(F.col("n") >= min_rows).orderBy("feature", "category").collect():
        frequent[row["feature"]].append(row["category"])
    return Imputation(
        {c: medians.get(c) if medians.get(c) is not None else 0.0 for c in numeric},
        {c: modes.get(c, POOLED) for c in categorical}, frequent,
    )


def fit_isotonic(scored: DataFrame, column: str) -> IsotonicRegressionModel:
    """Isotonic map from score to probability.

    Rows of one score are folded to their mean label and count first: the same
    least-squares fit on one weighted row per distinct score.
    """
    folded = scored.groupBy(column).agg(
        F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("copies")
    )
    return IsotonicRegression(
        featuresCol=column, labelCol="label", weightCol="copies", predictionCol=f"{column}__cal",
    ).fit(folded)


@dataclass
class RiskModel:
    """A calibrated model: fold boosters with their isotonic maps, and metadata."""

    name: str
    imputation: Imputation
    base: boosting.Forest
    folds: list[tuple[boosting.Forest, IsotonicRegressionModel]]
    metadata: dict

    @property
    def threshold(self) -> float:
        return float(self.metadata.get("decision_threshold", 0.5))

    def _input(self, df: DataFrame) -> DataFrame:
        """The imputed inputs, and the caller's row untouched in ``_row``."""
        row = F.struct(*[F.col(c) for c in df.columns])
        inputs = sum(model_inputs(self.name), [])
        return self.imputation.apply(df.withColumn("_row", row)).select("_row", *inputs)

    def base_score(self, df: DataFrame, out: str = "base_score") -> DataFrame:
        """Add ``out``: the uncalibrated probability."""
        return self._input(df).select("_row.*", self.base.probability().alias(out))

    def score(self, df: DataFrame, out: str) -> DataFrame:
        """Add ``out``: the mean of the calibrated fold probabilities.

        Row-local: every booster runs over each partition, nothing is shuffled.
        """
        scored = self._input(df).select(
            "_row", *[f.probability().alias(f"fold{i}") for i, (f, _) in enumerate(self.folds)]
        )
        parts = []
        for i, (_, isotonic) in enumerate(self.folds):
            scored = isotonic.transform(scored)
            parts.append(F.col(f"fold{i}__cal"))
        mean = sum(parts[1:], parts[0]) / float(len(parts))
        return scored.select("_row.*", mean.alias(out))

    def save(self, path: str) -> None:
        """Forests as Parquet, isotonic maps in Spark ML format, the rest as JSON."""
        spark = SparkSession.getActiveSession()
        self.base.frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/base")
        for i, (forest, isotonic) in enumerate(self.folds):
            forest.frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/fold{i}")
            isotonic.write().overwrite().save(f"{path}/isotonic{i}")
        payload = json.dumps({
            "name": self.name, "folds": len(self.folds), "imputation": asdict(self.imputation),
            "metadata": self.metadata,
        })
        spark.createDataFrame([(payload,)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str) -> RiskModel:
        payload = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        imputation = Imputation(**payload["imputation"])

        def forest(part: str) -> boosting.Forest:
            rows = spark.read.parquet(f"{path}/{part}").collect()
            return boosting.Forest.of(rows, list(imputation.medians), imputation.levels)

        return RiskModel(
            payload["name"], imputation, forest("base"),
            [
                (forest(f"fold{i}"), IsotonicRegressionModel.load(f"{path}/isotonic{i}"))
                for i in range(payload["folds"])
            ],
            payload["metadata"],
        )


def train(rows: DataFrame, name: str, settings: TrainSettings = TrainSettings()) -> tuple[RiskModel, DataFrame]:
    """Fit, calibrate and tune one model; returns it and its one-row test report.

    ``rows`` are ``features.modeling_rows``.  The split frame is staged once: every
    fit reads it from there.
    """
    numeric, categorical = model_inputs(name)
    fold = F.floor(E.unit_hash("order_id", settings.seed + 1) * settings.folds).cast("int")
    split = staged(E.stratified_split(rows, seed=settings.seed).withColumn("fold", fold), "split")
    train_rows = split.where(F.col("split") == "train")
    imputation = fit_imputation(train_rows, numeric, categorical, settings.min_category_rows)
    weight = E.class_weight(train_rows).first()["pos_weight"]
    weighted = F.when(F.col("label") == 1, F.lit(float(weight))).otherwise(F.lit(1.0))
    prepared = staged(
        imputation.apply(train_rows).withColumn("weight", weighted), "prepared"
    )
    base, *forests = boosting.fit_forests(
        prepared, numeric, imputation.levels, settings.boosting, settings.folds, settings.fit_rows
    )
    folds = []
    for i, forest in enumerate(forests):
        out = f"fold{i}"
        held_out = prepared.where(F.col("fold") == i).select(
            "label", forest.probability().alias(out)
        )
        folds.append((forest, fit_isotonic(held_out, out)))
    fitted = RiskModel(name, imputation, base, folds, {})
    validation = fitted.score(split.where(F.col("split") == "validation"), "score")
    threshold = E.best_threshold(validation.select("label", "score")).first()["threshold"]
    tested = staged(
        fitted.base_score(fitted.score(split.where(F.col("split") == "test"), "score")), "tested"
    )
    sizes = split.groupBy().pivot("split", ["train", "validation"]).count().first()
    report = E.report(tested, name, float(threshold)).select(
        "*",
        tested.agg(F.avg(F.pow(F.col("base_score") - F.col("label"), F.lit(2.0)))).scalar()
        .alias("uncalibrated_brier"),
        F.lit(sizes["train"]).cast("bigint").alias("train_size"),
        F.lit(sizes["validation"]).cast("bigint").alias("val_size"),
    )
    report = staged(report, "report")
    figures = report.first()
    fitted.metadata = {
        "name": name, "label_col": LABEL_OF[name], "numeric_features": numeric,
        "categorical_features": categorical,
        "positive_base_rate": round(figures["base_rate"], 4),
        "roc_auc": round(figures["roc_auc"], 4) if figures["roc_auc"] is not None else None,
        "decision_threshold": round(float(threshold), 4),
        "calibrated": True, "calibration_method": "isotonic",
    }
    return fitted, report


def score_with_both(frame: DataFrame, delay: RiskModel, low_review: RiskModel) -> DataFrame:
    """Both probabilities for every row of a scoring frame."""
    return low_review.score(delay.score(frame, "delay_probability"), "low_review_probability")


def mean_shap(model: RiskModel, rows: DataFrame) -> DataFrame:
    """(feature, importance): mean absolute Shapley value of the log-odds, over all rows.

    Numbers are named ``num__column``, categories ``cat__column_value``.
    """
    return boosting.mean_attributions(model.base, model._input(rows))


# What is shown for a low-review risk, and how many delay drivers.
LOW_REVIEW_DRIVERS = [
    "delivery_vs_estimate_days", "actual_delivery_days", "estimated_delivery_days",
    "customer_seller_distance_km", "main_category", "total_freight",
]
DELAY_DRIVERS = 6


def order_details(frame: DataFrame) -> DataFrame:
    """Per order the map of both models' inputs: numbers at two decimals, else text."""
    inputs = sorted({c for m in LABEL_OF for c in sum(model_inputs(m), [])})
    text = set(model_inputs("delay")[1])

    def shown(name: str):
        if name in text:
            return F.col(name)
        return F.round(F.col(name).cast("double"), 2).cast("string")

    features = F.map_from_arrays(
        F.array(*[F.lit(c) for c in inputs]), F.array(*[shown(c) for c in inputs])
    )
    return frame.select("order_id", features.alias("features"))


def drivers(details: DataFrame, importance: DataFrame, k: int = DELAY_DRIVERS) -> DataFrame:
    """The k strongest delay inputs with the order's own value, and the six fixed
    low-review ones.  A one-hot input shows its column's value.

    The k importance rows enter as one scalar array, so orders are not shuffled.
    """
    top = (
        importance.orderBy(F.col("importance").desc(), "feature").limit(k)
        .agg(F.sort_array(F.collect_list(F.struct("importance", "feature")), False).alias("t"))
        .scalar()
    )

    def value_of(raw):
        name = F.regexp_replace(raw, r"^[^_]+(_[^_]+)*?__", "")
        own = F.element_at(F.col("features"), name)
        base = F.regexp_replace(name, r"_[^_]*$", "")
        column = F.when(F.contains(name, F.lit("_")), F.element_at(F.col("features"), base))
        return name, F.coalesce(own, column)

    def driver(item):
        name, value = value_of(item["feature"])
        return F.struct(
            name.alias("feature"), F.round(item["importance"], 4).alias("importance"),
            value.alias("value"),
        )

    fixed = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.element_at("features", c).alias("value"))
        for c in LOW_REVIEW_DRIVERS
    ])
    ranked = F.array_compact(F.array(*[
        F.when(F.get("_top", F.lit(i)).isNotNull(), driver(F.get("_top", F.lit(i))))
        for i in range(k)
    ]))
    return details.withColumn("_top", top).select(
        "order_id", "features", ranked.alias("delay_drivers"), fixed.alias("low_review_drivers")
    )
