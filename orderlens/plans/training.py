"""Train both models from the gold order table and keep models and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderlens.operators import features, models
from orderlens.schemas import MODEL_NAMES


def train_all(
    level: DataFrame, root: str, settings: models.TrainSettings = models.TrainSettings()
) -> dict[str, DataFrame]:
    """Fit, save and report the delay and the low-review model."""
    frame = features.scoring_frame(level)
    reports = {}
    for name in MODEL_NAMES:
        rows = features.modeling_rows(frame, name)
        model, report = models.train(rows, name, settings)
        model.save(f"{root}/models/{name}")
        report.write.mode("overwrite").json(f"{root}/reports/metrics_{name}")
        if name == "delay":
            models.mean_shap(model, rows).write.mode("overwrite").json(
                f"{root}/reports/importance_{name}"
            )
        reports[name] = report
    return reports


def load_all(spark: SparkSession, root: str) -> dict[str, models.RiskModel]:
    """Both saved models."""
    return {n: models.RiskModel.load(spark, f"{root}/models/{n}") for n in MODEL_NAMES}
