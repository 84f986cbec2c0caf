"""Queries over splits, imputation, metrics, and the trained models."""

from __future__ import annotations

from pyspark.sql import functions as F

from orderlens.catalog.core import order_level, query
from orderlens.catalog.orders import r
from orderlens.catalog.relations import DELAY_STAND_IN, REVIEW_STAND_IN
from orderlens.catalog.text import _SECTIONS, headed_documents
from orderlens.operators import evaluation, features, models, retrieval, risk
from orderlens.schemas import MODEL_NAMES, ORDER_TIME_CATEGORICAL, model_inputs
from orderlens.session import scratch_path, staged


def labelled(spark, sf_dir):
    """(model, order_id, label, score) of the stand-in scores, staged for the metrics."""
    rows = features.add_labels(order_level(spark, sf_dir)).where(
        F.col("order_status") == "delivered"
    )
    both = F.array(
        F.struct(F.lit("delay").alias("model"), "order_id",
                 F.col("is_late").cast("int").alias("label"),
                 F.expr(DELAY_STAND_IN).alias("score")),
        F.struct(F.lit("low_review").alias("model"), "order_id",
                 F.col("low_review").cast("int").alias("label"),
                 F.expr(REVIEW_STAND_IN).alias("score")),
    )
    return staged(rows.select(F.inline(both)).where(F.col("label").isNotNull()), "labelled")


def per_model(rows, measure):
    """One measured part per model, stacked."""
    parts = [
        measure(rows.where(F.col("model") == m)).select(F.lit(m).alias("model"), "*")
        for m in MODEL_NAMES
    ]
    return parts[0].unionByName(parts[1])


_HASHED = """
    hashed AS (SELECT model, order_id, label,
                      CAST(CAST('0x' || substr(md5(order_id || ':42'), 1, 12) AS BIGINT) AS DOUBLE)
                      / 281474976710656.0E0 AS u FROM labelled)
"""


@query("m1_stratified_split", f"""
    WITH {_HASHED}
    SELECT order_id, CAST(label AS BIGINT) AS label,
           CASE WHEN rn <= floor((n - 1) * 0.2E0 + 1 + 1e-9) THEN 'test'
                WHEN rn <= floor((n - 1) * 0.36E0 + 1 + 1e-9) THEN 'validation'
                ELSE 'train' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY u) AS rn,
                 count(*) OVER (PARTITION BY label) AS n
          FROM hashed WHERE model = 'delay') h
""")
def stratified_split(spark, sf_dir):
    rows = labelled(spark, sf_dir).where(F.col("model") == "delay")
    return evaluation.stratified_split(rows).select(
        "order_id", F.col("label").cast("bigint").alias("label"), "split"
    )


@query("k6_seeded_sample", f"""
    WITH {_HASHED}
    SELECT order_id FROM hashed WHERE model = 'delay' ORDER BY u, order_id LIMIT 400
""")
def seeded_sample(spark, sf_dir):
    rows = labelled(spark, sf_dir).where(F.col("model") == "delay")
    return evaluation.seeded_sample(rows, 400).select("order_id")


@query("j10_sampled_features", f"""
    WITH {_HASHED},
    drawn AS (SELECT order_id, u FROM hashed WHERE model = 'delay' ORDER BY u, order_id LIMIT 400)
    SELECT d.order_id, round(d.u, 9) AS draw, CAST(f.n_items AS BIGINT) AS n_items,
           f.main_category FROM drawn d JOIN features f ON f.order_id = d.order_id
""")
def sampled_features(spark, sf_dir):
    level = staged(order_level(spark, sf_dir), "level")
    table = features.feature_table(level)
    known = table.where((F.col("order_status") == "delivered") & F.col("is_late").isNotNull())
    sample = evaluation.seeded_sample(known.select("order_id"), 400)
    return evaluation.sampled_features(sample, table).select(
        "order_id", r("draw", 9), "n_items", "main_category"
    )


_NUMERIC = model_inputs("delay")[0]


@query("m2_median_imputation", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median "
    f"FROM features WHERE order_status = 'delivered'" for c in _NUMERIC
))
def median_imputation(spark, sf_dir):
    rows = staged(
        features.feature_table(order_level(spark, sf_dir))
        .where(F.col("order_status") == "delivered").select(*_NUMERIC), "numeric",
    )
    return evaluation.median_values(rows, _NUMERIC).select("feature", r("median"))


_FREQUENCIES = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, {c} AS category, count(*) AS n FROM features "
    f"WHERE order_status = 'delivered' AND {c} IS NOT NULL GROUP BY {c}"
    for c in ORDER_TIME_CATEGORICAL
)


@query("m3_category_encoding", f"""
    WITH freq AS ({_FREQUENCIES}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, category) AS rn
               FROM freq)
    SELECT feature, category, CAST(n AS BIGINT) AS n, n >= 50 AS own_level, rn = 1 AS is_mode
    FROM ranked
""")
def category_encoding(spark, sf_dir):
    rows = features.feature_table(order_level(spark, sf_dir)).where(
        F.col("order_status") == "delivered")
    frequencies = staged(evaluation.category_frequencies(rows, ORDER_TIME_CATEGORICAL), "freq")
    modes = evaluation.most_frequent(frequencies).select(
        "feature", F.col("category").alias("mode"))
    return frequencies.join(modes, "feature").select(
        "feature", "category", "n", (F.col("n") >= 50).alias("own_level"),
        (F.col("category") == F.col("mode")).alias("is_mode"),
    )


@query("m4_class_weight", """
    SELECT model, CAST(count(*) FILTER (WHERE label = 0) AS BIGINT) AS negatives,
           CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS positives,
           round(count(*) FILTER (WHERE label = 0) * 1.0E0
                 / greatest(count(*) FILTER (WHERE label = 1), 1), 6) AS pos_weight
    FROM labelled GROUP BY model
""")
def class_weight(spark, sf_dir):
    return per_model(labelled(spark, sf_dir), evaluation.class_weight).select(
        "model", "negatives", "positives", r("pos_weight", 6)
    )


@query("m7_best_threshold", """
    SELECT model, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM best_cut
""")
def best_threshold(spark, sf_dir):
    return per_model(labelled(spark, sf_dir), evaluation.best_threshold).select(
        "model", r("threshold", 6), r("f1", 6)
    )


@query("m8_m9_m10_ranking_metrics", """
    SELECT r.model, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc,
           round(b.brier, 6) AS brier
    FROM rank_metrics r JOIN (SELECT model, avg(power(score - label, 2)) AS brier
                              FROM labelled GROUP BY model) b ON b.model = r.model
""")
def ranking_metrics(spark, sf_dir):
    return per_model(labelled(spark, sf_dir), evaluation.ranking_metrics).select(
        "model", r("roc_auc", 6), r("pr_auc", 6), r("brier", 6)
    )


@query("m11_point_metrics", """
    SELECT model, round(precision, 6) AS precision, round(recall, 6) AS recall,
           round(f1, 6) AS f1, round(accuracy, 6) AS accuracy, CAST(tn AS BIGINT) AS tn,
           CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp
    FROM point_metrics WHERE cut = 'half'
""")
def point_metrics(spark, sf_dir):
    return per_model(
        labelled(spark, sf_dir), lambda rows: evaluation.point_metrics(rows, 0.5)
    ).select("model", r("precision", 6), r("recall", 6), r("f1", 6), r("accuracy", 6),
             "tn", "fp", "fn", "tp")


_BASELINE = """
    SELECT model, count(*) AS n_test, avg(label) AS base_rate,
           greatest(avg(label), 1 - avg(label)) AS baseline_accuracy,
           CASE WHEN avg(label) >= 0.5 THEN 1.0E0 ELSE 0.0E0 END AS baseline_recall
    FROM labelled GROUP BY model
"""


@query("m12_majority_baseline", f"""
    SELECT model, CAST(n_test AS BIGINT) AS n_test, round(base_rate, 6) AS base_rate,
           round(baseline_accuracy, 6) AS baseline_accuracy, baseline_recall,
           0.5E0 AS baseline_auc FROM ({_BASELINE}) b
""")
def majority_baseline(spark, sf_dir):
    return per_model(labelled(spark, sf_dir), evaluation.majority_baseline).select(
        "model", "n_test", r("base_rate", 6), r("baseline_accuracy", 6), "baseline_recall",
        "baseline_auc",
    )


def stand_in_report(spark, sf_dir):
    """The full metrics row per model, threshold tuned on the same rows."""
    rows = labelled(spark, sf_dir)
    parts = []
    for m in MODEL_NAMES:
        own = rows.where(F.col("model") == m)
        cut = evaluation.best_threshold(own).select("threshold").scalar()
        parts.append(evaluation.report(own, m, cut))
    return parts[0].unionByName(parts[1])


_REPORT = f"""
    metrics AS (SELECT b.*, r.roc_auc, r.pr_auc,
                       (SELECT avg(power(score - label, 2)) FROM labelled l
                        WHERE l.model = b.model) AS brier,
                       t.threshold, t.precision, t.recall, t.f1, t.accuracy,
                       h.accuracy AS accuracy_at_half
                FROM ({_BASELINE}) b JOIN rank_metrics r ON r.model = b.model
                JOIN point_metrics t ON t.model = b.model AND t.cut = 'tuned'
                JOIN point_metrics h ON h.model = b.model AND h.cut = 'half')
"""


@query("m17_model_report", f"""
    WITH {_REPORT}
    SELECT model, CAST(n_test AS BIGINT) AS n_test, round(base_rate, 6) AS base_rate,
           round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(brier, 6) AS brier,
           round(threshold, 6) AS threshold, round(precision, 6) AS precision,
           round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy,
           round(accuracy_at_half, 6) AS accuracy_at_half,
           round(baseline_accuracy, 6) AS baseline_accuracy FROM metrics
""")
def model_report(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    stand_in_report(spark, sf_dir).write.json(path)
    schema = ("model string, n_test bigint, base_rate double, roc_auc double, pr_auc double, "
              "brier double, threshold double, precision double, recall double, f1 double, "
              "accuracy double, accuracy_at_half double, baseline_accuracy double")
    return spark.read.schema(schema).json(path).select(
        "model", "n_test",
        *[r(c, 6) for c in ("base_rate", "roc_auc", "pr_auc", "brier", "threshold", "precision",
                            "recall", "f1", "accuracy", "accuracy_at_half", "baseline_accuracy")],
    )


@query("x5_knowledge_corpus", f"""
    WITH {_SECTIONS},
    {_REPORT},
    sentences AS (SELECT 'metrics_' || model AS id, 'Model ''' || model || ''' — '
        || CASE model WHEN 'delay' THEN 'delivery-delay'
                ELSE 'low-review (1-2 star) satisfaction' END
        || ' risk. Held-out test set: ' || format('{{:,}}', n_test)
        || ' orders; positive base rate ' || printf('%.1f', base_rate * 100) || '%. ROC-AUC '
        || printf('%.4f', roc_auc) || ', PR-AUC ' || printf('%.4f', pr_auc) || ', Brier '
        || printf('%.4f', brier) || '. At the validation-tuned threshold '
        || printf('%.4f', threshold) || ': precision ' || printf('%.4f', precision) || ', recall '
        || printf('%.4f', recall) || ', F1 ' || printf('%.4f', f1) || ', accuracy '
        || printf('%.4f', accuracy) || '. Majority-class baseline accuracy '
        || printf('%.4f', baseline_accuracy) || ', recall on positives '
        || printf('%.4f', baseline_recall) || '. Probabilities are isotonic-calibrated.' AS text,
        'reports/metrics_' || model || '.json' AS source FROM metrics)
    SELECT id, text, source FROM sections UNION ALL SELECT id, text, source FROM sentences
""")
def knowledge_corpus(spark, sf_dir):
    from_docs = retrieval.sections(headed_documents(spark, sf_dir), "doc_id").select(
        "id", "text", "source", F.lit(0).alias("part")
    )
    from_metrics = retrieval.metric_sentences(stand_in_report(spark, sf_dir)).withColumn(
        "part", F.lit(1)
    )
    return retrieval.keep_first(from_docs.unionByName(from_metrics), "id", "part").select(
        "id", "text", "source"
    )


_DRIVER_NUMERIC = ["estimated_delivery_days", "n_items", "max_product_weight_g",
                   "avg_product_volume_cm3", "max_installments"]


@query("m16_order_drivers", f"""
    WITH delivered AS (SELECT f.*, o.actual_delivery_days, o.delivery_vs_estimate_days
                       FROM features f JOIN order_level o ON o.order_id = f.order_id
                       WHERE f.order_status = 'delivered'),
    imp AS ({' UNION ALL '.join(
        f"SELECT 'num__{c}' AS feature, abs(corr(CAST(is_late AS INT), CAST({c} AS DOUBLE))) "
        f"AS importance FROM delivered" for c in _DRIVER_NUMERIC)}
        UNION ALL SELECT 'cat__main_category_large',
            abs(corr(CAST(is_late AS INT), CASE WHEN main_category = 'large' THEN 1.0E0
                     ELSE 0 END)) FROM delivered)
    SELECT d.order_id, regexp_replace(i.feature, '^(num|cat)__', '') AS feature,
           round(i.importance, 4) AS importance,
           CASE i.feature {' '.join(
               f"WHEN 'num__{c}' THEN CAST(round(CAST({c} AS DOUBLE), 2) AS VARCHAR)"
               for c in _DRIVER_NUMERIC)} ELSE main_category END AS value,
           d.main_category AS review_driver
    FROM delivered d CROSS JOIN imp i
""")
def order_drivers(spark, sf_dir):
    frame = staged(
        features.scoring_frame(order_level(spark, sf_dir))
        .where(F.col("order_status") == "delivered"), "frame",
    )
    late = F.col("is_late").cast("int")
    measured = [
        (f"num__{c}", F.abs(F.corr(late, F.col(c).cast("double")))) for c in _DRIVER_NUMERIC
    ] + [(
        "cat__main_category_large",
        F.abs(F.corr(late, F.when(F.col("main_category") == "large", 1.0).otherwise(0.0))),
    )]
    importance = frame.agg(F.array(*[
        F.struct(F.lit(n).alias("feature"), e.alias("importance")) for n, e in measured
    ]).alias("i")).select(F.inline("i"))
    shown = models.drivers(models.order_details(frame), importance)
    return shown.select(
        "order_id", F.inline("delay_drivers"),
        F.element_at("low_review_drivers", 5)["value"].alias("_review"),
    ).select("order_id", "feature", "importance", "value", F.col("_review").alias("review_driver"))


# ---- trained models: checked by their properties ------------------------------------

_TRAINED: dict[tuple[str, str], dict] = {}


def trained(spark, sf_dir):
    """Both models, trained once per session and data set, saved and loaded again."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TRAINED:
        level = staged(order_level(spark, sf_dir), "level")
        frame = features.scoring_frame(level, "order_purchase_timestamp", "review_score")
        loaded, reports, root = {}, {}, scratch_path(spark, "models")
        for name in MODEL_NAMES:
            model, reports[name] = models.train(features.modeling_rows(frame, name), name)
            model.save(f"{root}/{name}")
            loaded[name] = models.RiskModel.load(spark, f"{root}/{name}")
        _TRAINED[key] = {"models": loaded, "reports": reports, "frame": frame}
    return _TRAINED[key]


@query("m5_m6_m14_train_calibrate_save")
def train_both(spark, sf_dir):
    reports = trained(spark, sf_dir)["reports"]
    return reports["delay"].unionByName(reports["low_review"])


@query("m15_bulk_scoring")
def bulk_scoring(spark, sf_dir):
    state = trained(spark, sf_dir)
    delivered = state["frame"].where(F.col("order_status") == "delivered")
    both = models.score_with_both(
        delivered, state["models"]["delay"], state["models"]["low_review"]
    )
    return risk.with_risk(
        both, state["models"]["delay"].threshold, state["models"]["low_review"].threshold
    ).select(
        "order_id", r("delay_probability"), "delay_risk", "delay_flag",
        r("low_review_probability"), "low_review_risk", "low_review_flag",
        risk.priority().alias("priority"),
    )


@query("m13_feature_importance")
def feature_importance(spark, sf_dir):
    state = trained(spark, sf_dir)
    rows = features.modeling_rows(state["frame"], "delay")
    return models.mean_shap(state["models"]["delay"], rows).select(
        "feature", r("importance", 6)
    )
