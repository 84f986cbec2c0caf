"""Exact quantiles, running totals and global ranks without collecting a column in one task.

``exact_quantiles`` narrows each quantile with a mergeable sketch to a bracket
holding a sliver of the rows, checks by counting that the bracket holds the ranks
it is for, and widens it if not.  The values inside are then sorted in ranges over
the cluster; equal values travel as one counted row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.session import checkpointed, staged

# Sketch accuracy: its rank error is at most n / SKETCH_ACCURACY; a bracket opens four
# times as wide on each side, two ranks more for short columns, and is counted.
SKETCH_ACCURACY = 10_000
BRACKET_MARGIN = 4.0 / SKETCH_ACCURACY
MORE_RANKS = 2
WIDER = 10.0

_BRACKET = "metric string, probability double, n bigint, low double, high double, under bigint, rank bigint, upper_rank bigint"


def _number(value: float) -> str:
    """A double as SQL text."""
    return f"double('{float(value)!r}')"


def _ranks(n: int, probability: float) -> tuple[int, int]:
    """The two order statistics between which a quantile is interpolated."""
    # guard against 0.9999… where the exact product is a whole number
    lower = floor((n - 1) * probability + 1 + 1e-9)
    return lower, min(lower + 1, n)


def _brackets(values: DataFrame, metrics: Sequence[str], probabilities: Sequence[float]) -> list[tuple]:
    """Rows of ``_BRACKET``, one per (metric, probability) of metrics with a value.

    Reads one row of sketches and one of counts; a bracket that misses its ranks is
    opened wider and counted again, at last from the least to the greatest value.
    """
    sizes = values.selectExpr(*[f"count(`{m}`) AS `{m}`" for m in metrics]).first()
    wanted = [(m, p) for m in metrics if sizes[m] for p in probabilities]
    margin, found = BRACKET_MARGIN, []
    while wanted:
        edges: dict[str, list[float]] = {}
        for m, p in wanted:
            side = margin + MORE_RANKS / sizes[m]
            edges.setdefault(m, []).extend((max(p - side, 0.0), min(p + side, 1.0)))
        cuts = values.selectExpr(*[
            f"percentile_approx(`{m}`, array({', '.join(map(_number, own))}), {SKETCH_ACCURACY}) AS `{m}`"
            for m, own in edges.items()
        ]).first()
        ends = {m: iter(cuts[m]) for m in edges}
        tried = [(m, p, next(ends[m]), next(ends[m])) for m, p in wanted]
        counts = values.selectExpr(*[
            f"struct(count_if(`{m}` < {_number(low)}) AS under, count_if(`{m}` <= {_number(high)}) AS upto) AS b{i}"
            for i, (m, _, low, high) in enumerate(tried)
        ]).first()
        wanted = []
        for (m, p, low, high), (under, upto) in zip(tried, counts):
            lower, upper = _ranks(sizes[m], p)
            if under < lower and upper <= upto:
                found.append((m, float(p), sizes[m], float(low), float(high), under, lower, upper))
            else:
                wanted.append((m, p))
        margin *= WIDER
    return found


def exact_quantiles(
    df: DataFrame, metrics: Mapping[str, Column], probabilities: Sequence[float]
) -> DataFrame:
    """Linear-interpolated quantiles of several columns at once; nulls are skipped.

    The columns are staged and their brackets found when this is called; the input is
    read once.

    One row per (metric, probability): ``n`` values, ``rank`` of the lower order
    statistic, ``lower_value`` there, ``below`` (values smaller than it) and the
    interpolated ``quantile``.
    """
    values = staged(
        df.select(*[expr.cast("double").alias(name) for name, expr in metrics.items()]), "quantile-values"
    )
    rows = _brackets(values, list(metrics), probabilities)
    inside = {m: "false" for m in metrics}
    for m, _, _, low, high, *_ in rows:
        inside[m] += f" OR `{m}` BETWEEN {_number(low)} AND {_number(high)}"
    folded = (
        values.selectExpr("inline(array({}))".format(", ".join(
            f"struct('{m}' AS metric, if({kept}, `{m}`, NULL) AS value)" for m, kept in inside.items()
        )))
        .where("value IS NOT NULL")
        .groupBy("metric", "value").agg(F.count(F.lit(1)).alias("copies"))
    )
    # one row per (metric, probability): bounded by the arguments
    brackets = F.broadcast(df.sparkSession.createDataFrame(rows, _BRACKET))
    counted = running_sums(
        folded.join(brackets, "metric").where(F.col("value").between(F.col("low"), F.col("high"))),
        ["metric", "probability"], F.col("value"), "copies",
    )
    reached = counted.withColumn("upto", F.col("copies_upto") + F.col("under")).withColumn(
        "below", F.col("upto") - F.col("copies")
    )
    at_lower = (F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("upto"))
    at_upper = (F.col("below") < F.col("upper_rank")) & (F.col("upper_rank") <= F.col("upto"))
    found = reached.where(at_lower | at_upper).groupBy("metric", "probability", "n", "rank").agg(
        F.max(F.when(at_lower, F.col("value"))).alias("lower_value"),
        F.max(F.when(at_lower, F.col("below"))).alias("below"),
        F.max(F.when(at_upper, F.col("value"))).alias("upper_value"),
    )
    weight = F.greatest(
        (F.col("n") - 1) * F.col("probability") + 1 - F.col("rank"), F.lit(0.0)
    )
    quantile = F.col("lower_value") + weight * (F.col("upper_value") - F.col("lower_value"))
    return found.select(
        "metric", "probability", "n", "rank", "lower_value", "below", quantile.alias("quantile")
    )


def exact_median(df: DataFrame, value: Column) -> Column:
    """Exact interpolated median as a scalar subquery."""
    return exact_quantiles(df, {"value": value}, [0.5]).select("quantile").scalar()


def running_sums(df: DataFrame, groups: Sequence[str], order: Column, *counts: str) -> DataFrame:
    """``df`` with ``<count>_upto``: sums over a group's rows up to each row by ``order``.

    Rows are staged in ranges of (groups, order), so a large group is spread over many
    tasks; a window sees one range, and what lies before it is one row per range and group.
    ``order`` must tell the rows of a group apart.
    """
    placed = staged(
        df.withColumn("_order", order).repartitionByRange(*groups, "_order")
        .withColumn("_part", F.spark_partition_id()),
        "ranges",
    )
    keys = [*groups, "_part"]
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts]).select(
        *keys, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in counts]
    )
    within = Window.partitionBy(*keys).orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(before, keys).withColumns(
        {f"{c}_upto": F.sum(c).over(within) + F.col(f"_before_{c}") for c in counts}
    ).drop("_order", "_part", *[f"_before_{c}" for c in counts])


def with_global_rank(df: DataFrame, *order: str, rank: str = "rank") -> DataFrame:
    """1-based rank of every row under a total order, without a single-task window.

    Rows are range-partitioned (ties on the first column spread over partitions
    by the later ones), sorted inside their partition and checkpointed, which
    freezes the partition boundaries.  The rank is then the row's position in its
    partition plus the number of rows in earlier partitions: one counted row per
    partition, so the prefix window runs over a few thousand rows at most.
    """
    ordered = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    serial = F.monotonically_increasing_id()
    placed = ordered.withColumn("_serial", serial).select(
        "*",
        F.shiftright("_serial", 33).alias("_part"),
        F.col("_serial").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
    )
    offsets = (
        placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_size").over(
                    Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .select("_part", "_before")
    )
    # one row per partition: bounded by the partition count, not by the data
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(rank, F.col("_before") + F.col("_place") + 1)
        .drop("_serial", "_part", "_place", "_before")
    )


def running_totals(counted: DataFrame, score: str, *counts: str) -> DataFrame:
    """Totals of ``counts`` over all rows with an equal or higher score.

    ``counted`` holds one row per distinct score.  Output adds ``<count>_at_or_above``
    and ``<count>_above``.
    """
    summed = running_sums(counted, [], -F.col(score), *counts)
    return summed.withColumns(
        {f"{c}_above": F.col(f"{c}_upto") - F.col(c) for c in counts}
    ).withColumnsRenamed({f"{c}_upto": f"{c}_at_or_above" for c in counts})
