import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderlens.operators import pivot_index as P
from orderlens.operators import retrieval as R


def clustered(n=3000, width=6, seed=4):
    """Vectors in twenty tight groups, a third of them one and the same vector."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(20, width)) * 20
    data = middles[rng.integers(0, 20, n)] + rng.normal(size=(n, width))
    data[: n // 3] = data[0]
    return data


def frame_of(spark, data, name):
    return spark.createDataFrame(pd.DataFrame({name: np.arange(len(data)), "vector": list(data)})).repartition(4)


@pytest.mark.parametrize("pivots, max_floats", [(None, 1 << 20), (1, 1 << 20), (37, 30)])
def test_nearest_equals_brute_force(spark, pivots, max_floats):
    data = clustered()
    rng = np.random.default_rng(5)
    asked = np.concatenate([data[[0, 1500, 2999]], data[rng.integers(0, 3000, 9)] + rng.normal(size=(9, 6)), [[0.0] * 6]])
    index = P.build(frame_of(spark, data, "id"), pivots)
    found, told = P.nearest(frame_of(spark, asked, "query_id"), index, 5, max_floats)
    got = found.toPandas()
    for q, point in enumerate(asked):
        square = ((data - point) ** 2).sum(axis=1)
        want = sorted(range(len(data)), key=lambda i: (square[i], i))[:5]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert mine["distance"].to_list() == pytest.approx([square[i] for i in want], abs=1e-9)
        if q:  # next to the copies, ties go to the smaller id
            assert mine["id"].to_list() == want
        else:
            assert mine["id"].to_list() == [0, 1, 2, 3, 4]
    if pivots is None:
        assert told["opened"] < 0.25 * told["pairs"]


def test_closed_cells_are_not_read(spark):
    data = clustered()
    index = P.build(frame_of(spark, data, "id"))
    away = P.distances(data[2000:2001], index.centers)
    first = P.first_cells(index, away, 5)
    assert index.sizes[first[0]].sum() >= 5 and first.sum() <= 3
    rows = index.vectors.where(F.col("cell").isin(np.flatnonzero(first[0]).tolist()))
    assert "PushedFilters: [In(cell" in rows._jdf.queryExecution().executedPlan().toString() or \
        "EqualTo(cell" in rows._jdf.queryExecution().executedPlan().toString()
    # no vector within the limit lies in a closed cell
    square = ((data - data[2000]) ** 2).sum(axis=1)
    limit = np.sqrt(np.sort(square)[40])
    opened = P.open_cells(index, away, np.array([limit]))[0]
    cell = P.distances(data, index.centers).argmin(axis=1)
    assert opened[cell[np.sqrt(square) <= limit]].all()
    assert opened.mean() < 0.5


def test_odd_corpora(spark):
    none = spark.createDataFrame([], "id bigint, vector array<double>")
    asked = spark.createDataFrame([(1, [0.0, 1.0])], "query_id bigint, vector array<double>")
    assert R.nearest_vectors(asked, none).count() == 0
    few = spark.createDataFrame([("b", [0.0, 1.0]), ("a", [0.0, 1.0])], "id string, vector array<double>")
    assert [r["id"] for r in R.nearest_vectors(asked, few).orderBy("rank").collect()] == ["a", "b"]
    assert R.nearest_vectors(asked.where("false"), few).count() == 0
    with pytest.raises(ValueError, match="one length"):
        P.build(few.unionByName(spark.createDataFrame([("c", [1.0])], "id string, vector array<double>")))
