"""Approximate nearest neighbours by adaptive dimension scans of probed lists.

Unit vectors are dealt to lists around k-means centres and turned by a random rotation, so
that the first dimensions of a difference estimate its whole length.  A query scans its
nearest lists in column blocks: after each block a candidate is abandoned if its partial
distance is so large that, by the hypothesis test of the estimate, its full distance exceeds
the query's current k-th best.  Survivors get their exact cosine from the original vectors.

Equal vectors are one entry with its smallest ids (k + 1 suffice, for every one of them ties
with the others), so one vector may hold any share of the rows.  Lists are cut in slices of
bounded size, and each (list, slice) is one group of work.

Centres are fitted on at most ``SAMPLE`` vectors; every vector is indexed.

Defined results: vectors that are null, zero, of another width than most, or that hold null
or non-finite components take no part, nor do rows without vec_id; a repeated row counts
once; a query never finds its own id; with fewer candidates than k all are returned; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.common import hash_partitions, stored

K = 5
EVERY = 50
#: Vectors that the centres are fitted on, at most.
SAMPLE = 20_000
ROWS_PER_LIST = 400
LISTS_AT_MOST = 1024
PROBE_SHARE = 0.65
PROBES_AT_LEAST = 16
SLICE = 4096
BLOCK_COLUMNS = 16
#: Of the hypothesis test: a larger value abandons later and errs less.
EPSILON = 2.1
SEED = 11


def _unit(batch: pd.Series) -> np.ndarray:
    v = np.stack(batch.to_list()).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, v): the vectors that take part."""
    v = F.col(column).cast("array<double>")
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    fine = vectors.select("vec_id", v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    width = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return fine.where(F.size("v") == (width["d"] if width else 0))


def fit_centres(classes: DataFrame, lists: int) -> np.ndarray:
    """Spherical k-means on a bounded sample of distinct vectors."""
    sample = classes.select("v", F.xxhash64("cid").alias("h")).orderBy("h").limit(SAMPLE).toPandas()
    x = _unit(sample["v"])
    draw = np.random.default_rng(SEED)
    centres = x[draw.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(10):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return centres


def scan_list(queries: np.ndarray, vectors: np.ndarray, keep: int, rotation: np.ndarray):
    """(query, vector) index pairs that survive the scan: the ``keep`` nearest and ties, mostly."""
    q, x = queries @ rotation, vectors @ rotation
    width = q.shape[1]
    first = min(len(x), max(keep, 32))
    for i, one in enumerate(q):
        near = ((x[:first] - one) ** 2).sum(axis=1)
        index = np.arange(first)
        bound = np.partition(near, keep - 1)[keep - 1] if len(near) >= keep else np.inf
        if first < len(x):
            alive, partial = np.arange(first, len(x)), np.zeros(len(x) - first)
            for at in range(0, width, BLOCK_COLUMNS):
                partial = partial + ((x[alive, at:at + BLOCK_COLUMNS] - one[at:at + BLOCK_COLUMNS]) ** 2).sum(axis=1)
                seen = min(at + BLOCK_COLUMNS, width)
                slack = 1.0 if seen == width else (1 + EPSILON / np.sqrt(seen)) ** 2
                ok = partial * (width / seen) <= bound * slack * (1 + 1e-9)
                alive, partial = alive[ok], partial[ok]
            index, near = np.concatenate([index, alive]), np.concatenate([near, partial])
            if len(near) > keep:
                bound = np.partition(near, keep - 1)[keep - 1]
        index = index[near <= bound * (1 + 1e-9) + 1e-15]
        yield i, index


def nearest(vectors: DataFrame, column: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """Each query's k nearest by cosine: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, column).dropDuplicates(["vec_id", "v"])
    order = Window.partitionBy("v").orderBy("vec_id")
    firsts = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    classes = stored(
        firsts.groupBy("v").agg(F.min("vec_id").alias("cid"), F.sort_array(F.collect_set("vec_id")).alias("ids")),
        "vector-classes",
    )
    out = "query_id bigint, rank int, vec_id bigint, score double"
    count = classes.count()
    if not count:
        return spark.createDataFrame([], out)
    lists = max(1, min(LISTS_AT_MOST, count // ROWS_PER_LIST))
    probes = min(lists, max(PROBES_AT_LEAST, int(lists * PROBE_SHARE)))
    centres = fit_centres(classes, lists)
    width = centres.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, width)))[0]
    model = spark.sparkContext.broadcast((centres, rotation))  # LISTS_AT_MOST centres at most

    def assign(batches):
        centres, _ = model.value
        for batch in batches:
            if len(batch):
                yield batch.assign(list=np.argmax(_unit(batch["v"]) @ centres.T, axis=1).astype("int32"))

    def probe(batches):
        centres, _ = model.value
        for batch in batches:
            if len(batch):
                near = np.argsort(-(_unit(batch["v"]) @ centres.T), axis=1)[:, :probes]
                yield batch.assign(list=list(near.astype("int32"))).explode("list").astype({"list": "int32"})

    listed = stored(classes.select("cid", "v").mapInPandas(assign, "cid bigint, v array<double>, list int"), "lists")
    sizes = stored(listed.groupBy("list").agg(
        F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices")), "list-sizes")
    asking = stored(
        rows.where(F.col("vec_id") % every == 0).select("vec_id", "v")
        .join(classes.select("cid", "v"), "v").select(F.col("vec_id").alias("query_id"), "cid"), "query-ids",
    )
    # one search for all queries with the same vector
    asked = classes.join(asking.select("cid").distinct(), "cid", "left_semi").select(F.col("cid").alias("qid"), "v")
    left = asked.mapInPandas(probe, "qid bigint, v array<double>, list int").join(
        F.broadcast(sizes), "list"
    ).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    right = listed.join(F.broadcast(sizes), "list").withColumn(
        "slice", F.pmod(F.xxhash64("cid"), F.col("slices")).cast("int")
    )

    def scan(queries: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": [], "cid": [], "score": []}).astype({"qid": "int64", "cid": "int64"})
        if not len(queries) or not len(found):
            return empty
        _, rotation = model.value
        q, x = np.stack(queries["v"].to_list()), np.stack(found["v"].to_list())
        norm_q, norm_x = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
        unit_q, unit_x = q / norm_q[:, None], x / norm_x[:, None]
        qid, cid, parts = queries["qid"].to_numpy(), found["cid"].to_numpy(), [empty]
        # the query's own class is among the nearest, so one more is kept
        for i, index in scan_list(unit_q, unit_x, k + 1, rotation):
            score = (x[index] * q[i]).sum(axis=1) / (norm_x[index] * norm_q[i])
            parts.append(pd.DataFrame({"qid": qid[i], "cid": cid[index], "score": score}))
        return pd.concat(parts, ignore_index=True)

    n = hash_partitions(spark)
    found = left.select("qid", "v", "list", "slice").repartition(n, "list", "slice").groupBy("list", "slice").cogroup(
        right.select("cid", "v", "list", "slice").repartition(n, "list", "slice").groupBy("list", "slice")
    ).applyInPandas(scan, "qid bigint, cid bigint, score double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    top = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    # k + 1 classes of k + 1 ids at most per query vector
    ids = top.join(classes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    listed_ids = stored(
        ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1), "nearest-ids"
    )
    own = Window.partitionBy("query_id").orderBy("n")
    return (
        asking.join(listed_ids, F.col("cid") == F.col("qid")).where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
