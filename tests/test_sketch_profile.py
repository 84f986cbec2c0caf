import pytest
from pyspark.sql import functions as F

from orderlens.operators import profile, sketch_profile
from orderlens.sources import snapshots, writers

NUMBERS = ["price", "score"]


def rows(spark, low, high):
    i = F.col("id")
    return spark.range(low, high).select(
        i.alias("order_id"), F.date_add(F.lit("2024-01-01"), (i % 300).cast("int")).cast("timestamp").alias("at"),
        F.when(i % 7 != 0, F.pmod(F.hash("id"), F.lit(900)) / 10.0).alias("price"),
        F.when(i % 11 != 0, (i % 5).cast("int")).alias("score"), F.lit(None).cast("string").alias("none"),
    )


def write(df, path):
    writers.upsert_table(df, path, part=writers.period_part("at"))


def merged(spark, path):
    stored = sketch_profile.stored_sketches(spark, path)
    quality = {r["column_name"]: r for r in sketch_profile.quality_profile(stored).collect()}
    return quality, {r["metric"]: r for r in sketch_profile.describe(stored).collect()}


def test_merged_profile_follows_the_table(spark, tmp_path):
    table, path, anew = (str(tmp_path / x) for x in ("t", "s", "anew"))
    write(rows(spark, 0, 20_000), table)
    assert len(sketch_profile.refresh(spark, table, path, NUMBERS)) == 10
    assert sketch_profile.refresh(spark, table, path, NUMBERS) == []
    # one month is written again, one of its orders moves to a new month
    march = rows(spark, 0, 3_000).where(F.month("at") == 3)
    moved = F.when(F.col("order_id") == march.agg(F.min("order_id")).first()[0], F.lit("2025-05-01").cast("timestamp"))
    write(march.withColumn("at", F.coalesce(moved, "at")).withColumn("price", F.col("price") + 500), table)
    assert sketch_profile.refresh(spark, table, path, NUMBERS) == ["part=2024-03", "part=2025-05"]

    level = writers.read_upserted(spark, table)
    quality, numbers = merged(spark, path)
    exact = {r["column_name"]: r for r in profile.quality_profile(level).collect()}
    assert set(quality) == set(exact)
    for name, row in exact.items():
        got = quality[name]
        assert (got["dtype"], got["n_missing"]) == (row["dtype"], row["n_missing"])
        assert got["pct_missing"] == pytest.approx(row["pct_missing"])
        assert got["n_unique"] == pytest.approx(row["n_unique"], rel=0.03)
    for row in profile.describe(level, NUMBERS).collect():
        got = numbers[row["metric"]]
        assert (got["n"], got["min"], got["max"]) == (row["n"], row["min"], row["max"])
        assert got["mean"] == pytest.approx(row["mean"]) and got["sd"] == pytest.approx(row["sd"])
        known = level.where(F.col(row["metric"]).isNotNull())
        for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
            below = known.where(F.col(row["metric"]) < got[name]).count() / row["n"]
            upto = known.where(F.col(row["metric"]) <= got[name]).count() / row["n"]
            assert below - 0.01 <= p <= upto + 0.01

    # what was merged equals what is built anew
    sketch_profile.refresh(spark, table, anew, NUMBERS)
    again, numbers_again = merged(spark, anew)
    assert {n: tuple(r) for n, r in again.items()} == {n: tuple(r) for n, r in quality.items()}
    for name, row in numbers_again.items():
        assert row["sd"] == pytest.approx(numbers[name]["sd"])


def test_gone_partitions_and_new_columns(spark, tmp_path):
    table, path = str(tmp_path / "t"), str(tmp_path / "s")
    write(rows(spark, 0, 600), table)
    sketch_profile.refresh(spark, table, path, NUMBERS)
    few = rows(spark, 0, 20)  # January alone stays
    writers.replace_table(few, table, writers.period_part("at"))
    assert sketch_profile.refresh(spark, table, path, NUMBERS) == ["part=2024-01"]
    quality, numbers = merged(spark, path)
    assert quality["order_id"]["n_unique"] == 20 and quality["none"]["n_unique"] == 0
    assert numbers["price"]["n"] == few.where(F.col("price").isNotNull()).count()
    writers.replace_table(few.withColumn("more", F.lit(1)), table, writers.period_part("at"))
    sketch_profile.refresh(spark, table, path, NUMBERS)
    assert merged(spark, path)[0]["more"]["n_unique"] == 1


def test_empty_table_and_odd_partition_names(spark, tmp_path):
    table, path = str(tmp_path / "t"), str(tmp_path / "s")
    writers.replace_table(rows(spark, 0, 0), table, writers.period_part("at"))
    assert sketch_profile.refresh(spark, table, path, NUMBERS) == []
    assert merged(spark, path) == ({}, {})
    odd = rows(spark, 0, 40).withColumn("at", F.when(F.col("order_id") > 5, F.col("at")))
    writers.replace_table(odd, table, F.when(F.col("at").isNull(), F.lit("a:b/c=d")).otherwise(F.lit("x")))
    assert len(sketch_profile.refresh(spark, table, path, NUMBERS)) == 2
    assert sketch_profile.refresh(spark, table, path, NUMBERS) == []
    assert sum(r["n_rows"] for r in sketch_profile.stored_sketches(spark, path).where(
        F.col("column_name") == "price").collect()) == 40
    with pytest.raises(FileNotFoundError):
        sketch_profile.refresh(spark, str(tmp_path / "no"), path)
    assert snapshots.load(spark, path).version == 1
