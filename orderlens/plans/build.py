"""Gold tables from the raw ones: full rebuild and scheduled increments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderlens.operators import sketch_profile
from orderlens.operators.features import feature_table
from orderlens.operators.order_level import assert_no_fan_out, build_order_level
from orderlens.schemas import FEATURES_TABLE, ORDERS_TABLE, SKETCHES_TABLE
from orderlens.sources.readers import read_raw_tables
from orderlens.sources.writers import (
    period_part,
    read_upserted,
    replace_table,
    write_csv_copy,
)
from orderlens.streaming.ingest import IngestState, run_increment, save_state


def run_full(spark: SparkSession, raw_dir: str, root: str, write_csv: bool = True) -> dict[str, int]:
    """Rebuild both gold tables in the layout of the increments; features come from the written orders."""
    raw = read_raw_tables(spark, raw_dir)
    part = period_part()
    counts = {ORDERS_TABLE: replace_table(build_order_level(raw), f"{root}/{ORDERS_TABLE}", part)}
    level = read_upserted(spark, f"{root}/{ORDERS_TABLE}")
    assert_no_fan_out(level, raw["orders"])
    features = feature_table(level, "order_purchase_timestamp")
    counts[FEATURES_TABLE] = replace_table(features, f"{root}/{FEATURES_TABLE}", part)
    sketch_profile.refresh(spark, f"{root}/{ORDERS_TABLE}", f"{root}/{SKETCHES_TABLE}")
    if write_csv:
        for name in counts:
            write_csv_copy(read_upserted(spark, f"{root}/{name}"), f"{root}/csv/{name}")
    return counts


def run_incremental(
    spark: SparkSession, raw_dir: str, root: str, batch_size: int, reset: bool = False,
    write_csv: bool = True,
) -> IngestState:
    """Ingest the next slice; the profile follows it, the CSV copy is that of the whole table."""
    if reset:
        save_state(spark, f"{root}/ingest_state", IngestState())
    state = run_increment(spark, read_raw_tables(spark, raw_dir), root, batch_size)
    if state.cursor:
        sketch_profile.refresh(spark, f"{root}/{ORDERS_TABLE}", f"{root}/{SKETCHES_TABLE}")
    if write_csv and state.cursor:
        for name in (ORDERS_TABLE, FEATURES_TABLE):
            write_csv_copy(read_upserted(spark, f"{root}/{name}"), f"{root}/csv/{name}")
    return state
