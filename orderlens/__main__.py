"""Command line: build, increment, train, score, profile.

    spark-submit … -m orderlens build     --raw RAW_DIR --root GOLD_DIR
    spark-submit … -m orderlens increment --raw RAW_DIR --root GOLD_DIR --batch-size 2000
    spark-submit … -m orderlens train     --root GOLD_DIR
    spark-submit … -m orderlens score     --root GOLD_DIR
    spark-submit … -m orderlens profile   --root GOLD_DIR [--merged]
"""

from __future__ import annotations

import argparse
import datetime as dt

from orderlens.operators.models import TrainSettings
from orderlens.operators.sketch_profile import stored_sketches
from orderlens.plans import build, scoring, training
from orderlens.schemas import ORDERS_TABLE, SKETCHES_TABLE
from orderlens.session import build_session
from orderlens.sources.writers import read_upserted
from orderlens.streaming.ingest import DEFAULT_BATCH_SIZE


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="orderlens")
    parser.add_argument("command", choices=["build", "increment", "train", "score", "profile"])
    parser.add_argument("--raw", help="folder of the raw CSV files")
    parser.add_argument("--root", required=True, help="folder of the gold tables and outputs")
    parser.add_argument("--batch-size", type=int, default=DEFAULT_BATCH_SIZE)
    parser.add_argument("--reset", action="store_true")
    parser.add_argument("--no-csv", action="store_true")
    parser.add_argument("--trees", type=int, default=TrainSettings.trees)
    parser.add_argument("--merged", action="store_true", help="profile from stored sketches, no rows read")
    args = parser.parse_args(argv)
    spark = build_session()

    if args.command == "build":
        print(build.run_full(spark, args.raw, args.root, not args.no_csv))
        return 0
    if args.command == "increment":
        print(build.run_incremental(
            spark, args.raw, args.root, args.batch_size, args.reset, not args.no_csv))
        return 0

    level = read_upserted(spark, f"{args.root}/{ORDERS_TABLE}")
    if args.command == "train":
        training.train_all(level, args.root, TrainSettings(trees=args.trees))
        return 0
    if args.command == "profile" and args.merged:
        stored = stored_sketches(spark, f"{args.root}/{SKETCHES_TABLE}")
        outputs = {"profile_merged": scoring.merged_profile_tables(stored)}
    elif args.command == "profile":
        outputs = {"profile": scoring.profile_tables(level)}
    else:
        trained = training.load_all(spark, args.root)
        scored = scoring.score_orders(level, trained)
        outputs = {
            "dashboard": scoring.dashboard(level, scored, trained),
            "segments": scoring.segment_tables(level),
            "forecast": scoring.forecast_tables(level),
        }
        now = dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
        scoring.digest(level, scored, f"{args.root}/digests", now)
        scoring.export_queue(scored, f"{args.root}/exports/action_queue")
    for area, tables in outputs.items():
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{args.root}/{area}/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
