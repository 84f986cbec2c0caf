import random

import pytest
from pyspark.sql import functions as F

from nine_tables import tables
from orderlens import session
from orderlens.operators.order_level import build_order_level
from orderlens.plans import build
from orderlens.schemas import FEATURES_TABLE, ORDERS_TABLE, RAW_FILES
from orderlens.sources import readers, snapshots, writers
from orderlens.streaming import ingest


def write_raw(spark, root, t=None):
    for name, df in (t or tables(spark)).items():
        df.coalesce(1).write.option("header", "true").option("escape", '"').csv(
            f"{root}/{RAW_FILES[name].replace('*', 'any')}")


def replay_orders(spark):
    return spark.createDataFrame(
        [("c", "2018-03-01"), ("a", "2018-01-01"), ("b", "2018-02-01"), ("d", "2018-04-01"),
         ("z", None), ("y", "garbage")],
        "order_id string, order_purchase_timestamp string")


def test_slices_are_chronological(spark):
    orders, state, seen = replay_orders(spark), ingest.IngestState(), []
    for _ in range(4):
        batch, state = ingest.next_slice(orders, state, 2)
        seen.append([r["order_id"] for r in batch.collect()])
    assert seen == [["a", "b"], ["c", "d"], ["y", "z"], []]
    assert (state.cursor, state.runs) == (6, 4)
    assert ingest.remaining(orders, state).first()["remaining"] == 0
    assert ingest.remaining(orders, ingest.IngestState()).first()["remaining"] == 6


@pytest.mark.parametrize("cells, small", [(4096, 100_000), (3, 5), (2, 1)])
def test_slices_of_any_size(spark, monkeypatch, cells, small):
    monkeypatch.setattr(ingest, "TIME_CELLS", cells)
    monkeypatch.setattr(ingest, "SMALL_CELL", small)
    draw = random.Random(3)
    rows = [(f"o{i:03}", draw.choice(["2018-01-01 10:00:00", f"2018-0{draw.randrange(1, 9)}-1{draw.randrange(9)} 0{draw.randrange(9)}:00:00",
                                      None, "2018-05-05 05:05:05"])) for i in range(45)]
    orders = spark.createDataFrame(rows, "order_id string, order_purchase_timestamp string")
    want = [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[0]))]
    for size in (20,):
        state, seen = ingest.IngestState(), []
        while True:
            batch, after = ingest.next_slice(orders, state, size)
            ids = [r["order_id"] for r in batch.collect()]
            assert after.cursor - state.cursor == len(ids) <= size
            if not ids:
                break
            seen.append(ids)
            state = after
        assert [i for ids in seen for i in ids] == want and all(len(ids) == size for ids in seen[:-1])


def test_only_reviews_are_read_in_one_piece(spark, tmp_path):
    t = tables(spark)
    write_raw(spark, tmp_path / "raw", t)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        parts = {n: df.rdd.getNumPartitions() for n, df in readers.read_raw_tables(spark, str(tmp_path / "raw")).items()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert parts["reviews"] == 1 and parts["orders"] > 1 and parts["items"] > 1


def test_look_up_reads_few_row_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(40_000).select(F.sha1(F.col("id").cast("string")).alias("order_id"), (F.col("id") % 10).alias("p"), "id")
    spark.conf.set("parquet.block.size", str(64 << 10))
    writers.replace_table(rows, path, F.col("p"))
    table = writers.read_upserted(spark, path)
    assert len(list((tmp_path / "t").glob("_write=*/part=*/*.parquet"))) >= 10
    key = rows.where("id = 77").first()["order_id"]
    found = readers.look_up(table, [key, "unknown"], "id")
    assert [tuple(r) for r in found.collect()] == [(key, 77)]
    scans = found._jdf.queryExecution().executedPlan().collectLeaves()
    read = sum(scans.apply(i).metrics().apply("numOutputRows").value() for i in range(scans.size()))
    assert 1 <= read <= 4_000  # one of ten files at most
    with pytest.raises(ValueError, match="join"):
        readers.look_up(table, list(range(2000)), "id")


def test_state_survives(spark, tmp_path):
    path = str(tmp_path / "state")
    assert ingest.load_state(spark, path) == ingest.IngestState()
    _, state = ingest.next_slice(replay_orders(spark), ingest.IngestState(), 3)
    ingest.save_state(spark, path, state)
    assert ingest.load_state(spark, path) == state
    assert state.last_purchase_ts.startswith("2018-03-01")


def upsert_rows(spark, rows):
    return spark.createDataFrame(rows, "order_id string, v int, order_purchase_timestamp string")


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    assert writers.upsert_table(
        upsert_rows(spark, [("o1", 1, "2018-01-01"), ("o2", 2, "2018-02-01")]), path,
        part=writers.period_part()) == 2
    second = upsert_rows(spark, [("o2", 99, "2018-02-01"), ("o3", 3, "2018-03-01")])
    for _ in range(2):  # a repeated batch changes nothing
        assert writers.upsert_table(second, path, part=writers.period_part()) == 3
    got = {r["order_id"]: r["v"] for r in writers.read_upserted(spark, path).collect()}
    assert got == {"o1": 1, "o2": 99, "o3": 3}


def test_upsert_moves_a_row_between_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.upsert_table(upsert_rows(
        spark, [("o1", 1, "2018-01-01"), ("o2", 2, "2018-02-01"), ("o4", 4, "2018-02-02")]),
        path, part=writers.period_part())
    for moved in ([("o1", 5, "2018-02-01")], [("o2", 6, "2018-03-01")]):
        assert writers.upsert_table(upsert_rows(spark, moved), path, part=writers.period_part()) == 3
    got = {r["order_id"]: r["v"] for r in writers.read_upserted(spark, path).collect()}
    assert got == {"o1": 5, "o2": 6, "o4": 4}


def test_upsert_by_key_slot_with_null_keys_and_copies(spark, tmp_path):
    path = str(tmp_path / "t")
    first = upsert_rows(spark, [(None, 1, None), ("o1", 1, None), ("o1", 2, None)])
    assert writers.upsert_table(first, path, order="v") == 2
    again = upsert_rows(spark, [(None, 7, None), ("o1", 3, None)])
    assert writers.upsert_table(again, path) == 3  # rows without a key are appended
    got = sorted((r["order_id"] or "", r["v"]) for r in writers.read_upserted(spark, path).collect())
    assert got == [("", 1), ("", 7), ("o1", 3)]


def values(spark, path, version=None):
    return {r["order_id"]: r["v"] for r in writers.read_upserted(spark, path, version).collect()}


def test_readers_see_one_snapshot(spark, tmp_path):
    path = str(tmp_path / "t")
    by = writers.period_part()
    writers.upsert_table(upsert_rows(spark, [("o1", 1, "2018-01-01"), ("o2", 2, "2018-02-01")]), path, part=by)
    before = writers.read_upserted(spark, path)  # its files are chosen, nothing is read yet
    writers.upsert_table(upsert_rows(spark, [("o1", 9, "2018-03-01"), ("o3", 3, "2018-02-01")]), path, part=by)
    assert {r["order_id"]: r["v"] for r in before.collect()} == {"o1": 1, "o2": 2} == values(spark, path, 0)
    assert values(spark, path) == {"o1": 9, "o2": 2, "o3": 3}
    # an untouched partition stays where it is, an emptied one is named no more
    first, second = (snapshots.load(spark, path, v).parts for v in (0, 1))
    assert set(first) == {"part=2018-01", "part=2018-02"} and set(second) == {"part=2018-02", "part=2018-03"}
    writers.upsert_table(upsert_rows(spark, [("o1", 10, "2018-03-01")]), path, part=by)
    assert snapshots.load(spark, path).parts["part=2018-02"] == second["part=2018-02"]


def test_a_write_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = upsert_rows(spark, [("o1", 1, "2018-01-01")])
    writers.upsert_table(rows, path)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "commit", die)
        with pytest.raises(RuntimeError, match="lost"):
            writers.upsert_table(upsert_rows(spark, [("o1", 2, None), ("o2", 2, None)]), path)
    assert values(spark, path) == {"o1": 1}
    assert writers.upsert_table(upsert_rows(spark, [("o1", 3, None)]), path) == 1
    # two writers from one snapshot: the second is refused
    former = snapshots.load(spark, path, 0)
    with pytest.raises(snapshots.ConcurrentWrite):
        snapshots.note(spark, path, former, ("s", 1))
    assert values(spark, path) == {"o1": 3}


def test_old_snapshots_go(spark, tmp_path):
    path = str(tmp_path / "t")
    for v in range(5):
        writers.upsert_table(upsert_rows(spark, [("o1", v, "2018-01-01"), (f"p{v}", v, f"2018-0{v + 2}-01")]), path,
                             part=writers.period_part())
    snapshots.forget(spark, path, keep=2)
    assert snapshots.versions(spark, path) == [3, 4]
    assert values(spark, path) == {"o1": 4, **{f"p{v}": v for v in range(5)}}
    assert values(spark, path, 3) == {"o1": 3, **{f"p{v}": v for v in range(4)}}
    assert len(list((tmp_path / "t").glob("_write=*/part=2018-01"))) == 2


def test_empty_batches_and_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    none = upsert_rows(spark, [])
    assert writers.upsert_table(none, path, batch=("s", 0)) == 0
    assert writers.read_upserted(spark, path).columns == none.columns and values(spark, path) == {}
    assert writers.upsert_table(upsert_rows(spark, [("o1", 1, None)]), path, batch=("s", 1)) == 1
    assert writers.upsert_table(none, path, batch=("s", 2)) == 1
    assert snapshots.load(spark, path).batches == {"s": 2}
    with pytest.raises(FileNotFoundError):
        writers.read_upserted(spark, str(tmp_path / "nowhere"))


def test_a_batch_is_taken_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = upsert_rows(spark, [(None, 1, None), ("o1", 1, None)])  # a second time, the row without a key would be added
    for _ in range(3):
        assert writers.upsert_table(rows, path, batch=("s", 4)) == 2
    assert writers.upsert_table(rows, path, batch=("other", 4)) == 3
    assert len(snapshots.versions(spark, path)) == 2


def test_merge_rows(spark):
    stored = upsert_rows(spark, [("o1", 1, None), ("o2", 2, None)])
    merged = writers.merge_rows(stored, upsert_rows(spark, [("o2", 9, None), ("o3", 3, None)]))
    assert {r["order_id"]: r["v"] for r in merged.collect()} == {"o1": 1, "o2": 9, "o3": 3}


def test_replace_is_idempotent(spark, tmp_path):
    df = replay_orders(spark)
    for _ in range(2):
        assert writers.replace_table(df, str(tmp_path / "r")) == 6


def same_rows(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_full_build_from_csv(spark, tmp_path):
    write_raw(spark, tmp_path / "raw")
    raw = readers.read_raw_tables(spark, str(tmp_path / "raw"))
    # quotes and a line break inside a review survive
    assert raw["reviews"].where("review_id = 'r1'").first()["review_comment_message"] == (
        'said "good", \nthen left')
    counts = build.run_full(spark, str(tmp_path / "raw"), str(tmp_path / "gold"))
    assert counts == {ORDERS_TABLE: 7, FEATURES_TABLE: 7}
    assert counts == build.run_full(spark, str(tmp_path / "raw"), str(tmp_path / "gold"))
    copy = spark.read.option("header", "true").csv(str(tmp_path / "gold/csv" / ORDERS_TABLE))
    row = copy.where("order_id = 'o1'").first()
    assert row["order_purchase_timestamp"] == "2018-01-02T10:00:00" and row["is_late"] == "false"
    with pytest.raises(readers.MissingSource):
        readers.read_raw_table(spark, str(tmp_path / "nowhere"), "orders")


def test_increments_equal_one_build(spark, tmp_path):
    write_raw(spark, tmp_path / "raw")
    root = str(tmp_path / "gold")
    for _ in range(4):
        state = build.run_incremental(spark, str(tmp_path / "raw"), root, 2, write_csv=False)
    assert state.cursor == 7
    want = build_order_level(readers.read_raw_tables(spark, str(tmp_path / "raw")))
    got = writers.read_upserted(spark, f"{root}/{ORDERS_TABLE}")
    assert same_rows(want.drop("customer_seller_distance_km"), got)
    again = build.run_incremental(
        spark, str(tmp_path / "raw"), root, 2, reset=True, write_csv=False)
    assert again.cursor == 2
    assert writers.read_upserted(spark, f"{root}/{ORDERS_TABLE}").count() == 7


def test_increment_continues_a_full_build(spark, tmp_path):
    write_raw(spark, tmp_path / "raw")
    root = str(tmp_path / "gold")
    build.run_full(spark, str(tmp_path / "raw"), root, write_csv=False)
    want = build_order_level(readers.read_raw_tables(spark, str(tmp_path / "raw")))
    build.run_incremental(spark, str(tmp_path / "raw"), root, 2, write_csv=False)
    got = writers.read_upserted(spark, f"{root}/{ORDERS_TABLE}")
    assert same_rows(want.drop("customer_seller_distance_km"), got)
    assert writers.read_upserted(spark, f"{root}/{FEATURES_TABLE}").count() == 7
    writers.replace_table(want, str(tmp_path / "plain"))
    with pytest.raises(ValueError, match="not partitioned"):
        writers.upsert_table(want, str(tmp_path / "plain"))


def test_stream_replay_and_late_review(spark, tmp_path):
    t, root = tables(spark), str(tmp_path / "gold")
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    t["orders"].repartition(3).write.parquet(source)
    # no order is known before it arrives
    early = {**t, "orders": t["orders"].where("false"), "reviews": t["reviews"].where("review_id <> 'r4'")}
    for _ in range(2):  # the second start finds nothing new
        ingest.stream_ingest(spark, source, "orders", early, root, checkpoint).awaitTermination()
    got = writers.read_upserted(spark, f"{root}/{ORDERS_TABLE}")
    assert got.count() == 7
    assert got.where("order_id = 'o3'").first()["review_score"] is None
    # the review arrives later, as a stream of its own, and changes its order
    arrivals = str(tmp_path / "reviews")
    t["reviews"].where("review_id = 'r4'").write.parquet(arrivals)
    ingest.stream_ingest(
        spark, arrivals, "reviews", early, root, str(tmp_path / "cp2")).awaitTermination()
    want = build_order_level(t).drop("customer_seller_distance_km")
    assert same_rows(want, writers.read_upserted(spark, f"{root}/{ORDERS_TABLE}"))


def test_replayed_and_empty_batches(spark, tmp_path, monkeypatch):
    t, root = tables(spark), str(tmp_path / "gold")
    source = str(tmp_path / "in")
    # the first file is empty
    t["orders"].where("false").coalesce(1).write.parquet(source)
    t["orders"].coalesce(1).write.mode("append").parquet(source)
    early = {**t, "orders": t["orders"].where("false")}
    ingest.stream_ingest(spark, source, "orders", early, root, str(tmp_path / "cp")).awaitTermination()
    names = (ORDERS_TABLE, FEATURES_TABLE)
    want = [writers.read_upserted(spark, f"{root}/{n}") for n in names]
    assert [w.count() for w in want] == [7, 7]
    # the batch comes again after the tables have taken it
    assert not ingest.load_batch(t["orders"], "orders", early, root, (str(tmp_path / "cp"), 1))
    # the sink dies between the tables, and the batch is replayed
    changed, upsert = t["orders"].withColumn("order_status", F.lit("again")), ingest.upsert_table

    def dies_at_features(rows, path, **kwargs):
        if path.endswith(FEATURES_TABLE):
            raise RuntimeError("lost")
        return upsert(rows, path, **kwargs)

    batch = (str(tmp_path / "cp"), 2)
    with monkeypatch.context() as m:
        m.setattr(ingest, "upsert_table", dies_at_features)
        with pytest.raises(RuntimeError):
            ingest.load_batch(changed, "orders", early, root, batch)
    version = snapshots.load(spark, f"{root}/{ORDERS_TABLE}").version
    assert ingest.load_batch(changed, "orders", early, root, batch)
    assert snapshots.load(spark, f"{root}/{ORDERS_TABLE}").version == version
    assert {r[0] for r in writers.read_upserted(spark, f"{root}/{ORDERS_TABLE}").select("order_status").collect()} == {"again"}


def test_uploaded_orders(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_text('order_id, total_price ,note\n007,12.5,"a, b"\n008, ,x\n009,abc,\n')
    df = readers.read_uploaded_orders(spark, str(path))
    assert df.columns == ["order_id", "total_price", "note"]
    got = df.select("order_id", readers.upload_number(df, "total_price").alias("p"),
                    readers.upload_number(df, "absent").alias("q"), "note").collect()
    assert [tuple(r) for r in got] == [
        ("007", 12.5, None, "a, b"), ("008", None, None, "x"), ("009", None, None, None)]
    with pytest.raises(ValueError):
        readers.upload_number(df, "order_id")


def test_lookup_and_corpus(spark, tmp_path):
    table = spark.range(10).select(F.col("id").alias("order_id"), (F.col("id") * 2).alias("v"))
    ids = spark.createDataFrame([(3,), (3,), (77,)], "order_id bigint")
    assert [tuple(r) for r in readers.lookup(table, ids, "v").collect()] == [(3, 6)]
    path = tmp_path / "c.json"
    path.write_text('[{"id": "a", "text": "t1", "source": "s"},\n {"id": "b", "text": "t2"}]')
    got = readers.read_corpus(spark, str(path)).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("a", "t1", "s"), ("b", "t2", None)]


def test_queue_export_quotes_everything(spark, tmp_path):
    from orderlens.operators import risk

    rows = risk.with_risk(spark.createDataFrame(
        [("a", None, 'odd "name"', 0.9, 0.6)],
        "order_id string, customer_state string, main_category string, "
        "delay_probability double, low_review_probability double"))
    writers.write_action_queue(rows.coalesce(1), str(tmp_path / "q"))
    (text,) = [p.read_text() for p in (tmp_path / "q").glob("*.csv")]
    assert text.splitlines()[1] == (
        '"a","high","high","0.900","high","0.600","","odd ""name""",'
        '"Expedite shipping + notify the customer",'
        '"Zendesk / Gorgias | Gmail / Outlook | Google Sheets | Slack"')


def scratch_folders(spark):
    fs, at = snapshots.files(spark, session.shared_dir(spark))
    return {s.getPath().getName() for s in fs.listStatus(at(session.shared_dir(spark)))}


def test_batches_leave_no_stages(spark, tmp_path):
    t, root = tables(spark), str(tmp_path / "gold")
    early = {**t, "orders": t["orders"].where("false")}
    before = scratch_folders(spark)
    assert ingest.load_batch(t["orders"].where("order_id < 'o4'"), "orders", early, root, ("s", 0))
    assert ingest.load_batch(t["orders"].where("order_id >= 'o3'"), "orders", early, root, ("s", 1))
    assert scratch_folders(spark) == before
    want = build_order_level(t).drop("customer_seller_distance_km")
    assert same_rows(want, writers.read_upserted(spark, f"{root}/{ORDERS_TABLE}"))
    before = scratch_folders(spark)
    with pytest.raises(RuntimeError):
        with session.passing_stages(spark):
            kept = session.staged(spark.range(3), "kept")
            with session.passing_stages(spark):
                session.staged(spark.range(3), "inner")
            assert len(scratch_folders(spark) - before) == 1 and kept.count() == 3
            raise RuntimeError
    assert scratch_folders(spark) == before


@pytest.mark.parametrize("prefix", ["", "o"])
def test_children_of_other_orders_are_dropped_where_they_are_read(spark, prefix):
    key = F.col("id") if not prefix else F.concat(F.lit(prefix), "id")
    rows = spark.range(20_000).select(key.alias("order_id"), F.col("id").alias("n"))
    lines = rows.unionByName(rows).unionByName(rows.limit(1).select(F.lit(None).alias("order_id"), "n"))
    known = {"orders": rows, "items": lines, "payments": lines, "reviews": lines, "customers": rows}
    ids = rows.where("n % 2 = 0").select("order_id")
    cut = ingest.restrict(known, ids)
    assert cut["orders"].count() == 10_000
    for name in ingest.ORDER_CHILDREN:
        assert cut[name].join(ids, "order_id", "left_semi").count() == 20_000
        assert cut[name].count() < 23_000
    # keys that would hash differently are left to the join
    if prefix:
        other = {**known, "items": lines.withColumn("order_id", F.col("order_id").cast("binary"))}
        assert ingest.restrict(other, ids)["items"].count() == 40_001


def test_key_filter_of_few_and_of_no_keys(spark, monkeypatch):
    rows = spark.range(2_000).select(F.col("id").alias("order_id"))
    for n in (0, 1, 5):
        assert rows.where(ingest.key_filter(rows.limit(n), n)).join(rows.limit(n), "order_id", "left_anti").count() < 100
        assert rows.limit(n).where(ingest.key_filter(rows.limit(n), n)).count() == n
    monkeypatch.setattr(ingest, "MOST_BITS", 1 << 14)  # a full table of bits lets more rows pass, and loses none
    assert rows.where(ingest.key_filter(rows, 2_000)).count() == 2_000
