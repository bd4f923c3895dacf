"""Staged tables' lifetime, partitioned and keyed files, exact slices, buckets, column statistics, and pairs of hot sessions."""

import collections
import datetime
import itertools
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from larkspur.operators import affinity, features, retention, rfm, star
from larkspur.plans import staging
from larkspur.sources import adapters, events


def scan_metrics(df):
    """Sums of the scans' metrics once df has run."""
    df = df.select("*")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    found, todo = collections.Counter(), [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            metrics = node.metrics()
            for name in ("numFiles", "numPartitions", "numOutputRows"):
                if metrics.contains(name):
                    found[name] += metrics.apply(name).value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
    return found


def log(spark, days=40, rows=4000):
    at = F.timestamp_seconds(F.lit(1_000_000_000) + F.col("id") * (days * 86_400 // rows))
    return spark.range(rows).select(at.alias("event_time"), (F.col("id") % 97).alias("product_id"), F.col("id").alias("user_id"), F.concat(F.lit("b"), F.col("id") % 11).alias("brand"))


def test_staged_tables_go_with_the_last_plan(spark):
    staging.reap(wait=5)
    before = set(staging._LIVE)
    first = staging.staged(spark.range(50), "kept")
    path = first.staged_at
    second = first.filter("id > 10").groupBy().count()
    del first
    staging.reap(wait=1)
    assert path in staging._LIVE and second.collect() == second.collect() == [(39,)]
    del second
    assert path not in staging.reap(wait=10) and not Path(path).exists()
    assert set(staging._LIVE) <= before


def test_discarded_tables_are_forgotten(spark):
    df = staging.staged(spark.range(5), "gone")
    staging.discard(df)
    assert df.staged_at not in staging._LIVE and not Path(df.staged_at).exists()


def test_days_are_replaced_alone_and_pruned(spark, tmp_path):
    path, own = str(tmp_path / "days"), log(spark)
    events.write_by_day(own, path)
    events.write_by_day(own.filter("event_time < '2001-09-11'"), path)  # days that are there already
    events.write_by_day(own.limit(0), path)
    late = spark.createDataFrame([(None, 1, -1, "b")], "event_time timestamp, product_id long, user_id long, brand string")
    events.write_by_day(late, path)
    assert spark.read.parquet(path).count() == 4001
    span = events.read_days(spark, path, "2001-09-12 06:00:00", "2001-09-14 00:00:00")
    want = own.filter("event_time >= '2001-09-12 06:00:00' AND event_time < '2001-09-14'")
    assert sorted(r.user_id for r in span.collect()) == sorted(r.user_id for r in want.collect())
    seen = scan_metrics(span)
    assert seen["numPartitions"] == 3 and seen["numOutputRows"] < 400  # of 41 folders; the row groups' spans leave out a part
    assert "PartitionFilters: [isnotnull(event_date" in span._jdf.queryExecution().toString()
    assert events.read_days(spark, path, "2001-09-14", "2001-09-14").count() == 0


def test_months_as_folders(spark, tmp_path):
    events.write_by_day(log(spark, 200), str(tmp_path), unit="month")
    span = events.read_days(spark, str(tmp_path), "2001-10-31", "2001-11-02", unit="month")
    assert span.count() == log(spark, 200).filter("event_time >= '2001-10-31' AND event_time < '2001-11-02'").count()
    assert scan_metrics(span)["numPartitions"] == 2


@pytest.mark.parametrize("rows,size", [(2500, 1000), (3000, 1000), (10, 1000), (0, 10)])
def test_slices_are_exact_and_in_order(spark, tmp_path, rows, size):
    df = spark.range(rows).withColumn("slice_", F.lit("x")).repartition(7).sortWithinPartitions("id")
    path = str(tmp_path / "slices")
    events.write_slices(df, path, size)
    files = sorted(Path(path).glob("slice=*/*.parquet"), key=lambda p: int(p.parent.name[6:]))
    counts = [spark.read.parquet(str(p)).count() for p in files]
    assert counts == [size] * (rows // size) + ([rows % size] if rows % size else [])
    if rows:
        assert spark.read.parquet(path).select("id").distinct().count() == rows
        found = events.file_report(spark, path).collect()
        assert sorted(r.rows for r in found) == sorted(counts) and {r.codec for r in found} == {"zstd"}
        assert {(r.file_name, r.bytes) for r in found} == {(p.name, p.stat().st_size) for p in files}


def test_files_of_one_name_and_size_are_told_apart_by_folder(spark, tmp_path):
    # a task that writes several slices gives them all one name, and equal rows make them equal in size
    events.write_slices(spark.range(1200).select(F.lit(1).alias("x")), str(tmp_path), 100)
    files = list(tmp_path.glob("slice=*/*.parquet"))
    assert len(files) == 12 and len({(p.name, p.stat().st_size) for p in files}) < 12
    assert [r.rows for r in events.file_report(spark, str(tmp_path)).collect()] == [100] * 12


def test_lookups_skip_row_groups_by_bloom_filter(spark, tmp_path):
    # every row group spans all ids, so only the filters tell them apart
    df = spark.range(400_000).select((F.col("id") * 7919 % 400_009).alias("product_id"), F.sha2(F.col("id").cast("string"), 256).alias("brand")).coalesce(1)
    with_, without = str(tmp_path / "with"), str(tmp_path / "without")
    events.write_keyed(df, with_, ("product_id",), row_group_bytes=1 << 20)
    events.write_keyed(df, without, (), row_group_bytes=1 << 20)
    found, plain = (spark.read.parquet(p).filter("product_id = 123456") for p in (with_, without))
    assert found.collect() == plain.collect() and found.count() == 1
    assert scan_metrics(found)["numOutputRows"] * 4 < scan_metrics(plain)["numOutputRows"]


def test_bucketed_tables_join_without_exchange(spark):
    e = adapters.clickstream(spark, "/root/testdata/sf0.001")
    parts = star.dim_users(e), rfm.rfm_segments(rfm.rfm_base(e)), features.session_features(star.sessions(e))
    own = features.feature_table(*(events.bucketed(p, "user_id", 8) for p in parts))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
        grouped = own.groupBy("user_id").count()
        assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
        got, want = ({r.user_id: tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in t.collect()} for t in (own, features.feature_table(*parts)))
        assert got == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("by_")]


def test_column_statistics(spark):
    df = spark.createDataFrame([(1, "a", None, [1]), (3, None, 2.5, None), (1, "c", None, [2])], "n int, s string, `odd name` double, xs array<int>")
    got = {r.column_name: tuple(r)[1:] for r in events.column_statistics(df).collect()}
    assert got == {"n": (3, 0, "1", "3", 2), "s": (3, 1, "a", "c", 2), "odd name": (3, 2, "2.5", "2.5", 1), "xs": (3, 1, None, None, None)}
    assert events.column_statistics(df.limit(0)).filter("rows = 0").count() == 4


def brute_pairs(rows, least, distinct):
    held = collections.defaultdict(collections.Counter)
    for session, product in rows:
        if session is not None and product is not None:
            held[session][product] += 1
    pairs = collections.Counter()
    for c in held.values():
        for a, b in itertools.combinations(sorted(c), 2):
            pairs[a, b] += 1 if distinct else c[a] * c[b]
    return {p: n for p, n in pairs.items() if n >= least}


@pytest.mark.parametrize("block", [3, 512])
def test_pairs_equal_brute_force_whatever_the_blocks(spark, block):
    rng = random.Random(9)
    rows = [(f"s{min(rng.randrange(40), 12)}", rng.choice([None, *range(25)])) for _ in range(900)] + [(None, 1), (None, 2), ("lone", 3), ("twice", 99), ("twice", 99)]
    df = spark.createDataFrame(rows, "user_session string, product_id int")
    for least, distinct in itertools.product((1, 4, 30), (False, True)):
        want = brute_pairs(rows, least, distinct)
        one_way = affinity.product_pairs(df, least, directed=False, distinct=distinct, block=block)
        assert {(r.product_a, r.product_b): r.pair_count for r in one_way.collect()} == want
        both = affinity.product_pairs(df, least, distinct=distinct, block=block).collect()
        assert {(r.product_a, r.product_b): r.pair_count for r in both} == want | {(b, a): n for (a, b), n in want.items()} and len(both) == 2 * len(want)
    assert affinity.product_pairs(df.limit(0), 1, block=block).count() == 0


def test_larger_tables_have_more_tasks_not_larger_ones(spark, monkeypatch):
    monkeypatch.setattr(affinity, "ROWS", 100, raising=False)
    monkeypatch.setattr(affinity, "PAIRS", 200, raising=False)
    rng, tasks = random.Random(4), []
    for sessions in (60, 240):
        rows = [(f"s{i}", rng.randrange(300)) for i in range(sessions) for _ in range(10)]
        pairs = affinity.product_pairs(spark.createDataFrame(rows, "user_session string, product_id int"), 1, directed=False)
        assert {(r.product_a, r.product_b): r.pair_count for r in pairs.collect()} == brute_pairs(rows, 1, False)
        tasks.append(pairs.rdd.getNumPartitions())
    assert 10 <= tasks[0] <= 14 and 3.5 * tasks[0] <= tasks[1] <= 4.5 * tasks[0]


def test_the_logs_join_has_tasks_by_its_lines(spark, monkeypatch):
    few = adapters.retail(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(adapters, "ROWS", 500, raising=False)
    many = adapters.retail(spark, "/root/testdata/sf0.001")
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert many.rdd.getNumPartitions() == 1 + lines // 500 > 8
    assert few.exceptAll(many).count() == many.exceptAll(few).count() == 0 and few.count() == lines


def test_products_have_tasks_by_the_logs_lines_whatever_their_shares(spark, monkeypatch):
    want = star.dim_products(adapters.retail(spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(adapters, "ROWS", 500, raising=False)
    log = adapters.retail(spark, "/root/testdata/sf0.001")
    got = star.dim_products(log)
    assert got.rdd.getNumPartitions() == 1 + log.count() // 500 > 8
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and want.count() > 0
    hot = log.withColumn("product_id", F.lit(None).cast("long"))
    hot.tasks = log.tasks
    best = log.orderBy(*(F.desc(c) for c in ("event_time", "price", "category_code", "brand"))).first()
    assert [(r.product_id, r.current_price, r.brand) for r in star.dim_products(hot).collect()] == [(None, best.price, best.brand)]
    assert star.dim_products(hot, drop_null_key=True).count() == 0


def test_a_frequent_product_spreads_over_the_tasks_of_the_support(spark, monkeypatch):
    monkeypatch.setattr(affinity, "ROWS", 100, raising=False)
    rows = [(f"s{i}", p) for i in range(600) for p in (7, 8 + i % 50, 1000 + i)]
    lines = affinity.shared_lines(affinity.basket_lines(spark.createDataFrame(rows, "user_session string, product_id int")))
    able = affinity.supported_lines(lines, 2, False, 19)
    assert sorted(able.select("user_session", "product_id").collect()) == sorted(x for x in rows if x[1] < 1000)
    where = able.filter("product_id = 7").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert able.rdd.getNumPartitions() == 19 and len(where) > 3 and max(r["count"] for r in where) < 300


def test_support_prunes_products_before_the_join(spark):
    rows = [("hot", i) for i in range(500)] + [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 700), ("c", 700), ("c", 701)]
    lines = affinity.shared_lines(affinity.basket_lines(spark.createDataFrame(rows, "user_session string, product_id int")))
    assert {r.product_id for r in affinity.supported_lines(lines, 2, True).collect()} == {1, 2}
    assert {r.product_id for r in affinity.supported_lines(lines, 2, False).collect()} == {1, 2, 700, 701}


def test_a_hot_session_spreads_over_all_tasks(spark):
    hot = spark.range(3000).select(F.lit("hot").alias("user_session"), F.col("id").alias("product_id"), F.lit(1).cast("long").alias("c"), F.lit(3000).cast("long").alias("products"))
    a, b = affinity.pair_cells(hot, 64)
    met = a.join(b.hint("merge"), ["user_session", "p", "q"]).filter("p < q OR product_a < product_b")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = sorted(r["count"] for r in met.groupBy(F.spark_partition_id().alias("task")).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 3000 * 2999 // 2 and len(sizes) == 16 and sizes[-1] < 2 * sizes[8]


def test_curves_have_the_cells_of_the_matrix(spark):
    rows = [(1, datetime.datetime(2020, 1, 6)), (1, datetime.datetime(2020, 1, 14)), (2, datetime.datetime(2020, 1, 7)), (3, datetime.datetime(2020, 2, 3)), (1, datetime.datetime(2020, 3, 3))]
    df = spark.createDataFrame(rows, "user_id int, event_time timestamp")
    users = df.groupBy("user_id").agg(F.min("event_time").alias("first_seen"))
    weekly = retention.weekly_retention(df, users)
    got = {r.cohort_week.strftime("%m%d"): (r.cohort_size, r.rates) for r in retention.retention_curves(weekly).collect()}
    assert got == {"0106": (2, {0: 1.0, 1: 0.5, 8: 0.5}), "0203": (1, {0: 1.0})}
