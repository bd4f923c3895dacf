"""Hand-made logs with answers worked out by hand."""

from datetime import datetime

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from larkspur.functions.scalars import format_compact, format_usd
from larkspur.operators import affinity, experiment, features, funnel, propensity, report, retention, rfm, sampling, star
from larkspur.plans.ranking import ntiles, percentiles
from larkspur.plans.star import build_star, register_views, run_query
from larkspur.sources import events as io
from larkspur.streaming.kpis import stream_daily_kpis, stream_sessions

SCHEMA = "event_time timestamp_ntz, event_type string, product_id int, category_id long, category_code string, brand string, price double, user_id long, user_session string"


def t(text):
    return datetime.fromisoformat(text)


def log(spark, *rows):
    """Rows of time, type, product, user, session, and if need be price, category and brand."""
    full = [(t(a), k, p, None, *(rest[1:3] if len(rest) > 2 else ("x.y", "acme")), rest[0] if rest else 1.0, u, s) for a, k, p, u, s, *rest in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def tiny(spark):
    return log(
        spark,
        ("2024-01-01T10:00:00", "view", 1, 1, "a", 5.0, "x.y", "acme"), ("2024-01-01T10:00:30", "cart", 1, 1, "a", 5.0, "x.y", "acme"), ("2024-01-01T10:01:00", "purchase", 1, 1, "a", 5.0, "x.y", "acme"),
        ("2024-01-02T09:00:00", "view", 2, 2, "b", 0.0, None, None), ("2024-01-02T09:10:00", "cart", 2, 2, "b", None, None, None),
        ("2024-01-09T09:00:00", "view", 2, 1, None, 7.0, "x.z", "bolt"), ("2024-01-10T09:00:00", "purchase", 2, 3, "d", 7.0, "x.z", "bolt"), ("2024-01-10T09:00:00", "purchase", 1, 3, "d", 6.0, "x.y", "acme"),
    )


def test_products_take_the_newest_row_and_break_ties(spark, tiny):
    got = {r.product_id: (r.current_price, r.brand, r.category_code) for r in star.dim_products(tiny).collect()}
    assert got == {1: (6.0, "acme", "x.y"), 2: (7.0, "bolt", "x.z")}
    tied = log(spark, ("2024-01-01T00:00:00", "view", 1, 1, "a", 1.0, "a", "a"), ("2024-01-01T00:00:00", "view", 1, 1, "a", 2.0, None, None))
    assert star.dim_products(tied).first()["brand"] == "unknown"


def test_days_users_and_sessions_agree_on_revenue(tiny):
    days = {str(r.date): r for r in star.daily_kpis(tiny).collect()}
    assert (days["2024-01-01"].total_events, days["2024-01-01"].dau, days["2024-01-10"].daily_revenue, days["2024-01-09"].daily_sessions) == (3, 1, 13.0, 0)
    total = sum(r.daily_revenue for r in days.values())
    assert total == sum(r.total_spend for r in star.dim_users(tiny).collect()) == sum(r.session_revenue for r in star.sessions(tiny).collect()) == 18.0
    assert {r.user_id: r.is_buyer for r in star.dim_users(tiny, "c").collect()} == {1: 1, 2: 0, 3: 1}


def test_session_variants(spark):
    df = log(spark, ("2024-01-01T00:00:00.900000", "view", 1, 1, "s"), ("2024-01-01T00:00:01.100000", "view", 2, 1, "s"), ("2024-01-01T00:00:00", "view", 2, 1, None))
    full = star.sessions(df).collect()
    assert len(full) == 1 and full[0].duration_sec == 1
    compact = {r.user_session: r for r in star.compact_sessions(df).collect()}
    assert compact["s"].duration_sec == 0 and compact["s"].unique_products == 2 and None in compact


def test_mode_takes_the_smallest_of_tied_categories(spark):
    df = log(spark, ("2024-01-01T00:00:00", "view", 1, 1, "s", 1.0, "b", "x"), ("2024-01-01T00:00:01", "view", 1, 1, "s", 1.0, "a", "x"))
    assert star.sessions(df).first().top_category == "a"


@pytest.mark.parametrize("n", [1, 3, 4, 5, 7, 11, 1503])
def test_tiles_equal_those_of_one_window(spark, n):
    df = spark.range(n).selectExpr("id AS user_id", "CAST(id * 7919 % 13 AS INT) AS m", "CAST(id % 3 AS DOUBLE) AS k")
    got = {r.user_id: (r.a, r.b) for r in ntiles(df, {"a": ["m", "user_id"], "b": ["-k", "user_id"]}, 5, "user_id").collect()}
    df.createOrReplaceTempView("ranked")
    want = spark.sql("SELECT user_id, ntile(5) OVER (ORDER BY m, user_id) a, ntile(5) OVER (ORDER BY k DESC, user_id) b FROM ranked")
    assert got == {r.user_id: (r.a, r.b) for r in want.collect()}


def test_tiles_with_nulls_and_without_rows(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "user_id long, m int")
    got = ntiles(df, {"up": ["m", "user_id"], "down": ["-m", "user_id"]}, 3, "user_id").collect()
    assert {r.user_id: (r.up, r.down) for r in got} == {1: (1, 3), 3: (2, 2), 2: (3, 1)}
    assert ntiles(df.limit(0), {"up": ["m", "user_id"]}, 3, "user_id").count() == 0


def test_tiles_of_one_value(spark):
    df = spark.range(4000).selectExpr("(id * 7919) % 100003 AS user_id", "IF(id % 3 = 0, id, 1) AS m")
    got = {r.user_id: r.a for r in ntiles(df, {"a": ["m", "user_id"]}, 5, "user_id").collect()}
    df.createOrReplaceTempView("ranked")
    assert got == {r.user_id: r.a for r in spark.sql("SELECT user_id, ntile(5) OVER (ORDER BY m, user_id) a FROM ranked").collect()}


@pytest.mark.parametrize("n", [0, 1, 2, 5, 3000])
def test_percentiles_equal_those_of_one_task(spark, n):
    df = spark.range(n).selectExpr("IF(id % 4 = 0, 7.5D, IF(id % 11 = 0, NULL, pow(id * 7919 % 1009, 2) / 3)) AS x")
    shares = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)
    got = percentiles(df, "x", shares).first().p
    want = [df.selectExpr(f"percentile(x, {q})").first()[0] for q in shares]
    assert got == pytest.approx(want) if n else got == want


@pytest.mark.parametrize("expr", ["CAST(id * 7919 % 100003 AS DOUBLE)", "IF(id % 3 = 0, 5D, id / 7)", "5D", "IF(id % 2 = 0, 1D, 2D)"])
def test_percentiles_over_several_ranges(spark, expr):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows end in one range
    try:
        df = spark.range(5000).selectExpr(f"{expr} AS x")
        shares = (0.0, 0.1, 0.25, 0.4999, 0.5, 0.75, 0.999, 1.0)
        got = percentiles(df, "x", shares).first()
        want = df.selectExpr(f"percentile(x, array({', '.join(map(str, shares))})) AS p", "min(x) AS least", "max(x) AS greatest", "avg(x) AS mean").first()
        assert got.p == pytest.approx(want.p) and (got.least, got.greatest) == (want.least, want.greatest) and got["mean"] == pytest.approx(want["mean"])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_labels_of_all_scores(spark):
    grid = spark.createDataFrame([(r, f) for r in range(1, 6) for f in range(1, 6)], "r_score int, f_score int")
    f = {(r.r_score, r.f_score): r.x for r in grid.withColumn("x", rfm._labels(rfm.RULES_F, "At Risk")).collect()}
    assert (f[5, 2], f[1, 3], f[2, 1], f[3, 1], f[4, 1], f[3, 3], f[5, 5], f[1, 2]) == ("At Risk", "At Risk", "At Risk", "Promising", "New Customers", "Loyal Customers", "Champions", "Hibernating")
    c = {(r.r_score, r.f_score): r.x for r in grid.withColumn("x", rfm._labels(rfm.RULES_C, "Regular")).collect()}
    assert (c[3, 2], c[2, 3], c[1, 1], c[5, 1]) == ("Regular", "At Risk", "Lost", "Promising")


def test_recency_counts_midnights(spark):
    df = log(spark, ("2024-01-01T23:59:00", "purchase", 1, 1, "a"), ("2024-01-02T00:01:00", "purchase", 1, 2, "b"))
    assert {r.user_id: r.recency_days for r in rfm.rfm_base(df).collect()} == {1: 1, 2: 0}


def test_features_of_users_without_carts(tiny):
    s = {r.user_id: r for r in features.session_features(star.sessions(tiny)).collect()}
    assert s[3].checkout_rate == 0 and s[3].std_session_duration == 0 and s[1].cart_rate == 1
    wide = {r.user_id: r for r in features.feature_table(star.dim_users(tiny), rfm.rfm_segments(rfm.rfm_base(tiny)), features.session_features(star.sessions(tiny))).collect()}
    assert (wide[2].rfm_segment, wide[2].rfm_code, wide[2].recency_days, wide[2].monetary_raw) == ("Browser", "000", -1, 0.0)


def test_funnels(tiny, spark):
    f = funnel.session_funnel(star.sessions(tiny)).first()
    assert (f.sessions_with_view, f.sessions_with_cart, f.sessions_with_purchase, f.overall_conversion) == (2, 2, 2, 0.6667)
    empty = funnel.event_funnel(tiny.limit(0)).first()
    assert empty.views == 0 and empty.view_to_cart_pct == 0
    assert tuple(funnel.distinct_session_funnel(tiny).first()) == (2, 2, 2)


def test_cohorts_begin_on_monday(spark):
    df = log(spark, ("2024-01-07T12:00:00", "view", 1, 1, "a"), ("2024-01-08T12:00:00", "view", 1, 1, "b"), ("2024-01-08T12:00:00", "view", 1, 2, "c"))
    got = {(str(r.cohort_week)[:10], r.weeks_since_first): (r.active_users, r.retention_rate) for r in retention.weekly_retention(df, star.dim_users(df)).collect()}
    assert got == {("2024-01-01", 0): (1, 1.0), ("2024-01-01", 1): (1, 1.0), ("2024-01-08", 0): (1, 1.0)}
    matrix = retention.retention_matrix(retention.weekly_retention(df, star.dim_users(df)), [0, 1, 2]).orderBy("cohort_week").collect()
    assert [tuple(r)[1:] for r in matrix] == [(1.0, 1.0, None), (1.0, None, None)]


def test_churn_edges(spark):
    df = log(spark, *((f"2024-01-{d:02d}T00:00:00", "view", 1, d, "s") for d in (1, 2, 8, 9)), ("2024-01-16T00:00:00", "view", 1, 99, "s"))
    assert {r.user_id: r.status for r in retention.churn_status(star.dim_users(df), df).collect()} == {1: "Churned", 2: "At Risk", 8: "At Risk", 9: "Active", 99: "Active"}


def test_pairs_by_rows_and_by_sessions(spark):
    df = log(spark, *(("2024-01-01T00:00:00", "purchase", p, 1, s) for p, s in ((1, "a"), (1, "a"), (2, "a"), (3, None), (1, None))))
    rows = affinity.baskets(df)
    assert {(r.product_a, r.product_b): r.pair_count for r in affinity.product_pairs(rows, 1).collect()} == {(1, 2): 2, (2, 1): 2}
    assert [tuple(r) for r in affinity.product_pairs(rows, 1, directed=False, distinct=True).collect()] == [(1, 2, 1)]
    assert {r.product_id: r.support for r in affinity.product_support(rows).collect()} == {1: 3, 2: 1, 3: 1}


def test_lift_is_symmetric(spark):
    df = log(spark, *(("2024-01-01T00:00:00", "purchase", p, 1, s) for p, s in ((1, "a"), (2, "a"), (1, "b"), (2, "b"), (3, "c"), (3, "d"))))
    rules = {(r.product_a, r.product_b): (r.confidence, r.lift) for r in affinity.affinity_rules(df, 2).collect()}
    assert rules == {(1, 2): (1.0, 2.0), (2, 1): (1.0, 2.0)}
    products = star.dim_products(df)
    assert affinity.recommend(affinity.affinity_rules(df, 2), products, 1).count() == 1
    assert affinity.recommend_all(affinity.affinity_rules(df, 2), 1).count() == 2


def test_reports(tiny):
    mix = report.event_mix(tiny).collect()
    assert abs(sum(r.pct for r in mix) - 100) < 0.05
    nulls = report.null_profile(tiny).first()
    assert (nulls.user_session_nulls, nulls.brand_nulls, nulls.no_price_pct) == (1, 2, 25.0)
    rows = {r.column_name: r for r in report.profile(tiny).collect()}
    assert rows["price"].nulls == 1 and rows["price"].max_value == 7.0 and rows["brand"].min_value is None
    bands = [(r.price_band, r.events) for r in report.price_bands(tiny).collect()]
    assert bands == [("$0-10", 6)]
    assert report.key_metrics(report.user_summary(tiny)).first().avg_order_value == pytest.approx((5 + 6.5) / 2)
    assert {r.table_name: r["rows"] for r in report.row_counts({"a": tiny, "b": tiny.limit(2)}).collect()} == {"a": 8, "b": 2}


def test_samples_repeat_and_are_part_of_the_source(spark):
    df = log(spark, *((f"2024-01-01T00:{m:02d}:00", "view", m, u, "s") for u in range(100) for m in range(u % 5 + 1)))
    users = sampling.stratified_users(df, 10.0).collect()
    assert sorted(r.quintile for r in users) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    a, b = (sorted(map(tuple, sampling.stratified_user_sample(df, 10.0).collect())) for _ in range(2))
    assert a == b and set(a) <= set(map(tuple, df.collect()))
    assert io.load_for_analysis(df, 0.1).select("user_id").distinct().count() == 10
    assert sampling.temporal_coverage(df).first().days == 1
    assert sampling.compare_mix(df, df.limit(3)).count() == 2


def test_experiment_against_tabulated_values(spark):
    rows = [("control", 1)] * 100 + [("control", 0)] * 900 + [("treatment", 1)] * 150 + [("treatment", 0)] * 850
    r = experiment.ab_readout(spark.createDataFrame(rows, "variant string, converted int")).first()
    assert r.lift == pytest.approx(0.5) and r.z_stat == pytest.approx(3.3903, abs=1e-4) and r.z_p_value == pytest.approx(0.000698, abs=1e-6)
    assert r.significant and r.decision == "SHIP" and (r.ci_lower, r.ci_upper) == pytest.approx((0.021095, 0.078905), abs=1e-6)
    flat = experiment.ab_readout(spark.createDataFrame([("control", 0), ("treatment", 0)], "variant string, converted int")).first()
    assert flat.decision == "HOLD" and flat.t_p_value is None


def test_variants_are_stable_and_even(spark):
    users = spark.range(10_000).withColumnRenamed("id", "user_id")
    n = {r.variant: r["count"] for r in experiment.assign_variants(users, "x").groupBy("variant").count().collect()}
    assert abs(n["control"] - 5000) < 250


def test_retention_matrix_has_every_week(spark):
    df = log(spark, *((a, "view", 1, 1, "s") for a in ("2024-01-01T00:00:00", "2024-03-26T00:00:00", "2024-12-31T00:00:00")))
    weekly = retention.weekly_retention(df, star.dim_users(df))
    assert retention.retention_matrix(weekly).columns == ["cohort_week", "0", "12", "52"]
    assert retention.retention_matrix(weekly, range(2)).columns == ["cohort_week", "0", "1"]


def test_top_share_with_ties(spark):
    df = spark.createDataFrame([(i, float(i >= 90), int(i % 2 == 0)) for i in range(100)], "user_id long, score double, target int")
    r = propensity.top_share_metrics(df).first()
    assert (r.selected, r.precision, r.recall, r.lift) == (10, 0.5, 0.1, 1.0)


def test_propensity_model_learns(spark, tmp_path):
    frame = spark.range(400).selectExpr("id AS user_id", *(f"CAST(id % {k} AS LONG) AS {c}" for k, c in zip((7, 3, 5, 2, 4, 6, 9), propensity.FEATURES, strict=True)), "CAST(id % 2 AS INT) AS target")
    fit, test = propensity.stratified_split(frame)
    assert fit.count() + test.count() == 400
    model = propensity.train(fit, rounds=5)
    assert propensity.roc_auc(propensity.score(model, test)) > 0.95
    assert propensity.feature_importance(model).first().feature == "carts"
    propensity.save_model(model, str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert sorted(map(tuple, propensity.score(again, test).collect())) == sorted(map(tuple, propensity.score(model, test).collect()))
    assert {r.target: r["count"] for r in test.groupBy("target").count().collect()} == {0: 40, 1: 40}
    assert propensity.roc_auc(spark.createDataFrame([(0, 0.1), (1, 0.1), (1, 0.3), (0, 0.2)], "target int, score double")) == 0.625


def test_noise_grows_few_trees_and_fits_little(spark):
    """Where nothing tells the classes apart, scores stay near the share of the class."""
    noise = (f"CAST(abs(hash(id, {i})) % 1000 AS LONG) AS {c}" for i, c in enumerate(propensity.FEATURES))
    frame = spark.range(3000).selectExpr("id AS user_id", *noise, "CAST(abs(hash(id, 99)) % 2 AS INT) AS target")
    fit, test = propensity.stratified_split(frame)
    model = propensity.train(fit)
    assert model.stages[-1].getNumTrees < 30
    loss = propensity.score(model, test).agg(F.avg(-F.log(F.when(F.col("target") == 1, F.col("score")).otherwise(1 - F.col("score"))))).first()[0]
    assert loss < 0.72  # 0.693 of a constant


def test_text_forms(spark):
    df = spark.createDataFrame([(1234567.0,), (999.0,), (1500.0,), (None,)], "x double")
    assert [tuple(r) for r in df.select(format_compact("x"), format_usd("x")).collect()] == [("1.2M", "$1,234,567.00"), ("999", "$999.00"), ("1.5K", "$1,500.00"), (None, None)]


def test_compact_numbers_round_as_printf_does(spark):
    known = [(1250.0, "1.2K"), (1350.0, "1.4K"), (1450.0, "1.4K"), (1750.0, "1.8K"), (1950.0, "1.9K"), (-1950.0, "-1.9K"), (0.5, "0"), (2.5, "2"), (999.5, "1000"), (12_250_000.0, "12.2M"), (1_050_000_000.0, "1.1B")]
    got = spark.createDataFrame(known, "x double, shown string").select("shown", format_compact("x").alias("got")).collect()
    assert [r.got for r in got] == [r.shown for r in got]
    sums = [step * i for step in (1.0, 50.0, 50_000.0, 50_000_000.0) for i in range(900, 3000)]
    want = [next(f"{x / size:.1f}{unit}" if unit else f"{x:.0f}" for size, unit in ((1e9, "B"), (1e6, "M"), (1e3, "K"), (0, "")) if x >= size) for x in sums]
    assert [r.got for r in spark.createDataFrame([(x,) for x in sums], "x double").select(format_compact("x").alias("got")).collect()] == want


def test_files_there_and_back(spark, tmp_path):
    head = "event_time,event_type,product_id,category_id,category_code,brand,price,user_id,user_session\n"
    (tmp_path / "a.csv").write_text(head + "2019-10-01 00:00:00 UTC,view,1,2,,acme,1.5,7,s\n")
    (tmp_path / "b.csv").write_text(head + "2019-10-02 00:00:00 UTC,purchase,3,2,x.y,,2.5,8,\nbad,view,1,2,,,1,9,\n2019-10-02 00:00:00 UTC,view,99999999999,2,,,1,9,\n")
    raw = io.read_events_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    good, rejects = io.split_rejects(raw)
    assert (good.count(), rejects.count()) == (2, 2)
    events = io.optimize_events(good)
    assert dict(events.dtypes)["event_time"] == "timestamp_ntz" and dict(events.dtypes)["price"] == "float"
    io.write_events(events, str(tmp_path / "one"))
    back = io.read_events(spark, str(tmp_path / "one"))
    assert sorted(map(str, back.collect())) == sorted(map(str, events.collect()))
    io.write_chunks(events.repartition(1), str(tmp_path / "many"), rows=1)
    assert len(list((tmp_path / "many").glob("*.parquet"))) == 2
    assert io.size_report(spark, str(tmp_path / "one"), str(tmp_path / "many")).first().bytes_before > 0
    io.ingest_events(events, "ingested_events")
    n, few = io.check_load(spark, "ingested_events")
    assert n == 2 and len(few.collect()) == 2
    assert io.describe_tables(spark).filter("table_name = 'ingested_events'").count() == 9
    io.save_table(events.limit(0), "derived")
    io.save_table(events.select("user_id", "price"), "derived")
    assert spark.table("derived").columns == ["user_id", "price"] and spark.table("derived").count() == 2
    sizes = {r.table_name: r for r in io.table_sizes(spark).collect()}
    assert sizes["derived"].rows == 2 and sizes["ingested_events"].bytes > 0
    assert {tuple(r) for r in io.write_tables({"a": events, "none": events.limit(0)}, str(tmp_path / "tables")).collect()} == {("a", 2), ("none", 0)}
    assert io.read_events(spark, str(tmp_path / "tables" / "a")).count() == 2
    spark.sql("DROP TABLE ingested_events")
    spark.sql("DROP TABLE derived")


def test_star_views_answer_sql(spark, tiny):
    for variant in ("f", "c"):
        register_views(build_star(tiny, variant, min_support=1, as_of="2024-02-01"))
        assert run_query(spark, "SELECT count(*) AS n FROM dim_users WHERE total_spend >= :least", least=5.0).first().n == 2


def test_streams(spark, tiny, tmp_path):
    tiny.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(tiny.schema).parquet(str(tmp_path / "in")).selectExpr("* EXCEPT (event_time)", "CAST(event_time AS TIMESTAMP) AS event_time")
    for name, plan in (("days", stream_daily_kpis(live)), ("visits", stream_sessions(live))):
        q = plan.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    days = {str(r.date): r.total_events for r in spark.table("days").collect()}
    assert days["2024-01-01"] == 3 and "2024-01-10" not in days
    assert spark.table("visits").count() >= 2
