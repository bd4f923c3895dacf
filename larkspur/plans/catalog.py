"""The registered queries over the driver's tables and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators import affinity, experiment, features, funnel, propensity, report, retention, rfm, sampling, star
from larkspur.functions.scalars import format_compact, format_usd
from larkspur.plans.staging import held, remove, staged_path
from larkspur.plans.star import register_views, run_query
from larkspur.plans.twins import SQL
from larkspur.sources.adapters import clickstream, retail
from larkspur.sources.events import bucketed, check_load, column_statistics, describe_tables, file_report, ingest_events, load_for_analysis, optimize_events, read_days, read_events, read_events_csv, save_table, table_sizes, write_by_day, write_chunks, write_events, write_keyed, write_slices, write_tables
from larkspur.sources.schema import RAW_TIME

#: The day that recency and churn count from where a variant wants one given.
AS_OF = "2001-08-01"
CUTOFF = "2001-02-01"
#: The weeks of retention_matrix, as its SQL has them; retention_matrix_all has every week.
WEEKS = range(0, 12)
#: What events_by_day reads, the rows of a slice, and the buckets of saved tables.
SPAN, SLICE, BUCKETS = ("1995-11-05 00:00:00", "1996-03-01 00:00:00"), 7000, 16
#: Pairs are rare in the driver's baskets.
SUPPORT = 2

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles to a few places: sums of doubles depend on their order."""
    return df.select(*(F.round(F.col(f"`{c}`").cast("double"), places).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes))


def _segmented(events: DataFrame) -> DataFrame:
    return rfm.rfm_segments(rfm.rfm_base(events))


def _features(events: DataFrame) -> DataFrame:
    return features.feature_table(star.dim_users(events), _segmented(events), features.session_features(star.sessions(events)))


def _rules(events: DataFrame) -> DataFrame:
    return affinity.affinity_rules(events, SUPPORT)


def _experiment(events: DataFrame) -> DataFrame:
    """Users split by remainder, which both engines know; converted if they bought anything."""
    users = star.dim_users(events)
    return users.select("user_id", F.when(F.col("user_id") % 2 == 0, "control").otherwise("treatment").alias("variant"), F.col("purchase_count").__gt__(12).cast("int").alias("converted"))


def _scored(events: DataFrame) -> DataFrame:
    """A fixed score of recency and activity, to measure."""
    frame = propensity.propensity_frame(events, CUTOFF)
    return frame.select("user_id", "target", (F.col("events") / (1.0 + F.col("recency_days"))).alias("score"))


def _propensity_scores(events: DataFrame) -> DataFrame:
    frame = propensity.propensity_frame(events, CUTOFF)
    fit, test = propensity.stratified_split(frame)
    return propensity.score(propensity.train(fit), test)


def _evaluation(events: DataFrame) -> DataFrame:
    """Precision, recall and lift of the model's top scores, and its ROC-AUC."""
    scored = _propensity_scores(events)
    return propensity.top_share_metrics(scored).withColumn("roc_auc", F.lit(propensity.roc_auc(scored)))


def _roc_auc(events: DataFrame) -> DataFrame:
    """ROC-AUC of the fixed score."""
    return events.sparkSession.range(1).select(F.lit(propensity.roc_auc(_scored(events))).alias("roc_auc"))


def _split(events: DataFrame) -> DataFrame:
    """Every user of the frame with its class and its side of the split."""
    sides = propensity.stratified_split(propensity.propensity_frame(events, CUTOFF))
    return sides[0].select("user_id", "target", F.lit("train").alias("side")).unionByName(sides[1].select("user_id", "target", F.lit("test").alias("side")))


def _through_csv(events: DataFrame) -> DataFrame:
    """The log written as raw CSV in two parts, read together, narrowed, written as Parquet and read back."""
    spark, raw, narrow = events.sparkSession, staged_path(events.sparkSession, "raw"), staged_path(events.sparkSession, "narrow")
    text = events.withColumn("event_time", F.date_format("event_time", RAW_TIME))
    for side in (0, 1):
        text.filter(F.col("user_id") % 2 == side).write.option("header", True).csv(f"{raw}/{side}")
    write_events(optimize_events(read_events_csv(spark, [f"{raw}/0", f"{raw}/1"])), narrow)
    remove(spark, raw)
    return held(read_events(spark, narrow), narrow)


def _through_chunks(events: DataFrame) -> DataFrame:
    """The log written in files of a bounded number of rows, and read back."""
    path = staged_path(events.sparkSession, "chunks")
    write_chunks(events, path)
    return held(read_events(events.sparkSession, path), path)


def _curves(events: DataFrame) -> DataFrame:
    """Every cohort's cells as text: weeks since and thousandths, in order."""
    curves = retention.retention_curves(retention.weekly_retention(events, star.dim_users(events)))
    cells = F.transform(F.map_entries("rates"), lambda e: F.concat_ws(":", e.key.cast("string"), F.round(e.value * 1000).cast("long").cast("string")))
    return curves.select("cohort_week", "cohort_size", F.size("rates").cast("long").alias("weeks"), F.array_join(cells, " ").alias("rates"))


def _by_day(events: DataFrame) -> DataFrame:
    """The log written by months, one year of it written again, and a span of it read back by folders."""
    spark, path = events.sparkSession, staged_path(events.sparkSession, "days")
    write_by_day(events, path, unit="month")
    write_by_day(events.filter((F.col("event_time") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("event_time") < F.lit("1997-01-01").cast("timestamp"))), path, unit="month")
    return held(read_days(spark, path, *SPAN, unit="month"), path).select("event_time", "product_id", "price", "user_id", "user_session")


def _slices(events: DataFrame) -> DataFrame:
    """Rows of the files that the log's slices are, largest first."""
    path = staged_path(events.sparkSession, "exact")
    write_slices(events, path, SLICE)
    files = held(file_report(events.sparkSession, path), path)
    return files.select("rows", "codec", F.row_number().over(Window.orderBy(F.desc("rows"))).alias("nth"))  # a row a file


def _looked_up(events: DataFrame) -> DataFrame:
    """The lines of one brand and a few products, from files with Bloom filters for both."""
    path = staged_path(events.sparkSession, "keyed")
    write_keyed(events, path, ("product_id", "brand"))
    return held(read_events(events.sparkSession, path), path).filter("product_id IN (7, 77, 177) OR brand = 'Brand#23' AND price > 50000")


def _bucketed_features(events: DataFrame) -> DataFrame:
    """The feature table from users, segments and behaviour saved in buckets by user."""
    parts = star.dim_users(events), _segmented(events), features.session_features(star.sessions(events))
    return features.feature_table(*(bucketed(p, "user_id", BUCKETS) for p in parts))


def _columns(events: DataFrame) -> DataFrame:
    """Rows and nulls of every column, and the ends of those that both engines show alike."""
    alike = F.col("column_name").isin("event_type", "product_id", "brand", "user_id", "user_session")
    found = column_statistics(events)
    return found.select("column_name", "rows", "nulls", *(F.when(alike, F.col(c)).alias(c) for c in ("least", "greatest")))


def _written(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of tables, taken while these are written."""
    spark = SparkSession.active()
    folder = staged_path(spark, "tables")
    counts = write_tables(tables, folder)
    remove(spark, folder)
    return counts


def _ingested(events: DataFrame) -> DataFrame:
    """What the check after a load tells: rows of the table, rows of the preview, columns."""
    spark, path, name = events.sparkSession, staged_path(events.sparkSession, "ingest"), f"ingested_{uuid.uuid4().hex}"
    ingest_events(events, name, path)
    rows, few = check_load(spark, name)
    few = held(few, path)
    spark.sql(f"DROP TABLE {name}")
    return few.agg(F.count("*").alias("preview_rows")).select(F.lit(rows).cast("long").alias("table_rows"), "preview_rows", F.lit(len(few.columns)).cast("long").alias("columns"))


def _saved(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables saved in the catalog, as it describes them: rows, columns, and whether they take room."""
    spark, mark, folder = SparkSession.active(), f"_{uuid.uuid4().hex}", staged_path(SparkSession.active(), "saved")
    for name, df in tables.items():
        save_table(df, name + mark, path=f"{folder}/{name}")
    columns = describe_tables(spark, f"*{mark}").groupBy("table_name").agg(F.count("*").alias("columns"))
    found = table_sizes(spark, f"*{mark}").join(columns, "table_name")
    for name in tables:
        spark.sql(f"DROP TABLE {name}{mark}")
    remove(spark, folder)
    return found.select(F.replace("table_name", F.lit(mark), F.lit("")).alias("table_name"), "rows", "columns", (F.col("bytes") > 0).alias("has_bytes"))


def _exported(events: DataFrame) -> DataFrame:
    """The sample of users written as Parquet and read back."""
    path = staged_path(events.sparkSession, "sample")
    write_events(sampling.stratified_user_sample(events, 20.0, by=("user_session", "product_id")), path)
    return held(read_events(events.sparkSession, path), path)


def _model_kept(events: DataFrame) -> DataFrame:
    """The test users, and whether the saved and reloaded model scores each as the model itself did."""
    spark, path = events.sparkSession, staged_path(events.sparkSession, "model")
    fit, test = propensity.stratified_split(propensity.propensity_frame(events, CUTOFF))
    model = propensity.train(fit)
    propensity.save_model(model, path)
    again = propensity.load_model(path)
    remove(spark, path)
    both = propensity.score(model, test).join(propensity.score(again, test).select("user_id", F.col("score").alias("again")), "user_id")
    return both.select("user_id", "target", F.col("score").eqNullSafe(F.col("again")).alias("same_score"))


def _view_sql(events: DataFrame) -> DataFrame:
    """SQL with a parameter over two of the star's views."""
    register_views({"larkspur_days": star.daily_kpis(events), "larkspur_products": star.dim_products(events)})
    return run_query(events.sparkSession, "SELECT date, dau, total_purchases, (SELECT count(*) FROM larkspur_products) AS products FROM larkspur_days WHERE dau >= :least", least=2)


def _shown_totals(events: DataFrame) -> DataFrame:
    """Daily figures as text for display."""
    days = star.daily_kpis(events)
    return days.select("date", format_compact("daily_revenue").alias("revenue_compact"), format_usd("daily_revenue").alias("revenue_usd"), format_compact("total_events").alias("events_compact"))


def _importance(events: DataFrame) -> DataFrame:
    fit, _ = propensity.stratified_split(propensity.propensity_frame(events, CUTOFF))
    return propensity.feature_importance(propensity.train(fit))


#: Name -> the log it reads and what it computes.
_PLANS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], Callable[[DataFrame], DataFrame]]] = {
    "dim_products_f": (retail, star.dim_products),
    "dim_products_c": (clickstream, lambda e: star.dim_products(e, drop_null_key=True)),
    "dim_users_f": (clickstream, star.dim_users),
    "dim_users_c": (retail, lambda e: star.dim_users(e, "c")),
    "favorite_category": (clickstream, star.favorite_category),
    "daily_kpis_f": (retail, star.daily_kpis),
    "daily_kpis_c": (clickstream, lambda e: star.daily_kpis(e, "c")),
    "sessions_f": (clickstream, star.sessions),
    "sessions_c": (clickstream, star.compact_sessions),
    "rfm_f": (retail, _segmented),
    "rfm_c": (retail, lambda e: rfm.rfm_segments(rfm.rfm_base(e, "c", AS_OF), "c")),
    "rfm_base": (retail, rfm.rfm_base),
    "affinity_f": (retail, _rules),
    "affinity_c": (retail, lambda e: affinity.affinity_rules(e, SUPPORT, "c")),
    "affinity_nofilter": (retail, lambda e: affinity.affinity_rules(e, SUPPORT, "c", None)),
    "session_funnel": (clickstream, lambda e: funnel.session_funnel(star.sessions(e))),
    "session_stats": (clickstream, lambda e: funnel.session_stats(star.sessions(e))),
    "session_features": (clickstream, lambda e: features.session_features(star.sessions(e))),
    "feature_table": (clickstream, _features),
    "segment_profile": (retail, lambda e: rfm.segment_profile(_segmented(e))),
    "segment_coverage": (clickstream, lambda e: rfm.segment_coverage(_features(e))),
    "rfm_scatter_sample": (retail, lambda e: rfm.rfm_scatter_sample(_segmented(e), 500)),
    "weekly_retention": (retail, lambda e: retention.weekly_retention(e, star.dim_users(e))),
    "retention_matrix": (retail, lambda e: retention.retention_matrix(retention.weekly_retention(e, star.dim_users(e)), WEEKS)),
    "retention_matrix_all": (retail, _curves),
    "churn_status": (retail, lambda e: retention.churn_status(star.dim_users(e), e, AS_OF)),
    "churn_counts": (retail, lambda e: retention.churn_counts(retention.churn_status(star.dim_users(e), e))),
    "baskets": (clickstream, affinity.baskets),
    "product_pairs": (retail, lambda e: affinity.product_pairs(affinity.baskets(e), SUPPORT)),
    "product_support": (retail, lambda e: affinity.product_support(affinity.baskets(e))),
    "total_purchase_sessions": (clickstream, affinity.total_purchase_sessions),
    "top_pairs_preview": (retail, lambda e: affinity.top_pairs_preview(_rules(e), star.dim_products(e))),
    "brands_with_rules": (retail, lambda e: affinity.brands_with_rules(_rules(e), star.dim_products(e))),
    "products_with_rules": (retail, lambda e: affinity.products_with_rules(_rules(e), star.dim_products(e), "Brand#11")),
    "recommend_topk": (retail, lambda e: affinity.recommend_all(_rules(e), 6)),
    "recommend_named": (retail, lambda e: affinity.recommend_all(_rules(e), 6, star.dim_products(e))),
    "dataset_overview": (clickstream, report.dataset_overview),
    "event_mix": (clickstream, report.event_mix),
    "event_funnel": (clickstream, funnel.event_funnel),
    "distinct_session_funnel": (clickstream, funnel.distinct_session_funnel),
    "daily_trend": (clickstream, report.daily_trend),
    "daily_trend_stats": (clickstream, report.daily_trend_stats),
    "price_percentiles": (retail, report.price_percentiles),
    "price_bands": (clickstream, report.price_bands),
    "top_categories": (clickstream, report.top_categories),
    "top_brands": (clickstream, report.top_brands),
    "category_performance": (retail, report.category_performance),
    "brand_performance": (clickstream, lambda e: report.brand_performance(report.product_summary(e))),
    "activity_histogram": (clickstream, lambda e: report.activity_histogram(star.dim_users(e))),
    "user_stats": (retail, lambda e: report.user_stats(star.dim_users(e))),
    "user_engagement": (clickstream, lambda e: report.user_engagement(report.user_summary(e))),
    "buyer_tiers": (clickstream, lambda e: report.buyer_tiers(report.user_summary(e))),
    "product_stats": (clickstream, lambda e: report.product_stats(report.product_summary(e))),
    "top_products": (clickstream, report.top_products),
    "daily_aggregates": (clickstream, lambda e: report.daily_aggregates(report.daily_summary(e))),
    "null_profile": (clickstream, report.null_profile),
    "profile": (retail, report.profile),
    "events_per_session": (clickstream, report.events_per_session),
    "session_characteristics": (clickstream, lambda e: funnel.session_characteristics(star.sessions(e))),
    "session_conversion": (clickstream, lambda e: funnel.session_conversion(star.sessions(e))),
    "key_metrics": (clickstream, lambda e: report.key_metrics(report.user_summary(e))),
    "executive_kpis": (clickstream, lambda e: report.executive_kpis(star.daily_kpis(e, "c"))),
    "sanity_totals": (clickstream, lambda e: report.sanity_totals(star.daily_kpis(e), star.dim_users(e))),
    "row_counts": (clickstream, lambda e: _written({"dim_products": star.dim_products(e), "dim_users": star.dim_users(e), "fact_daily_kpis": star.daily_kpis(e), "fact_sessions": star.sessions(e)})),
    "product_summary": (clickstream, report.product_summary),
    "user_summary": (clickstream, report.user_summary),
    "daily_summary": (clickstream, report.daily_summary),
    "summary_row_counts": (clickstream, lambda e: _written({"product_summary": report.product_summary(e), "user_summary": report.user_summary(e), "daily_summary": report.daily_summary(e)})),
    "user_modulo_sample": (clickstream, lambda e: load_for_analysis(e, 0.1)),
    "events_through_csv": (clickstream, _through_csv),
    "events_through_chunks": (clickstream, _through_chunks),
    "events_by_day": (retail, _by_day),
    "events_slices": (retail, _slices),
    "events_lookup": (retail, _looked_up),
    "feature_table_bucketed": (clickstream, _bucketed_features),
    "column_statistics": (retail, _columns),
    "ingest_check": (retail, _ingested),
    "saved_tables": (clickstream, lambda e: _saved({"dim_products": star.dim_products(e), "dim_users": star.dim_users(e), "fact_daily_kpis": star.daily_kpis(e), "fact_sessions": star.sessions(e)})),
    "sample_export": (retail, _exported),
    "saved_model": (retail, _model_kept),
    "view_sql": (retail, _view_sql),
    "formatted_totals": (retail, _shown_totals),
    "stratified_sample": (retail, lambda e: sampling.stratified_user_sample(e, 20.0, by=("user_session", "product_id"))),
    "stratified_users": (retail, lambda e: sampling.stratified_users(e, 3.0)),
    "compare_mix": (clickstream, lambda e: sampling.compare_mix(e, e.filter(F.col("user_id") % 10 == 0))),
    "temporal_coverage": (clickstream, sampling.temporal_coverage),
    "segment_population": (clickstream, lambda e: experiment.segment_population(_features(e), "Champions")),
    "variant_assignment": (clickstream, lambda e: experiment.assign_variants(star.dim_users(e).select("user_id"), "checkout")),
    "variant_summary": (clickstream, lambda e: experiment.variant_summary(_experiment(e))),
    "ab_statistics": (clickstream, lambda e: experiment.ab_statistics(_experiment(e))),
    "ab_readout": (clickstream, lambda e: experiment.ab_readout(_experiment(e))),
    "propensity_frame": (retail, lambda e: propensity.propensity_frame(e, CUTOFF)),
    "class_balance": (retail, lambda e: propensity.class_balance(propensity.propensity_frame(e, CUTOFF))),
    "topk_precision_recall": (retail, lambda e: propensity.top_share_metrics(_scored(e))),
    "roc_auc": (retail, _roc_auc),
    "split_by_class": (retail, _split),
    "propensity_scores": (retail, _propensity_scores),
    "propensity_evaluation": (retail, _evaluation),
    "feature_importance": (retail, _importance),
}


def _query(name: str) -> Query:
    log, plan = _PLANS[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(plan(log(spark, sf_dir)))

    query.__name__ = name
    return query


def queries() -> dict[str, Query]:
    return {name: _query(name) for name in _PLANS}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
