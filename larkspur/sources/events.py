"""Reading, narrowing and writing event logs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.plans.staging import discard, held, staged, staged_path
from larkspur.sources.schema import RAW, RAW_TIME

#: The partition column of a log by days.
DAY = "event_date"


def read_events_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Raw CSV files with a header, stacked."""
    return spark.read.schema(RAW).csv([paths] if isinstance(paths, str) else list(paths), header=True)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def optimize_events(raw: DataFrame) -> DataFrame:
    """Parses the time and narrows the types; values that don't fit raise, as ANSI casts do."""
    return raw.select(
        F.to_timestamp_ntz("event_time", F.lit(RAW_TIME)).alias("event_time"), "event_type", F.col("product_id").cast("int"), F.col("category_id").cast("long"),
        "category_code", "brand", F.col("price").cast("float"), F.col("user_id").cast("int"), "user_session",
    )


def split_rejects(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that optimize_events() accepts, and those it would raise on."""
    good = (F.try_to_timestamp("event_time", F.lit(RAW_TIME)).isNotNull() | F.isnull("event_time")) & F.coalesce(F.expr("try_cast(product_id AS INT) IS NOT NULL OR product_id IS NULL"), F.lit(False)) & F.coalesce(F.expr("try_cast(user_id AS INT) IS NOT NULL OR user_id IS NULL"), F.lit(False))
    good = F.coalesce(good, F.lit(False))
    return raw.filter(good), raw.filter(~good)


def write_events(df: DataFrame, path: str, level: int = 3, row_group_bytes: int = 128 << 20, rows_per_file: int = 0) -> None:
    """Zstandard Parquet; rows_per_file bounds the files if it isn't 0."""
    writer = df.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).option("parquet.block.size", row_group_bytes)
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


def write_chunks(df: DataFrame, path: str, rows: int = 10_000_000, level: int = 10) -> None:
    """Files of `rows` rows at most."""
    write_events(df, path, level, rows_per_file=rows)


def write_slices(df: DataFrame, path: str, rows: int = 10_000_000, level: int = 10) -> None:
    """Folders slice=0, 1, ..., each one file of exactly `rows` rows, the last of what is left, in the order of df's rows.

    df is written once and read back, so that its partitions and the order in them are fixed. Counting the partitions
    tells every row's place in the whole; each slice then meets in one task, as it is one file.
    """
    df = staged(df, "slices")
    placed = df.withColumn("_place", F.monotonically_increasing_id())  # the partition's number above 33 bits, the row's below
    part = F.shiftrightunsigned("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    # a row a partition
    starts = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_start"))
    at = F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_at", at).withColumn("slice", F.expr(f"_at DIV {rows}"))
    ordered = numbered.repartition("slice").sortWithinPartitions("slice", "_at").select(*df.columns, "slice")
    ordered.write.mode("overwrite").partitionBy("slice").option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    discard(df)


def write_by_day(df: DataFrame, path: str, time: str = "event_time", unit: str = "day") -> None:
    """A log in folders by day (or `week`, `month`, `year`), of which only those that df has rows for are replaced; loading a day again changes nothing else.

    Spark deals the rows so that a day's rows share files and a day with very many has several. Rows within a task are in
    order of time, so row groups cover short spans; rows without a time go to a folder of their own.
    """
    days = df.withColumn(DAY, F.to_date(F.date_trunc(unit, time))).hint("rebalance", DAY).sortWithinPartitions(DAY, time)
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(DAY).parquet(path)


def read_days(spark: SparkSession, path: str, start: str | datetime, end: str | datetime, time: str = "event_time", unit: str = "day") -> DataFrame:
    """The rows from start until before end. Whole days (or units) are left out by their folders, and row groups of the others by their spans."""
    lo, hi = (F.lit(x).cast("timestamp") for x in (start, end))
    days = spark.read.parquet(path).filter((F.col(DAY) >= F.to_date(F.date_trunc(unit, lo))) & (F.col(DAY) <= F.to_date(hi)))
    kind = dict(days.dtypes)[time]
    return days.filter((F.col(time) >= lo.cast(kind)) & (F.col(time) < hi.cast(kind)))


def write_keyed(df: DataFrame, path: str, keys: Sequence[str], row_group_bytes: int = 16 << 20, distinct: int = 1 << 16) -> None:
    """Parquet with a Bloom filter for each key in every row group, so that a lookup of few values reads few row groups.

    distinct: values a row group may have; it sizes the filters.
    """
    writer = df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", row_group_bytes)
    for k in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true").option(f"parquet.bloom.filter.expected.ndv#{k}", distinct)
    writer.parquet(path)


def file_report(spark: SparkSession, path: str) -> DataFrame:
    """file_name, bytes, rows and codec of every Parquet file below path.

    Rows are counted by the reader from the footers, as no column is asked for; sizes come with the listing, the codec
    from the name that Spark gave the file. A task gives its files in different folders the same name, so a file is told by
    its whole path. Empty files of a write have no row here.
    """
    files = spark.read.option("recursiveFileLookup", "true").parquet(path).select("_metadata.file_path", "_metadata.file_name", "_metadata.file_size")
    counts = files.groupBy("file_path", "file_name", F.col("file_size").alias("bytes")).agg(F.count("*").alias("rows"))
    return counts.select("file_name", "bytes", "rows", F.regexp_extract("file_name", r"\.([a-z0-9]+)\.parquet$", 1).alias("codec"))


def write_tables(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes each table into its own folder; table_name, rows, with the rows counted by the plan that writes them."""
    rows = []
    for name, df in tables.items():
        seen = Observation()
        write_events(df.observe(seen, F.count(F.lit(1)).alias("rows")), f"{folder}/{name}")
        rows.append((name, seen.get["rows"]))
    return SparkSession.active().createDataFrame(rows, "table_name string, rows long")


def size_report(spark: SparkSession, before: str, after: str) -> DataFrame:
    """One row: bytes before and after, and the percentage saved; only file listings are read."""

    def total(path: str, name: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return files.agg(F.sum("length").alias(name))

    both = total(before, "bytes_before").crossJoin(F.broadcast(total(after, "bytes_after")))
    return both.withColumn("saved_pct", F.round(100 * (1 - F.col("bytes_after") / F.nullif("bytes_before", F.lit(0))), 1))


def load_for_analysis(df: DataFrame, fraction: float = 0.1) -> DataFrame:
    """All events of one user in int(1 / fraction), by remainder."""
    return df.filter(F.col("user_id") % F.lit(int(1 / fraction)) == 0)


def ingest_events(df: DataFrame, name: str, path: str = "") -> None:
    """Replaces the table with the events in ranges of event_time, sorted within files, so that time filters skip files; with `path`, its files are there."""
    writer = df.repartitionByRange("event_time").sortWithinPartitions("event_time").write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def check_load(spark: SparkSession, name: str, preview: int = 3) -> tuple[int, DataFrame]:
    """Row count of a table and a few of its rows."""
    t = spark.table(name)
    return t.count(), t.limit(preview)


def save_table(df: DataFrame, name: str, by: str = "", buckets: int = 0, path: str = "") -> None:
    """Create-or-replace of a derived table; with `by`, dealt to buckets by that column and sorted in them, so that tables saved alike join without a shuffle.

    With `path`, its files are there.
    """
    writer = df.write.mode("overwrite")
    writer = writer.option("path", path) if path else writer
    (writer.bucketBy(buckets, by).sortBy(by) if by else writer).saveAsTable(name)


def bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """df written in buckets by a column and read back. Joins and groups by it with tables of as many buckets need no exchange.

    The rows are dealt by the column first, so every bucket is one file. The catalog knows the table only while it is
    read in; its files go as those of staged() do.
    """
    spark, path = df.sparkSession, staged_path(df.sparkSession, f"by-{by}")
    name = "by_" + path.rpartition("-")[2]
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(name)
    read = held(spark.table(name), path)
    spark.sql(f"DROP TABLE {name}")
    return read


def column_statistics(df: DataFrame) -> DataFrame:
    """column_name, rows, nulls, least, greatest, approx_distinct of every column, as text, from one pass that combines in the scanning tasks.

    Doubles and times are shown as Spark casts them; arrays, maps and structs have no least and greatest value.
    """
    plain = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary"))]

    def of(c: str) -> Column:
        col = F.col(f"`{c}`")
        ends = (F.min(col).cast("string"), F.max(col).cast("string")) if c in plain else (F.lit(None).cast("string"),) * 2
        distinct = F.approx_count_distinct(col) if c in plain else F.lit(None).cast("long")
        return F.struct(F.lit(c).alias("column_name"), F.count("*").alias("rows"), F.count_if(col.isNull()).alias("nulls"), ends[0].alias("least"), ends[1].alias("greatest"), distinct.alias("approx_distinct"))

    return df.agg(F.array(*map(of, df.columns)).alias("columns")).select(F.inline("columns"))


def describe_tables(spark: SparkSession, pattern: str = "*") -> DataFrame:
    """table_name, column_name, data_type of every table and view in the current database whose name fits the pattern, from the catalog alone."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables(pattern=pattern) for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def table_sizes(spark: SparkSession, pattern: str = "*") -> DataFrame:
    """table_name, rows, bytes of every table in the current database whose name fits the pattern, by ANALYZE TABLE; views have no size and are left out."""
    rows = []
    for t in spark.catalog.listTables(pattern=pattern):
        if t.tableType in ("MANAGED", "EXTERNAL"):
            spark.sql(f"ANALYZE TABLE `{t.name}` COMPUTE STATISTICS")
            stats = spark.sql(f"DESCRIBE EXTENDED `{t.name}`").filter("col_name = 'Statistics'").select("data_type").first()
            found = dict(reversed(x.split(" ", 1)) for x in stats.data_type.split(", "))  # such as: 1234 bytes, 10 rows
            rows.append((t.name, int(found["rows"]), int(found["bytes"])))
    return spark.createDataFrame(rows, "table_name string, rows long, bytes long")
