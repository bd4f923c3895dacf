"""A corpus pipeline: toxic documents go, one of each group of near-copies stays, sources are mixed, and what is left is packed."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import bounded_batches, staged, table, tokenizer_path
from larkspur.llm.mixing import mix_sources
from larkspur.llm.ngramjoin import near_duplicates
from larkspur.llm.packing import pack_documents
from larkspur.llm.toxicity import fit, score_toxicity

_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _keeping_others(stage: Stage) -> Stage:
    """The stage with all columns of docs: those that documents doesn't have are renamed before it and named back after it, whatever their names."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        names = {c: c if c in _COLUMNS else f"other_{i}" for i, c in enumerate(docs.columns)}
        return stage(spark, docs.toDF(*names.values()), sf_dir).toDF(*names)

    return run


@_keeping_others
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic. The model learns from labelled documents of this stage's input.

    Null and empty texts have no hits and stay, as do rows with a null id; repeated rows share one fate. A table
    without labelled documents of both classes stays whole. An empty table gives no rows.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs.withColumnRenamed("doc_id", "own_id"), model, ("own_id", "text"), carry=tuple("own_id" if c == "doc_id" else c for c in docs.columns))
    return scored.filter("predicted = 0").drop("doc_id").withColumnRenamed("own_id", "doc_id").select(*docs.columns)


@_keeping_others
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each component stays, null last; rows without words are components of their own.

    Rows are told apart by a hash of id and text, as ids may be null or repeat. Of rows equal in both the one with the
    smallest language, source and length stays. Null and empty texts link with nothing; texts are compared whole. An
    empty table gives no rows.
    """
    keyed = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    found = staged(near_duplicates(keyed, ("row", "text")).filter("n_shingles > 0").groupBy(F.col("doc_id").alias("row")).agg(F.min("component_id").alias("component"), F.count("*").alias("times")), "components")
    ids = keyed.groupBy("row").agg(F.min("doc_id").alias("doc_id"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = found.join(ids, "row").groupBy("component").agg(F.min_by("row", order).alias("first"))
    told = found.join(first, "component").withColumn("stays", F.col("row") == F.col("first"))
    gone = staged(told.filter("NOT stays").select("row"), "near-copies")
    repeated = staged(told.filter("stays AND times > 1").select("row"), "repeats")
    # the rows that go are the fewer: broadcast while their file is small, else the join is shuffled
    kept = keyed.join(gone, "row", "left_anti")
    first = F.min_by(F.struct(*docs.columns), F.struct("lang", "source", "n_chars"))
    once = kept.join(repeated, "row", "left_semi").groupBy("row").agg(first.alias("own")).select("own.*")
    return kept.join(repeated, "row", "left_anti").select(*docs.columns).unionByName(once)


@_keeping_others
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it.

    Rows are told apart by a hash of the columns of documents; equal ones share their copies. Null and empty texts
    have no words, and each such row stays as often as the target has whole sources in it. Null sources are one
    source. An empty table gives no rows.
    """
    keyed = docs.withColumn("row", F.xxhash64(*(F.struct(F.col(c).isNull(), c) for c in _COLUMNS)))
    mix = mix_sources(keyed, columns=("row", "text", "source")).groupBy("doc_id").agg(F.sum("copies").alias("all"), F.count("*").alias("times"))
    copies = staged(mix.filter("all > 0").withColumnRenamed("doc_id", "row"), "copies")
    even = keyed.join(copies.filter("all % times = 0"), "row").withColumn("copies", F.expr("all DIV times"))
    nth = F.row_number().over(Window.partitionBy("row").orderBy("row"))
    odd = keyed.join(copies.filter("all % times > 0"), "row").withColumn("copies", F.expr("all DIV times") + (nth <= F.expr("all % times")).cast("long"))
    joined = even.unionByName(odd).filter("copies > 0")
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in its window.

    Null and empty texts are one piece, the closing id; every row is packed on its own, whatever its id. An empty
    table gives no rows. Columns but doc_id and text go.
    """
    bounded_batches(spark)
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("ngram_jaccard_join", ngram_jaccard_join), ("mixing", mixing), ("packing", packing)]

#: SQL expresses neither the learnt scores nor the packing; tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"stage-{name}")
    return docs
