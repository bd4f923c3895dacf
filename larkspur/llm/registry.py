"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import twins
from larkspur.llm.align import align_tokens
from larkspur.llm.centroids import cluster_vectors
from larkspur.llm.chat import digest_examples, expand_replies
from larkspur.llm.common import table, tokenizer_path
from larkspur.llm.html import extract_main_text
from larkspur.llm.imatch import fingerprint_edits
from larkspur.llm.mixing import mix_sources
from larkspur.llm.ngramjoin import near_duplicates
from larkspur.llm.packing import pack_documents
from larkspur.llm.prefixbpe import encode_texts
from larkspur.llm.tokencount import count_tokens
from larkspur.llm.toxicity import fit, score_toxicity
from larkspur.llm.vectors import nearest_neighbours
from larkspur.llm.warc import archive_round_trip


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are the template's own control strings."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], told.schema)
    return digest_examples(expand_replies(told.unionByName(extra)))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive_round_trip(table(spark, sf_dir, "pages"))
    return read.filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = encode_texts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return read.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings")).drop("compared")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_main_text, op2_packing, op3_chat, op4_token_counts, op5_posting_lists, op6_toxicity, op7_imatch, op8_ngram_jaccard, op9_warc, op10_mixing, op11_token_alignment, op12_prefix_bpe, op13_centroids)}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": twins.CHAT, "op8_ngram_jaccard": twins.NGRAM, "op9_warc": twins.WARC, "op13_centroids": twins.CENTROIDS}
