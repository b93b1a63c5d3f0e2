"""The registered queries of this folder: thin, with production parameters, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import bpe, imatch, jaccard, licenses, line_chunks, mixing, negatives, packing, quality, repetition, token_files, url_filter, whitening
from pageloom.llm.sql import HARD_NEGATIVES, URL_FILTER

URL_RULES = (
    url_filter.Rule("allow", "org"), url_filter.Rule("block", "example.org", "/es/"), url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"), url_filter.Rule("block", "com", "/de/"),
)
# Every address that pages are stored under at these hosts and their subdomains is on the list.
SPAM_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.dedupe(documents(spark, sf_dir))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compared(documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    manifest = token_files.write_tokens(documents(spark, sf_dir), folder, tokenizer("byte_bpe_50k.json"), end_id=2)
    return token_files.read_tokens(manifest, folder)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scores(documents(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=0, longest=1024)


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(documents(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = url_filter.lower_ascii(F.regexp_extract(url_filter.after_scheme(F.col("url")), "^[^/?#]*", 0))
    listed = pages.filter(reduce(Column.__or__, ((host == name) | host.endswith(f".{name}") for name in SPAM_HOSTS)))
    return url_filter.judge(pages, listed, URL_RULES)


QUERIES = {f.__name__: f for f in (
    op1_bpe, op2_jaccard, op3_quality, op4_line_chunks, op5_imatch, op6_token_files, op7_mixing, op8_licenses, op9_packing, op10_repetition,
    op11_whitening, op12_negatives, op13_url_filter,
)}
ORACLES = {"op12_negatives": HARD_NEGATIVES, "op13_url_filter": URL_FILTER}
