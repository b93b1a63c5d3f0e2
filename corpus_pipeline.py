"""From raw documents to packed training sequences: quality, repetition, line chunks, near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Rows of a repeated id are told apart by a hash of their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import jaccard, line_chunks, packing, quality, repetition
from pageloom.llm.queries import documents, tokenizer
from pageloom.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# The end mark's id in the packed sequences.
END_ID = 0
LONGEST = 1024


def told_apart(docs: DataFrame) -> DataFrame:
    """``docs`` with the key by which the operators' verdicts come back: id and hash of the text."""
    return docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))


def keep(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows that ``verdicts`` (doc_id, text_hash) name."""
    docs = told_apart(docs).alias("d")
    chosen = verdicts.select("doc_id", "text_hash").alias("v")
    same = F.col("d.doc_id").eqNullSafe(F.col("v.doc_id")) & (F.col("d.text_hash") == F.col("v.text_hash"))
    return docs.join(chosen, same, "left_semi").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    scored = quality.score(docs, model, keep=COLUMNS)
    return scored.filter(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.judge(docs, keep=COLUMNS).filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the line chunks that an earlier one has."""
    cleaned = line_chunks.dedupe(docs, keep=["lang", "source"])
    return cleaned.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates; of rows that repeat id and text, one."""
    first = jaccard.classes(docs).filter("is_first").select("doc_id", "text_hash")
    once = keep(docs, first)
    repeated = first.groupBy("doc_id", "text_hash").count().filter("count > 1")
    # Rows repeated whole are rare: only they are gathered to be reduced to one.
    again = stage(keep(once, repeated), "repeated")
    if again.isEmpty():
        return once
    told = told_apart(once).alias("d").join(repeated.alias("v"), F.col("d.doc_id").eqNullSafe(F.col("v.doc_id")) & (F.col("d.text_hash") == F.col("v.text_hash")), "left_anti")
    return told.select(*COLUMNS).unionByName(told_apart(again).dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two sequences of token ids, one row per piece."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), END_ID, LONGEST)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("packing", pack_sequences),
]
# The classifier and the tokenizer have no SQL; tests/llm/test_pipeline.py compares each stage's rows with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
