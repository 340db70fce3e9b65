"""A corpus from documents to packed sequences, in five stages over whole tables.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again as the next
one's docs. A doc_id stays a key throughout where it is one. Each stage takes an empty table and gives an empty one, keeps
null texts but for what is said below, and keeps rows that repeat a doc_id, or have none, apart by their text. ORACLE_SQL is None: classifier, edit join, shingle join and tokenizer are
beyond SQL; tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm.common import Scratch
from netlens.llm.linededup import dedup_lines
from netlens.llm.mixing import mixed_texts
from netlens.llm.ngram_join import keep_first
from netlens.llm.packing import pack
from netlens.llm.toxicity import keep_clean, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted severity says toxic go; the model is fitted on a bounded sample of labels. Null texts are
    clean and stay; repeated rows are judged each and alike; without labels nothing goes."""
    return keep_clean(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen before go; so do documents of which nothing is left. Null texts and texts without such lines stay as they
    are; rows that repeat doc_id and text lose the same lines; a null doc_id comes after all others."""
    rows = dedup_lines(docs).where("_gone = 0 or length(trim(text)) > 0")
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_gone") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more; the one of the smallest
    (doc_id, hash of the text), null ids last. Null texts and texts without words are nobody's copies and stay, once for
    each (doc_id, text)."""
    return keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; repetitions stand in the text. A null source is one of its own; documents of which
    the mix takes no word go, and with them null texts; repeated rows are documents each."""
    return mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows: one row per piece of a document. Null texts are one end id; repeated rows are packed each."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = s.cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return s.finish(STAGES[-1][1](spark, docs, sf_dir))
