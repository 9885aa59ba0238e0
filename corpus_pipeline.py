"""A training corpus out of ``documents``: each stage works on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ldlake.llm import jaccard, language, packing, suffixes
from ldlake.llm.common import fresh_dir, remove, table
from ldlake.llm.queries import mix_documents, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text, or no letter) go; others stay as they are."""
    got = language.identify(docs, language.fit(docs), keep=COLUMNS)
    return got.where("lang_pred != 'und'").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that links join (shingles of five words, 0.8 or more), the one with the smallest doc_id stays; rows without words stay."""
    return jaccard.one_of_each(docs).select(*COLUMNS)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what an earlier document has; n_chars follows. What is left with white space only goes."""
    got = suffixes.repeats(docs, keep_text=True, carry=("lang", "source"))
    left = got.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"\S"))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, by the target weights, in one epoch."""
    return mix_documents(docs, 0.8, 1).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", remove_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, suffix order and tokens can't be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again; a result goes when its successor is there."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        at = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if last:
            remove(spark, last)
        last = at
    # the last stage's pieces are a checkpoint, but what it returns may be read from its input too, so that stays
    return STAGES[-1][1](spark, docs, sf_dir)
