"""A corpus pipeline of five stages, each one an operator of ``ostinato.llm`` over all that its predecessor kept.

All stages but the last take and return the columns of ``documents`` in COLUMNS; other columns, whatever their names, are not read and not
kept. A missing one of COLUMNS is an error. Empty tables give empty tables, and very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm import mixing, packing, simhash, substring, toxicity
from ostinato.llm.common import scratch_path, table
from ostinato.llm.queries import held_out, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now is."""
    return df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more for toxicity go; the rest stay as they are.

    Labels teach from rows outside the held-out ones. Null and empty texts score the prior and stay if it is under 0.3. Repeated rows are scored each, alike. Null ids have
    no label and are scored like others. Without labels, or without toxic ones, every document stays.
    """
    index = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score(docs, index).where("predicted = 0").select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash links stays: the one with the smallest id, a null id being the largest.

    Null and empty texts have the fingerprint zero and are one group. Of repeated ids the least text hash stays, of equal rows one.
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 35 words or more that occur more than once go; documents stay, also with an empty text.

    Every occurrence of such a passage goes, also within one document and in repeated rows. Null texts stay null, with n_chars 0.
    """
    return _documents(substring.without_repeats(docs, length=35))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source as often as its target needs: documents repeat, and one in each source ends where the budget does.

    Documents without words, null texts among them, aren't taken. Null is a source of its own. Ties of the random order go by id and size.
    """
    return _documents(mixing.mixed_documents(docs, weights=[5.0, 2.0, 1.0], share=1.0, most=3.0))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of at most 2048 tokens.

    Null and empty texts are an end id; repeated rows and null ids are packed each.
    """
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048)


STAGES = [("toxicity", without_toxic), ("simhash near-dedup", without_near_copies), ("substring dedup", without_repeated_passages), ("mixing to target weights", mixed), ("best-fit packing", packed)]

#: Learned scores, XXH64 fingerprints and tokenizers aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + "".join(c if c.isalnum() else "-" for c in name))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
