"""A corpus pipeline over `documents`: quality, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return
the columns of the documents that they were given. Only doc_id, text and source are read by the stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramquarry.llm.common import cut_lineage, table, unused
from gramquarry.llm.minhash import near_duplicates
from gramquarry.llm.mixing import mix, words_in
from gramquarry.llm.packing import pack_documents
from gramquarry.llm.pii import sanitise
from gramquarry.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the weakly supervised scorer accepts. A null or empty text scores by the bias."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest doc_id (5 words, 0.8).

    Rows with a null doc_id and texts without words are in no group and stay; rows that repeat a doc_id
    stay or go together.
    """
    gone = near_duplicates(docs, width=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data and disclosing terms replaced; n_chars, where there is one, follows the
    text. Texts without either are unchanged."""
    clean = sanitise(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: its taken words over its size, to the nearest whole number (up to 3).

    Documents that the mix doesn't take, and texts without words, go. Rows with a null doc_id or
    repeating one are taken by the average of their id.
    """
    copies, of, copy = unused(docs, "__copies", "__of", "__copy")
    taken = mix(docs).where("taken > 0").groupBy(F.col("doc_id").alias(of)).agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias(copies)).where(F.col(copies) > 0)
    both = docs.where(words_in(F.col("text")) > 0).join(taken.hint("merge"), F.col("doc_id").eqNullSafe(F.col(of)))  # as long as the documents: never broadcast
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 2048 ids."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tokens=2048, end_id=1, special={"<|endoftext|>": 50256})


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]

#: The classifier is trained and ids come from a vocabulary; SQL cannot express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage keeps is cut off in the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
