"""The queries over the training-data operators, with production parameters and the columns of their contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gramquarry.llm import licenses
from gramquarry.llm.common import table


#: The tokenizer file's special tokens, which the ranks file leaves out.
SPECIAL = {"<|endoftext|>": 50256}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gramquarry.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op2_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gramquarry.llm.secret_scan import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gramquarry.llm.gif import payload_media

    return payload_media(table(spark, sf_dir, "documents"))


def op4_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gramquarry.llm.quotes import conversations

    return conversations(table(spark, sf_dir, "conversations"))


def op5_disclosing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gramquarry.llm.pii import personal_spans

    return personal_spans(table(spark, sf_dir, "documents"))


def op6_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gramquarry.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op7_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gramquarry.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)


def op8_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gramquarry.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, tokens=2048, end_id=1, special=SPECIAL)


def op10_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gramquarry.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_projection_forest, op2_token_efficiency, op3_gif_media, op4_quotation_links, op5_disclosing_terms, op6_circulant_minhash, op7_low_discrepancy_mix, op8_sentence_rules, op9_vector_packing, op10_weak_labels)}
ORACLES: dict[str, str] = {"op8_sentence_rules": licenses.oracle()}
