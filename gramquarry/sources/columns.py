"""Sources in long format: one row (doc_id, column, value BINARY) for each value of each logical column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramquarry.config import DEFAULT_COLUMN, MARKER, SUFFIXES, BytesMode
from gramquarry.functions.binary import to_bytes

FORMATS = ("parquet", "json", "csv", "text", "orc", "binaryFile")


def read(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> DataFrame:
    """A table from any of Spark's file formats."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    return spark.read.format(kind).options(**options).load(path)


def is_search_field(name: str | None) -> bool:
    """Whether a field takes part by its name alone."""
    return name is not None and name.endswith(SUFFIXES)


def search_fields(df: DataFrame) -> list[str]:
    return [c for c in df.columns if is_search_field(c)]


def marked_parts(text: Column) -> tuple[Column, Column]:
    """Column name and value of a marked text; without a whole marker the default column and the text itself."""
    pattern = f"(?s)^{MARKER}(.*?)@@(.*)$"
    marked = F.rlike(text, F.lit(pattern))
    return F.when(marked, F.regexp_extract(text, pattern, 1)).otherwise(F.when(text.isNotNull(), DEFAULT_COLUMN)), F.when(marked, F.regexp_extract(text, pattern, 2)).otherwise(text)


def from_columns(df: DataFrame, doc_id: str, columns: list[str], mode: BytesMode = BytesMode.UTF8) -> DataFrame:
    """Physical columns; those that are neither text nor binary are searched as their text. Nulls and empty values
    are left out: they have no windows."""
    kinds = dict(df.dtypes)
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), (F.col(c) if kinds[c] == "binary" else to_bytes(F.col(c).cast("string"), mode)).alias("value")) for c in columns))
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.explode(pairs).alias("x")).select("doc_id", "x.*").where("value is not null and octet_length(value) > 0")


def from_marked(df: DataFrame, doc_id: str, text: str, mode: BytesMode = BytesMode.UTF8) -> DataFrame:
    """Texts that carry their column as a marker."""
    name, value = marked_parts(F.col(text))
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), name.alias("column"), to_bytes(value, mode).alias("value")).where("value is not null and octet_length(value) > 0")


def from_json(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Every key of one-level JSON objects as a column, discovered from the rows."""
    entries = F.explode(F.from_json(text, "map<string,string>"))
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), entries.alias("column", "v")).select("doc_id", "column", F.col("v").cast("binary").alias("value")).where("value is not null and octet_length(value) > 0")


def union(sources: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)
