"""Ranks over whole columns without a task for a whole column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramquarry.session import cut_lineage


def ranked(df: DataFrame, keys: tuple[str, ...], order: tuple[str | Column, ...], name: str = "term_index") -> DataFrame:
    """The rows with their rank from 1 by `order` within `keys`, neither of which is null.

    Ranges of (keys, order) are dealt out, so rows of one key spread over tasks; a rank is the row's number
    in its range and the counts of the key's earlier ranges.
    """
    part = f"__part_{name}"
    # the folder of the checkpoint keeps which range a row fell in
    dealt = cut_lineage(df.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()))
    held = dealt.groupBy(*keys, part).agg(F.count("*").alias("__held"))
    before = Window.partitionBy(*keys).orderBy(part)  # a row for each range
    base = held.select(*keys, part, (F.sum("__held").over(before) - F.col("__held")).alias("__base"))
    inside = dealt.withColumn("__inside", F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order)))
    return inside.join(base, [*keys, part]).withColumn(name, (F.col("__inside") + F.col("__base")).cast("int")).drop(part, "__inside", "__base")


def out_of_order(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The rows of a stored table that sort before the row ahead of them in their file."""
    placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    ahead = F.lag(F.struct(*order)).over(Window.partitionBy("__file").orderBy("__row"))
    return placed.withColumn("__ahead", ahead).where(F.col("__ahead") > F.struct(*order)).drop("__file", "__row", "__ahead")
