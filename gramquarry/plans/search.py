"""Search by scanning. Candidate mode returns the documents in which every slice of the pattern occurs; exact mode
those in which one value holds the whole pattern."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramquarry.config import BytesMode
from gramquarry.functions.binary import pattern_bytes, query_slices

MODES = ("candidate", "exact")


def holds(value: Column, part: bytes) -> Column:
    return F.contains(value, F.lit(bytearray(part)))


def text_holds(text: Column, part: bytes) -> Column:
    """Whether a text holds the bytes. Whole characters are compared as text, a filter that reaches the scan."""
    try:
        return F.contains(text, F.lit(part.decode()))
    except UnicodeDecodeError:
        return holds(text.cast("binary"), part)


def candidate(value: Column, pattern: bytes, has: Callable[[Column, bytes], Column] = holds) -> Column:
    """Whether the value holds every slice; an empty pattern has none and matches nothing."""
    slices = query_slices(pattern)
    return reduce(and_, (has(value, s) for s in slices)) if slices else F.lit(False)


def exact(value: Column, pattern: bytes, has: Callable[[Column, bytes], Column] = holds) -> Column:
    """Whether the value holds the whole pattern, and so every slice."""
    return has(value, pattern) if pattern else F.lit(False)


def any_of(value: Column, patterns: list[bytes], mode: str = "exact") -> Column:
    """Whether the value matches one of the patterns."""
    test = {"exact": exact, "candidate": candidate}[mode]
    return reduce(or_, (test(value, p) for p in patterns)) if patterns else F.lit(False)


def match(df: DataFrame, column: str, pattern: str | bytes, *, mode: str = "candidate", bytes_mode: BytesMode = BytesMode.UTF8) -> DataFrame:
    """Rows of a table with one value per row: one filter, no shuffle. On text columns the filter reaches the scan as
    far as slices are whole characters."""
    test = {"exact": exact, "candidate": candidate}[mode]
    if dict(df.dtypes)[column] == "string":
        return df.where(test(F.col(column), pattern_bytes(pattern, bytes_mode), text_holds))
    return df.where(test(F.col(column).cast("binary"), pattern_bytes(pattern, bytes_mode)))


def scan_search(source: DataFrame, column: str, pattern: str | bytes, *, mode: str = "candidate", bytes_mode: BytesMode = BytesMode.UTF8) -> DataFrame:
    """Distinct doc_id of a long-format source. The slices of a candidate may lie in different values of a document, so
    one flag for each slice is combined per document; values without any slice never reach the shuffle."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    q = pattern_bytes(pattern, bytes_mode)
    slices = query_slices(q)
    rows = source.where(F.col("column") == column)
    if not slices or len(slices) == 1 or mode == "exact":
        return rows.where(exact(F.col("value"), q) if mode == "exact" else candidate(F.col("value"), q)).select("doc_id").distinct()
    flags = [holds(F.col("value"), s).alias(f"s{i}") for i, s in enumerate(slices)]
    some = rows.select("doc_id", *flags).where(reduce(or_, (F.col(f"s{i}") for i in range(len(slices)))))
    every = some.groupBy("doc_id").agg(*(F.bool_or(f"s{i}").alias(f"s{i}") for i in range(len(slices))))
    return every.where(reduce(and_, (F.col(f"s{i}") for i in range(len(slices))))).select("doc_id")
