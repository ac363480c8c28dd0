"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramquarry.session import cut_lineage

__all__ = ["WORD", "cut_lineage", "mix64", "small_side", "table", "texts", "unused"]

#: Rows of a table with a few numbers in each that a broadcast may hold.
BROADCAST_ROWS = 50_000

#: What the contracts call a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with underscores until no column of the table has it, for columns beside the table's own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table, to be broadcast if it is counted to have few rows; larger ones are left to the planner. Stored tables have
    no size that the planner knows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def texts(column: pa.Array, slice_rows: int = 512) -> Iterator[list[str]]:
    """A text column as lists of at most slice_rows strings, null as the empty string."""
    for at in range(0, len(column), slice_rows):
        yield [t or "" for t in column.slice(at, slice_rows).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix constants): a bijection that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
