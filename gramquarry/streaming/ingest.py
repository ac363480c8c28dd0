"""Streams into index versions: micro-batches wait until they fill a version, and versions are merged by compaction."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gramquarry.config import OVER_RATE, Level, block_complete
from gramquarry.operators import mining
from gramquarry.plans.index import FpIndex
from gramquarry.plans.search import scan_search

PENDING = "doc_id long, column string, value binary, b long"


@dataclass
class VersionedIndex:
    """Index versions below one path, and the batches that wait for the next.

    A batch is stored under its number, so a replayed one overwrites itself. A version is built from all waiting batches and has the
    last one's number; it counts once its line in `versions` is written, and the batches up to its number no longer wait.
    A version is due when a column of what waits is full at the top level, or after `most_batches`, or on finish().
    """

    spark: SparkSession
    path: str
    most_batches: int = 64

    def versions(self) -> list[int]:
        """Numbers of the whole versions: a short list, one for many batches."""
        lines = self._read("versions", "size long, v long")
        return sorted(r.v for r in lines.select("v").distinct().collect()) if lines is not None else []

    def _read(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def pending(self) -> DataFrame | None:
        """(doc_id, column, value, b) of the batches that wait."""
        rows = self._read("pending", PENDING)
        return rows if rows is None else rows.where(F.col("b") > max(self.versions(), default=-1))

    def add(self, source: DataFrame, number: int, **options) -> bool:
        """Store a batch; whether that made a version."""
        source.select("doc_id", "column", "value").write.mode("overwrite").parquet(f"{self.path}/pending/b={number}")
        return self.due() and self.flush(**options)

    def due(self) -> bool:
        rows = self.pending()
        batches = rows.select("b").distinct().count()
        if batches >= self.most_batches:
            return True
        held = mining.terms(rows).groupBy("column").agg(F.count_distinct("term").alias("terms"), F.count_distinct("doc_id").alias("docs"))
        return not held.where(block_complete(F.lit(OVER_RATE[Level.TOP]), F.lit(int(Level.TOP)), F.col("docs"), F.col("terms"))).isEmpty()

    def flush(self, **options) -> bool:
        """A version of all that waits; False where nothing does."""
        rows = self.pending()
        last = None if rows is None else rows.agg(F.max("b")).first()[0]
        if last is None:
            return False
        FpIndex.build(rows.where(F.col("b") <= last).select("doc_id", "column", "value"), **options).write(f"{self.path}/index/v={last:012d}")
        self.spark.range(1).select(F.lit(rows.count()).alias("size")).write.mode("overwrite").parquet(f"{self.path}/versions/v={last}")
        return True

    finish = flush

    def open(self) -> list[FpIndex]:
        return [FpIndex.read(self.spark, f"{self.path}/index/v={v:012d}") for v in self.versions()]

    def search(self, column: str, pattern: str | bytes, **options) -> DataFrame:
        """doc_id over all versions, and by scanning what waits. A document lies in one of them."""
        found = [index.search(column, pattern, **options) for index in self.open()]
        waiting = self.pending()
        if waiting is not None:
            found.append(scan_search(waiting.drop("b"), column, pattern, **{k: v for k, v in options.items() if k in ("mode", "bytes_mode")}))
        if not found:
            return self.spark.createDataFrame([], "doc_id long")
        return reduce(DataFrame.union, found).distinct()

    def compact(self, target: str, deleted: DataFrame | None = None, **options) -> FpIndex:
        """All versions as one at another path, without the deleted documents; full groups pass through."""
        FpIndex.merge(self.open(), deleted=deleted, **options).write(target)
        return FpIndex.read(self.spark, target)

    def ingest(self, stream: DataFrame, checkpoint: str, to_source: Callable[[DataFrame], DataFrame], **options) -> StreamingQuery:
        """Index a stream: to_source turns a micro-batch into (doc_id, column, value)."""

        def one(batch: DataFrame, number: int) -> None:
            if not batch.isEmpty():
                self.add(to_source(batch), number, **options)

        return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
