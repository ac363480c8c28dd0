"""Terms, postings, and the mining of hot grams.

A gram is hot in a group if at least a threshold of the group's distinct terms contain it; a term's documents
go to each of its hot grams that lies in no longer hot gram of that term. Everything works on distinct
(term, gram) rows, before documents are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramquarry.config import HIT_BAND, HIT_TIERS, NGRAM_MAX
from gramquarry.functions.binary import bucket, grams, index_windows
from gramquarry.operators.ordering import ranked

#: No hits sort after all others.
LAST = 2147483647


def terms(source: DataFrame) -> DataFrame:
    """Distinct (column, term, doc_id) of the index windows."""
    return source.select("doc_id", "column", F.explode(index_windows(F.col("value"))).alias("w")).select("column", F.col("w.term").alias("term"), "doc_id").distinct()


def postings(term_docs: DataFrame, key: tuple[str, ...] = ("column", "term")) -> DataFrame:
    """Sorted distinct documents of each term as an array; for keys whose documents fit a row."""
    return term_docs.groupBy(*key).agg(F.array_sort(F.collect_set("doc_id")).alias("docs"))


def gram_rows(term_table: DataFrame, keys: tuple[str, ...] = ("column", "group_id")) -> DataFrame:
    """Distinct (keys, term, gram), deduplicated in the row before any shuffle."""
    return term_table.select(*keys, "term", F.explode(F.array_distinct(grams(F.col("term")))).alias("gram"))


def document_frequency(rows: DataFrame, keys: tuple[str, ...] = ("column", "group_id")) -> DataFrame:
    """How many terms contain each gram."""
    return rows.groupBy(*keys, "gram").agg(F.count("*").alias("df"))


def hot_grams(rows: DataFrame, threshold: Column | int, keys: tuple[str, ...] = ("column", "group_id")) -> DataFrame:
    """(keys, gram, df) of the grams at or above the threshold; a threshold column must be a key."""
    return document_frequency(rows, keys).where(F.col("df") >= threshold)


def hot_occurrences(rows: DataFrame, hot: DataFrame, keys: tuple[str, ...] = ("column", "group_id")) -> DataFrame:
    """(keys, term, gram) of hot grams."""
    return rows.join(hot.select(*keys, "gram"), [*keys, "gram"], "left_semi").select(*keys, "term", "gram")


def maximal(occurrences: DataFrame, keys: tuple[str, ...] = ("column", "group_id")) -> DataFrame:
    """The hot occurrences that lie in no longer hot gram of their term.

    All grams inside a hot one are hot, so a gram lies in a longer one iff it lies in one longer by a byte: the grams without
    their first or last byte are what is not maximal. A term is a window of few bytes, so its grams fit a row.
    """
    of_term = occurrences.groupBy(*keys, "term").agg(F.collect_set("gram").alias("grams"))
    shorter = lambda g: F.array(F.substring(g, F.lit(1), F.octet_length(g) - 1), F.substring(g, F.lit(2), F.octet_length(g) - 1))
    covered = F.flatten(F.transform(F.filter("grams", lambda g: F.octet_length(g) > 1), shorter))
    return of_term.select(*keys, "term", F.explode(F.array_except("grams", covered)).alias("gram"))


def numbered(df: DataFrame, keys: tuple[str, ...], order: tuple[Column | str, ...], bounded: bool) -> DataFrame:
    """Rows numbered from 1 within the keys; bounded keys have few enough rows for a task each."""
    if not bounded:
        return ranked(df, keys, order)
    return df.withColumn("term_index", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def ordinals(hot: DataFrame, keys: tuple[str, ...] = ("column", "group_id"), *, bounded: bool = True) -> DataFrame:
    """Hot grams numbered from 1 by length, then bytes."""
    return numbered(hot, keys, (F.octet_length("gram"), "gram"), bounded)


def hit_counts(term_table: DataFrame, maximal_rows: DataFrame, keys: tuple[str, ...] = ("column", "group_id")) -> DataFrame:
    """How many hot grams took each term's documents."""
    hits = maximal_rows.groupBy(*keys, "term").agg(F.count("*").alias("hits"))
    return term_table.join(hits, [*keys, "term"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def flush_ranks(counted: DataFrame, keys: tuple[str, ...] = ("column", "group_id"), *, bounded: bool = True) -> DataFrame:
    """Common terms numbered from 1 by their hits, those without hits last, ties by bytes."""
    return numbered(counted, keys, (F.when(F.col("hits") == 0, LAST).otherwise(F.col("hits")), "term"), bounded)


def hit_tier(hits: Column) -> Column:
    """Band of a hit count: 0 for none, else 50 to a band, 16 at most."""
    return F.when(hits <= 0, 0).otherwise(F.least(F.floor((hits - 1) / HIT_BAND) + 1, F.lit(HIT_TIERS))).cast("int")


def residual_grams(rows: DataFrame, hot: DataFrame, keys: tuple[str, ...] = ("column", "group_id")) -> DataFrame:
    """(keys, term, gram) of the grams that aren't hot."""
    return rows.join(hot.select(*keys, "gram"), [*keys, "gram"], "left_anti").select(*keys, "term", "gram")


def budget(gram: Column) -> Column:
    """How much longer than an anchor a hot payload may be; nothing longer than the gram itself anchors it."""
    return F.lit(NGRAM_MAX + 1) - F.octet_length(gram)


def bucket_orders(numbered: DataFrame, keys: tuple[str, ...] = ("column", "group_id")) -> DataFrame:
    """(keys, len_idx, bucket, orders) of (keys, gram, term_index): the sorted ordinals in each bucket."""
    placed = numbered.select(*keys, (F.octet_length("gram") - 1).alias("len_idx"), bucket(F.col("gram")).alias("bucket"), "term_index")
    return placed.groupBy(*keys, "len_idx", "bucket").agg(F.array_sort(F.collect_set("term_index")).alias("orders"))


def packed_groups(term_table: DataFrame, cap: int) -> DataFrame:
    """Terms cut into groups of `cap` in byte order within their column.

    The index deals groups by hash instead, which needs no order over a whole column.
    """
    return ranked(term_table, ("column",), ("term",)).withColumn("group_id", F.floor((F.col("term_index") - 1) / cap).cast("int")).drop("term_index")


def key_changes(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Rows with `changed` where a sorted stream's key differs from the row before; per first key. A row begins a
    key iff none of the key sorts before it, so whole keys are grouped and no first key is one task."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first"))
    return df.join(first, list(keys)).withColumn("changed", F.struct(*order) == F.col("__first")).drop("__first")


def union_docs(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def difference_docs(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def intersect_docs(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def retag(term_tables: list[DataFrame]) -> DataFrame:
    """Several term tables as one, each with its place in the list as index_id."""
    tagged = [t.withColumn("index_id", F.lit(i)) for i, t in enumerate(term_tables)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out


def merged(term_tables: list[DataFrame], key: str = "term") -> DataFrame:
    """(key, rank, index_id): an ordered merge of several sorted tables. rank counts the distinct keys in byte order from
    1, and the rows of a key come in the order of their tables."""
    rows = retag([t.select(key).distinct() for t in term_tables])
    keys = ranked(rows.select(key).distinct().withColumn("__all", F.lit(0)), ("__all",), (key,), "rank").drop("__all")
    return rows.join(keys, key)


def posting_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, doc_id, in_a, in_b) of two postings given as rows, from which union (all), difference (in_a and not in_b)
    and intersection (both) are filters; no key's documents ever meet in one row."""
    rows = a.select(*keys, "doc_id", F.lit(True).alias("in_a"), F.lit(False).alias("in_b")).unionByName(b.select(*keys, "doc_id", F.lit(False).alias("in_a"), F.lit(True).alias("in_b")))
    return rows.groupBy(*keys, "doc_id").agg(F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b"))
