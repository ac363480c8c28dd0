"""MinHash near-duplicates with circulant signatures.

Two permutations make a whole signature: sigma spreads a document's shingles over a circle of D
places, and coordinate k is the least pi at the places shifted by k. Because neighbouring coordinates
read neighbouring places, the K coordinates of one shingle are one contiguous run of pi, and a
signature is the minimum over such runs. Signatures are cut into bands; documents that share a band
are candidates; every link is confirmed by the exact Jaccard similarity of the full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramquarry.llm.common import BROADCAST_ROWS, cut_lineage, mix64, texts
from gramquarry.llm.components import connected_components, local_components

#: Places on the circle; collisions there only add candidates, which are verified.
D = 1 << 20
#: Rows of a bucket that go to one task in a join by buckets.
SHARE = 512
SIGNATURES = "doc_id long, n_shingles long, fp binary, bands array<long>"


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """B^j and B^-j modulo 2^64 for an odd B."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, dtype=np.uint64)]).astype(np.uint64), dtype=np.uint64) for b in (base, inverse))


@cache
def _circle(k: int, seed: int) -> tuple[np.ndarray, np.uint64]:
    """pi as a table continued by k places past its end, and what sigma multiplies by."""
    pi = np.random.default_rng(seed).permutation(D).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: k - 1]]), k), np.uint64(0xD6E8FEB86659FD93 ^ (seed << 1))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of the text, A-Z lower-cased, in order: a polynomial over the UTF-8
    bytes from prefix sums, finalised together with the word's length."""
    data = np.frombuffer(text.encode().lower(), dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = 1 << max(12, int(len(data) + 1).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix64((sums[end] - sums[start]) * down[start] + mix64((end - start).astype(np.uint64)))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; with fewer words, of the whole sequence."""
    w = word_hashes(text)
    n = min(width, len(w))
    if not n:
        return w
    h = np.full(len(w) - n + 1, np.uint64(n), dtype=np.uint64)
    for i in range(n):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def signature(shingles: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """The k circulant coordinates of a non-empty shingle set; memory is bounded for any text."""
    runs, factor = _circle(k, seed)
    places = (mix64(shingles ^ factor) >> np.uint64(44)).astype(np.int64)
    least = np.full(k, D, dtype=np.uint32)
    for at in range(0, len(places), 2048):
        np.minimum(least, runs[places[at : at + 2048]].min(axis=0), out=least)
    return least


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` coordinates; the band's number is part of the key."""
    parts = sig.astype(np.uint64).reshape(-1, rows)
    h = np.arange(len(parts), dtype=np.uint64)
    for i in range(rows):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, i])
    return h.view(np.int64)


def signatures(docs: DataFrame, *, width: int, bands: int, rows: int) -> DataFrame:
    """SIGNATURES columns of (doc_id, text): set size, fingerprint of the full set, band keys (null for no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in texts(batch.column(1)):
                sizes, prints, keys = [], [], []
                for t in some:
                    s = shingle_set(t, width)
                    sizes.append(len(s))
                    prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    keys.append(band_keys(signature(s, bands * rows), rows) if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "fp", "bands"])
                at += len(some)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SIGNATURES)


def shingle_sets(docs: DataFrame, *, width: int) -> DataFrame:
    """(doc, words): the full shingle set as sorted little-endian 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in texts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), pa.array([shingle_set(t, width).tobytes() for t in some], pa.binary())], names=["doc", "words"])
                at += len(some)

    return docs.select("doc_id", "text").mapInArrow(run, "doc long, words binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            ok = [similar(np.frombuffer(x[i].as_py(), "<u8"), np.frombuffer(y[i].as_py(), "<u8"), percent) for i in range(len(batch))]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    x = sets.select(F.col("doc").alias("a"), F.col("words").alias("words_a"))
    y = sets.select(F.col("doc").alias("b"), F.col("words").alias("words_b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "words_a", "words_b").mapInArrow(run, "a long, b long")


def _residual(df: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between rows of different components in one pair of blocks, enough of them to join what is linked."""
    df = df.drop_duplicates("node", ignore_index=True)
    sets = [np.frombuffer(w, "<u8") for w in df.words]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, local = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(df)), sizes)
    common = np.bincount(local, minlength=len(values)) > 1
    local, row = local[common[local]], row[common[local]]
    number = np.cumsum(common) - 1
    local = number[local]
    both = np.zeros((len(df), len(df)), dtype=np.float32)
    order = np.argsort(local, kind="stable")
    local, row, step = local[order], row[order], 4096
    cuts = np.searchsorted(local, np.arange(0, int(common.sum()) + step, step))
    for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        m = np.zeros((len(df), step), dtype=np.float32)
        m[row[lo:hi], local[lo:hi] - i * step] = 1
        both += m @ m.T
    both = both.astype(np.int64)
    comp = np.unique(df.component, return_inverse=True)[1]
    linked = (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) & (comp[:, None] < comp[None, :])
    x, y = np.nonzero(linked)
    ends = np.unique(np.column_stack([comp[x], comp[y]]), axis=0, return_index=True)[1] if len(x) else np.zeros(0, dtype=np.int64)
    x, y = x[ends], y[ends]
    root = local_components(int(comp.max()) + 1 if len(comp) else 0, comp[x], comp[y])
    first = pd.Series(df.node.to_numpy()).groupby(comp).min().to_numpy()
    at = np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"a": first[at], "b": first[root[at]]})


def _spread(by_key: DataFrame) -> DataFrame:
    """One row for each share of a bucket, to be joined by (key, share)."""
    return by_key.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")


def _members(nodes: DataFrame, bands: Column) -> DataFrame:
    """(key, share, shares, n, low, node, size) of all buckets with several nodes.

    A large bucket is cut into shares of about SHARE nodes, so that no task gets a whole one in the joins by key.
    The large ones are looked up by a broadcast of at most BROADCAST_ROWS rows; were there more, buckets are
    joined whole, and left to the adaptive splitting of skewed joins.
    """
    rows = cut_lineage(nodes.select("node", "size", F.explode(bands).alias("key")).distinct())
    buckets = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low")).where("n > 1")
    buckets = cut_lineage(buckets.withColumn("shares", F.ceil(F.col("n") / SHARE)))
    large = buckets.where("shares > 1").select("key", "shares")
    if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(large), "key", "left").withColumn("share", F.pmod(F.xxhash64("node"), F.coalesce("shares", F.lit(1)))).drop("shares")
    else:
        buckets, rows = buckets.withColumn("shares", F.lit(1).cast("long")), rows.withColumn("share", F.lit(0).cast("long"))
    each = buckets.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    return rows.join(each, ["key", "share"])


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, small: int = 6, block: int = 512, block_shingles: int = 1 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document of (doc_id, text).

    Documents with equal shingle sets are one node. Nodes sharing a band are candidates: all pairs of
    a bucket of at most `small` nodes, and in larger ones each node with the bucket's least; each
    distinct pair is verified once. Larger buckets that still hold several components are then compared
    exactly in blocks (only across components), so no link is lost to the stars. Blocks have about `block` nodes
    and `block_shingles` shingles at most, or a single larger set.

    Null and empty texts and texts without words have no shingles and are linked with nothing. Rows of
    one doc_id are one document for links and give a row each. A null doc_id is never linked: its
    component_id is null and it is kept. An empty table gives no rows; other columns are ignored. Of
    a component only its smallest doc_id is kept.
    """
    sig = cut_lineage(signatures(docs, width=width, bands=bands, rows=rows))
    known = sig.where("doc_id is not null and fp is not null")
    classes = known.groupBy("fp").agg(F.min("doc_id").alias("node"))
    nodes = known.withColumnRenamed("doc_id", "node").withColumnRenamed("n_shingles", "size").join(classes, ["fp", "node"], "left_semi")
    members = cut_lineage(_members(nodes, F.col("bands")))
    few = members.where(F.col("n") <= small).groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("all"))
    few = few.select(F.posexplode("all").alias("i", "a"), "all").select("a", F.explode(F.slice("all", F.col("i") + 2, small)).alias("b"))
    stars = members.where((F.col("n") > small) & (F.col("node") != F.col("low"))).select(F.col("low").alias("a"), F.col("node").alias("b"))
    pairs = cut_lineage(few.union(stars).distinct())
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    sets = cut_lineage(shingle_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi"), width=width))
    links = cut_lineage(verified(pairs, sets, percent))
    found = connected_components(links)

    large = members.where(F.col("n") > small).join(found, "node", "left").select("key", "share", "shares", "node", "size", F.coalesce("component", "node").alias("component"))
    large = cut_lineage(large)
    # a bucket's core is the component of its least node; pairs inside the core are settled
    core = large.groupBy("key", "shares").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "node").alias("core")).where("low != high")
    large = large.join(_spread(core.select("key", "shares", "core")), ["key", "share"]).withColumn("rest", F.col("component") != F.col("core"))
    blocks = lambda part: F.greatest(F.ceil(F.sum(part.cast("long")) / block), F.ceil(F.sum(F.when(part, F.col("size")).otherwise(0)) / block_shingles))
    count = large.groupBy("key", "shares").agg(blocks(F.col("rest")).alias("rests"), blocks(~F.col("rest")).alias("cores"))
    large = large.join(_spread(count), ["key", "share"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("cores"))))
    # block pairs: rest blocks with each other and with every core block
    of_rest = F.concat(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1), lambda j: F.struct(F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j"))),
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("cores") - 1), lambda j: F.struct(F.col("mine").alias("i"), (-1 - j).alias("j"))),
    )
    of_core = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1), lambda i: F.struct(i.alias("i"), (-1 - F.col("mine")).alias("j")))
    dealt = large.select("key", "node", "component", F.explode(F.array_distinct(F.when(F.col("rest"), of_rest).otherwise(of_core))).alias("p"))
    dealt = dealt.join(sets.withColumnRenamed("doc", "node"), "node").select("key", "p.i", "p.j", "node", "component", "words")
    more = dealt.groupBy("key", "i", "j").applyInPandas(lambda df: _residual(df, percent), "a long, b long")
    more = cut_lineage(more.distinct())
    if not more.isEmpty():
        found = connected_components(links.union(more))

    by_class = classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("in_component"))
    out = sig.select("doc_id", "n_shingles", "fp").join(by_class, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("in_component", "doc_id"), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
