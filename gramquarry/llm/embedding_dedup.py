"""Near-duplicate vectors with a random-projection tree forest.

Every tree splits the vectors recursively by random directions at the median; vectors near a split go
to both sides (spill), so close pairs seldom part. Pairs are compared within leaves in double
precision, counted in the first leaf they share, and united into components.

The upper levels' thresholds come from a bounded sample of the table on the driver. Leaves that hold too many
vectors are split further by trees of their own, fitted on the executors to a bounded sample of each leaf, until they
are small; so leaves stay bounded at any size of the table. All samples are thinned to vectors that are no near-duplicates of
each other, lest medians fall into a dense group and part it. A leaf that holds such a group can't be split and is compared
exactly, block pair by block pair: as many comparisons as the group has links. The number of trees follows
from the depth, so that a pair at the threshold is missed with probability `miss`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramquarry.llm.common import cut_lineage, small_side
from gramquarry.llm.components import connected_components, local_components

#: Share of pairs at cosine 0.9 that one split with 5 % spill leaves together, for directions that are as spread as random ones.
STAY = 0.935
#: Sampled rows of a leaf that is split further, and rounds of that at most.
LEAF_SAMPLE, ROUNDS = 512, 12


def raw(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of a binary column of vectors of one length, without copying."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tree:
    """Nodes are heap numbers (children 2i + 1, 2i + 2); bounds has those that split, as the upper end of
    what goes left and the lower end of what goes right. name makes its directions and leaves its own."""

    def __init__(self, name: str, dim: int, bounds: dict[int, tuple[float, float]]):
        self.name, self.dim, self.bounds = name, dim, bounds
        self.known: dict[int, np.ndarray] = {}

    def __getstate__(self) -> tuple:
        return self.name, self.dim, self.bounds

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def direction(self, node: int) -> np.ndarray:
        if node not in self.known:
            seed = int.from_bytes(hashlib.blake2b(f"{self.name}/{node}".encode(), digest_size=8).digest(), "big")
            self.known[node] = np.random.default_rng(seed).standard_normal(self.dim).astype(np.float32)
        return self.known[node]

    def leaf(self, node: int) -> int:
        """A leaf's code. Leaves that share one by chance are compared together, which loses nothing."""
        return int.from_bytes(hashlib.blake2b(f"{self.name}:{self.dim}:{node}".encode(), digest_size=4).digest(), "big", signed=True)

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, codes) of all leaves that the rows of x reach."""
        todo, rows, codes = [(0, np.arange(len(x)))], [], []
        while todo:
            node, some = todo.pop()
            if node not in self.bounds:
                rows.append(some)
                codes.append(np.full(len(some), self.leaf(node), dtype=np.int32))
                continue
            high, low = self.bounds[node]
            p = x[some] @ self.direction(node)
            for child, side in ((2 * node + 1, p <= high), (2 * node + 2, p >= low)):
                if side.any():
                    todo.append((child, some[side]))
        return np.concatenate(rows), np.concatenate(codes)

    def packed(self) -> bytes:
        nodes = sorted(self.bounds)
        return np.array([[n, *self.bounds[n]] for n in nodes], dtype=np.float64).tobytes()

    @staticmethod
    def unpacked(name: str, dim: int, data: bytes) -> Tree:
        return Tree(name, dim, {int(n): (high, low) for n, high, low in np.frombuffer(data, dtype=np.float64).reshape(-1, 3)})


def grow(x: np.ndarray, name: str, leaf: float, spill: float, depth: int = 40) -> Tree:
    """A tree over the sample x whose leaves have about `leaf` sample rows at most."""
    tree = Tree(name, x.shape[1], {})
    x = x.astype(np.float32)
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, level = todo.pop()
        if len(rows) <= leaf or level >= depth:
            continue
        p = x[rows] @ tree.direction(node)
        low, high = np.quantile(p, [0.5 - spill, 0.5 + spill])
        left, right = rows[p <= high], rows[p >= low]
        if max(len(left), len(right)) == len(rows):  # nothing parts them
            continue
        tree.bounds[node] = (float(high), float(low))
        todo += [(2 * node + 1, left, level + 1), (2 * node + 2, right, level + 1)]
    return tree


def thinned(x: np.ndarray, cosine: float, step: int = 1000) -> np.ndarray:
    """The rows of x without those that are near an earlier one: of a dense group, few stay."""
    x = x.astype(np.float32)
    kept = x[:0]
    for at in range(0, len(x), step):
        part = x[at : at + step]
        part = part[~(part @ kept.T >= cosine).any(axis=1)]
        kept = np.concatenate([kept, part[~np.tril(part @ part.T >= cosine, -1).any(axis=1)]])
    return kept


def trees_for(total: int, leaf_rows: int, miss: float) -> int:
    """How many trees: a pair at the threshold shares a leaf of one with probability STAY^depth."""
    together = STAY ** max(0.0, math.log2(max(1, total) / leaf_rows))
    return max(3, math.ceil(math.log(miss) / math.log(1 - min(together, 0.95))))


@cache
def _above(n: int) -> np.ndarray:
    return np.triu(np.ones((n, n), dtype=bool), 1)


def near_pairs(x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) with a < b of the rows of x (unit length, double) with a cosine of at least `cosine`. Single precision
    with a margin finds candidates; doubles decide."""
    single = x.astype(np.float32)
    s = (single @ single.T >= cosine - 1e-4) & _above(len(x))
    a, b = np.nonzero(s)
    if len(a) > 8 * len(x):
        return np.nonzero(s & (x @ x.T >= cosine))
    good = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
    return a[good], b[good]


def compare(part: pa.RecordBatch, kind: str, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cls, links, root) of the vectors of a leaf, or of a pair of its blocks: links first found here, and a vector of
    their local component; those without either are left out."""
    x = unit(raw(part.column("vector"), kind))
    i, j, leaf = (part.column(c)[0].as_py() for c in ("i", "j", "leaf"))
    a, b = near_pairs(x, cosine)
    own = part.column("mine").to_numpy()
    if i != j:
        apart = own[a] != own[b]
        a, b = a[apart], b[apart]
    if not len(a):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    root = local_components(len(x), a, b)
    # a pair counts in the least leaf that both have
    codes = part.column("codes")
    sizes = np.diff(codes.offsets.to_numpy())
    full = np.full((len(x), sizes.max()), np.iinfo(np.int32).max, dtype=np.int32)
    full[np.repeat(np.arange(len(x)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = codes.flatten().to_numpy()
    first = np.zeros(len(a), dtype=bool)
    for at in range(0, len(a), 4096):
        p, q = full[a[at : at + 4096]], full[b[at : at + 4096]]
        first[at : at + 4096] = ~((p[:, :, None] == q[:, None, :]) & (p < leaf)[:, :, None]).any(axis=(1, 2))
    a, b = a[first], b[first]
    copies = part.column("copies").to_numpy()
    links = np.bincount(a, weights=copies[b], minlength=len(x)) + np.bincount(b, weights=copies[a], minlength=len(x))
    some = (links > 0) | (root != np.arange(len(x)))
    cls = part.column("cls").to_numpy()
    return cls[some], links[some].astype(np.int64), cls[root[some]]


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The groups of a stream that is sorted by integer keys; a group is in memory as a whole."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    whole = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        if not len(batch):
            continue
        columns = np.column_stack([batch.column(k).to_numpy() for k in keys])
        edges = np.flatnonzero((columns[1:] != columns[:-1]).any(axis=1)) + 1
        starts = [0, *edges.tolist(), len(batch)]
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(columns[s].tolist())
            if held and key != last:
                yield whole()
                held = []
            held.append(batch.slice(s, e - s))
            last = key
    if held:
        yield whole()


def _split_further(routed: DataFrame, kind: str, *, limit: int, leaf_rows: int, spill: float, cosine: float) -> DataFrame:
    """routed with the leaves of more than `limit` vectors replaced by those of trees of their own, as long as they part."""

    def fit(df: pd.DataFrame) -> pd.DataFrame:
        few = thinned(unit(np.frombuffer(b"".join(df.vector), dtype=kind).reshape(len(df), -1)), cosine)
        leaf, n = int(df["leaf"].iloc[0]), int(df["n"].iloc[0])
        tree = grow(few, str(leaf), max(16, leaf_rows * len(df) / n), spill)
        return pd.DataFrame({"leaf": [leaf], "dim": [few.shape[1]], "tree": [tree.packed() if tree.bounds else None]})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, Tree] = {}
        for batch in batches:
            leaves = batch.column("leaf").to_numpy()
            for leaf in np.unique(leaves).tolist():
                at = np.flatnonzero(leaves == leaf)
                some = batch.take(pa.array(at))
                if leaf not in trees:
                    if len(trees) > 256:
                        trees.clear()
                    trees[leaf] = Tree.unpacked(str(leaf), some.column("dim")[0].as_py(), some.column("tree")[0].as_py())
                rows, codes = trees[leaf].route(unit(raw(some.column("vector"), kind)).astype(np.float32))
                yield pa.RecordBatch.from_arrays([some.column("cls").take(pa.array(rows)), pa.array(np.full(len(rows), leaf, dtype=np.int32)), pa.array(codes)], names=["cls", "leaf", "code"])

    stuck = None
    for _ in range(ROUNDS):
        over = routed.select(F.explode("codes").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > limit)
        over = cut_lineage(over if stuck is None else over.join(stuck, "leaf", "left_anti"))
        if over.isEmpty():
            break
        held = routed.select("cls", "vector", F.explode("codes").alias("leaf")).join(small_side(over), "leaf")
        sampled = held.where(F.pmod(F.xxhash64("cls", "leaf"), F.col("n")) < LEAF_SAMPLE)
        fitted = cut_lineage(sampled.groupBy("leaf").applyInPandas(fit, "leaf int, dim int, tree binary"))
        parted = fitted.where("tree is not null")
        whole = fitted.where("tree is null").select("leaf")
        stuck = whole if stuck is None else cut_lineage(stuck.union(whole))
        if parted.isEmpty():
            continue
        moved = held.join(parted, "leaf").select("cls", "vector", "leaf", "dim", "tree").mapInArrow(route, "cls long, leaf int, code int")
        moved = moved.groupBy("cls").agg(F.collect_set("leaf").alias("gone"), F.collect_list("code").alias("into"))  # a vector's leaves
        both = routed.join(moved, "cls", "left")
        codes = F.when(F.col("gone").isNull(), F.col("codes")).otherwise(F.array_distinct(F.concat(F.array_except("codes", "gone"), "into")))
        routed = cut_lineage(both.select("cls", "copies", "vector", codes.alias("codes")))
    return routed


def near_duplicate_vectors(
    vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = 0.9, trees: int | None = None, miss: float = 0.002, leaf_rows: int = 512, spill: float = 0.05, sample_rows: int = 10_000, block: int = 1024, seed: int = 7
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of the table.

    Equal vectors are one class with a count, so copies are never paired off. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing; vectors of different
    lengths never link; neither do rows with a null id, whose component_id is null and which are kept.
    Rows that repeat an id are vectors of their own, with their own links and component. An empty table gives no
    rows; other columns are ignored.
    """
    kind = "<f4" if dict(vectors.dtypes)[vector_column] == "array<float>" else "<f8"
    ids = F.col(id_column).cast("long").alias("id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, prints = [], []
            for v in batch.column(1):
                x = None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(kind) if not v.values.null_count else None
                good = x is not None and len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                data.append((x + 0.0).astype(kind).tobytes() if good else None)
                prints.append(hashlib.blake2b(data[-1], digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array(prints, pa.binary())], names=["id", "vector", "fp"])

    rows = cut_lineage(vectors.select(ids, F.col(vector_column)).mapInArrow(read, "id long, vector binary, fp binary"))
    good = rows.where("id is not null and fp is not null")
    classes = good.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.any_value("vector").alias("vector"))
    classes = cut_lineage(classes.withColumn("cls", F.monotonically_increasing_id()))
    total = classes.count()

    sample = classes.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).select("vector").toPandas()  # bounded by sample_rows
    size = int(kind[2])
    number = trees or trees_for(total, leaf_rows, miss)
    forests: dict[int, list[Tree]] = {}
    for length, same in sample.groupby(sample.vector.map(len)):
        x = unit(np.frombuffer(b"".join(same.vector), dtype=kind).reshape(len(same), -1))
        leaf = max(16, leaf_rows * len(sample) / max(1, total))
        few = thinned(x, cosine)
        forests[int(length) // size] = [grow(few, f"{seed}:{t}", leaf, spill) for t in range(number)]
    held = classes.sparkSession.sparkContext.broadcast(forests)  # trees times sample_rows / 16 thresholds at most

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = np.diff(np.frombuffer(whole.column("vector").buffers()[1], dtype=np.int32)[whole.column("vector").offset : whole.column("vector").offset + len(whole) + 1])
            for length in np.unique(lengths).tolist():
                same = whole.take(pa.array(np.flatnonzero(lengths == length)))
                for at in range(0, len(same), 2048):
                    batch = same.slice(at, 2048)
                    dim = length // size
                    x = unit(raw(batch.column("vector"), kind)).astype(np.float32)
                    parts = [tree.route(x) for tree in held.value.get(dim) or [Tree("none", dim, {})]]
                    place, code = np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])
                    order = np.lexsort((code, place))
                    offsets = np.searchsorted(place[order], np.arange(len(batch) + 1))
                    codes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(code[order]))
                    yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("copies"), batch.column("vector"), codes], names=["cls", "copies", "vector", "codes"])

    routed = classes.select("cls", "copies", "vector").mapInArrow(leaves, "cls long, copies long, vector binary, codes array<int>")
    routed = cut_lineage(routed.withColumn("codes", F.array_distinct("codes")))
    routed = _split_further(routed, kind, limit=4 * leaf_rows, leaf_rows=leaf_rows, spill=spill, cosine=cosine)

    # leaves of at most a block are groups; of larger ones, each pair of blocks
    sizes = routed.select(F.explode("codes").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > block)
    sizes = cut_lineage(sizes.select("leaf", F.ceil(F.col("n") / block).alias("blocks")))  # one row for each dense leaf
    placed = routed.select("cls", "copies", "vector", "codes", F.explode("codes").alias("leaf")).join(small_side(sizes), "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least("mine", k).alias("i"), F.greatest("mine", k).alias("j")))
    dealt = placed.select("leaf", F.explode(pairs).alias("p"), "mine", "cls", "copies", "vector", "codes").select("leaf", "p.i", "p.j", "mine", "cls", "copies", "vector", "codes")

    def links_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, ("leaf", "i", "j")):
            if len(part) > 1:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, compare(part, kind, cosine))), names=["cls", "links", "root"])

    found = cut_lineage(dealt.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j").mapInArrow(links_in, "cls long, links long, root long"))

    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    least = joined.join(classes.select(F.col("cls").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("in_component"))
    joined = joined.join(least, "component").select(F.col("node").alias("cls"), "in_component")
    by_class = classes.select("fp", "cls", "least", "copies").join(links, "cls", "left").join(joined, "cls", "left")
    by_class = by_class.select("fp", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("with_links"), F.coalesce("in_component", "least").alias("in_component"))
    out = rows.select("id", "fp").withColumn("fp", F.when(F.col("id").isNotNull(), F.col("fp"))).join(by_class, "fp", "left")
    component = F.when(F.col("id").isNotNull(), F.least(F.coalesce("in_component", "id"), F.col("id")))
    return out.select(F.col("id").alias(id_column), F.coalesce("with_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
