"""The n-gram index: build, store, look up, merge and delete.

Tables: fp_term (payloads and their headers), fp_posting (a row for each term and document, so that no term's
documents are ever one row), fp_index (bucket and gram to ordinals) and fp_block (a row for each group). Groups are
dealt by a hash of the term, which keeps them even and repeatable without ordering a whole column. Buckets prune
the sorted fp_index; the gram beside them tells the grams of a bucket apart, so a search of indexed groups reads
no payloads.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramquarry.config import FORMAT_VERSION, HOT_THRESHOLD, LEVEL_TERMS, NO_INDEX_TERMS, OVER_RATE, BytesMode, Level, block_complete, by_level, target_level
from gramquarry.functions.binary import bucket_of, grams, pattern_bytes, query_slices
from gramquarry.logs import timed
from gramquarry.operators import mining
from gramquarry.operators.ordering import out_of_order
from gramquarry.plans.search import exact, holds, scan_search
from gramquarry.session import cut_lineage

KEYS = ("column", "group_id")
#: The stored tables; an empty one has no files to infer a schema from.
SCHEMAS = {
    "fp_term": "column string, group_id int, level tinyint, tier string, term_index int, is_del boolean, budget tinyint, payload binary",
    "fp_posting": "column string, tier string, group_id int, term_index int, doc_id bigint",
    "fp_index": "column string, group_id int, tier string, len_idx int, bucket int, gram binary, orders array<int>",
    "fp_block": "column string, group_id int, target_level tinyint, hot_count bigint, common_count bigint, doc_count bigint, passed boolean, format_version int",
}
#: In which order a stored table's rows lie in each of its files.
ORDERS = {"fp_term": ("column", "group_id", "term_index"), "fp_posting": ("column", "tier", "group_id", "term_index", "doc_id"), "fp_index": ("column", "tier", "len_idx", "bucket")}
#: Slices up to so many bytes occur nearly everywhere; a scan answers them faster than the index.
SHORT = 2
#: Term candidates of a search that are filtered by their keys; more are joined.
MOST_KEYS = 4096
#: Groups, each of thousands of terms, whose fates a merge broadcasts; more are joined.
MOST_GROUPS = 50_000


def _key() -> Column:
    """Group and ordinal as one number."""
    return F.shiftleft(F.col("group_id").cast("long"), 32).bitwiseOR(F.col("term_index").cast("long"))


@dataclass
class FpIndex:
    """The four tables of one index version."""

    term: DataFrame
    posting: DataFrame
    index: DataFrame
    block: DataFrame
    _levels: dict[str, dict[int, int]] = field(default_factory=dict, repr=False)

    @staticmethod
    def build(source: DataFrame, *, no_index_terms: int = NO_INDEX_TERMS, level: Level | None = None, groups: int | None = None) -> FpIndex:
        """From a (doc_id, column, value) source. Tables that are used several times are checkpointed."""
        return FpIndex.of_terms(mining.terms(source), no_index_terms=no_index_terms, level=level, groups=groups)

    @staticmethod
    def of_terms(term_docs: DataFrame, *, no_index_terms: int = NO_INDEX_TERMS, level: Level | None = None, groups: int | None = None) -> FpIndex:
        """From distinct (column, term, doc_id). A number of groups may be given instead of the level's; they then hold any number
        of terms, so their ordinals are counted over ranges."""
        bounded = groups is None
        term_docs = cut_lineage(term_docs)
        # aggregated per column: a row for each column, joined by its real size
        totals = term_docs.groupBy("column").agg(F.count_distinct("term").alias("terms"), F.count_distinct("doc_id").alias("docs"))
        totals = totals.withColumn("level", F.lit(int(level)) if level else target_level(F.col("terms"), F.col("docs")))
        cap = F.floor(by_level(F.col("level"), LEVEL_TERMS) * by_level(F.col("level"), OVER_RATE))
        totals = totals.select("column", "level", (F.ceil(F.col("terms") / cap) if bounded else F.lit(groups)).alias("groups"))
        dealt = term_docs.select("column", "term").distinct().join(totals, "column")
        dealt = dealt.select("column", F.pmod(F.xxhash64("term"), F.col("groups")).cast("int").alias("group_id"), "level", "term")
        sizes = dealt.groupBy(*KEYS).agg(F.count("*").alias("n"))
        dealt = cut_lineage(dealt.join(sizes, list(KEYS)).withColumn("level", F.when(F.col("n") <= no_index_terms, int(Level.NONE)).otherwise(F.col("level")).cast("tinyint")).drop("n"))

        indexed = dealt.where(F.col("level") != int(Level.NONE))
        rows = cut_lineage(mining.gram_rows(indexed, (*KEYS, "level")))
        hot = cut_lineage(mining.hot_grams(rows, by_level(F.col("level"), HOT_THRESHOLD), (*KEYS, "level")))
        occurrences = mining.hot_occurrences(rows, hot, (*KEYS, "level"))
        top = cut_lineage(mining.maximal(occurrences, (*KEYS, "level")))
        owned = top.select(*KEYS, "level", "gram").distinct().withColumn("is_del", F.lit(False))
        numbered = mining.ordinals(hot, (*KEYS, "level"), bounded=bounded).join(owned, [*KEYS, "level", "gram"], "left").withColumn("is_del", F.coalesce("is_del", F.lit(True)))
        numbered = cut_lineage(numbered)
        ranked = cut_lineage(mining.flush_ranks(mining.hit_counts(dealt, top, (*KEYS, "level")), (*KEYS, "level"), bounded=bounded))

        header = (*KEYS, "level", "tier", "term_index", "is_del", "budget", "payload")
        hot_terms = numbered.select(*KEYS, "level", F.lit("hot").alias("tier"), "term_index", "is_del", mining.budget(F.col("gram")).cast("tinyint").alias("budget"), F.col("gram").alias("payload"))
        common = ranked.select(*KEYS, "level", F.lit("common").alias("tier"), "term_index", F.lit(False).alias("is_del"), F.lit(0).cast("tinyint").alias("budget"), F.col("term").alias("payload"))
        term = hot_terms.select(*header).unionByName(common.select(*header))

        of_common = ranked.select(*KEYS, "term", "term_index").join(term_docs, ["column", "term"]).select(*KEYS, F.lit("common").alias("tier"), "term_index", "doc_id")
        of_hot = top.join(numbered.select(*KEYS, "gram", "term_index"), [*KEYS, "gram"]).select(*KEYS, "term", "term_index").join(term_docs, ["column", "term"])
        posting = of_common.unionByName(of_hot.select(*KEYS, F.lit("hot").alias("tier"), "term_index", "doc_id").distinct())

        orders = lambda rows, tier: mining.bucket_orders(rows.select(*KEYS, F.lit(tier).alias("tier"), "gram", "term_index"), (*KEYS, "tier", "gram"))
        in_hot = numbered.select(*KEYS, "term_index", F.explode(F.array_distinct(grams(F.col("gram")))).alias("gram"))
        rest = mining.residual_grams(rows, hot, (*KEYS, "level")).join(ranked.select(*KEYS, "term", "term_index"), [*KEYS, "term"])
        index = orders(in_hot, "hot").unionByName(orders(rest, "common"))

        block = ranked.groupBy(*KEYS, "level").agg(F.count("*").alias("common_count"))
        docs = of_common.groupBy(*KEYS).agg(F.count_distinct("doc_id").alias("doc_count"))
        block = block.join(hot.groupBy(*KEYS).agg(F.count("*").alias("hot_count")), list(KEYS), "left").join(docs, list(KEYS), "left")
        block = block.select(*KEYS, F.col("level").alias("target_level"), F.coalesce("hot_count", F.lit(0)).alias("hot_count"), "common_count", F.coalesce("doc_count", F.lit(0)).alias("doc_count"), F.lit(False).alias("passed"), F.lit(FORMAT_VERSION).alias("format_version"))
        return FpIndex(term, posting, index, block)

    def write(self, path: str, *, row_group_bytes: int | None = None) -> None:
        """Store the tables below path, sorted (ORDERS), so that lookups prune files and row groups by group and ordinal, and
        by bucket. Ranges are dealt out, so that the documents of one gram, or the grams of one bucket, are no single task.
        A sort starts with the partition columns: the writer keeps an order only if it begins so."""
        options = {"parquet.block.size": str(row_group_bytes)} if row_group_bytes else {}
        with timed("write", "store", 1, path=path):
            for name, by in (("fp_term", ["column"]), ("fp_posting", ["column", "tier"]), ("fp_index", ["column", "tier", "len_idx"])):
                table = getattr(self, name.removeprefix("fp_"))
                order = ORDERS[name]
                table.repartitionByRange(*order).sortWithinPartitions(*order).write.options(**options).mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}")
            self.block.write.mode("overwrite").parquet(f"{path}/fp_block")

    @staticmethod
    def read(spark: SparkSession, path: str) -> FpIndex:
        """A stored index; another format version is an error."""
        term, posting, index, block = (spark.read.schema(schema).parquet(f"{path}/{t}") for t, schema in SCHEMAS.items())
        if not block.where(F.col("format_version") != FORMAT_VERSION).isEmpty():
            raise ValueError("the index has another format version")
        return FpIndex(term, posting, index, block)

    def violations(self) -> DataFrame:
        """(table, violations): how many rows of a stored index lie out of order in their file."""
        counts = [out_of_order(getattr(self, name.removeprefix("fp_")), order).agg(F.lit(name).alias("table"), F.count("*").alias("violations")) for name, order in ORDERS.items()]
        return reduce(DataFrame.unionByName, counts)

    def levels(self, column: str) -> dict[int, int]:
        """Common terms of the column's groups by level, read once: a row for each level."""
        if column not in self._levels:
            rows = self.block.where(F.col("column") == column).groupBy("target_level").agg(F.sum("common_count").alias("n")).collect()
            self._levels[column] = {int(r.target_level): int(r.n) for r in rows}
        return self._levels[column]

    def lookup(self, column: str, slices: list[bytes]) -> DataFrame:
        """Distinct (slice, doc_id): the ordinals of the slices' grams in both tiers, joined with the postings."""
        wanted = self.term.sparkSession.createDataFrame([(i, bytearray(s)) for i, s in enumerate(slices)], "slice int, gram binary")
        # one row for each slice of a pattern: bounded by the pattern, so broadcast
        hits = self._near(column, slices).join(F.broadcast(wanted), "gram").select("column", "group_id", "tier", "slice", F.explode("orders").alias("term_index"))
        return self._documents(hits)

    def _near(self, column: str, slices: list[bytes]) -> DataFrame:
        """The index rows of the slices' buckets, with other grams in them."""
        return self.index.where((F.col("column") == column) & F.col("len_idx").isin(sorted({len(s) - 1 for s in slices})) & F.col("bucket").isin(sorted({bucket_of(s) for s in slices})))

    def scan_small(self, column: str, slices: list[bytes]) -> DataFrame:
        """Distinct (slice, doc_id) in the groups too small to have an index."""
        small = self.term.where((F.col("column") == column) & (F.col("level") == int(Level.NONE)))
        flags = F.array(*(F.when(holds(F.col("payload"), s), F.lit(i)) for i, s in enumerate(slices)))
        hits = small.select("column", "group_id", "tier", "term_index", F.explode(F.array_compact(flags)).alias("slice"))
        return self._documents(hits)

    def _documents(self, hits: DataFrame) -> DataFrame:
        column_docs = self.posting.join(hits, ["column", "group_id", "tier", "term_index"])
        return column_docs.select("slice", "doc_id").distinct()

    def _few(self, column: str, slices: list[bytes]) -> list[dict[str, list[tuple[int, int]]]] | None:
        """For each slice the (group, ordinal) of its terms by tier; None where there are more than MOST_KEYS in all.

        What reaches the driver is bounded by MOST_KEYS rows, of indexed groups and of those too small for an index.
        """
        levels = self.levels(column)
        out: list[dict[str, list[tuple[int, int]]]] = [defaultdict(list) for _ in slices]
        if set(levels) - {int(Level.NONE)}:
            rows = self._near(column, slices).where(F.col("gram").isin([bytearray(s) for s in slices])).select("tier", "group_id", "gram", F.explode("orders").alias("term_index"))
            near = rows.orderBy("group_id", "term_index").limit(MOST_KEYS + 1).collect()
            if len(near) > MOST_KEYS:
                return None
            places = {s: i for i, s in enumerate(slices)}
            for r in near:
                out[places[bytes(r.gram)]][r.tier].append((r.group_id, r.term_index))
        if int(Level.NONE) in levels:
            tests = [holds(F.col("payload"), s).alias(f"s{i}") for i, s in enumerate(slices)]
            small = self.term.where((F.col("column") == column) & (F.col("level") == int(Level.NONE))).select("tier", "group_id", "term_index", *tests)
            known = small.where(reduce(or_, (F.col(f"s{i}") for i in range(len(slices))))).orderBy("group_id", "term_index").limit(MOST_KEYS + 1).collect()
            if len(known) > MOST_KEYS:
                return None
            for r in known:
                for i, hits in enumerate(out):
                    if r[f"s{i}"]:
                        hits[r.tier].append((r.group_id, r.term_index))
        return out

    def _found(self, column: str, slices: list[bytes]) -> DataFrame:
        """doc_id of the documents in which every slice occurs."""
        few = self._few(column, slices)
        if few is None:
            found = self.lookup(column, slices).union(self.scan_small(column, slices)).distinct()
            return found.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") == len(slices)).select("doc_id")
        if not all(few):
            return self.posting.select("doc_id").where("false")
        # the keys of the verified terms are filters, which prune the sorted postings
        places, flags = [], []
        for hits in few:
            flags.append(reduce(or_, ((F.col("tier") == tier) & _key().isin([g << 32 | t for g, t in keys]) for tier, keys in hits.items())))
            places += [x for keys in hits.values() for x in keys]
        near = F.col("group_id").isin(sorted({g for g, _ in places})) & F.col("term_index").isin(sorted({t for _, t in places})) & F.col("tier").isin(sorted({tier for hits in few for tier in hits}))
        rows = self.posting.where((F.col("column") == column) & near)
        if len(slices) == 1:
            return rows.where(flags[0]).select("doc_id").distinct()
        names = [f"s{i}" for i in range(len(slices))]
        some = rows.select("doc_id", *(f.alias(n) for f, n in zip(flags, names, strict=True))).where(reduce(or_, map(F.col, names)))
        return some.groupBy("doc_id").agg(*(F.bool_or(n).alias(n) for n in names)).where(reduce(and_, map(F.col, names))).select("doc_id")

    def search(self, column: str, pattern: str | bytes, *, mode: str = "candidate", source: DataFrame | None = None, bytes_mode: BytesMode = BytesMode.UTF8) -> DataFrame:
        """doc_id of the documents that match. Exact mode checks the candidates' values in `source`. With a source,
        patterns for which the index is not worth it (use_index) are answered by scanning it."""
        q = pattern_bytes(pattern, bytes_mode)
        slices = query_slices(q)
        if not slices:
            return self.posting.select("doc_id").where("false")
        if source is not None and not use_index(slices, sum(self.levels(column).values())):
            return scan_search(source, column, q, mode=mode)
        with timed("search", "lookup", column=column, slices=len(slices)):
            docs = self._found(column, slices)
        if mode == "candidate":
            return docs
        if source is None:
            raise ValueError("exact mode needs the source")
        values = source.where((F.col("column") == column) & exact(F.col("value"), q))
        return values.join(docs, "doc_id", "left_semi").select("doc_id").distinct()

    def search_all(self, column: str, patterns: list[str | bytes]) -> DataFrame:
        """doc_id of the documents that are candidates of every pattern: one lookup of all their slices."""
        each = [query_slices(pattern_bytes(p)) for p in patterns]
        if not each or not all(each):
            return self.posting.select("doc_id").where("false")
        slices = list(dict.fromkeys(s for some in each for s in some))
        with timed("search", "lookup", column=column, slices=len(slices)):
            return self._found(column, slices)

    def funnel(self, column: str, pattern: str | bytes) -> DataFrame:
        """Counts along a candidate search, by level and tier: blocks (groups times slices), buckets (those in which a slice's
        bucket is), candidates (ordinals in them), missing (without a term), tombstones, mismatches (another gram of the
        bucket), verified terms, and hits (posting rows of these). Groups without an index are tier sparse:
        their candidates are all their terms."""
        slices = query_slices(pattern_bytes(pattern))
        wanted = self.term.sparkSession.createDataFrame([(i, bytearray(s), len(s) - 1, bucket_of(s)) for i, s in enumerate(slices)], "slice int, part binary, len_idx int, bucket int")
        groups = self.block.where(F.col("column") == column).select("column", "group_id", F.col("target_level").alias("level"))
        indexed = groups.where(F.col("level") != int(Level.NONE))
        rows = self._near(column, slices).join(F.broadcast(wanted), ["len_idx", "bucket"])
        orders = rows.select("column", "group_id", "tier", "slice", (F.col("gram") == F.col("part")).alias("same"), F.explode("orders").alias("term_index"))
        terms = self.term.where(F.col("column") == column).select("column", "group_id", "tier", "term_index", "payload", "is_del")
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("slice"), F.lit(bytearray(s)).alias("part")) for i, s in enumerate(slices)))).alias("w")
        sparse = terms.join(groups.where(F.col("level") == int(Level.NONE)), list(KEYS)).select("*", each).select("*", "w.*")
        checked = orders.join(terms, ["column", "group_id", "tier", "term_index"], "left").join(indexed, list(KEYS)).select("column", "group_id", "level", "tier", F.col("tier").alias("stage"), "slice", "same", "term_index", F.col("payload").isNull().alias("absent"), "is_del")
        checked = checked.unionByName(sparse.select("column", "group_id", "level", "tier", F.lit("sparse").alias("stage"), "slice", F.contains("payload", F.col("part")).alias("same"), "term_index", F.lit(False).alias("absent"), "is_del"))
        checked = checked.withColumn("ok", F.col("same") & ~F.col("absent") & ~F.coalesce("is_del", F.lit(False)))
        held = self.posting.where(F.col("column") == column).groupBy("column", "tier", "group_id", "term_index").agg(F.count("*").alias("held"))
        checked = checked.join(held, ["column", "tier", "group_id", "term_index"], "left")
        number = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
        counts = checked.groupBy("level", F.col("stage").alias("tier")).agg(
            F.count_distinct("group_id", "slice").alias("buckets"), F.count("*").alias("candidates"), number(F.col("absent")).alias("missing"), number(F.col("is_del")).alias("tombstones"),
            number(~F.col("same")).alias("mismatches"), number(F.col("ok")).alias("verified"), F.sum(F.when(F.col("ok"), F.coalesce("held", F.lit(0))).otherwise(0)).alias("hits"),
        )
        tiers = F.when(F.col("level") == int(Level.NONE), F.array(F.lit("sparse"))).otherwise(F.array(F.lit("hot"), F.lit("common")))
        blocks = groups.groupBy("level").agg((F.count("*") * len(slices)).alias("blocks")).select("level", F.explode(tiers).alias("tier"), "blocks")
        names = ("buckets", "candidates", "missing", "tombstones", "mismatches", "verified", "hits")
        return blocks.join(counts, ["level", "tier"], "left").select("level", "tier", "blocks", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))

    def write_counters(self) -> DataFrame:
        """For each column: groups passed through and rebuilt, tombstones, and posting rows of either tier."""
        groups = self.block.groupBy("column").agg(F.sum(F.col("passed").cast("long")).alias("passed"), F.sum((~F.col("passed")).cast("long")).alias("rebuilt"))
        gone = self.term.groupBy("column").agg(F.sum(F.col("is_del").cast("long")).alias("tombstones"))
        rows = self.posting.groupBy("column").agg(F.sum((F.col("tier") == "hot").cast("long")).alias("doclist_hot"), F.sum((F.col("tier") == "common").cast("long")).alias("doclist_common"))
        return groups.join(gone, "column", "left").join(rows, "column", "left").na.fill(0)

    def term_docs(self) -> DataFrame:
        """Distinct (column, term, doc_id): hot terms are derived and left out."""
        return _term_docs(self.term, self.posting)

    @staticmethod
    def fates(indexes: list[FpIndex], *, deleted: DataFrame | None = None) -> DataFrame:
        """(column, index_id, group_id, level, hot_terms, common_terms, docs, passed) of every group that a merge takes in.

        A group passes through unchanged if it has an index and, without the deleted documents, still is as full as the
        column's level over all versions asks, but not three times beyond the top level; the others are rebuilt.
        """
        blocks = reduce(DataFrame.unionByName, [x._counted(deleted).withColumn("index_id", F.lit(i)) for i, x in enumerate(indexes)])
        totals = blocks.groupBy("column").agg(F.sum("common_count").alias("all_terms"), F.sum("doc_count").alias("all_docs"))
        both = blocks.join(totals, "column")
        level = target_level(F.col("all_terms"), F.col("all_docs"))
        full = block_complete(F.lit(1.0), level, F.col("doc_count"), F.col("common_count")) & ~block_complete(F.lit(3.0), F.lit(int(Level.TOP)), F.col("doc_count"), F.col("common_count"))
        return both.select("column", "index_id", "group_id", F.col("target_level").alias("level"), F.col("hot_count").alias("hot_terms"), F.col("common_count").alias("common_terms"), F.col("doc_count").alias("docs"), ((F.col("target_level") != int(Level.NONE)) & full).alias("passed"))

    def _counted(self, deleted: DataFrame | None) -> DataFrame:
        """The block table; with deletions, its counts of what they leave."""
        if deleted is None:
            return self.block
        left = self.posting.where("tier = 'common'").join(deleted.select("doc_id").distinct(), "doc_id", "left_anti")
        counts = left.groupBy(*KEYS).agg(F.count_distinct("term_index").alias("c"), F.count_distinct("doc_id").alias("d"))
        both = self.block.join(counts, list(KEYS), "left")
        return both.select("column", "group_id", "target_level", "hot_count", F.coalesce("c", F.lit(0)).alias("common_count"), F.coalesce("d", F.lit(0)).alias("doc_count"), "passed", "format_version")

    @staticmethod
    def merge(indexes: list[FpIndex], *, deleted: DataFrame | None = None, **options) -> FpIndex:
        """One index of several versions, without the deleted documents; terms left without documents vanish.

        Full groups (fates) pass through: they only get new numbers and lose deleted documents, and their ordinals, budgets and
        buckets stay. The common terms of all other groups are built anew.
        """
        with timed("write", "merge", 1, versions=len(indexes)):
            fates = cut_lineage(FpIndex.fates(indexes, deleted=deleted))
            # a row for each group of thousands of terms
            order = Window.partitionBy("column").orderBy("index_id", "group_id")
            moved = cut_lineage(fates.where("passed").select("column", "index_id", "group_id", (F.row_number().over(order) - 1).cast("int").alias("to")))
            alive = lambda rows: rows if deleted is None else rows.join(deleted.select("doc_id").distinct(), "doc_id", "left_anti")
            # beside the groups' rows, the tables of groups are small; stored, they have no size that the planner knows
            side = F.broadcast if fates.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS else lambda df: df
            rest = fates.where("not passed").select("column", "index_id", "group_id")
            of = lambda table, groups, i: table.join(side(groups.where(F.col("index_id") == i).drop("index_id")), list(KEYS))
            rows = reduce(DataFrame.unionByName, [_term_docs(of(x.term, rest, i), alive(of(x.posting, rest, i))) for i, x in enumerate(indexes)])
            built = FpIndex.of_terms(rows.select("column", "term", "doc_id").distinct(), **options)
            if moved.isEmpty():
                return built
            gather = lambda name: reduce(DataFrame.unionByName, [of(getattr(x, name), moved, i).withColumn("group_id", F.col("to")).drop("to") for i, x in enumerate(indexes)])
            term, posting, index = gather("term"), cut_lineage(alive(gather("posting"))), gather("index")
            if deleted is not None:
                held = posting.select(*KEYS, "tier", "term_index").distinct().withColumn("held", F.lit(True))
                term = term.join(held, [*KEYS, "tier", "term_index"], "left").where("held or tier = 'hot'").withColumn("is_del", F.col("is_del") | F.col("held").isNull()).drop("held")
            counts = term.groupBy(*KEYS, F.col("level").alias("target_level")).agg(F.sum((F.col("tier") == "hot").cast("long")).alias("hot_count"), F.sum((F.col("tier") == "common").cast("long")).alias("common_count"))
            docs = posting.where("tier = 'common'").groupBy(*KEYS).agg(F.count_distinct("doc_id").alias("doc_count"))
            block = counts.join(docs, list(KEYS), "left").select(*KEYS, "target_level", "hot_count", "common_count", F.coalesce("doc_count", F.lit(0)).alias("doc_count"), F.lit(True).alias("passed"), F.lit(FORMAT_VERSION).alias("format_version"))
            # new groups are numbered after those that passed
            after = moved.groupBy("column").agg(F.count("*").cast("int").alias("to"))
            shift = lambda df: df.join(side(after), "column", "left").withColumn("group_id", F.col("group_id") + F.coalesce("to", F.lit(0))).drop("to")
            parts = zip((term, posting, index, block), (built.term, built.posting, built.index, built.block), strict=True)
            return FpIndex(*(old.unionByName(shift(new)) for old, new in parts))

    @staticmethod
    def provenance(indexes: list[FpIndex], *, deleted: DataFrame | None = None) -> DataFrame:
        """(column, index_id, ingested, merged_hot, merged_common, passed): of each source of a merge, the common terms that passed
        through with their groups, and the hot and common terms that rebuilt groups put in, with the number of groups passed."""
        some = FpIndex.fates(indexes, deleted=deleted)
        of = lambda c, passed: F.sum(F.when(F.col("passed") == passed, F.col(c)).otherwise(0))
        return some.groupBy("column", "index_id").agg(of("common_terms", True).alias("ingested"), of("hot_terms", False).alias("merged_hot"), of("common_terms", False).alias("merged_common"), F.sum(F.col("passed").cast("long")).alias("passed"))

    def delete(self, deleted: DataFrame, **options) -> FpIndex:
        return FpIndex.merge([self], deleted=deleted, **options)


def _term_docs(term: DataFrame, posting: DataFrame) -> DataFrame:
    common = term.where("tier = 'common'").select(*KEYS, "term_index", F.col("payload").alias("term"))
    return posting.where("tier = 'common'").join(common, [*KEYS, "term_index"]).select("column", "term", "doc_id").distinct()


def use_index(slices: list[bytes], terms: int) -> bool:
    """Whether a lookup is worth it: not for columns without an index or for patterns of short slices only."""
    return terms > NO_INDEX_TERMS and max(map(len, slices), default=0) > SHORT
