"""Mixing sources to target weights by a low-discrepancy schedule.

Slot k of the schedule is the golden-ratio point frac(k * phi) mapped through the cumulative targets of
the sources, so every stretch of the schedule holds each source in nearly its target share. Slots are
ranked per source, and rank r joins block r modulo the source's blocks: equal-token blocks of the
source's documents in a shuffled order. Blocks are as large as the source allows, and the shares of slots
count each source's target in its own blocks. DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramquarry.llm.common import WORD, cut_lineage

#: The golden ratio's fraction in 48 bits, odd so that 2^48 slots have distinct points.
PHI = 173_961_102_589_771
POINT = 1 << 48
#: Cells of the unit interval on which slots and shares are joined, at least; more where there are more sources.
CELLS = 4096
#: Slots of a source's target or size, whichever is smaller, at least; fewer only where all sources together would
#: have more than MOST_SLOTS by it, and never under LEAST_FINE. Sources of fewer words have blocks of one word.
FINE, LEAST_FINE, MOST_SLOTS = 512, 32, 1 << 26
#: A table of sources is broadcast only up to so many rows.
BROADCAST_ROWS = 50_000


def words_in(text: Column) -> Column:
    """How many words the text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """The table with number and target, of one row for each source (source, source_size and any other columns).

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes; a
    target stops at `most` times its source's size and the excess is shared again by weight. With the
    sources in order of size / weight, those that stop come first, so one running sum finds the
    level at which the others share: source i stops iff the level without it would exceed its limit.
    """
    everything = Window.partitionBy(F.lit(0))
    number = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("source_size", F.col("source_size").cast("long")).withColumn("number", number.cast("int"))
    weighed = weighed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = everything.orderBy(F.col("limit") / F.col("weight"), "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = weighed.withColumn("level", left / open_weight)
    # once a source doesn't stop, no later one does, and the level stays
    stops = F.col("level") * F.col("weight") >= F.col("limit")
    final = F.min(F.when(~stops, F.struct(F.col("limit") / F.col("weight"), "number", F.col("level").alias("level")))).over(everything)["level"]
    return level.withColumn("final", final).select(*sizes.columns, "number", F.when(stops, F.col("limit")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, slots: int = 1 << 20, bucket_rows: int = 2048, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of (doc_id, text, source).

    A row's place in its source's shuffled order comes from hashes of its id and text, so reruns agree. Rows are
    dealt to buckets by those hashes and positions are running sums over buckets, then within one,
    so a source with most of the rows is no single task, whatever its ids are; rows that are equal in id, text and source
    are one item with a count there and come one after another. Blocks have the words of the mix over `slots`,
    16 to 4096, but in each source at most a FINE-th of its size and its target, so a small source
    meets its target beside any total. Counts of golden-ratio points are off by a few slots at most.

    A null or empty text has size 0 and takes nothing; null is a source of its own; a null id and
    repeated ids are rows of their own; an empty table gives no rows; other columns are ignored. A row is taken at
    most `most` times its size.
    """
    source = F.col("source").cast("string")
    rows = docs.select(F.col(id_column).alias("doc_id"), source.alias("source"), words_in(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    items = cut_lineage(rows.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("copies")))
    by_source = items.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n"))
    # a number for a key: Spark gives a broadcast table with a text or several keys 64 MiB at once
    key = F.xxhash64(F.col("source").isNull(), "source")
    plan = cut_lineage(targets(by_source, weights, float(most)).withColumn("key", key))
    sources, keys, total = plan.agg(F.count("*"), F.count_distinct("key"), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    if keys < sources:  # two names with one hash: by the names themselves
        key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
        plan = plan.withColumn("key", key)
    block_words = max(16, min(4096, -(-total // slots)))
    fine = max(LEAST_FINE, min(FINE, MOST_SLOTS // max(1, sources)))
    own_words = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.least(F.col("source_size").cast("double"), "target") / fine)))
    plan = plan.withColumn("block_words", own_words.cast("long"))
    plan = plan.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words"))).withColumn("buckets", F.ceil(F.col("n") / bucket_rows))

    # positions in the shuffled order
    own = plan.select("key", "number", "buckets", "source_size", "target", "block_words")
    dealt = items.withColumn("key", key).join(F.broadcast(own) if sources <= BROADCAST_ROWS else own, "key")
    dealt = dealt.withColumn("h", F.xxhash64("doc_id", "tie", F.lit("order"))).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie", F.lit("bucket")), F.col("buckets")).cast("int"))
    held = F.col("size") * F.col("copies")
    sums = dealt.groupBy("number", "bucket").agg(F.sum(held).alias("held"))
    base = sums.withColumn("base", F.sum("held").over(Window.partitionBy("number").orderBy("bucket")) - F.col("held")).drop("held")
    inside = Window.partitionBy("number", "bucket").orderBy("h", "doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("upto", F.sum(held).over(inside)).join(base, ["number", "bucket"])
    placed = placed.withColumn("start", F.col("base") + F.col("upto") - held).select("doc_id", "size", "source_size", "target", "number", "start", "block_words", "copies")
    placed = _each_copy(placed).withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("copy")

    # the schedule: golden-ratio points through the cumulative targets; slots and blocks compress so well that Spark
    # would take them for small and broadcast them, hence the hints
    counts = _block_counts(plan, most, 1 << max(CELLS - 1, sources - 1).bit_length(), sources <= BROADCAST_ROWS)
    words = F.col("block_words")
    first, last = F.expr("start div block_words"), F.expr("(start + size - 1) div block_words")
    key_row = F.monotonically_increasing_id()
    placed = cut_lineage(placed.select("doc_id", "size", "source_size", "target", "number", "start", "block_words", first.alias("first"), F.when(F.col("size") > 0, last).otherwise(first).alias("last")).withColumn("row", key_row))
    pieces = placed.where("size > 0").select("row", "number", "start", "size", "block_words", F.explode(F.sequence("first", "last")).alias("block"))
    part = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * words) - F.greatest(F.col("start"), F.col("block") * words)
    taken = pieces.withColumn("part", part).join(counts.hint("merge"), ["number", "block"]).groupBy("row").agg(F.sum(F.col("part") * F.col("times")).alias("taken"))
    return placed.join(taken.hint("merge"), "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _each_copy(items: DataFrame, at_once: int = 4096) -> DataFrame:
    """A row for each copy of an item, numbered by `copy`; items of more than `at_once` copies are dealt out in stretches."""
    one = lambda first, last: F.explode(F.sequence(first, last)).alias("copy")
    rest = [c for c in items.columns if c != "copies"]
    few = items.where(F.col("copies") <= at_once).select(*rest, one(F.lit(0).cast("long"), F.col("copies") - 1))
    many = items.where(F.col("copies") > at_once).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(at_once).cast("long"))).alias("from"))
    many = many.repartition(F.col("start"), F.col("from")).select(*rest, one(F.col("from"), F.least(F.col("from") + at_once, F.col("copies")) - 1))
    return few.unionByName(many)


def _block_counts(plan: DataFrame, most: int, cells_in_all: int, few: bool) -> DataFrame:
    """(number, block, times): how often the schedule's slots take each block.

    Slots are numbered over the whole mix; each gets its source, and its rank is the count of that
    source's earlier slots, from counts per stretch of slots and a running sum over stretches. A source's
    share of the slots is its target in blocks of their mean size, so its short last block is no loss.
    """
    everything = Window.partitionBy(F.lit(0))
    shares = plan.where("target > 0").withColumn("due", F.col("target") * F.col("blocks") / F.col("source_size"))
    shares = shares.withColumn("high", F.sum("due").over(everything.orderBy("number"))).withColumn("all", F.sum("due").over(everything))
    shares = shares.select("number", "blocks", ((F.col("high") - F.col("due")) / F.col("all") * POINT).cast("long").alias("low"), F.when(F.col("high") >= F.col("all"), F.lit(POINT)).otherwise((F.col("high") / F.col("all") * POINT).cast("long")).alias("high"), "all")
    size = F.ceil("all")
    stretch = 1024
    slots = shares.select(size.alias("slots")).distinct().select("slots", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / stretch).cast("int"))).alias("stretch"))
    slots = slots.repartition(F.col("stretch")).select("stretch", F.explode(F.sequence(F.col("stretch").cast("long") * stretch, F.least((F.col("stretch").cast("long") + 1) * stretch, "slots") - 1)).alias("slot"))
    point = F.expr(f"cast(pmod(cast(slot as decimal(38, 0)) * {PHI}, {POINT}) as bigint)")
    slots = slots.withColumn("point", point)
    # a slot's source: an equi-join on the cell of the unit interval, then the share that holds the point
    width = POINT // cells_in_all
    cells = shares.where("low < high").select("low", "high", "number", "blocks", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))).alias("cell"))
    # a row for each cell and one more for each source at most
    slots = slots.withColumn("cell", F.expr(f"point div {width}")).join(F.broadcast(cells) if few else cells.hint("merge"), "cell").where("point >= low and point < high").select("slot", "stretch", "number", "blocks")
    per = slots.groupBy("number", "stretch").agg(F.count("*").alias("held"))
    base = per.withColumn("base", F.sum("held").over(Window.partitionBy("number").orderBy("stretch")) - F.col("held")).drop("held")
    rank = F.row_number().over(Window.partitionBy("number", "stretch").orderBy("slot")) - 1
    ranked = slots.withColumn("rank", rank).join(base.hint("merge"), ["number", "stretch"]).withColumn("rank", F.col("rank") + F.col("base"))
    ranked = ranked.where(F.col("rank") < F.col("blocks") * most)
    return ranked.groupBy("number", F.pmod("rank", "blocks").alias("block")).agg(F.count("*").alias("times"))
