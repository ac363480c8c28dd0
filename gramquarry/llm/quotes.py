"""Chat formatting by quotation linking.

Quote levels are parsed from '>' prefixes, quoted passages are normalised and hashed, and the hashes join to
the messages that first said them in the same conversation. Conversations come out in reply order, without
the quotes. DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramquarry.llm.common import cut_lineage

#: A line's quote marks, blanks between them allowed, and one blank after them.
MARKS = r"^(?:[\x20\x09]*>)++[\x20\x09]?"
#: The line that introduces a quote in mail and forum clients.
ATTRIBUTION = r"(?i)^.{0,200}(?:wrote|writes|said|schrieb|escribió|a écrit)\x20?:[\x20\x09]*$"
#: Passages shorter than this are often said again, so they link to the nearest earlier turn, longer ones to the earliest.
LEAST = 12
#: Where a sentence ends; full-width marks need no blank after them.
SENTENCE = r"(?<=[.!?…][)\"'»”]{0,3})\s+|(?<=[。！？])(?![。！？」』”])\s*|\n\s*\n"


def depth(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def normalised(text: Column) -> Column:
    """Lower case, with every run of anything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")


def body(text: Column) -> Column:
    """The text's own lines, without quotes and the lines that introduce them, trimmed of white space."""
    marked = F.transform(_lines(text), lambda x: F.struct(x.alias("line"), depth(x).alias("depth")))

    def own(lines: Column) -> Column:
        kept = F.filter(lines, lambda x, i: (x["depth"] == 0) & ~(F.rlike(x["line"], F.lit(ATTRIBUTION)) & (F.coalesce(F.try_element_at(lines, i + 2)["depth"], F.lit(0)) > 0)))
        return F.array_join(F.transform(kept, lambda x: x["line"]), "\n")

    quoted = F.element_at(F.transform(F.array(marked), own), 1)
    plain = F.when(F.contains(text, F.lit(">")), quoted).otherwise(text)
    return F.regexp_replace(plain, r"^\s+|\s+\z", "")


def passages(text: Column) -> Column:
    """array<struct<depth, text>> of the runs of lines of one quote depth, depth 0 left out, in order."""
    lines = F.transform(_lines(F.translate(text, "\x01\x02", "  ")), lambda x: F.struct(depth(x).alias("depth"), F.regexp_replace(x, MARKS, "").alias("line")))

    def cut(lines: Column) -> Column:
        starts = F.transform(
            lines,
            lambda x, i: F.concat(F.when((i == 0) | (x["depth"] != F.coalesce(F.try_element_at(lines, F.when(i > 0, i).otherwise(1))["depth"], F.lit(-1))), F.concat(F.lit("\x01"), x["depth"].cast("string"), F.lit("\x02"))).otherwise(F.lit("\n")), x["line"]),
        )
        runs = F.split(F.array_join(starts, ""), "\x01")
        parts = F.transform(F.filter(runs, lambda r: r != ""), lambda r: F.struct(F.split_part(r, F.lit("\x02"), F.lit(1)).cast("int").alias("depth"), F.split_part(r, F.lit("\x02"), F.lit(2)).alias("text")))
        return F.filter(parts, lambda p: p["depth"] > 0)

    empty = F.array().cast("array<struct<depth:int,text:string>>")
    return F.when(F.contains(text, F.lit(">")), F.element_at(F.transform(F.array(lines), cut), 1)).otherwise(empty)


def _keys(texts: Column) -> Column:
    """Keys of the normalised texts, each once: digests, or, after a sign that no digest has, the short texts themselves."""
    good = F.filter(F.transform(texts, normalised), lambda t: t != "")
    return F.array_distinct(F.transform(good, lambda t: F.when(F.length(t) < LEAST, F.concat(F.lit("="), t)).otherwise(F.md5(t))))


def _short(key: Column) -> Column:
    return F.startswith(key, F.lit("="))


def _ranked(keys: Column, rank: int) -> Column:
    """array<struct<rank, key>>: the whole passage, then lines, then sentences, then short lines and short sentences."""
    return F.transform(keys, lambda k: F.struct(F.when(_short(k) & F.lit(rank > 0), rank + 2).otherwise(rank).alias("rank"), k.alias("key")))


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, body, n_quotes, quote_depth, n_linked, reply_to, thread) for every row of
    (conv_id, turn, role, text).

    A quoted passage links to the earliest earlier turn of its conversation whose own text, a paragraph, a
    line or a sentence of it is the passage once both are normalised; where the whole passage is nowhere, its
    lines are tried, then its sentences, lines joined. Texts under LEAST characters link to the nearest earlier turn
    that has them instead, and as lines or sentences only where no longer one is found. Among lines
    or sentences of one passage the earliest turn counts. Parts of a sentence, and lines without sentence ends that were
    wrapped anew, link only as a whole text or paragraph. reply_to is the latest turn that the message's outermost quotes link to; thread is the
    first turn of the chain of replies (the message's own where it replies to nothing). Ordering by
    (conv_id, thread, turn) gives each conversation in reply order.

    A null text is an empty message; rows with a null conv_id or turn have no links and their own turn as
    thread; repeated rows and repeated (conv_id, turn) give a row each and link alike; an empty table gives no
    rows; other columns are ignored.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    quoting = rows.where(F.contains("text", F.lit(">")) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quotes = quoting.select("conv_id", "turn", passages(F.col("text")).alias("p")).distinct().select("conv_id", "turn", F.posexplode("p").alias("at", "p"))
    quotes = cut_lineage(quotes.select("conv_id", "turn", "at", "p.depth", _keys(F.array("p.text")).alias("whole"), _keys(_lines(F.col("p.text"))).alias("lines"), _keys(F.split("p.text", SENTENCE)).alias("sentences")))
    ranked = [_ranked(F.col(name), rank) for rank, name in enumerate(("whole", "lines", "sentences"))]
    tried = quotes.select("conv_id", "turn", "at", "depth", F.explode(F.concat(*ranked)).alias("k"))
    tried = tried.select("conv_id", "turn", "at", "depth", "k.rank", "k.key")

    # what was said first, for the keys that some quote of the conversation has
    wanted = tried.select("conv_id", "key").distinct()
    talked = rows.join(quotes.select("conv_id").distinct(), "conv_id", "left_semi").where("turn is not null").select("conv_id", "turn", body(F.col("text")).alias("own"))
    said = talked.select("conv_id", "turn", F.explode(_keys(F.concat(F.array("own"), F.split("own", r"\n\s*\n"), F.split("own", "\n"), F.split("own", SENTENCE)))).alias("key"))
    said = said.join(wanted, ["conv_id", "key"], "left_semi")
    first = said.where(~_short(F.col("key"))).groupBy("conv_id", "key").agg(F.min("turn").alias("origin"))
    found = tried.join(first, ["conv_id", "key"]).where("origin < turn")
    # the nearest of short ones: sayings and quotes in one order, so no quote meets every saying
    quoted = tried.where(_short(F.col("key")))
    sayings = said.where(_short(F.col("key"))).withColumn("origin", F.col("turn"))
    both = sayings.unionByName(quoted.select("conv_id", "turn", "key").distinct().withColumn("origin", F.lit(None).cast("long")))
    before = Window.partitionBy("conv_id", "key").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    nearest = both.select("conv_id", "turn", "key", F.max("origin").over(before).alias("last")).groupBy("conv_id", "turn", "key").agg(F.max("last").alias("origin")).where("origin is not null")
    found = found.unionByName(quoted.join(nearest, ["conv_id", "turn", "key"]))
    best = found.groupBy("conv_id", "turn", "at", "depth").agg(F.min(F.struct("rank", "origin"))["origin"].alias("origin"))
    by_message = best.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.max_by("origin", F.struct(-F.col("depth"), "origin")).alias("reply_to"))
    replies = cut_lineage(by_message)

    # the first turn of each chain, by pointer jumping over the replies alone: log2(longest chain) rounds
    chain = replies.select("conv_id", "turn", F.col("reply_to").alias("thread"))
    while True:
        up = chain.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("above"))
        jumped = cut_lineage(chain.join(up, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("above", "thread").alias("thread"), (F.col("above").isNotNull()).alias("moved")))
        chain = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            break
    # only messages that quote can have links, so the others need no join
    links = replies.join(chain, ["conv_id", "turn"])
    marked = F.contains("text", F.lit(">"))
    counts = passages(F.col("text"))
    own = body(F.col("text")).alias("body")
    plain = rows.where(~marked).select("conv_id", "turn", "role", own, F.lit(0).cast("long").alias("n_quotes"), F.lit(0).alias("quote_depth"), F.lit(0).cast("long").alias("n_linked"), F.lit(None).cast("long").alias("reply_to"), F.col("turn").alias("thread"))
    out = rows.where(marked).select("conv_id", "turn", "role", own, F.size(counts).cast("long").alias("n_quotes"), F.coalesce(F.array_max(F.transform(counts, lambda p: p["depth"])), F.lit(0)).alias("quote_depth"))
    out = out.join(links, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "body", "n_quotes", "quote_depth", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "reply_to", F.coalesce("thread", "turn").alias("thread")
    )
    return plain.unionByName(out)


def conversations(messages: DataFrame, *, block: int = 256) -> DataFrame:
    """(conv_id, first, n_messages, n_quotes, n_linked, messages): every conversation of (conv_id, turn, role, text) in
    reply order and without the quotes.

    messages is array<struct<position, turn, role, reply_to, thread, body>>, ordered by thread, then turn (null last),
    role and body; position counts from 0 in the conversation. A row holds at most `block` messages, so a longer
    conversation has several rows, in the order of first, the position of their first message; where a row ends may
    depend on the partitioning, the messages and their positions do not. Rows with a null conv_id are one
    conversation; repeated rows are messages each; an empty table gives no rows; other columns are ignored.
    """
    order = ["thread", "turn", "role", "body"]
    by = [F.col(c).asc_nulls_last() for c in order]
    # ranges of the order, not conversations, are dealt out, so a conversation of any length is no single task
    dealt = link_quotes(messages).repartitionByRange("conv_id", *by)
    dealt = cut_lineage(dealt.withColumn("part", F.spark_partition_id()))
    held = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("held"))
    base = held.select("conv_id", "part", (F.sum("held").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("held")).alias("base"))
    inside = dealt.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*by)) - 1)
    message = F.struct(F.col("k").alias("k"), "turn", "role", "reply_to", "thread", "body")
    blocks = inside.groupBy("conv_id", "part", F.floor(F.col("k") / block).alias("b")).agg(F.count("*").alias("n_messages"), F.sum("n_quotes").alias("n_quotes"), F.sum("n_linked").alias("n_linked"), F.array_sort(F.collect_list(message)).alias("m"))
    base = base.select(F.col("conv_id").alias("base_id"), F.col("part").alias("base_part"), "base")
    placed = blocks.join(base, (F.col("part") == F.col("base_part")) & F.col("conv_id").eqNullSafe(F.col("base_id")))
    at = lambda x: (x["k"] + F.col("base")).cast("long")
    listed = F.transform("m", lambda x: F.struct(at(x).alias("position"), x["turn"].alias("turn"), x["role"].alias("role"), x["reply_to"].alias("reply_to"), x["thread"].alias("thread"), x["body"].alias("body")))
    return placed.select("conv_id", (F.col("base") + F.col("b") * block).alias("first"), "n_messages", "n_quotes", "n_linked", listed.alias("messages"))
