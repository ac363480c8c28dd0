"""Personal data: pattern spans, and terms that reveal them, by corpus co-occurrence.

Entities are the values that the patterns find. A term in an entity's documents discloses it by their pointwise
mutual information over the documents, as a share of the entity's information: log(N n_et / (n_e n_t)) /
log(N / n_e). Terms above a threshold, seen with the entity in several different contexts, are removed or,
below a second threshold, generalised: wherever the entity stands, and in all other documents too if nearly
all documents with the term have the entity. DataFrame and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramquarry.llm.common import cut_lineage, small_side, unused

KINDS = ("email", "ip", "card", "phone", "term")
#: The contract's patterns. Possessive repeats and the anchor at a run's start (or where the last match
#: ended) match the same spans without backtracking, so long runs cost linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these has no match of the kind; they are found in one pass, without a try at every character.
HINTS = {"email": r"@[A-Za-z0-9-]++\.", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?){13}", "phone": r"\+[0-9]"}
#: Scripts without blanks between words, all of them above U+0E00; the range is tested first, as scripts are looked up slowly.
SPACELESS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
DENSE = rf"[\x{{0e00}}-\x{{10ffff}}&&[{SPACELESS}]]"
#: A term is a run of one of them, or of other letters, marks and digits; the commonest are listed for speed.
TERM = rf"[a-zA-Z0-9\x{{e0}}-\x{{f6}}\x{{f8}}-\x{{ff}}[\p{{L}}\p{{M}}\p{{N}}&&[^{SPACELESS}]]]++|{DENSE}++"
SPAN = "struct<start:int,kind:int,end:int,value:string>"
#: Signs around the places of terms; texts have blanks for them while they are searched.
OPEN, CLOSE = "\x01", "\x02"
#: Terms that texts are compared with as literals; more are joined.
MOST_TERMS = 1000


def found_in(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the pattern's leftmost non-overlapping matches, in code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.struct(F.transform(gaps, F.length).alias("g"), F.transform(matches, F.length).alias("m"), matches.alias("v"))

    def place(x: Column) -> Column:
        # running ends: each match ends one gap and one match after the one before
        ends = F.aggregate(
            F.arrays_zip(F.slice(x["g"], 1, F.size(x["m"])).alias("g"), x["m"].alias("m")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")),
            lambda acc, p: F.struct((acc["at"] + p["g"] + p["m"]).alias("at"), F.array_append(acc["ends"], acc["at"] + p["g"] + p["m"]).alias("ends")),
        )["ends"]
        return F.zip_with(ends, F.arrays_zip(x["m"].alias("m"), x["v"].alias("v")), lambda e, p: F.struct((e - p["m"]).alias("start"), e.alias("end"), p["v"].alias("value")))

    return F.element_at(F.transform(F.array(lengths), place), 1)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + F.element_at(F.array(*[F.lit(k) for k in range(10)], *[F.lit(k * 2 - 9 * (k > 4)) for k in range(10)]), F.substring(digits, n - i + 1, F.lit(1)).cast("int") + 1 + F.when(i % 2 == 0, 10).otherwise(0)),
    )
    return total % 10 == 0


def _good(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, p.substr(-3, 3).cast("int")), F.lit(999)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _test(kind: str) -> Callable[[Column], Column]:
    return lambda s: _good(kind, s["value"])


def _of_kind(k: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), s["value"].alias("value"))


def base_spans(text: Column) -> Column:
    """array of SPAN, by start, then kind."""
    parts = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        spans = F.filter(found_in(text, pattern), _test(kind))
        spans = F.transform(spans, _of_kind(k))
        empty = F.array().cast(f"array<{SPAN}>")
        parts.append(F.when(F.rlike(text, F.lit(HINTS[kind])), spans).otherwise(empty))
    return F.array_sort(F.concat(*parts))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def words_of(text: Column) -> Column:
    """The text's distinct terms in lower case: runs of letters, marks and digits; where a script sets no blanks between words, all
    pairs of neighbours in the run."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(TERM), F.lit(0))
    return F.array_distinct(F.when(F.rlike(low, F.lit(DENSE)), F.flatten(F.transform(runs, lambda r: F.transform(_parts(r), lambda p: p["value"])))).otherwise(runs))


def _parts(run: Column) -> Column:
    """array<struct<at, value>>: the run itself, or its pairs where its script sets no blanks."""
    whole = F.array(F.struct(F.lit(0).alias("at"), run.alias("value")))
    pairs = F.transform(F.sequence(F.lit(0), F.length(run) - 2), lambda i: F.struct(i.alias("at"), F.substring(run, i + 1, F.lit(2)).alias("value")))
    return F.when(F.rlike(run, F.lit(f"^{DENSE}")) & (F.length(run) > 2), pairs).otherwise(whole)


def masked(text: Column, spans: Column) -> Column:
    """The text with blanks in place of the spans, so that every other character stays where it is."""

    def step(acc: Column, s: Column) -> Column:
        start, end = F.greatest(acc["at"], s["start"]), F.greatest(acc["at"], s["end"])
        part = F.concat(F.substring(text, acc["at"] + 1, start - acc["at"]), F.repeat(F.lit(" "), end - start))
        return F.struct(end.alias("at"), F.array_append(acc["parts"], part).alias("parts"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    return F.aggregate(spans, first, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def disclosures(docs: DataFrame, spans: DataFrame, occurrences: DataFrame, *, share: float, contexts: int) -> DataFrame:
    """(kind, entity, term, share, points, outside) of the terms that disclose entities, over all documents: points is the share of
    the documents with the term that have the entity, outside the number of the others.

    docs has text; spans has row, text and clean (the text without base spans) of the documents with entities;
    occurrences is near() of them. A document gives an entity and each of its terms one context, the
    surroundings of the entity's first place, and terms near other places of the entity those as well.
    """
    entities = occurrences.groupBy("kind", "entity").agg(F.count_distinct("row").alias("n_e"), F.count_distinct("context").alias("n_c"))
    # no term has more contexts than its entity
    entities = cut_lineage(entities.where(F.col("n_c") >= contexts).drop("n_c"))
    known = entities.count()
    if not known:
        return entities.select("kind", "entity", F.lit("").alias("term"), F.lit(0.0).alias("share"), F.lit(0.0).alias("points"), F.lit(0).cast("long").alias("outside"))
    seen = occurrences.join(F.broadcast(entities) if known <= 20_000 else entities, ["kind", "entity"])
    whole = seen.groupBy("row", "kind", "entity").agg(F.min_by("context", "start").alias("context"))
    whole = whole.join(spans.select("row", words_of(F.col("clean")).alias("terms")), "row").select("kind", "entity", "context", "terms", F.lit(1).alias("n"))
    each = whole.unionByName(seen.select("kind", "entity", "context", "terms", F.lit(0).alias("n"))).select("kind", "entity", "context", "n", F.explode("terms").alias("term"))
    together = each.groupBy("kind", "entity", "term").agg(F.sum("n").alias("n_et"), F.count_distinct("context").alias("contexts"))
    together = together.where(F.col("contexts") >= contexts).join(F.broadcast(entities) if known <= 20_000 else entities, ["kind", "entity"])
    number = docs.count()
    # counted before the join: a row for each word and task is shuffled, however many terms are wanted
    words = docs.select(F.explode(words_of(F.col("text"))).alias("term"), F.lit(1).alias("k"))
    # words of the entities themselves don't count
    own = spans.select(F.explode(F.array_except(words_of(F.col("text")), words_of(F.col("clean")))).alias("term"), F.lit(-1).alias("k"))
    frequencies = words.unionByName(own).groupBy("term").agg(F.sum("k").alias("n_t"))
    information = F.log(F.lit(float(number)) / F.col("n_e"))
    mutual = F.log(F.lit(float(number)) * F.col("n_et") / (F.col("n_e").cast("double") * F.col("n_t")))
    # an entity of every document holds no information to disclose
    scored = together.join(frequencies, "term").withColumn("share", F.when(information > 0, mutual / information).otherwise(0.0))
    return scored.where(F.col("share") >= share).select("kind", "entity", "term", "share", (F.col("n_et") / F.col("n_t")).alias("points"), (F.col("n_t") - F.col("n_et")).alias("outside"))


def near(spans: DataFrame, reach: int) -> DataFrame:
    """(row, kind, entity, start, context, terms) of every base span: its surroundings within `reach` code points
    on either side, as a digest, and the distinct whole terms in them."""
    each = spans.select("row", "text", "clean", F.explode("found").alias("s"))
    low = F.greatest(F.col("s.start") - reach, F.lit(0))
    left = lambda c: F.substring(c, low + 1, F.col("s.start") - low)
    right = lambda c: F.substring(c, F.col("s.end") + 1, F.lit(reach))
    # a word that the reach cuts is no whole one
    before = F.when(low > 0, F.regexp_replace(left("clean"), r"^[\p{L}\p{M}\p{N}]+", "")).otherwise(left("clean"))
    after = F.when(F.length("clean") > F.col("s.end") + reach, F.regexp_replace(right("clean"), r"(?<![\p{L}\p{M}\p{N}])[\p{L}\p{M}\p{N}]++\z", "")).otherwise(right("clean"))
    entity = F.when(F.col("s.kind") == 0, F.lower("s.value")).otherwise(F.regexp_replace("s.value", r"[^0-9.]", ""))
    return each.select("row", F.col("s.kind").alias("kind"), entity.alias("entity"), F.col("s.start").alias("start"), F.xxhash64(left("text"), right("text")).alias("context"), words_of(F.concat(before, F.lit(" "), after)).alias("terms"))


def places(texts: DataFrame) -> DataFrame:
    """(row, term, start, end) of the terms of `told` wherever they stand in `clean`, for (row, clean, told), and of other
    terms in the same runs.

    Signs are set around the runs that hold one, so that only those become rows. Positions are running sums over
    rows, as arrays that grow by a place each would take the square of a long text's places.
    """
    clean = F.translate("clean", OPEN + CLOSE, "  ")
    runs = F.arrays_zip(F.split(clean, TERM, -1).alias("gap"), F.regexp_extract_all(clean, F.lit(TERM), F.lit(0)).alias("run"))
    has = lambda run: F.exists(_parts(run), lambda p: F.array_contains("told", F.lower(p["value"])))
    marked = F.transform(runs, lambda x: F.concat(x["gap"], F.when(x["run"].isNull(), "").when(has(x["run"]), F.concat(F.lit(OPEN), x["run"], F.lit(CLOSE))).otherwise(x["run"])))
    parts = texts.select("row", F.split(F.array_join(marked, ""), f"[{OPEN}{CLOSE}]", -1).alias("parts")).where(F.size("parts") > 2)
    pairs = F.transform(F.sequence(F.lit(1), F.size("parts") - 2, F.lit(2)), lambda k: F.struct(F.length(F.element_at("parts", k)).alias("gap"), F.element_at("parts", k + 1).alias("run")))
    found = parts.select("row", F.posexplode(pairs).alias("at", "p")).select("row", "at", "p.gap", "p.run")
    upto = F.sum(F.col("gap") + F.length("run")).over(Window.partitionBy("row").orderBy("at"))
    found = found.withColumn("start", (upto - F.length("run")).cast("int"))
    each = found.select("row", "start", F.explode(_parts(F.col("run"))).alias("p"))
    start = F.col("start") + F.col("p.at")
    return each.select("row", F.lower("p.value").alias("term"), start.alias("start"), (start + F.length("p.value")).alias("end"))


def _holding(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(__digest, text, told) of the documents that hold any of the terms (term), each text once, with those that it holds."""
    some = wanted.select("term").limit(MOST_TERMS + 1).collect()
    texts = docs.where("text is not null").select("text", F.md5("text").alias("__digest"))
    if len(some) <= MOST_TERMS:  # as literals, no word is shuffled
        return texts.withColumn("told", F.array_intersect(words_of(F.col("text")), F.array(*(F.lit(r.term) for r in some)))).where(F.size("told") > 0).dropDuplicates(["__digest"])
    words = texts.select("__digest", F.explode(words_of(F.col("text"))).alias("term")).join(wanted.select("term"), "term", "left_semi")
    return texts.dropDuplicates(["__digest"]).join(words.groupBy("__digest").agg(F.collect_set("term").alias("told")), "__digest")


def find_personal(docs: DataFrame, into: tuple[str, str] = ("__found", "__terms"), *, share: float = 0.8, contexts: int = 3, reach: int = 60, elsewhere: float = 0.9) -> DataFrame:
    """The table with two more columns (into): base spans, and disclosing terms, whose value is the share.

    Terms count, and are found, anywhere in the documents that hold their entity; `reach` only says which
    surroundings of an entity are one context. A term is found in documents without the entity too, if at least
    `elsewhere` of the documents with the term have the entity: there it points to somebody who isn't named. Terms
    depend on the text and the corpus alone, so they are joined back by the text's digest. A null text is empty and
    has no spans; repeated rows have equal spans; a table without entities, or an empty one, has none; other
    columns pass unchanged.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base, terms = into
    found = docs.withColumn(base, base_spans(text))
    with_any = found.where(F.size(base) > 0).select(F.monotonically_increasing_id().alias("row"), F.col("text"), F.col(base).alias("found"))
    with_any = cut_lineage(with_any.withColumn("clean", masked(F.col("text"), F.col("found"))))
    occurrences = cut_lineage(near(with_any, reach))
    telling = cut_lineage(disclosures(docs, with_any, occurrences, share=share, contexts=contexts))
    none = F.array().cast(f"array<{SPAN}>")
    if telling.isEmpty():
        return found.withColumn(terms, none)
    # the words of a row that tell of an entity which is there: never all terms of an entity beside each of its rows
    there = occurrences.select("row", "kind", "entity").distinct().join(telling.select("kind", "entity").distinct(), ["kind", "entity"], "left_semi")
    held = with_any.join(there.select("row").distinct(), "row", "left_semi").select("row", F.explode(words_of(F.col("clean"))).alias("term"))
    told = held.join(telling.select("kind", "entity", "term", "share"), "term").join(there, ["row", "kind", "entity"], "left_semi")
    told = cut_lineage(told.groupBy("row", "term").agg(F.max("share").alias("share")))
    digested = with_any.withColumn("__digest", F.md5("text"))
    once = digested.join(told.select("row").distinct(), "row", "left_semi").groupBy("__digest").agg(F.min("row").alias("row"))
    of_row = told.groupBy("row").agg(F.collect_list("term").alias("told"))
    hits = places(with_any.join(once, "row").select("row", "clean").join(of_row, "row")).join(told, ["row", "term"]).join(once, "row").select("__digest", "start", "end", "share")
    wide = cut_lineage(telling.where((F.col("outside") > 0) & (F.col("points") >= elsewhere)).groupBy("term").agg(F.max("share").alias("share")))
    if not wide.isEmpty():
        others = _holding(docs, wide).withColumn("clean", masked(F.col("text"), base_spans(F.col("text"))))
        others = cut_lineage(others.select("__digest", "clean", "told").withColumn("row", F.monotonically_increasing_id()))
        more = places(others.select("row", "clean", "told")).join(wide, "term").join(others.select("row", "__digest"), "row")
        hits = hits.unionByName(more.select("__digest", "start", "end", "share")).groupBy("__digest", "start", "end").agg(F.max("share").alias("share"))
    digest, told_terms = unused(found, "__digest", "__told")
    hits = hits.groupBy(F.col("__digest").alias(digest)).agg(F.array_sort(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", F.col("share").cast("string").alias("value")))).cast(f"array<{SPAN}>").alias(told_terms))
    hits = cut_lineage(hits)
    both = found.withColumn(digest, F.md5(text)).join(small_side(hits, 2_000), digest, "left").drop(digest)
    return both.withColumn(terms, F.coalesce(told_terms, none)).drop(told_terms)


def personal_spans(docs: DataFrame, **options: float) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans) for every row of (doc_id, text)."""
    all_found = find_personal(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **options)
    count = lambda k: F.size(F.filter("__found", lambda s: s["kind"] == k)).cast("long")
    return all_found.select(
        "doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])), F.size("__terms").cast("long").alias("n_term"), F.sha2(joined(F.col("__found")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("__found", "__terms"))).alias("spans"),
    )


def sanitise(docs: DataFrame, *, remove: float = 0.95, **options: float) -> DataFrame:
    """The table with personal data replaced in text: [EMAIL], [IP], [CARD], [PHONE] for pattern spans; disclosing
    terms are removed at a share of `remove` or more, else generalised to [TERM]. Spans that begin inside an
    earlier one are covered by its replacement. Texts without spans, and nulls, are unchanged.
    """
    base, terms = unused(docs, "__found", "__terms")
    found = find_personal(docs, (base, terms), **options)
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    tag = lambda s: F.when((s["kind"] == 4) & (s["value"].cast("double") >= remove), F.lit("")).otherwise(tags[s["kind"]])
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        ahead = s["start"] >= acc["at"]
        more = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), tag(s))
        return F.struct(F.when(ahead, s["end"]).otherwise(F.greatest(acc["at"], s["end"])).alias("at"), F.when(ahead, F.array_append(acc["parts"], more)).otherwise(acc["parts"]).alias("parts"))

    spans = F.array_sort(F.concat(base, terms))
    folded = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")), step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    clean = F.when(F.size(base) + F.size(terms) > 0, folded).otherwise(text)
    return found.withColumn("text", clean).drop(base, terms)
