import random

import pytest
from pyspark.sql import functions as F

from gramquarry import logs
from gramquarry.config import Level
from gramquarry.functions.binary import bucket_of, query_slices
from gramquarry.functions.sql import register
from gramquarry.operators import mining
from gramquarry.operators.ordering import out_of_order, ranked
from gramquarry.plans.index import FpIndex
from gramquarry.plans.search import match, scan_search
from gramquarry.session import shared_folder
from gramquarry.sources import columns
from gramquarry.streaming.ingest import VersionedIndex


def found(df):
    return sorted(r.doc_id for r in df.collect())


def source(spark, values):
    return spark.createDataFrame([(d, c, bytearray(v)) for d, c, v in values], "doc_id long, column string, value binary")


def closed_form(values, column, q):
    slices = query_slices(q)
    docs = {}
    for d, c, v in values:
        if c == column:
            docs.setdefault(d, set()).update(s for s in slices if s in v)
    return sorted(d for d, got in docs.items() if slices and len(got) == len(slices))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(1, 9))) for _ in range(25)]
    values = [(d, "a", b"".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for d in range(300)]
    values += [(d, "a", rng.choice(words)) for d in range(0, 300, 7)]  # several values of a document
    return values + [(d, "b", b"only here \xc3\xa9" + str(d).encode()) for d in range(40)]


@pytest.fixture(scope="module")
def built(spark, corpus):
    return FpIndex.build(source(spark, corpus))


def test_index_and_scan_equal_the_closed_form(spark, corpus, built):
    rng, rows = random.Random(6), source(spark, corpus)
    values = [v for _, c, v in corpus if c == "a" and len(v) > 12]
    for n in (1, 5, 6, 9, 14):
        v = rng.choice(values)
        at = rng.randrange(0, max(1, len(v) - n))
        q = v[at : at + n]
        want = closed_form(corpus, "a", q)
        assert want
        assert found(scan_search(rows, "a", q)) == want
        assert found(built.search("a", q)) == want
    exact = sorted({d for d, c, x in corpus if c == "a" and q in x})
    assert found(built.search("a", q, mode="exact", source=rows)) == exact == found(scan_search(rows, "a", q, mode="exact"))


def test_columns_are_apart_and_absent_patterns_find_nothing(spark, corpus, built):
    assert found(built.search("b", b"only here")) == list(range(40))  # a group too small for an index
    assert found(built.search("a", b"only here")) == []
    assert found(built.search("a", b"")) == found(scan_search(source(spark, corpus), "a", b"")) == []
    assert found(built.search("nowhere", b"ab")) == []


def test_write_read_merge_delete(spark, corpus, built, tmp_path):
    built.write(str(tmp_path / "i"), row_group_bytes=65536)
    stored = FpIndex.read(spark, str(tmp_path / "i"))
    q = next(v for _, c, v in corpus if c == "a" and len(v) > 12)[:9]
    want = closed_form(corpus, "a", q)
    assert found(stored.search("a", q)) == want
    gone = {d for d in want[::2]} | set(range(10))
    left = stored.delete(spark.createDataFrame([(d,) for d in gone], "doc_id long"))
    assert found(left.search("a", q)) == [d for d in want if d not in gone]
    spark.createDataFrame([("a", 0, 1, 0, 1, 1, False, 6)], "column string, group_id int, target_level byte, hot_count long, common_count long, doc_count long, passed boolean, format_version int").write.mode("overwrite").parquet(str(tmp_path / "i/fp_block"))
    with pytest.raises(ValueError, match="format version"):
        FpIndex.read(spark, str(tmp_path / "i"))


def scanned(df):
    """Rows that each file scan of an executed plan gave, after pruning of files, row groups and pages, by table."""
    df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], {}
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif hasattr(node, "plan") and name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            table = node.relation().location().rootPaths().head().getName()
            out[table] = out.get(table, 0) + node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_a_lookup_reads_few_rows(spark, tmp_path):
    """Files and row groups are pruned by group, ordinal and bucket; a scan of the source reads everything."""
    rows = spark.range(30000).select(F.col("id").alias("doc_id"), F.lit("n").alias("column"), F.col("id").cast("string").cast("binary").alias("value"))
    rows.write.parquet(str(tmp_path / "source"))
    FpIndex.build(rows).write(str(tmp_path / "i"), row_group_bytes=4096)
    index, source = FpIndex.read(spark, str(tmp_path / "i")), spark.read.parquet(str(tmp_path / "source"))
    for q in ("12345", "2987", "777"):
        found_rows = index.search("n", q)
        want = [i for i in range(30000) if q in str(i)]
        assert found(found_rows) == want == found(scan_search(source, "n", q))
        assert scanned(found_rows)["fp_posting"] < 0.35 * index.posting.count()
        near = index._near("n", query_slices(q.encode()))
        assert scanned(near)["fp_index"] < 0.2 * index.index.count()
    assert sum(scanned(scan_search(source, "n", "12345")).values()) == 30000
    assert scanned(index.search("n", "12345"))["fp_posting"] < 0.1 * 30000
    assert {r.violations for r in index.violations().collect()} == {0}


def test_order_violations_are_seen(spark, tmp_path):
    spark.createDataFrame([(1,), (3,), (2,), (4,)], "k int").coalesce(1).write.parquet(str(tmp_path / "t"))
    assert [r.k for r in out_of_order(spark.read.parquet(str(tmp_path / "t")), ("k",)).collect()] == [2]


def test_few_and_many_candidates_agree(spark, corpus, built, monkeypatch):
    values = [v for _, c, v in corpus if c == "a" and len(v) > 12]
    patterns = [values[k][k : k + n] for k, n in enumerate((1, 4, 6, 11))]
    want = [closed_form(corpus, "a", q) for q in patterns]
    assert [found(built.search("a", q)) for q in patterns] == want
    monkeypatch.setattr("gramquarry.plans.index.MOST_KEYS", 0)
    assert [found(built.search("a", q)) for q in patterns] == want


def test_a_scan_answers_what_the_index_is_not_worth(spark, corpus, built):
    rows = source(spark, corpus)
    for column, q in (("a", b"ab"), ("b", b"only"), ("a", b"a\x00b")):
        assert found(built.search(column, q, source=rows)) == closed_form(corpus, column, q)


def test_full_groups_pass_through_a_merge(spark):
    rng = random.Random(9)
    values = [(d, "a", bytes(rng.choices(b"abcdefgh", k=rng.randrange(6, 20)))) for d in range(2400)]
    parts = [source(spark, [v for v in values if v[0] % 2 == k]) for k in range(2)]
    versions = [FpIndex.build(p, level=Level.LOW) for p in parts] + [FpIndex.build(source(spark, [(9000 + i, "a", b"small one %d" % i) for i in range(200)]))]
    values += [(9000 + i, "a", b"small one %d" % i) for i in range(200)]
    gone = spark.createDataFrame([(d,) for d in range(0, 2400, 24)], "doc_id long")
    for deleted in (None, gone):
        whole = FpIndex.merge(versions, deleted=deleted)
        left = [v for v in values if deleted is None or v[0] % 24 or v[0] >= 2400]
        for q in (values[5][2][:6], values[900][2][1:8], b"one 19", b"abc"):
            assert found(whole.search("a", q)) == closed_form(left, "a", q)
        fates = FpIndex.fates(versions, deleted=deleted).collect()
        passed = sum(r.passed for r in fates)
        assert passed >= 2 and not any(r.passed for r in fates if r.index_id == 2)
        assert [r.passed for r in whole.write_counters().collect()] == [passed]
        assert whole.block.select("column", "group_id").distinct().count() == whole.block.count()
        if deleted is None:  # ordinals, budgets and tombstones of a passed group stay
            first = min((r for r in fates if r.passed), key=lambda r: (r.index_id, r.group_id))
            columns_ = ("tier", "term_index", "is_del", "budget", "payload")
            old = versions[first.index_id].term.where(F.col("group_id") == first.group_id).select(*columns_)
            assert sorted(map(tuple, old.collect())) == sorted(map(tuple, whole.term.where("group_id = 0").select(*columns_).collect()))
    assert sum(r.ingested + r.merged_common for r in FpIndex.provenance(versions).collect()) == len({v for _, _, v in values})


def test_hot_threshold_and_tombstones(spark):
    for n, want in ((4, True), (3, False)):
        t = spark.createDataFrame([("c", bytearray(b"xab" + bytes([97 + i]))) for i in range(n)], "column string, term binary")
        hot = mining.hot_grams(mining.gram_rows(t, ("column",)), 4, ("column",))
        assert (hot.where(F.col("gram") == F.lit(bytearray(b"ab"))).count() == 1) is want
    t = spark.createDataFrame([("c", bytearray(b"abc" + bytes([i]))) for i in range(4)], "column string, term binary")
    rows = mining.gram_rows(t, ("column",))
    top = mining.maximal(mining.hot_occurrences(rows, mining.hot_grams(rows, 4, ("column",)), ("column",)), ("column",))
    assert {bytes(r.gram) for r in top.collect()} == {b"abc"}


def test_markers(spark):
    cases = [("@@jsonkey@@user.name@@bob@@x", "user.name", "bob@@x"), ("@@jsonkey@@@@v", "", "v"), ("@@jsonkey@@open", "d", "@@jsonkey@@open"), ("a@@b", "d", "a@@b"), ("", "d", ""), (None, None, None), ("@@jsonkey@@k@@a\nb", "k", "a\nb")]
    name, rest = columns.marked_parts(F.col("t"))
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, n string, r string").select("n", "r", name.alias("name"), rest.alias("rest")).collect()
    assert all((r.n, r.r) == (r.name, r.rest) for r in rows)
    assert [columns.is_search_field(x) for x in ("content_bfp", "title_sfp", "content_bfp_extra", "bfp", None)] == [True, True, False, False, False]


def test_json_columns_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id long, j string")
    assert columns.from_json(df, "id", "j").count() == 0
    assert found(FpIndex.build(columns.from_json(df, "id", "j")).search("k", b"abc")) == []


def test_sql_surface(spark):
    register(spark)
    assert [bytes(r.slice) for r in spark.sql("SELECT * FROM fp_slices(CAST('400998' AS BINARY)) ORDER BY at").collect()] == [b"40099", b"00998"]
    row = spark.sql("SELECT fp_contains(CAST('abc' AS BINARY), CAST('bc' AS BINARY)) a, fp_contains(CAST('abc' AS BINARY), CAST('' AS BINARY)) b, size(fp_windows(CAST('abcdefgh' AS BINARY), 5, 3)) n, fp_bucket(CAST('abc' AS BINARY)) k, fp_bucket(CAST('abcde' AS BINARY)) m").first()
    assert tuple(row) == (True, False, 2, (3 << 24) | 0x616263, bucket_of(b"abcde"))


def test_stream_versions_and_compaction(spark, tmp_path):
    rows = [(i, f'{{"k": "value {i}", "other": "x"}}') for i in range(30)]
    for part in range(2):
        spark.createDataFrame(rows[part * 15 : part * 15 + 15], "id long, j string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, j string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    index = VersionedIndex(spark, str(tmp_path / "versions"), most_batches=1)
    index.ingest(stream, str(tmp_path / "checkpoint"), lambda df: columns.from_json(df, "id", "j")).awaitTermination()
    assert len(index.versions()) == 2
    want = sorted(i for i in range(30) if "value 1" in f"value {i}")
    assert found(index.search("k", "value 1")) == want
    whole = index.compact(str(tmp_path / "one"), spark.createDataFrame([(1,)], "doc_id long"))
    assert found(whole.search("k", "value 1")) == [i for i in want if i != 1]


def test_batches_wait_until_a_version_is_due(spark, tmp_path):
    index = VersionedIndex(spark, str(tmp_path / "v"), most_batches=3)
    batch = lambda k: source(spark, [(10 * k + i, "c", b"value %d" % (10 * k + i)) for i in range(10)])
    assert found(index.search("c", "value 1")) == []
    assert not index.flush()
    made = [index.add(batch(k), k) for k in range(5)]
    assert made == [False, False, True, False, False] and index.versions() == [2]
    want = [i for i in range(50) if "value 1" in f"value {i}"]
    assert found(index.search("c", "value 1")) == want  # versions and what waits
    index.add(batch(4), 4)  # replayed
    assert found(index.search("c", "value 1")) == want
    assert index.finish() and index.versions() == [2, 4] and index.pending().isEmpty()
    assert found(index.search("c", "value 1")) == want


def test_a_full_column_makes_a_version(spark, tmp_path):
    index = VersionedIndex(spark, str(tmp_path / "v"))
    rows = spark.range(18100).select(F.col("id").alias("doc_id"), F.lit("c").alias("column"), F.col("id").cast("string").cast("binary").alias("value"))
    assert not index.add(rows.where("id < 17000".replace("id", "doc_id")), 0)
    assert index.due() is False
    rows.where("doc_id >= 17000").write.parquet(str(tmp_path / "v/pending/b=1"))
    assert index.due()


def test_formats(spark, tmp_path):
    rows = [(1, "one"), (2, "två")]
    df = spark.createDataFrame(rows, "id int, t string")
    for kind in ("parquet", "json", "csv", "orc"):
        df.write.format(kind).option("header", True).save(str(tmp_path / kind))
        back = columns.read(spark, str(tmp_path / kind), kind, **({"header": "true"} if kind == "csv" else {}))
        assert sorted((int(r.id), r.t) for r in back.collect()) == rows
    df.select("t").coalesce(1).write.text(str(tmp_path / "text"))
    assert sorted(r.value for r in columns.read(spark, str(tmp_path / "text"), "text").collect()) == ["one", "två"]
    assert columns.read(spark, str(tmp_path / "text/*.txt"), "binaryFile").select("content").count() == 1
    with pytest.raises(ValueError, match="unknown format"):
        columns.read(spark, "x", "jdbc")


def test_text_filters_reach_the_scan(spark, sf):
    plan = lambda q, **o: match(spark.read.parquet(f"{sf}/documents.parquet"), "text", q, **o).select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(text,whole word)" in plan("whole word", mode="exact")
    assert plan("of the ent").count("StringContains") >= 3
    cut = "é" * 5  # ten bytes: a slice of five cuts a character
    rows = [(1, cut), (2, "é" * 3), (3, None), (4, "x" + cut)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(match(df, "text", cut)) == [1, 2, 4] and found(match(df, "text", cut, mode="exact")) == [1, 4]


def test_ranks_over_whole_columns(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(10**6), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(9)
    out = ranked(df, ("k",), ("v", "i"), "rank").collect()
    for k in "ab":
        want = sorted((v, i) for x, v, i in rows if x == k)
        assert [(r.v, r.i) for r in sorted((r for r in out if r.k == k), key=lambda r: r["rank"])] == want
        assert sorted(r["rank"] for r in out if r.k == k) == list(range(1, len(want) + 1))
    assert ranked(df.limit(0), ("k",), ("v",)).count() == 0


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_log_lines(caplog):
    assert logs.line("write", event="x", n=None) == "[write] event=x n=null"
    assert logs.due(logs.SLOW_MS) and logs.due(1, 1)
    assert 0 < sum(logs.due(1) for _ in range(20_000)) < 1000
    with caplog.at_level("INFO", "gramquarry"), logs.timed("search", "lookup", 1, column="c") as more:
        more["hits"] = 3
    assert caplog.messages[0].startswith("[search] event=lookup column=c hits=3 ms=")
