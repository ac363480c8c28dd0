"""The pipeline's stages on the small table: what each must keep, drop and change."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gramquarry.llm import minhash, mixing
from gramquarry.llm.common import cut_lineage, table


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = cut_lineage(stage(spark, docs, sf))
        out.append((name, docs, after))
        docs = after
    return out


def test_columns_stay_to_the_last_stage(stages):
    for name, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes, name
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(stages[-1][2].columns)


def test_quality_keeps_clean_documents(spark, sf, stages):
    _, before, after = stages[0]
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    kept = {r.doc_id for r in after.collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    components = {r.doc_id: r.component_id for r in minhash.near_duplicates(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(components.values()))


def test_no_addresses_are_left(stages):
    _, before, after = stages[2]
    old = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert len(rows) == len(old)
    for r in rows:
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r.text)
        assert r.n_chars == len(r.text)
        if "[" not in r.text:
            assert r.text == old[r.doc_id]
    assert any("[EMAIL]" in r.text or "[PHONE]" in r.text or "[CARD]" in r.text or "[IP]" in r.text for r in rows)


def test_copies_follow_the_mix(stages):
    _, before, after = stages[3]
    want = {r.doc_id: int(r.taken / r.size + 0.5) for r in mixing.mix(before).collect() if r.size}
    got = {}
    for r in after.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in want.items() if n}


def test_every_copy_is_packed(stages):
    _, before, after = stages[4]
    pieces = after.toPandas()
    starts = pieces[pieces.start == 0].groupby("doc_id").size().to_dict()
    copies = {}
    for r in before.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert starts == copies
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048


def test_words_follow_the_targets(stages):
    """Whole copies: each source's words come within its longest document and a few percent of its target."""
    _, before, after = stages[3]
    target = {r.source: (r.target, r.longest) for r in mixing.mix(before).join(before.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("target"), F.max("size").alias("longest")).collect()}
    words = {r.source: r.n for r in after.groupBy("source").agg(F.sum(mixing.words_in(F.col("text"))).alias("n")).collect()}
    for source, (want, longest) in target.items():
        assert abs(words.get(source, 0) - want) <= 3 * longest + 0.05 * want, source


LONG = "word another thing more text here. " * 4000
EDGES = [(1, None), (2, ""), (3, "  \n\t"), (4, "one"), (5, LONG), (6, "A plain sentence of several words stands here. And one more."), (6, "A plain sentence of several words stands here. And one more."), (6, "Another text under the same number, with other words in it."), (None, "A plain sentence of several words stands here. And one more."), (None, None), (7, "Mail a@b.org now or call +1 (132) 555-0135."), (8, "é😀 ñ \x00"), (None, "Mail a@b.org now or call +1 (132) 555-0135.")]
NAMES = ("__score", "__found", "__terms", "__digest", "__told", "__copies", "__of", "__copy", "row", "node", "size", "key", "share", "term", "h", "pattern")


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(i, t, None if k % 4 == 0 else "en", ("s", None, "t")[k % 3], None if t is None else len(t), *(f"{name}{k}" for name in NAMES)) for k, (i, t) in enumerate(EDGES)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_edges(spark, sf, edges, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, edges.limit(0), sf).count() == 0
    out = stage(spark, edges, sf)
    rows = out.collect()
    if name == "packing":
        assert sum(r.start == 0 for r in rows) == len(EDGES) and sum(r.doc_id is None and r.start == 0 for r in rows) == 3
        return
    assert out.dtypes == edges.dtypes
    # what a row brings besides its text and length stays with it
    known = {tuple(r[n] for n in ("doc_id", "lang", "source", *NAMES)) for r in edges.collect()}
    assert all(tuple(r[n] for n in ("doc_id", "lang", "source", *NAMES)) in known for r in rows)
    if name == "near_dedup":
        assert sorted(map(str, [r.doc_id for r in rows])) == sorted(map(str, [i for i, _ in EDGES]))  # no id is near another; those without one are in no group
    if name == "personal_data":
        assert len(rows) == len(EDGES)
        assert sorted(r.text or "" for r in rows if "EMAIL" in (r.text or "")) == ["Mail [EMAIL] now or call [PHONE]."] * 2
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    if name == "mixing":
        assert all((r.text or "").split() for r in rows)
    if name == "quality":
        assert {4, 6} <= {r.doc_id for r in rows}


def test_whole_pipeline_on_edges(spark, sf, edges):
    docs = edges
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, sf))
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
