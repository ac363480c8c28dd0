"""Every operator over nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from gramquarry.llm import embedding_dedup, gif, licenses, minhash, mixing, packing, pii, quality, quotes, secret_scan
from tests.oracles import duck

LONG = "word another thing more text here. " * 6000
TEXTS = [None, "", "   \n\t", "one", "the same text of several words here", "the same text of several words here", LONG, "é😀 ñ x", "\x00\x01\x02", "a" * 70000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, size long, row long, h long, bucket long, start long, fp string, leaf long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ("s1", None, "s2")[i % 3], len(t or ""), "k", 1, 1, 1, 1, 1, 1, "f", 1) for i, t in enumerate(TEXTS)]
    rows += [(None, "the same text of several words here", None, None, None, None, None, None, None, None, None, None, None, None), rows[4]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


TIK = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
RUNS = {
    "secrets": lambda d: secret_scan.find_secrets(d, *TIK),
    "media": gif.payload_media,
    "pii": pii.personal_spans,
    "minhash": minhash.near_duplicates,
    "mix": mixing.mix,
    "licenses": licenses.scan_licenses,
    "quality": quality.quality_scores,
}


@pytest.mark.parametrize("name", RUNS)
def test_one_row_for_each_and_none_for_none(name, docs, empty):
    out = RUNS[name](docs).toPandas()
    assert len(out) == len(TEXTS) + 2
    assert out.doc_id.isna().sum() == 1
    columns = [c for c in out.columns if c not in ("doc_id", "component_id", "kept", "taken", "target", "source_size")]
    same = out[out.doc_id.isin([4, 5])]
    assert same[columns].drop_duplicates().shape[0] == 1, "equal texts, equal values"
    assert RUNS[name](empty).count() == 0


def test_pieces_of_edges(docs, empty):
    out = packing.pack_documents(docs, *TIK).toPandas()
    assert out[out.doc_id == 0].doc_tokens.tolist() == [1]
    assert len(out[out.doc_id == 4]) == 2
    assert out[out.doc_id == 6].length.sum() == out[out.doc_id == 6].doc_tokens.iloc[0]
    assert packing.pack_documents(empty, *TIK).count() == 0


def test_vectors(spark):
    one, other = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(0, one), (1, one), (2, [2.0, 0.1, 0.0]), (3, other), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [float("inf"), 1.0, 0.0]), (9, []), (10, [1.0, 0.0]), (None, one), (3, other)]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("node", F.lit(1)).withColumn("leaf", F.lit("x"))
        out = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(df).collect()}
        assert out == {(0, 2, 0, True), (1, 2, 0, False), (2, 2, 0, False), (3, 1, 3, True), *((i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10)), (None, 0, None, True)}
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_quotes_edges(spark):
    rows = [(1, 0, "u", None), (1, 1, "a", ""), (None, 0, "u", "> quoted text of some length"), (1, None, "u", "> quoted text of some length"), (2, 0, None, ">" * 50000), (2, 1, "u", "> " + LONG), (2, 1, "u", "> " + LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1)).withColumn("at", F.lit(1))
    out = quotes.link_quotes(df).collect()
    assert len(out) == len(rows)
    assert all(r.reply_to is None and r.n_linked == 0 for r in out)
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_licenses_equal_their_sql(spark, sf):
    got = licenses.scan_licenses(spark.read.parquet(f"{sf}/documents.parquet")).toPandas().sort_values("doc_id", ignore_index=True)
    want = duck(sf).sql(licenses.oracle()).df().sort_values("doc_id", ignore_index=True)
    assert got.equals(want[got.columns])
    assert (got.licenses != "").any()


def test_license_rules(spark):
    bsd = [licenses.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")]
    whole, partly, turned = (". ".join(x) + "." for x in (bsd, [bsd[0], bsd[1], bsd[2], bsd[4]], bsd[::-1]))
    df = spark.createDataFrame([(0, whole.upper()), (1, "Unknown sentence. " + partly), (2, turned), (3, "Text.\nReleased under the\nMIT License.  Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    out = {r.doc_id: r.licenses for r in licenses.scan_licenses(df).collect()}
    assert out == {0: "BSD-3-Clause", 1: "BSD-2-Clause", 2: "", 3: "MIT,CC-BY-NC-4.0"}
