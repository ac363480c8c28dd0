import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gramquarry.config import BytesMode, Level, block_complete, target_level
from gramquarry.functions import binary


def starts(n, width, step):
    if n == 0:
        return []
    if n < width:
        return [0]
    found = list(range(0, n - width + 1, step))
    return found + [n - width] * (found[-1] != n - width)


@pytest.mark.parametrize("n", [0, 1, 3, 31, 32, 33, 58, 59, 60, 128])
def test_windows(spark, n):
    value = bytes(range(n))
    row = spark.createDataFrame([(bytearray(value),)], "v binary").select(binary.index_windows(F.col("v")).alias("w")).first()
    assert [(w.start, bytes(w.term)) for w in row.w] == [(s, value[s : s + 32]) for s in starts(n, 32, 27)]


def test_windows_of_nothing_and_bad_arguments(spark):
    row = spark.createDataFrame([(None,)], "v binary").select(binary.index_windows(F.col("v")).alias("w")).first()
    assert row.w == []
    with pytest.raises(ValueError):
        binary.windows(F.col("v"), 0, 1)


@given(st.binary(max_size=40))
@settings(max_examples=200, deadline=None)
def test_slices_cover_the_pattern(q):
    slices = binary.query_slices(q)
    assert slices == list(dict.fromkeys(q[s : s + 5] for s in starts(len(q), 5, 3)))
    assert all(s in q for s in slices)


def test_known_slices():
    assert binary.query_slices(b"400998") == [b"40099", b"00998"]
    assert binary.query_slices(b"4009980000") == [b"40099", b"99800", b"80000"]
    assert binary.query_slices(b"") == []


def test_buckets(spark):
    values = [b"\x01\x02", b"abc", b"\xffabc", b"abcde", b"", b"abcdefg"]
    rows = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "i int, v binary").select("i", binary.bucket(F.col("v")).alias("b")).orderBy("i").collect()
    got = [r.b for r in rows]
    assert got[:3] == [(2 << 24) | 0x0102, (3 << 24) | 0x616263, (4 << 24) | 0x616263]
    assert got[3] == binary.bucket_of(b"abcde") and got[3] >> 24 == 5
    assert got[4:] == [None, None]
    key = binary.pack_key(F.lit(3), F.lit(42))
    assert tuple(spark.range(1).select(*binary.unpack_key(key)).first()) == (3, 42)


def test_hex_mode(spark):
    one = lambda text: spark.createDataFrame([(text,)], "t string").select(binary.to_bytes(F.col("t"), BytesMode.HEX).alias("b")).first().b
    assert bytes(one(" 0a Bc\n")) == b"\x0a\xbc"
    assert bytes(one("")) == b""
    assert one(None) is None
    for bad in ("abc", "zz"):
        with pytest.raises(Exception, match="hex text"):
            one(bad)
        with pytest.raises(ValueError, match="hex text"):
            binary.pattern_bytes(bad, BytesMode.HEX)
    with pytest.raises(ValueError):
        BytesMode(99)


@pytest.mark.parametrize(("group", "level", "hot", "order", "gone", "budget"), [(1, 1, True, 7, False, 2), (42, 7, True, 1, True, 0), (999, 100, False, 3, False, 5)])
def test_term_layout_round_trip(spark, group, level, hot, order, gone, budget):
    parts = [F.lit("c.é"), F.lit(42), F.lit(group), F.lit(level), F.lit(hot), F.lit(order), F.lit(gone), F.lit(budget), F.lit(bytearray(b"ab\x00\xff"))]
    t = spark.range(1).select(binary.encode_term(*parts).alias("s"), binary.search_prefix(*parts[:6]).alias("p")).select("p", "s", binary.decode_term(F.col("s")).alias("t")).first()
    assert t.t.asDict() == {"column": "c.é", "index_id": 42, "group_id": group, "level": level, "hot": hot, "term_index": order, "is_del": gone, "budget": budget, "payload": bytearray(b"ab\x00\xff")}
    assert bytes(t.s).startswith(bytes(t.p))


def test_printable(spark):
    values = [None, b"", b"hello", b"\xff\xfe"]
    rows = spark.createDataFrame([(i, v if v is None else bytearray(v)) for i, v in enumerate(values)], "i int, v binary").orderBy("i").select(binary.printable(F.col("v")).alias("p")).collect()
    assert [r.p for r in rows] == ["null", "", "hello", "fffe"]


def test_policy(spark):
    cases = [(20000, 10, 4), (9000, 10, 3), (5000, 10, 2), (500, 500, 1), (100, 100000, 4), (100, 50000, 3)]
    rows = spark.createDataFrame(cases, "terms long, docs long, want int").select("want", target_level(F.col("terms"), F.col("docs")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)
    full = [(1.0, 100, 100, False), (1.0, 3000, 0, True), (1.0, 0, 600, True), (3.0, 8000, 0, True)]
    rows = spark.createDataFrame(full, "rate double, docs long, terms long, want boolean").select("want", block_complete(F.col("rate"), F.lit(int(Level.LOW)), F.col("docs"), F.col("terms")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_five_byte_hashes(spark):
    """The published test vectors, and the column's hash against that of literals."""
    known = {b"": 0, b"test": 0xBA6BD213, b"Hello, world!": 0xC0363E43, b"The quick brown fox jumps over the lazy dog": 0x2E4FF723}
    assert {k: binary.hash32_of(k) for k in known} == known
    rng = __import__("random").Random(4)
    values = [bytes(rng.randrange(256) for _ in range(5)) for _ in range(500)] + [b"\xff" * 5, b"\0" * 5]
    rows = spark.createDataFrame([(bytearray(v),) for v in values], "v binary").select("v", binary.hash32(F.col("v")).alias("h"), binary.bucket(F.col("v")).alias("b")).collect()
    assert all(r.h == binary.hash32_of(bytes(r.v)) and r.b == binary.bucket_of(bytes(r.v)) for r in rows)


def test_keys_without_groups(spark):
    parts = [F.lit("c"), F.col("i"), F.col("i") * 7, F.lit(1), F.lit(True), F.lit(3), F.lit(False), F.lit(2), F.lit(bytearray(b"ab"))]
    rows = spark.range(3).select(F.col("id").cast("int").alias("i")).select(binary.without_group(binary.encode_term(*parts)).alias("k"), F.when(F.col("i") == 0, binary.encode_term(*parts)).alias("zero")).collect()
    assert len({bytes(r.k) for r in rows}) == 1
    assert bytes(rows[0].k) in {bytes(r.zero) for r in rows if r.zero}
