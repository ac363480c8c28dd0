"""Bytes as columns: decoding, windows, grams, buckets, and the stored term layout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gramquarry.config import INDEX_STEP, INDEX_WINDOW, NGRAM_MAX, NGRAM_MIN, QUERY_STEP, QUERY_WINDOW, BytesMode

LOW24 = 0xFFFFFF
WORD32 = 0xFFFFFFFF
# Fixed values of the hash.
C1, C2, H_ADD, F1, F2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35


def to_bytes(text: Column, mode: BytesMode | int = BytesMode.UTF8) -> Column:
    """Text as bytes. HEX drops white space and fails on odd lengths and on anything but hexadecimal digits."""
    if BytesMode(mode) == BytesMode.UTF8:
        return text.cast("binary")
    digits = F.regexp_replace(text, r"\s", "")
    odd = F.raise_error(F.lit("hex text must have an even number of digits"))
    bad = F.raise_error(F.lit("hex text has a character that is no hexadecimal digit"))
    return F.when(F.length(digits) % 2 == 1, odd).when(~F.rlike(digits, F.lit("^[0-9A-Fa-f]*$")), bad).otherwise(F.unhex(digits))


def window_starts(size: Column, width: int, step: int) -> Column:
    """Where windows of `width` bytes start in `size` bytes: every step, and once more at the tail."""
    if width <= 0 or step <= 0:
        raise ValueError("window and step must be positive")
    whole = F.array_distinct(F.concat(F.sequence(F.lit(0), size - width, F.lit(step)), F.array(size - width)))
    return F.when(size == 0, F.array().cast("array<int>")).when(size < width, F.array(F.lit(0))).otherwise(whole)


def windows(value: Column, width: int, step: int) -> Column:
    """array<struct<start, term>> of a binary value; null or empty has none."""
    size = F.octet_length(value)
    parts = F.transform(window_starts(size, width, step), lambda s: F.struct(s.alias("start"), F.substring(value, s + 1, F.lit(width)).alias("term")))
    return F.coalesce(parts, F.array().cast("array<struct<start:int,term:binary>>"))


def index_windows(value: Column) -> Column:
    return windows(value, INDEX_WINDOW, INDEX_STEP)


def query_windows(value: Column) -> Column:
    return windows(value, QUERY_WINDOW, QUERY_STEP)


def query_slices(pattern: bytes) -> list[bytes]:
    """A pattern's slices: its query windows, each once, in order."""
    n = len(pattern)
    starts = [] if not n else [0] if n < QUERY_WINDOW else [*range(0, n - QUERY_WINDOW + 1, QUERY_STEP), n - QUERY_WINDOW]
    return list(dict.fromkeys(pattern[s : s + QUERY_WINDOW] for s in starts))


def pattern_bytes(pattern: str | bytes, mode: BytesMode | int = BytesMode.UTF8) -> bytes:
    """A query's pattern as bytes, by the same rules as to_bytes."""
    if isinstance(pattern, bytes):
        return pattern
    if BytesMode(mode) == BytesMode.UTF8:
        return pattern.encode()
    digits = "".join(pattern.split())
    if len(digits) % 2:
        raise ValueError("hex text must have an even number of digits")
    if digits.strip("0123456789abcdefABCDEF"):
        raise ValueError("hex text has a character that is no hexadecimal digit")
    return bytes.fromhex(digits)


def grams(value: Column, least: int = NGRAM_MIN, most: int = NGRAM_MAX) -> Column:
    """All grams of `least` to `most` bytes of a value, with repeats."""
    size = F.octet_length(value)
    none = F.array().cast("array<binary>")
    parts = [F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda s: F.substring(value, s, F.lit(n)))).otherwise(none) for n in range(least, most + 1)]
    return F.coalesce(F.concat(*parts), none)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _times(x: Column, factor: int) -> Column:
    """x * factor modulo 2^32 of numbers below 2^32, by halves, as products of 64 bits would overflow."""
    high = F.shiftleft((F.shiftright(x, 16) * factor).bitwiseAND(F.lit(0xFFFF)), 16)
    return (x.bitwiseAND(F.lit(0xFFFF)) * factor + high).bitwiseAND(F.lit(WORD32))


def _rotated(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftright(x, 32 - bits)).bitwiseAND(F.lit(WORD32))


def hash32(gram: Column) -> Column:
    """MurmurHash3 x86 32-bit, seed 0, of five bytes as a non-negative long: one block of four and a tail of one."""
    number = lambda part: F.conv(F.hex(part), 16, 10).cast("long")
    byte = lambda i: number(F.substring(gram, F.lit(i), F.lit(1)))
    mixed = lambda x: _let(_times(x, C1), lambda k: _let(_rotated(k, 15), lambda r: _times(r, C2)))
    block = byte(1).bitwiseOR(F.shiftleft(byte(2), 8)).bitwiseOR(F.shiftleft(byte(3), 16)).bitwiseOR(F.shiftleft(byte(4), 24))
    body = _let(_let(block, mixed), lambda k: (_rotated(k, 13) * 5 + H_ADD).bitwiseAND(F.lit(WORD32)))
    h = body.bitwiseXOR(_let(byte(5), mixed)).bitwiseXOR(F.lit(5))
    shifted = lambda x, bits: x.bitwiseXOR(F.shiftright(x, bits))
    h = _let(h, lambda x: shifted(x, 16))
    h = _let(_let(h, lambda x: _times(x, F1)), lambda x: shifted(x, 13))
    return _let(_let(h, lambda x: _times(x, F2)), lambda x: shifted(x, 16))


def hash32_of(gram: bytes) -> int:
    """The same hash of literal bytes of any length."""

    def mixed(k: int) -> int:
        k = k * C1 & WORD32
        return (k << 15 | k >> 17) * C2 & WORD32

    h, whole = 0, len(gram) & ~3
    for at in range(0, whole, 4):
        h ^= mixed(int.from_bytes(gram[at : at + 4], "little"))
        h = ((h << 13 | h >> 19) * 5 + H_ADD) & WORD32
    if whole < len(gram):
        h ^= mixed(int.from_bytes(gram[whole:], "little"))
    h ^= len(gram)
    h = (h ^ h >> 16) * F1 & WORD32
    h = (h ^ h >> 13) * F2 & WORD32
    return h ^ h >> 16


def bucket(gram: Column) -> Column:
    """(length << 24) | 24 bits: the low bytes themselves up to 4 bytes, a hash at 5; null at other lengths."""
    size = F.octet_length(gram)
    low = F.when(size < NGRAM_MAX, F.conv(F.hex(gram), 16, 10).cast("long").bitwiseAND(F.lit(LOW24))).otherwise(hash32(gram).bitwiseAND(F.lit(LOW24)))
    return F.when(size.between(NGRAM_MIN, NGRAM_MAX), (F.shiftleft(size.cast("long"), 24).bitwiseOR(low)).cast("int"))


def bucket_of(gram: bytes) -> int | None:
    """The bucket of literal bytes."""
    if not NGRAM_MIN <= len(gram) <= NGRAM_MAX:
        return None
    return len(gram) << 24 | (int.from_bytes(gram, "big") if len(gram) < NGRAM_MAX else hash32_of(gram)) & LOW24


def pack_key(len_idx: Column, bucket_index: Column) -> Column:
    return F.shiftleft(len_idx.cast("long"), 32).bitwiseOR(bucket_index.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def unpack_key(key: Column) -> tuple[Column, Column]:
    return F.shiftright(key, 32).cast("int"), key.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def printable(value: Column) -> Column:
    """UTF-8 text where the bytes are valid, else their hexadecimal digits in lower case; null reads 'null'."""
    text = value.cast("string")
    return F.when(value.isNull(), "null").when(F.is_valid_utf8(text), text).otherwise(F.lower(F.hex(value)))


def _sortable(number: Column, width: int) -> Column:
    """A signed number as big-endian bytes that sort as it does: the sign bit is flipped."""
    bits = 8 * width
    return F.unhex(F.lpad(F.hex((number.cast("long") + (1 << (bits - 1))).bitwiseAND(F.lit((1 << bits) - 1))), 2 * width, "0"))


def _byte(number: Column) -> Column:
    return F.unhex(F.lpad(F.hex(number.cast("long").bitwiseAND(F.lit(255))), 2, "0"))


def encode_term(column: Column, index_id: Column, group_id: Column, level: Column, hot: Column, term_index: Column, is_del: Column, budget: Column, payload: Column) -> Column:
    """The stored layout of a term: name length, name, then index (2), group (4), level (1), flag (1, hot is 0),
    ordinal (4), tombstone (1), budget (1) and payload."""
    name = column.cast("binary")
    return F.concat(
        _sortable(F.octet_length(name), 4), name, _sortable(index_id, 2), _sortable(group_id, 4), _byte(level), _byte(F.when(hot, 0).otherwise(1)), _sortable(term_index, 4), _byte(is_del.cast("int")), _byte(budget), payload
    )


def decode_term(term: Column) -> Column:
    """The struct of a stored term."""

    def number(at: Column, width: int) -> Column:
        return F.conv(F.hex(F.substring(term, at, F.lit(width))), 16, 10).cast("long") - (1 << (8 * width - 1))

    def byte(at: Column) -> Column:
        return F.conv(F.hex(F.substring(term, at, F.lit(1))), 16, 10).cast("int")

    size = number(F.lit(1), 4).cast("int")
    head = size + 5
    return F.struct(
        F.substring(term, F.lit(5), size).cast("string").alias("column"), number(head, 2).cast("int").alias("index_id"), number(head + 2, 4).cast("int").alias("group_id"), byte(head + 6).alias("level"),
        (byte(head + 7) == 0).alias("hot"), number(head + 8, 4).cast("int").alias("term_index"), (byte(head + 12) != 0).alias("is_del"), byte(head + 13).alias("budget"), F.substring(term, head + 14, F.octet_length(term)).alias("payload"),
    )


def search_prefix(column: Column, index_id: Column, group_id: Column, level: Column, hot: Column, term_index: Column) -> Column:
    """The stored term's bytes up to its ordinal, by which it is looked up."""
    whole = encode_term(column, index_id, group_id, level, hot, term_index, F.lit(False), F.lit(0), F.lit(b""))
    return F.substring(whole, F.lit(1), F.octet_length(whole) - 2)


def without_group(term: Column) -> Column:
    """The stored term with index and group as zero: equal for one term of several indexes and groups."""
    size = F.conv(F.hex(F.substring(term, F.lit(1), F.lit(4))), 16, 10).cast("long") - (1 << 31)
    head = size.cast("int") + 4
    return F.concat(F.substring(term, F.lit(1), head), _sortable(F.lit(0), 2), _sortable(F.lit(0), 4), F.substring(term, head + 7, F.octet_length(term)))


def max_hot_payload(budget: Column, anchor_length: Column) -> Column:
    return budget + anchor_length - 1
