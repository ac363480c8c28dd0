"""Vector bin packing of instruction data into training sequences.

Documents become token pieces; pieces that fill a sequence alone keep it, and the rest are packed
under simultaneous limits on tokens, segment count and loss-bearing tokens by the dot-product
heuristic: an open sequence takes the fitting piece whose demand vector has the largest dot product
with the sequence's remaining capacity.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramquarry.llm.common import cut_lineage, texts

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss long"
#: Entries of a worker's cache of encoded chunks; it is emptied when full.
CACHE = 500_000


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The byte-level vocabulary splits a text before every single blank between non-blanks, so the
    chunks between blanks encode independently and a cache of chunks serves most of a text. Texts
    in which blanks touch each other, and those with a special token's string, are encoded as a whole.
    The vocabulary's file of ranks gives the same ids as its tokenizer file, several times as fast; special
    tokens are in the latter alone and are cut out of the text before anything else, as there.
    """

    def __init__(self, ranks: str, pattern: str, special: dict[str, int] | None = None):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        coding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens=special or {})
        self.encode, self.with_special, self.special = coding.encode_ordinary, lambda t: coding.encode(t, allowed_special="all"), tuple(special or ())
        self.cache: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return array("I", self.with_special(text)).tobytes()
        first, *rest = text.split(" ")
        if "" in rest:
            return self.whole(text)
        cache, whole = self.cache, self.whole
        found = list(map(cache.get, rest))
        if None in found:
            if len(cache) > CACHE:
                cache.clear()
            for i, known in enumerate(found):
                if known is None:
                    chunk = rest[i]
                    known = cache.get(chunk)
                    if known is None:
                        known = whole(" " + chunk)
                        if len(chunk) < 64:
                            cache[chunk] = known
                    found[i] = known
        return whole(first) + b"".join(found)


def cuts(bears: np.ndarray, tokens: int, loss: int) -> list[int]:
    """Where pieces of a document begin, and its end: each as long as `tokens` ids and `loss` loss-bearing ones allow."""
    upto = np.concatenate([[0], np.cumsum(bears)])
    at = [0]
    while at[-1] < len(bears):
        at.append(min(at[-1] + tokens, int(np.searchsorted(upto, upto[at[-1]] + loss, side="right")) - 1))
    return at


def pieces(docs: DataFrame, ranks: str, pattern: str, *, tokens: int = 2048, loss: int = 2048, end_id: int = 1, special: dict[str, int] | None = None, prompt_column: str | None = None) -> DataFrame:
    """Token pieces of (doc_id, text), each as long as the limits on ids and loss-bearing ids allow.

    A document is its text's ids followed by end_id, so an empty or null text is one id. Loss-bearing are all
    ids of a document but its first, which nothing precedes; with a prompt column, which says how many code points
    the text begins with are a prompt, only those that come after the prompt (null: none; the prompt and the
    rest are encoded apart, and the end id bears loss).
    """
    if loss < 1 or tokens < 1:
        raise ValueError("limits must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(ranks, pattern, special), np.asarray([end_id], dtype="<u4").tobytes()
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            prompts = batch.column(2).to_pylist() if prompt_column else None
            for some in texts(batch.column(1)):
                rows: list[tuple] = []
                for k, (doc, text) in enumerate(zip(ids[at : at + len(some)], some, strict=True), at):
                    asked = max(0, prompts[k] or 0) if prompts else 0
                    head = encode(text[:asked]) if asked else b""
                    data = head + encode(text[asked:]) + end
                    n, first = len(data) // 4, max(1, len(head) // 4) if not prompts or asked else 0
                    if loss >= tokens:  # only the number of ids cuts
                        at_ids = [*range(0, n, tokens), n]
                    else:
                        at_ids = cuts(np.arange(n) >= first, tokens, loss)
                    for s, e in zip(at_ids[:-1], at_ids[1:], strict=True):
                        rows.append((doc, s, e - s, zlib.crc32(data[4 * s : 4 * e]), n, max(0, e - max(s, first))))
                at += len(some)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    prompt = [F.col(prompt_column).cast("long").alias("prompt")] if prompt_column else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *prompt).mapInArrow(run, PIECES)


def fill(demand: np.ndarray, capacity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in the bin of each row of demand (items by resources), one bin open at a time.

    Demands and capacities are scaled by the capacity. The open bin takes the fitting item of the
    largest dot product with its remaining capacity, ties by row number, until none fits. Items of
    one demand vector are interchangeable, so the choice runs over distinct vectors.
    """
    if (demand > capacity).any():
        raise ValueError("an item is larger than an empty sequence")
    kinds, kind = np.unique(demand, axis=0, return_inverse=True)
    order = np.argsort(kind, kind="stable")
    begin = np.searchsorted(kind[order], np.arange(len(kinds)))
    left = np.bincount(kind, minlength=len(kinds))
    taken = np.zeros(len(kinds), dtype=np.int64)
    scaled = kinds / capacity
    alive = np.arange(len(kinds))
    bins, places = np.zeros(len(demand), dtype=np.int64), np.zeros(len(demand), dtype=np.int64)
    used, number, placed, room = 0, 0, 0, capacity.astype(np.int64).copy()
    while placed < len(demand):
        ok = alive[(kinds[alive] <= room).all(axis=1)]
        if not len(ok):
            number, used, room = number + 1, 0, capacity.astype(np.int64).copy()
            continue
        k = ok[np.argmax(scaled[ok] @ (room / capacity))]
        item = order[begin[k] + taken[k]]
        bins[item], places[item] = number, used
        used += kinds[k][0]
        room = room - kinds[k]
        taken[k] += 1
        left[k] -= 1
        placed += 1
        if not left[k]:
            alive = alive[alive != k]
    return bins, places


def pack(items: DataFrame, *, tokens: int = 2048, segments: int = 1024, loss: int = 2048, group_rows: int = 2048, rows: int) -> DataFrame:
    """Sequence and offset of every piece (PIECES columns); `rows` is a count of items.

    Pieces of exactly `tokens` ids have a sequence of their own and aren't shuffled for it; the others
    are dealt by hash to about rows / group_rows groups of bounded size, each packed in one task from
    its lengths alone. Which group a piece falls in depends on the piece, not on a source or key, so a
    hot source spreads evenly. Sequence ids are group * 2^31 + number for packed and negative for full
    ones (by Spark's partition and row, as the pieces are stored), so that they never meet.
    """
    capacity = np.array([tokens, segments, loss], dtype=np.int64)
    groups = max(1, -(-rows // group_rows))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["length", "doc_id", "start", "ids_crc32"], ignore_index=True)
        bins, places = fill(np.column_stack([df.length, np.ones(len(df), dtype=np.int64), df.loss]), capacity)
        df["sequence_id"] = df.g * (1 << 31) + bins
        df["offset"] = places
        return df[[x.split()[0] for x in PACKED.split(", ")]]

    full = F.col("length") == tokens
    whole = items.where(full).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "loss")
    rest = items.where(~full).withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return whole.unionByName(rest.groupBy("g").applyInPandas(run, PACKED))


def pack_documents(
    docs: DataFrame, ranks: str, pattern: str, *, tokens: int = 2048, segments: int = 1024, loss: int | None = None, end_id: int = 1, special: dict[str, int] | None = None, prompt_column: str | None = None
) -> DataFrame:
    """Every document's pieces with their places in sequences of at most `tokens` ids, `segments` pieces and
    `loss` loss-bearing ids (None: as many as ids).

    Null or empty texts are a single end id; a null doc_id is kept as null; equal rows are packed
    each; an empty table gives no rows; only doc_id, text and the prompt column of the table are read.
    """
    loss = tokens if loss is None else loss
    items = cut_lineage(pieces(docs, ranks, pattern, tokens=tokens, loss=loss, end_id=end_id, special=special, prompt_column=prompt_column))
    return pack(items, tokens=tokens, segments=segments, loss=loss, rows=items.count())
