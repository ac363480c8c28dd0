"""Secret scans: labelled patterns, and random strings exposed by their low token efficiency.

A byte-pair vocabulary spends few tokens on language and many on random strings, so the characters per
token of a candidate string separate the two. Known digests (hexadecimal strings of digest lengths,
labelled digests), identifiers (UUIDs, dotted or slashed names, words joined by signs, numbers, timestamps)
are excluded before the test.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, islice, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramquarry.llm.common import texts

#: Fixed by the contract.
ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORD = re.compile(r"(?ai:passw|secret|token|api_?key)")
KINDS = ("assign", "access", "hex", "random")

#: Shorter random strings are as short as model names, versions and codes that are not words either.
LEAST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
#: Lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hexadecimal.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
DIGEST_LABEL = re.compile(r"(?ai:(?:md5|sha-?(?:1|224|256|384|512)|digest|checksum|integrity|fingerprint)[\"']?[\x20:=-]*[\"']?)\Z")
#: The same label as the beginning of the string itself.
DIGEST_INSIDE = re.compile(r"(?ai:md5|sha-?(?:1|224|256|384|512)|digest|checksum|integrity|fingerprint)[+/_=-]")
#: Words joined by signs: identifiers, paths and options.
IDENTIFIER = re.compile(r"[+/_=-]*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[+/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[+/_=-]*")
NUMBER = re.compile(r"[0-9+/_=-]+")
#: ISO 8601, or its part before the first colon.
TIMESTAMP = re.compile(r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}T[0-9]{2}[0-9-]*(?:Z|\+[0-9]+)?")

FOUND = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


class Vocabulary:
    """A tiktoken vocabulary from its file of ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.encoding = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def characters_per_token(self, text: str) -> float:
        return len(text) / len(self.encoding.encode_ordinary(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the labelled patterns; failing matches are dropped where they were found."""
    out = []
    if KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def is_random(text: str, start: int, end: int, run: int, vocabulary: Vocabulary, most: float) -> bool:
    """Whether text[start:end], a part of the run of key characters that begins at `run`, is a random string by
    the token-efficiency test."""
    s = text[start:end].strip("=/+-_")
    if len(s) < LEAST or NUMBER.fullmatch(s) or TIMESTAMP.fullmatch(s) or IDENTIFIER.fullmatch(s):
        return False
    if HEX_ONLY.fullmatch(s) and len(s) in DIGEST_LENGTHS or DIGEST_LABEL.search(text, max(0, run - 24), run) or DIGEST_INSIDE.match(text, run):
        return False
    return vocabulary.characters_per_token(s) < most


def candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, start of the run) of the strings to test: what taken spans (sorted) and UUIDs leave of the runs of key characters."""
    ends = list(accumulate((e for _, e in taken), max))
    for m in CANDIDATE.finditer(text):
        at, k = m.start(), bisect_right(ends, m.start())  # spans that end before the run don't matter
        gone = sorted([*((u.start(), u.end()) for u in UUID.finditer(text, m.start(), m.end())), *takewhile(lambda s: s[0] < m.end(), islice(taken, k, None))])
        for start, end in gone:
            if start > at:
                yield at, start, m.start()
            at = max(at, end)
        if at < m.end():
            yield at, m.end(), m.start()


def scan(text: str, vocabulary: Vocabulary, most: float) -> list[tuple[int, int, int]]:
    """All spans of a text in order: the labelled ones, and the random strings in what they leave over."""
    spans = sorted(base_spans(text))
    more = [(start, 3, end) for start, end, run in candidates(text, [(s, e) for s, _, e in spans]) if is_random(text, start, end, run, vocabulary, most)]
    return sorted(spans + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, ranks: str, pattern: str, *, most: float = 2.0) -> DataFrame:
    """FOUND columns for every row of (doc_id, text).

    Spans are code points with the end exclusive. A null or empty text has no spans (base_sha256 is
    that of the empty string). Rows are independent: repeated rows give equal results, a null doc_id
    stays null, an empty table gives no rows, other columns are ignored. Whole texts are scanned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(ranks, pattern)
        names = [c.split()[0] for c in FOUND.split(", ")]
        for batch in batches:
            ids, at = batch.column(0), 0
            for some in texts(batch.column(1)):
                found = [scan(t, vocabulary, most) for t in some]
                counts = [[sum(k == kind for _, k, _ in spans) for spans in found] for kind in range(4)]
                base = [hashlib.sha256(joined([x for x in spans if x[1] < 3]).encode()).hexdigest() for spans in found]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(some)), *(pa.array(c, pa.int64()) for c in counts), pa.array(base), pa.array([joined(s) for s in found])], names=names)
                at += len(some)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)
