"""Quality classifier from weak labels: heuristic labellers, expectation-maximisation, a hashed linear scorer.

Labellers vote good, bad or nothing on each document. Expectation-maximisation over the counts of vote
patterns, taken over all documents, estimates each labeller's accuracies; the posterior labels of a bounded
sample train a logistic scorer over hashed words and word shapes, which scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from gramquarry.llm.common import cut_lineage, mix64, texts, unused
from gramquarry.llm.minhash import word_hashes

LABELLERS = ("signs", "tables", "capitals", "shouting", "plain_words", "word_length", "repetition", "echoes", "sentences")
BITS = 15
#: Shape classes of bytes: capital, small, digit, white space, UTF-8 continuation and leads as small letters; other signs are themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 65, 98, 48, 98
PLAIN = re.compile(r"(?<!\S)[\"'(]?[^\W\d_]+[\"')]?[.,;:!?]?(?!\S)")
SENTENCE_END = re.compile(r"[.!?](?:\s|$)")


def votes(text: str) -> str:
    """A letter for each labeller: g(ood), b(ad) or - where it has no opinion."""
    words = text.split()
    n = len(words)
    if not n:
        return "-" * len(LABELLERS)
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    upper = int(((data >= 65) & (data <= 90)).sum())
    letters = upper + int(((data >= 97) & (data <= 122)).sum()) + int((data >= 192).sum())
    signs = int(np.isin(data, np.frombuffer(b"#$%&*@^~=+<>{}[]\\_", dtype=np.uint8)).sum())
    bars, shouts = text.count("|"), text.count("!")
    ends, plain = len(SENTENCE_END.findall(text)), len(PLAIN.findall(text))

    def vote(bad: bool, good: bool) -> str:
        return "b" if bad else "g" if good else "-"

    few = n < 12  # too short for shares to mean much
    distinct = len(set(words)) / n
    lines = Counter(text.split("\n"))
    echoes = sum(map(eq, words, words[1:])) + sum((k - 1) * len(x.split()) for x, k in lines.items() if k > 1)
    return "".join(
        (
            vote(signs > 0.5 * n, signs < 0.05 * n),
            vote(bars > 0.15 * n, bars == 0),
            vote(letters > 0 and upper > 0.5 * letters and n > 3, letters > 0 and upper < 0.2 * letters),
            vote(shouts > 0.25 * n, shouts < 0.05 * n),
            vote(plain < 0.7 * n, plain > 0.9 * n),
            vote(letters > 14 * n or (letters < 2 * n and not few), 3 * n <= letters <= 10 * n),
            vote(not few and distinct < 0.2, not few and distinct > 0.35),
            vote(not few and echoes > 0.2 * n, not few and echoes < 0.05 * n),
            vote(not few and ends < 0.01 * n, not few and ends >= 0.03 * n and shouts < 0.05 * n),
        )
    )


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers and their shares: words in the lower half, word shapes in the upper,
    and in the first 16 numbers how often the words repeat."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    words = word_hashes(text)
    shape_bytes = _CLASS[data]
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (shape_bytes[1:] != shape_bytes[:-1]) | (shape_bytes[1:] < 48)  # runs of one class count once
    shapes = word_hashes(shape_bytes[keep].tobytes().decode("ascii"))
    half = np.uint64(64 - BITS + 1)
    # how much of the text a word's repeats take, for texts long enough to tell
    same = (words >> np.uint64(52)).astype(np.int64)
    repeats = np.minimum(np.floor(-np.log2(np.bincount(same)[same] / len(words))), 15).astype(np.uint64) if len(words) >= 12 else words[:0]
    where = np.concatenate([mix64(words) >> half, (mix64(shapes) >> half) + np.uint64(1 << (BITS - 1)), repeats]).astype(np.int64)
    share = np.concatenate([np.full(len(x), 1 / max(1, len(x))) for x in (words, shapes, repeats)])
    return where, share


def estimate(patterns: dict[str, int], rounds: int = 200) -> tuple[float, np.ndarray, dict[str, float]]:
    """Share of good documents, (labeller, class, vote) probabilities, and each pattern's posterior of good.

    The labellers are taken as independent given the class. The start says what they are made for: each finds
    some kind of bad document and seldom a good one, so a bad vote weighs more than a good one. Votes are
    smoothed by one, so that an empty table or an unused vote has a defined result.
    """
    names = sorted(patterns)
    counts = np.array([patterns[p] for p in names], dtype=np.float64)
    code = np.array([["gb-".index(v) for v in p] for p in names], dtype=np.int64).reshape(len(names), len(LABELLERS))
    prior = 0.8
    table = np.empty((len(LABELLERS), 2, 2))
    table[:, 0], table[:, 1] = (0.98, 0.02), (0.6, 0.4)
    posterior = np.full(len(names), prior)
    for _ in range(rounds):
        known = np.concatenate([np.log(table), np.zeros((len(LABELLERS), 2, 1))], axis=2)  # no opinion says nothing
        log = known[np.arange(len(LABELLERS))[None, :], :, code].sum(axis=1) + np.log([prior, 1 - prior])
        new = 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -50, 50)))
        done = np.abs(new - posterior).max(initial=0.0) < 1e-9
        posterior = new
        weight = np.stack([posterior, 1 - posterior]) * counts
        for vote in range(2):
            table[:, :, vote] = np.stack([(weight * (code[:, k] == vote)).sum(axis=1) + 1 for k in range(len(LABELLERS))]) if len(names) else table[:, :, vote]
        table /= table.sum(axis=2, keepdims=True)
        prior = float(np.clip((weight[0].sum() + 1) / (counts.sum() + 2), 0.02, 0.98))
        if done:
            break
    return prior, table, dict(zip(names, posterior.tolist(), strict=True))


def train(rows: list[Row], passes: int = 60, rate: float = 4.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic weights and bias from (text, posterior) rows: full-batch AdaGrad in row order, classes weighed alike."""
    weights, bias = np.zeros(1 << BITS), 0.0
    y = np.array([r.posterior for r in rows])
    if not len(y) or y.sum() < 1e-9 or (1 - y).sum() < 1e-9:
        return weights, 0.0 if not len(y) else float(np.where(y.mean() >= 0.5, 2.0, -2.0))
    found = [features(r.text or "") for r in rows]
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(w) for w, _ in found])
    where, share = np.concatenate([w.astype(np.int32) for w, _ in found]), np.concatenate([s.astype(np.float32) for _, s in found])
    del found
    balance = y / (2 * y.sum()) + (1 - y) / (2 * (1 - y).sum())
    seen, seen_bias = np.full(1 << BITS, 1e-6), 1e-6
    for _ in range(passes):
        score = np.bincount(row, weights=weights[where] * share, minlength=len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - y) * balance
        step = np.bincount(where, weights=error[row] * share, minlength=1 << BITS) + decay * weights
        seen += step * step
        seen_bias += error.sum() ** 2
        weights -= rate * step / np.sqrt(seen)
        bias -= 0.5 * error.sum() / np.sqrt(seen_bias)
    return weights, float(bias)


def fitting(rows: list[Row], room: int) -> list[Row]:
    """Rows in their order, those skipped that no longer fit in the room for characters; the shortest if none fits."""
    out = []
    for r in rows:
        if r.n <= room:
            out.append(r)
            room -= r.n
    return out or sorted(rows, key=lambda r: (r.n, r.h))[:1]


def classify(docs: DataFrame, into: str = "__score", *, sample_rows: int = 3000, sample_chars: int = 4_000_000) -> DataFrame:
    """The table with one more column (into), the scorer's probability that the row's text is good.

    At most `sample_rows` documents train the scorer, half of them of either posterior label where there are so
    many, chosen by a hash of the text so that reruns agree, and at most `sample_chars` characters of
    them, half of either label (where no text of a label fits, the shortest that was chosen); everything else runs over all documents. The only tables on the driver are the sample and the
    counts of vote patterns, at most 3^9.

    Null, empty and blank texts get no votes and score by the bias alone. Repeated rows score alike. An
    empty table gives no rows. Other columns pass unchanged.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [votes(t) for some in texts(batch.column(0)) for t in some]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), batch.column(1), batch.column(2)], names=["pattern", "h", "n"])

    order = F.xxhash64("text")
    voted = cut_lineage(docs.select("text", order.alias("h"), F.coalesce(F.length("text"), F.lit(0)).alias("n")).mapInArrow(vote, "pattern string, h long, n int"))
    patterns = {r.pattern: r["count"] for r in voted.groupBy("pattern").count().collect()}  # 3^9 at most
    prior, _, posterior = estimate(patterns)
    # the sample: hashes of the chosen texts, then the texts themselves
    table = docs.sparkSession.createDataFrame([(p, float(q)) for p, q in posterior.items()], "pattern string, posterior double")
    known = voted.where("n > 0").join(F.broadcast(table), "pattern")
    picked = []
    for good in (True, False):
        some = known.where(F.col("posterior") >= 0.9 if good else F.col("posterior") <= 0.1).select("h", "n", "posterior").distinct()
        chosen = some.orderBy(F.xxhash64("h"), "h").limit(sample_rows // 2).collect()  # sample_rows at most
        picked += [(r.h, r.posterior) for r in fitting(chosen, sample_chars // 2)]
    wanted = docs.sparkSession.createDataFrame(picked, "h long, posterior double").dropDuplicates(["h"])
    rows = docs.select("text", order.alias("h")).join(F.broadcast(wanted), "h").groupBy("h").agg(F.min("text").alias("text"), F.first("posterior").alias("posterior")).orderBy("h").collect()
    weights, bias = train(rows)
    bias += float(np.log(prior / (1 - prior)))  # training weighed the classes alike
    held = docs.sparkSession.sparkContext.broadcast((weights, bias))  # 2^15 weights

    names = docs.columns
    schema = docs.select("*", F.lit(0.0).alias(into)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        for batch in batches:
            scores = []
            for some in texts(batch.column(names.index("text"))):
                for t in some:
                    where, share = features(t)
                    scores.append(float(1 / (1 + np.exp(-np.clip(weights[where] @ share + bias, -50, 50)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, into])

    return docs.mapInArrow(score, schema)


def quality_scores(docs: DataFrame, *, threshold: float = 0.3, **options: int) -> DataFrame:
    """(doc_id, score, kept) for every row of (doc_id, text)."""
    scored = classify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **options)
    return scored.select("doc_id", F.col("__score").alias("score"), (F.col("__score") >= threshold).alias("kept"))


def keep_good(docs: DataFrame, *, threshold: float = 0.3, **options: int) -> DataFrame:
    """The rows that the scorer keeps, with the table's own columns. The threshold lies below even odds: a clean
    document that goes is worse than a poor one that stays."""
    (score,) = unused(docs, "__score")
    return classify(docs, score, **options).where(F.col(score) >= threshold).drop(score)
