"""Constants of the index and its sizing policy."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gram lengths, windows and names that results depend on.
NGRAM_MIN, NGRAM_MAX = 1, 5
INDEX_WINDOW, INDEX_STEP = 32, 27
QUERY_WINDOW, QUERY_STEP = 5, 3
SUFFIXES = ("_bfp", "_sfp")
DEFAULT_COLUMN = "d"
MARKER = "@@jsonkey@@"
FORMAT_VERSION = 7
NO_INDEX_TERMS = 128
HIT_BAND, HIT_TIERS = 50, 16
DOCS_PER_TERM = 5


class Level(IntEnum):
    """How many terms a group is sized for; NONE is a group too small to index."""

    NONE = 0
    LOW = 1
    MID = 2
    HIGH = 3
    TOP = 4


# Fixed values of the policy, by level from LOW to TOP.
LEVEL_TERMS = {Level.LOW: 512, Level.MID: 4096, Level.HIGH: 8192, Level.TOP: 16384}
OVER_RATE = {Level.LOW: 1.4, Level.MID: 1.3, Level.HIGH: 1.2, Level.TOP: 1.1}
HOT_THRESHOLD = {Level.LOW: 4, Level.MID: 8, Level.HIGH: 16, Level.TOP: 32}
LAYER_THRESHOLD = {Level.LOW: 16, Level.MID: 24, Level.HIGH: 32, Level.TOP: 48}


class BytesMode(IntEnum):
    """How text becomes bytes."""

    UTF8 = 1
    HEX = 2


def by_level(level: Column, values: dict[Level, int | float]) -> Column:
    """A level's value; an unknown level has the lowest level's."""
    out = F.lit(values[Level.LOW])
    for key in (Level.MID, Level.HIGH, Level.TOP):
        out = F.when(level == int(key), F.lit(values[key])).otherwise(out)
    return out


def target_level(terms: Column, docs: Column) -> Column:
    """The level for a column of so many distinct terms and documents, by whichever is larger in proportion."""
    size = F.greatest(F.floor(docs / DOCS_PER_TERM), terms.cast("long"))
    out = F.when(size >= LEVEL_TERMS[Level.TOP], int(Level.TOP)).when(size >= LEVEL_TERMS[Level.HIGH], int(Level.HIGH))
    return out.when(size >= LEVEL_TERMS[Level.MID], int(Level.MID)).otherwise(int(Level.LOW))


def block_complete(rate: Column, level: Column, docs: Column, terms: Column) -> Column:
    """Whether a group is full: either of its counts reaches the level's, times rate."""
    least = by_level(level, LEVEL_TERMS)
    return (docs >= least * DOCS_PER_TERM * rate) | (terms >= least * rate)
