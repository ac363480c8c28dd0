"""Lines of keys and values for builds, merges and searches: slow ones always, others one in `rate`."""

from __future__ import annotations

import logging
import random
import time
from collections.abc import Iterator
from contextlib import contextmanager

LOG = logging.getLogger("gramquarry")
#: When an event is slow, and how many fast ones share a line.
SLOW_MS = 500
RATE = 100


def line(tag: str, **fields: object) -> str:
    """[tag] key=value ..., in the order given."""
    return " ".join([f"[{tag}]", *(f"{k}={'null' if v is None else v}" for k, v in fields.items())])


def due(ms: float, rate: int = RATE) -> bool:
    """Whether an event that took so long gets a line."""
    return ms >= SLOW_MS or rate <= 1 or random.randrange(rate) == 0


@contextmanager
def timed(tag: str, event: str, rate: int = RATE, **fields: object) -> Iterator[dict]:
    """Logs the block as a line; fields may be added to the dictionary. Slow events are warnings."""
    began, more = time.monotonic(), {}
    try:
        yield more
    finally:
        ms = round(1000 * (time.monotonic() - began))
        if due(ms, rate):
            LOG.log(logging.WARNING if ms >= SLOW_MS else logging.INFO, line(tag, event=event, **fields, **more, ms=ms))
