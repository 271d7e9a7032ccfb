"""Driver-side helpers: timing of slow operations, and a level for a while."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from gridloom.options import DEFAULTS


def timed(name: str, threshold: float = DEFAULTS.slow_seconds) -> Callable:
    """Decorator: logs calls that take longer than the threshold, failed ones too."""

    def wrap(call: Callable) -> Callable:
        @functools.wraps(call)
        def run(*args, **kwargs):
            start = time.time()
            try:
                return call(*args, **kwargs)
            finally:
                took = time.time() - start
                if took > threshold:
                    logging.getLogger(call.__module__).info("%s took %.2fs", name, took)

        return run

    return wrap


@contextmanager
def log_level(name: str, level: int | None = None) -> Iterator[logging.Logger]:
    """The logger at another level within the block."""
    logger = logging.getLogger(name)
    before = logger.level
    if level is not None:
        logger.setLevel(level)
    try:
        yield logger
    finally:
        logger.setLevel(before)
