"""Cached frames that are let go when the work that made them ends."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame

_kept: ContextVar[list[DataFrame] | None] = ContextVar("kept", default=None)


def kept(df: DataFrame) -> DataFrame:
    """`df` cached, until the enclosing `letting_go` ends; outside of one until the caller unpersists it."""
    df = df.cache()
    if (now := _kept.get()) is not None:
        now.append(df)
    return df


@contextmanager
def letting_go() -> Iterator[None]:
    """Unpersist at the end what was `kept` inside; results must have been collected or written by then."""
    token = _kept.set([])
    try:
        yield
    finally:
        for df in _kept.get():
            df.unpersist()
        _kept.reset(token)
