"""Registry of the runnable queries: name, Spark function, expected result as SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
EXPECTED: dict[str, str] = {}


def query(name: str, expected: str | None = None):
    """Registers ``fn(spark, data_dir) -> DataFrame`` and the SQL it has to agree with."""

    def register(fn):
        QUERIES[name] = fn
        if expected is not None:
            EXPECTED[name] = expected.strip()
        return fn

    return register
