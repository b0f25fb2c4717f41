"""Every query of the repository with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, tuple[Query, str | None]]:
    """``name -> (Spark query, oracle SQL or None)``."""
    from . import cleaning, effect, profile, segment

    found: dict[str, tuple[Query, str | None]] = {}
    for module in (segment, cleaning, profile, effect):
        found.update(module.QUERIES)
    return found
