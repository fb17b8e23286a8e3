"""Named queries: key -> (Spark plan, SQL that must give the same rows)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallyframe.session import configure

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    key: str
    build: Build
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(key: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        if key in _QUERIES:
            raise ValueError(f"query {key} is defined twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        _QUERIES[key] = Query(key, run, sql)
        return build

    return register


def all_queries() -> dict[str, Query]:
    from tallyframe.plans import (  # noqa: F401
        analytics,
        checks,
        extraction,
        mailbox,
        reporting,
        stores,
        streams,
        workflow,
    )

    return dict(_QUERIES)
