"""Bindings of the operators to tables, one callable per query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Views of one folder by attribute: t.b_clips. Views that are `ready` are not made again."""

    def __init__(self, spark: SparkSession, sf_dir: str, ready: dict[str, DataFrame] | None = None) -> None:
        self.spark, self.sf_dir, self.ready = spark, sf_dir, ready or {}

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name, self.ready) if name.startswith("b_") else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    """Register a function of Tables as a query, with its oracle where SQL can say it."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return f

    return add


from . import queries_curation, queries_media, queries_metrics, queries_mining, queries_text, queries_timeline  # noqa: E402,F401
