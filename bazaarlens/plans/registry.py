"""Queries by name, each with the SQL it is checked against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bazaarlens.plans.fixtures import SHARED, TABLES, VIEWS

SPREAD_SETTING = "bazaarlens.input.partitions"
SPREAD = ("lineitem", "orders", "documents", "events", "pages", "conversations")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Tables and derived views of one data folder; each is built once per query."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._built: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._built:
            if name in TABLES:
                self._built[name] = self._table(name)
            else:
                needs, sql = SHARED.get(name) or VIEWS[name]
                self._built[name] = self.spark.sql(sql, **{n: self(n) for n in needs})
        return self._built[name]

    def _table(self, name: str) -> DataFrame:
        """The table as read. Where the session says so (a local one over single small files does),
        its rows are dealt out again, whatever the size of the table."""
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        spread = int(self.spark.conf.get(SPREAD_SETTING, "0"))
        return df.repartition(spread) if spread and name in SPREAD else df


def with_views(names: list[str], body: str) -> str:
    """The body after WITH clauses for the named views and all they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in TABLES or name in ordered:
            return
        needs, _ = VIEWS[name]
        for need in needs:
            add(need)
        ordered.append(name)

    for name in names:
        add(name)
    parts = [
        f"{name} AS ({VIEWS[name][1].format(**{n: n for n in VIEWS[name][0]})})" for name in ordered
    ]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(parts + [body[len("WITH RECURSIVE") :]])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts + [body[len("WITH ") :]])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


def query(name: str, views: list[str] | None = None, oracle: str | None = None):
    """Register a query over ``Inputs``; ``views`` are the views the oracle text refers to."""

    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if oracle is not None:
            ORACLES[name] = with_views(views or [], oracle)
        return fn

    return register
