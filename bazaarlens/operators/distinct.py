"""Work on texts that many rows share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.core import barrier


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out by number: few bytes can be much work, and partitions are cut by bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def once_per(df: DataFrame, inputs: list[str], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows with the columns that ``build`` makes of the inputs, computed once per distinct inputs.

    ``build`` keeps every row and reads nothing but the inputs; it may replace them. Rows meet their
    result by a 128-bit digest of the inputs.
    """
    digest = F.unhex(F.md5(F.to_json(F.struct(*inputs)).cast("binary")))
    keyed = df.withColumn("_once", barrier(digest))
    built = build(spread(keyed.select("_once", *inputs).distinct()))
    return keyed.drop(*[c for c in built.columns if c != "_once"]).join(built, "_once").drop("_once")
