"""Joins with dimensions of any size, whatever share of the rows a key has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20
MOST_HOT, LEAST_HOT = 10_000, 1000
_OF_VALUE = 16  # bytes counted for a value of fixed width


def lookup(rows: DataFrame, on: dict[str, str], dim: DataFrame, value: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` with the column ``value`` of the row of ``dim`` whose keys (right names of ``on``) are theirs (left names), null where there is none.

    ``dim``, a written table of numbers, has a key once. It is counted first and broadcast if it is small. If it
    is not, keys of more than a ten-thousandth of the rows, at most ``MOST_HOT``, are broadcast, so that
    their rows stay where they are; rows without a key do too; only the others are dealt by key.
    """
    columns = [*rows.columns, value]
    dim = dim.select(*on.values(), value)
    same = [F.col(k) == F.col(v) for k, v in on.items()]
    if dim.count() * _OF_VALUE * len(dim.columns) <= most:
        return rows.join(F.broadcast(dim), same, "left").select(*columns)
    known = F.lit(True)
    for k in on:
        known = known & F.col(k).isNotNull()
    counts = rows.where(known).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot = counts.where(F.col("_n") > max(LEAST_HOT, total // MOST_HOT)).withColumnsRenamed({k: f"_hot_{k}" for k in on}).drop("_n")
    marked = rows.withColumn("_known", known).join(F.broadcast(hot.withColumn("_is_hot", F.lit(True))), [F.col(k) == F.col(f"_hot_{k}") for k in on], "left").drop(*hot.columns)
    heavy = dim.join(F.broadcast(hot), [F.col(v) == F.col(f"_hot_{k}") for k, v in on.items()], "left_semi")
    often = marked.where(F.col("_is_hot") & F.col("_known")).join(F.broadcast(heavy), same, "left").select(*columns)
    seldom = marked.where(F.col("_is_hot").isNull() & F.col("_known")).join(dim, same, "left").select(*columns)
    without = marked.where(~F.col("_known")).withColumn(value, F.lit(None).cast(dim.schema[value].dataType)).select(*columns)
    return often.unionByName(seldom).unionByName(without)
