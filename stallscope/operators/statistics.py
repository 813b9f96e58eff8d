"""Nine statistics of each duration distribution.

Quartiles are the values at the 0-based places n/4, n/2 and 3n/4 of the sorted durations. They are found
on counts of equal durations, which are written once, and their running totals in blocks of values, so no task sorts a whole
distribution. Rows without a duration or metric do not count. Variance is that of the population. Metrics without a duration have zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import PS_PER_S, metric_dim
from ..functions.ranks import BLOCK_ROWS, in_blocks, ranked

COLUMNS = ("metric", "count", "sum", "min", "max", "mean", "variance", "median", "q25", "q75")


def summarize(found: DataFrame, by: str = "metric", scale: float = PS_PER_S, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each value of ``by`` that ``found`` (by, dur_ps) has."""
    counts = found.where(F.col(by).isNotNull() & F.col("dur_ps").isNotNull()).groupBy(by, "dur_ps").agg(F.count(F.lit(1)).alias("c"))
    return summarize_counts(counts, by, scale, block_rows)


# The sets of dimensions beside the metric.
DRILLS = ((), ("op",), ("pid",), ("comm_id",), ("op", "comm_id"))


def drilldown(found: DataFrame, sets: tuple[tuple[str, ...], ...] = DRILLS, scale: float = PS_PER_S, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The statistics of each metric, and of each part of it by the dimensions of each set, exact quartiles in all: (level, metric, op, pid, comm_id, the statistics).

    ``level`` names the set's dimensions by commas; dimensions outside it are null, as are those that have no value. Grouping sets
    count equal durations in one pass over ``found`` (metric, op, pid, comm_id, dur_ps), and all sets are ranked together.
    """
    dims = ["metric", "op", "pid", "comm_id", "dur_ps"]
    rows = found.where("metric is not null and dur_ps is not null")
    counts = rows.groupingSets([["metric", *s, "dur_ps"] for s in sets], *dims).agg(F.grouping_id().alias("left_out"), F.count(F.lit(1)).alias("c"))
    level = F.lit(None).cast("string")
    for s in sets:
        left_out = sum(1 << (len(dims) - 1 - k) for k, c in enumerate(dims) if c not in ("metric", "dur_ps", *s))
        level = F.when(F.col("left_out") == left_out, ",".join(s)).otherwise(level)
    # Nulls inside a structure are equal, so that a dimension without a value is a part as others are.
    counts = counts.select(F.struct(level.alias("level"), *dims[:-1]).alias("part"), "dur_ps", "c")
    return summarize_counts(counts, "part", scale, block_rows).select("part.*", *COLUMNS[1:])


def summarize_counts(counts: DataFrame, by: str, scale: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The statistics of durations of which ``counts`` (by, dur_ps, c) says how many are equal; written once."""
    counts = in_blocks(counts, "dur_ps", block_rows, "duration-counts")
    d = F.col("dur_ps").cast("decimal(38,0)")
    totals = counts.groupBy(by).agg(F.sum("c").alias("count"), F.sum(d * F.col("c")).alias("total"), F.min("dur_ps").alias("low"), F.max("dur_ps").alias("high"))
    placed = ranked(counts, [by], ["dur_ps"], {"upto": F.col("c")})
    n = F.col("count")
    rows = placed.join(totals, by)
    away = F.col("dur_ps") / F.lit(scale) - F.col("total").cast("double") / F.lit(scale) / n

    def at(place):
        return F.min(F.when(F.col("upto") > place, F.col("dur_ps")))

    stats = rows.groupBy(by).agg(
        F.first("count").alias("count"),
        F.first("total").alias("total"),
        F.first("low").alias("low"),
        F.first("high").alias("high"),
        F.sum(away * away * F.col("c")).alias("squares"),
        at(F.floor(n / 4)).alias("p25"),
        at(F.floor(n / 2)).alias("p50"),
        at(F.floor(n * 3 / 4)).alias("p75"),
    )

    def scaled(x):
        return F.col(x).cast("double") / F.lit(scale)

    return stats.select(by, "count", scaled("total").alias("sum"), scaled("low").alias("min"), scaled("high").alias("max"), (scaled("total") / n).alias("mean"), (F.col("squares") / n).alias("variance"), scaled("p50").alias("median"), scaled("p25").alias("q25"), scaled("p75").alias("q75"))


def with_all_metrics(stats: DataFrame) -> DataFrame:
    """All eight metrics in report order (column ``ord``), zeros where a metric has no duration."""
    rows = metric_dim(stats.sparkSession).join(stats, "metric", "left")
    zeros = [F.coalesce(c, F.lit(0 if c == "count" else 0.0)).alias(c) for c in COLUMNS[1:]]
    return rows.select("ord", "metric", *zeros)
