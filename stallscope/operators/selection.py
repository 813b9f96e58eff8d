"""Order statistics by narrowing ranges of values, without a sort and without a row for each different value.

Every place that is asked of a key has a range of values that holds it, at first from the key's least to its
greatest. A round cuts each open range into cells, counts the rows in them and goes on with the cell that holds
the place, from its least to its greatest value. So a round moves one count for each cell and task, ranges
shrink at least ``CELLS`` times, and four rounds suffice for durations below 2^40 ps, seven for any. Outliers cost no more rounds than
their distance takes, ties end a range as soon as its least value is its greatest. The driver gets the number
of open ranges of a round; ranges are a table.

Rows without a key or value do not count; a key without rows has no place; a place below 0 or beyond the last row
gives no row; a null place neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.joins import BROADCAST_BYTES
from ..functions.names import PS_PER_S
from ..functions.tables import dropped, written

CELLS = 1 << 10
_OF_RANGE = 96  # bytes counted for a row of ranges, its key among them


def _beside(rows: DataFrame, ranges: DataFrame, n: int, by: str) -> DataFrame:
    """Rows joined with the few rows of each key, broadcast where all are small."""
    return rows.join(F.broadcast(ranges) if n * _OF_RANGE <= BROADCAST_BYTES else ranges, by)


def select_places(held: DataFrame, places: DataFrame, by: str, value: str, cells: int = CELLS) -> DataFrame:
    """(by, name, value): of rows (by, value), which should be cheap to read again, the value at each 0-based place of ``places`` (by, name, place, low, high), where low and high are the key's least and greatest value."""
    v = F.col(value)
    ranges = written(places.where("place >= 0").select(by, "name", "place", "low", "high", F.lit(0).cast("long").alias("below")), "selection-ranges")
    while n := ranges.where("low < high").count():
        near = _beside(held.where(v.isNotNull()), ranges.where("low < high"), n, by).where(v.between(F.col("low"), F.col("high")))
        counts = near.withColumn("cell", F.expr(f"({value} - low) div ((high - low) div {cells} + 1)"))
        counts = counts.groupBy(by, "name", "place", "below", "cell").agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))
        before = F.coalesce(F.sum("n").over(W.partitionBy(by, "name").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        hit = counts.withColumn("below", F.col("below") + before).where("place >= below and place < below + n")
        after = written(ranges.where("low = high").unionByName(hit.select(*ranges.columns)), "selection-ranges")
        dropped(ranges)
        ranges = after
    return ranges.select(by, "name", F.col("low").alias(value))


def summarize_selected(found: DataFrame, by: str = "metric", scale: float = PS_PER_S, cells: int = CELLS) -> DataFrame:
    """The rows of ``statistics.summarize``, quartiles by selection."""
    held = written(found.where(F.col(by).isNotNull() & F.col("dur_ps").isNotNull()).select(by, "dur_ps"), "selection-durations")
    d, n = F.col("dur_ps").cast("decimal(38,0)"), F.col("count")
    totals = held.groupBy(by).agg(F.count(F.lit(1)).alias("count"), F.sum(d).alias("total"), F.min("dur_ps").alias("low"), F.max("dur_ps").alias("high"))
    totals = written(totals, "selection-totals")
    quarters = F.explode(F.array(*[F.struct(F.lit(f"p{25 * k}").alias("name"), F.floor(n * k / 4).alias("place")) for k in (1, 2, 3)]))
    chosen = select_places(held, totals.select(by, quarters.alias("q"), "low", "high").select(by, "q.*", "low", "high"), by, "dur_ps", cells)
    chosen = chosen.groupBy(by).agg(*[F.max(F.when(F.col("name") == p, F.col("dur_ps"))).alias(p) for p in ("p25", "p50", "p75")])
    away = F.col("dur_ps") / F.lit(scale) - F.col("total").cast("double") / F.lit(scale) / n
    squares = _beside(held, totals.select(by, "count", "total"), totals.count(), by).groupBy(by).agg(F.sum(away * away).alias("squares"))

    def scaled(x: str) -> Column:
        return F.col(x).cast("double") / F.lit(scale)

    stats = totals.join(chosen, by).join(squares, by)
    return stats.select(by, "count", scaled("total").alias("sum"), scaled("low").alias("min"), scaled("high").alias("max"), (scaled("total") / n).alias("mean"), (F.col("squares") / n).alias("variance"), scaled("p50").alias("median"), scaled("p25").alias("q25"), scaled("p75").alias("q75"))
