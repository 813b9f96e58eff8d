"""Ranks inside keys that may hold any share of the rows.

A plain ``row_number`` sorts a whole key in one task. Here a key is cut into blocks of its order
column; rows are ranked inside a block and moved on by what the key's earlier blocks hold, so the
largest sort is one block and only one row per key and block is summed up in order. What is ranked is written
once, so its source is read once however many passes the blocks take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from .tables import shuffle_partitions, written

BLOCK_ROWS = 1 << 20
MOST_BLOCKS = 1 << 17
CELLS = 1 << 4  # least number of cells into which a cell is cut
CELLS_A_BLOCK = 4


def _borders(df: DataFrame, order: str, low: int, high: int, n: int, most: int) -> list[int]:
    """Where blocks of about ``most`` rows begin: cells of equal width, in which cells that hold more are cut again.

    A cell is cut into a few more cells than it will make blocks, so the driver gets counts of a few cells for each block.
    """
    spark = df.sparkSession

    def finer(cell: int, lo: int, hi: int, rows: int) -> tuple[int, int, int]:
        return cell, lo, (hi - lo) // max(CELLS, CELLS_A_BLOCK * rows // most) + 1

    held = df.where(F.col(order).isNotNull()).select(F.col(order).cast("long").alias("v"), F.lit(0).cast("long").alias("cell"))
    cut, firsts = [finer(0, low, high, n)], [(low, high)]
    leaves: list[tuple[int, int]] = []
    while cut:
        # Cells of a level are numbered on from those of the cell before.
        sizes = [(hi - lo) // width + 1 for (lo, hi), (_, _, width) in zip(firsts, cut, strict=True)]
        starts = [sum_ - size for sum_, size in zip(_running(sizes), sizes, strict=True)]
        known = spark.createDataFrame([(c, s, lo, width) for s, (c, lo, width) in zip(starts, cut, strict=True)], "cell long, first long, lo long, width long")
        held = held.join(F.broadcast(known), "cell").select("v", (F.col("first") + F.expr("(v - lo) div width")).alias("cell"))
        counts = held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        leaves += [(r["lo"], r["n"]) for r in counts if r["n"] <= most or r["lo"] == r["hi"]]
        large = [r for r in counts if r["n"] > most and r["lo"] < r["hi"]]
        cut, firsts = [finer(r["cell"], r["lo"], r["hi"], r["n"]) for r in large], [(r["lo"], r["hi"]) for r in large]
    borders, sum_here = [], 0
    for lo, rows in sorted(leaves):
        if not borders or sum_here + rows > most:
            borders.append(lo)
            sum_here = 0
        sum_here += rows
    return borders


def _running(sizes: list[int]) -> list[int]:
    total, out = 0, []
    for x in sizes:
        total += x
        out.append(total)
    return out


BINS_A_BORDER = 2
BIN = "bin long, base long, border long, child long, lo long, width long, last long"


def _directory(borders: list[int]) -> list[list[tuple]]:
    """Tables (schema ``BIN``), one for each step of a search: bins of equal width between some borders, and what each says of its values.

    With at most one border in it a bin says which block its values are in: ``base``, and the next one from ``border`` on. A bin
    with more is cut once more, between its first and its last border; its bins are numbered from ``child`` on.
    """
    levels, nodes = [], [(0, len(borders) - 1, 0)]  # first and last border, number of the first bin
    while nodes:
        table, below, numbered = [], [], 0
        for first, last, start in nodes:
            lo, width = borders[first], (borders[last] - borders[first]) // (BINS_A_BORDER * (last - first + 1)) + 1
            n = (borders[last] - lo) // width + 1
            table.append((start, first - 1, None, None, None, None, None))
            at = first
            for k in range(n):
                end = at
                while end <= last and (borders[end] - lo) // width == k:
                    end += 1
                if end - at < 2:
                    table.append((start + 1 + k, at - 1, borders[at] if end > at else None, None, None, None, None))
                else:
                    inner = (borders[end - 1] - borders[at]) // (BINS_A_BORDER * (end - at)) + 1
                    count = (borders[end - 1] - borders[at]) // inner + 1
                    table.append((start + 1 + k, None, None, numbered, borders[at], inner, count + 1))
                    below.append((at, end - 1, numbered))
                    numbered += count + 2
                at = end
            table.append((start + 1 + n, last, None, None, None, None, None))
        levels.append(table)
        nodes = below
    return levels


def with_block(df: DataFrame, order: str, borders: list[int]) -> DataFrame:
    """Adds ``_block``, the number of the last of the ascending ``borders`` that is not above ``order``; null where that is null.

    Each step of the search is a join with a broadcast table of a few bins for each border; evenly spread borders take one or
    two steps, others a few more. The value has to be no less than the first border.
    """
    spark, v = df.sparkSession, F.col(order)
    width = (borders[-1] - borders[0]) // (BINS_A_BORDER * len(borders)) + 1
    place: Column = _bin(v, F.lit(0), F.lit(borders[0]), F.lit(width), F.lit((borders[-1] - borders[0]) // width + 2))
    out, found = df, []
    for k, table in enumerate(_directory(borders)):
        names = {c.split()[0]: f"_{c.split()[0]}{k}" for c in BIN.split(", ")}
        known = spark.createDataFrame(table, BIN).withColumnsRenamed(names)
        out = out.withColumn("_at", place).join(F.broadcast(known), F.col("_at") == F.col(names["bin"]), "left").drop("_at", names["bin"])
        found.append(F.col(names["base"]) + F.coalesce((v >= F.col(names["border"])).cast("long"), F.lit(0)))
        place = _bin(v, *(F.col(names[c]) for c in ("child", "lo", "width", "last")))
    return out.withColumn("_block", F.coalesce(*found)).select(*df.columns, "_block")


def _bin(v: Column, child: Column, lo: Column, width: Column, last: Column) -> Column:
    """The bin of a value: the first below ``lo``, the last beyond the bins between."""
    inner = F.call_function("div", v - lo, width) + 1
    return F.when(v.isNotNull(), child + F.when(v < lo, F.lit(0)).otherwise(F.least(inner, last)))


def in_blocks(df: DataFrame, order: str, block_rows: int = BLOCK_ROWS, name: str = "ordered") -> DataFrame:
    """``df``, written once, with a block number ``_block`` that ascends with the integer column ``order``, for blocks of at most about ``block_rows`` rows; without any where one block holds all.

    However values are spread, only a single value of more rows makes a larger block. Tables of more than
    ``MOST_BLOCKS`` such blocks get larger ones. Borders follow from counts of all rows, so equal inputs give equal blocks.
    """
    seen = Observation()
    held = written(df.observe(seen, F.min(order).alias("low"), F.max(order).alias("high"), F.count(order).alias("n")), name)
    low, high, n = (seen.get.get(x) for x in ("low", "high", "n"))
    if not n or n <= block_rows or high == low:
        return held
    return with_block(held, order, _borders(held, order, int(low), int(high), n, max(block_rows, n // MOST_BLOCKS)))


def join_blocks(held: DataFrame, of_blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``held`` with what ``of_blocks`` says of each key and ``_block`` (there named ``_of_`` and the name); nulls are keys too."""
    names = [*keys, "_block"]
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in names]
    return held.join(of_blocks, same).drop(*(f"_of_{k}" for k in names))


def ranked(held: DataFrame, keys: list[str], order: list[str], names: dict[str, Column | None]) -> DataFrame:
    """Adds each of ``names``: the 1-based rank of a row in its key by ``order``, or of a column its running total, this row included.

    ``held`` is a table of ``in_blocks`` by the first of ``order``; without blocks a key is ranked in one go. Nulls in keys are keys of their own.
    """

    def within(inside: WindowSpec, w: Column | None) -> Column:
        return F.row_number().over(inside) if w is None else F.sum(w).over(inside.rowsBetween(W.unboundedPreceding, 0))

    if "_block" not in held.columns:
        whole = W.partitionBy(*keys).orderBy(*order)
        return held.withColumns({k: within(whole, w).cast("long") for k, w in names.items()})
    inside = W.partitionBy(*keys, "_block").orderBy(*order)
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sums = held.groupBy(*keys, "_block").agg(*[(F.count(F.lit(1)) if w is None else F.sum(w)).alias(f"_held_{k}") for k, w in names.items()])
    sums = sums.select(*(F.col(k).alias(f"_of_{k}") for k in (*keys, "_block")), *(F.coalesce(F.sum(f"_held_{k}").over(before), F.lit(0)).alias(f"_before_{k}") for k in names))
    local = {f"_local_{k}": within(inside, w) for k, w in names.items()}
    out = join_blocks(held.withColumns(local), sums, keys)
    out = out.withColumns({k: (F.col(f"_local_{k}") + F.col(f"_before_{k}")).cast("long") for k in names})
    return out.drop("_block", *(f"{part}_{k}" for part in ("_local", "_before") for k in names))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df``, written once, with dense numbers from 0 in column ``name``, by ``order``, over all rows.

    Rows are dealt by ranges of the whole order and sorted in their tasks, which number them from 0; the
    driver gets the count of each task and nothing else. Rows that are equal in all of ``order`` have to be equal.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    held = written(dealt.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    task, row = F.shiftright("_place", 33).alias("_task"), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(held.groupBy(task).agg(F.count(F.lit(1)).alias("n")).collect())
    starts = [(r["_task"], total - r["n"]) for r, total in zip(counts, _running([r["n"] for r in counts]), strict=True)]
    known = spark.createDataFrame(starts, "_task long, _start long")
    return held.withColumn("_task", task).join(F.broadcast(known), "_task").withColumn(name, F.col("_start") + row).drop("_task", "_start", "_place")
