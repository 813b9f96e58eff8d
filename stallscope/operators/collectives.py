"""Groups of collective calls.

``slot`` mode fills, per (op, root), the places of calls by the root in order of time: the g-th call by
the root opens max(size of its communicator, 1) - 1 places, and the j-th call by any other process
takes the j-th place. With lo and hi the places opened before and including g, call j belongs to g if
lo < j <= hi. Calls without a place are dropped; so are groups of one call that are not complete.

``ordinal`` mode joins the k-th call of each process on (communicator, op, root).

Both modes name a group by their own key (``group_key``): g counts inside (op, root) in the one, inside
(communicator, op, root) in the other. Nulls in these are values of their own (a call without a process
is none of its root); an empty trace has no groups. Communicators that are repeated count once, those without an id or of
null members not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.joins import lookup
from ..functions.names import is_collective
from ..functions.ranks import BLOCK_ROWS, in_blocks, numbered, ranked
from ..functions.tables import written
from ..sources.trace import communicators

SLOT_KEY = ("op", "root", "g")
ORDINAL_KEY = ("comm_id", *SLOT_KEY)


def group_key(groups: DataFrame) -> tuple[str, ...]:
    """The columns that tell groups apart, of groups of either mode."""
    return ORDINAL_KEY if "comm_id" in groups.columns else SLOT_KEY


def collectives(trace: DataFrame) -> DataFrame:
    return trace.where(is_collective(F.col("op")))


def with_expected_size(trace: DataFrame, comm: DataFrame) -> DataFrame:
    """Collective calls with comm_size, 0 where the communicator is unknown; calls stay where they are, however many are on one communicator."""
    sizes = written(communicators(comm).select(F.col("comm_id").alias("_comm"), F.size("members").alias("comm_size")), "comm-sizes")
    return lookup(collectives(trace), {"comm_id": "_comm"}, sizes, "comm_size").withColumn("comm_size", F.coalesce("comm_size", F.lit(0)))


def group_slots(trace: DataFrame, comm: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(op, root, g, idx, pid, ts, end_ts, comm_size, n, root_ts, comm) of every call in a kept group; g counts from 1, comm is the caller's communicator.

    The trace is read once: its calls are ranked, roots and others apart, and written, and all else is made of
    that table. Places are dealt in blocks, so that a hot (op, root) spreads over tasks: inside a block the last
    opening before a call decides. A group's size n follows from lo, hi and the number of other calls.
    """
    key = ["op", "root"]
    is_root = F.coalesce(F.col("pid") == F.col("root"), F.lit(False)).alias("is_root")
    calls = with_expected_size(trace, comm).select(*key, is_root, "idx", "pid", "ts", "end_ts", F.greatest("comm_size", F.lit(1)).cast("long").alias("comm_size"), F.col("comm_id").alias("comm"))
    opened = F.when(F.col("is_root"), F.col("comm_size") - 1).otherwise(0)
    calls = ranked(in_blocks(calls, "ts", block_rows, "calls"), [*key, "is_root"], ["ts", "idx"], {"k": None, "hi": opened})
    calls = written(calls, "ranked-calls")
    roots, others = calls.where("is_root").withColumnRenamed("k", "g"), calls.where("not is_root").withColumnRenamed("k", "j")
    roots = roots.withColumn("lo", F.col("hi") - F.col("comm_size") + 1)
    waiting = others.groupBy(*key).agg(F.count(F.lit(1)).alias("waiting"))
    same = [roots[k].eqNullSafe(waiting[k]) for k in key]
    roots = roots.join(waiting, same, "left").drop(*[waiting[k] for k in key]).withColumn("waiting", F.coalesce("waiting", F.lit(0)))
    n = 1 + F.least("hi", "waiting") - F.least("lo", "waiting")
    roots = roots.withColumn("n", n).where((F.col("n") >= F.col("comm_size")) | (F.col("n") >= 2))

    size = F.lit(block_rows)
    opening = F.struct("g", "hi", "comm_size", "n", F.col("ts").alias("root_ts"))
    places = F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.least("hi", "waiting") - 1) / size)))
    openings = roots.where("least(hi, waiting) > lo").select(*key, opening.alias("opening"), places.alias("part"), "lo")
    none = F.lit(None)
    openings = openings.select(*key, "part", F.greatest(F.col("lo") + 1, F.col("part") * size + 1).alias("place"), F.lit(0).alias("kind"), "opening", none.cast("long").alias("idx"), none.cast("long").alias("pid"), none.cast("long").alias("ts"), none.cast("long").alias("end_ts"), none.cast("long").alias("comm"))
    callers = others.select(*key, F.floor((F.col("j") - 1) / size).alias("part"), F.col("j").alias("place"), F.lit(1).alias("kind"), none.cast(openings.schema["opening"].dataType).alias("opening"), "idx", "pid", "ts", "end_ts", "comm")
    last = F.max("opening").over(W.partitionBy(*key, "part").orderBy("place", "kind").rowsBetween(W.unboundedPreceding, 0))
    members = openings.unionByName(callers).withColumn("opening", last).where("kind = 1 and place <= opening.hi")
    columns = (*key, "g", "idx", "pid", "ts", "end_ts", "comm_size", "n", "root_ts", "comm")
    members = members.select(*key, "opening.*", "idx", "pid", "ts", "end_ts", "comm").select(*columns)
    return roots.withColumn("root_ts", F.col("ts")).select(*columns).unionByName(members)


def group_ordinals(trace: DataFrame, comm: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Calls with the number g of their instance, n the calls it has; the more robust reading, not the default."""
    calls = with_expected_size(trace, comm).select("comm_id", "op", "root", "idx", "pid", "ts", "end_ts", "comm_size")
    rows = ranked(in_blocks(calls, "ts", block_rows, "calls"), ["comm_id", "op", "root", "pid"], ["ts", "idx"], {"g": None})
    whole = W.partitionBy(*ORDINAL_KEY)
    return rows.select("comm_id", "op", "root", "g", "idx", "pid", "ts", "end_ts", "comm_size", F.count(F.lit(1)).over(whole).alias("n"), F.max(F.when(F.col("pid") == F.col("root"), F.col("ts"))).over(whole).alias("root_ts"), F.col("comm_id").alias("comm"))


def group_collectives(trace: DataFrame, comm: DataFrame, mode: str = "slot") -> DataFrame:
    if mode not in ("slot", "ordinal"):
        raise ValueError(f"no such mode: {mode}")
    return group_slots(trace, comm) if mode == "slot" else group_ordinals(trace, comm)


def group_offsets(groups: DataFrame) -> DataFrame:
    """One row per group: type, root, size and its members, the root's call first and the others by time."""
    order = F.array_sort(F.collect_list(F.struct((F.col("pid") != F.col("root")).alias("later"), "ts", "idx")))
    return groups.groupBy(*group_key(groups)).agg(F.count(F.lit(1)).alias("n"), F.transform(order, lambda x: x["idx"]).alias("members"))


def group_csr(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups as compressed rows: (gid, group key, begin_offset, end_offset), and the members (position, gid, idx), both numbered densely from 0.

    Groups stand in the order of their key, members in that of their group, the root's call first and the others by
    time. The positions of a group are those from its begin to before its end.
    """
    key = list(group_key(groups))
    late = F.coalesce(F.col("pid") != F.col("root"), F.lit(True)).alias("_late")
    placed = numbered(groups.select(*key, late, "ts", "idx"), [*key, "_late", "ts", "idx"], "position")
    found = placed.groupBy(*key).agg(F.min("position").alias("begin_offset"), (F.max("position") + 1).alias("end_offset"))
    offsets = numbered(found, ["begin_offset"], "gid").select("gid", *key, "begin_offset", "end_offset")
    same = [placed[k].eqNullSafe(offsets[k]) for k in key]
    return offsets, placed.join(offsets, same).select("position", "gid", "idx")


def group_summary(groups: DataFrame) -> DataFrame:
    sizes = groups.groupBy(*group_key(groups)).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_members"))
