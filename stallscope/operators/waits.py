"""The eight wait-state duration distributions. Zero differences give no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import ALL_TO_ALL, BARRIER, FROM_ROOT, TO_ROOT
from .collectives import group_key


def _positive(df: DataFrame, named: dict[str, Column], where: dict[str, Column] | None = None) -> DataFrame:
    """One row (metric, dur_ps, and the columns ``where``) for each positive duration among the named ones of a row."""
    each = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("dur_ps")) for k, v in named.items()])
    kept = [c.alias(name) for name, c in (where or {}).items()]
    return df.select(F.explode(each).alias("d"), *kept).select("d.metric", "d.dur_ps", *(where or {})).where("dur_ps > 0")


def message_durations(pairs: DataFrame) -> DataFrame:
    late = F.col("send_ts") - F.col("recv_ts")
    return _positive(pairs, {"late_sender": late, "late_receiver": -late})


LOCATED = ("op", "pid", "comm_id")


def located_message_durations(pairs: DataFrame) -> DataFrame:
    """(metric, dur_ps, op, pid, comm_id) of pairs that carry these three: of the call that waits, the receive of a late sender and the send of a late receiver."""
    late = F.col("send_ts") - F.col("recv_ts")
    sides = [_positive(pairs, {m: d}, {c: F.col(f"{side}_{c}") for c in LOCATED}) for m, d, side in (("late_sender", late, "recv"), ("late_receiver", -late, "send"))]
    return sides[0].unionByName(sides[1])


def group_durations(groups: DataFrame, group: tuple[str, ...] | None = None, located: bool = False) -> DataFrame:
    """Of members with op, pid, root, ts and end_ts, in one pass over each group (told apart by the key of the groups' mode); with ``located`` also the member's op, pid and communicator (comm_id, from comm).

    Groups without a call by their root give no earlyreduce and no latebroadcast.
    """
    group = group or group_key(groups)
    whole = W.partitionBy(*group)
    is_root = F.col("pid") == F.col("root")
    rows = groups.select(*dict.fromkeys([*group, "op", "pid", "root", "ts", "end_ts", *(["comm"] if located else [])])).select(
        "op",
        *(["pid", F.col("comm").alias("comm_id")] if located else []),
        "ts",
        "end_ts",
        is_root.alias("is_root"),
        F.max("ts").over(whole).alias("last_ts"),
        F.min("end_ts").over(whole).alias("first_end"),
        F.max(F.when(is_root, F.col("ts"))).over(whole).alias("root_ts"),
    )
    op = F.col("op")
    wait, done = F.col("last_ts") - F.col("ts"), F.col("end_ts") - F.col("first_end")
    return _positive(
        rows,
        {
            "barrier_wait": F.when(op.isin(*BARRIER), wait),
            "barrier_completion": F.when(op.isin(*BARRIER), done),
            "earlyreduce": F.when(op.isin(*TO_ROOT) & F.col("is_root"), wait),
            "latebroadcast": F.when(op.isin(*FROM_ROOT), F.col("root_ts") - F.col("ts")),
            "wait_nxn": F.when(op.isin(*ALL_TO_ALL), wait),
            "nxn_completion": F.when(op.isin(*ALL_TO_ALL), done),
        },
        {c: F.col(c) for c in LOCATED} if located else None,
    )


def durations(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    return message_durations(pairs).unionByName(group_durations(groups))


def located_durations(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """``durations`` with the op, the process and the communicator of the call that waits."""
    return located_message_durations(pairs).unionByName(group_durations(groups, located=True))
