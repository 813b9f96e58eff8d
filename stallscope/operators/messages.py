"""Point-to-point matching: the k-th send of a (source, destination, tag) meets its k-th receive.

A null in the key is a value of its own, so sends and receives without a tag match each other; rows that
are repeated with their idx match each on its own; an empty trace gives no pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import RECVS, SENDS
from ..functions.ranks import BLOCK_ROWS, in_blocks, ranked

KEY = ("src", "dst", "tag")


def messages(trace: DataFrame, key: tuple[str, ...] = KEY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sends and receives with their side and their ordinal ``k`` in (key, side) by idx.

    Sends are keyed by the process that sends, receives by the one that receives.
    """
    send = F.col("op").isin(*SENDS)
    rows = trace.where(F.col("op").isin(*SENDS, *RECVS)).select("idx", "op", "ts", "tag", "comm_id", "pid", F.when(send, F.col("pid")).otherwise(F.col("src")).alias("src"), F.when(send, F.col("dst")).otherwise(F.col("pid")).alias("dst"), send.alias("is_send"))
    return ranked(in_blocks(rows, "idx", block_rows, "messages"), [*key, "is_send"], ["idx"], {"k": None})


def pairs_of(rows: DataFrame, key: tuple[str, ...] = KEY, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (send_idx, recv_idx, send_ts, recv_ts, and of ``carry`` the send's and the receive's) of ``messages``; both sides are dealt by key and ordinal, so one key's pairs spread over all tasks."""
    send, held = F.col("is_send"), F.struct("idx", "ts", *carry)
    met = rows.groupBy(*key, "k").agg(F.max(F.when(send, held)).alias("s"), F.max(F.when(~send, held)).alias("r"))
    met = met.where("s is not null and r is not null")
    return met.select(*[F.col(f"{side[0]}.{c}").alias(f"{side}_{c}") for c in ("idx", "ts", *carry) for side in ("send", "recv")])


def match_p2p(trace: DataFrame, key: tuple[str, ...] = KEY, block_rows: int = BLOCK_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """The pairs of a trace; per key as many as its rarer side has rows."""
    return pairs_of(messages(trace, key, block_rows), key, carry)


def partners(trace: DataFrame, key: tuple[str, ...] = KEY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(idx, match_partner) of every row of the trace, -1 where there is none, by one grouping of the messages."""
    send, none = F.col("is_send"), F.lit(-1).cast("long")
    met = messages(trace, key, block_rows).groupBy(*key, "k").agg(F.max(F.when(send, F.struct("idx"))).alias("s"), F.max(F.when(~send, F.struct("idx"))).alias("r"))
    sides = [F.when(F.col(a).isNotNull(), F.struct(F.col(f"{a}.idx").alias("idx"), F.coalesce(f"{b}.idx", none).alias("match_partner"))) for a, b in ("sr", "rs")]
    matched = met.select(F.inline(F.array_compact(F.array(*sides))))
    others = trace.where(~F.coalesce(F.col("op").isin(*SENDS, *RECVS), F.lit(False))).select("idx", none.alias("match_partner"))
    return matched.unionByName(others)


def match_partner(trace: DataFrame, pairs: DataFrame) -> DataFrame:
    """(idx, match_partner) of every row of the trace, -1 where there is none."""
    both = pairs.select(F.col("send_idx").alias("idx"), F.col("recv_idx").alias("partner")).union(pairs.select("recv_idx", "send_idx"))
    return trace.select("idx").join(both, "idx", "left").select("idx", F.coalesce("partner", F.lit(-1).cast("long")).alias("match_partner"))


def unmatched(trace: DataFrame, pairs: DataFrame, sends: bool) -> DataFrame:
    codes, column = (SENDS, "send_idx") if sends else (RECVS, "recv_idx")
    rows = trace.where(F.col("op").isin(*codes))
    return rows.join(pairs.select(F.col(column).alias("idx")), "idx", "left_anti").select("idx", "op", "ts", "pid", "src", "dst", "tag")


def match_summary(pairs: DataFrame) -> DataFrame:
    n = pairs.agg(F.count(F.lit(1)).alias("pairs"))
    return n.select((F.col("pairs") * 2).alias("matched_events"), "pairs")
