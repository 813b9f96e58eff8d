"""Point-to-point matching of a stream: pairs as soon as no earlier message can come.

Messages of a (source, destination, tag) wait in the state of their key until the watermark has passed their time. Then they are
taken in the order of time and row number and meet one another, the k-th send the k-th receive; what has not met
yet waits on, with no limit. Where row numbers ascend with time in each key and side, as they do in location files, the pairs
of a stream that has ended are those of ``match_p2p``, whatever its batches are and in whatever order messages arrive
within the delay. Times are not negative. Messages that come later than the delay are dropped by Spark, as its metrics tell.

A key's messages are in one task, as all state of a key is. Rows that are no messages, or have no time, are passed over; nulls in
keys are values of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..functions.names import RECVS, SENDS
from ..operators.messages import KEY

PAIR = "send_idx long, recv_idx long, send_ts long, recv_ts long"
HELD = StructType([StructField("idx", LongType()), StructField("ts", LongType()), StructField("is_send", BooleanType())])
PS_PER_MS = 10**9
# Spark's first watermark is the epoch and drops what is not after it, so time 0 of a trace is one day later.
BEGIN_MS = 86_400_000


def _ms(ts: int) -> int:
    return ts // PS_PER_MS + BEGIN_MS


class _Matcher(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getListState("early", HELD)  # beyond the watermark
        self.waiting = handle.getListState("waiting", HELD)  # of one side, in order

    def _wake(self, early: list[tuple]) -> None:
        """One timer for the earliest of them."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if early:
            self.handle.registerTimer(min(_ms(r[1]) for r in early))

    def _release(self, early: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        ready = sorted((r for r in early if _ms(r[1]) <= watermark), key=lambda r: (r[1], r[0]))
        if ready:
            waiting, pairs = list(self.waiting.get()), []
            first = 0
            for r in ready:
                if first < len(waiting) and waiting[first][2] != r[2]:
                    one, other = (r, waiting[first]) if r[2] else (waiting[first], r)
                    pairs.append((one[0], other[0], one[1], other[1]))
                    first += 1
                else:
                    waiting.append(r)
            self._put(self.waiting, waiting[first:])
            early = [r for r in early if _ms(r[1]) > watermark]
            if pairs:
                yield pd.DataFrame(pairs, columns=[c.split()[0] for c in PAIR.split(", ")])
        self._put(self.early, early)
        self._wake(early)

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:
        state.put(rows) if rows else state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        early = [tuple(r) for r in self.early.get()]
        for some in rows:
            early += zip(some["idx"].tolist(), some["ts"].tolist(), some["is_send"].tolist(), strict=True)
        yield from self._release(early, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release([tuple(r) for r in self.early.get()], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def match_stream(trace: DataFrame, delay: str = "10 seconds", key: tuple[str, ...] = KEY) -> DataFrame:
    """Pairs (schema ``PAIR``) of a stream of rows of a trace that come at most ``delay`` late by their time in ps; needs the state store of RocksDB."""
    send = F.col("op").isin(*SENDS)
    rows = trace.where(F.col("op").isin(*SENDS, *RECVS) & F.col("ts").isNotNull() & F.col("idx").isNotNull())
    rows = rows.select("idx", "ts", send.alias("is_send"), "tag", "comm_id", F.when(send, F.col("pid")).otherwise(F.col("src")).alias("src"), F.when(send, F.col("dst")).otherwise(F.col("pid")).alias("dst"))
    timed = rows.withColumn("time", F.timestamp_micros(F.expr(f"ts div 1000000 + {BEGIN_MS * 1000}"))).withWatermark("time", delay)
    return timed.groupBy(*key).transformWithStateInPandas(_Matcher(), outputStructType=PAIR, outputMode="Append", timeMode="EventTime")
