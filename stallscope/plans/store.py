"""Traces stored in tables that are bucketed by the keys of what is done with them, so that this needs no exchange.

Messages lie by (source, destination, tag, ordinal): a pair is in one bucket, and a hot key is in all of them. Members
of collective groups lie by the key of their group, the trace by its row number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import new_path, shuffle_partitions
from ..operators import collectives, messages, waits


class StoredTrace:
    """The tables of one trace, by the name they share."""

    PARTS = ("trace", "messages", "groups")

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def table(self, part: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{part}")

    def pairs(self, carry: tuple[str, ...] = ()) -> DataFrame:
        """What ``match_p2p`` gives."""
        return messages.pairs_of(self.table("messages"), carry=carry)

    def group_durations(self) -> DataFrame:
        return waits.group_durations(self.table("groups"))

    def durations(self) -> DataFrame:
        return waits.message_durations(self.pairs()).unionByName(self.group_durations())

    def group_offsets(self) -> DataFrame:
        return collectives.group_offsets(self.table("groups"))

    def rows(self, idx: list[int]) -> DataFrame:
        """Rows of the trace by their numbers, by which its files are sorted."""
        return self.table("trace").where(F.col("idx").isin(*idx))

    def drop(self) -> None:
        for part in self.PARTS:
            self.spark.sql(f"drop table if exists {self.name}_{part}")


def store(trace: DataFrame, comm: DataFrame, name: str | None = None, path: str | None = None, mode: str = "slot", buckets: int | None = None) -> StoredTrace:
    """Stores a trace, its messages with their ordinals and its groups; without a path in the shared folder, until the application ends."""
    spark = trace.sparkSession
    name, path, n = name or f"trace_{uuid.uuid4().hex}", path or new_path(spark, "stored-trace"), buckets or shuffle_partitions(spark)
    groups = collectives.group_collectives(trace, comm, mode)
    for part, rows, keys, order in (
        ("trace", trace, ["idx"], ["idx"]),
        ("messages", messages.messages(trace), [*messages.KEY, "k"], [*messages.KEY, "k"]),
        ("groups", groups, list(collectives.group_key(groups)), list(collectives.group_key(groups))),
    ):
        # Dealt as buckets are, each task writes one file of one bucket.
        rows.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*order).option("path", f"{path}/{part}").mode("overwrite").saveAsTable(f"{name}_{part}")
    return StoredTrace(spark, name)
