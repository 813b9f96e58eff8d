"""Operation and metric dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Operation codes and names as traces spell them, in the order of their codes.
OPERATIONS = (
    "MPI_Init",
    "MPI_Comm_size",
    "MPI_Comm_rank",
    "MPI_Send",
    "MPI_Recv",
    "MPI_Isend",
    "MPI_Irecv",
    "MPI_Bcast",
    "MPI_Barrier",
    "MPI_Reduce",
    "MPI_Gather",
    "MPI_Gatherv",
    "MPI_Scatter",
    "MPI_Scatterv",
    "MPI_Reduce_Scatter",
    "MPI_Reduce_Scatter_Block",
    "MPI_All_Gather",
    "MPI_All_Gatherv",
    "MPI_All_Reduce",
    "MPI_AlltoAll",
    "MPI_Finalize",
)
# Metric labels in report order.
METRICS = ("late_sender", "late_receiver", "barrier_wait", "barrier_completion", "earlyreduce", "latebroadcast", "wait_nxn", "nxn_completion")

SENDS, RECVS = (3, 5), (4, 6)
BARRIER = (8,)
TO_ROOT = (9, 10, 11)
FROM_ROOT = (7, 12, 13)
ALL_TO_ALL = (14, 15, 16, 17, 18, 19)
FIRST_COLLECTIVE, LAST_COLLECTIVE = 7, 19
NO_ROOT = 4294967295
PS_PER_S = 1e12


def is_collective(op: Column) -> Column:
    return op.between(FIRST_COLLECTIVE, LAST_COLLECTIVE)


def class_of(op: Column) -> Column:
    kinds = (("send", SENDS), ("recv", RECVS), ("barrier", BARRIER), ("n_to_1", TO_ROOT), ("1_to_n", FROM_ROOT), ("n_to_n", ALL_TO_ALL))
    out = F
    for name, codes in kinds:
        out = out.when(op.isin(*codes), name)
    return out.otherwise("other")


def op_dim(spark: SparkSession) -> DataFrame:
    rows = [(k, name) for k, name in enumerate(OPERATIONS)]
    return spark.createDataFrame(rows, "op int, name string").withColumn("class", class_of(F.col("op")))


def metric_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, m) for k, m in enumerate(METRICS)], "ord int, metric string")
