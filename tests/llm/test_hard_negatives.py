import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallscope.llm.hard_negatives import first_of, hard_negatives, op12_hard_negatives, oracle, product
from tests.llm.edges import saved
from tests.oracle import assert_same

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def test_whole_query_against_sql(spark):
    assert assert_same(op12_hard_negatives(spark, SF), oracle(), SF) > 20


def vectors(spark, seed):
    """Few values, so that scores tie; labels with a third of all rows and with few; rows that take no part; repeated ones."""
    rng = random.Random(seed)
    rows = []
    for k in range(160):
        v = [rng.choice([0.0, 0.25, 0.5, 1.0, -0.5, 2.0]) for _ in range(rng.choice([9, 9, 9, 4, 0]))]
        rows.append((k * 5, v, 3 if k % 3 == 0 else rng.randrange(14)))
    rows += rng.sample(rows, 20)
    rows += [(r[0], r[1], 1) for r in rng.sample(rows, 5)]
    nothing, inf = float("nan"), float("inf")
    rows += [(None, [1.0], 1), (50, None, 1), (1001, [1.0, 2.0], None), (1002, [1.0, None], 3), (1050, [nothing] * 9, 3), (1003, [inf] * 9, 3), (1004, [-inf, 0.0], 2)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("v", "bid", "chunk", "rank", "score", "ids", "grp")})


@pytest.mark.parametrize("seed", range(2))
def test_small_blocks_against_sql(spark, tmp_path, seed):
    df = vectors(spark, seed)
    folder = saved(df, tmp_path, "embeddings")
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    n = [assert_same(hard_negatives(df, rows=11, anchors=2, chunk=4), oracle(), _one_file(folder)), assert_same(op12_hard_negatives(spark, folder), oracle(), _one_file(folder))]
    assert n[0] == n[1] > 5


def _one_file(folder):
    """A folder in which the table is one file, as the SQL's views read it."""
    import os

    import pyarrow.parquet as pq

    os.makedirs(f"{folder}/flat", exist_ok=True)
    pq.write_table(pq.read_table(f"{folder}/embeddings.parquet"), f"{folder}/flat/embeddings.parquet")
    return f"{folder}/flat"


def test_empty_tables_and_no_anchors(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert op12_hard_negatives(spark, saved(none, tmp_path, "embeddings")).count() == 0
    some = spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], SCHEMA)
    assert hard_negatives(some).count() == 0
    alone = spark.createDataFrame([(50, [1.0], 1), (2, [1.0], 2)], SCHEMA)
    got = hard_negatives(alone)
    assert got.count() == 0 and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_large_components_are_exact(spark):
    big = [1e6 + k for k in range(5)]
    rows = [(50, big, 1), (51, [x + 1 / 256 for x in big], 1), (52, [x * 0.7 for x in big], 2), (53, [x * 0.7 for x in reversed(big)], 2), (54, [1e300], 2)]
    got = [tuple(r) for r in hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), chunk=2).orderBy("rank").collect()]
    ints = {k: [int(np.floor(256 * x)) for x in v] for k, v, _ in rows[:4]}
    dot = {k: sum(a * b for a, b in zip(ints[50], v, strict=True)) for k, v in ints.items()}
    first, second = sorted((52, 53), key=lambda k: (-dot[k], k))
    assert got == [(50, 51, 1, first, dot[51], dot[first]), (50, 51, 2, second, dot[51], dot[second])]


def test_products_and_first_columns():
    rng = np.random.default_rng(1)
    for most in (100, 1 << 14, 1 << 24, 1 << 29):
        a, b = (rng.integers(-most, most, (n, 6)) for n in (5, 8))
        assert (product(a, b) == a.astype(object) @ b.astype(object).T).all()
    for _ in range(50):
        scores = rng.integers(-3, 3, (4, rng.integers(0, 12)))
        able = rng.random(scores.shape) < 0.6
        i, j = first_of(scores, able, 3)
        expected = [(r, c) for r in range(4) for c in sorted((c for c in range(scores.shape[1]) if able[r, c]), key=lambda c: (-scores[r, c], c))[:3]]
        assert list(zip(i.tolist(), j.tolist(), strict=True)) == expected


def shuffled(spark):
    """Bytes that all stages so far wrote for others."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_scores_of_tiles_are_not_shuffled(spark):
    """1500 anchors and 6000 rows have 72 MB of scores, which take more than 15 MB compressed."""
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=4).tolist(), k % 3) for k in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    before = shuffled(spark)
    assert hard_negatives(df, F.col("vec_id") % 4 == 0).count() > 10_000
    assert 0 < shuffled(spark) - before < 8 << 20


def test_groups_of_anchors_and_ties_give_the_same(spark):
    """Groups of one block of anchors, tiles of which many rows tie, against one group."""
    rng = random.Random(4)
    rows = [(k, [rng.choice([0.5, 1.0]) for _ in range(5)], rng.randrange(3)) for k in range(600)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    few, one = (sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 4 == 0, rows=50, anchors=a, chunk=2, group_bytes=g).collect())) for a, g in ((7, 1), (512, 1 << 25)))
    assert few == one and len(few) > 1000
