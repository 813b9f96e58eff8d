import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallscope.functions import tables
from stallscope.llm import common


@pytest.mark.parametrize("least", [3, 1000])
def test_hot_keys_join_like_others(spark, monkeypatch, least):
    monkeypatch.setattr(common, "LEAST_HEAVY", least)
    rng = random.Random(1)
    keys = [rng.choice([0, 0, 0, *range(40)]) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(keys)), "v long, k long")
    sized = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 7")
    expected = sorted((k, v, keys.count(k)) for v, k in enumerate(keys) if k != 7)
    for total in (None, len(keys)):
        got = common.join_hot(rows, sized, ["k"], "n", total).select("k", "v", "n").collect()
        assert sorted(map(tuple, got)) == expected


@pytest.mark.parametrize("least", [3, 1000])
def test_components_of_stars_chains_and_random_edges(spark, monkeypatch, least):
    monkeypatch.setattr(common, "LEAST_HEAVY", least)
    rng = random.Random(2)
    edges = [(5, 1000 + k) for k in range(60)] + [(k, k + 1) for k in range(2000, 2040)] + [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(70)] + [(1, 1)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    met = {x for a, b in edges if a != b for x in (a, b)}
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long"), "edges").collect()
    assert {r.id: r.component_id for r in got} == {x: root(x) for x in met} and len(got) == len(met)
    assert common.connected_components(spark.createDataFrame([], "a long, b long"), "none").count() == 0


def test_sums_of_arrays(spark):
    rng = np.random.default_rng(3)
    parts = [(int(k), rng.integers(0, 100, 8).astype("<f4")) for k in rng.integers(-1, 5, 90)]
    df = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in parts], "chunk int, values binary").repartition(11)
    got = common.summed_arrays(df)
    assert got.keys() == {k for k, _ in parts}
    assert all((got[k] == sum(x for c, x in parts if c == k)).all() for k in got)


def test_only_what_is_small_in_bytes_is_broadcast(spark):
    narrow = spark.range(100)
    wide = narrow.select("id", F.repeat(F.lit("x"), 1000).alias("text"))

    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    assert hinted(common.small(narrow, 10_000)) and not hinted(common.small(wide, 10_000)) and hinted(common.small(wide, 110_000))
    assert hinted(common.small(narrow.limit(0)))


def test_tables_are_dropped(spark):
    df = tables.written(spark.range(5).withColumnRenamed("id", "n"), "some")
    assert df.count() == 5
    tables.dropped(df)
    _, system = tables._on_disk(spark, df._written_to)
    assert not system.exists(spark._jvm.org.apache.hadoop.fs.Path(df._written_to))
    tables.dropped(spark.range(1))


def test_the_table_of_the_memory_is_built_once_for_texts_of_three_megabytes(monkeypatch):
    tokens = common.ChunkedTokenizer(common.vocabulary("byte_bpe_50k.json"), True)
    texts = [" ".join(f"w{k * j % 997}" for j in range(500)) for k in range(1250)]
    assert 3 << 20 > sum(map(len, texts)) > 5 << 19
    seen, gather = [], tokens.chunks.gather
    monkeypatch.setattr(tokens.chunks, "gather", lambda *a: seen.append(1) or gather(*a))
    found = tokens.encode(pa.array(texts))
    assert len(seen) == 1 and found[7].tolist() == tokens.tokenizer.encode(texts[7], add_special_tokens=False).ids
