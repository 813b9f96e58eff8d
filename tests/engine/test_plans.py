import os
import random
import re

import pytest
from pyspark.sql import functions as F

from stallscope.functions import ranks, tables
from stallscope.operators import collectives, messages, selection, statistics, waits
from stallscope.plans import store
from stallscope.sources import trace as source
from stallscope.sources.trace import COMM, RAW, TRACE
from stallscope.streaming.matching import match_stream

SF = "/root/testdata/sf0.01"


def plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def scans(df, what):
    return len(re.findall(rf"FileScan parquet [^\n]*{what}", plan(df)))


def test_ten_thousand_blocks_are_searched_in_generated_code(spark):
    df = spark.range(200_000).selectExpr("if(id % 1000 = 0, null, id * id) v")
    borders = sorted({(20 * k) ** 2 for k in range(10_000)})
    got = ranks.with_block(df, "v", borders)
    text = plan(got)
    assert re.findall(r"\*\(\d+\) Project", text) and not re.findall(r"(?m)^[ +:-]*Project", text)
    wrong = got.where("v is not null").withColumn("low", F.pow(F.col("_block") * 20, 2)).withColumn("high", F.pow(F.col("_block") * 20 + 20, 2)).where("v < low or (v >= high and _block < 9999)")
    assert wrong.count() == 0 and got.where("v is null").agg(F.count("_block")).first()[0] == 0
    one = ranks.with_block(df, "v", [0]).where("v is not null")
    assert one.where("_block = 0").count() == one.count()


@pytest.mark.parametrize("mode", ["slot", "ordinal"])
def test_the_trace_is_read_once_in_blocks(spark, tmp_path, mode):
    source.derived_trace(spark, SF).write.parquet(f"{tmp_path}/trace-here")
    trace, reads = source.read_trace(spark, f"{tmp_path}/trace-here"), []
    comm = source.derived_comm(spark)
    group = collectives.group_slots if mode == "slot" else collectives.group_ordinals
    seen = tables.written

    def note(df, name):
        reads.append(len(re.findall(rf"Location: InMemoryFileIndex[^\n]*{tmp_path}", df._jdf.queryExecution().executedPlan().toString())))
        return seen(df, name)

    for module in (ranks, collectives):
        module.written = note
    try:
        groups = group(trace, comm, 500)
        assert sum(reads) == 1
        assert scans(groups, f"{tmp_path}") == 0
    finally:
        for module in (ranks, collectives):
            module.written = seen
    key = list(collectives.group_key(groups))
    whole = group(trace, comm)
    assert sorted(map(tuple, groups.select(*key, "idx", "n").collect())) == sorted(map(tuple, whole.select(*key, "idx", "n").collect()))


def test_stored_traces_are_used_without_an_exchange(spark):
    trace, comm = source.derived_trace(spark, SF), source.derived_comm(spark)
    kept = store.store(trace, comm, buckets=8)
    try:
        for df in (kept.pairs(), kept.group_durations(), kept.group_offsets(), kept.durations()):
            assert "Exchange" not in plan(df)
        assert sorted(map(tuple, kept.pairs().collect())) == sorted(map(tuple, messages.match_p2p(trace).collect()))
        assert sorted(map(tuple, kept.durations().collect())) == sorted(map(tuple, waits.durations(messages.match_p2p(trace), collectives.group_slots(trace, comm)).collect()))
        some = [r.idx for r in trace.limit(3).collect()]
        assert sorted(r.idx for r in kept.rows(some).collect()) == sorted(some)
    finally:
        kept.drop()
    assert not spark.catalog.tableExists(f"{kept.name}_trace")


def test_numbers_are_dense_in_any_order_and_number_of_tasks(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(5)]), k) for k in range(1000)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(13)
    got = ranks.numbered(df, ["a", "b"], "n").orderBy("n").collect()
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) and [r.n for r in got] == list(range(1000))
    assert ranks.numbered(df.limit(0), ["a", "b"], "n").count() == 0


def test_rows_of_groups_as_compressed_rows(spark):
    comm = spark.createDataFrame([(0, [0, 1, 2])], COMM)
    rng = random.Random(4)
    rows = [(k, rng.choice([7, 8, 9]), rng.randrange(50), 60, rng.randrange(3), 0, 0, 0, 0, 0) for k in range(120)]
    groups = collectives.group_slots(spark.createDataFrame(rows, TRACE), comm)
    offsets, members = (sorted(map(tuple, df.collect())) for df in collectives.group_csr(groups))
    listed = {tuple(r[:3]): r.members for r in collectives.group_offsets(groups).select("op", "root", "g", "members").collect()}
    assert [r[0] for r in offsets] == list(range(len(listed))) and [r[0] for r in members] == list(range(groups.count()))
    ends = [0]
    for gid, op, root, g, begin, end in offsets:
        assert begin == ends[-1] and [idx for p, of, idx in members if of == gid] == listed[op, root, g] == [members[p][2] for p in range(begin, end)]
        ends.append(end)
    assert [r[1:4] for r in offsets] == sorted(listed)
    assert all(df.count() == 0 for df in collectives.group_csr(groups.limit(0)))


def test_repeated_communicators_do_not_double_calls(spark):
    rows = [(k, 8, ts, ts + 5, pid, 0, 0, 0, 0, 0) for k, (pid, ts) in enumerate([(0, 100), (1, 110)])]
    comm = spark.createDataFrame([(0, [0, 1]), (0, [0, 1]), (None, [0, 1]), (1, None)], COMM)
    for mode, key in (("slot", ("op", "root", "g")), ("ordinal", ("comm_id", "op", "root", "g"))):
        groups = collectives.group_collectives(spark.createDataFrame(rows, TRACE), comm, mode)
        assert tuple(collectives.group_summary(groups).first()) == (1, 2) and collectives.group_key(groups) == key
    raw = spark.createDataFrame([(0, 0, "coll_begin", 1, None, None, "barrier", 0, 0), (1, 0, "coll_end", 2, None, None, "barrier", source.NO_ROOT, 0)], RAW)
    assert source.decode(raw, comm).count() == 1


def test_calls_on_one_communicator_stay_where_they_are(spark):
    trace, comm = source.derived_trace(spark, SF), source.derived_comm(spark)
    raw = source.derived_raw(spark, SF)
    sized, resolved = collectives.with_expected_size(trace, comm), source.resolve_roots(source.pair_collectives(raw), comm)
    for df in (sized, resolved):
        assert "hashpartitioning(comm_id" not in plan(df)
        assert df.where("comm_size = 8").count() == df.count() > 0


def distributions():
    rng = random.Random(6)
    yield "ties", [5] * 400 + [7] * 3
    yield "outliers", [*range(100), 10**18, 2 * 10**18, 1]
    yield "one", [3]
    yield "wide", [rng.randrange(1 << 62) for _ in range(501)]
    yield "below zero", [-(10**15), -1, 0, 4, 10**15]
    for n in range(2, 9):
        yield f"n{n}", [rng.randrange(10) for _ in range(n)]


@pytest.mark.parametrize("cells", [2, 1 << 10])
def test_selection_and_sorting_agree_with_lists(spark, cells):
    rows = [(name, v) for name, values in distributions() for v in values] + [("ties", None), (None, 4)]
    df = spark.createDataFrame(rows, "metric string, dur_ps long").repartition(4)
    selected = {r["metric"]: r for r in selection.summarize_selected(df, scale=1.0, cells=cells).collect()}
    ranked = {r["metric"]: r for r in statistics.summarize(df, scale=1.0, block_rows=50).collect()}
    for name, values in distributions():
        s, n = sorted(values), len(values)
        mean = sum(values) / n
        for r in (selected[name], ranked[name]):
            assert [r[c] for c in ("count", "min", "max", "q25", "median", "q75")] == [n, *map(float, (s[0], s[-1], s[n // 4], s[n // 2], s[n * 3 // 4]))], name
            assert r["sum"] == pytest.approx(sum(values)) and r["variance"] == pytest.approx(sum((x - mean) ** 2 for x in values) / n)
    assert len(selected) == len(ranked) == len(list(distributions()))
    assert selection.summarize_selected(df.limit(0)).count() == 0


def test_drill_down_of_parts_without_a_value(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randrange(20), rng.choice([3, 4, None]), rng.choice([0, 1, None]), rng.choice([0, None])) for _ in range(300)]
    df = spark.createDataFrame([*rows, (None, 1, 3, 0, 0), ("a", None, 3, 0, 0)], "metric string, dur_ps long, op int, pid long, comm_id long")
    got = statistics.drilldown(df, scale=1.0, block_rows=40).collect()
    expected = {}
    for s in statistics.DRILLS:
        for m, d, *dims in rows:
            part = [x if c in s else None for c, x in zip(("op", "pid", "comm_id"), dims, strict=True)]
            expected.setdefault((",".join(s), m, *part), []).append(d)
    assert {(r.level, r.metric, r.op, r.pid, r.comm_id): (r["count"], r.median, r.q25, r.q75) for r in got} == {k: (n := len(v), (s := sorted(v))[n // 2], s[n // 4], s[n * 3 // 4]) for k, v in expected.items()}
    assert len(got) == len(expected)


def test_what_is_written_inside_a_scope_goes(spark):
    with tables.released(spark):
        kept = tables.written(spark.range(3).toDF("x"), "here")
        with tables.released(spark):
            inner = tables.written(kept, "there")
            assert inner.count() == 3
        assert not os.path.exists(inner._written_to.removeprefix("file://")) and kept.count() == 3
    assert not os.path.exists(kept._written_to.removeprefix("file://"))


def test_a_stream_in_batches_with_late_rows_pairs_as_a_table_does(spark, tmp_path):
    """Row numbers ascend with time; rows arrive shuffled within the delay, in three batches, with a last row that lets the watermark pass all."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rng = random.Random(2)
        second = 10**12
        rows = [(k, op := rng.choice([3, 4, 5, 6, 8]), k * second // 5, 0, a if op in (3, 5) else b, a, b, rng.choice([0, 1, None]), 0, 0) for k in range(300) for a, b in [(rng.randrange(2), rng.randrange(2))]]
        expected = sorted(map(tuple, messages.match_p2p(spark.createDataFrame(rows, TRACE)).collect()))
        batches = [[], [], []]
        for r in rows:  # some come one batch late, by less than the delay
            at = r[0] // 100
            batches[min(2, at + (rng.random() < 0.3 and r[0] % 100 > 60))].append(r)
        for k, some in enumerate(batches):
            rng.shuffle(some)
            more = [(10_000, 3, 10**6 * second, 0, 9, 9, 9, 9, 0, 0)] if k == 2 else []
            spark.createDataFrame(some + more, TRACE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(TRACE).parquet(f"{tmp_path}/in")
            query = match_stream(stream, "30 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            query.awaitTermination(240)
            assert query.exception() is None
            so_far = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
            assert set(so_far) <= set(expected) and len(set(so_far)) == len(so_far)
            assert (len(so_far) < len(expected)) == (k < 2)
        assert so_far == expected and len(expected) > 40
    finally:
        spark.conf.unset(provider)
