import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stallscope.functions import ranks
from stallscope.operators import collectives, messages, statistics, waits
from stallscope.plans.engine import analyze, format_report
from stallscope.sources.trace import COMM, RAW, TRACE, pair_collectives


def trace(spark, rows):
    """Rows (op, ts, end_ts, pid, src, dst, tag, root)."""
    return spark.createDataFrame([(k, *r, 0) for k, r in enumerate(rows)], TRACE)


def partners(spark, rows, **more):
    t = trace(spark, rows)
    return [r.match_partner for r in messages.match_partner(t, messages.match_p2p(t, **more)).orderBy("idx").collect()]


def mates(rows, key=lambda a, b, tag: (a, b, tag)):
    """Sends and receives of a key, each in their order, paired one after the other."""
    sends, recvs = defaultdict(list), defaultdict(list)
    for k, (op, _, _, pid, src, dst, tag, _) in enumerate(rows):
        if op in (3, 5):
            sends[key(pid, dst, tag)].append(k)
        elif op in (4, 6):
            recvs[key(src, pid, tag)].append(k)
    out = [-1] * len(rows)
    for who, some in sends.items():
        for a, b in zip(some, recvs[who], strict=False):
            out[a], out[b] = b, a
    return out


@pytest.mark.parametrize("seed", range(3))
def test_matching_of_random_traces(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(150 * seed):
        op, a, b, tag, t = rng.choice((3, 4, 5, 6, 8)), rng.randrange(3), rng.randrange(3), rng.choice((0, 1, 2**21, None)), rng.randrange(10**6)
        rows.append((op, t, t, a if op in (3, 5, 8) else b, a, b, tag, 0))
    assert partners(spark, rows, block_rows=20) == mates(rows)
    assert partners(spark, rows) == mates(rows)


def test_matching_of_a_hot_key_in_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.choice((3, 5)), k, k, 0, 0, 1, 7, 0) if rng.random() < 0.5 else (rng.choice((4, 6)), k, k, 1, 0, 1, 7, 0) for k in range(200)]
    sends = [k for k, r in enumerate(rows) if r[0] in (3, 5)]
    recvs = [k for k, r in enumerate(rows) if r[0] in (4, 6)]
    expected = [-1] * len(rows)
    for a, b in zip(sends, recvs, strict=False):
        expected[a], expected[b] = b, a
    assert partners(spark, rows, block_rows=16) == expected


def restated(rows, sizes):
    """Groups of calls, one after the other: roots open places, others take the oldest free one or wait."""
    out = {}
    for key in sorted({(r[0], r[7]) for r in rows}):
        calls = sorted((r[1], k) for k, r in enumerate(rows) if (r[0], r[7]) == key)
        open_, queue, g = [], [], 0
        for _, k in calls:
            if rows[k][3] == key[1]:
                g += 1
                open_.append([max(sizes[k], 1), g, [k]])
            else:
                queue.append(k)
            for group in open_:
                while queue and len(group[2]) < group[0]:
                    group[2].append(queue.pop(0))
        for size, g, members in open_:
            if len(members) >= size or len(members) >= 2:
                out[(*key, g)] = sorted(members)
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block_rows", [3, 1 << 20])
def test_slots_are_those_of_the_sequential_rule(spark, seed, block_rows):
    rng = random.Random(seed)
    comms = {c: list(range(rng.randrange(0, 6))) for c in range(4)}
    rows, sizes = [], []
    data = []
    for k in range(120):
        c = rng.randrange(5)  # communicator 4 is unknown
        row = (rng.choice((7, 8)), rng.randrange(60), 100, rng.randrange(4), 0, 0, 0, rng.randrange(2))
        rows.append(row)
        sizes.append(len(comms.get(c, [])))
        data.append((k, *row, c))
    t = spark.createDataFrame(data, TRACE)
    comm = spark.createDataFrame(sorted(comms.items()), COMM)
    got = {}
    for r in collectives.group_slots(t, comm, block_rows).collect():
        got.setdefault((r.op, r.root, r.g), []).append(r.idx)
        assert r.n >= 1
    assert {k: sorted(v) for k, v in got.items()} == restated(rows, sizes)


def waits_of(members):
    """The positive durations of one group of calls (op, root, pid, ts, end)."""
    op, root = members[0][:2]
    last, first = max(m[3] for m in members), min(m[4] for m in members)
    at_root = [m[3] for m in members if m[2] == root]
    found = []
    for _, _, pid, ts, end in members:
        if op == 8:
            found += [("barrier_wait", last - ts), ("barrier_completion", end - first)]
        elif op in (9, 10, 11) and pid == root:
            found.append(("earlyreduce", last - ts))
        elif op in (7, 12, 13) and at_root:
            found.append(("latebroadcast", at_root[0] - ts))
        elif op >= 14:
            found += [("wait_nxn", last - ts), ("nxn_completion", end - first)]
    return [x for x in found if x[1] > 0]


def test_durations_of_random_groups(spark):
    rng = random.Random(2)
    rows, expected = [], []
    for g in range(60):
        op, root, n = rng.randrange(7, 20), rng.randrange(3), rng.randrange(1, 6)
        some = [(op, root, pid, ts := rng.randrange(50), ts + rng.randrange(50)) for pid in rng.sample(range(6), n)]
        rows += [(op, root, g, pid, ts, end) for _, _, pid, ts, end in some]
        expected += waits_of(some)
    groups = spark.createDataFrame(rows, "op int, root long, g long, pid long, ts long, end_ts long")
    assert sorted(tuple(r) for r in waits.group_durations(groups).collect()) == sorted(expected)
    assert {m for m, _ in expected} == {"barrier_wait", "barrier_completion", "earlyreduce", "latebroadcast", "wait_nxn", "nxn_completion"}


def test_communicators_part_ordinals(spark):
    """Two barriers on two communicators, close together, are two groups and not one."""
    rows = [(k, 8, ts, ts + 5, pid, 0, 0, 0, 0, c) for k, (c, pid, ts) in enumerate([(0, 0, 100), (0, 1, 110), (1, 0, 2_000_000), (1, 1, 2_000_010)])]
    comm = spark.createDataFrame([(0, [0, 1]), (1, [0, 1])], COMM)
    groups = collectives.group_collectives(spark.createDataFrame(rows, TRACE), comm, "ordinal")
    assert tuple(collectives.group_summary(groups).first()) == (2, 4)
    assert collectives.group_offsets(groups).count() == 2
    assert sorted(r.dur_ps for r in waits.group_durations(groups).where("metric = 'barrier_wait'").collect()) == [10, 10]


@pytest.mark.parametrize("values", [[*range(500), 10**18], [7] * 300 + [8] * 300 + list(range(100)), [0, *([10**15] * 50), *(10**15 + k * k for k in range(400))], [None, 5, 5, -(10**17), None]])
def test_blocks_are_even_however_values_are_spread(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    held = ranks.in_blocks(df.withColumn("idx", F.monotonically_increasing_id()), "v", 20)
    rows = held.select("v", (held["_block"] if "_block" in held.columns else F.lit(0)).alias("b")).where("v is not null").orderBy("v").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows)
    by_block = defaultdict(list)
    for r in rows:
        by_block[r.b].append(r.v)
    assert all(len(x) <= 20 or len(set(x)) == 1 for x in by_block.values())
    # At most twice as many blocks as would do.
    assert len(by_block) <= 2 * len(rows) / 20 + 2 + sum(len(set(x)) == 1 for x in by_block.values())
    got = ranks.ranked(held, [], ["v", "idx"], {"k": None, "total": F.lit(2)}).collect()
    assert sorted(r.k for r in got) == list(range(1, len(values) + 1)) and all(r.total == 2 * r.k for r in got)


@pytest.mark.parametrize("block_rows", [1, 7, 1 << 20])
def test_ordinals_and_pairs_in_blocks(spark, block_rows):
    rng = random.Random(3)
    rows = [(k, rng.choice([8, 9]), rng.choice([None, *range(30)]), 0, rng.randrange(2), 0, 0, 0, rng.choice([0, None]), rng.choice([0, None])) for k in range(200)]
    comm = spark.createDataFrame([(0, [0, 1])], COMM)
    expected, seen = set(), {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        key = (r[9], r[1], r[8], r[4])
        seen[key] = seen.get(key, 0) + 1
        expected.add((r[0], seen[key]))
    trace = spark.createDataFrame(rows, TRACE)
    grouped = collectives.group_ordinals(trace, comm, block_rows)
    assert {(r.idx, r.g) for r in grouped.collect()} == expected and grouped.count() == len(rows)

    raw = [(k, rng.choice([None, 0, 1]), rng.choice(["coll_begin", "coll_end", "send"]), rng.choice([None, *range(0, 900, 9)]), None, None, "bcast", 0, 0) for k in range(300)]
    pending, expected = {}, set()
    for seq, pid, kind, ts, *_ in sorted(raw, key=lambda r: (r[3] is not None, r[3] or 0, r[0])):
        if kind == "coll_begin":
            pending[pid] = (ts,)
        elif kind == "coll_end" and pid in pending:
            expected.add((seq, pid, pending.pop(pid)[0], ts))
    paired = pair_collectives(spark.createDataFrame(raw, RAW), block_rows)
    assert {(r.seq, r.pid, r.begin_ts, r.end_ts) for r in paired.collect()} == expected
    assert paired.count() == len(expected) > 20


def test_statistics(spark):
    rng = random.Random(11)
    lists = {f"m{k}": [rng.randrange(1, 10**13) for _ in range(n)] for k, n in enumerate((*range(1, 14), 200))}
    rows = [(m, v) for m, some in lists.items() for v in some] + [("m3", None), (None, 77)]
    got = {r["metric"]: r for r in statistics.summarize(spark.createDataFrame(rows, "metric string, dur_ps long"), block_rows=9).collect()}
    assert set(got) == set(lists)
    for m, some in lists.items():
        s, n = [x / 1e12 for x in sorted(some)], len(some)
        expected = [n, sum(s), sum(s) / n, s[0], s[-1], s[n // 4], s[n // 2], s[n * 3 // 4], sum((x - sum(s) / n) ** 2 for x in s) / n]
        assert [got[m][c] for c in ("count", "sum", "mean", "min", "max", "q25", "median", "q75", "variance")] == pytest.approx(expected)


def test_report_of_nothing_and_something(spark):
    t = trace(spark, [(3, 5000, 5000, 0, 0, 1, 1, 0), (4, 2000, 2000, 1, 0, 1, 1, 0)])
    comm = spark.createDataFrame([(0, [0, 1])], COMM)
    text = format_report(analyze(t, comm))
    lines = text.splitlines()
    assert lines[0] == "------------------ late_sender -------------------" and lines[1:3] == ["Count: 1", "Mean: 0.0000000030"]
    assert lines[lines.index("------------------ late_receiver -------------------") + 1] == "There is no late_receiver"
    assert analyze(t.limit(0), comm).where(F.col("count") > 0).count() == 0
