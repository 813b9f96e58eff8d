import random

import pytest

from stallscope.plans import engine
from stallscope.sources import trace as source

RAW = source.RAW


def raw_rows():
    """Messages of every kind and two calls of two processes."""
    return [
        (0, 0, "send", 4_000, 1, 5, None, None, 0),
        (1, 1, "recv", 1_000, 0, 5, None, None, 0),
        (2, 1, "isend", 2_000, 0, 6, None, None, 0),
        (3, 0, "irecv_complete", 9_000, 1, 6, None, None, 0),
        (4, 0, "coll_begin", 10_000, None, None, "barrier", source.NO_ROOT, 0),
        (5, 1, "coll_begin", 15_000, None, None, "barrier", source.NO_ROOT, 0),
        (6, 0, "coll_end", 20_000, None, None, "barrier", source.NO_ROOT, 0),
        (7, 1, "coll_end", 21_000, None, None, "barrier", source.NO_ROOT, 0),
    ]


@pytest.mark.parametrize("form", source.FORMS)
def test_report_of_a_table_in_every_format(spark, tmp_path, capsys, form):
    raw = spark.createDataFrame(raw_rows(), RAW)
    writer = raw.write.option("header", True) if form == "csv" else raw.write
    writer.format(form).save(f"{tmp_path}/raw")
    spark.createDataFrame([(0, [0, 1])], source.COMM).write.parquet(f"{tmp_path}/comm")
    read = source.read_raw(spark, f"{tmp_path}/raw", form)
    assert sorted(map(tuple, read.collect())) == raw_rows()
    assert engine.main([f"{tmp_path}/raw", f"{tmp_path}/comm", "--form", form]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert lines[0].startswith("Spark ") and f"Trace file: {tmp_path}/raw" in lines
    assert "Events: 6" in lines and "Matched events: 4 (pairs: 2)" in lines and "Groups: 1, members: 2" in lines
    assert any(x.startswith("Data size: 0.000366") for x in lines)
    at = lines.index("------------------ late_sender -------------------")
    assert lines[at + 1 : at + 7] == ["Count: 1", "Mean: 0.0000000030", "Median: 0.0000000030", "Minimum: 0.0000000030", "Maximum: 0.0000000030", "Sum: 0.0000000030"]
    assert "There is no wait_nxn" in lines
    at = lines.index("=== Timing Summary ===")
    assert [x.split(":")[0] for x in lines[at + 1 :]] == ["Read", "P2P Matching", "Coll. Grouping", "Analysis", "Statistics", "Total"]


def test_options(spark, tmp_path, capsys):
    # Ticks of a nanosecond, from 50 on.
    rows = [(s, p, k, t // 1000 + 50, *rest) for s, p, k, t, *rest in raw_rows()]
    spark.createDataFrame(rows, RAW).write.parquet(engine.benchmark_path(str(tmp_path), "lu", 2))
    args = ["--runs", str(tmp_path), "--benchmark", "lu", "--nprocs", "2", "--resolution", str(10**9), "--offset", "50", "--mode", "ordinal"]
    assert engine.main(args) == 0
    out = capsys.readouterr().out
    assert "Mean: 0.0000000030" in out and "Groups: 2, members: 2" in out  # without communicators each call is its own root
    assert engine.main([*args, "--pids", "1"]) == 0
    assert "Events: 3\n" in capsys.readouterr().out


def test_location_files_and_local_ranks(spark, tmp_path, capsys):
    """The same events whose peers are places in a communicator that lists the processes backwards."""
    from stallscope.sources.locations import write_locations

    rows = [(*r[:4], None if r[4] is None else 1 - r[4], *r[5:]) for r in raw_rows()]
    write_locations(spark.createDataFrame(rows, RAW), f"{tmp_path}/raw")
    spark.createDataFrame([(0, [1, 0])], source.COMM).write.parquet(f"{tmp_path}/comm")
    assert engine.main([f"{tmp_path}/raw", f"{tmp_path}/comm", "--form", "locations", "--local-ranks"]) == 0
    out = capsys.readouterr().out
    assert "Events: 6" in out and "Matched events: 4 (pairs: 2)" in out and "Groups: 1, members: 2" in out
    assert "Counted events: 6 (unpaired ends: 0, unknown collectives: 0, calls on unknown communicators: 0)" in out
    spark.createDataFrame([(0, [1, 0]), (0, [0])], source.COMM).write.parquet(f"{tmp_path}/wrong")
    assert engine.main([f"{tmp_path}/raw", f"{tmp_path}/wrong", "--form", "locations"]) == 1
    assert "1 ids of different members" in capsys.readouterr().err


def test_what_cannot_be_read_is_told(spark, tmp_path, capsys):
    assert engine.main([]) == 1
    assert capsys.readouterr().err.startswith("Usage: ")
    assert engine.main([f"{tmp_path}/absent"]) == 1
    assert capsys.readouterr().err.startswith("Error: ")
    bad = [(0, None, "send", 1, 1, 0, None, None, 0), (1, 0, "shout", 1, 1, 0, None, None, 0), (2, 0, "recv", 1, None, 0, None, None, 0), (3, 0, "coll_end", 1, None, None, None, 0, 0)]
    spark.createDataFrame(bad, RAW).write.parquet(f"{tmp_path}/bad")
    assert engine.main([f"{tmp_path}/bad"]) == 1
    said = capsys.readouterr().err
    for what in ("1 rows without a sequence number", "1 rows of unknown kind", "1 messages without a peer", "1 collective calls without a name"):
        assert what in said
    with pytest.raises(ValueError, match="lack the columns ts, tag"):
        source.validated(spark.createDataFrame([(0,)], "seq long").selectExpr("seq", "seq pid", "'send' kind", "seq peer", "'' coll_op", "seq root", "seq comm_id"))
    with pytest.raises(ValueError, match="no such format"):
        source.read_raw(spark, "x", "xml")


def test_messages_are_decoded_from_both_sides(spark):
    rng = random.Random(1)
    kinds = {"send": 3, "recv": 4, "isend": 5, "irecv_complete": 6}
    rows = [(k, rng.randrange(4), rng.choice(list(kinds)), rng.randrange(10**6), rng.randrange(4), rng.randrange(9), None, None, rng.randrange(2)) for k in range(100)]
    comm = spark.createDataFrame([(0, [0, 1])], source.COMM)
    got = sorted(tuple(r) for r in source.decode(spark.createDataFrame(rows, RAW), comm).collect())
    expected = []
    for seq, pid, kind, ts, peer, tag, _, _, c in rows:
        src, dst = (pid, peer) if kind in ("send", "isend") else (peer, pid)
        expected.append((seq, kinds[kind], ts, ts, pid, src, dst, tag, 0, c))
    assert got == expected


def test_clock_and_defaults(spark):
    raw = spark.createDataFrame([(k, 0, "send", t, 0, 0, None, None, 0) for k, t in enumerate([0, 7, 3 * 10**6, 9 * 10**18, -5])], RAW)
    assert [r.ts for r in source.clock_normalized(raw.where("seq < 3"), 3, 1).orderBy("seq").collect()] == [-333333333333, 2 * 10**12, (3 * 10**6 - 1) * 10**12 // 3]
    assert [r.ts for r in source.clock_normalized(raw).orderBy("seq").collect()] == [0, 7, 3 * 10**6, 9 * 10**18, -5]
    with pytest.raises(ValueError, match="positive"):
        source.clock_normalized(raw, 0)
    filled = source.with_defaults(spark.createDataFrame([(1, 3, None)], "idx long, op int, tag long"))
    assert tuple(filled.first()) == (1, 3, 0, 0, 0, 0, 0, 0, 0, 0, -1, -1)
