import random

import pyarrow as pa
import pyarrow.csv
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stallscope.plans import catalog
from stallscope.sources import locations
from stallscope.sources import trace as source
from stallscope.sources.locations import ARROW, read_locations, write_locations

SF = "/root/testdata/sf0.01"


@pytest.fixture
def pushed(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def rows_of(df):
    return sorted(map(tuple, df.select(*ARROW.names).collect()), key=repr)


def partitions(df):
    return df.rdd.getNumPartitions()


def test_location_files_have_the_rows_of_the_table(pushed, tmp_path):
    raw = source.derived_raw(pushed, SF).withColumn("pid", F.when(F.col("seq") % 50 != 1, F.col("pid")))
    raw.write.parquet(f"{tmp_path}/table")
    table = source.read_raw(pushed, f"{tmp_path}/table")
    write_locations(table, f"{tmp_path}/folder")
    got = read_locations(pushed, f"{tmp_path}/folder")
    assert rows_of(got) == rows_of(table)
    files = list((tmp_path / "folder").iterdir())
    assert len(files) >= 9 and all(len(set(pq.read_table(f)["pid"].to_pylist())) == 1 for f in files)
    assert partitions(got) == len(files)

    # Files, row groups and rows are left out by what is asked for, and what else a query says is Spark's.
    middle = table.agg(F.percentile_approx("ts", 0.5)).first()[0]
    some = read_locations(pushed, f"{tmp_path}/folder", pids=[1, 5], since=middle, until=2 * middle)
    assert partitions(some) == sum(f.name.split("-")[0] in ("1", "5") for f in files) < len(files)
    expected = source.read_raw(pushed, f"{tmp_path}/table", pids=[1, 5]).where(F.col("ts").between(middle, 2 * middle))
    assert rows_of(some) == rows_of(expected) and some.where("tag = 1").count() == expected.where("tag = 1").count()
    assert rows_of(got.where("pid = 1").union(got.where("pid = 2 or pid is null"))) == rows_of(table.where("pid is null or pid in (1, 2)"))

    # Filters that are pushed do the same, of one query for each load.
    for condition in ("pid in (1, 5)", f"ts > {middle}", f"ts <= {middle}", f"pid = 3 and ts >= {middle} and tag = 1", f"ts = {middle} or pid = 2", "pid is null", f"pid <=> 4 and ts < {middle}", "pid = 3 and pid = 4"):
        loads = [pushed.read.format("trace_events").option("push", "true").load(f"{tmp_path}/folder").where(condition) for _ in range(2)]
        assert rows_of(loads[0]) == rows_of(table.where(condition)), condition
        if condition == "pid in (1, 5)":
            assert partitions(loads[1]) == partitions(some)


def test_row_groups_are_left_out_by_their_times(tmp_path, monkeypatch):
    table = pa.table({"seq": range(1000), "pid": [7] * 1000, "ts": range(1000)})
    pq.write_table(table, f"{tmp_path}/7.parquet", row_group_size=100)
    reader = locations.PushedLocationReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([locations.GreaterThan(("ts",), 349), locations.LessThanOrEqual(("ts",), 420), locations.EqualTo(("pid",), 7), locations.EqualTo(("tag",), 1)])) == [locations.EqualTo(("tag",), 1)]
    asked = []
    whole = pq.ParquetFile.iter_batches
    monkeypatch.setattr(pq.ParquetFile, "iter_batches", lambda self, **more: asked.append(more["row_groups"]) or whole(self, **more))
    (part,) = reader.partitions()
    assert [x for b in reader.read(part) for x in b.column("ts").to_pylist()] == list(range(350, 421)) and asked == [[3, 4]]
    reader.pushFilters([])
    assert list(reader.pushFilters([locations.EqualTo(("pid",), 8)])) == [] and reader.partitions() == []


def read_lines(file, pid, low, high):
    """A form of the caller's: lines of time and kind."""
    rows = [line.split() for line in file.read().decode().splitlines()]
    yield pa.RecordBatch.from_pydict({"seq": list(range(len(rows))), "pid": [pid] * len(rows), "ts": [int(t) for t, _ in rows], "kind": [k for _, k in rows]})


def test_other_forms_and_what_is_no_location_file(pushed, tmp_path):
    (tmp_path / "own").mkdir()
    for pid in (0, 12):
        (tmp_path / "own" / f"{pid}.evt").write_text(f"5 send\n{pid} recv\n")
    got = read_locations(pushed, f"{tmp_path}/own", "tests.engine.test_sources:read_lines")
    assert sorted((r.pid, r.ts, r.kind, r.peer) for r in got.where("pid = 12").collect()) == [(12, 5, "send", None), (12, 12, "recv", None)]
    with pytest.raises(Exception, match="is no location file"):
        read_locations(pushed, f"{tmp_path}/own").collect()
    with pytest.raises(Exception, match="needs the path"):
        pushed.read.format("trace_events").load().collect()

    (tmp_path / "csv").mkdir()
    rng = random.Random(1)
    rows = [(k, 3, "send", rng.randrange(100), 1, None, None, None, 0) for k in range(50)]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], names=ARROW.names)
    pyarrow.csv.write_csv(table, tmp_path / "csv" / "3.csv")
    (tmp_path / "csv" / "_hidden").write_text("x")
    assert rows_of(read_locations(pushed, f"{tmp_path}/csv").where("ts < 50")) == sorted((r for r in rows if r[3] < 50), key=repr)
    (tmp_path / "none").mkdir()
    assert read_locations(pushed, f"{tmp_path}/none").count() == 0


def test_overwriting_replaces_and_failing_leaves_nothing(spark, tmp_path):
    raw = spark.createDataFrame([(1, 0, "send", 5, 1, 2, None, None, 0), (2, 1, "recv", 6, 0, 2, None, None, 0)], source.RAW)
    for _ in range(2):
        write_locations(raw, f"{tmp_path}/x", "overwrite")
    write_locations(raw.where("seq = 1"), f"{tmp_path}/x")
    assert rows_of(read_locations(spark, f"{tmp_path}/x")) == sorted([*map(tuple, raw.collect()), tuple(raw.where("seq = 1").first())], key=repr)
    bad = raw.withColumn("seq", F.when(F.col("pid") == 0, F.col("seq")).otherwise(F.raise_error(F.lit("no"))))
    with pytest.raises(Exception, match="no"):
        write_locations(bad, f"{tmp_path}/y")
    assert not [f for f in (tmp_path / "y").glob("*") if not f.name.startswith("_")] if (tmp_path / "y").exists() else True


def test_queries_of_the_source(spark):
    assert catalog.queries()["location_scan"](spark, SF).count() > 1000


def test_communicators(spark, tmp_path):
    comm = spark.createDataFrame([(0, [0, 1]), (0, [0, 1]), (1, []), (2, [5, 3, 5])], source.COMM)
    assert sorted(map(tuple, source.validated_comm(comm).collect())) == [(0, [0, 1]), (1, []), (2, [5, 3, 5])]
    wrong = comm.unionByName(spark.createDataFrame([(1, [4]), (None, [1]), (3, None)], source.COMM))
    with pytest.raises(ValueError, match="1 ids of different members, 2 ids that are null or without members"):
        source.validated_comm(wrong)
    assert sorted(map(tuple, source.communicators(wrong).collect())) == [(0, [0, 1]), (1, []), (2, [5, 3, 5]), (3, [])]
    for form in ("parquet", "json", "orc"):
        comm.write.format(form).save(f"{tmp_path}/{form}")
        assert sorted(map(tuple, source.read_comm(spark, f"{tmp_path}/{form}", form).collect())) == sorted(map(tuple, comm.collect()))
    comm.selectExpr("comm_id", "array_join(members, ' ') members").write.option("header", True).csv(f"{tmp_path}/csv")
    assert sorted(map(tuple, source.read_comm(spark, f"{tmp_path}/csv", "csv").collect())) == sorted((c, m) for c, m in map(tuple, comm.collect()))


@pytest.mark.parametrize("most", [0, 32 << 20])
def test_ranks_are_translated_whatever_the_size_of_the_dimension(spark, monkeypatch, most):
    from stallscope.functions import joins

    monkeypatch.setattr(joins.lookup, "__defaults__", (most,))
    monkeypatch.setattr(joins, "LEAST_HOT", 20)
    rng = random.Random(3)
    members = {0: [4, 2, 9], 1: [7], 2: [], 3: None}
    rows = []
    for k in range(400):
        call = k % 2
        rank = rng.choice([0, 0, 0, 1, 2, 3, None])
        rows.append((k, 0, "coll_end" if call else "send", k, None if call else rank, 0, "bcast", rng.choice([rank, source.NO_ROOT]) if call else None, rng.choice([0, 0, 0, 1, 2, 3, 4, None])))
    comm = spark.createDataFrame(list(members.items()), source.COMM)

    def located(c, r):
        some = members.get(c) or []
        return some[r] if r is not None and r < len(some) else None

    expected = [(s, p, kind, t, located(c, peer), tag, op, root if root == source.NO_ROOT else located(c, root), c) for s, p, kind, t, peer, tag, op, root, c in rows]
    got = source.translate_ranks(spark.createDataFrame(rows, source.RAW), comm)
    assert sorted(map(tuple, got.collect())) == expected


def test_unsigned_clocks(spark):
    big = 1 << 63
    ticks = [big, big + 7, big + 3 * 10**6, (1 << 64) - 1, None]
    raw = spark.createDataFrame([(k, str(t) if t is not None else None) for k, t in enumerate(ticks)], "seq long, ts string")
    got = [(r.ts, r.overflow) for r in source.clock_unsigned(raw, 3).orderBy("seq").collect()]
    assert got == [(0, False), (7 * 10**12 // 3, False), (10**18, False), (None, True), (None, False)]
    assert [r.ts for r in source.clock_unsigned(raw.where("seq in (0, 3)"), 10**12).orderBy("seq").collect()] == [0, (1 << 63) - 1]
    assert source.clock_unsigned(raw.limit(0)).count() == 0
    for wrong in (-1, 1 << 64):
        with pytest.raises(ValueError, match="1 times are no unsigned ticks"):
            source.clock_unsigned(spark.createDataFrame([(0, str(wrong))], "seq long, ts string"))


def test_account_of_decoding(spark):
    from tests.engine.test_command import raw_rows

    comm = spark.createDataFrame([(0, [0, 1])], source.COMM)
    more = [(8, 0, "coll_end", 30_000, None, None, "barrier", 0, 0), (9, 0, "coll_begin", 31_000, None, None, "odd", 0, 0), (10, 0, "coll_end", 32_000, None, None, "odd", 0, 5), (11, 0, "coll_begin", 33_000, None, None, "bcast", 0, 7), (12, 0, "coll_end", 34_000, None, None, "bcast", 0, 7)]
    raw = spark.createDataFrame(raw_rows() + more, source.RAW)
    trace, account = source.decode_accounted(raw, comm, strict=True)
    assert account == {"counted": 9, "written": 7, "begins": 4, "unpaired_ends": 1, "unknown_collectives": 1, "unknown_kinds": 0, "unresolved_comms": 2}
    assert rows_of_trace(trace) == rows_of_trace(source.decode(raw, comm)) and trace.count() == 7
    assert account["counted"] == account["written"] + account["unpaired_ends"] + account["unknown_collectives"]
    bad = raw.withColumn("kind", F.when(F.col("seq") == 0, "shout").otherwise(F.col("kind")))
    with pytest.raises(ValueError, match="raw events have 1 rows of unknown kind"):
        source.decode_accounted(bad, comm, strict=True)
    assert source.decode_accounted(bad, comm)[1]["unknown_kinds"] == 1
    assert set(source.decode_accounted(raw.limit(0), comm)[1].values()) == {0}


def rows_of_trace(df):
    return sorted(map(tuple, df.select(*(c.split()[0] for c in source.TRACE.split(", "))).collect()), key=repr)
