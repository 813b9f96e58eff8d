"""Traces: tables of raw events, their decoding, and the trace derived from an event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import NO_ROOT, SENDS, is_collective
from ..functions.joins import lookup
from ..functions.ranks import BLOCK_ROWS, in_blocks, join_blocks
from ..functions.tables import dropped, written

TRACE = "idx long, op int, ts long, end_ts long, pid long, src long, dst long, tag long, root long, comm_id long"
RAW = "seq long, pid long, kind string, ts long, peer long, tag long, coll_op string, root long, comm_id long"
COMM = "comm_id long, members array<long>"
BYTES_PER_EVENT = 64
# Names of collective kinds in raw events and their operation codes.
COLLECTIVES = {
    "bcast": 7,
    "barrier": 8,
    "reduce": 9,
    "gather": 10,
    "gatherv": 11,
    "scatter": 12,
    "scatterv": 13,
    "reduce_scatter": 14,
    "reduce_scatter_block": 15,
    "allgather": 16,
    "allgatherv": 17,
    "allreduce": 18,
    "alltoall": 19,
}
RANKS = 8


FORMS = ("parquet", "csv", "json", "orc")
MESSAGE_KINDS = ("send", "recv", "isend", "irecv_complete")
COLLECTIVE_KINDS = ("coll_begin", "coll_end")


def _read(spark: SparkSession, path: str, form: str, schema: str) -> DataFrame:
    if form not in FORMS:
        raise ValueError(f"no such format: {form}")
    reader = spark.read.schema(schema)
    return (reader.option("header", True) if form == "csv" else reader).format(form).load(path)


def read_raw(spark: SparkSession, path: str, form: str = "parquet", pids: list[int] | None = None) -> DataFrame:
    """A table of raw events (parquet, csv, json or orc) with the fixed schema ``RAW``; of all processes, or of some, which the scan then filters."""
    raw = _read(spark, path, form, RAW)
    return raw if pids is None else raw.where(F.col("pid").isin(*pids))


def read_trace(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A table of decoded events (schema ``TRACE``); columns that are missing or null get their defaults."""
    return with_defaults(_read(spark, path, form, TRACE))


def read_comm(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A table of communicators (schema ``COMM``); csv has the members as numbers with spaces between them."""
    if form != "csv":
        return _read(spark, path, form, COMM)
    listed = F.filter(F.split("members", " +"), lambda x: x != "")
    # An empty field is a null string in csv, and here a communicator without members.
    return _read(spark, path, form, "comm_id long, members string").na.fill("", ["members"]).withColumn("members", F.transform(listed, lambda x: x.cast("long")))


def communicators(comm: DataFrame) -> DataFrame:
    """One row for each id that is not null; of repeated ids the least members that are not null, none where all are."""
    members = F.coalesce(F.min("members"), F.array().cast("array<long>"))
    return comm.where("comm_id is not null").groupBy("comm_id").agg(members.alias("members"))


def validated_comm(comm: DataFrame) -> DataFrame:
    """The communicators, one row each, or a ValueError where an id has different members or one row without them."""
    wrong = comm.groupBy("comm_id").agg(F.count_distinct("members").alias("n"), F.count_if(F.col("members").isNull()).alias("none"))
    several, none = wrong.agg(F.count_if(F.col("n") > 1), F.count_if((F.col("none") > 0) | F.col("comm_id").isNull())).first()
    said = [f"{n} {what}" for n, what in ((several, "ids of different members"), (none, "ids that are null or without members")) if n]
    if said:
        raise ValueError(f"communicators have {', '.join(said)}")
    return communicators(comm)


def clock_normalized(raw: DataFrame, resolution: int = 10**12, offset: int = 0) -> DataFrame:
    """``raw`` with times in ps since the clock's offset, of ticks of which a second has ``resolution``; exact, rounded towards zero."""
    if resolution <= 0:
        raise ValueError("a clock's resolution is positive")
    return raw.withColumn("ts", F.expr(f"((cast(ts as decimal(20,0)) - {offset}BD) * {10**12}BD) div {resolution}BD"))


def with_defaults(trace: DataFrame) -> DataFrame:
    """The columns of ``TRACE`` and of a match and a group, absent or null ones filled: with 0, but these two with -1."""
    named = [c.split() for c in TRACE.split(", ")] + [["match_partner", "long"], ["coll_group", "long"]]
    blank = {"match_partner": -1, "coll_group": -1}
    return trace.select(*[F.coalesce(F.col(c) if c in trace.columns else F.lit(None), F.lit(blank.get(c, 0))).cast(kind).alias(c) for c, kind in named])


def clock_unsigned(raw: DataFrame, resolution: int = 10**12) -> DataFrame:
    """``raw``, whose times are unsigned ticks (decimals or strings below 2^64), in ps since its first tick, with a column ``overflow``.

    The first tick is found while the rows are written, so ``raw`` is read once. A time that no longer fits
    a long in ps is null and its row says so in ``overflow``; a null tick stays null; what is no tick is an error of the cast.
    """
    if resolution <= 0:
        raise ValueError("a clock's resolution is positive")
    seen = Observation()
    ticks = raw.withColumn("ts", F.col("ts").cast("decimal(20,0)"))
    held = written(ticks.observe(seen, F.min("ts").alias("first"), F.count_if((F.col("ts") < 0) | (F.col("ts") >= F.expr(f"cast({1 << 64}BD as decimal(20,0))"))).alias("wrong")), "trace-ticks")
    if seen.get.get("wrong"):
        raise ValueError(f"{seen.get['wrong']} times are no unsigned ticks of 64 bits")
    since = F.col("ts") - F.expr(f"cast({seen.get.get('first') or 0}BD as decimal(20,0))")
    # A quotient and a rest, since a decimal holds 38 digits: the first is whole seconds, at most 2^64, the second below one.
    second = F.lit(resolution).cast("decimal(20,0)")
    whole = F.floor(since.cast("decimal(20,0)") / second).cast("decimal(20,0)")
    rest = (since - whole * second).cast("decimal(20,0)")
    ps = whole * F.lit(10**12).cast("decimal(13,0)") + F.floor(rest * F.lit(10**12).cast("decimal(13,0)") / second).cast("decimal(20,0)")
    fits = ps <= F.expr(f"{(1 << 63) - 1}BD")
    return held.withColumn("_ps", ps).withColumn("overflow", F.coalesce(~fits, F.lit(False))).withColumn("ts", F.when(fits, F.col("_ps")).cast("long")).drop("_ps")


def unsound() -> dict[str, Column]:
    """What makes a raw event unusable, in words and as a condition."""
    return {
        "rows without a sequence number, process, time or kind": F.col("seq").isNull() | F.col("pid").isNull() | F.col("ts").isNull() | F.col("kind").isNull(),
        "rows of unknown kind": ~F.col("kind").isin(*MESSAGE_KINDS, *COLLECTIVE_KINDS),
        "messages without a peer": F.col("kind").isin(*MESSAGE_KINDS) & F.col("peer").isNull(),
        "collective calls without a name": F.col("kind").isin(*COLLECTIVE_KINDS) & F.col("coll_op").isNull(),
    }


def _told(counts: list[int]) -> None:
    said = [f"{n} {what}" for n, what in zip(counts, unsound(), strict=True) if n]
    if said:
        raise ValueError(f"raw events have {', '.join(said)}")


def with_columns_of_raw(raw: DataFrame) -> DataFrame:
    missing = [c.split()[0] for c in RAW.split(", ") if c.split()[0] not in raw.columns]
    if missing:
        raise ValueError(f"raw events lack the columns {', '.join(missing)}")
    return raw


def validated(raw: DataFrame) -> DataFrame:
    """``raw``, or a ValueError that says what is wrong with it: columns that are missing, rows without a process, time or kind, kinds that are not known, calls without a name."""
    _told(list(with_columns_of_raw(raw).agg(*[F.count_if(c).alias(f"n{k}") for k, c in enumerate(unsound().values())]).first()))
    return raw


def collective_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(COLLECTIVES.items(), key=lambda x: x[1]), "coll_op string, op int")


def pair_collectives(raw: DataFrame, block_rows: int = BLOCK_ROWS, seen: Observation | None = None) -> DataFrame:
    """Ends of collective calls with the time of their begin.

    A begin overwrites one that is pending; an end counts if a begin is pending and clears it. So an
    end pairs exactly if the row before it, among the begins and ends of its process, is a begin. The
    rows of a process are sorted in blocks of time; the row before a block's first is the last of the
    block before it. ``seen`` gets the numbers of begins, ends and unpaired ends when the rows are read.
    """
    calls = raw.where(F.col("kind").isin(*COLLECTIVE_KINDS)).select("seq", "pid", "kind", "ts", "coll_op", "root", "comm_id")
    calls = in_blocks(calls, "ts", block_rows, "trace-calls")
    row = F.struct("kind", "ts")
    if "_block" not in calls.columns:
        calls = calls.withColumn("before", F.lag(row).over(W.partitionBy("pid").orderBy("ts", "seq")))
    else:
        last = calls.groupBy("pid", "_block").agg(F.max(F.struct("ts", "seq", "kind")).alias("last"))
        prior = F.lag("last").over(W.partitionBy("pid").orderBy("_block"))
        last = last.select(F.col("pid").alias("_of_pid"), F.col("_block").alias("_of__block"), F.struct(prior["kind"].alias("kind"), prior["ts"].alias("ts")).alias("carried"))
        order = W.partitionBy("pid", "_block").orderBy("ts", "seq")
        calls = join_blocks(calls.withColumn("before", F.lag(row).over(order)), last, ["pid"]).withColumn("before", F.coalesce("before", "carried"))
    is_end, follows = F.col("kind") == "coll_end", F.coalesce(F.col("before.kind") == "coll_begin", F.lit(False))
    if seen:
        calls = calls.observe(seen, F.count_if(~is_end).alias("begins"), F.count_if(is_end).alias("ends"), F.count_if(is_end & ~follows).alias("unpaired_ends"))
    return calls.where(is_end & follows).select("seq", "pid", "coll_op", F.col("before.ts").alias("begin_ts"), F.col("ts").alias("end_ts"), "root", "comm_id")


def resolve_roots(calls: DataFrame, comm: DataFrame) -> DataFrame:
    """Adds comm_size, and replaces the "no root" sentinel by the least of the process and its communicator's members.

    Unknown communicators have a null size; the sentinel then becomes the process itself.
    """
    of_comm = F.struct(F.array_min("members").alias("least"), F.size("members").alias("comm_size"))
    known = written(communicators(comm).select(F.col("comm_id").alias("_comm"), of_comm.alias("_of_comm")), "comm-roots")
    root = F.when(F.col("root") == NO_ROOT, F.least("pid", F.coalesce("_of_comm.least", "pid"))).otherwise(F.col("root"))
    found = lookup(calls, {"comm_id": "_comm"}, known, "_of_comm")
    return found.withColumn("root", root).withColumn("comm_size", F.col("_of_comm.comm_size")).drop("_of_comm")


def _messages(raw: DataFrame) -> DataFrame:
    peer, pid = F.col("peer"), F.col("pid")
    out_bound = F.col("kind").isin("send", "isend")
    op = F.when(F.col("kind") == "send", 3).when(F.col("kind") == "recv", 4).when(F.col("kind") == "isend", 5).when(F.col("kind") == "irecv_complete", 6)
    return raw.select(F.col("seq").alias("idx"), op.cast("int").alias("op"), "ts", F.col("ts").alias("end_ts"), "pid", F.when(out_bound, pid).otherwise(peer).alias("src"), F.when(out_bound, peer).otherwise(pid).alias("dst"), "tag", F.lit(0).cast("long").alias("root"), "comm_id").where("op is not null")


def _named(calls: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Resolved calls as rows of a trace; those of unknown kinds are dropped, and counted in ``seen`` as are calls on unknown communicators."""
    zero = F.lit(0).cast("long")
    calls = calls.join(F.broadcast(collective_dim(calls.sparkSession)), "coll_op", "left")
    if seen:
        calls = calls.observe(seen, F.count_if(F.col("op").isNull()).alias("unknown_collectives"), F.count_if(F.col("comm_size").isNull()).alias("unresolved_comms"))
    return calls.where("op is not null").select(F.col("seq").alias("idx"), "op", F.col("begin_ts").alias("ts"), "end_ts", "pid", zero.alias("src"), zero.alias("dst"), zero.alias("tag"), "root", "comm_id")


def decode(raw: DataFrame, comm: DataFrame) -> DataFrame:
    """Raw events as a trace (schema ``TRACE``); unknown kinds of collective are dropped after pairing."""
    return _messages(raw).unionByName(_named(resolve_roots(pair_collectives(raw), comm)))


ACCOUNT = "counted long, written long, begins long, unpaired_ends long, unknown_collectives long, unknown_kinds long, unresolved_comms long"


def decode_accounted(raw: DataFrame, comm: DataFrame, block_rows: int = BLOCK_ROWS, strict: bool = False) -> tuple[DataFrame, dict[str, int]]:
    """The decoded trace, written once, and the account of it, all counted while it is decoded.

    ``counted`` messages and ends of collective calls bound what is ``written``; the difference are ends without a
    begin and collectives of unknown kind. With ``strict`` raw events that are not sound raise a ValueError.
    """
    rows, pairs, names, out = (Observation() for _ in range(4))
    kind = F.col("kind")
    counts = [F.count_if(kind.isin(*MESSAGE_KINDS, "coll_end")).alias("counted"), F.count_if(~F.coalesce(kind.isin(*MESSAGE_KINDS, *COLLECTIVE_KINDS), F.lit(False))).alias("unknown_kinds")]
    counts += [F.count_if(c).alias(f"wrong{k}") for k, c in enumerate(unsound().values())]
    messages = _messages(with_columns_of_raw(raw).observe(rows, *counts))
    calls = _named(resolve_roots(pair_collectives(raw, block_rows, pairs), comm), names)
    trace = written(messages.unionByName(calls).observe(out, F.count(F.lit(1)).alias("written")), "trace")
    found = {**rows.get, **pairs.get, **names.get, **out.get}
    if strict:
        _told([found.get(f"wrong{k}") or 0 for k in range(len(unsound()))])
    return trace, {c.split()[0]: found.get(c.split()[0]) or 0 for c in ACCOUNT.split(", ")}


def decode_account(raw: DataFrame, comm: DataFrame) -> DataFrame:
    """One row with the account of ``decode_accounted``."""
    trace, account = decode_accounted(raw, comm)
    dropped(trace)
    return raw.sparkSession.createDataFrame([tuple(account[c.split()[0]] for c in ACCOUNT.split(", "))], ACCOUNT)


def translate_ranks(raw: DataFrame, comm: DataFrame) -> DataFrame:
    """``raw`` with peers and roots, which are ranks inside the row's communicator, as locations: the member at that place.

    A rank that its communicator does not have, or of an unknown one, gives null; the sentinel for "no root"
    stays. Members stand one by one in a dimension (communicator, rank, location), which is looked up by both.
    """
    places = communicators(comm).select(F.col("comm_id").alias("_comm"), F.posexplode("members").alias("_rank", "_location"))
    places = written(places.withColumn("_rank", F.col("_rank").cast("long")), "trace-places")
    out = raw
    for column in ("peer", "root"):
        rank = F.when(F.col(column) != NO_ROOT, F.col(column)) if column == "root" else F.col(column)
        found = lookup(out.withColumn("_at", rank), {"comm_id": "_comm", "_at": "_rank"}, places, "_location")
        kept = (F.col(column) == NO_ROOT) if column == "root" else F.lit(False)
        out = found.withColumn(column, F.when(kept, F.col(column)).otherwise(F.col("_location"))).drop("_at", "_location")
    return out.select(*raw.columns)


def derived_trace(spark: SparkSession, sf_dir: str, comms: int = 1) -> DataFrame:
    """The trace of eight ranks that integer arithmetic makes of the ``events`` table, on so many communicators."""
    e, u = F.col("e"), F.col("u")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01', ts)") * 1_000_000
    base = events.select(F.col("event_id").alias("e"), F.col("user_id").alias("u"), "event_type", t.alias("t"))
    op = F.when(F.col("event_type") == "click", 3).when(F.col("event_type") == "view", 4).when(F.col("event_type") == "signup", 5).when(F.col("event_type") == "purchase", 6)
    src, dst = u % RANKS, (u + e) % RANKS
    zero = F.lit(0).cast("long")
    comm_id = e % comms if comms > 1 else zero
    messages = base.select((16 * e).alias("idx"), op.cast("int").alias("op"), F.col("t").alias("ts"), F.col("t").alias("end_ts"), F.when(op.isin(*SENDS), src).otherwise(dst).alias("pid"), src.alias("src"), dst.alias("dst"), (e % 3).alias("tag"), zero.alias("root"), zero.alias("comm_id")).where("op is not null")
    r = F.col("r")
    calls = base.where("event_type = 'error'").withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(RANKS - 1).cast("long")))).where((31 * e + 17 * r) % 97 != 0)
    kind = e % 13
    begin = F.col("t") + ((7919 * e + 104729 * r) % 1000003) * 300000
    calls = calls.select((16 * e + 1 + r).alias("idx"), (7 + kind).cast("int").alias("op"), begin.alias("ts"), (begin + 400000000000 + ((31 * e + 7919 * r) % 5003) * 1000000).alias("end_ts"), r.alias("pid"), zero.alias("src"), zero.alias("dst"), zero.alias("tag"), F.when(kind.isin(0, 2, 3, 4, 5, 6), u % RANKS).otherwise(zero).alias("root"), comm_id.alias("comm_id"))
    return messages.unionByName(calls)


def derived_comm(spark: SparkSession, comms: int = 1) -> DataFrame:
    """One communicator of all ranks; of four, the second is of half of them, the third of none, and the fourth is not known."""
    members = [list(range(RANKS)), list(range(RANKS // 2)), []]
    return spark.createDataFrame([(k, members[k]) for k in range(min(comms, 3))], COMM)


def derived_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events of the derived trace: messages of all four kinds, and begins and ends of collectives, with lost and doubled begins and unknown kinds."""
    trace = derived_trace(spark, sf_dir)
    calls = trace.where(is_collective(F.col("op")))
    e = F.floor(F.col("idx") / 16)
    names = F.create_map(*[x for name, op in COLLECTIVES.items() for x in (F.lit(op), F.lit(name))])
    root = F.when((F.col("op") == 8) | (F.col("op") >= 14), F.lit(NO_ROOT)).otherwise(F.col("root"))
    calls = calls.withColumn("e", e).withColumn("raw_root", root).withColumn("coll", names[F.col("op")])
    null = F.lit(None)

    def rows(some: DataFrame, seq: int, kind: str, ts, coll) -> DataFrame:
        return some.select((F.col("idx") * 4 + seq).alias("seq"), "pid", F.lit(kind).alias("kind"), ts.alias("ts"), null.cast("long").alias("peer"), null.cast("long").alias("tag"), coll.alias("coll_op"), F.col("raw_root").alias("root"), "comm_id")

    begins = rows(calls.where("e % 101 <> 0"), 1, "coll_begin", F.col("ts"), F.col("coll"))
    doubled = rows(calls.where("e % 101 <> 0 and e % 103 = 0"), 0, "coll_begin", F.col("ts") - 1_000_000, F.col("coll"))
    ends = rows(calls, 2, "coll_end", F.col("end_ts"), F.when(F.col("e") % 107 == 0, F.lit("unknown")).otherwise(F.col("coll")))
    op = F.col("op")
    kind = F.when(op == 3, "send").when(op == 4, "recv").when(op == 5, "isend").when(op == 6, "irecv_complete")
    peer = F.when(op.isin(*SENDS), F.col("dst")).otherwise(F.col("src"))
    messages = trace.where(kind.isNotNull()).select((F.col("idx") * 4 + 3).alias("seq"), "pid", kind.alias("kind"), "ts", peer.alias("peer"), "tag", null.cast("string").alias("coll_op"), null.cast("long").alias("root"), "comm_id")
    return begins.unionByName(doubled).unionByName(ends).unionByName(messages)


def trace_size(trace: DataFrame) -> DataFrame:
    """Number of events and bytes at the fixed width of an event."""
    n = trace.agg(F.count(F.lit(1)).alias("events"))
    return n.select("events", (F.col("events") * BYTES_PER_EVENT).alias("bytes"))


def counts_by_op(trace: DataFrame) -> DataFrame:
    return trace.groupBy("op").agg(F.count(F.lit(1)).alias("n"))


