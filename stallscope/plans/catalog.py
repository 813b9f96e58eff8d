"""The queries over the derived trace, each with equivalent SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import ALL_TO_ALL, BARRIER, FROM_ROOT, METRICS, NO_ROOT, OPERATIONS, RECVS, SENDS, TO_ROOT, metric_dim, op_dim
from ..functions.ranks import numbered
from ..functions.tables import new_path
from ..operators import collectives, messages, selection, statistics, waits
from ..sources import locations
from ..sources import trace as source
from . import store

COMMS = 4
Query = Callable[[SparkSession, str], DataFrame]


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.derived_trace(spark, sf_dir)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.match_p2p(_trace(spark, sf_dir))


def _groups(spark: SparkSession, sf_dir: str, mode: str = "slot") -> DataFrame:
    return collectives.group_collectives(_trace(spark, sf_dir), source.derived_comm(spark), mode)


def _many(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """Groups of a trace on four communicators: whole, half, empty and unknown."""
    return collectives.group_collectives(source.derived_trace(spark, sf_dir, COMMS), source.derived_comm(spark, COMMS), mode)


def _clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events whose clock ticks 24,000,000 times a second and starts late, back in ps."""
    ticks = source.derived_raw(spark, sf_dir).withColumn("ts", F.expr("ts div 1000000 * 24 + 123456789"))
    return source.clock_normalized(ticks, 24_000_000, 123_456_789).select("seq", "kind", "ts")


def _defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace without two columns and with some nulls, filled."""
    trace = _trace(spark, sf_dir).drop("dst", "comm_id")
    return source.with_defaults(trace.withColumn("tag", F.when(F.col("tag") > 0, F.col("tag"))).withColumn("end_ts", F.when(F.col("op") > 6, F.col("end_ts"))))


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waits.durations(_pairs(spark, sf_dir), _groups(spark, sf_dir))


def _rounded(stats: DataFrame, keys: tuple[str, ...] = ("metric",), digits: int = 6, of_variance: int = 3) -> DataFrame:
    return stats.select(*keys, "count", *[F.round(c, digits).alias(c) for c in ("sum", "min", "max", "mean", "median", "q25", "q75")], F.round("variance", of_variance).alias("variance"))


def _one_message_metric(name: str) -> Query:
    return lambda spark, sf_dir: waits.message_durations(_pairs(spark, sf_dir)).where(F.col("metric") == name)


def _one_group_metric(name: str) -> Query:
    return lambda spark, sf_dir: waits.group_durations(_groups(spark, sf_dir)).where(F.col("metric") == name)


def wait_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(statistics.with_all_metrics(statistics.summarize(_durations(spark, sf_dir))))


def wait_stats_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(statistics.with_all_metrics(statistics.summarize(_durations(spark, sf_dir).where("dur_ps < 0"))))


def wait_stats_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(statistics.with_all_metrics(selection.summarize_selected(_durations(spark, sf_dir))))


MINUTE = 60e12


def wait_stats_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(statistics.with_all_metrics(statistics.summarize(_durations(spark, sf_dir), scale=MINUTE)))


def wait_stats_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics by metric, and by metric and op, process, communicator, and op and communicator, of the trace on four communicators."""
    pairs = messages.match_p2p(source.derived_trace(spark, sf_dir, COMMS), carry=waits.LOCATED)
    stats = statistics.drilldown(waits.located_durations(pairs, _many(spark, sf_dir, "slot")))
    return _rounded(stats, ("level", "metric", "op", "pid", "comm_id"), 3, -3)


def metric_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics in report order with the number of their durations."""
    counts = _durations(spark, sf_dir).groupBy("metric").agg(F.count(F.lit(1)).alias("n"))
    return metric_dim(spark).join(counts, "metric", "left").select("ord", "metric", F.coalesce("n", F.lit(0)).alias("n"))


def _repeated_comms(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """Groups of four communicators of which one stands there twice, one without an id and one without members."""
    more = spark.createDataFrame([(0, list(range(source.RANKS))), (None, [0]), (2, None)], source.COMM)
    return collectives.group_collectives(source.derived_trace(spark, sf_dir, COMMS), source.derived_comm(spark, COMMS).unionByName(more), mode)


def _accounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The account of raw events some of which are of unknown kind, on known and unknown communicators."""
    noisy = F.when(F.col("seq") % 101 == 3, "noise").otherwise(F.col("kind"))
    raw = source.derived_raw(spark, sf_dir).withColumn("kind", noisy).withColumn("comm_id", F.col("seq") % 5)
    return source.decode_account(raw, source.derived_comm(spark, COMMS))


def _translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events whose peers and roots are ranks in one of four communicators (of all processes in an order of their own, of three, of none, unknown), as processes."""
    raw = source.derived_raw(spark, sf_dir).withColumn("comm_id", F.col("seq") % COMMS)
    comm = spark.createDataFrame(list(LOCAL.items()), source.COMM)
    return source.translate_ranks(raw, comm).select("seq", "kind", "comm_id", "peer", "root")


LOCAL = {0: [3, 1, 4, 0, 5, 2, 7, 6], 1: [6, 2, 5], 2: []}


def _unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events whose clock ticks 24,000,000 times a second, from beyond 2^63 on, some so late that they do not fit, in ps since the first."""
    late = F.when(F.col("seq") % 97 == 1, F.lit(10**15)).otherwise(0)
    ticks = F.expr("cast(ts div 1000000 * 24 as decimal(20,0))") + late + F.expr(f"{(1 << 63) + 12345}BD")
    raw = source.derived_raw(spark, sf_dir).withColumn("ts", ticks.cast("decimal(20,0)"))
    return source.clock_unsigned(raw, 24_000_000).select("seq", "kind", "ts", "overflow")


def _locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events of three processes in a range of time, from a folder of location files."""
    path = new_path(spark, "locations")
    locations.write_locations(source.derived_raw(spark, sf_dir), path)
    return locations.read_locations(spark, path, pids=[1, 4, 6], since=EARLY).select("seq", "pid", "kind", "ts", "peer", "root")


EARLY = 500_000 * 10**12


def _stored(spark: SparkSession, sf_dir: str) -> store.StoredTrace:
    return store.store(_trace(spark, sf_dir), source.derived_comm(spark))


def _csr(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return collectives.group_csr(_many(spark, sf_dir, "slot"))


def _group_columns(groups: DataFrame) -> DataFrame:
    return groups.select("op", "root", "g", "idx", "pid", "ts", "end_ts", "comm_size", "n")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "trace_scan": _trace,
        "trace_counts_by_op": lambda s, d: source.counts_by_op(_trace(s, d)).join(F.broadcast(op_dim(s)), "op").select("op", "name", "class", "n"),
        "trace_size": lambda s, d: source.trace_size(_trace(s, d)),
        "collective_pairing": lambda s, d: source.pair_collectives(source.derived_raw(s, d)).select("seq", "pid", "coll_op", "begin_ts", "end_ts"),
        "op_decode": lambda s, d: source.decode(source.derived_raw(s, d), source.derived_comm(s)).select("idx", "op", "ts", "end_ts", "pid", "src", "dst", "tag", "root", "comm_id"),
        "comm_resolve": lambda s, d: collectives.with_expected_size(_trace(s, d), source.derived_comm(s)).select("idx", "comm_id", "comm_size"),
        "root_sentinel": lambda s, d: source.resolve_roots(source.pair_collectives(source.derived_raw(s, d)), source.derived_comm(s)).select("seq", "pid", "root"),
        "recv_filter": lambda s, d: _trace(s, d).where(F.col("op").isin(*RECVS)),
        "p2p_pairs": _pairs,
        "p2p_unmatched_sends": lambda s, d: messages.unmatched(t := _trace(s, d), messages.match_p2p(t), True),
        "p2p_unmatched_recvs": lambda s, d: messages.unmatched(t := _trace(s, d), messages.match_p2p(t), False),
        "p2p_match_summary": lambda s, d: messages.match_summary(_pairs(s, d)),
        "p2p_match_partner": lambda s, d: messages.partners(_trace(s, d)),
        "collective_filter_sorted": lambda s, d: collectives.collectives(_trace(s, d)).select("idx", "op", "ts", "pid", "root").orderBy("ts", "idx"),
        "group_expected_size": lambda s, d: collectives.with_expected_size(_trace(s, d), source.derived_comm(s)).select("idx", "op", "root", "pid", F.greatest("comm_size", F.lit(1)).alias("expected")),
        "collective_groups_slot": lambda s, d: _group_columns(_groups(s, d)),
        "collective_groups_ordinal": lambda s, d: _groups(s, d, "ordinal").select("comm_id", "op", "root", "g", "idx", "pid", "n"),
        "collective_group_offsets": lambda s, d: collectives.group_offsets(_groups(s, d)).select("op", "root", "g", "n", F.array_join("members", ",").alias("members")),
        "collective_group_summary": lambda s, d: collectives.group_summary(_groups(s, d)),
        "slot_many_comms": lambda s, d: _group_columns(_many(s, d, "slot")),
        "ordinal_many_comms": lambda s, d: _many(s, d, "ordinal").select("comm_id", "op", "root", "g", "idx", "pid", "comm_size", "n"),
        "ordinal_durations": lambda s, d: waits.group_durations(_many(s, d, "ordinal")),
        "ordinal_group_offsets": lambda s, d: collectives.group_offsets(_many(s, d, "ordinal")).select("comm_id", "op", "root", "g", "n", F.array_join("members", ",").alias("members")),
        "ordinal_group_summary": lambda s, d: collectives.group_summary(_many(s, d, "ordinal")),
        "clock_normalized": _clock,
        "decode_defaults": _defaults,
        "all_durations": _durations,
        "wait_stats": wait_stats,
        "wait_stats_empty": wait_stats_empty,
        "metric_order": metric_order,
        "wait_stats_selected": wait_stats_selected,
        "wait_stats_minutes": wait_stats_minutes,
        "wait_stats_drilldown": wait_stats_drilldown,
        "slot_repeated_comms": lambda s, d: _group_columns(_repeated_comms(s, d, "slot")),
        "ordinal_repeated_comms": lambda s, d: _repeated_comms(s, d, "ordinal").select("comm_id", "op", "root", "g", "idx", "pid", "comm_size", "n"),
        "decode_account": _accounted,
        "ranks_translated": _translated,
        "clock_unsigned": _unsigned,
        "collective_csr_offsets": lambda s, d: _csr(s, d)[0],
        "collective_csr_members": lambda s, d: _csr(s, d)[1],
        "location_scan": _locations,
        "stored_pairs": lambda s, d: _stored(s, d).pairs(),
        "stored_durations": lambda s, d: _stored(s, d).durations(),
        "trace_row_numbers": lambda s, d: numbered(_trace(s, d).select("idx"), ["idx"], "i"),
    }
    out |= {m: _one_message_metric(m) for m in METRICS[:2]}
    return out | {m: _one_group_metric(m) for m in METRICS[2:]}


_BASE_OF = """
base as (select event_id e, user_id u, event_type k, date_diff('microsecond', timestamp '2024-01-01', ts) * 1000000 t from events),
p2p as (
  select 16*e idx, case k when 'click' then 3 when 'view' then 4 when 'signup' then 5 when 'purchase' then 6 end::int op, t ts, t end_ts,
    case when k in ('click', 'signup') then u % 8 else (u + e) % 8 end pid, u % 8 src, (u + e) % 8 dst, e % 3 tag, 0::bigint root, 0::bigint comm_id
  from base where k in ('click', 'view', 'signup', 'purchase')),
calls as (
  select 16*e + 1 + r idx, (7 + e % 13)::int op, t + ((7919*e + 104729*r) % 1000003) * 300000 ts, e, r, u
  from base, range(8) x(r) where k = 'error' and (31*e + 17*r) % 97 <> 0),
trace as (
  select * from p2p union all
  select idx, op, ts, ts + 400000000000 + ((31*e + 7919*r) % 5003) * 1000000, r, 0, 0, 0, case when e % 13 in (0,2,3,4,5,6) then u % 8 else 0 end, COMM from calls)"""
_BASE = _BASE_OF.replace("COMM", "0")

_PAIRS = """,
sides as (
  select idx, ts, case when op in (3,5) then pid else src end src, case when op in (3,5) then dst else pid end dst, tag, op in (3,5) is_send from trace where op in (3,4,5,6)),
ordered as (select *, row_number() over (partition by src, dst, tag, is_send order by idx) k from sides),
pairs as (
  select s.idx send_idx, r.idx recv_idx, s.ts send_ts, r.ts recv_ts from ordered s join ordered r using (src, dst, tag, k) where s.is_send and not r.is_send)"""

_GROUPS_OF = """,
coll as (select *, greatest(SIZE, 1)::bigint comm_size from trace where op between 7 and 19),
roots0 as (select *, row_number() over w g, sum(comm_size - 1) over (partition by op, root order by ts, idx rows unbounded preceding)::bigint hi from coll where pid = root window w as (partition by op, root order by ts, idx)),
roots as (select *, hi - (comm_size - 1) lo from roots0),
others as (select *, row_number() over (partition by op, root order by ts, idx) j from coll where pid <> root),
placed as (
  select op, root, g, idx, pid, ts, end_ts, comm_size from roots union all
  select o.op, o.root, r.g, o.idx, o.pid, o.ts, o.end_ts, r.comm_size from others o join roots r on o.op = r.op and o.root = r.root and o.j > r.lo and o.j <= r.hi),
counted as (select *, count(*) over (partition by op, root, g) n from placed),
groups as (select * from counted where n >= comm_size or n >= 2)"""
_GROUPS = _GROUPS_OF.replace("SIZE", "8")

_MANY = _BASE_OF.replace("COMM", f"e % {COMMS}") + _GROUPS_OF.replace("SIZE", "case comm_id when 0 then 8 when 1 then 4 else 0 end")
_ORDINAL = """,
called as (select *, case comm_id when 0 then 8 when 1 then 4 else 0 end::int size, row_number() over (partition by comm_id, op, root, pid order by ts, idx) g from coll),
ordinal as (select *, count(*) over (partition by comm_id, op, root, g) n from called)"""

_WAITS = """
  select 'barrier_wait' metric, (last_ts - ts)::bigint dur_ps from seen where op = 8 and last_ts > ts union all
  select 'barrier_completion', end_ts - first_end from seen where op = 8 and end_ts > first_end union all
  select 'earlyreduce', last_ts - ts from seen where op in (9,10,11) and pid = root and last_ts > ts union all
  select 'latebroadcast', root_ts - ts from seen where op in (7,12,13) and root_ts > ts union all
  select 'wait_nxn', last_ts - ts from seen where op between 14 and 19 and last_ts > ts union all
  select 'nxn_completion', end_ts - first_end from seen where op between 14 and 19 and end_ts > first_end"""
_SEEN = """,
seen as (
  select *, max(ts) over w last_ts, min(end_ts) over w first_end, max(case when pid = root then ts end) over w root_ts from GROUPS window w as (partition by KEY))"""
_DURATIONS = _SEEN.replace("GROUPS", "groups").replace("KEY", "op, root, g") + """,
durations as (
  select 'late_sender' metric, (send_ts - recv_ts)::bigint dur_ps from pairs where send_ts > recv_ts union all
  select 'late_receiver', recv_ts - send_ts from pairs where recv_ts > send_ts union all""" + _WAITS + ")"

_METRIC_DIM = "metrics(ord, metric) as (values " + ", ".join(f"({k}::int, '{m}')" for k, m in enumerate(METRICS)) + ")"

_RAW = """,
names(op, coll_op) as (values """ + ", ".join(f"({v}, '{k}')" for k, v in source.COLLECTIVES.items()) + f"""),
known as (select t.*, n.coll_op, t.idx // 16 e, case when t.op = 8 or t.op >= 14 then {NO_ROOT} else t.root end raw_root from trace t join names n using (op)),
raw as (
  select idx*4 + 1 seq, pid, 'coll_begin' kind, ts, coll_op, raw_root root from known where e % 101 <> 0 union all
  select idx*4, pid, 'coll_begin', ts - 1000000, coll_op, raw_root from known where e % 101 <> 0 and e % 103 = 0 union all
  select idx*4 + 2, pid, 'coll_end', end_ts, case when e % 107 = 0 then 'unknown' else coll_op end, raw_root from known),
prior as (select *, lag(kind) over w before_kind, lag(ts) over w begin_ts from raw window w as (partition by pid order by ts, seq)),
paired as (select seq, pid, coll_op, begin_ts, ts end_ts, case when root = {NO_ROOT} then least(pid, 0) else root end root from prior where kind = 'coll_end' and before_kind = 'coll_begin')"""


_RAW_MESSAGES = """,
events_raw as (
  select seq, pid, kind, ts, null::bigint peer, root from raw union all
  select idx*4 + 3, pid, case op when 3 then 'send' when 4 then 'recv' when 5 then 'isend' else 'irecv_complete' end, ts, case when op in (3,5) then dst else src end, null from p2p where op is not null)"""
_ACCOUNT = """,
noisy as (select * replace (case when seq % 101 = 3 then 'noise' else kind end as kind) from (select seq, pid, kind, ts, coll_op from raw union all select idx*4 + 3, pid, case op when 3 then 'send' when 4 then 'recv' when 5 then 'isend' else 'irecv_complete' end, ts, null from p2p where op is not null)),
befores as (select *, lag(kind) over (partition by pid order by ts, seq) was from noisy where kind in ('coll_begin', 'coll_end')),
ended as (select *, coalesce(was = 'coll_begin', false) follows from befores where kind = 'coll_end')
select (select count(*) from noisy where kind not in ('coll_begin', 'noise')) counted,
  (select count(*) from noisy where kind not in ('coll_begin', 'coll_end', 'noise')) + (select count(*) from ended where follows and coll_op <> 'unknown') as written,
  (select count(*) from befores where kind = 'coll_begin') begins, (select count(*) from ended where not follows) unpaired_ends, (select count(*) from ended where follows and coll_op = 'unknown') unknown_collectives,
  (select count(*) from noisy where kind = 'noise') unknown_kinds, (select count(*) from ended where follows and seq % 5 > 2) unresolved_comms"""
_TRANSLATED = f"""
select seq, kind, seq % {COMMS} comm_id, case seq % {COMMS} """ + " ".join(f"when {c} then ({m}::bigint[])[peer + 1]" for c, m in LOCAL.items()) + f""" end peer,
  case when root = {NO_ROOT} then root else case seq % {COMMS} """ + " ".join(f"when {c} then ({m}::bigint[])[root + 1]" for c, m in LOCAL.items()) + """ end end root from events_raw"""
_UNSIGNED = """,
ticks as (select seq, kind, (ts // 1000000 * 24)::hugeint + case when seq % 97 = 1 then 1000000000000000 else 0 end + 9223372036854788153 t from events_raw),
since as (select seq, kind, (t - min(t) over ())::hugeint * 1000000000000 // 24000000 ps from ticks)
select seq, kind, case when ps <= 9223372036854775807 then ps::bigint end ts, ps > 9223372036854775807 overflow from since"""
_LOCATED = _SEEN.replace("GROUPS", "groups").replace("KEY", "op, root, g") + """,
waiting as (
  select 'late_sender' metric, (send_ts - recv_ts)::bigint dur_ps, recv_idx idx from pairs where send_ts > recv_ts union all
  select 'late_receiver', recv_ts - send_ts, send_idx from pairs where recv_ts > send_ts union all""" + _WAITS.replace(" from seen", ", idx from seen") + """),
located as (select metric, dur_ps, op, pid, comm_id from waiting join trace using (idx)),
parts as (""" + " union all ".join(f"select '{','.join(x)}' as level, metric, {', '.join(c if c in x else f'null::{kind} {c}' for c, kind in (('op', 'int'), ('pid', 'bigint'), ('comm_id', 'bigint')))}, dur_ps from located" for x in statistics.DRILLS) + """),
placed_parts as (select *, row_number() over (w order by dur_ps) - 1 k, count(*) over w n from parts window w as (partition by level, metric, op, pid, comm_id)),
stats as (
  select level, metric, op, pid, comm_id, any_value(n) n, sum(dur_ps::decimal(38,0))::double total, min(dur_ps)::double low, max(dur_ps)::double high, var_pop(dur_ps / 1e12) var,
    max(case when k = n // 4 then dur_ps end)::double p25, max(case when k = n // 2 then dur_ps end)::double p50, max(case when k = n * 3 // 4 then dur_ps end)::double p75
  from placed_parts group by all)
select level, metric, op, pid, comm_id, n count, round(total / 1e12, 3) as sum, round(low / 1e12, 3) min, round(high / 1e12, 3) max, round(total / 1e12 / n, 3) mean, round(p50 / 1e12, 3) median, round(p25 / 1e12, 3) q25, round(p75 / 1e12, 3) q75, round(var, -3) variance from stats"""
_CSR = """,
numbered_members as (select op, root, g, idx, row_number() over (order by op, root, g, pid <> root, ts, idx) - 1 as position from groups),
offsets as (select op, root, g, min(position) begin_offset, max(position) + 1 end_offset from numbered_members group by all),
numbered_groups as (select row_number() over (order by op, root, g) - 1 gid, * from offsets)"""


def _stats(source_rows: str, unit: str = "1e12") -> str:
    scaled = ", ".join(f"round(coalesce({x}, 0.0), 6) {c}" for c, x in (("sum", f"total / {unit}"), ("min", f"low / {unit}"), ("max", f"high / {unit}"), ("mean", f"total / {unit} / n"), ("median", f"p50 / {unit}"), ("q25", f"p25 / {unit}"), ("q75", f"p75 / {unit}")))
    return f""", {_METRIC_DIM},
ranked as (select metric, dur_ps, row_number() over (partition by metric order by dur_ps) - 1 k, count(*) over (partition by metric) n from {source_rows}),
stats as (
  select metric, any_value(n) n, sum(dur_ps::decimal(38,0))::double total, min(dur_ps)::double low, max(dur_ps)::double high, var_pop(dur_ps / {unit}) var,
    max(case when k = n // 4 then dur_ps end)::double p25, max(case when k = n // 2 then dur_ps end)::double p50, max(case when k = n * 3 // 4 then dur_ps end)::double p75
  from ranked group by metric)
select metric, coalesce(n, 0)::bigint count, {scaled}, round(coalesce(var, 0.0), 3) variance from metrics left join stats using (metric)"""


def oracle_sql() -> dict[str, str]:
    trace, raw = f"with {_BASE}", f"with {_BASE}{_RAW}"
    pairs = trace + _PAIRS
    groups = trace + _GROUPS
    both = trace + _PAIRS + _GROUPS + _DURATIONS
    names = ", ".join(f"({k}::int, '{name}', '{kind}')" for k, name, kind in _op_rows())
    many = f"with {_MANY}"
    out = {
        "trace_scan": f"{trace} select * from trace",
        "trace_counts_by_op": f"{trace}, dim(op, name, class) as (values {names}) select op, name, class, count(*) n from trace join dim using (op) group by all",
        "trace_size": f"{trace} select count(*) events, count(*) * 64 bytes from trace",
        "collective_pairing": f"{raw} select seq, pid, coll_op, begin_ts, end_ts from paired",
        "op_decode": f"{raw} select seq idx, op::int op, begin_ts ts, end_ts, pid, 0::bigint src, 0::bigint dst, 0::bigint tag, root, 0::bigint comm_id from paired join names using (coll_op) union all select idx * 4 + 3, op, ts, ts, pid, src, dst, tag, 0, 0 from p2p where op is not null",
        "comm_resolve": f"{trace} select idx, comm_id, 8::int comm_size from trace where op between 7 and 19",
        "root_sentinel": f"{raw} select seq, pid, root from paired",
        "recv_filter": f"{trace} select * from trace where op in (4, 6)",
        "p2p_pairs": f"{pairs} select * from pairs",
        "p2p_unmatched_sends": f"{pairs} select idx, op, ts, pid, src, dst, tag from trace where op in (3,5) and idx not in (select send_idx from pairs)",
        "p2p_unmatched_recvs": f"{pairs} select idx, op, ts, pid, src, dst, tag from trace where op in (4,6) and idx not in (select recv_idx from pairs)",
        "p2p_match_summary": f"{pairs} select count(*) * 2 matched_events, count(*) pairs from pairs",
        "p2p_match_partner": f"{pairs} select t.idx, coalesce(a.recv_idx, b.send_idx, -1)::bigint match_partner from trace t left join pairs a on t.idx = a.send_idx left join pairs b on t.idx = b.recv_idx",
        "collective_filter_sorted": f"{trace} select idx, op, ts, pid, root from trace where op between 7 and 19 order by ts, idx",
        "group_expected_size": f"{trace} select idx, op, root, pid, 8::int expected from trace where op between 7 and 19",
        "collective_groups_slot": f"{groups} select op, root, g, idx, pid, ts, end_ts, comm_size, n from groups",
        "collective_groups_ordinal": f"{groups}, o as (select *, row_number() over (partition by comm_id, op, root, pid order by ts, idx) g from coll) select comm_id, op, root, g, idx, pid, count(*) over (partition by comm_id, op, root, g) n from o",
        "collective_group_offsets": f"{groups} select op, root, g, count(*) n, string_agg(idx, ',' order by pid <> root, ts, idx) members from groups group by op, root, g",
        "collective_group_summary": f"{groups}, sizes as (select count(*) n from groups group by op, root, g) select count(*) n_groups, coalesce(sum(n), 0)::bigint n_members from sizes",
        "slot_many_comms": f"{many} select op, root, g, idx, pid, ts, end_ts, comm_size, n from groups",
        "ordinal_many_comms": f"{many}{_ORDINAL} select comm_id, op, root, g, idx, pid, size comm_size, n from ordinal",
        "ordinal_durations": many + _ORDINAL + _SEEN.replace("GROUPS", "ordinal").replace("KEY", "comm_id, op, root, g") + _WAITS,
        "ordinal_group_offsets": f"{many}{_ORDINAL} select comm_id, op, root, g, count(*) n, string_agg(idx, ',' order by pid <> root, ts, idx) members from ordinal group by comm_id, op, root, g",
        "ordinal_group_summary": f"{many}{_ORDINAL}, sizes as (select count(*) n from ordinal group by comm_id, op, root, g) select count(*) n_groups, coalesce(sum(n), 0)::bigint n_members from sizes",
        "clock_normalized": f"{raw} select seq, kind, ts // 1000000 * 1000000 ts from raw union all select idx * 4 + 3, case op when 3 then 'send' when 4 then 'recv' when 5 then 'isend' else 'irecv_complete' end, ts // 1000000 * 1000000 from p2p where op is not null",
        "decode_defaults": f"{trace} select idx, op, ts, case when op > 6 then end_ts else 0 end end_ts, pid, src, 0::bigint dst, tag, root, 0::bigint comm_id, -1::bigint match_partner, -1::bigint coll_group from trace",
        "all_durations": f"{both} select metric, dur_ps from durations",
        "wait_stats": both + _stats("durations"),
        "wait_stats_empty": both + _stats("(select * from durations where dur_ps < 0)"),
        "metric_order": f"{both}, {_METRIC_DIM} select ord, metric, count(dur_ps) n from metrics left join durations using (metric) group by ord, metric",
        "wait_stats_selected": both + _stats("durations"),
        "wait_stats_minutes": both + _stats("durations", "60e12"),
        "wait_stats_drilldown": many + _PAIRS + _LOCATED,
        "slot_repeated_comms": f"{many} select op, root, g, idx, pid, ts, end_ts, comm_size, n from groups",
        "ordinal_repeated_comms": f"{many}{_ORDINAL} select comm_id, op, root, g, idx, pid, size comm_size, n from ordinal",
        "decode_account": raw + _ACCOUNT,
        "ranks_translated": raw + _RAW_MESSAGES + _TRANSLATED,
        "clock_unsigned": raw + _RAW_MESSAGES + _UNSIGNED,
        "collective_csr_offsets": f"{many}{_CSR} select gid, op, root, g, begin_offset, end_offset from numbered_groups",
        "collective_csr_members": f"{many}{_CSR} select position, gid, idx from numbered_members join numbered_groups using (op, root, g)",
        "location_scan": f"{raw}{_RAW_MESSAGES} select * from events_raw where pid in (1, 4, 6) and ts >= {EARLY}",
        "stored_pairs": f"{pairs} select * from pairs",
        "stored_durations": f"{both} select metric, dur_ps from durations",
        "trace_row_numbers": f"{trace} select idx, row_number() over (order by idx) - 1 i from trace",
    }
    return out | {m: f"{both} select metric, dur_ps from durations where metric = '{m}'" for m in METRICS}


def _op_rows() -> list[tuple[int, str, str]]:
    kinds = {"send": SENDS, "recv": RECVS, "barrier": BARRIER, "n_to_1": TO_ROOT, "1_to_n": FROM_ROOT, "n_to_n": ALL_TO_ALL}
    return [(k, name, next((c for c, codes in kinds.items() if k in codes), "other")) for k, name in enumerate(OPERATIONS)]
