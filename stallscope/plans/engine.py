"""The whole analysis, from a trace to its report."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..functions.names import METRICS
from ..functions.tables import released, written
from ..operators.collectives import group_collectives, group_summary
from ..operators.messages import match_p2p, match_summary
from ..operators.statistics import summarize, with_all_metrics
from ..operators.waits import durations
from ..sources.locations import read_locations
from ..sources.trace import FORMS, clock_normalized, decode_accounted, derived_comm, derived_trace, read_comm, read_raw, trace_size, translate_ranks, validated_comm, with_columns_of_raw


def analyze(trace: DataFrame, comm: DataFrame, mode: str = "slot") -> DataFrame:
    """One row per metric with its nine statistics, in seconds."""
    return with_all_metrics(summarize(durations(match_p2p(trace), group_collectives(trace, comm, mode))))


# The report's labels and the statistics they show, in its order.
LABELS = (
    ("Count", "count"),
    ("Mean", "mean"),
    ("Median", "median"),
    ("Minimum", "min"),
    ("Maximum", "max"),
    ("Sum", "sum"),
    ("Variance", "variance"),
    ("Quartile 25", "q25"),
    ("Quartile 75", "q75"),
)


def format_report(stats: DataFrame) -> str:
    """The text report of the (at most eight) rows of ``analyze``."""
    rows = {r["metric"]: r for r in stats.collect()}
    lines: list[str] = []
    for metric in METRICS:
        lines.append(f"------------------ {metric} -------------------")
        r = rows.get(metric)
        if r is None or not r["count"]:
            lines.append(f"There is no {metric}")
            continue
        lines += [f"{label}: {r[c]}" if c == "count" else f"{label}: {r[c]:.10f}" for label, c in LABELS]
    return "\n".join(lines)


def banner(spark: SparkSession) -> str:
    sc = spark.sparkContext
    return f"Spark {spark.version}, master {sc.master}, parallelism {sc.defaultParallelism}"


def timed_phases(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Seconds of each phase on the derived trace, built and forced by itself without an output, all that it depends on included."""
    took: dict[str, float] = {}

    def run(name: str, build: Callable[[], DataFrame]) -> None:
        with released(spark):
            began = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            took[name] = time.perf_counter() - began

    def found() -> DataFrame:
        return durations(match_p2p(trace()), group_collectives(trace(), derived_comm(spark)))

    def trace() -> DataFrame:
        return derived_trace(spark, sf_dir)

    run("read", trace)
    run("match", lambda: match_p2p(trace()))
    run("group", lambda: group_collectives(trace(), derived_comm(spark)))
    run("group_ordinal", lambda: group_collectives(trace(), derived_comm(spark), "ordinal"))
    run("analysis", found)
    run("stats", lambda: with_all_metrics(summarize(found())))
    return took


def benchmark_path(root: str, benchmark: str = "cg", nprocs: int = 64) -> str:
    """Where the raw events of a run of a benchmark lie."""
    return f"{root}/scorep_{benchmark}_{nprocs}_trace/raw.parquet"


def _arguments(args: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="python -m stallscope.plans.engine", description="The wait states of a trace.")
    parser.add_argument("raw", nargs="?", help="table of raw events")
    parser.add_argument("communicators", nargs="?", help="table of communicators")
    parser.add_argument("--form", default="parquet", choices=(*FORMS, "locations"), help="of the raw events; locations: a folder of one file for each process")
    parser.add_argument("--communicators-form", default="parquet", choices=FORMS, help="of the communicators")
    parser.add_argument("--local-ranks", action="store_true", help="peers and roots are ranks in their communicator, not processes")
    parser.add_argument("--mode", default="slot", choices=("slot", "ordinal"))
    parser.add_argument("--pids", type=lambda x: [int(p) for p in x.split(",")], help="only these processes, by commas")
    parser.add_argument("--resolution", type=int, default=10**12, help="ticks a second of the trace's clock")
    parser.add_argument("--offset", type=int, default=0, help="ticks at which the trace begins")
    parser.add_argument("--runs", help="folder of benchmark runs, in place of a table of raw events")
    parser.add_argument("--benchmark", default="cg")
    parser.add_argument("--nprocs", type=int, default=64)
    return parser.parse_args(args)


def main(args: list[str]) -> int:
    """Reads a table of raw events and one of communicators and prints the report, its phases timed; each phase's rows are written once."""
    asked = _arguments(args)
    path = asked.raw or (benchmark_path(asked.runs, asked.benchmark, asked.nprocs) if asked.runs else None)
    if not path:
        print("Usage: python -m stallscope.plans.engine RAW_EVENTS [COMMUNICATORS] [options]", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("stallscope").getOrCreate()
    print(banner(spark), f"Trace file: {path}", sep="\n\n", end="\n\n")
    try:
        with released(spark):
            _report(spark, path, asked)
    except (ValueError, AnalysisException) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


def _report(spark: SparkSession, path: str, asked: argparse.Namespace) -> None:
    took: dict[str, float] = {}

    def timed(name: str, build: Callable[[], DataFrame], keep: bool = True) -> DataFrame:
        began = time.perf_counter()
        out = written(build(), "trace-" + name.lower().replace(" ", "-")) if keep else build()
        took[name] = (time.perf_counter() - began) * 1000
        return out

    comm = validated_comm(read_comm(spark, asked.communicators, asked.communicators_form)) if asked.communicators else derived_comm(spark).limit(0)
    if asked.form == "locations":
        raw = read_locations(spark, path, pids=asked.pids)
    else:
        raw = read_raw(spark, path, asked.form, asked.pids)
    account: dict[str, int] = {}

    def read() -> DataFrame:
        events = clock_normalized(with_columns_of_raw(raw), asked.resolution, asked.offset)
        trace, counts = decode_accounted(translate_ranks(events, comm) if asked.local_ranks else events, comm, strict=True)
        account.update(counts)
        return trace

    trace = timed("Read", read, keep=False)
    size = trace_size(trace).first()
    print(f"Events: {size['events']}", f"Data size: {size['bytes'] / (1024 * 1024):.6g} MB", sep="\n")
    print(f"Counted events: {account['counted']} (unpaired ends: {account['unpaired_ends']}, unknown collectives: {account['unknown_collectives']}, calls on unknown communicators: {account['unresolved_comms']})", end="\n\n")
    pairs = timed("P2P Matching", lambda: match_p2p(trace))
    met = match_summary(pairs).first()
    print(f"Matched events: {met['matched_events']} (pairs: {met['pairs']})", end="\n\n")
    groups = timed("Coll. Grouping", lambda: group_collectives(trace, comm, asked.mode))
    held = group_summary(groups).first()
    print(f"Groups: {held['n_groups']}, members: {held['n_members']}", end="\n\n")
    found = timed("Analysis", lambda: durations(pairs, groups))
    stats = timed("Statistics", lambda: with_all_metrics(summarize(found)))
    print("=== Analysis Results ===", format_report(stats), sep="\n", end="\n\n")
    print("=== Timing Summary ===", *[f"{name + ':':<21} {ms:.2f} ms" for name, ms in [*took.items(), ("Total", sum(took.values()))]], sep="\n")


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
