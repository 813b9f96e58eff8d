"""Folders of location files as a data source: one file, or several, for each process of a trace.

``spark.read.format("trace_events").load(folder)`` has the columns of raw events (schema ``RAW``). Every file is a
partition of its own and is read in Arrow batches. Its name begins with its process, as in ``12.parquet`` or
``12-3.csv`` (``none`` where rows have no process). The options ``pids`` (by commas), ``since`` and ``until`` (both inclusive) ask
for some processes and times: files of other processes are never opened, row groups of Parquet files are left out by
their statistics, and so are rows.

With the option ``push`` filters on ``pid`` and ``ts`` arrive here as well and do the same. The session then needs
``spark.sql.python.filterPushdown.enabled``, and each load may be used for one query only: Spark 4.1 keeps the filters that were pushed
last with the loaded table, and reads by them whatever else is made of it. Therefore it is not the default.

Other forms of file are read by a function of the caller's: the option ``reader`` names it as ``module:function``. It gets an open
file, the process of its name and the least and greatest time that are asked for (null: any), and yields record batches
with columns of ``RAW``, of which those that are missing become null; all files of the folder are then of its form.

Files are listed and opened by pyarrow, so the folder is a local path or the URI of a store that pyarrow knows.
Files whose name begins with a dot or a low line are not read. An empty folder gives no row.
"""

from __future__ import annotations

import importlib
import os
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from .trace import RAW

NAME = "trace_events"
ARROW = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (c.split() for c in RAW.split(", "))])
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1
OF_PROCESS = re.compile(r"(none|-?[0-9]+)(?:[-.].*)?$")


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), os.path.abspath(path)


def _parquet(file: pa.NativeFile, pid: int | None, low: int | None, high: int | None) -> Iterator[pa.RecordBatch]:
    table = pq.ParquetFile(file)
    at = table.schema_arrow.get_field_index("ts")

    def can_hold(group: int) -> bool:
        known = table.metadata.row_group(group).column(at).statistics if at >= 0 else None
        return known is None or not known.has_min_max or ((high is None or known.min <= high) and (low is None or known.max >= low))

    groups = [k for k in range(table.num_row_groups) if can_hold(k)]
    if groups:
        yield from table.iter_batches(row_groups=groups)


def _csv(file: pa.NativeFile, pid: int | None, low: int | None, high: int | None) -> Iterator[pa.RecordBatch]:
    kinds = {f.name: f.type for f in ARROW}
    yield from pyarrow.csv.open_csv(file, convert_options=pyarrow.csv.ConvertOptions(column_types=kinds, strings_can_be_null=True))


READERS: dict[str, Callable[..., Iterator[pa.RecordBatch]]] = {".parquet": _parquet, ".csv": _csv}


def _as_raw(batch: pa.RecordBatch) -> pa.RecordBatch:
    columns = [batch.column(f.name).cast(f.type) if f.name in batch.schema.names else pa.nulls(batch.num_rows, f.type) for f in ARROW]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)


@dataclass
class LocationFile(InputPartition):
    path: str
    pid: int | None

    def __init__(self, path: str, pid: int | None):
        super().__init__(path)
        self.path, self.pid = path, pid


class LocationReader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError(f"{NAME} needs the path of a folder")
        self.path, self.named = options["path"], options.get("reader")
        self.pids: set[int] | None = {int(x) for x in options["pids"].split(",") if x.strip()} if "pids" in options else None
        self.low, self.high = int(options.get("since", LEAST)), int(options.get("until", GREATEST))

    def partitions(self) -> list[LocationFile]:
        store, folder = _store(self.path)
        found = []
        for f in sorted(store.get_file_info(pyarrow.fs.FileSelector(folder)), key=lambda f: f.path):
            if f.type != pyarrow.fs.FileType.File or f.base_name[0] in "._":
                continue
            if not (m := OF_PROCESS.match(f.base_name)) or not (self.named or f".{f.extension}" in READERS):
                raise ValueError(f"{f.path} is no location file")
            pid = None if m[1] == "none" else int(m[1])
            if self.pids is None or pid in self.pids:
                found.append(LocationFile(f.path, pid))
        return found

    def read(self, partition: LocationFile) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return  # an empty folder is read as one partition
        low, high = (None if x in (LEAST, GREATEST) else x for x in (self.low, self.high))
        read = READERS.get(os.path.splitext(partition.path)[1])
        if self.named:
            module, _, function = self.named.partition(":")
            read = getattr(importlib.import_module(module), function)
        with _store(self.path)[0].open_input_file(partition.path) as file:
            for batch in map(_as_raw, read(file, partition.pid, low, high)):
                ts, kept = batch.column("ts"), pa.scalar(True)
                if low is not None or high is not None:
                    kept = pc.and_(pc.greater_equal(ts, self.low), pc.less_equal(ts, self.high))
                if self.pids is not None:
                    kept = pc.and_(kept, pc.is_in(batch.column("pid"), pa.array(sorted(self.pids), pa.int64())))
                yield batch if isinstance(kept, pa.Scalar) else batch.filter(kept)


class PushedLocationReader(LocationReader):
    """A reader that takes filters of the query too."""

    def _of_process(self, f: Filter) -> set[int] | None:
        if isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
            return {f.value}
        return {x for x in f.value if x is not None} if isinstance(f, In) else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and lists of ``pid`` and bounds of ``ts``; the others are Spark's."""
        for f in filters:
            of = getattr(f, "attribute", None)
            if of == ("pid",) and (some := self._of_process(f)) is not None:
                self.pids = some if self.pids is None else self.pids & some
            elif of == ("ts",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None:
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            elif of in (("pid",), ("ts",)) and isinstance(f, IsNotNull):
                yield f  # cheap, and not implied by the name of a file
            else:
                yield f


@dataclass
class _Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class LocationWriter(DataSourceArrowWriter):
    """Parquet files of one process each; they get their names when all tasks have written theirs."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        store, folder = _store(self.path)
        store.create_dir(folder)
        names: list[tuple[str, str]] = []
        out, now = None, ()
        for batch in map(_as_raw, batches):
            runs = pc.run_end_encode(batch.column("pid"))
            start = 0
            for end, pid in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
                if now != (pid,):
                    if out:
                        out.close()
                    id_ = uuid.uuid4().hex
                    names.append((f"{folder}/_{id_}", f"{folder}/{'none' if pid is None else pid}-{id_}.parquet"))
                    out, now = pq.ParquetWriter(names[-1][0], ARROW, filesystem=store), (pid,)
                out.write_batch(batch.slice(start, end - start))
                start = end
        if out:
            out.close()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        store, folder = _store(self.path)
        store.create_dir(folder)
        if self.overwrite:
            for f in store.get_file_info(pyarrow.fs.FileSelector(folder)):
                if f.type == pyarrow.fs.FileType.File and OF_PROCESS.match(f.base_name):
                    store.delete_file(f.path)
        for m in messages:
            for hidden, name in m.names if m else ():
                store.move(hidden, name)

    def abort(self, messages: list[_Written | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            for hidden, _ in m.names if m else ():
                store.delete_file(hidden)


class TraceEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> LocationReader:
        return (PushedLocationReader if self.options.get("push") == "true" else LocationReader)(self.options)

    def writer(self, schema, overwrite: bool) -> LocationWriter:
        return LocationWriter(self.options, overwrite)


def read_locations(spark: SparkSession, path: str, reader: str | None = None, pids: list[int] | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """The raw events of a folder of location files: of all processes and times, or of some."""
    spark.dataSource.register(TraceEvents)
    asked = {"reader": reader, "pids": None if pids is None else ",".join(map(str, pids)), "since": since, "until": until}
    return spark.read.format(NAME).options(**{k: v for k, v in asked.items() if v is not None}).load(path)


def write_locations(raw: DataFrame, path: str, mode: str = "append") -> None:
    """Raw events as location files, in the order of time; a process of many rows gets several files."""
    spark = raw.sparkSession
    spark.dataSource.register(TraceEvents)
    order = ["pid", "ts", "seq"]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw.select(*ARROW.names).repartitionByRange(partitions, *order).sortWithinPartitions(*order).write.format(NAME).mode(mode).save(path)
