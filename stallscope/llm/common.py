"""What several operators of this subpackage share."""

from __future__ import annotations

import itertools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import dropped, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


BROADCAST_BYTES = 32 << 20
_OF_FIXED_WIDTH = 16  # bytes counted for a value, of whatever width, beside those of its text


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df``, of plain columns, with the hint to broadcast it if its rows, as counted and measured, take at most so many bytes (``BROADCAST_BYTES``); the join's rows are the same either way."""
    texts = [F.coalesce(F.sum(F.octet_length(f.name).cast("long")), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    held = F.count(F.lit(1)) * (_OF_FIXED_WIDTH * len(df.columns))
    for x in texts:
        held = held + x
    return F.broadcast(df) if df.agg(held).first()[0] <= (BROADCAST_BYTES if most is None else most) else df


MOST_HEAVY, LEAST_HEAVY = 10_000, 1000


def join_hot(rows: DataFrame, sized: DataFrame, keys: list[str], count: str, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``sized`` (keys, count, ...), one row for each key that says how many of the rows have it.

    Keys of more than a ten-thousandth of all rows (``total``, or the sum of the counts) are at most
    ``MOST_HEAVY``, so they are broadcast and their rows stay where they are; only the others are dealt by key.
    """
    if total is None:
        total = sized.agg(F.sum(count)).first()[0] or 0
    heavy = sized.where(F.col(count) > max(LEAST_HEAVY, total // MOST_HEAVY))
    if total <= LEAST_HEAVY or heavy.isEmpty():
        return rows.join(sized, keys)
    light = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(sized, keys)
    return rows.join(F.broadcast(heavy), keys).select(*light.columns).unionByName(light)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def vocabulary(name: str, path: str | None = None) -> str:
    """A tokenizer file: the given path, or the one that the installed package names."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()  # many times faster than to_pylist


class _Memory:
    """Ids of the strings seen, in Arrow and numpy arrays of a bounded number of bytes."""

    def __init__(self, kind: np.dtype):
        self.kind = kind
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids, self.sizes = np.zeros(0, self.kind), np.zeros(0, np.int32)

    def held(self) -> int:
        """Bytes, those of the table that looks strings up among them."""
        return self.known.nbytes + self.ids.nbytes + self.sizes.nbytes + 40 * len(self.known)

    def add(self, some: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, some.cast(pa.large_string())])
        self.ids = np.concatenate([self.ids, ids])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])

    def gather(self, lists: pa.Array, learn: Callable[[_Memory, pa.Array], None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings of the lists in a row, and where those of each list begin and end; ``learn`` adds the unseen."""
        numbered = pc.dictionary_encode(lists.flatten())
        found = pc.index_in(numbered.dictionary, value_set=self.known)
        new = numbered.dictionary.filter(pc.is_null(found))
        slots = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).copy()
        if len(new):
            before = len(self.known)
            learn(self, new)
            slots[slots < 0] = pc.index_in(new, value_set=self.known.slice(before)).to_numpy(zero_copy_only=False) + before
        starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        slots = slots[numbered.indices.to_numpy()]
        held = self.sizes[slots]
        ends = np.cumsum(held, dtype=np.int64)
        last = ends[-1] if len(ends) else 0
        kind = np.int32 if len(self.ids) + last < 1 << 31 else np.int64
        place = np.repeat((starts[slots] - (ends - held)).astype(kind), held)
        place += np.arange(len(place), dtype=kind)
        return self.ids[place], np.concatenate([[0], ends])[lists.offsets.to_numpy()]


class ChunkedTokenizer:
    """Ids of whole texts by the tokenizers library, with a bounded memory of encoded chunks.

    A chunk is what lies between two places where any pre-tokenizer of the two supported files cuts
    (before a space that follows a non-space), so the ids of a text are those of its chunks in a row.
    Texts with white space before a space are encoded whole. Arrow cuts many texts into chunks and
    numbers the different ones; unseen chunks are encoded many at a time, with a separator between them
    that is always one id of its own; numpy puts the ids of all chunks in a row. Where spaces lead words,
    unseen chunks are first cut once more, between a letter and a sign and around a line break, so that a
    word is encoded once whatever signs follow it.
    """

    MEMORY = 40 << 20  # bytes of each memory of chunks, beyond which it starts afresh
    TOGETHER = 64
    BYTES = 4 << 20  # of texts that are cut together; each time the memory's table is built anew

    def __init__(self, path: str, leading_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.leading_space = leading_space
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        # A line break parts words of the one file and is an id; a tilde between spaces is one of the other.
        self.mark, self.between = ("\n", "\n") if leading_space else ("~", " ~ ")
        self.mark_id = self._ids([f"a{self.between}a"])[0][1]
        self.chunks, self.pieces = _Memory(self.kind), _Memory(self.kind)

    @classmethod
    def shared(cls, path: str, leading_space: bool) -> ChunkedTokenizer:
        """One for all tasks that a Python worker runs, which keeps its memory of chunks."""
        if (path, leading_space) not in _tokenizers:
            _tokenizers[path, leading_space] = cls(path, leading_space)
        return _tokenizers[path, leading_space]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, chunk: str) -> bool:
        """Whether the chunk is sure to stand apart from a separator beside it."""
        return self.mark not in chunk and chunk[-1:].strip() != "" and (chunk[1:2].strip() != "" or len(chunk) == 1)

    def _learn(self, memory: _Memory, chunks: pa.Array) -> None:
        """Adds the ids of unseen chunks to the memory, encoded by the tokenizer."""
        sure = pc.match_substring_regex(chunks, _SURE)
        plain, alone = _strings(chunks.filter(sure)), []
        for c in _strings(chunks.filter(pc.invert(sure))):
            (plain if self._plain(c) else alone).append(c)
        groups = [plain[k : k + self.TOGETHER] for k in range(0, len(plain), self.TOGETHER)]
        for at in range(0, len(groups), 256):
            some = groups[at : at + 256]
            done: list[str] = []
            ids, sizes = [], []
            for group, found in zip(some, self._ids([self.between.join(g) for g in some]), strict=True):
                coded = np.array(found, dtype=self.kind)
                inner = coded != self.mark_id
                cuts = np.flatnonzero(~inner)
                if len(cuts) != len(group) - 1:
                    alone += group
                    continue
                done += group
                ids.append(coded[inner])
                sizes.append(np.diff(np.concatenate([[-1], cuts, [len(coded)]])) - 1)
            if done:
                memory.add(pa.array(done, pa.large_string()), np.concatenate(ids), np.concatenate(sizes))
        for at in range(0, len(alone), 20_000):
            part = alone[at : at + 20_000]
            found = self._ids(part)
            memory.add(pa.array(part, pa.large_string()), np.array([x for ids in found for x in ids], dtype=self.kind), np.array([len(ids) for ids in found]))

    def _learn_by_pieces(self, memory: _Memory, chunks: pa.Array) -> None:
        """Adds the ids of unseen chunks to the memory, put together from those of their pieces."""
        cut = pc.replace_substring_regex(pc.replace_substring_regex(chunks, _SIGN_AFTER, "\\1\0\\2"), _BREAK_WITHIN, "\\1\0\n\0\\2")
        ids, ends = self.pieces.gather(pc.split_pattern(cut, "\0"), self._learn)
        memory.add(chunks, ids, np.diff(ends))

    def _encode_cut(self, texts: pa.Array) -> list[np.ndarray]:
        for memory in (self.chunks, self.pieces):
            if memory.held() > self.MEMORY:
                memory.forget()
        texts = texts.cast(pa.large_string())
        if self.leading_space:
            cut = pc.split_pattern(pc.replace_substring(texts, " ", "\0 "), "\0")
        else:
            cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        ids, ends = self.chunks.gather(cut, self._learn_by_pieces if self.leading_space else self._learn)
        return [ids[a:b] for a, b in itertools.pairwise(ends.tolist())]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Per text the ids, of type ``self.kind``; null counts as empty."""
        out: list[np.ndarray] = []
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            before = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + self.BYTES, side="right")))
            some = pc.fill_null(texts.slice(at, upto - at), "")
            at = upto
            whole = pc.match_substring_regex(some, _SPACE_RUN) if self.leading_space else None
            if whole is None or not pc.any(whole).as_py():
                out += self._encode_cut(some)
                continue
            rest = iter(self._encode_cut(some.filter(pc.invert(whole))))
            for k, alone in enumerate(whole.to_pylist()):
                out.append(np.array(self._ids([some[k].as_py()])[0], self.kind) if alone else next(rest))
        return out


_tokenizers: dict[tuple[str, bool], ChunkedTokenizer] = {}
# A space behind white space of whatever kind, or the mark that cuts.
_SPACE_RUN = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\p{Z}] |\x{0}"
# Letters and signs of which every version of Unicode says the same; apostrophes can belong to what follows.
_LETTERS, _SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-&(-/:-@\[-`{-~"
_SIGN_AFTER = f"([{_LETTERS}])([{_SIGNS}])"
_BREAK_WITHIN = f"([{_LETTERS}{_SIGNS}])\n([{_LETTERS}])"
_SURE = f"^ ?[{_LETTERS}]+$"  # chunks that stand apart from any separator


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroups the batches of a partition sorted by ``keys`` so that no run of equal keys is cut."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, at: int) -> tuple:
        return tuple(batch.column(batch.schema.get_field_index(k))[at].as_py() for k in keys)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        last = key(batch, n - 1)
        low, high = 0, n - 1  # first row of the last run
        while low < high:
            mid = (low + high) // 2
            if key(batch, mid) == last:
                high = mid
            else:
                low = mid + 1
        if low == 0 and held and key(held[-1], held[-1].num_rows - 1) == last:
            held.append(batch)
            continue
        if low > 0:
            yield pa.Table.from_batches([*held, batch.slice(0, low)])
        elif held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(low)]
    if held:
        yield pa.Table.from_batches(held)


def connected_components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(id, component_id): for each id in an edge (a, b) the least id that it reaches.

    Alternates large-star and small-star steps, each a pre-aggregated minimum and a join in which the
    edges of a large star stay where they are; every round is written to the shared folder.
    """

    def star(pairs: DataFrame, most: int) -> DataFrame:
        sized = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        return join_hot(pairs, sized, ["u"], "n", most).select("u", "v", "m")

    def sum_of(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), name)
    before = sum_of(e)
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(star(both, 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), name)
        down = star(large, before[0])
        small = down.select("u", F.col("m").alias("v")).union(down.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        after = written(small, name)
        now = sum_of(after)
        dropped(e, large)
        e = after
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    least = e.groupBy("u").agg(F.min("v").alias("component_id")).withColumnRenamed("u", "id")
    return least.union(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())


_BUCKETS = 64


def summed_arrays(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums rows (chunk int, values binary of float32) by chunk; what arrives is one array per chunk.

    A tree of two levels: the parts of a chunk are first summed in ``_BUCKETS`` buckets, by the task that
    has sent them. Rows are dealt and sorted and added up one by one, so a task holds one sum however
    many tasks have sent a part.
    """
    spark = parts.sparkSession

    def level(some: DataFrame, keys: list[str], kind: str) -> DataFrame:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, total = None, None
            for batch in batches:
                for *k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if k != key:
                        if total is not None:
                            yield _summed(key, total)
                        key, total = k, np.zeros(len(v) // np.dtype(kind).itemsize)
                    total += np.frombuffer(v, kind)
            if total is not None:
                yield _summed(key, total)

        dealt = some.select("chunk", "bucket", "values").repartition(shuffle_partitions(spark), *keys).sortWithinPartitions("chunk", "bucket")
        return dealt.mapInArrow(add, "chunk int, bucket int, values binary")

    once = level(parts.withColumn("bucket", F.pmod(F.spark_partition_id(), F.lit(_BUCKETS))), ["chunk", "bucket"], "<f4")
    twice = level(once.withColumn("bucket", F.lit(0)), ["chunk"], "<f8")
    return {r["chunk"]: np.frombuffer(r["values"], "<f8") for r in twice.collect()}


def _summed(key: list[int], total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["chunk", "bucket", "values"])
