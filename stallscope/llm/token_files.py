"""Token ids in Simple-8b files (operator 10).

File format: a Parquet data set of segments in ascending document order. A segment holds the ids of
some whole documents as 64-bit words. The top four bits of a word select how many ids share its lower
60 bits and how wide each is. Ids are cut into blocks of ``BLOCK``; every block starts a new word and
``block_words`` holds the number of words before it, so that blocks decode independently and all at
once. An id of more than 60 bits is an escape: its place in the words holds 0, and ``escape_at`` and
``escape_id`` hold its position and value.

Null texts count as empty, so they hold the end id alone. Equal doc_ids keep the order of their texts.
An empty table gives no segment. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import new_path
from .common import ChunkedTokenizer, shuffle_partitions, table, vocabulary

BLOCK = 256
SEGMENT_IDS = 1 << 18
END_ID = 2
#: Fixed values of the code: ids per word and bits per id, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_POWERS = np.array([1 << k for k in range(61)], dtype=np.uint64)

SEGMENT = "part int, seq int, part_start long, n_ids long, doc_ids array<long>, doc_tokens array<long>, block_words array<int>, escape_at array<long>, escape_id array<decimal(20,0)>, words binary"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, block_words, escape_at, escape_id) of unsigned 64-bit ids."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    escape_at = np.flatnonzero(ids >= _POWERS[60])
    escape_id = ids[escape_at]
    blocks = -(-n // BLOCK)
    v = np.zeros(blocks * BLOCK, np.uint64)
    v[:n] = ids
    v[escape_at] = 0
    # An exponent is the number of bits, and exact below 2^52.
    bits = np.frexp(v.astype(np.float64))[1] if v.max() < _POWERS[52] else np.searchsorted(_POWERS, v, side="right")
    width = np.zeros((blocks, BLOCK + 240), np.uint8)  # what is past a block fits anywhere
    width[:, :BLOCK] = bits.reshape(blocks, BLOCK)
    v = v.reshape(blocks, BLOCK)
    choice = np.full((blocks, BLOCK), 15, np.uint8)
    widest, held = width[:, :BLOCK].copy(), 1  # of so many ids from a place on
    for s in range(14, -1, -1):  # a selector of more ids overrides one of fewer
        for k in range(held, COUNTS[s]):
            np.maximum(widest, width[:, k : k + BLOCK], out=widest)
        held = COUNTS[s]
        fits = widest <= BITS[s]
        if not fits.any():
            break  # nor do more ids of fewer bits
        choice[fits] = s
    at = np.zeros(blocks, np.int64)
    rows = np.arange(blocks)
    who, where, how = [], [], []
    while len(rows):
        s = choice[rows, at[rows]]
        who.append(rows)
        where.append(at[rows])
        how.append(s)
        at[rows] += COUNTS[s]
        rows = rows[at[rows] < BLOCK]
    who, where, how = np.concatenate(who), np.concatenate(where), np.concatenate(how)
    order = np.argsort(who, kind="stable")
    who, where, how = who[order], where[order], how[order]
    words = how.astype(np.uint64) << np.uint64(60)
    tail = np.zeros((blocks, BLOCK + 240), np.uint64)
    tail[:, :BLOCK] = v
    for s in range(2, 16):
        k = np.flatnonzero(how == s)
        for j in range(COUNTS[s]) if len(k) else ():
            words[k] |= tail[who[k], where[k] + j] << np.uint64(j * BITS[s])
    block_words = np.searchsorted(who, np.arange(blocks)).astype(np.int32)
    return words, block_words, escape_at, escape_id


def unpack(words: np.ndarray, block_words: np.ndarray, n: int, escape_at: np.ndarray, escape_id: np.ndarray) -> np.ndarray:
    """The ids of ``pack``; every block's place is known, so all words decode together."""
    out = np.zeros((len(block_words), BLOCK + 240), np.uint64)
    if n:
        how = (words >> np.uint64(60)).astype(np.int64)
        held = COUNTS[how]
        before = np.cumsum(held) - held
        of = np.repeat(np.arange(len(block_words)), np.diff(np.append(block_words, len(words))))
        place = before - before[block_words][of]
        for s in range(2, 16):
            k = np.flatnonzero(how == s)
            mask = _POWERS[BITS[s]] - np.uint64(1)
            for j in range(COUNTS[s]) if len(k) else ():
                out[of[k], place[k] + j] = (words[k] >> np.uint64(j * BITS[s])) & mask
    ids = out[:, :BLOCK].reshape(-1)[:n]
    ids[escape_at] = escape_id
    return ids


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of every text, each with ``end_id`` behind, as segments under ``path``."""
    spark = docs.sparkSession
    file = vocabulary("byte_bpe_50k.json", tokenizer)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = ChunkedTokenizer.shared(file, leading_space=True)
        seq = done = size = 0
        doc_ids: list = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, done, size
            lengths = [len(x) for x in held]
            words, block_words, escape_at, escape_id = pack(np.concatenate(held))
            row = {"part": part, "seq": seq, "part_start": done, "n_ids": size, "doc_ids": doc_ids, "doc_tokens": lengths, "block_words": block_words.tolist(), "escape_at": escape_at.tolist(), "escape_id": [int(x) for x in escape_id], "words": words.astype("<u8").tobytes()}
            seq, done, size = seq + 1, done + size, 0
            return pa.RecordBatch.from_pylist([row], schema=_SEGMENT)

        end = np.array([end_id], np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                for i, ids in zip(some.column(0).to_pylist(), coder.encode(some.column(1)), strict=True):
                    held.append(np.concatenate([ids.astype(np.uint64), end]))
                    doc_ids.append(i)
                    size += len(held[-1])
                    if size >= SEGMENT_IDS:
                        yield flush()
                        doc_ids, held = [], []
        if held:
            yield flush()

    dealt = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(segments, SEGMENT).write.parquet(path)


_SEGMENT = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("block_words", pa.list_(pa.int32())), ("escape_at", pa.list_(pa.int64())), ("escape_id", pa.list_(pa.decimal128(20, 0))), ("words", pa.binary())])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of each document in the files."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    # One row for each partition that wrote; what precedes it.
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("held"))
    before = parts.select("part", (F.expr("sum(held) over (order by part rows unbounded preceding)") - F.col("held")).alias("before"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = unpack(np.frombuffer(row["words"], "<u8"), np.array(row["block_words"], np.int64), row["n_ids"], np.array(row["escape_at"], np.int64), np.array([int(x) for x in row["escape_id"]], np.uint64)).astype("<u4")
                ends = np.cumsum(row["doc_tokens"])
                starts = ends - np.array(row["doc_tokens"])
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["before"] + row["part_start"], pa.int64()), pa.array(row["doc_tokens"], pa.int64()), pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return segments.join(F.broadcast(before), "part").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
