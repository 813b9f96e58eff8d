"""Packing of documents into windows by non-negative least squares (operator 3).

Every document becomes its ids and an end id. What fills whole windows is cut off; the rest, shorter
than a window, is packed. Per shard of documents: the histogram of rest lengths, the shallow
combinations of these lengths that fill a window exactly, their non-negative repeat counts by least
squares against the histogram, rounded (to one where less and its parts are there), and the same again
over what that leaves, a few times; then the residual rests greedily, the piece that meets the end of a
window being cut there. So only the last window of a shard is short; it is padded.

A shard is what a task reads until it holds ``SHARD_IDS`` ids, so nothing is shuffled, equal rows meet
nowhere, and a lost task is simply done again. Tables of many tiny partitions pad the last window of
each; coalesce them first.

Null texts count as empty and hold the end id alone. Rows with equal or null doc_id are packed each on
its own. An empty table gives no piece. Other columns of the input are not read.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ChunkedTokenizer, table, vocabulary

WINDOW = 2048
END_ID = 1
SHARD_IDS = 1 << 22
ROUNDS = 4
LEAST = 0.02  # of repeats, below which a combination is not tried
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def combinations(lengths: np.ndarray, window: int, depth: int = 6) -> list[tuple[tuple[int, int], ...]]:
    """The exact fillings of a window, each as (length, times) pairs, from lengths in order of their frequency.

    By at most ``depth`` pieces of one or two of the lengths, by three lengths of which two are among the
    96 commonest, and by four of which three are among the 24 commonest.
    """
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    found: list[tuple[tuple[int, int], ...]] = []
    for times in range(1, depth + 1):
        if window % times == 0 and present[window // times]:
            found.append(((window // times, times),))
        for more in range(1, depth - times + 1):
            rest = window - times * lengths
            ok = (rest > 0) & (rest % more == 0)
            a, b = lengths[ok], rest[ok] // more
            ok = present[b] & (a != b)
            if times == more:
                ok &= a < b
            found += [((int(x), times), (int(y), more)) for x, y in zip(a[ok], b[ok], strict=True)]
    for size, among in ((2, 96), (3, 24)):
        some = np.array(list(itertools.combinations(lengths[:among].tolist(), size)), np.int64).reshape(-1, size)
        last = window - some.sum(axis=1)
        ok = (last > 0) & present[np.maximum(last, 0)] & (some != last[:, None]).all(axis=1)
        rows = np.unique(np.sort(np.column_stack([some[ok], last[ok]]), axis=1), axis=0)
        found += [tuple((x, 1) for x in row) for row in rows.tolist()]
    return found


def non_negative_least_squares(kinds: list[tuple[tuple[int, int], ...]], histogram: np.ndarray, steps: int = 120) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|, A's columns being the combinations; accelerated projected gradient."""
    if not kinds:
        return np.zeros(0)
    col = np.repeat(np.arange(len(kinds)), [len(k) for k in kinds])
    row = np.array([length for k in kinds for length, _ in k])
    val = np.array([times for k in kinds for _, times in k], float)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, val * x[col], minlength=len(histogram))

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(col, val * r[row], minlength=len(kinds))

    bound = max(1.0, float((np.bincount(row, val, minlength=len(histogram)).max() * np.bincount(col, val).max())))
    x = y = np.zeros(len(kinds))
    t = 1.0
    for _ in range(steps):
        z = np.maximum(0, y - back(forward(y) - histogram) / bound)
        u = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = z + (t - 1) / u * (z - x)
        x, t = z, u
    return x


def plan(tokens: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents with so many tokens."""
    pieces: list[tuple[int, int, int, int, int]] = []
    waiting: dict[int, list[int]] = {}
    n = 0  # sequences so far
    for d, size in enumerate(tokens.tolist()):
        for k in range(size // window):
            pieces.append((d, k * window, window, n, 0))
            n += 1
        if size % window:
            waiting.setdefault(size % window, []).append(d)

    def put(length: int, offset: int) -> None:
        d = waiting[length].pop()
        pieces.append((d, int(tokens[d]) - length, length, n, offset))

    for _ in range(ROUNDS):
        histogram = np.zeros(window + 1)
        for length, of in waiting.items():
            histogram[length] = len(of)
        lengths = np.array(sorted((x for x in waiting if waiting[x]), key=lambda x: (-len(waiting[x]), x)), dtype=np.int64)
        kinds = combinations(lengths, window)
        times = non_negative_least_squares(kinds, histogram)
        before = n
        for k in np.argsort(-times, kind="stable"):
            if times[k] < LEAST:
                break
            can = min(len(waiting[length]) // m for length, m in kinds[k])
            for _ in range(min(can, max(1, round(times[k])))):
                offset = 0
                for length, m in kinds[k]:
                    for _ in range(m):
                        put(length, offset)
                        offset += length
                n += 1
        if (n - before) * 100 < histogram.sum():
            break
    # The residual: largest first, then the largest that still fits; the shortest is cut where none does.
    left = sorted((length, d) for length, of in waiting.items() for d in of)
    offset = 0
    size_of = [x for x, _ in left]
    while left:
        room = window - offset
        k = bisect.bisect_right(size_of, room) - 1
        cut = k < 0
        k = max(k, 0)
        length, d = left.pop(k)
        size_of.pop(k)
        start = int(tokens[d]) - length
        if cut:
            pieces.append((d, start, room, n, offset))
            bisect.insort(left, (length - room, d))
            bisect.insort(size_of, length - room)
            n, offset = n + 1, 0
            continue
        pieces.append((d, start, length, n, offset))
        offset += length
        if offset == window:
            n, offset = n + 1, 0
    return pieces


def pack_documents(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The pieces of all documents, with their ids (little-endian unsigned 32-bit); documents are packed by the task that reads them, about ``shard_ids`` ids at a time."""
    file = vocabulary("word_bpe_49k.json", tokenizer)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = ChunkedTokenizer.shared(file, leading_space=False)
        end = np.array([end_id], coder.kind)
        first = TaskContext.get().partitionId() << 40
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first
            sizes = np.array([len(x) for x in held], np.int64)
            got = plan(sizes, window)
            for at in range(0, len(got), 2000):
                doc, start, length, sequence, offset = np.array(got[at : at + 2000], np.int64).T
                ids = [held[d][s : s + k].astype("<u4").tobytes() for d, s, k in zip(doc, start, length, strict=True)]
                columns = [pa.array([doc_ids[d] for d in doc], pa.int64()), pa.array(start), pa.array(length), pa.array(ids, pa.binary()), pa.array(sizes[doc]), pa.array(sequence + first), pa.array(offset)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            first += max(x[3] for x in got) + 1

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                for i, ids in zip(some.column(0).to_pylist(), coder.encode(some.column(1)), strict=True):
                    doc_ids.append(i)
                    held.append(np.concatenate([ids, end]))
                    waiting += len(held[-1])
                    if waiting >= shard_ids:
                        yield from flush()
                        doc_ids, held, waiting = [], [], 0
        if held:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(packed, PIECES)


def op3_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
