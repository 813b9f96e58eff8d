"""Hard negatives by a two-dimensional block product of integer vectors (operator 12).

Vectors become integers and are cut twice: rows into blocks and dimensions into chunks. So are those of the
anchors. The tiles of blocks of anchors and blocks of rows are dealt to cells: a cell has a group of blocks of
anchors and a share of the blocks of rows that these meet. It holds the anchors, takes rows block by block, adds the
partial products of the chunks to a tile of scores and keeps of all its tiles only the first rows of each anchor, by which
later tiles are narrowed. So no score of a tile leaves its task, and what is shuffled are rows, anchors and first rows.

The first pass is over pairs of the same label and gives the positives. With them an anchor has one window of scores for
each; the second pass, over pairs of different labels, keeps the first rows inside each window. In both the first rows of
an anchor's cells meet once more. Blocks of rows are of one label where a label has enough rows, labels with few rows
share blocks; the first pass leaves out blocks of other groups of labels, the second the anchors of a block's own label.

A block has about ``ROWS`` rows and a tile ``ROWS`` x ``ANCHORS`` scores; a group of anchors takes about ``GROUP_BYTES``
and its rows are dealt to at most ``CELLS`` cells, whatever the input. So rows are sent once in a pass for each group of
anchors (65,536 of 64 dimensions, of 3.3 million rows), anchors and first rows at most ``CELLS`` times; products
remain as many as anchors times rows, as is asked. A label with any share of the rows has as many blocks as it needs. The
driver knows the counts of labels that have a block of their own (at most one for ``ROWS`` rows), no rows.

Sums are exact: floating point multiplies only tiles whose bound is below what it holds exactly, others are
multiplied as int64, which wraps beyond 2^63.

Defined results: rows with a null id, label or vector or a component that is null or not finite take no part;
rows that repeat an id and a label (as changed) are one, of the least vector; rows that share an id but not the
label are apart, but never each other's positive or negative; of vectors of different lengths the shorter counts as if
followed by zeros; components beyond 2^53 count as 2^53; rows of equal scores stand in the order of their
ids, and of one id in that of labels; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, shuffle_partitions, table, written

ROWS, ANCHORS, DIMENSIONS = 2048, 512, 32
GROUP_BYTES, CELLS = 32 << 20, 24
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # hundredths of the positive's score between which a negative's lies
SCALE = 256
BLOCK = "bid int, chunk int, ids binary, labels binary, vectors binary, windows binary"


def integer_vectors(embeddings: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v): the rows that take part, once each, with integer vectors and labels changed where the contract changes them."""
    x, big = F.col(vector), float(1 << 53)
    sound = F.col(id_).isNotNull() & F.col("label").isNotNull() & x.isNotNull()
    sound &= F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    scaled = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(big)), F.lit(-big))).cast("long"))
    changed = F.when(F.col(id_) % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.where(sound).select(F.col(id_).cast("long").alias("vec_id"), changed.cast("long").alias("label"), scaled.alias("v"))
    return rows.groupBy("vec_id", "label").agg(F.min("v").alias("v"))


class Directory:
    """Which blocks there are: for labels of more than ``most`` rows their own, others share blocks by a hash of the label.

    A group is such a label, or one shared block; groups and blocks are numbered in a row.
    """

    def __init__(self, rows: DataFrame, most: int):
        counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        large = {r["label"]: -(-r["n"] // most) for r in counts.where(F.col("n") > most).collect()}
        n = counts.where(F.col("n") <= most).agg(F.sum("n")).first()[0] or 0
        self.shared = -(-n // most)
        self.labels = dict(zip(sorted(large), range(len(large)), strict=True))
        sizes = [large[x] for x in self.labels] + [1] * self.shared
        self.first = [0, *np.cumsum(sizes).tolist()]
        self.spark = rows.sparkSession

    def grouped(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the number of their group (``grp``), the first of its blocks and how many these are."""
        shared = F.lit(len(self.labels)) + F.pmod(F.xxhash64("label"), F.lit(max(1, self.shared)))
        known = self.spark.createDataFrame([(x, g, self.first[g], self.first[g + 1] - self.first[g]) for x, g in self.labels.items()], "label long, _grp int, _first int, _n int")
        rows = rows.join(F.broadcast(known), "label", "left")
        grp = F.coalesce("_grp", shared.cast("int"))
        first = F.coalesce("_first", (shared - len(self.labels) + self.first[len(self.labels)]).cast("int"))
        return rows.select(*[c for c in rows.columns if c[0] != "_"], grp.alias("grp"), first.alias("first"), F.coalesce("_n", F.lit(1)).alias("blocks"))


def _packed(rows: DataFrame, chunk: int, tasks: int, windows: bool = False) -> DataFrame:
    """Rows (bid, vec_id, label, v, and ``windows``, where asked) as one row per block and chunk of dimensions (schema ``BLOCK``), ids ascending."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("vec_id", "ascending"), ("label", "ascending")])
        lists = t.column("v").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        width = int(sizes.max(initial=1))
        whole = np.zeros((len(t), max(1, width)), np.int64)
        whole[np.arange(whole.shape[1]) < sizes[:, None]] = flat
        ids, labels = (t.column(c).to_numpy().astype("<i8").tobytes() for c in ("vec_id", "label"))
        more = b"".join(t.column("windows").to_pylist()) if windows else b""
        out = {"bid": [], "chunk": [], "ids": [], "labels": [], "vectors": [], "windows": []}
        for k in range(0, whole.shape[1], chunk):
            part = np.zeros((len(t), chunk), "<i8")
            part[:, : min(chunk, whole.shape[1] - k)] = whole[:, k : k + chunk]
            low = np.abs(part).max(initial=0) < 1 << 15  # as narrow as they can be: blocks are sent to every block that they meet
            head = ids, labels, more
            values = [t.column("bid")[0].as_py(), k // chunk, head[0], head[1], part.astype("<i2").tobytes() if low else part.tobytes(), head[2]]
            for name, v in zip(out, values, strict=True):
                out[name].append(v)
        return pa.table({"bid": pa.array(out["bid"], pa.int32()), "chunk": pa.array(out["chunk"], pa.int32()), **{c: pa.array(out[c], pa.binary()) for c in ("ids", "labels", "vectors", "windows")}})

    return rows.repartition(tasks, "bid").groupBy("bid").applyInArrow(pack, BLOCK)


def _matrix(data: bytes, n: int, chunk: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if len(data) == n * chunk * 2 else "<i8").reshape(n, chunk)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly, as int64."""
    return _whole(_tile([(a, b)], a.shape[0], b.shape[0]))


def _whole(scores: np.ndarray) -> np.ndarray:
    return scores if scores.dtype == np.int64 else np.rint(scores).astype(np.int64)


def _tile(chunks: list[tuple[np.ndarray, np.ndarray]], n: int, m: int) -> np.ndarray:
    """The sum of the products of chunks (n rows of anchors, m rows), whole numbers in a type that holds them and all sums exactly."""
    bound = sum(int(np.abs(a, dtype=np.int64).max(initial=0)) * int(np.abs(b, dtype=np.int64).max(initial=0)) * a.shape[1] for a, b in chunks)
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    total = np.zeros((n, m), kind)
    for a, b in chunks:
        total += a.astype(kind, copy=False) @ b.astype(kind, copy=False).T
    return total


def first_of(scores: np.ndarray, able: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``most`` highest able scores of each row, of equal ones the first columns."""
    least = np.iinfo(np.int64).min
    held = np.where(able, scores, least)
    if held.shape[1] > most:
        bar = np.partition(held, held.shape[1] - most, axis=1)[:, held.shape[1] - most]
        able = able & (held >= bar[:, None])
    row, column = np.nonzero(able)
    order = np.lexsort((column, -held[row, column], row))
    row, column = row[order], column[order]
    starts = np.searchsorted(row, row)
    kept = np.arange(len(row)) - starts < most
    return row[kept], column[kept]


def _hundredths(x: np.ndarray, n: int) -> np.ndarray:
    """n x / 100, rounded down, without a product that could overflow."""
    return x // 100 * n + x % 100 * n // 100


META = ("ids", "labels", "windows")
FOUND = "anchor_id long, anchor_label long, window int, id long, label long, score long"


class _First:
    """The ``most`` first rows (highest scores, then least ids, then least labels) of each slot, of rows that come in any order."""

    def __init__(self, slots: int, most: int):
        self.n = np.zeros(slots, np.int64)
        self.score, self.id, self.label = (np.zeros((slots, most), np.int64) for _ in range(3))
        self.most = most

    def bars(self, low: np.ndarray) -> np.ndarray:
        """The least score of each slot that can still count: that of its last row, or ``low`` while there is room."""
        return np.where(self.n == self.most, self.score[:, -1], low)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        last = self.score[slot, -1], self.id[slot, -1], self.label[slot, -1]
        behind = (ids > last[1]) | ((ids == last[1]) & (labels > last[2]))
        able = (self.n[slot] < self.most) | (score > last[0]) | ((score == last[0]) & ~behind)
        slot, score, ids, labels = slot[able], score[able], ids[able], labels[able]
        met = np.unique(slot)
        of, place = np.nonzero(np.arange(self.most) < self.n[met][:, None])
        held = met[of], place
        slot = np.concatenate([slot, held[0]])
        score, ids, labels = (np.concatenate([new, old[held]]) for new, old in ((score, self.score), (ids, self.id), (labels, self.label)))
        order = np.lexsort((labels, ids, ~score, slot))  # not the negative, which the least number lacks
        slot, score, ids, labels = slot[order], score[order], ids[order], labels[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = place < self.most
        at = slot[kept], place[kept]
        self.score[at], self.id[at], self.label[at] = score[kept], ids[kept], labels[kept]
        self.n[met] = np.minimum(np.bincount(slot, minlength=len(self.n))[met], self.most)


class _Cell:
    """A group of anchors and the first rows of each, by windows of scores where ``positives`` is not 0, else of its own label."""

    def __init__(self, blocks: list[dict], size: int, positives: int, most: int):
        """``blocks`` by their metadata and chunks; ``windows`` hold for each anchor so many positive scores, those that are not there marked by a 0 in the second half."""
        ids, labels, windows = (np.concatenate([np.frombuffer(b[c], "<i8") for b in blocks]) for c in META)
        by_label = np.argsort(labels, kind="stable")
        self.ids, self.labels, self.size, self.same = ids[by_label], labels[by_label], size, not positives
        self.windows = max(1, positives)
        chunks = sorted({k for b in blocks for k in b["chunks"]})
        sizes = [len(b["ids"]) // 8 for b in blocks]
        width = next(iter(blocks[0]["chunks"].values())).shape[1]
        self.chunks = {k: np.concatenate([b["chunks"].get(k, np.zeros((n, width), np.int16)) for b, n in zip(blocks, sizes, strict=True)])[by_label] for k in chunks}
        n, limit = len(ids), np.iinfo(np.int64)
        if self.same:
            self.low, self.high, self.open = np.full((n, 1), limit.min), np.full((n, 1), limit.max), np.ones((n, 1), bool)
        else:
            windows = windows.reshape(n, 2, positives)[by_label]
            self.low, self.high, self.open = -_hundredths(-windows[:, 0], LOW), _hundredths(windows[:, 0], HIGH), windows[:, 1] > 0
        self.first = _First(n * self.windows, most)

    def take(self, ids: np.ndarray, labels: np.ndarray, chunks: dict[int, np.ndarray]) -> None:
        """Goes through the tiles of a block of rows."""
        spans = [(0, len(self.ids))]
        if labels[0] == labels[-1] and (labels == labels[0]).all():
            own = tuple(np.searchsorted(self.labels, labels[0], side).item() for side in ("left", "right"))
            spans = [own] if self.same else [(0, own[0]), (own[1], len(self.ids))]
        for low, high in spans:
            for at in range(low, high, self.size):
                self._tile(slice(at, min(high, at + self.size)), ids, labels, chunks)

    def _tile(self, some: slice, ids: np.ndarray, labels: np.ndarray, chunks: dict[int, np.ndarray]) -> None:
        a_ids, a_labels = self.ids[some], self.labels[some]
        tile = _tile([(self.chunks[k][some], b) for k, b in chunks.items() if k in self.chunks], len(a_ids), len(ids))
        bars = np.maximum(self.first.bars(np.iinfo(np.int64).min).reshape(-1, self.windows)[some], self.low[some])
        tops, is_open = self.high[some], self.open[some] & (bars <= self.high[some])
        limit = np.iinfo(np.int64)
        if tile.dtype == np.int64:
            least, most = limit.min, limit.max
        else:  # no score is beyond, and the type holds these exactly
            most = (1 << 24) if tile.dtype == np.float32 else (1 << 53)
            least = -most
        lows, highs = np.where(is_open, bars, limit.max).min(axis=1, keepdims=True), np.where(is_open, tops, limit.min).max(axis=1, keepdims=True)
        able = (tile >= np.clip(lows, least, most).astype(tile.dtype)) & (tile <= np.clip(highs, least, most).astype(tile.dtype))
        able &= is_open.any(axis=1, keepdims=True)
        if not able.any():
            return
        able &= a_ids[:, None] != ids
        able &= (a_labels[:, None] == labels) == self.same
        dense = np.count_nonzero(able) * 8 > able.size
        if not dense:
            i, j = np.nonzero(able)
            scores = _whole(tile[i, j])
        else:
            whole = _whole(tile)
        for k in range(self.windows):
            low, high = bars[:, k], tops[:, k]
            if dense:
                x, y = first_of(whole, able & (whole >= low[:, None]) & (whole <= high[:, None]) & is_open[:, k, None], self.first.most)
                s = whole[x, y]
            else:
                inside = (scores >= low[i]) & (scores <= high[i]) & is_open[i, k]
                x, y, s = i[inside], j[inside], scores[inside]
            if len(x):
                self.first.add((x + some.start) * self.windows + k, s, ids[y], labels[y])

    def found(self) -> pa.RecordBatch:
        slot, place = np.nonzero(np.arange(self.first.most) < self.first.n[:, None])
        of = slot // self.windows
        columns = self.ids[of], self.labels[of], (slot % self.windows + 1).astype(np.int32), self.first.id[slot, place], self.first.label[slot, place], self.first.score[slot, place]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in FOUND.split(", ")])


def _met(asking: DataFrame, blocks: DataFrame, tasks: int, size: int, chunk: int, positives: int, most: int) -> DataFrame:
    """(schema ``FOUND``) the first rows that each cell has for its anchors: blocks of anchors and of rows, as ``_packed`` gives them, each with its ``cell``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # In each cell anchors come first, then rows, both block by block and of these chunk by chunk.
        cell, now, held, block = None, None, [], None

        def take() -> None:
            nonlocal now
            if block and not block["is_row"]:
                held.append(block)
            elif block and held:
                now = now or _Cell(held, size, positives, most)
                now.take(*(np.frombuffer(block[c], "<i8") for c in ("ids", "labels")), block["chunks"])

        for batch in batches:
            for k in range(batch.num_rows):
                r = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                key = r["cell"], r["is_row"], r["bid"]
                if block is None or key != block["key"]:
                    take()
                    if cell != r["cell"]:
                        if now:
                            yield now.found()
                        cell, now, held = r["cell"], None, []
                    block = {"key": key, "is_row": r["is_row"], "chunks": {}, **{c: r[c] for c in META}}
                block["chunks"][r["chunk"]] = _matrix(r["vectors"], len(r["ids"]) // 8, chunk)
        take()
        if now:
            yield now.found()

    columns = ["cell", "is_row", "bid", "chunk", "vectors", *META]
    both = asking.withColumn("is_row", F.lit(False)).select(*columns).unionByName(blocks.withColumn("is_row", F.lit(True)).select(*columns))
    # Cells are numbered in a row, so every task has as many of them as others.
    dealt = both.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int")).sortWithinPartitions("cell", "is_row", "bid", "chunk")
    return dealt.mapInArrow(find, FOUND)


def _first(found: DataFrame, keys: list[str], most: int, name: str) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "id", "label")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= most)


def _cells(spark: SparkSession, groups: list[tuple[int, int, int, int]], most: int) -> tuple[DataFrame, DataFrame, int]:
    """Of groups (first and last block of anchors, first and last block of rows, lasts excluded) the cells: (bid, cell) of anchors, (bid, cell) of rows, and their number."""
    spans, n = [], 0
    for a_low, a_high, low, high in groups:
        cells = min(high - low, most)
        spans.append((a_low, a_high, low, high, n, cells))
        n += cells
    spans = spark.createDataFrame(spans, "a_low int, a_high int, low int, high int, first int, cells int")
    asked = spans.select(F.explode(F.sequence("a_low", F.col("a_high") - 1)).alias("bid"), "first", "cells").select("bid", F.explode(F.sequence("first", F.col("first") + F.col("cells") - 1)).alias("cell"))
    met = spans.select(F.explode(F.sequence("low", F.col("high") - 1)).alias("bid"), "first", "cells").select("bid", (F.col("first") + F.col("bid") % F.col("cells")).alias("cell"))
    return asked, met, n


def hard_negatives(embeddings: DataFrame, is_anchor: Column | None = None, rows: int = ROWS, anchors: int = ANCHORS, chunk: int = DIMENSIONS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, embedding, label)."""
    spark = embeddings.sparkSession
    is_anchor = F.col("vec_id") % 50 == 0 if is_anchor is None else is_anchor
    known = written(integer_vectors(embeddings), "negatives-vectors")
    groups = Directory(known, rows)
    placed = groups.grouped(known)
    chosen = placed.where(is_anchor)
    held = {r["grp"]: (r["n"], r["width"]) for r in chosen.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).collect()}
    if not held:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    tasks = max(shuffle_partitions(spark), groups.first[-1] // 16)
    salt = F.pmod(F.xxhash64("vec_id", "label"), F.col("blocks")).cast("int")
    blocks = written(_packed(placed.withColumn("bid", F.col("first") + salt), chunk, tasks), "negatives-blocks")

    sizes = {g: -(-n // anchors) for g, (n, _) in sorted(held.items())}
    firsts = dict(zip(sizes, np.cumsum([0, *sizes.values()]).tolist(), strict=False))
    own = spark.createDataFrame([(g, firsts[g], n) for g, n in sizes.items()], "grp int, a_first int, a_blocks int")
    a_salt = F.pmod(F.xxhash64("vec_id", "label", F.lit(1)), F.col("a_blocks")).cast("int")
    chosen = written(chosen.join(F.broadcast(own), "grp").withColumn("bid", F.col("a_first") + a_salt).select("bid", "vec_id", "label", "v"), "negatives-anchors")
    # Blocks of anchors in a group, of the longest vectors as longs.
    together = max(1, group_bytes // (8 * anchors * max(1, *(w for _, w in held.values()))))
    most = min(shuffle_partitions(spark), CELLS)

    def first_rows(asking: DataFrame, spans: list[tuple[int, int, int, int]], positives: int, kept: int) -> DataFrame:
        groups = [(a, min(a + together, a_high), low, high) for a_low, a_high, low, high in spans for a in range(a_low, a_high, together)]
        asked, met, n = _cells(spark, groups, most)
        return _met(asking.join(F.broadcast(asked), "bid"), blocks.join(F.broadcast(met), "bid"), min(n, tasks), anchors, chunk, positives, kept)

    first = groups.first
    asking = written(_packed(chosen, chunk, tasks), "negatives-asking")
    found = first_rows(asking, [(firsts[g], firsts[g] + n, first[g], first[g + 1]) for g, n in sizes.items()], 0, POSITIVES).drop("window")
    positives = written(_first(found, ["anchor_id", "anchor_label"], POSITIVES, "rank"), "negatives-positives")

    scores = F.array(*[F.coalesce(F.max(F.when(F.col("rank") == k + 1, F.col("score"))), F.lit(0)) for k in range(POSITIVES)], *[F.count_if(F.col("rank") == k + 1) for k in range(POSITIVES)])
    windows = positives.groupBy("anchor_id", "anchor_label").agg(_bytes(scores).alias("windows"))
    windowed = chosen.join(windows.withColumnsRenamed({"anchor_id": "vec_id", "anchor_label": "label"}), ["vec_id", "label"])
    # Anchors of all labels share blocks here, so that rows meet few groups.
    mixed = -(-sum(n for n, _ in held.values()) // anchors)
    windowed = windowed.withColumn("bid", F.pmod(F.xxhash64("vec_id", "label", F.lit(2)), F.lit(mixed)).cast("int"))
    again = written(_packed(windowed, chunk, tasks, True), "negatives-again")
    found = first_rows(again, [(0, mixed, 0, first[-1])], POSITIVES, NEGATIVES)
    negatives = _first(found, ["anchor_id", "anchor_label", "window"], NEGATIVES, "rank")
    mates = positives.select("anchor_id", "anchor_label", F.col("rank").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.join(mates, ["anchor_id", "anchor_label", "window"])
    out = written(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives-result")
    dropped(known, blocks, chosen, asking, positives, again)
    return out


def _bytes(longs: Column) -> Column:
    """An array of longs as little-endian bytes."""
    hexed = F.transform(longs, lambda x: F.lpad(F.hex(x), 16, "0"))
    little = F.transform(hexed, lambda h: F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(8)]))
    return F.unhex(F.array_join(little, ""))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    return f"""
with sound as (
  select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
r as (select vec_id, label, min(v) v from sound group by all),
pairs as (
  select a.vec_id anchor_id, a.label anchor_label, b.vec_id id, b.label, coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0)::bigint score
  from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
positives as (select * from pairs where label = anchor_label qualify row_number() over (partition by anchor_id, anchor_label order by score desc, id, label) <= {POSITIVES}),
negatives as (
  select p.anchor_id, p.id positive_id, p.score positive_score, n.id negative_id, n.score negative_score, row_number() over (partition by p.anchor_id, p.anchor_label, p.id order by n.score desc, n.id, n.label) as rank
  from positives p join pairs n on p.anchor_id = n.anchor_id and p.anchor_label = n.anchor_label and n.label <> n.anchor_label and n.score * 100 between {LOW} * p.score and {HIGH} * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from negatives where rank <= {NEGATIVES}"""
