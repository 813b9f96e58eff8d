"""Near-duplicate vectors by Euclidean p-stable hashing (operator 4).

A vector is normalised and projected on Gaussian directions; each projection is shifted and cut into
cells of ``WIDTH``. A table joins ``K`` cells to one bucket, and vectors that share a bucket in any table
are compared by their exact cosine. K grows with the logarithm of the number of vectors, so that a
bucket holds about ``CHANCE`` unrelated vectors at any size, and the number of tables then follows from
the recall wanted for pairs exactly at the threshold (closer pairs are found more surely).

Equal vectors are first reduced to one that counts as often as it occurs. Buckets are compared in blocks
of bounded size, a bucket of several blocks in pairs of blocks. What is shuffled there is a sketch of a
vector, the signs of ``SKETCH`` random projections: two vectors go on only if no more signs differ than those of a
pair at the threshold ever do (in one of some 10,000 such pairs more do). Those left in a block that hang together are a
cluster, and clusters of equal members that several tables give are compared once. Only then do vectors leave their
place, once for each cluster, for their exact cosines. Pairs whose own sketches differ by more are no links there either,
so that a third vector changes no count, and a pair counts in the first table that it shares, so each link counts once. A cluster sends one count per vector and a spanning forest of its links, never its pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with
nothing (n_links 0, component_id = vec_id), and so do rows without a vec_id; vectors of different
lengths never link; rows that repeat a vec_id and its vector count once; a vec_id with several different vectors
has the links of all, each of which counts as a vector of its own; every input row gives one row;
an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, dropped, join_hot, shuffle_partitions, small, table, whole_runs, written
from .dart_minhash import mix

COSINE = 0.9
RECALL = 0.97  # of pairs exactly at the threshold
WIDTH = 2.0
CHANCE = 64
BLOCK = 2048
SKETCH = 128


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one projection puts two points so far apart in the same cell."""
    c = width / distance
    tail = 0.5 * math.erfc(c / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def parameters(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(cells per table, tables) for n vectors: unrelated ones are a right angle apart."""
    far, near = collision(math.sqrt(2)), collision(math.sqrt(max(2 - 2 * cosine, 1e-9)))
    cells = max(2, round(math.log(max(n, 2) / CHANCE) / -math.log(far)))
    return cells, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**cells)))


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Of vectors of one length: their directions, and which of them have one."""
    x = np.array(vectors, dtype=np.float64)
    size = np.abs(x).max(axis=1)
    good = np.isfinite(x).all(axis=1) & (size > 0)
    x = np.where(good[:, None], x, 1.0) / np.where(good, size, 1.0)[:, None]  # scaled first: squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1))[:, None], good


def buckets(x: np.ndarray, cells: int, tables: int, seed: int = 7) -> np.ndarray:
    """A 64-bit bucket of each row in each table; rows of different lengths, and tables, share none."""
    dim = x.shape[1]
    rng = np.random.default_rng([seed, dim])
    cell = np.floor((x @ rng.standard_normal((dim, cells * tables)) + rng.random(cells * tables) * WIDTH) / WIDTH).astype(np.int64)
    cell = cell.view(np.uint64).reshape(len(x), tables, cells)
    h = np.tile(mix(np.arange(tables, dtype=np.uint64) + np.uint64(dim << 20)), (len(x), 1))
    for k in range(cells):
        h = mix(h + cell[:, :, k] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    return h.view(np.int64)


def sketch(x: np.ndarray, seed: int = 13) -> np.ndarray:
    """The signs of random projections, as bytes."""
    dim = x.shape[1]
    return np.packbits(x @ np.random.default_rng([seed, dim]).standard_normal((dim, SKETCH)) > 0, axis=1)


def most_differing(cosine: float) -> int:
    """Signs in which a pair at the threshold differs at most, but for a chance of some 1 in 10,000."""
    p = math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    return math.ceil(SKETCH * p + 3.9 * math.sqrt(SKETCH * p * (1 - p)))


def _hashed(vectors: DataFrame, cells: int, tables: int) -> DataFrame:
    """(vec_id, k1, k2, sketch, buckets) of rows that can link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            by_dim: dict[int, list[int]] = {}
            for k, v in enumerate(found):
                if ids[k] is not None and v and None not in v:
                    by_dim.setdefault(len(v), []).append(k)
            for of in by_dim.values():
                x, good = unit([found[k] for k in of])
                if not good.any():
                    continue
                x, at = x[good], pa.array(np.array(of)[good])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(at) for k in range(3)), pa.array([r.tobytes() for r in sketch(x)], pa.binary()), pa.array([r.tobytes() for r in buckets(x, cells, tables)], pa.binary())],
                    names=["vec_id", "k1", "k2", "sketch", "buckets"],
                )

    return _keyed(vectors).mapInArrow(rows, "vec_id long, k1 long, k2 int, sketch binary, buckets binary")


def _keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, k1, k2, embedding): equal vectors have equal keys."""
    e = F.col("embedding").cast("array<double>")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64(e).alias("k1"), F.hash(e).alias("k2"), e.alias("embedding"))


def _clusters(signs: np.ndarray, side: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows of a unit that hang together by signs; in a pair of blocks only pairs across count, and what they leave is one cluster."""
    s = np.where(np.unpackbits(signs, axis=1), np.float32(1), np.float32(-1))
    least = SKETCH - 2 * most
    if side[0]:
        near = s[side == 1] @ s[side == 2].T >= least
        left = np.zeros(len(s), bool)
        left[np.flatnonzero(side == 1)[near.any(axis=1)]] = True
        left[np.flatnonzero(side == 2)[near.any(axis=0)]] = True
        if left.any():
            yield np.flatnonzero(left)
        return
    near = s @ s.T >= least
    np.fill_diagonal(near, False)
    left = np.flatnonzero(near.any(axis=1))
    near = near[np.ix_(left, left)]
    free = np.ones(len(left), bool)
    for start in range(len(left)):
        if not free[start]:
            continue
        mine = np.zeros(len(left), bool)
        mine[start] = True
        while True:
            more = mine | near[mine].any(axis=0)
            if (more == mine).all():
                break
            mine = more
        free &= ~mine
        yield left[mine]


def _compare(x: np.ndarray, h: np.ndarray, signs: np.ndarray, most: int, band: int, side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric matrices: links, and those of them that this table and no earlier one has joined.

    A pair's sketches decide alike in all tables, so one that is a link here was also left by the first table it shares.
    """
    s = np.where(np.unpackbits(signs, axis=1), np.float32(1), np.float32(-1))
    link = (x @ x.T >= cosine) & (s @ s.T >= SKETCH - 2 * most)
    if side[0]:
        link &= side[:, None] != side[None, :]
    np.fill_diagonal(link, False)
    new = link.copy()
    if link.any():
        new &= h[:, band][:, None] == h[:, band][None, :]
        for t in range(band):
            new &= h[:, t][:, None] != h[:, t][None, :]
    return link, new


def _forest(link: np.ndarray) -> list[tuple[int, int]]:
    left = link.any(axis=1)
    out: list[tuple[int, int]] = []
    for start in np.flatnonzero(left):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            hit = np.flatnonzero(link[at] & left)
            left[hit] = False
            out += [(at, k) for k in hit]
            queue += hit.tolist()
    return out


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    spark = vectors.sparkSession
    cells, tables = parameters(vectors.count(), cosine, recall)
    most = most_differing(cosine)
    hashed = written(_hashed(vectors, cells, tables), "vectors-hashed")
    key = ["k1", "k2"]
    rows = hashed.groupBy("vec_id", *key).agg(F.first("sketch").alias("sketch"), F.first("buckets").alias("buckets"))
    distinct = rows.groupBy(*key).agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"), F.first("buckets").alias("buckets"))
    distinct = written(distinct, "vectors-distinct")

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            h = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8").reshape(n, tables)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), tables)), pa.array(np.tile(np.arange(tables, dtype=np.int16), n)), pa.array(h.reshape(-1)), batch.column(2).take(pa.array(np.repeat(np.arange(n), tables)))], names=["node", "band", "bucket", "sketch"])

    members = distinct.select("k1", "buckets", "sketch").mapInArrow(exploded, "node long, band short, bucket long, sketch binary")
    wide = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    wide = written(wide.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "vectors-wide")
    met = members.join(small(wide), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit_key = F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")))
    # side: 0 in a single block, else 1 or 2, in which of the two blocks of a unit a row is.
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).cast("short")
    met = met.select(unit_key.alias("unit"), "node", "band", side.alias("side"), "sketch")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_runs(batches, ["unit"]):
            units, nodes, bands, sides = (run.column(c).to_numpy() for c in ("unit", "node", "band", "side"))
            signs = np.frombuffer(b"".join(run.column("sketch").to_pylist()), np.uint8).reshape(len(nodes), SKETCH // 8)
            cuts = np.flatnonzero(np.diff(units)) + 1
            out: list[tuple] = []
            for a, b in zip([0, *cuts], [*cuts, len(units)], strict=True):
                for k in _clusters(signs[a:b], sides[a:b], most) if b - a > 1 else ():
                    k = k + a
                    name = np.bitwise_xor.reduce(mix(nodes[k].view(np.uint64) * np.uint64(4) + sides[k].astype(np.uint64)))
                    out.append((int(name.view(np.int64)), int(bands[a]), nodes[k].tolist(), sides[k].tolist()))
            if out:
                kinds = (pa.int64(), pa.int16(), pa.list_(pa.int64()), pa.list_(pa.int16()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["cluster", "band", "nodes", "sides"])

    dealt = met.repartition(shuffle_partitions(spark), "unit").sortWithinPartitions("unit", "node")
    found = written(dealt.mapInArrow(sketched, "cluster long, band short, nodes array<long>, sides array<short>"), "vectors-clusters")
    # Equal clusters of several tables: the first table's stands for all. (A name of 64 bits parts different ones of equal size and least member.)
    same = ["cluster", F.size("nodes").alias("n"), F.array_min("nodes").alias("least")]
    once = found.select(*same, F.struct("band", "nodes", "sides").alias("c")).groupBy("cluster", "n", "least").agg(F.min("c").alias("c"))
    once = once.select(F.xxhash64("cluster", "n", "least").alias("cluster"), "c.band", F.explode(F.arrays_zip("c.nodes", "c.sides")).alias("m")).select("cluster", "band", F.col("m.nodes").alias("k1"), F.col("m.sides").alias("side"))
    once = written(once.join(distinct.select("id", *key, "copies"), "k1"), "vectors-once")
    needed = once.select(F.col("id").alias("vec_id"), *key).distinct()
    bodies = _keyed(vectors).join(small(needed), ["vec_id", *key], "left_semi")
    if hashed.groupBy("vec_id", *key).count().where("count > 1").limit(1).count():
        bodies = bodies.dropDuplicates(["vec_id", *key])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_runs(batches, ["cluster"]):
            clusters, ids, copies, bands, side = (run.column(c).to_numpy() for c in ("cluster", "id", "copies", "band", "side"))
            k1, k2 = run.column("k1").to_numpy(), run.column("k2").to_numpy()
            vector = run.column("embedding").combine_chunks()
            lengths = np.diff(vector.offsets.to_numpy())
            cuts = np.flatnonzero((np.diff(clusters) != 0) | (np.diff(lengths) != 0)) + 1
            out: list[tuple] = []
            for a, b in zip([0, *cuts], [*cuts, len(clusters)], strict=True):
                if b - a < 2:
                    continue
                flat = vector.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
                x, _ = unit(flat.reshape(b - a, -1))
                link, new = _compare(x, buckets(x, cells, tables), sketch(x), most, int(bands[a]), side[a:b], cosine)
                links = new @ copies[a:b]
                out += [(ids[a + k], k1[a + k], k2[a + k], None, int(links[k])) for k in np.flatnonzero(links)]
                out += [(ids[a + i], None, None, ids[a + j], 0) for i, j in _forest(link)]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["a", "k1", "k2", "b", "n"])

    brought = bodies.withColumnRenamed("vec_id", "id").join(small(once), ["id", *key])
    brought = brought.repartition(shuffle_partitions(spark), "cluster").sortWithinPartitions("cluster", F.size("embedding"), "id")
    found_links = written(brought.select("cluster", "id", *key, "copies", "band", "side", "embedding").mapInArrow(compared, "a long, k1 long, k2 int, b long, n long"), "vectors-found")
    counts = found_links.where("b is null").groupBy(*key).agg(F.sum("n").alias("links"))
    classes = connected_components(found_links.where("b is not null").select("a", "b"), "vectors-classes")
    of_key = distinct.join(counts, key, "left").join(classes, "id", "left").select(*key, "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    of_key = written(of_key, "vectors-of-key")
    linked = join_hot(hashed.select("vec_id", *key).distinct(), of_key, key, "copies").groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    linked = written(linked, "vectors-linked")
    dropped(hashed, distinct, wide, found, once, found_links, of_key)
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(linked, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_pstable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
