"""Near duplicates by DartMinHash signatures (operator 6).

A text is a weighted set of shingles of five words (white space separates words; a shorter text is one
shingle). Every unit of weight of an element is a region into which hashed darts fall as a Poisson
process along the rank axis; a dart also has a place across its region and counts only if the
element's weight reaches it. A signature keeps, per coordinate, the earliest dart. Two sets agree in a
coordinate with the probability of their weighted Jaccard similarity. Darts are thrown up to a rank
that about fills the coordinates; where one stays empty the rank is doubled.

An element weighs as often as it occurs, in signatures and in the similarities that decide.

Texts that are equal are first reduced to one. Bands of the signature are joined. Texts that share a
band are a group; it is cut into blocks of bounded size and bytes, each of which also has the group's
first text. Exact similarities are found inside a block, which sends a spanning forest of its links, not
its pairs, and the links of all blocks are connected. That joins a group of near copies at the cost of its
members alone. Where a group of several blocks is then still of more than one class, its texts outside its
largest class are compared with its texts of other classes, in pairs of blocks, so that no link is lost. But first
those are left out that cannot link with another class: shingles are ordered from rare to common, and two similar texts
share one among the first of both, up to the weight that similarity may leave out (``leading``). So pages that share
a template and differ in a ninth of their shingles or more meet no more, however many they are. Only texts that met are
read again and shuffled.

Defined results: null texts and texts without a word link with nothing and stay (class_id = doc_id);
rows with equal doc_id count as one document that has all of their texts; rows without a doc_id link
with nothing and give one row; an empty table gives no row; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, dropped, join_hot, shuffle_partitions, small, summed_arrays, table, whole_runs, written

WORDS = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 5
BLOCK = 256
BLOCK_BYTES = 16 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the runs of so many words, in order, repeats included."""
    found = (text or "").split()
    if not found:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w) for w in found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = mix(out + h[k : k + n] + _STEP)
    return out


def signature(elements: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """The earliest dart of each of ``size`` coordinates of a non-empty weighted set of 64-bit elements."""
    reach = (size * np.log(size) + 2 * size) / weights.sum()
    units = np.ceil(weights).astype(np.int64)
    unit = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
    region = mix(np.repeat(elements, units) + (unit.astype(np.uint64) + np.uint64(1)) * _M2)
    room = np.repeat(weights, units) - unit  # 1 or more: the whole unit
    while True:
        seed, space, rank = region, room, np.zeros(len(region))
        ranks, darts = [], []
        while len(seed):
            seed = mix(seed + _STEP)
            rank = rank - np.log(((seed >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
            near = rank <= reach
            seed, space, rank = seed[near], space[near], rank[near]
            dart = mix(seed ^ _M1)
            inside = (space >= 1) | ((mix(dart ^ _M2) >> np.uint64(11)).astype(float) * 2.0**-53 < space)
            ranks.append(rank[inside])
            darts.append(dart[inside])
        rank, dart = np.concatenate(ranks), np.concatenate(darts)
        order = np.argsort(-rank, kind="stable")
        dart = dart[order]
        out = np.zeros(size, np.uint64)
        filled = np.zeros(size, bool)
        place = (dart % np.uint64(size)).astype(np.int64)
        out[place] = dart  # the earliest comes last
        filled[place] = True
        if filled.all():
            return out
        reach *= 2


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.zeros(bands, np.uint64)
    for k in range(rows):
        h = mix(h + sig[k::rows][:bands] + _STEP)
    return h.view(np.int64)


def weighted_set(text: str | None, weighted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles in ascending order and their weights: how often each occurs, or 1."""
    elements, times = np.unique(shingles(text), return_counts=True)
    return elements, times.astype(float) if weighted else np.ones(len(elements))


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, weighted: bool = True) -> DataFrame:
    """(doc_id, text_key, size, bands) of every row, size in bytes; empty texts have no bands."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                out: list = []
                for text in some.column(1).to_pylist():
                    elements, weights = weighted_set(text, weighted)
                    out.append(bands_of(signature(elements, weights, bands * rows), bands, rows) if len(elements) else None)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), some.column(3), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "text_key", "size", "bands"])

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5("text")).alias("text_key"), F.octet_length("text").cast("long").alias("size"))
    return rows_in.mapInArrow(signed, "doc_id long, text_key binary, size long, bands array<long>")


class Sets:
    """Weighted sets, of which one is compared with many others at a time."""

    def __init__(self, texts: list[str], weighted: bool):
        found = [weighted_set(t, weighted) for t in texts]
        self.elements = [x for x, _ in found]
        self.weights = [w for _, w in found]
        self.totals = np.array([w.sum() for w in self.weights])

    def near(self, at: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """Those of the others whose weighted Jaccard similarity to one reaches the threshold."""
        total = self.totals[at]
        # Sets of too different a size cannot be similar.
        some = others[(self.totals[others] >= similarity * total - 1e-9) & (self.totals[others] * similarity <= total + 1e-9)]
        if not len(some):
            return some
        flat = np.concatenate([self.elements[k] for k in some])
        own = self.elements[at]
        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.where(own[place] == flat, np.minimum(self.weights[at][place], np.concatenate([self.weights[k] for k in some])), 0.0)
        lengths = np.array([len(self.elements[k]) for k in some])
        shared = np.add.reduceat(both, np.cumsum(lengths) - lengths)
        return some[shared >= similarity * (self.totals[some] + total - shared) - 1e-9]


def forest(owner: np.ndarray, sets: Sets, similarity: float) -> list[tuple[int, int]]:
    """Links that connect the sets as all pairs of at least the similarity would.

    Walks each component from its least member, comparing the one at hand with all sets not yet reached.
    """
    links: list[tuple[int, int]] = []
    left = np.arange(len(owner))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = sets.near(at, left, similarity)
            if len(hit):
                links += [(int(owner[at]), int(owner[k])) for k in hit]
                queue += hit.tolist()
                left = left[~np.isin(left, hit)]
    return links


def across(owner: np.ndarray, sets: Sets, similarity: float, side: np.ndarray, classes: np.ndarray) -> list[tuple[int, int]]:
    """Links between the sets of one side and those of the other, of different classes: to each class one."""
    links: list[tuple[int, int]] = []
    a, b = np.flatnonzero(~side), np.flatnonzero(side)
    for k in a:
        hit = sets.near(k, b[classes[b] != classes[k]], similarity)
        _, first = np.unique(classes[hit], return_index=True)
        links += [(int(owner[k]), int(owner[j])) for j in hit[first]]
    return links


def _links_of_units(texts: DataFrame, met: DataFrame, similarity: float, weighted: bool) -> DataFrame:
    """Links (a, b) inside the units of ``met`` (id, unit, and for pairs of blocks side and class)."""
    spark = texts.sparkSession
    paired = "side" in met.columns
    kept = ["unit", "id", *(["side", "class"] if paired else []), "text"]

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_runs(batches, ["unit"]):
            units, ids = run.column("unit").to_numpy(), run.column("id").to_numpy()
            cuts = np.flatnonzero(np.diff(units)) + 1
            found: list[tuple[int, int]] = []
            for a, b in zip([0, *cuts], [*cuts, len(units)], strict=True):
                if b - a < 2:
                    continue
                sets = Sets(run.column("text").slice(a, b - a).to_pylist(), weighted)
                if paired:
                    side, classes = (run.column(c).slice(a, b - a).to_numpy() for c in ("side", "class"))
                    found += across(ids[a:b], sets, similarity, side.astype(bool), classes)
                else:
                    found += forest(ids[a:b], sets, similarity)
            if found:
                x = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    # Only texts that met anything leave their place, once for each unit.
    some = texts.join(small(met.select("id").distinct()), "id", "left_semi").join(small(met), "id")
    dealt = some.repartition(shuffle_partitions(spark), "unit").sortWithinPartitions("unit", "id").select(*kept)
    return dealt.mapInArrow(linked, "a long, b long")


# Buckets of shingles by which common ones are told, at least, at most, and one for so many shingles; a collision costs time and loses nothing.
LEAST_COUNTED, MOST_COUNTED, SHINGLES_A_BUCKET = 1 << 12, 1 << 22, 16


def leading(elements: np.ndarray, weights: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The shingles that come first, from rare to common, of which a text that is as similar and no longer has one, and how many of these a text that is no shorter has one of.

    Of a longer text at least ``similarity`` of the weight is shared, and of a shorter one twice that by 1 + ``similarity``. What
    comes behind the first shingles of either weighs less, so the two share one of the first of both: the earliest
    that they share is among them in the one whose first ones end earlier, and so in the other as well.
    """
    order = np.lexsort((elements, counts[(elements % np.uint64(len(counts))).astype(np.int64)]))
    behind = weights.sum() - np.cumsum(weights[order])
    longer, shorter = (int(np.searchsorted(-behind, -(share * weights.sum() - 1e-6), side="right")) + 1 for share in (similarity, 2 * similarity / (1 + similarity)))
    return elements[order][:longer], shorter


def _may_link(texts: DataFrame, ids: DataFrame, similarity: float, weighted: bool) -> DataFrame:
    """The ids of ``ids`` (id, class) whose texts can be similar to one of another class."""
    spark = texts.sparkSession

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                found = [weighted_set(t, weighted) for t in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *(pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1))], names=["id", "class", "elements", "weights"])

    held = texts.join(small(ids), "id").select("id", "class", "text").mapInArrow(sets, "id long, class long, elements binary, weights binary")
    held = written(held, "near-sets")

    n = (held.agg(F.sum(F.octet_length("elements").cast("long"))).first()[0] or 0) // 8
    buckets = min(MOST_COUNTED, max(LEAST_COUNTED, 1 << (n // SHINGLES_A_BUCKET).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = np.concatenate([np.frombuffer(e.as_buffer(), np.uint64) for e in batch.column(0).slice(at, 500)])
                total += np.bincount((some % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.astype("<f4").tobytes()], pa.binary())], names=["chunk", "values"])

    counts = summed_arrays(held.select("elements").mapInArrow(count, "chunk int, values binary")).get(0, np.zeros(buckets))
    sent = spark.sparkContext.broadcast(counts.astype(np.float32))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, classes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in range(0, batch.num_rows, 500):
                some = range(at, min(at + 500, batch.num_rows))
                sets = [(np.frombuffer(batch.column(2)[k].as_buffer(), np.uint64), np.frombuffer(batch.column(3)[k].as_buffer(), np.float64)) for k in some]
                found = [leading(e, w, sent.value, similarity) if len(e) else (e, 0) for e, w in sets]
                sizes = [len(e) for e, _ in found]
                lead = np.concatenate([np.arange(len(e)) < n for e, n in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([e for e, _ in found]).view(np.int64)), pa.array(np.repeat(ids[some.start : some.stop], sizes)), pa.array(np.repeat(classes[some.start : some.stop], sizes)), pa.array(lead)], names=["element", "id", "class", "lead"])

    rows = written(held.mapInArrow(first, "element long, id long, class long, lead boolean"), "near-leading")
    own = F.when(F.col("lead"), F.col("class"))
    by = rows.groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("low"), F.max("class").alias("high"), F.min(own).alias("lead_low"), F.max(own).alias("lead_high"))
    # Where two classes meet at a shingle, one of them has it among those of a shorter text.
    by = written(by.where("low <> high and lead_low is not null"), "near-meeting")
    differ = (F.col("lead_low") != F.col("class")) | (F.col("lead_high") != F.col("class")) | F.col("lead")
    out = written(join_hot(rows, by, ["element"], "n").where(differ).select("id").distinct(), "near-able")
    sent.unpersist()
    dropped(held, rows, by)
    return out


def near_duplicate_links(texts: DataFrame, members: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, weighted: bool = True) -> DataFrame:
    """Links (a, b) between the ids of ``members`` (id, size, band, hash), whose texts ``texts`` (id, text) holds."""
    group = ["band", "hash"]
    groups = members.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("id").alias("least"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who")).where("n > 1")
    # Texts that meet in several bands as the same group meet once.
    blocks = F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")
    once = groups.groupBy("n", "who").agg(F.min(F.struct(*group, "bytes", "least")).alias("g"))
    once = written(once.select("g.band", "g.hash", "g.least", "n", F.col("g.bytes").alias("bytes")).select(*group, "least", "n", blocks), "near-groups")
    joined = written(join_hot(members, once, group, "n").select("id", *group, "least", "blocks"), "near-members")
    mine = F.pmod(F.xxhash64("id", "hash"), F.col("blocks")).cast("int")
    places = F.when(F.col("id") == F.col("least"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(mine))
    met = written(joined.withColumn("place", F.explode(places)).select("id", F.xxhash64(*group, "place").alias("unit")), "near-met")
    links = written(_links_of_units(texts, met, similarity, weighted).distinct(), "near-links")
    dropped(met, once)

    # What several blocks leave open: members outside the largest class of their group.
    wide = joined.where("blocks > 1").select("id", *group)
    if wide.isEmpty():
        return links
    classes = connected_components(links, "near-classes")
    wide = written(wide.join(classes, "id", "left").select("id", *group, F.coalesce("component_id", "id").alias("class")), "near-wide")

    def ways_of(some: DataFrame) -> DataFrame:
        """Groups of several classes, with the largest class and the blocks of all their texts and of those outside it."""
        held = some.groupBy(*group, "class").agg(F.count(F.lit(1)).alias("n"))
        held = held.groupBy(*group).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"), F.max(F.struct("n", "class")).alias("most"))
        return written(held.where("classes > 1").select(*group, "n", F.ceil(F.col("n") / block).cast("int").alias("all"), F.ceil((F.col("n") - F.col("most.n")) / block).cast("int").alias("apart"), F.col("most.class").alias("main")), "near-ways")

    ways = ways_of(wide)
    if ways.isEmpty():
        return links
    able = _may_link(texts, written(join_hot(wide, ways, group, "n").select("id", "class").distinct(), "near-ids"), similarity, weighted)
    left_open = written(wide.join(small(able), "id", "left_semi"), "near-open")
    dropped(ways)
    ways = ways_of(left_open)
    if ways.isEmpty():
        return links
    left_open = join_hot(left_open, ways, group, "n")
    among = F.pmod(F.xxhash64("id", "hash"), F.col("all")).cast("int")
    aside = F.pmod(F.xxhash64("hash", "id"), F.col("apart")).cast("int")
    unit = F.xxhash64(*group, "i", "j").alias("unit")
    one = left_open.where("class <> main").withColumn("i", aside).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("all") - 1)))
    other = left_open.withColumn("j", among).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("apart") - 1)))
    pairs = one.select("id", unit, F.lit(0).alias("side"), "class").unionByName(other.select("id", unit, F.lit(1).alias("side"), "class"))
    return links.unionByName(written(_links_of_units(texts, written(pairs, "near-pairs"), similarity, weighted).distinct(), "near-links"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK, weighted: bool = True) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and kept (doc_id = class_id) of every document."""
    signed = written(signatures(docs, bands, rows, weighted), "near-signed")
    texts = signed.where("bands is not null and doc_id is not null").groupBy("text_key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    texts = written(texts, "near-texts")
    members = texts.select("id", "size", F.posexplode("bands").alias("band", "hash"))
    body = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    links = near_duplicate_links(body, members, similarity, block, weighted)
    with_text = F.col("bands").isNotNull() & F.col("doc_id").isNotNull()
    several = signed.where(with_text).groupBy("doc_id").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).where("low <> high").select("doc_id")
    several = written(several, "near-several")
    if not several.isEmpty():  # a document's own texts are linked
        own = signed.where(with_text).join(small(several), "doc_id").join(texts.select("text_key", "id"), "text_key")
        links = links.unionByName(own.select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    classes = connected_components(links, "near-classes")
    of_text = texts.join(classes, "id", "left").select("text_key", "copies", F.coalesce("component_id", "id").alias("class_id"))
    linked = join_hot(signed.where(with_text).select("doc_id", "text_key"), written(of_text, "near-of-text"), ["text_key"], "copies")
    alone = signed.where(~with_text).select("doc_id", F.col("doc_id").alias("class_id"))
    out = linked.select("doc_id", "class_id").unionByName(alone).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def without_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` but for those of all documents of a class except the first; rows repeated with their id and text stay once."""
    classes = written(near_duplicates(docs, similarity), "near-result")
    gone = classes.where("not kept").select("doc_id")
    left = docs.join(small(gone), "doc_id", "left_anti")
    again = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "near-again")
    if not again.isEmpty():
        again = small(again)
        left = left.join(again, "doc_id", "left_anti").unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return left.select(*docs.columns)


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
