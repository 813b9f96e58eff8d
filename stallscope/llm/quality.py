"""Text quality by pooled random-indexing word vectors and a small network (operator 5).

A word is a run of letters, of digits or of other signs; its letters' case counts. Words hash to
``BUCKETS`` rows. Every row has a fixed sparse random index vector; its word vector is the sum of the index
vectors of the words around it (``REACH`` on either side), over the texts of the whole corpus. Word
vectors are damped and normalised. A document is the mean and the spread of the vectors of its words, the mean cosines of words
one and two apart, its share of distinct words and the logarithm of its length.

A network of two layers, in numpy, learns ``labels.quality`` from these; it is fitted to at most
``FIT_ROWS`` labelled documents (those least by a hash of the id, about 400 bytes each), a fifth of them
kept aside to choose when to stop and the temperature that calibrates the probabilities.

Defined results: null texts, and texts without a word, are scored by the network as the zero vector;
documents with contradicting labels, null labels or none teach nothing; without labels of both kinds the
score is the labels' mean (1.0 without any); equal doc_ids are scored each on its own; an empty table
gives no row; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, id_remainder, summed_arrays, table, written

BUCKETS = 1 << 14
WIDTH = 40
SPARSE = 4
REACH = 2
FIT_ROWS = 20_000
HIDDEN = 24
ACCEPTED = 0.7
CHUNK = 128  # rows of the word table that are summed up together
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_FLUSH = 500_000


class Hasher:
    """Rows of words, with a bounded memory of words seen."""

    def __init__(self, limit: int = 200_000):
        self.known: dict[str, int] = {}
        self.limit = limit

    def rows(self, text: str | None) -> np.ndarray:
        words = _WORD.findall(text) if text else []
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        except KeyError:
            import zlib

            if len(known) > self.limit:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
            return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[str | None]:
    """Few at a time, which bounds what a worker holds beside the batch."""
    for at in range(0, batch.num_rows, 256):
        yield from batch.column(column).slice(at, 256).to_pylist()


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's nonzero components."""
    rng = np.random.default_rng(seed)
    return np.argsort(rng.random((BUCKETS, WIDTH)), axis=1)[:, :SPARSE].astype(np.int64), rng.choice([-1.0, 1.0], (BUCKETS, SPARSE))


def add_contexts(total: np.ndarray, rows: list[np.ndarray], places: np.ndarray, signs: np.ndarray) -> None:
    """Adds to ``total`` (flat: row, component) the index vectors of what surrounds each word of the texts."""
    gap = np.full(REACH, -1, np.int32)
    flat = np.concatenate([x for r in rows for x in (r, gap)])
    for away in range(1, REACH + 1):
        left, right = flat[:-away], flat[away:]
        both = (left >= 0) & (right >= 0)
        # A pair occurs often; count it once for all its times.
        pairs, times = np.unique(left[both].astype(np.int64) * BUCKETS + right[both], return_counts=True)
        a, b = pairs // BUCKETS, pairs % BUCKETS
        for word, near in ((a, b), (b, a)):
            for k in range(SPARSE):
                total += np.bincount(word * WIDTH + places[near, k], signs[near, k] * times, minlength=len(total))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors of the corpus (row x component), from all its texts."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (places, signs) = Hasher(), index_vectors()
        total = np.zeros(BUCKETS * WIDTH)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text in _texts(batch, 0):
                held.append(hasher.rows(text))
                size += len(held[-1])
                if size >= _FLUSH:
                    add_contexts(total, held, places, signs)
                    held, size = [], 0
        if size:
            add_contexts(total, held, places, signs)
        table = total.astype("<f4").reshape(-1, CHUNK * WIDTH)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(table)), pa.int32()), pa.array([x.tobytes() for x in table], pa.binary())], names=["chunk", "values"])

    sums = summed_arrays(docs.where("text is not null").select("text").mapInArrow(contexts, "chunk int, values binary"))
    out = np.zeros((BUCKETS // CHUNK, CHUNK * WIDTH))
    for k, v in sums.items():
        out[k] = v
    out = out.reshape(BUCKETS, WIDTH)
    out = np.sign(out) * np.log1p(np.abs(out))
    return (out / np.maximum(np.sqrt((out * out).sum(axis=1)), 1e-9)[:, None]).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, pooled): of each text what its words' vectors pool to, as bytes of float32."""
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, v = Hasher(), sent.value
        for batch in batches:
            out = [pool_text(hasher, v, text).tobytes() for text in _texts(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "pooled"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pool, "doc_id long, pooled binary")


def _order(rows: np.ndarray, v: np.ndarray, span: int = 65_536) -> list[float]:
    """The mean cosines of words one and two apart, in spans that bound the memory."""
    out = []
    for away in (1, 2):
        total = 0.0
        for at in range(0, len(rows) - away, span):
            a = rows[at : min(at + span, len(rows) - away)]
            total += float(np.einsum("ij,ij->", v[a], v[rows[at + away : at + away + len(a)]]))
        out.append(total / max(1, len(rows) - away))
    return out


def pool_text(hasher: Hasher, v: np.ndarray, text: str | None) -> np.ndarray:
    """What the vectors of a text's words pool to."""
    rows = hasher.rows(text)
    if not len(rows):
        return np.zeros(2 * WIDTH + 4, "<f4")
    of, times = np.unique(rows, return_counts=True)
    share = (times / len(rows)).astype(np.float32)
    x = v[of]
    mean = share @ x
    spread = np.sqrt(np.maximum(share @ (x * x) - mean * mean, 0))
    return np.concatenate([mean, spread, _order(rows, v), [len(of) / len(rows), np.log1p(len(rows))]]).astype("<f4")


class Network:
    """Two layers: tanh, then a logistic unit whose logit is divided by the temperature."""

    def __init__(self, constant: float | None = None):
        self.constant = constant

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.middle) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 0.01, seed: int = 3) -> Network:
    """A network fitted by Adam; rows are in an order that does not depend on where they came from."""
    if not len(y) or y.min() == y.max():
        return Network(float(y.mean()) if len(y) else 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    aside = order[: max(1, len(y) // 5)] if len(y) >= 10 else order
    used = order[len(y) // 5 :] if len(y) >= 10 else order
    net = Network()
    net.middle, net.scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-4
    net.temperature = 1.0
    p = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    z = (x - net.middle) / net.scale
    best, kept, step = np.inf, None, 0
    for _ in range(epochs):
        mixed = rng.permutation(used)
        for at in range(0, len(mixed), batch):
            k = mixed[at : at + batch]
            h = np.tanh(z[k] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - y[k]) / len(k)
            dh = np.outer(d, p[2]) * (1 - h * h)
            g = [z[k].T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            step += 1
            for i in range(4):
                m[i] = 0.9 * m[i] + 0.1 * g[i]
                v[i] = 0.999 * v[i] + 0.001 * g[i] ** 2
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], p[3]
        now = _loss(net.logits(x[aside]), y[aside])
        if now < best:
            best, kept = now, [a.copy() for a in p]
    net.w1, net.b1, net.w2, net.b2 = kept
    logits = net.logits(x[aside])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    net.temperature = float(min(grid, key=lambda t: _loss(logits / t, y[aside])))
    return net


def sure_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of documents whose labels do not contradict each other."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")


def train(vectors: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Network:
    """A network from the labelled documents of ``vectors`` (doc_id, pooled), at most ``fit_rows`` of them."""
    rows = vectors.join(sure_labels(labels), "doc_id").orderBy(F.xxhash64("doc_id"), "pooled").limit(fit_rows).select("pooled", "quality").toArrow()
    if not rows.num_rows:
        return Network(1.0)
    x = np.frombuffer(b"".join(rows.column(0).to_pylist()), "<f4").reshape(rows.num_rows, -1).astype(float)
    return fit(x, np.array([q > 0 for q in rows.column(1).to_pylist()], float))


def scored(vectors: DataFrame, network: Network) -> DataFrame:
    """Replaces ``pooled`` by score and predicted."""
    sent = vectors.sparkSession.sparkContext.broadcast(network)
    rest = [c for c in vectors.columns if c != "pooled"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist()), "<f4").reshape(batch.num_rows, -1).astype(float)
            s = sent.value.scores(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= ACCEPTED).astype(np.int32))], names=[*rest, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema if f.name != "pooled")
    return vectors.select(*rest, "pooled").mapInArrow(score, f"{kinds}, score double, predicted int")


def _held_out() -> Column:
    return F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    vectors = written(pooled(docs, word_vectors(docs)).withColumn("held_out", _held_out()), "quality-pooled")
    return scored(vectors, train(vectors.where("not held_out").select("doc_id", "pooled"), labels))


def accepted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` whose text is predicted to be good, by the network of ``quality``.

    Texts are scored where they are, without a join; before that only those that the network is fitted to are pooled.
    """
    words = word_vectors(docs)
    fitted = docs.select("doc_id").where(~_held_out()).join(sure_labels(labels).select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id")).limit(fit_rows)
    fitted = written(fitted.distinct(), "quality-fitted")
    network = train(pooled(docs.join(F.broadcast(fitted), "doc_id", "left_semi"), words), labels, fit_rows)  # at most fit_rows ids
    dropped(fitted)
    sent = docs.sparkSession.sparkContext.broadcast((words, network))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (v, net) = Hasher(), sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array([pool_text(hasher, v, t) for t in _texts(batch, at)], float)
            yield batch.filter(pa.array(net.scores(x) >= ACCEPTED))

    return docs.mapInArrow(keep, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
