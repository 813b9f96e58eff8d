"""Scores of whole documents by a gated recurrent language model (operator 9).

Tokens: words between ASCII white space with A-Z in lower case, and one end after each text. Counts of all
training tokens are gathered over the corpus. The ``HEAD`` most frequent ones (of equal counts those first in the order
of their bytes) reach the tasks as a table; the others, and words of more than ``LONGEST_HEAD_WORD`` bytes, meet their
counts in a join.

The model is a gated recurrent unit with a class-factored softmax: the most frequent tokens, as many as
half the root of the number of training tokens and ``MODELLED`` at least, are cut into classes of about
equal mass, and a token's probability is that of its class times its own within the class, both given the
state. The number of classes is the one that makes the softmax cheapest, about the root of the modelled
tokens, and the state takes four more units each time these have grown fourfold. All other tokens are one more class, inside which the smoothed
base probability holds, so the model gives a proper probability to every token, known or not.

Training is by truncated backpropagation in numpy over all training texts, each seen once, in the rounds of
``ROUNDS``. Texts are dealt by a hash to shards of about ``SHARD_TOKENS`` tokens, so that neither the number of
machines nor the way the table is cut into files matters. In each round every shard goes on from the same model through its
own texts, in windows of ``WINDOW`` tokens through which the state is carried, and the shards' models are averaged
by their tokens. Of a text of more than ``STREAM`` tokens the parts are trained on side by side, each with the token before
it as its first input; when texts are scored, the state runs through the whole text.

Defined results: null texts count as empty and hold the end alone; without training texts the base
probability of every token is 1 by its formula, and so is the model's; every row gives one row, whatever
its doc_id; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import copy
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import select_places
from .common import dropped, id_remainder, summed_arrays, table, written

END = b"\n"  # no word holds white space
SMOOTHING = 0.1
HEAD = 1 << 17
LONGEST_HEAD_WORD = 256
MODELLED, CLASSES, STATE = 768, 20, 12  # at least
TOP_LOGIT = np.float32(60)  # exp stays finite
WINDOW = 32
SCORED = 64  # tokens that are scored together; the state goes on behind them
STREAM = 1024
SHARD_TOKENS = 2_000_000
ROUNDS = ((1,), (2, 3, 4, 5), (6, 7, 8, 9))  # tenths of the documents
RATE = 0.01
CHUNK = 4096


def words_of(text: str | None) -> list[bytes]:
    # Lower case and white space of bytes are those of ASCII.
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


TOGETHER_BYTES = 16 << 20  # of texts that are cut together


def cut_words(texts: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(first text, words, ends) of some texts at a time: the words of ``words_of`` of all in a row, and where those of each text end."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TOGETHER_BYTES, side="right")))
        some = pc.fill_null(texts.slice(at, upto - at).cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(some))
        words = lists.flatten()
        inner = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty string there
        before = np.concatenate([[0], np.cumsum(inner.to_numpy(zero_copy_only=False))])
        yield at, words.filter(inner).cast(pa.large_binary()), before[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()]
        at = upto


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts, the end among them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words, ends in cut_words(batch.column(0)):
                seen = pc.value_counts(words)
                found = pa.concat_arrays([seen.field("values").cast(pa.binary()), pa.array([END], pa.binary())])
                yield pa.RecordBatch.from_arrays([found, pa.concat_arrays([seen.field("counts"), pa.array([len(ends)], pa.int64())])], names=["word", "c"])

    return docs.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The frequent tokens in order of their counts, and the figures of the base probability."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int):
        self.words = words
        self.counts = np.array(counts, dtype=np.float64)
        self.total, self.distinct = total, distinct
        self.norm = total + SMOOTHING * (distinct + 1)
        self.modelled = min(max(MODELLED, math.isqrt(total) // 2), len(words))
        self.state = STATE + 4 * max(0, round(math.log(max(1, self.modelled) / MODELLED, 4)))
        top = self.counts[: self.modelled]
        self.base = np.log10((self.counts + SMOOTHING) / self.norm)
        self.rest = (total - top.sum() + SMOOTHING * (distinct + 1 - self.modelled)) / self.norm
        # Classes: runs of about equal sums of the roots of counts.
        mass = np.cumsum(np.sqrt(top)) if len(top) else top
        # With k such classes a token costs k and, inside its class, mass^2 / (k total) in the mean.
        wanted = max(CLASSES, round(mass[-1] / math.sqrt(total))) if len(top) else CLASSES
        cut = np.minimum(mass / mass[-1] * wanted, wanted - 1).astype(int) if len(top) else np.zeros(0, int)
        self.class_of = np.unique(cut, return_inverse=True)[1] if len(top) else cut
        self.classes = int(self.class_of[-1]) + 1 if len(top) else 0
        self.first = np.searchsorted(self.class_of, np.arange(self.classes + 1))

    def index(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.words)}


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` words of the greatest counts, of equal counts those first in the order of bytes.

    A border is found by counts of rows in narrowing ranges, first of counts, then, inside the count that is cut, of
    ever later bytes of the words; so many words of one count cost no task more than others.
    """
    taken, left = [], most
    for at in (0, *range(1, LONGEST_HEAD_WORD + 1, 7)):
        if counts.limit(left + 1).count() <= left:
            break
        # Numbers in the order wanted, written once where it takes time to make them of words.
        keyed = counts.select(F.lit("all").alias("of"), (_seven_bytes("word", at) if at else -F.col("c")).alias("key"))
        keyed = written(keyed, "lm-keys") if at else keyed
        places = keyed.groupBy("of").agg(F.lit("last").alias("name"), F.lit(left - 1).cast("long").alias("place"), F.min("key").alias("low"), F.max("key").alias("high"))
        border = select_places(keyed, places, "of", "key").first()["key"]
        dropped(keyed)
        if at:
            here, border = F.substring("word", at, 7), F.lit((border >> 3).to_bytes(7, "big")[: border & 7])
            before, counts = counts.where(here < border), counts.where(here == border)
        else:
            before, counts = counts.where(F.col("c") > -border), counts.where(F.col("c") == -border)
        taken.append(before)
        left -= before.count()
    for before in taken:
        counts = counts.unionByName(before)
    return counts


def _seven_bytes(word: str, at: int) -> Column:
    """Bytes from the 1-based place on as a number in whose order words are that agree before the place."""
    some = F.substring(word, at, 7)
    return F.conv(F.hex(F.rpad(some, 7, b"\0")), 16, 10).cast("long") * 8 + F.octet_length(some)


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """From written counts; what reaches the driver is bounded by ``HEAD``."""
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    rows = most_frequent(counts.where(F.length("word") <= LONGEST_HEAD_WORD), HEAD).collect()
    rows.sort(key=lambda r: (-r["c"], bytes(r["word"])))
    return Vocabulary([bytes(r["word"]) for r in rows], [r["c"] for r in rows], total or 0, distinct)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _reach(weights: np.ndarray, bias: np.ndarray, axis: int) -> float:
    """A bound of all logits, as no unit of a state is beyond 1."""
    return float((np.abs(weights).sum(axis=axis) + bias).max(initial=0)) * 1.001


class Model:
    """Parameters by name; inputs are the modelled tokens, then the rest, then the start of a text."""

    def __init__(self, v: Vocabulary, seed: int = 5):
        rng = np.random.default_rng(seed)
        m, c, s = v.modelled, v.classes, v.state
        self.first, self.class_of, self.rest, self.state = v.first, np.append(v.class_of, c).astype(np.uint8 if c < 256 else np.uint16), m, s  # short ones sort fast
        self.start = m + 1

        def normal(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(s)).astype(np.float32)

        top = v.counts[:m]
        inside = np.append(np.bincount(v.class_of, top, minlength=c), max(v.total - top.sum(), 1.0))
        self.p = {
            "embed": normal(m + 2, s),
            "w": normal(s, 3 * s),
            "u": normal(s, 2 * s),
            "un": normal(s, s),
            "b": np.zeros(3 * s, np.float32),
            "cw": normal(s, c + 1) * np.float32(0.1),
            "cb": np.log(inside / inside.sum()).astype(np.float32),
            "vw": normal(m, s) * np.float32(0.1),
            "vb": np.log(np.maximum(top, 1) / np.maximum(inside[v.class_of], 1)).astype(np.float32) if m else np.zeros(0, np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def input_table(self) -> np.ndarray:
        """What each input adds before the gates."""
        return self.p["embed"] @ self.p["w"] + self.p["b"]

    def run(self, inputs: np.ndarray, active: np.ndarray, h: np.ndarray, table: np.ndarray, trail: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States (time x stream) of a window, and the last; at time t the first ``active[t]`` streams go on.

        ``trail`` (5 x time x stream x unit) takes the states before, the gates, the proposals and the gated states.
        """
        p, s = self.p, self.state
        x = table[inputs]
        states = np.zeros((*inputs.shape, s), np.float32)
        u, un = p["u"], p["un"]
        h = h.copy()
        for t, a in enumerate(active):
            before = h[:a]
            zr = before @ u
            zr += x[t, :a, : 2 * s]
            _sigmoid(zr)
            z, r = zr[:, :s], zr[:, s:]
            gated = r * before
            n = gated @ un
            n += x[t, :a, 2 * s :]
            np.tanh(n, out=n)
            if trail is not None:
                for k, kept in enumerate((before, z, r, n, gated)):
                    trail[k, t, :a] = kept
            n -= before
            n *= z
            before += n
            states[t, :a] = before
        return states, h

    def log_probabilities(self, h: np.ndarray, targets: np.ndarray, gradients: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logarithms of each target's class and place in it, given its state; with ``gradients`` also of the states."""
        p = self.p
        of = self.class_of[targets]
        rows = np.arange(len(targets))
        e = h @ p["cw"]  # in place from here on: these are the largest arrays
        e += p["cb"]
        if _reach(p["cw"], p["cb"], 0) > TOP_LOGIT:
            np.minimum(e, TOP_LOGIT, out=e)
        out = e[rows, of]
        np.exp(e, out=e)
        total = e @ np.ones(e.shape[1], e.dtype)
        out -= np.log(total)
        back = None
        if gradients is not None:
            d = e
            d *= (1 / total)[:, None]
            d[rows, of] -= 1
            gradients["cw"] += h.T @ d
            gradients["cb"] += d.sum(axis=0)
            back = d @ p["cw"].T
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(len(self.first)))
        far = _reach(p["vw"], p["vb"], 1) > TOP_LOGIT
        for c in range(len(self.first) - 1):
            k = order[cuts[c] : cuts[c + 1]]
            lo, hi = self.first[c], self.first[c + 1]
            if not len(k) or hi - lo < 2:
                continue
            own = h[k]
            e = own @ p["vw"][lo:hi].T
            e += p["vb"][lo:hi]
            if far:
                np.minimum(e, TOP_LOGIT, out=e)
            place = targets[k] - lo
            rows = np.arange(len(k))
            met = e[rows, place]
            np.exp(e, out=e)
            total = e @ np.ones(hi - lo, e.dtype)
            out[k] += met - np.log(total)
            if gradients is not None:
                d = e
                d *= (1 / total)[:, None]
                d[rows, place] -= 1
                gradients["vw"][lo:hi] += d.T @ own
                gradients["vb"][lo:hi] += d.sum(axis=0)
                back[k] += d @ p["vw"][lo:hi]
        return np.minimum(out, 0), back

    def window_gradients(self, inputs: np.ndarray, targets: np.ndarray, active: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the mean loss over one window, truncated at its start, and the state at its end."""
        p, s = self.p, self.state
        g = {k: np.zeros_like(p[k]) for k in ("cw", "cb", "vw", "vb")}
        trail = np.zeros((5, *inputs.shape, s), np.float32)
        states, h = self.run(inputs, active, h, self.input_table(), trail)
        on = np.arange(inputs.shape[1])[None, :] < active[:, None]
        _, back = self.log_probabilities(states[on], targets[on], g)
        d_states = np.zeros_like(states)
        d_states[on] = back
        before, z, r, n, gated = trail
        # Of each gate and proposal: how it moves with what is before it.
        move_n, move_z, move_r = z * (1 - n * n), (n - before) * z * (1 - z), before * r * (1 - r)
        keep = 1 - z
        dx = np.zeros((*inputs.shape, 3 * s), np.float32)
        dh = np.zeros((inputs.shape[1], s), np.float32)
        un, u = np.ascontiguousarray(p["un"].T), np.ascontiguousarray(p["u"].T)
        for t in range(len(active) - 1, -1, -1):
            a = active[t]
            d = d_states[t, :a]
            d += dh[:a]
            row = dx[t, :a]
            np.multiply(d, move_n[t, :a], out=row[:, 2 * s :])
            dgated = row[:, 2 * s :] @ un
            np.multiply(d, move_z[t, :a], out=row[:, :s])
            np.multiply(dgated, move_r[t, :a], out=row[:, s : 2 * s])
            d *= keep[t, :a]
            dgated *= r[t, :a]
            d += dgated
            d += row[:, : 2 * s] @ u
            dh[:a] = d
        flat = dx[on]
        g["un"] = gated[on].T @ flat[:, 2 * s :]
        g["u"] = before[on].T @ flat[:, : 2 * s]
        # What reaches the table of inputs, summed by input.
        order = np.argsort(inputs[on], kind="stable")
        seen, first = np.unique(inputs[on][order], return_index=True)
        of_input = np.zeros((len(p["embed"]), 3 * s), np.float32)
        if len(seen):
            of_input[seen] = np.add.reduceat(flat[order], first, axis=0)
        g["w"] = p["embed"].T @ of_input
        g["b"] = of_input.sum(axis=0)
        g["embed"] = of_input @ p["w"].T
        share = np.float32(1 / max(1, int(on.sum())))
        for x in g.values():
            x *= share
        return g, h


def batches_of(streams: list[np.ndarray], size: int, window: int) -> Iterator[tuple]:
    """(which, windows) of batches of streams of similar length, longest first; a window is (inputs, targets, active).

    A stream begins with its first input, what it is to follow.
    """
    lengths = np.array([len(x) - 1 for x in streams])
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), size):
        which = order[at : at + size]
        yield which, _windows([streams[k] for k in which], lengths[which], window)


def _windows(streams: list[np.ndarray], n: np.ndarray, window: int) -> Iterator[tuple]:
    flat = np.concatenate(streams)
    offset = np.cumsum(n + 1) - n - 1
    for low in range(0, int(n[0]), window):
        high = min(low + window, int(n[0]))
        wide = int(np.searchsorted(-n, -low, side="left"))  # streams longer than low
        times = np.arange(low, high)
        active = np.searchsorted(-n, -times, side="left")
        place = np.minimum(times[:, None], n[None, :wide] - 1) + offset[None, :wide]
        yield flat[place], flat[place + 1], active


def train_on(model: Model, texts: Iterator[np.ndarray], rate: float = RATE, size: int = 384) -> int:
    """Changes the model by Adam over the texts; returns the number of tokens."""
    m, v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))
    seen = step = 0

    def learn(held: list[np.ndarray]) -> None:
        nonlocal step
        streams = [x[k : k + STREAM + 1] for x in held for k in range(0, len(x) - 1, STREAM)]
        runs = list(batches_of(streams, size, WINDOW))
        for k in np.random.default_rng(len(streams)).permutation(len(runs)):
            which, windows = runs[k]
            h = np.zeros((len(which), model.state), np.float32)
            for inputs, targets, active in windows:
                g, h = model.window_gradients(inputs, targets, active, h[: inputs.shape[1]])
                norm = math.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
                step += 1
                clip = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
                pace, spread = np.float32(rate / (1 - 0.9**step)), np.float32(1 / (1 - 0.99**step))
                for name, x in g.items():  # in place: these are the largest arrays
                    x *= clip
                    mean, square = m[name], v[name]
                    mean *= np.float32(0.9)
                    mean += x * np.float32(0.1)
                    x *= x
                    x *= np.float32(0.01)
                    square *= np.float32(0.99)
                    square += x
                    np.multiply(square, spread, out=x)
                    np.sqrt(x, out=x)
                    x += np.float32(1e-6)
                    np.divide(mean, x, out=x)
                    x *= pace
                    model.p[name] -= x

    held: list[np.ndarray] = []
    waiting = 0
    start = np.array([model.start], np.int32)
    for x in texts:
        held.append(np.concatenate([start, x]))
        waiting += len(x)
        if waiting >= 1_000_000:
            learn(held)
            seen, held, waiting = seen + waiting, [], 0
    if held:
        learn(held)
    return seen + waiting


def _ids(text: str | None, get, modelled: int) -> np.ndarray:
    """What ``_ids_of_all`` gives of one text, word by word."""
    words = words_of(text)
    ids = np.fromiter(map(get, words, repeat(modelled)), np.int32, len(words))
    return np.append(np.minimum(ids, modelled), np.int32(min(get(END, modelled), modelled)))


def _ids_of_all(texts: pa.Array, known: pa.Array) -> Iterator[tuple[list[np.ndarray], pa.Array, np.ndarray]]:
    """Of some texts at a time the places of the words of each, and of its end, among the ``known``, whose number stands for others; these others but the ends, in a row; and how many of them come up to the end of each text."""
    missing = len(known)
    end = pc.index_in(pa.scalar(END, pa.large_binary()), value_set=known).as_py()
    for _, words, ends in cut_words(texts):
        found = pc.index_in(words, value_set=known)
        absent = pc.is_null(found)
        n = np.diff(ends, prepend=0)
        out = np.full(len(words) + len(ends), missing if end is None else end, np.int32)
        out[np.arange(len(words)) + np.repeat(np.arange(len(ends)), n)] = pc.fill_null(found, missing).to_numpy(zero_copy_only=False)
        others = np.concatenate([[0], np.cumsum(absent.to_numpy(zero_copy_only=False))])[ends]
        yield np.split(out, (ends + np.arange(1, len(ends) + 1))[:-1]), words.filter(absent), others


def trained(docs: DataFrame, vocabulary: Vocabulary, rounds: tuple[tuple[int, ...], ...] = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> Model:
    """The model after its rounds over ``docs`` (doc_id, text, tenth)."""
    model = Model(vocabulary)
    if not vocabulary.modelled:
        return model
    for tenths in rounds:
        shards = max(1, round(vocabulary.total * len(tenths) / sum(map(len, rounds)) / shard_tokens))
        key = F.xxhash64("doc_id", "text")
        some = docs.where(F.col("tenth").isin(*tenths)).select("text", key.alias("key"))
        dealt = some.repartitionById(shards, F.pmod("key", F.lit(shards)).cast("int")).sortWithinPartitions("key", "text")
        sent = docs.sparkSession.sparkContext.broadcast((model, vocabulary))

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, v = sent.value
            own = copy.deepcopy(own)  # tasks of one worker share what was sent
            known = pa.array(v.words[: v.modelled], pa.large_binary())
            n = train_on(own, (x for batch in batches for ids, _, _ in _ids_of_all(batch.column(0), known) for x in ids))
            if not n:
                return
            flat = own.flat().astype(np.float64) * n
            chunks = [flat[k : k + CHUNK].astype("<f4").tobytes() for k in range(0, len(flat), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(chunks)), pa.int32()), pa.array([np.array([n], "<f4").tobytes(), *chunks], pa.binary())], names=["chunk", "values"])

        sums = summed_arrays(dealt.select("text").mapInArrow(learn, "chunk int, values binary"))
        if -1 in sums:
            model.put(np.concatenate([sums[k] for k in sorted(sums) if k >= 0]) / sums[-1][0])
        sent.unpersist()
    return model


def score_texts(model: Model, texts: list[np.ndarray], size: int = 512) -> np.ndarray:
    """Natural log-likelihood of each whole text, the state running through it."""
    out = np.zeros(len(texts))
    start = np.array([model.start], np.int32)
    table = model.input_table()
    for which, windows in batches_of([np.concatenate([start, x]) for x in texts], size, SCORED):
        h = np.zeros((len(which), model.state), np.float32)
        for inputs, targets, active in windows:
            states, h = model.run(inputs, active, h[: inputs.shape[1]], table)
            on = np.arange(inputs.shape[1])[None, :] < active[:, None]
            logs, _ = model.log_probabilities(states[on], targets[on])
            found = np.zeros(on.shape)
            found[on] = logs
            out[which[: inputs.shape[1]]] += found.sum(axis=0)
    return out


def _scored(docs: DataFrame, model: Model, vocabulary: Vocabulary) -> DataFrame:
    """One row per document: what the frequent tokens give, and the words and times of the others."""
    sent = docs.sparkSession.sparkContext.broadcast((model, vocabulary))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, v = sent.value
        known = pa.array(v.words, pa.large_binary())
        row = TaskContext.get().partitionId() << 40
        log_rest = np.log10(v.rest)
        missing = len(v.words)
        base = np.append(v.base, 0.0)
        held: list[tuple] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            nonlocal row
            logs = score_texts(own, [x[-1] for x in held]) / np.log(10)
            cols = list(zip(*held, strict=True))
            rows = np.arange(row, row + len(held))
            row += len(held)
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(cols[:5], kinds, strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(rows), *arrays, pa.array(logs + np.array(cols[5])), pa.array(cols[6], pa.list_(pa.binary())), pa.array(cols[7], pa.list_(pa.int32()))],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "words", "times"],
            )

        for batch in batches:
            at = 0
            for ids_of, absent, others in _ids_of_all(batch.column(2), known):
                some = [batch.column(k).slice(at, len(ids_of)).to_pylist() for k in range(2)]
                at += len(ids_of)
                words, low = absent.to_numpy(zero_copy_only=False).tolist(), 0
                for doc_id, held_out, ids, high in zip(*some, ids_of, others.tolist(), strict=True):
                    tail = Counter(words[low:high])
                    low = high
                    if ids[-1] == missing:
                        tail[END] += 1
                    frequent = base[ids].sum()
                    rest = ids >= v.modelled
                    # In the last class the base probability holds; that of the others comes from the join.
                    in_rest = base[ids[rest]].sum() - rest.sum() * log_rest
                    held.append((doc_id, held_out, len(ids), len(ids) - tail.total(), float(frequent), float(in_rest), list(tail), list(tail.values()), np.minimum(ids, v.modelled)))
                    waiting += len(ids)
                    if waiting >= 2_000_000:
                        yield flush()
                        held, waiting = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, words array<binary>, times array<int>")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    tenth = id_remainder("doc_id", 10)
    held_out = F.coalesce(tenth == 0, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text", F.coalesce(tenth, F.lit(1)).alias("tenth"))
    training = docs.where("not held_out")
    counts = written(token_counts(training), "lm-counts")
    counts = counts.where("c > 0")
    vocabulary = vocabulary_of(counts)
    model = trained(training.select("doc_id", "text", "tenth"), vocabulary)
    rows = written(_scored(docs.select("doc_id", "held_out", "text"), model, vocabulary), "lm-scored")
    tail = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("t")).select("row", F.col("t.words").alias("word"), F.col("t.times").alias("times"))
    met = tail.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log = F.log10((F.col("c") + F.lit(SMOOTHING)) / F.lit(vocabulary.norm))
    more = met.groupBy("row").agg(F.sum(log * F.col("times")).alias("log"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("found"))
    out = rows.drop("words", "times").join(more, "row", "left")
    log, found = F.coalesce("log", F.lit(0.0)), F.coalesce("found", F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + found).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base") + log).alias("base_score"), (F.col("score") + log).alias("score"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
