"""Language identification by segmentation-marginalised unigrams (operator 2).

The pieces are those of a fixed public vocabulary. A language is a distribution over pieces; the
probability of a word is the sum over all its segmentations into pieces, by a forward pass. Expected
piece counts per language come from all training texts by expectation maximisation: words are counted
per language once, and in each round every task runs the forward and backward passes over its share of
the distinct words and sends one vector of piece counts per language.

Probabilities of words too long for plain floating point are kept as one factor per place, so no word is cut.

Words are runs of letters (what Unicode calls so: no digits, fractions or other signs), in lower case. A
text that is null or has no letter is ``und`` with score 0. Languages are learned and scored ``TOGETHER`` at a
time, which bounds the table of piece probabilities that a task gets; with more of them texts pass by one table after the
other and keep the best language and the sum so far, so the result is that of one table of all.
Ties go to the language that sorts first. Without any training text all texts are ``und``. Rows with
equal doc_id are predicted each on its own. Other columns of the input are not read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, id_remainder, table, vocabulary, written

TOGETHER = 256  # languages
WORD_BYTES = 64 << 20  # of scores of words that a worker keeps
SPAN = 4096  # places of a long word that are worked on at a time
FLOOR = 0.1  # added to each expected count
ROUNDS = 2
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 1 << 20
_LETTERS = 64 << 20  # of texts whose words are held


def words_of(text: str | None) -> list[str]:
    found = _WORD.findall(text.lower()) if text else []
    if found and not "".join(found).isalpha():  # numbers that are neither digits nor letters
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split(" ")
        found = [w for w in found if w]
    return found


class Pieces:
    """The vocabulary's lower-case pieces of letters; id 0 stands for any single other letter."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = {model.id_to_piece(k).lstrip("▁").lower() for k in range(model.get_piece_size())}
        self.names = sorted(p for p in kept if p.isalpha())
        self.longest = max(map(len, self.names), default=1)
        self.size = len(self.names) + 1
        self.slot = np.zeros(_SLOTS, np.int32)
        self.hash = np.zeros(self.size, np.uint64)
        for k, name in enumerate(self.names, 1):
            self.hash[k] = h = _hashes(np.array([name]), len(name), len(name))[len(name) - 1][0, -1]
            at = int(_slot(h)[0])
            while self.slot[at]:
                at = (at + 1) % _SLOTS
            self.slot[at] = k

    @classmethod
    def shared(cls, path: str) -> Pieces:
        """One for all tasks that a Python worker runs."""
        if path not in _pieces:
            _pieces[path] = cls(path)
        return _pieces[path]

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, 0 where there is none."""
        at = _slot(h)
        found = self.slot[at]
        k = np.nonzero(found)
        wrong = self.hash[found[k]] != h[k]
        k = tuple(x[wrong] for x in k)
        while len(k[0]):  # slots that others have taken: go on to the next
            at[k] = (at[k] + 1) % _SLOTS
            found[k] = self.slot[at[k]]
            wrong = (found[k] != 0) & (self.hash[found[k]] != h[k])
            k = tuple(x[wrong] for x in k)
        return found


_pieces: dict[str, Pieces] = {}
_seen_words: dict[str, tuple[dict[str, int], np.ndarray]] = {}


def _slot(h: np.ndarray) -> np.ndarray:
    h = np.atleast_1d(h)  # wraps around silently, unlike a scalar
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype(np.int64)


def _hashes(words: np.ndarray, n: int, longest: int) -> list[np.ndarray]:
    """Of words of n letters, up to the longest piece: at [k][:, j] the hash of the k + 1 letters that end at place j (from place k on)."""
    code = np.ascontiguousarray(words, dtype=f"<U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64) + np.uint64(1)
    out = [code * _BASE]
    for k in range(1, min(n, longest)):
        prior = out[-1]
        h = prior.copy()
        h[:, 1:] = (prior[:, :-1] ^ (prior[:, :-1] >> np.uint64(31))) * _BASE + code[:, 1:]
        out.append(h)
    return out


def segment(pieces: Pieces, words: list[str], probability: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The log-probability of each word under each language (columns of ``probability``).

    With ``counts`` (word x language) also the expected counts (piece x language).
    """
    logs = np.zeros((len(words), probability.shape[1]))
    expected = np.zeros_like(probability) if counts is not None else None
    sizes = np.array([len(w) for w in words])
    least = -np.log10(probability.min())
    for n in np.unique(sizes):
        which = np.flatnonzero(sizes == n)
        some = max(1, min(20_000, 2_000_000 // (int(n) * probability.shape[1])))
        way = _segment_short if n * least < 290 else _segment_long
        for at in range(0, len(which), some):
            k = which[at : at + some]
            logs[k] = way(pieces, np.array([words[i] for i in k]), int(n), probability, None if counts is None else counts[k], expected)
    return logs, expected


def _segment_short(pieces: Pieces, words: np.ndarray, n: int, probability: np.ndarray, counts: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
    """Words of n letters by plain forward and backward sums."""
    ids = [pieces.find(x) for x in _hashes(words, n, pieces.longest)]
    p = [probability[ids[0]]]  # word x place x language; letters that are no piece have the probability of piece 0
    for x in ids[1:]:
        hit = np.nonzero(x)
        p.append(np.zeros((*x.shape, probability.shape[1])))
        p[-1][hit] = probability[x[hit]]
    alpha = np.zeros((len(words), n + 1, probability.shape[1]))
    alpha[:, 0] = 1
    for e in range(1, n + 1):
        for size in range(1, min(e, pieces.longest) + 1):
            alpha[:, e] += alpha[:, e - size] * p[size - 1][:, e - 1]
    total = alpha[:, n]
    if expected is None:
        return np.log(total)
    beta = np.zeros_like(alpha)
    beta[:, n] = 1
    for e in range(n, 0, -1):
        for size in range(1, min(e, pieces.longest) + 1):
            beta[:, e - size] += beta[:, e] * p[size - 1][:, e - 1]
    share = counts / total
    for size in range(1, min(n, pieces.longest) + 1):
        of = ids[size - 1][:, size - 1 :]
        weight = alpha[:, : n - size + 1] * p[size - 1][:, size - 1 :] * beta[:, size:] * share[:, None, :]
        _add(expected, of, weight, size)
    return np.log(total)


def _add(expected: np.ndarray, of: np.ndarray, weight: np.ndarray, size: int) -> None:
    hit = (of > 0) if size > 1 else np.ones_like(of, bool)
    for lang in range(weight.shape[-1]):
        expected[:, lang] += np.bincount(of[hit], weight[..., lang][hit], minlength=len(expected))


def _segment_long(pieces: Pieces, words: np.ndarray, n: int, probability: np.ndarray, counts: np.ndarray | None, expected: np.ndarray | None) -> np.ndarray:
    """Words of n letters by factors that stay near one, so that no length underflows.

    The forward sum at a place is the product of one factor for each place up to it. ``reach`` holds, by the size of the
    piece that ends at a place, the forward sum where that piece begins over that one place before. The share of each size
    among the segmentations up to a place then carries the expected counts back.
    """
    longest, langs = pieces.longest, probability.shape[1]
    reach = np.zeros((len(words), longest, langs))
    reach[:, 0] = 1
    logs = np.zeros((len(words), langs))
    starts, at = [], list(range(0, n, SPAN))
    code = np.ascontiguousarray(words, dtype=f"<U{n}").view("<U1").reshape(len(words), n)

    def span(lo: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        hi, first = min(lo + SPAN, n), max(0, lo - longest + 1)
        letters = np.ascontiguousarray(code[:, first:hi]).view(f"<U{hi - first}").reshape(-1)
        ids = np.zeros((len(words), hi - lo, longest), np.int32)
        for k, h in enumerate(_hashes(letters, hi - first, longest)):
            ids[:, :, k] = pieces.find(h[:, lo - first :])
        p = probability[ids]
        p[:, :, 1:][ids[:, :, 1:] == 0] = 0
        total = np.zeros((len(words), langs))
        for t in range(hi - lo):
            p[:, t] *= reach
            c = p[:, t].sum(axis=1)
            p[:, t] /= c[:, None]
            total += np.log(c)
            reach = np.concatenate([np.ones((len(words), 1, langs)), reach[:, :-1] / c[:, None]], axis=1)
        return ids, p, total, reach

    for lo in at:
        starts.append(reach)
        *_, total, reach = span(lo, reach)
        logs += total
    if expected is None:
        return logs
    mass = np.zeros((len(words), longest + 1, langs))  # of the boundaries at the last places
    mass[:, -1] = counts
    for lo, reach in zip(reversed(at), reversed(starts), strict=True):
        ids, share, *_ = span(lo, reach)
        length = share.shape[1]
        held = np.concatenate([np.zeros((len(words), length, langs)), mass], axis=1)
        for t in range(length - 1, -1, -1):
            share[:, t] *= held[:, t + longest + 1][:, None]
            held[:, t + 1 : t + longest + 1] += share[:, t, ::-1]
        for size in range(1, longest + 1):
            _add(expected, ids[:, :, size - 1], share[:, :, size - 1], size)
        mass = held[:, : longest + 1]
    return logs


def languages(docs: DataFrame) -> list[str]:
    """All languages, in order; the driver holds their names."""
    return sorted(r["lang"] for r in docs.where("lang is not null").select("lang").distinct().collect())


def train(docs: DataFrame, path: str, rounds: int = ROUNDS, langs: list[str] | None = None) -> tuple[list[str], np.ndarray]:
    """Languages (all, or some) and log of piece probabilities (piece x language), from all rows of (text, lang).

    What reaches the driver is one number per piece and language.
    """
    langs = languages(docs) if langs is None else langs
    size = Pieces(path).size
    probability = np.full((size, max(1, len(langs))), 1 / size)
    if langs:
        words = written(_word_counts(docs, langs), "language-words")
        for _ in range(rounds):
            probability = _round(words, path, probability)
        dropped(words)
    return langs, probability


def _word_counts(docs: DataFrame, langs: list[str]) -> DataFrame:
    """(word, lang, n) over all texts; lang is a place in ``langs``."""
    place = {x: k for k, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in langs]
        letters = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for k, c in enumerate(seen):
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([k] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], names=["word", "lang", "n"])
                    c.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[place[lang]].update(words_of(text))
                letters += len(text)
                if letters > _LETTERS or sum(map(len, seen)) > 400_000:
                    yield from flush()
                    letters = 0
        yield from flush()

    rows = docs.where(F.col("lang").isin(*langs) & F.col("text").isNotNull()).select("text", "lang").mapInArrow(count, "word string, lang int, n long")
    return rows.groupBy("word", "lang").agg(F.sum("n").alias("n"))


def _round(words: DataFrame, path: str, probability: np.ndarray) -> np.ndarray:
    sent = words.sparkSession.sparkContext.broadcast(probability)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.shared(path)
        total = np.zeros_like(sent.value)

        def add(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held)
            word = rows.column("word").combine_chunks().dictionary_encode()
            counts = np.zeros((len(word.dictionary), total.shape[1]))
            np.add.at(counts, (word.indices.to_numpy(), rows.column("lang").to_numpy()), rows.column("n").to_numpy())
            total[:] += segment(pieces, word.dictionary.to_pylist(), sent.value, counts)[1]

        held, waiting = [], 0
        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting >= 100_000:
                add(held)
                held, waiting = [], 0
        if waiting:
            add(held)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])], names=["piece", "lang", "n"])

    rows = words.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full_like(probability, FLOOR)
    counts[rows["piece"], rows["lang"]] += rows["n"]
    sent.unpersist()
    return counts / counts.sum(axis=0)


def predict(docs: DataFrame, langs: list[str], probability: np.ndarray, path: str) -> DataFrame:
    """Adds lang_pred and score, the posterior of that language, to every row of (doc_id, text, ...)."""
    return _scored(docs, langs, probability, path).withColumn("score", F.when(F.col("_sum") == -math.inf, 0.0).otherwise(F.exp(F.col("_best") - F.col("_sum")))).drop("text", "_best", "_sum")


def _scored(docs: DataFrame, langs: list[str], probability: np.ndarray, path: str) -> DataFrame:
    """Adds lang_pred, the logarithm of its probability (_best) and of the sum of all (_sum), or improves those that are there by more languages."""
    sent = docs.sparkSession.sparkContext.broadcast(probability)
    model, again = uuid.uuid4().hex, "lang_pred" in docs.columns
    added = ["lang_pred", "_best", "_sum"]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.shared(path)
        if model not in _seen_words:  # words that this worker's earlier tasks have scored by the same model
            _seen_words.clear()
            _seen_words[model] = {}, np.zeros((0, max(1, len(langs))))
        known, logs = _seen_words[model]
        letters = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                split = [words_of(t) for t in some.column(some.schema.get_field_index("text")).to_pylist()]
                if len(known) > 1_000_000 or logs.nbytes > WORD_BYTES or letters > _LETTERS:
                    known, logs, letters = {}, logs[:0], 0
                fresh = list(set().union(*split).difference(known))
                letters += sum(map(len, fresh))
                if fresh:
                    known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
                    logs = np.concatenate([logs, segment(pieces, fresh, sent.value)[0]])
                _seen_words[model] = known, logs
                before = zip(*(some.column(some.schema.get_field_index(c)).to_pylist() for c in added), strict=True) if again else repeat((UNKNOWN, -math.inf, -math.inf))
                names, bests, sums = [], [], []
                for words, (name, best, total) in zip(split, before, strict=False):
                    if words and langs:
                        s = logs[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0)
                        at_best = int(s.argmax())
                        total = float(np.logaddexp(total, s[at_best] + np.log(np.exp(s - s[at_best]).sum())))
                        if s[at_best] > best:  # of equal ones the earlier language stays
                            name, best = langs[at_best], float(s[at_best])
                    names.append(name)
                    bests.append(best)
                    sums.append(total)
                out = some.drop_columns(added) if again else some
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(names, pa.string()), pa.array(bests, pa.float64()), pa.array(sums, pa.float64())], names=[*out.schema.names, *added])

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in added)
    return docs.mapInArrow(label, f"{rest}, lang_pred string, _best double, _sum double")


def identify(docs: DataFrame, learned: DataFrame, path: str, together: int = TOGETHER) -> DataFrame:
    """Rows of (doc_id, text, ...) with lang_pred and score by the languages of ``learned`` (text, lang), so many at a time."""
    langs = languages(learned)
    if len(langs) <= together:
        return predict(docs, *train(learned, path, langs=langs), path)
    for at in range(0, len(langs), together):
        docs = written(_scored(docs, *train(learned, path, langs=langs[at : at + together]), path), "language-scored")
    return docs.withColumn("score", F.when(F.col("_sum") == -math.inf, 0.0).otherwise(F.exp(F.col("_best") - F.col("_sum")))).drop("text", "_best", "_sum")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), docs.where(~held_out).select("text", "lang"), path)
