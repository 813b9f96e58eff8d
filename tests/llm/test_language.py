import itertools
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from stallscope.llm.common import vocabulary
from stallscope.llm import language
from stallscope.llm.language import Pieces, identify, op2_language, segment, train, words_of
from tests.llm import edges

PATH = vocabulary("piece_bpe_32k.model")


def test_forward_sum_is_that_of_all_segmentations():
    pieces = Pieces(PATH)
    rng = np.random.default_rng(1)
    p = rng.random((pieces.size, 3)) / 100
    ids = {name: k for k, name in enumerate(pieces.names, 1)}
    words = ["the", "nation", "größe", "a", "qzx"]
    logs, expected = segment(pieces, words, p, np.ones((len(words), 3)))
    total = np.zeros_like(p)
    for w, row in zip(words, logs, strict=True):
        whole = np.zeros(3)
        parts = []
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(w)]
            names = [w[a:b] for a, b in itertools.pairwise(at)]
            if all(n in ids or len(n) == 1 for n in names):
                k = [ids.get(n, 0) for n in names]
                parts.append((k, p[k].prod(axis=0)))
                whole += parts[-1][1]
        assert np.allclose(np.log(whole), row)
        for k, x in parts:
            for piece in k:
                total[piece] += x / whole
    assert np.allclose(total, expected)


def test_pieces_of_any_length():
    pieces = Pieces(PATH)
    assert pieces.longest == max(map(len, pieces.names)) > 10
    word = max(pieces.names, key=len)
    p = np.full((pieces.size, 1), 1e-9)
    p[pieces.names.index(word) + 1] = 0.5
    logs, expected = segment(pieces, [word], p, np.ones((1, 1)))
    assert np.allclose(np.exp(logs), 0.5) and np.allclose(expected[pieces.names.index(word) + 1], 1)


def test_words_of_any_length(monkeypatch):
    monkeypatch.setattr(language, "SPAN", 23)
    pieces = Pieces(PATH)
    rng = np.random.default_rng(2)
    p = rng.random((pieces.size, 2)) ** 4
    p = np.maximum(p / p.sum(axis=0), 1e-9)
    ids = {name: k for k, name in enumerate(pieces.names, 1)}
    words = ["thenationandthelandofthefreemenwhowanderonandonforeverandever", "qzx" * 20, "ab" * 500, max(pieces.names, key=len) * 5]
    logs, expected = segment(pieces, words, p, np.ones((len(words), 2)))
    for w, row in zip(words, logs, strict=True):
        total = [np.zeros(2)]  # of logarithms, by plain loops
        for e in range(1, len(w) + 1):
            ways = [total[e - k] + np.log(p[ids.get(w[e - k : e], 0)]) for k in range(1, min(e, pieces.longest) + 1) if k == 1 or w[e - k : e] in ids]
            total.append(np.logaddexp.reduce(ways, axis=0))
        assert np.allclose(total[-1], row)
    lengths = np.array([1, *map(len, pieces.names)])
    assert np.allclose(lengths @ expected, sum(map(len, words)))
    short = np.array(["nation", "growth", "qzxqzx"])
    one, two = np.zeros_like(p), np.zeros_like(p)
    a = language._segment_short(pieces, short, 6, p, np.full((3, 2), 2.0), one)
    b = language._segment_long(pieces, short, 6, p, np.full((3, 2), 2.0), two)
    assert np.allclose(a, b) and np.allclose(one, two)


def test_only_letters_make_words():
    assert words_of("½ ² Ⅷ ① 12 _ !") == []
    assert words_of("a½b x² élan") == ["a", "b", "x", "élan"]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = op2_language(spark, sf).join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 150
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_query_is_that_of_plain_loops(spark):
    """Expectation rounds, predictions and scores of the whole query, word by word."""
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    pieces = Pieces(PATH)
    ids = {name: k for k, name in enumerate(pieces.names, 1)}
    training = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 5 and lang]
    langs = sorted({lang for _, lang in training})
    counts = {lang: Counter(w for t, x in training if x == lang for w in words_of(t)) for lang in langs}
    p = np.full((pieces.size, len(langs)), 1 / pieces.size)

    def parts(w):
        return [(e - k, e, ids.get(w[e - k : e], 0)) for e in range(1, len(w) + 1) for k in range(1, min(e, pieces.longest) + 1) if k == 1 or w[e - k : e] in ids]

    def forward(w, col):
        a = [1.0] + [0.0] * len(w)
        for start, end, piece in parts(w):
            a[end] += a[start] * col[piece]
        return a

    for _ in range(language.ROUNDS):
        expected = np.full_like(p, language.FLOOR)
        for k, lang in enumerate(langs):
            col = p[:, k].tolist()
            for w, n in counts[lang].items():
                a, b = forward(w, col), [0.0] * len(w) + [1.0]
                for start, end, piece in reversed(parts(w)):
                    b[start] += b[end] * col[piece]
                for start, end, piece in parts(w):
                    expected[piece, k] += n * a[start] * col[piece] * b[end] / a[-1]
        p = expected / expected.sum(axis=0)
    columns = p.T.tolist()
    got = {r.doc_id: r for r in op2_language(spark, sf).collect()}
    for i, t, _ in rows[:80]:
        logs = np.array([sum(np.log(forward(w, col)[-1]) for w in words_of(t)) for col in columns])
        posterior = np.exp(logs - np.logaddexp.reduce(logs))
        if words_of(t):
            assert got[i].lang_pred == langs[int(posterior.argmax())] and abs(got[i].score - posterior.max()) < 1e-6


def test_languages_in_several_blocks_are_those_of_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    # Many languages: the words of the four, and of a dozen made of a part of their texts.
    learned = docs.select("text", F.when(F.col("doc_id") % 3 == 0, F.concat("lang", (F.col("doc_id") % 5).cast("string"))).otherwise(F.col("lang")).alias("lang"))
    one, several = ({r.doc_id: r for r in identify(docs.select("doc_id", "text"), learned, PATH, together=n).collect()} for n in (256, 3))
    assert one.keys() == several.keys() and len({r.lang_pred for r in one.values()}) > 4
    for k, r in one.items():
        assert several[k].lang_pred == r.lang_pred and abs(several[k].score - r.score) < 1e-9


def test_awkward_rows(spark, tmp_path):
    got = op2_language(spark, edges.saved(edges.documents(spark), tmp_path)).collect()
    assert len(got) == 12
    unknown = {r.doc_id for r in got if r.lang_pred == "und"}
    assert unknown == {1, 2, 3, 10}
    assert {r.score for r in got if r.lang_pred == "und"} == {0.0}
    assert op2_language(spark, edges.saved(edges.empty(spark), tmp_path / "none")).count() == 0
    untrained = op2_language(spark, edges.saved(edges.documents(spark).withColumn("lang", edges.F.lit(None).cast("string")), tmp_path / "untrained")).collect()
    assert {r.lang_pred for r in untrained} == {"und"}


def test_more_training_moves_probabilities_to_seen_pieces(spark):
    docs = spark.createDataFrame([("the nation the nation", "en"), ("la ciudad la ciudad", "es")], "text string, lang string")
    langs, p = train(docs, PATH)
    assert langs == ["en", "es"]
    assert np.allclose(p.sum(axis=0), 1)
