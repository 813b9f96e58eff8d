import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from stallscope.llm import language_model as lm
from tests.llm import edges


def vocabulary(texts):
    c = Counter(w for t in texts for w in [*lm.words_of(t), lm.END])
    top = sorted(c.items(), key=lambda x: (-x[1], x[0]))
    return lm.Vocabulary([w for w, _ in top], [n for _, n in top], sum(c.values()), len(c))


def test_gradients_are_those_of_differences(monkeypatch):
    monkeypatch.setattr(lm, "MODELLED", 12)
    v = vocabulary(["a b c d e f g h a b c a b a", "x y z a b a", "b c d"])
    model = lm.Model(v)
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    get = v.index().get
    texts = [lm._ids(t, get, v.modelled) for t in ("a b c x q", "b", "c d e f g h a b")]
    which, windows = next(lm.batches_of([np.append(model.start, x) for x in texts], 8, 16))
    inputs, targets, active = next(windows)
    zero = np.zeros((3, lm.STATE))
    g, _ = model.window_gradients(inputs, targets, active, zero)

    def loss():
        states, _ = model.run(inputs, active, zero, model.input_table())
        on = np.arange(3)[None, :] < active[:, None]
        return -model.log_probabilities(states[on].astype(float), targets[on])[0].mean()

    for k, x in model.p.items():
        flat = x.reshape(-1)
        at = int(np.abs(g[k]).argmax())
        old = flat[at]
        flat[at] = old + 1e-4
        up = loss()
        flat[at] = old - 1e-4
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2e-4 - g[k].reshape(-1)[at]) < 1e-4


def test_probabilities_of_all_tokens_sum_to_one():
    v = vocabulary(["a b c d e f g h a b c a b a"] * 3)
    model = lm.Model(v)
    h = np.random.default_rng(0).standard_normal((4, lm.STATE)).astype(np.float32)
    total = sum(np.exp(model.log_probabilities(h, np.full(4, t))[0]) for t in range(v.modelled + 1))
    assert np.allclose(total, 1, atol=1e-5)
    assert abs(v.rest + ((v.counts[: v.modelled] + 0.1) / v.norm).sum() - 1) < 1e-9


def test_model_grows_with_the_corpus():
    sizes = []
    for distinct in (1_000, 20_000, 100_000):
        counts = [max(1, 40 * distinct // (k + 1)) for k in range(distinct)]
        v = lm.Vocabulary([b"%d" % k for k in range(distinct)], counts, sum(counts), distinct)
        assert v.modelled == len(v.class_of) >= lm.MODELLED and v.first[-1] == v.modelled
        assert lm.Model(v).p["embed"].shape == (v.modelled + 2, v.state)
        sizes.append((v.modelled, v.classes, v.state, sum(counts[: v.modelled]) / sum(counts)))
    (a, ca, sa, _), (b, cb, sb, _), (c, cc, sc, _) = sizes
    assert a < b < c and ca <= cb < cc and sa <= sb < sc
    # The share of tokens with a probability of their own does not fall to that of a fixed number of words.
    assert sizes[2][3] > sum(counts[:768]) / sum(counts) + 0.1


def test_more_than_255_classes(monkeypatch):
    monkeypatch.setattr(lm, "CLASSES", 300)
    v = vocabulary([" ".join(f"w{k}" for k in range(700))])
    model = lm.Model(v)
    h = np.random.default_rng(0).standard_normal((2, v.state)).astype(np.float32)
    assert v.classes > 255
    total = sum(np.exp(model.log_probabilities(h, np.full(2, t))[0]) for t in range(v.modelled + 1))
    assert np.allclose(total, 1, atol=1e-4)


def test_state_runs_through_windows_of_any_length(monkeypatch):
    v = vocabulary(["a b c d e f g h a b c a b a"] * 3)
    model = lm.Model(v)
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, v.modelled + 1, n) for n in (1, 5, 90, 33, 200, 64)]
    whole = lm.score_texts(model, texts)
    assert np.allclose(whole, [lm.score_texts(model, [t])[0] for t in texts], rtol=1e-4)
    monkeypatch.setattr(lm, "SCORED", 7)
    assert np.allclose(whole, lm.score_texts(model, texts, size=2), rtol=1e-4)


def likelihood(model, ids):
    """Of one text, token by token, by the equations of the model."""
    p = {k: x.astype(float) for k, x in model.p.items()}
    s, h, before, total = model.state, np.zeros(model.state), model.start, 0.0
    for token in ids:
        x = p["embed"][before] @ p["w"] + p["b"]
        z = 1 / (1 + np.exp(-(x[:s] + h @ p["u"][:, :s])))
        r = 1 / (1 + np.exp(-(x[s : 2 * s] + h @ p["u"][:, s:])))
        h = h + z * (np.tanh(x[2 * s :] + (r * h) @ p["un"]) - h)
        of_class = h @ p["cw"] + p["cb"]
        c = int(model.class_of[token])
        total += of_class[c] - np.log(np.exp(of_class).sum())
        if c < len(model.first) - 1:
            lo, hi = model.first[c], model.first[c + 1]
            inside = p["vw"][lo:hi] @ h + p["vb"][lo:hi]
            total += inside[token - lo] - np.log(np.exp(inside).sum())
        before = token
    return total


def test_scores_are_those_of_the_equations():
    rng = np.random.default_rng(4)
    v = vocabulary([" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 20_000) % 3000)])
    model = lm.Model(v)
    texts = [rng.integers(0, v.modelled + 1, n).astype(np.int32) for n in (1, 40, 300)]
    assert lm.train_on(model, iter(texts * 5)) == 5 * 341
    assert np.allclose(lm.score_texts(model, texts), [likelihood(model, t) for t in texts], rtol=1e-4)


def test_score_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few, many = ({r.doc_id: r.score for r in lm.score_documents(docs.repartition(n, "text")).collect()} for n in (1, 13))
    assert few.keys() == many.keys() and np.allclose([few[k] for k in few], [many[k] for k in few], rtol=1e-4)


def brute(rows):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    tokens = [[*lm.words_of(t), lm.END] for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, held[i], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 4)) for (i, _), ws in zip(rows, tokens, strict=True)]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))


def test_base_scores_and_likelihood(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = lm.op9_language_model(spark, sf).collect()
    assert order([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got]) == order(brute(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.985


def test_gain_over_the_base_on_held_out_texts(spark):
    """Of the logarithm of the base probability; some 45 of 100 tokens are of words too rare to be modelled."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    base, score = lm.score_documents(docs).where("held_out").groupBy().sum("base_score", "score").first()
    assert score > 0.97 * base


def test_small_head_and_rare_words(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 40)
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = lm.op9_language_model(spark, sf).collect()
    assert order([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got]) == order(brute(rows))


def test_head_is_exact_however_counts_are_spread(spark, monkeypatch):
    rng = np.random.default_rng(4)
    flat = [(b"long common prefix %d" % k, 1) for k in range(500)]
    ties = [(b"a" * n, 3) for n in range(1, 40)] + [(b"a" * n + b"\0", 3) for n in range(40)] + [(b"\xff" * n, 3) for n in range(1, 9)]
    mixed = [(b"w%d" % k, int(c)) for k, c in enumerate(rng.integers(1, 1 << 40, 200))]
    monkeypatch.setattr(lm, "LONGEST_HEAD_WORD", 60)
    for rows in (flat, ties, mixed, flat + ties + mixed, [(b"x" * 61, 9), (b"y" * 60, 1)], []):
        df = spark.createDataFrame([(bytearray(w), c) for w, c in rows], "word binary, c long").repartition(5)
        fit = sorted(((w, c) for w, c in rows if len(w) <= 60), key=lambda r: (-r[1], r[0]))
        for most in (1, 37, 300, 5000):
            monkeypatch.setattr(lm, "HEAD", most)
            v = lm.vocabulary_of(df)
            assert list(zip(v.words, v.counts, strict=True)) == fit[:most]
            assert (v.total, v.distinct) == (sum(c for _, c in rows), len(rows))


def test_awkward_rows(spark, tmp_path):
    docs = edges.documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = lm.op9_language_model(spark, edges.saved(docs, tmp_path)).collect()
    assert order([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got]) == order(brute(rows))
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)
    assert lm.op9_language_model(spark, edges.saved(edges.empty(spark), tmp_path / "none")).count() == 0
    untrained = spark.createDataFrame([(k, "a b") for k in range(200) if zlib.crc32(str(k).encode()) % 10 == 0], "doc_id long, text string")
    got = lm.op9_language_model(spark, edges.saved(untrained, tmp_path / "untrained")).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, round(r.score, 6)) for r in got} == {(0, 0, 0.0, 0.0)}


def test_words_are_cut_and_looked_up_many_at_a_time(monkeypatch):
    """Every ASCII character, white space of other kinds, and texts without words, in cuts of a few bytes and in one; one look-up for all texts of a cut."""
    texts = ["".join(f"{chr(k)}a" for k in range(128)), " \tA\u00a0b \x1c C\x85d\u2028 ", "", None, "\n", "b " * 50, "\u0130 \u00c9X c"]
    known = pa.array([b"a", b"c", lm.END], pa.large_binary())
    get = {b"a": 0, b"c": 1, lm.END: 2}.get
    looked, look = [], lm.pc.index_in
    monkeypatch.setattr(lm.pc, "index_in", lambda *a, **k: looked.append(1) or look(*a, **k))
    for most in (1, 40, 1 << 20):
        monkeypatch.setattr(lm, "TOGETHER_BYTES", most)
        looked.clear()
        ids, absent, counted = [], [], 0
        for some, words, others in lm._ids_of_all(pa.array(texts), known):
            ids += [x.tolist() for x in some]
            absent += words.to_pylist()
            counted += int(others[-1])
        assert ids == [lm._ids(t, get, 3).tolist() for t in texts]
        assert absent == [w for t in texts for w in lm.words_of(t) if w not in (b"a", b"c")] and counted == len(absent)
        assert len(looked) == 2 or most < 1 << 20
    assert [x for x in lm._ids_of_all(pa.array([], pa.string()), known)] == []
