import zlib

import numpy as np

from stallscope.llm import quality as q
from tests.llm import edges

LABELS = "doc_id long, quality int, toxic int"


def test_contexts_are_sums_of_index_vectors():
    places, signs = q.index_vectors()
    dense = np.zeros((q.BUCKETS, q.WIDTH))
    np.put_along_axis(dense, places, signs, axis=1)
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 50, n).astype(np.int32) for n in (0, 1, 2, 30, 7)]
    total = np.zeros(q.BUCKETS * q.WIDTH)
    q.add_contexts(total, texts, places, signs)
    expected = np.zeros((q.BUCKETS, q.WIDTH))
    for t in texts:
        for i in range(len(t)):
            for j in range(max(0, i - q.REACH), min(len(t), i + q.REACH + 1)):
                if i != j:
                    expected[t[i]] += dense[t[j]]
    assert np.allclose(total.reshape(expected.shape), expected)


def test_query_is_that_of_plain_loops(spark):
    """Word vectors, pooled documents and scores of the whole query, one text after the other."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    places, signs = q.index_vectors()
    index = np.zeros((q.BUCKETS, q.WIDTH))
    np.put_along_axis(index, places, signs, axis=1)
    rows = {i: [zlib.crc32(w.encode()) % q.BUCKETS for w in q._WORD.findall(t or "")] for i, t in docs.items()}
    v = np.zeros_like(index)
    for x in rows.values():
        for k, word in enumerate(x):
            for j in range(max(0, k - q.REACH), min(len(x), k + q.REACH + 1)):
                if j != k:
                    v[word] += index[x[j]]
    v = np.sign(v) * np.log1p(np.abs(v))
    v = v / np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-9)[:, None]

    def pooled(x):
        if not x:
            return np.zeros(2 * q.WIDTH + 4)
        some = v[x]
        apart = [np.mean([a @ b for a, b in zip(some, some[k:], strict=False)]) if len(x) > k else 0.0 for k in (1, 2)]
        return np.concatenate([some.mean(axis=0), np.sqrt(np.maximum((some * some).mean(axis=0) - some.mean(axis=0) ** 2, 0)), apart, [len(set(x)) / len(x), np.log1p(len(x))]])

    x = {i: pooled(r) for i, r in rows.items()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs}
    fitted = [r.doc_id for r in spark.createDataFrame([(i,) for i in labels if i in docs and not held[i]], "doc_id long").orderBy(edges.F.xxhash64("doc_id")).collect()]
    net = q.fit(np.array([x[i] for i in fitted]), np.array([float(labels[i] > 0) for i in fitted]))
    got = {r.doc_id: r for r in q.op5_quality(spark, sf).collect()}
    ids = sorted(docs)
    scores = net.scores(np.array([x[i] for i in ids]))
    assert sorted(got) == ids and all(got[i].held_out == held[i] for i in ids)
    # Sums of 32 and 64 bits part a little on their way through the network.
    assert np.mean(np.abs(scores - [got[i].score for i in ids]) < 0.02) > 0.97
    assert np.mean([got[i].predicted == (s >= q.ACCEPTED) for i, s in zip(ids, scores, strict=True)]) > 0.98


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = q.op5_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 900
    assert np.mean([r.predicted == r.quality for r in got]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_network_is_calibrated():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 5))
    y = (rng.random(6000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    s = q.fit(x[:5000], y[:5000], epochs=15).scores(x[5000:])
    for low in np.arange(0, 1, 0.25):
        k = (s >= low) & (s < low + 0.25)
        assert abs(s[k].mean() - y[5000:][k].mean()) < 0.12


def test_awkward_rows(spark, tmp_path):
    docs = edges.documents(spark)
    folder = edges.saved(docs, tmp_path)
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (7, 1, None), (8, 0, 0), (8, 0, 0), (1, None, 0), (None, 1, 0), (4, 1, 1)], LABELS).withColumn("text", edges.F.lit("clash"))
    edges.saved(labels, tmp_path, "labels")
    got = q.op5_quality(spark, folder).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    kept = q.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= 12
    edges.saved(labels.limit(0), tmp_path, "labels")
    assert {r.score for r in q.op5_quality(spark, folder).collect()} == {1.0}
    none = edges.saved(edges.empty(spark), tmp_path / "none")
    edges.saved(labels.limit(0), tmp_path / "none", "labels")
    assert q.op5_quality(spark, none).count() == 0
