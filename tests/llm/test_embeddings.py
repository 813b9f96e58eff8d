import numpy as np
import pytest

from stallscope.llm import embeddings
from stallscope.llm.embeddings import near_vectors, op4_pstable_vectors
from tests.llm import edges


def brute(rows, cosine=0.9):
    """Every different (vec_id, vector) counts once."""
    seen = {(i, None if v is None else tuple(v)): (i, v) for i, v in rows}
    rows = list(seen.values())
    ids = [i for i, _ in rows]
    x = [np.array(v, float) if v and None not in v else np.zeros(1) for _, v in rows]
    good = [np.isfinite(v).all() and bool(v.any()) for v in x]
    n = len(rows)
    links = {i: 0 for i in ids}
    parent = {i: i for i in ids}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    pairs = set()
    for a in range(n):
        for b in range(a + 1, n):
            if good[a] and good[b] and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= cosine:
                links[ids[a]] += 1
                links[ids[b]] += 1
                pairs.add((ids[a], ids[b]))
                ra, rb = root(ids[a]), root(ids[b])
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (links[i], root(i), root(i) == i) for i in ids}, pairs


def test_links_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op4_pstable_vectors(spark, sf).collect()}
    assert got == brute(rows)[0]


@pytest.mark.parametrize("block", [8, 512])
def test_large_groups_in_blocks(spark, block):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(32)
    rows = [(k, (base + 0.05 * rng.standard_normal(32)).tolist()) for k in range(60)]
    rows += [(100 + k, base.tolist()) for k in range(20)] + [(200 + k, rng.standard_normal(32).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, block=block, recall=0.999).collect()}
    assert got == brute(rows)[0]


def test_repeated_rows_and_ids_of_several_vectors(spark):
    rng = np.random.default_rng(9)
    a, b = rng.standard_normal(16), rng.standard_normal(16)

    def near(x, by=0.03):
        return (x + by * rng.standard_normal(16)).tolist()

    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    rows += [(10 + k, near(a)) for k in range(12)] + [(30 + k, near(b)) for k in range(12)]
    rows += rows[5:15] * 3
    rows += [(10, near(b)), (10, near(a)), (99, rows[4][1]), (31, rows[4][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for block in (3, 2048):
        got = near_vectors(df, block=block, recall=0.9999).collect()
        expected = brute(rows)[0]
        assert len(got) == len(rows)
        assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, *x) for i, x in expected.items()}
        assert expected[1] == (0, 1, True) and expected[10][0] > 12


def test_lengths_that_clash_in_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "buckets", lambda x, cells, tables: np.tile(np.arange(tables), (len(x), 1)))
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal(8), rng.standard_normal(12)
    rows = [(k, (base + 0.05 * rng.standard_normal(len(base))).tolist()) for k, base in enumerate([a, b] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (4, 512):
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, block=block).collect()} == brute(rows)[0]


def test_counts_and_components_agree_when_sketches_part_pairs(spark, monkeypatch):
    """With few signs allowed to differ many pairs are cut; a vector is in a component of several if and only if it has a link."""
    monkeypatch.setattr(embeddings, "most_differing", lambda cosine: 9)
    rng = np.random.default_rng(12)
    rows = []
    for group in range(40):
        base = rng.standard_normal(64)
        rows += [(20 * group + k, (base + 0.3 * rng.standard_normal(64)).tolist()) for k in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ids, x = [i for i, _ in rows], embeddings.unit([v for _, v in rows])[0]
    s = np.where(np.unpackbits(embeddings.sketch(x), axis=1), 1, -1)
    link = (x @ x.T >= 0.9) & (s @ s.T >= embeddings.SKETCH - 18)
    np.fill_diagonal(link, False)
    assert 0 < link.sum() < 0.5 * ((x @ x.T >= 0.9).sum() - len(x))
    for block in (8, 2048):
        got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, block=block, recall=0.9999).collect()}
        assert {i: got[i][0] for i in ids} == dict(zip(ids, link.sum(axis=1).tolist(), strict=True))
        members = {}
        for i, (_, c) in got.items():
            members.setdefault(c, []).append(i)
        assert all((len(m) > 1) == (got[i][0] > 0) for m in members.values() for i in m)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(400):
        a = rng.standard_normal(64)
        a /= np.sqrt(a @ a)
        b = rng.standard_normal(64)
        b -= (a @ b) * a
        b /= np.sqrt(b @ b)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (0.901 * a + np.sqrt(1 - 0.901**2) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = near_vectors(df).where("n_links > 0").count()
    assert found >= 0.95 * 800


def test_awkward_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0]), (10, [1.0, 2.0, 3.0]), (11, [1e-200, 2e-200]), (12, [1e200, 2e200]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", edges.F.lit("clash")).withColumn("n", edges.F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op4_pstable_vectors(spark, edges.saved(df, tmp_path, "embeddings")).collect()}
    assert got.pop(None) == (0, None, True)
    same = {7, 8, 9, 11, 12}
    assert got == {i: (4, 7, i == 7) if i in same else (0, i, True) for i in range(1, 13)}
    assert op4_pstable_vectors(spark, edges.saved(df.limit(0), tmp_path / "none", "embeddings")).count() == 0
