from collections import Counter

import numpy as np
import pytest

from stallscope.llm import dart_minhash
from stallscope.llm.dart_minhash import leading, near_duplicate_links, near_duplicates, op6_dart_minhash, shingles, signature
from tests.llm import edges


def test_agreement_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    hits = truth = 0.0
    for _ in range(40):
        e = rng.integers(0, 2**63, 60).astype(np.uint64)
        a, b = rng.random(60) * 3 + 0.1, rng.random(60) * 3 + 0.1
        hits += (signature(e, a, 200) == signature(e, b, 200)).mean()
        truth += np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs(hits - truth) / 40 < 0.02


def brute(rows, similarity=0.8, weighted=True):
    """Least id of each document's component of all pairs of weighted Jaccard similarity; a document's own texts are linked."""
    texts = {}
    for i, t in rows:
        if i is not None:
            count = Counter(shingles(t).tolist())
            texts.setdefault(i, []).append(count if weighted else Counter(set(count)))
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def similar(x, y):
        shared = sum((x & y).values())
        return x and y and shared >= similarity * (sum(x.values()) + sum(y.values()) - shared) - 1e-9

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(similar(x, y) for x in texts[a] for y in texts[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("block", [4, 256])
def test_classes_are_those_of_all_pairs(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    long = [*base, *base[::-1], *(f"x{j}" for j in range(20))]
    copies = [(100_000 + k, " ".join([*long, f"y{k}", "end"])) for k in range(30)]
    # A chain, and texts that share bands with the copies without being similar to them.
    copies += [(200_000 + k, " ".join(f"z{j}" for j in range(k * 5, k * 5 + 60))) for k in range(12)]
    copies += [(300_000 + k, " ".join([*long, *(f"v{k}w{j}" for j in range(14))])) for k in range(20)]
    # Equal sets of shingles, but not as often each.
    copies += [(400_000 + k, " ".join(["la la la la la la"] * (1 + 3 * k) + base)) for k in range(3)]
    # Documents of several texts.
    copies += [(500_001, "one two three four five six seven"), (500_002, "one two three four five six seven"), (500_002, "sun moon star sky cloud rain"), (500_003, "sun moon star sky cloud rain"), (500_004, "sun moon star sky cloud rain")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(copies, "doc_id long, text string"))
    rows = docs.collect()
    got = {r.doc_id: r.class_id for r in near_duplicates(docs, block=block).collect()}
    expected = brute(rows)
    assert got == expected
    assert expected[500_004] == 500_001 and expected[400_001] == 400_001


def test_wide_groups_that_stay_open_are_compared_in_full(spark):
    """Members of one band in many blocks, of several classes and outliers: no link may be lost, and every link is sound."""
    families = [(f * 1000 + k, " ".join([*(f"f{f}w{j}" for j in range(60)), f"own{k % 3}"])) for f in range(3) for k in range(3)]
    chain = [(9000 + k, " ".join(f"c{j}" for j in range(k * 4, k * 4 + 60))) for k in range(25)]
    rows = [*families, *chain]
    texts = spark.createDataFrame(rows, "id long, text string")
    members = texts.selectExpr("id", "cast(length(text) as long) size", "0 band", "0L hash")
    links = near_duplicate_links(texts, members, block=4).collect()
    sets = {i: Counter(shingles(t).tolist()) for i, t in rows}
    for r in links:
        x, y = sets[r.a], sets[r.b]
        assert sum((x & y).values()) >= 0.8 * sum((x | y).values()) - 1e-9
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        parent[max(root(r.a), root(r.b))] = min(root(r.a), root(r.b))
    assert {i: root(i) for i in parent} == brute(rows)


def test_pages_of_one_template_do_not_meet_each_other(spark, monkeypatch):
    """Pages of one band group that share five sixths of their words and are no duplicates, with some that are: the first meet nobody, the others are all found."""
    rng = np.random.default_rng(3)
    common = [f"t{j}" for j in range(300)]
    rows = []
    for k in range(1500):
        own = [f"p{k}w{j}" for j in range(int(rng.integers(50, 80)))]
        rows.append((k, " ".join([*common, *own])))
        if k % 150 == 0:
            rows.append((10_000 + k, " ".join([*common, *own[:-1], "changed"])))
    texts = spark.createDataFrame(rows, "id long, text string").repartition(8)
    members = texts.selectExpr("id", "cast(length(text) as long) size", "0 band", "0L hash")
    held, whole = {}, dart_minhash.written

    def counted(df, name):
        out = whole(df, name)
        held[name] = out.count()
        return out

    monkeypatch.setattr(dart_minhash, "written", counted)
    links = {(min(r), max(r)) for r in map(tuple, near_duplicate_links(texts, members).collect())}
    assert links == {(k, 10_000 + k) for k in range(0, 1500, 150)}
    # A page leads with less than a third of its shingles; none but the ten pairs may go on.
    assert held["near-able"] <= 20 and held.get("near-pairs", 0) <= 100
    assert held["near-leading"] <= 120 * len(rows) and held["near-sets"] == len(rows)


def test_leading_shingles_of_similar_sets_meet():
    rng = np.random.default_rng(7)
    for _ in range(3000):
        pool = rng.integers(0, 1 << 62, int(rng.integers(2, 60))).astype(np.uint64)
        counts = rng.integers(0, 4, 16).astype(np.float32)
        sets = []
        for _ in range(2):
            kept = np.unique(pool[rng.random(len(pool)) < 0.95])
            sets.append((kept, rng.choice([1.0, 1.0, 1.0, 2.0, 5.0], len(kept)) if rng.random() < 0.3 else np.ones(len(kept))))
        (a, v), (b, w) = sorted(sets, key=lambda x: x[1].sum())
        if not len(a) or not len(b):
            continue
        shared = sum(min(v[list(a).index(e)], w[list(b).index(e)]) for e in set(a.tolist()) & set(b.tolist()))
        if shared >= 0.8 * (v.sum() + w.sum() - shared) - 1e-9:
            (first, n), (other, _) = leading(a, v, counts, 0.8), leading(b, w, counts, 0.8)
            assert set(first[:n].tolist()) & set(other.tolist())


def test_recall_at_the_threshold(spark):
    """Pairs whose similarity is 0.8 to 0.83: at least 97 of 100 are found."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(150):
        words = [f"p{k}q{j}" for j in range(104)]
        rows.append((2 * k, " ".join(words)))
        at = int(rng.integers(20, 80))
        changed = [*words[:at], "changed", *words[at + 1 :]] if k % 2 else words[10:]
        changed = [*changed[: at // 2], "again", *changed[at // 2 + 1 :]] if k % 2 else changed
        rows.append((2 * k + 1, " ".join(changed)))
    expected = brute(rows)
    pairs = [i for i in expected if expected[i] != i]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 100 and sum(got[i] == expected[i] for i in pairs) >= 0.97 * len(pairs)
    assert all(got[i] in (i, expected[i]) for i in got)


def test_awkward_rows(spark, tmp_path):
    docs = edges.documents(spark)
    got = {r.doc_id: (r.class_id, r.kept) for r in op6_dart_minhash(spark, edges.saved(docs, tmp_path)).collect()}
    assert got[5] == (5, True) and got[6] == (5, False)
    assert all(got[k] == (k, True) for k in (1, 2, 3, 4, 7, 8, 9, 10, None))
    assert op6_dart_minhash(spark, edges.saved(edges.empty(spark), tmp_path / "none")).count() == 0
