import pyarrow.parquet as pq

from stallscope.llm import common
from stallscope.llm import decontamination as d
from tests.llm import edges
from tests.oracle import assert_same


def test_pairs_are_those_of_the_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert assert_same(d.op7_contained_items(spark, sf), d.oracle(), sf) > 0


def test_changed_items_down_to_the_threshold(spark):
    items, docs, n = [], [], 0
    for size in (1, 3, 5, 9, 14, 20, 33, 60, 150):
        words = [f"i{size}w{k}" for k in range(size)]
        items.append((size, " ".join(words)))
        for changed in range(0, size, max(1, size // 12)):
            around = [f"n{n}x{k}" for k in range(300)]
            body = [w if k != changed else "changed" for k, w in enumerate(words)]
            docs.append((n, " ".join([*around, *body, *around])))
            n += 1
            docs.append((n, " ".join(body).upper()))
            n += 1
    def sets(t):
        w = t.lower().split()
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    expected = {(i, j) for i, t in docs for j, q in items if len(sets(t) & sets(q)) >= 0.8 * len(sets(q)) - 1e-9}
    got = d.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == expected
    assert len(expected) > 20


def test_short_items_are_found_inside_long_documents(spark, tmp_path):
    around = " ".join(f"w{k}" for k in range(200))
    docs = [(1, f"{around} Alpha beta {around}"), (2, f"{around} beta alpha {around}"), (3, "alpha beta"), (4, "gamma"), (5, f"{around}\tgamma"), (6, "alpha beta gamma delta"), (7, "x alpha beta"), (8, None), (9, f"{around} one two three four five {around}")]
    items = [(1, "alpha beta"), (2, "Gamma"), (3, "alpha beta gamma delta"), (4, "one two three four five"), (5, "two three four"), (6, "absent")]
    folder = edges.saved(spark.createDataFrame(docs, "doc_id long, text string"), tmp_path)
    edges.saved(spark.createDataFrame(items, "item_id long, text string"), tmp_path, "benchmark")
    got = {(r.doc_id, r.item_id) for r in d.op7_contained_items(spark, folder).collect()}
    assert got == {(1, 1), (3, 1), (6, 1), (7, 1), (4, 2), (5, 2), (6, 2), (6, 3), (9, 4), (9, 5)}
    flat = tmp_path / "flat"
    flat.mkdir()
    for name in ("documents", "benchmark"):
        pq.write_table(pq.read_table(f"{folder}/{name}.parquet"), f"{flat}/{name}.parquet")
    assert assert_same(d.op7_contained_items(spark, str(flat)), d.oracle(), str(flat)) == len(got)


def test_awkward_rows(spark, tmp_path):
    docs = edges.documents(spark)
    folder = edges.saved(docs, tmp_path)
    items = spark.createDataFrame([(1, "fox jumps over the lazy dog near"), (1, "fox jumps over the lazy dog near"), (2, None), (3, " "), (4, "one"), (None, "one")], "item_id long, text string").withColumn("doc_id", edges.F.lit("clash"))
    edges.saved(items, tmp_path, "benchmark")
    got = {(r.doc_id, r.item_id) for r in d.op7_contained_items(spark, folder).collect()}
    assert got == {(5, 1), (6, 1), (4, 4)}
    none = edges.saved(edges.empty(spark), tmp_path / "none")
    edges.saved(items.limit(0), tmp_path / "none", "benchmark")
    assert d.op7_contained_items(spark, none).count() == 0


def test_past_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    sf = "/root/testdata/sf0.001"
    assert assert_same(d.op7_contained_items(spark, sf), d.oracle(), sf) > 0
