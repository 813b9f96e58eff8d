import re

import corpus_pipeline
from tests.llm import edges
from tests.llm.test_dart_minhash import brute as near_classes
from tests.llm.test_packing import check as check_packing
from tests.llm.test_personal_data import expected as spans_of

SF = "/root/testdata/sf0.001"


def shingles(t):
    w = t.lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_each_stage_does_its_work_on_all_it_gets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        kept[name] = docs.collect()
        if name != "pack":
            assert docs.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {r.doc_id for r in kept["quality"]}
    assert sum(labels[i] == 1 for i in labels if i in good) >= 0.9 * sum(labels.values())
    classes = near_classes([(r.doc_id, r.text) for r in kept["quality"]])
    assert {r.doc_id for r in kept["near_dedup"]} == set(classes.values())
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in kept["near_dedup"] if not any(len(shingles(r.text) & q) >= 0.8 * len(q) - 1e-9 for q in items)}
    assert {r.doc_id for r in kept["decontaminate"]} == clean
    before = {r.doc_id: r.text for r in kept["decontaminate"]}
    for r in kept["pii"]:
        assert not spans_of(r.text)
        assert r.n_chars == len(r.text)
        if not spans_of(before[r.doc_id]) and r.text != before[r.doc_id]:
            assert re.search(r"\[(EMAIL|IP|CARD|PHONE|SECRET)\]", r.text)
    assert {r.doc_id for r in kept["pii"]} == clean
    # A task that packs pads the last of its sequences.
    assert check_packing(kept["pack"], [(r.doc_id, r.text) for r in kept["pii"]]) <= len({r.sequence_id >> 40 for r in kept["pack"]})


def test_awkward_rows(spark, tmp_path):
    docs = edges.documents(spark)
    folder = edges.saved(docs, tmp_path)
    edges.saved(spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    edges.saved(spark.createDataFrame([(1, "no such words in any text")], "item_id long, text string"), tmp_path, "benchmark")
    pieces = corpus_pipeline.run(spark, folder).collect()
    # Copies go, repeated rows stay once, everything else stays.
    assert {r.doc_id for r in pieces} == {1, 2, 3, 4, 5, 7, 8, 9, 10, None}
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{folder}/{name}.parquet").limit(0)
        edges.saved(df, tmp_path / "none", name)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
