import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from stallscope.llm import filter_audit
from stallscope.llm.filter_audit import FILTERS, audit, document_flags, op13_filter_audit, oracle
from tests.llm.edges import documents, empty, saved
from tests.oracle import assert_same

SF = "/root/testdata/sf0.01"
COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def by_hand(rows, filters=FILTERS):
    """Rows (part, flags by filter, good, toxic): every order applied filter by filter to lists of documents."""
    out = []
    for part in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == part]
        sums, found = Counter(), []
        for order in itertools.permutations(filters):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                late = sum(r[1][f] for r in own) - len(gone)
                alone = sum(r[1][f] and sum(r[1].values()) == 1 for r in own)
                sums[f] += len(gone)
                found.append([part, "".join(order), k + 1, len(left), len(gone), late, alone, sum(r[2] for r in gone), sum(r[3] for r in gone), f])
        out += [(*x[:-1], sums[x[-1]]) for x in found]
    return sorted(out)


def test_whole_query_against_sql(spark):
    n = assert_same(op13_filter_audit(spark, SF), oracle(), SF)
    assert n == 600 * spark.read.parquet(f"{SF}/documents.parquet").select(F.coalesce("lang", F.lit(""))).distinct().count()


def test_orders_by_hand(spark, monkeypatch):
    """All orders, of parts with and without survivors; each set of filters is made once, and nothing stays persisted."""
    made, edges = [], filter_audit.counted_edges

    def noted(rows, filters, marks):
        whole = filter_audit._name
        with monkeypatch.context() as m:
            m.setattr(filter_audit, "_name", lambda state: made.append(state) or whole(state))
            return edges(rows, filters, marks)

    monkeypatch.setattr(filter_audit, "counted_edges", noted)
    rng = random.Random(1)
    rows = [(rng.choice(["x", "y", "z"]), {f: rng.random() < 0.4 for f in FILTERS}, rng.random() < 0.5, rng.random() < 0.2) for _ in range(300)]
    rows += [("only", dict.fromkeys(FILTERS, True), True, True)] * 3  # a part without survivors after any step
    df = spark.createDataFrame([(p, *fs.values(), g, t) for p, fs, g, t in rows], "part string, A boolean, B boolean, C boolean, D boolean, E boolean, good boolean, toxic boolean")
    got = audit(df, FILTERS, ("good", "toxic"))
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == by_hand(rows)
    assert len(made) == len(set(made)) == 2**5 - 1 and spark.sparkContext._jsc.getPersistentRDDs().size() == 0
    one = audit(df.drop("good", "toxic"), ["C"]).collect()
    assert {(r.part, r.step, r.removed, r.unique_fails, r.shapley) for r in one} == {(p, 1, *[sum(fs["C"] for q, fs, *_ in rows if q == p)] * 3) for p in "x y z only".split()}


def test_awkward_rows(spark, tmp_path):
    docs = documents(spark)
    labels = [(5, 1, 0), (5, 0, 1), (6, None, None), (None, 1, 1), (7, 1, 1), (99, 1, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    saved(docs, tmp_path)
    folder = saved(labels, tmp_path, "labels")
    rows = docs.select("doc_id", "text", "lang").collect()
    marks = {5: (True, True), 7: (True, True)}
    known = []
    for r in rows:
        text = r.text or ""
        words = [w for w in text.replace("\n", " ").replace("\t", " ").split(" ") if w]
        first = min((q.doc_id for q in rows if (q.text or "") == text and q.doc_id is not None), default=None)
        fails = (len(words) < 200, len(set(words)) * 100 < 50 * len(words), sum("A" <= c <= "Z" for c in text) * 100 > 3 * len(text), any(c in "#$%&*|" for c in text), r.doc_id is not None and r.doc_id > first)
        known.append((r.lang or "", dict(zip(FILTERS, fails, strict=True)), *marks.get(r.doc_id, (False, False))))
    got = op13_filter_audit(spark, folder)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == by_hand(known)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "int"] + ["bigint"] * 7
    saved(empty(spark), tmp_path / "none")
    saved(labels.limit(0), tmp_path / "none", "labels")
    assert op13_filter_audit(spark, str(tmp_path / "none")).count() == 0


def test_a_hot_text_is_found_once(spark):
    docs = spark.createDataFrame([(k, "the same words" if k % 3 else f"text {k}", "en") for k in range(6000)], "doc_id long, text string, lang string")
    flags = document_flags(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert flags.where("E").count() == 3999 and flags.count() == 6000
