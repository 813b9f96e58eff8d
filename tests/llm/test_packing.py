import zlib
from collections import defaultdict

import numpy as np

from stallscope.llm.packing import combinations, non_negative_least_squares, op3_nnls_packing, pack_documents, plan
from tests.llm import edges
from tests.llm.test_token_files import SF, tokenizer


def check(rows, docs):
    t = tokenizer("word_bpe_49k.json")
    ids = [(d, [*t.encode(x or "", add_special_tokens=False).ids, 1]) for d, x in docs]
    whole = defaultdict(list)
    for d, x in ids:
        whole[d].append(x)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d, pieces in by_doc.items():
        assert sum(r.length for r in pieces) == sum(map(len, whole[d]))
        for r in pieces:
            assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in whole[d])
        if len(whole[d]) == 1:
            at = 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at
                at += r.length
    assert set(by_doc) == set(whole)
    short = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
        short += at < 2048
    return short


def test_pieces_are_those_of_the_tokenizer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert check(op3_nnls_packing(spark, SF).collect(), docs) <= 1


def test_awkward_rows(spark, tmp_path):
    docs = edges.documents(spark)
    check(op3_nnls_packing(spark, edges.saved(docs, tmp_path)).collect(), docs.select("doc_id", "text").collect())
    assert op3_nnls_packing(spark, edges.saved(edges.empty(spark), tmp_path / "none")).count() == 0


def test_smaller_window_and_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pack_documents(docs, window=128, shard_ids=20_000).collect()
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 128
    assert 1 < sum(v < 128 for v in fill.values()) <= sum(fill.values()) / 20_000 + 1


def test_equal_rows_are_packed_each_on_its_own(spark):
    rows = [(None, "a b c")] * 300 + [(7, "a b c d e f")] * 300 + [(7, None)] * 50
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window=64).collect()
    assert sum(r.start == 0 for r in got) == len(rows) and sum(r.doc_tokens == 1 for r in got) == 50
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_combinations_fill_most_windows():
    sizes = np.maximum(1, np.random.default_rng(1).lognormal(6, 0.8, 8000)).astype(np.int64)
    windows = defaultdict(list)
    for d, start, length, sequence, _ in plan(sizes):
        windows[sequence].append((d, start, length))
    shared = [w for w in windows.values() if w[0][2] < 2048]
    whole = [w for w in shared if all(start % 2048 == 0 and start + length == sizes[d] for d, start, length in w)]
    assert len(whole) > 0.9 * len(shared)
    assert sum(length for w in windows.values() for _, _, length in w) == sizes.sum()


def test_combinations_fill_and_solution_is_least_squares():
    lengths = np.array([5, 3, 2, 7])
    kinds = combinations(lengths, 12)
    assert kinds and all(sum(a * b for a, b in k) == 12 for k in kinds)
    histogram = np.zeros(13)
    histogram[[5, 7, 2]] = 40, 40, 6
    a = np.zeros((13, len(kinds)))
    for c, k in enumerate(kinds):
        for length, times in k:
            a[length, c] = times
    x = non_negative_least_squares(kinds, histogram, 3000)
    gradient = a.T @ (a @ x - histogram)
    assert (x >= 0).all() and (gradient > -0.05).all() and np.abs(gradient[x > 0.05]).max() < 0.05
    assert plan(np.zeros(0, np.int64)) == []
