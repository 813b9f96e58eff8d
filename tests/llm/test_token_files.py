import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stallscope.llm.common import vocabulary
from stallscope.llm.token_files import BLOCK, op10_token_files, pack, unpack
from tests.llm import edges

SF = "/root/testdata/sf0.001"


def tokenizer(name):
    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=4 * BLOCK))
def test_round_trip(ids):
    words, blocks, at, escaped = pack(np.array(ids, np.uint64))
    assert unpack(words, blocks.astype(np.int64), len(ids), at, escaped).tolist() == ids


def test_long_runs_pack_tightly():
    words, *_ = pack(np.zeros(BLOCK * 4, np.uint64))
    assert len(words) <= 8


def check(rows, docs):
    t = tokenizer("byte_bpe_50k.json")
    start = 0
    expected = []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected


def test_ids_are_those_of_the_tokenizer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check(op10_token_files(spark, SF).collect(), docs)


def test_awkward_rows(spark, tmp_path):
    docs = edges.documents(spark)
    check(op10_token_files(spark, edges.saved(docs, tmp_path)).collect(), docs.select("doc_id", "text").collect())
    assert op10_token_files(spark, edges.saved(edges.empty(spark), tmp_path / "none")).count() == 0
