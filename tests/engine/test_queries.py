import pytest

from stallscope.plans import catalog
from tests.oracle import assert_same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_has_the_rows_of_its_sql(spark, name):
    n = assert_same(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], SF)
    assert n or name in ("p2p_unmatched_recvs",)


def test_fixture_figures(spark):
    q = catalog.queries()
    assert q["trace_scan"](spark, SF).count() == 23938
    assert q["p2p_pairs"](spark, SF).count() == 3509
    assert tuple(q["collective_group_summary"](spark, SF).first()) == (1993, 15870)
    got = {r["metric"]: r["count"] for r in q["wait_stats"](spark, SF).collect()}
    assert got == {"late_sender": 1739, "late_receiver": 1770, "barrier_wait": 982, "barrier_completion": 982, "earlyreduce": 413, "latebroadcast": 1547, "wait_nxn": 6539, "nxn_completion": 6539}
