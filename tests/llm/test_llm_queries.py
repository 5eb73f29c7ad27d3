"""The registered queries of the subpackage: against their SQL where there is one."""

import pytest
from oracle import SF, compare, connect

from millrace.llm.queries import CAPACITY, QUERIES, SQL


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, connect(), QUERIES[name], SQL[name])


def test_containers_hold_every_token_once(spark):
    rows = QUERIES["p7_containers"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    per, sums = {}, {}
    for r in rows:
        per[r.container] = per.get(r.container, 0) + r.n_units
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.n_units
    assert max(per.values()) <= CAPACITY and len(sums) == docs.count()


def test_shares_and_found(spark):
    shares = {r.source: r for r in QUERIES["p8_shares"](spark, SF).collect()}
    caps = {r.source: r.max_repeats for r in spark.read.parquet(f"{SF}/mix_targets.parquet").collect()}
    assert all(r.most_times <= caps.get(s, 0) for s, r in shares.items() if r.n_uses)
    found = QUERIES["p9_found"](spark, SF)
    assert found.columns == ["doc_id"] and found.count() == found.distinct().count()
