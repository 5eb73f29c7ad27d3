import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import digests as D

AT = (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0)


def test_clusters_keep_weight_and_order():
    rng = np.random.default_rng(0)
    values = rng.lognormal(3, 2, 50_000)
    means, weights = D.cluster(values, np.ones(len(values)), 100)
    assert weights.sum() == len(values) and np.all(np.diff(means) > 0) and len(means) <= 52
    assert np.dot(means, weights) == pytest.approx(values.sum())
    again, w = D.cluster(np.concatenate([means, means]), np.concatenate([weights, weights]), 100)
    assert w.sum() == 2 * len(values) and len(again) <= 52


def test_percentiles_are_within_their_bound(spark):
    rng = np.random.default_rng(1)
    rows = [("a", f"m{i % 3}", float(v)) for i, v in enumerate(rng.lognormal(2, 2, 20_000))]
    rows += [("ties", "m1", float(v)) for v in rng.integers(0, 3, 3000)] + [("one", "m1", 7.0), (None, "m2", 1.0)]
    rows += [("a", "m1", None), ("a", "m1", float("nan")), ("none", "m1", None), ("a", "m1", float("inf"))]
    df = spark.createDataFrame(rows, "region string, month string, amount double").withColumn("n", F.lit("clash")).repartition(6)
    monthly = D.digest(df, ["region", "month"], "amount")
    yearly = D.combine(monthly, ["region"])
    assert {(r.region, r.n) for r in yearly.collect()} == {("a", 20_000), ("ties", 3000), ("one", 1), (None, 1)}
    out = D.certify(df, ["region"], "amount", D.quantiles(yearly, ["region"], AT), AT).collect()
    assert len(out) == 4 * len(AT) and all(r.within_bound for r in out)
    values = np.sort([v for k, _, v in rows if k == "a" and v is not None and np.isfinite(v)])
    for r in out:
        if r.region == "a":
            assert r.n_below == np.searchsorted(values, r.estimate, "left") and r.n_up_to == np.searchsorted(values, r.estimate, "right")
        if r.region == "one":
            assert r.estimate == 7.0
    assert D.digest(df.limit(0), ["region"], "amount").count() == 0


def test_two_step_merge_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(D, "_splits", lambda df: 1000)
    df = spark.range(5000).select((F.col("id") % 2).cast("string").alias("k"), F.col("id").cast("double").alias("v")).repartition(9)
    got = {r.k: r for r in D.digest(df, ["k"], "v").collect()}
    assert {k: (r.n, r.low, r.high) for k, r in got.items()} == {"0": (2500, 0.0, 4998.0), "1": (2500, 1.0, 4999.0)}
    assert D.estimate(np.array(got["0"].means), np.array(got["0"].weights), 0.0, 4998.0, 0.5) == pytest.approx(2499, abs=60)


def test_workers_hand_on_digests_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(D, "_DIGESTS", 7)
    monkeypatch.setattr(D, "_BUFFER_ALL", 300)
    df = spark.range(4000).select((F.col("id") % 40).cast("string").alias("k"), F.col("id").cast("double").alias("v")).repartition(3)
    got = {r.k: r for r in D.digest(df, ["k"], "v").collect()}
    assert len(got) == 40 and all(r.n == 100 and r.low == float(k) and r.high == 3960.0 + float(k) for k, r in got.items())


@pytest.mark.parametrize("limit", [20_000, 1])
def test_one_pass_certifies_groups_and_their_union(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "BROADCAST_GROUPS", limit)
    rng = np.random.default_rng(5)
    rows = [(str(rng.choice(["x", "y"])), f"m{i % 4}", float(v)) for i, v in enumerate(rng.lognormal(1, 1, 4000))] + [(None, "m0", 3.0), ("x", None, 4.0)]
    df = spark.createDataFrame(rows, "region string, month string, amount double").repartition(5)
    monthly = D.digest(df, ["region", "month"], "amount")
    out = D.certify_both(df, ["region", "month"], "month", "amount", monthly, (0.25, 0.5)).collect()
    assert all(r.within_bound and r.estimate is not None for r in out)
    for region in ("x", "y"):
        values = np.sort([v for k, _, v in rows if k == region])
        whole = {r.percentile: r for r in out if r.region == region and r.month is None and r.n == len(values)}
        assert set(whole) == {0.25, 0.5}
        for r in whole.values():
            assert r.n_below == np.searchsorted(values, r.estimate, "left") and r.n_up_to == np.searchsorted(values, r.estimate, "right")


def test_exact_quantiles(spark):
    rng = np.random.default_rng(6)
    rows = [(k, float(v)) for k, n in (("a", 3000), ("b", 7), ("c", 1)) for v in rng.integers(0, 50, n)] + [(None, 1.0), (None, 2.0), ("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {(r.k, r.percentile): r.value for r in D.exact_quantiles(df, ["k"], "v", (0.0, 0.1, 0.5, 0.77, 1.0)).collect()}
    for (k, q), v in got.items():
        assert v == pytest.approx(np.quantile([x for g, x in rows if g == k and x is not None and x == x], q))
    assert len(got) == 20 and D.exact_quantiles(df.limit(0), ["k"], "v", (0.5,)).count() == 0
