import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing as M

WORDS = {"news": "market report minister budget election", "songs": "love heart dance night baby", "code": "def return import class lambda", "rest": "misc other stuff things bits"}


@pytest.fixture(scope="module")
def documents(spark):
    rng = np.random.default_rng(0)
    rows, n = [], 0
    for source, many in (("news", 300), ("songs", 120), ("code", 20), ("rest", 40)):
        for _ in range(many):
            n += 1
            text = " ".join(rng.choice(WORDS[source].split(), int(rng.integers(5, 60))))
            rows.append((n, text, source if n % 10 else None))
    rows += [(9001, None, "news"), (9002, "", "code"), (9003, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_tokens", F.lit("clash"))


def test_targets_are_met_and_caps_hold(spark, documents):
    targets = spark.createDataFrame([("news", 0.5, 1), ("songs", 0.3, 2), ("code", 0.1, 3), ("absent", 0.1, 4), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    selection, shares = M.mix(documents, targets, "doc_id", "text", "source")
    got = {r.source: r for r in shares.collect()}
    assert set(got) == {"news", "songs", "code", "rest", "absent"}
    assert got["absent"].feasible_share == 0 and got["news"].feasible_share == pytest.approx(0.5 + 0.1 / 3)
    for s in ("news", "songs", "code"):
        assert got[s].expected_share == pytest.approx(got[s].feasible_share, abs=0.02)
    caps = {"news": 1, "songs": 2, "code": 3}
    used = selection.collect()
    assert all(1 <= r.times <= caps.get(r.source, 3) for r in used) and not any(r.source == "rest" for r in used)
    assert len({r.doc_id for r in used}) == len(used)


def test_a_total_beyond_reach_comes_near(spark, documents):
    targets = spark.createDataFrame([("news", 0.5, 1), ("code", 0.5, 2)], "source string, target_share double, max_repeats int")
    selection, shares = M.mix(documents, targets, "doc_id", "text", "source", total=1e9)
    got = {r.source: r for r in shares.collect()}
    assert got["news"].n_uses == got["news"].n_docs > 250 and got["code"].most_times == 2
    assert M.mix(documents.limit(0), targets, "doc_id", "text", "source")[0].count() == 0
    assert M.mix(documents, targets.limit(0), "doc_id", "text", "source")[0].count() == 0


def test_classifier_on_held_out_rows(documents):
    rows = [r for r in documents.collect() if r.text and r.source is None]
    model = M.train(documents, "text", "source")
    order = [s for s, many in (("news", 300), ("songs", 120), ("code", 20), ("rest", 40)) for _ in range(many)]
    got = model.posteriors(model.inputs([r.text for r in rows], [M._ids(r.text, M.TOKENIZER) for r in rows]))
    right = [model.sources[int(p.argmax())] == order[r.doc_id - 1] for p, r in zip(got, rows)]
    assert sum(right) / len(right) > 0.95
    assert model.report["accuracy"] > 0.9 > model.report["majority"] and model.report["log_loss"] < model.report["prior_log_loss"]
    p = model.posteriors(model.inputs([None], [M._ids(None, M.TOKENIZER)]))
    assert p.sum() == pytest.approx(1) and (p >= 0).all()


def test_posteriors_fall_back_on_shares_where_texts_tell_nothing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(WORDS["news"].split(), 20)), "big" if i % 4 else "small") for i in range(1200)]
    model = M.train(spark.createDataFrame(rows, "doc_id long, text string, source string"), "text", "source")
    p = model.posteriors(model.inputs([t for _, t, _ in rows[:200]], [M._ids(t, M.TOKENIZER) for _, t, _ in rows[:200]]))
    assert abs(p[:, model.sources.index("big")].mean() - 0.75) < 0.05 and model.report["accuracy"] >= model.report["majority"] - 0.02
    assert model.report["calibration_error"] < 0.1


def test_rounding_over_many_partitions_keeps_the_shares(spark):
    rows = [(i, "report budget " * (3 + i % 7), "a" if i % 20 else "b") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(40)
    targets = spark.createDataFrame([("a", 0.8, 1), ("b", 0.2, 1)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in M.mix(df, targets, "doc_id", "text", "source")[1].collect()}
    assert all(r.converged and abs(r.labelled_share - r.target_share) < 0.01 for r in got.values())


def test_feasible_targets():
    out = M.feasible_targets(np.array([0.5, 0.3, 0.2]), np.array([True, True, False]))
    assert out == pytest.approx([0.6, 0.4, 0.0])
    assert M.feasible_targets(np.array([0.0]), np.array([True])) == pytest.approx([0.0])
