import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import packing as P
from millrace.llm import tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60), st.integers(100, 130))
def test_every_item_is_packed_once_and_nothing_overflows(sizes, capacity):
    windows = P.pack(sizes, capacity)
    assert sorted(i for _, items in windows for i in items) == list(range(len(sizes)))
    for total, items in windows:
        assert total == sum(sizes[i] for i in items) <= capacity


def test_differencing_is_even():
    assert sorted(s for s, _ in P.difference([8, 7, 6, 5, 4], 2)) == [14, 16]
    rng = random.Random(0)
    sizes = [rng.randint(1, 1000) for _ in range(400)]
    sums = [s for s, _ in P.difference(sizes, 20)]
    assert len(sums) == 20 and max(sums) - min(sums) < 40
    assert P.pack([], 5) == [] and P.pack([0, 0], 5) == [(0, [0, 1])]
    with pytest.raises(ValueError):
        P.pack([6], 5)


def test_items_are_split_only_beyond_the_capacity(spark):
    rng = random.Random(1)
    rows = [(i if i % 50 else None, rng.choice([0, 3, 40, 99, 100, 101, 250, 1000, None])) for i in range(500)] + [(7, 60)] * 40
    df = spark.createDataFrame(rows, "doc_id long, n long").withColumn("container", F.lit("clash"))
    out = P.pack_items(df, "doc_id", "n", 100, shard_items=100).collect()
    per = {}
    for r in out:
        per.setdefault(r.container, []).append(r.n_units)
    assert all(sum(v) <= 100 for v in per.values()) and all(sum(per[r.container]) == r.container_units for r in out)
    assert sum(r.n_units for r in out) == sum(n or 0 for _, n in rows)
    assert len(out) == sum(-(-(n or 0) // 100) or 1 for _, n in rows)
    for r in out:
        if r.piece_no or r.n_units == 100:
            assert r.first_unit == r.piece_no * 100
    report = P.fill_report(P.pack_items(df, "doc_id", "n", 100, 100), 100).first()
    assert report.largest <= 100 and report.fill > 0.9
    assert P.pack_items(df.limit(0), "doc_id", "n", 100).count() == 0


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["Hello there, you'll  see 42\r\nlines…", "", None, "古い時計", "00:00:07,310 --> 00:00:11,197", "a" * 20_000, "Ça va ? \ud800" if False else "Ça va ?"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.with_token_counts(df, "text", ["doc_id"]).collect()}
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        assert got[i] == (len(other.encode(t, add_special_tokens=False).ids) if t else 0)
    assert tokens.count_tokens("x \ud800 y") > 0
