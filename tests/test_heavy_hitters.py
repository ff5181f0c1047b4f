"""Heavy hitters against exact counts, on both ways."""

import random
from collections import Counter

import pytest
from sievetext.operators.vocab import capped_index, frequency_index, token_counts, top_counts


def texts(spark, seed, n_words, skew):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(n_words)]
    weights = [1 / (i + 1) ** skew for i in range(n_words)]
    rows = [(rng.choices(words, weights, k=rng.randint(0, 200)),) for _ in range(120)] + [(None,), ([],), ([None, "w0"],)]
    return spark.createDataFrame(rows, "tokens array<string>").repartition(5), rows


@pytest.mark.parametrize("skew,n_words,top,capacity,proved", [
    (2.0, 400, 5, 60, True),       # most words are rare: the bound proves the few
    (0.0, 400, 5, 20, False),      # all alike: nothing can be proved, all are counted
    (1.0, 400, 20, 1000, True),    # the summaries hold every word
    (1.0, 8, 50, None, True),      # fewer words than asked for
])
def test_top_equals_exact(spark, skew, n_words, top, capacity, proved):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        df, rows = texts(spark, 5, n_words, skew)
        got, sure = top_counts(df, top=top, capacity=capacity)
        exact = Counter(t for (ts,) in rows for t in ts or [] if t is not None)
        assert sure == proved
        order = sorted(exact.items(), key=lambda r: (-r[1], r[0]))[:top]
        got = {r.token: r["count"] for r in got.collect()}
        assert dict(order).items() <= got.items() <= dict(exact).items()
        if sure and capacity and capacity < n_words:
            assert len(got) < len(exact)  # only candidates were counted
        for cap in (capacity, 3):
            index = capped_index(df, num_words=top + 4, capacity=cap).collect()
            want = frequency_index(token_counts(df), specials=()).where(f"id < {top + 4}").collect()
            assert sorted(map(tuple, index)) == sorted(map(tuple, want))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nothing_to_count(spark):
    df = spark.createDataFrame([(None,), ([],)], "tokens array<string>")
    assert top_counts(df, top=3)[0].collect() == [] and capped_index(df, num_words=10).collect() == []
    assert capped_index(df, num_words=4).collect() == []
    with pytest.raises(ValueError):
        top_counts(df, top=0)
