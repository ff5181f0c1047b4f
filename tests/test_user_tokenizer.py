"""A user's tokeniser works through a batch of texts in bounded parts."""

import pandas as pd
from pyspark.sql import functions as F

from sievetext.functions import text as T


def test_slices_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(T, "SLICE_CHARS", 10)
    texts = pd.Series(["abc", None, "defgh", "ijk", "", "x" * 40, "y", None])
    parts = list(T._slices(texts))
    assert [t for p in parts for t in p] == texts.tolist()
    assert [len(p) for p in parts] == [4, 2, 2]
    assert [len(p) for p in T._slices(texts.iloc[:0])] == [0]


def test_user_tokens_of_many_slices(spark, monkeypatch):
    """Tokens stay with their rows, null and empty texts too."""
    rows = [(i, None if i % 7 == 0 else "ab cd " * (i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(2)

    def fn(t):
        T.SLICE_CHARS = 40  # in the worker: from its next batch on
        return t.split()

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 12)
    try:
        got = df.select("id", T.python_tokenizer(fn)(F.col("text")).alias("t")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.id: r.t for r in got} == {i: None if t is None else t.split() for i, t in rows}
