"""Word-vector files: parsed once, and the same rows whatever the vocabulary's size."""

from sievetext.operators.vectors import read_word_vectors

LINES = ["3 2", "a 1 2", "b 0.1 -2e3", "a 5 6", "c 1", "d 7 8", "b 9 10", "e x 1"]


def _read(spark, path, **kw):
    got, info = read_word_vectors(spark, path, on_error="drop", **kw)
    return {r.token: r.vec for r in got.collect()}, info


def test_last_line_wins_for_repeated_words(spark, tmp_path):
    (tmp_path / "v.txt").write_text("\n".join(LINES) + "\n")
    got, info = _read(spark, str(tmp_path))
    assert got == {"a": [5.0, 6.0], "b": [9.0, 10.0], "d": [7.0, 8.0]}
    assert info == {"dim": 2, "dropped_length": 2, "malformed": 1}


def test_large_vocabulary_is_joined_after_parsing(spark, tmp_path):
    """Over the broadcast budget the same words are kept, and a table without repeated
    words is neither grouped nor sorted."""
    (tmp_path / "v.txt").write_text("\n".join(LINES[1:3] + LINES[5:6] + ["f 0.1 0.3"]) + "\n")
    vocab = spark.createDataFrame([("a",), ("d",), ("f",), ("zz",), ("a",)], "token string")
    small, info = _read(spark, str(tmp_path), vocab=vocab)
    spark.conf.set("spark.sievetext.broadcastBytes", 0)
    try:
        large, info2 = _read(spark, str(tmp_path), vocab=vocab)
        plan = read_word_vectors(spark, str(tmp_path), vocab=vocab)[0]._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sievetext.broadcastBytes")
    assert small == large == {"a": [1.0, 2.0], "d": [7.0, 8.0], "f": [0.1, 0.3]} and info == info2
    assert "Aggregate" not in plan and "Join" not in plan
