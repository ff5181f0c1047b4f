"""Look-ups by frequent rows sent to the workers: same results as the plain joins."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievetext.operators import frequent
from sievetext.operators.cnn import CNNRunner, CNNText
from sievetext.operators.encode import decode_ids, encode_capped, encode_fixed, word_ids
from sievetext.operators.frequent import LocalIndex
from sievetext.operators.vectors import attention_pool, mean_pool
from sievetext.operators.vocab import vocabulary, word_index

WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def rows(spark):
    """Texts of 0 to 60 words, a null text, ids that come twice, and null ids."""
    rng = np.random.default_rng(3)
    texts = [[WORDS[min(39, int(rng.exponential(6)))] for _ in range(n)] for n in (0, 1, 3, 60, 25, 25, 7, 12, 12)]
    ids = [1, 2, 3, 4, 5, 6, None, 8, 8]
    data = [(i, 1, t) for i, t in zip(ids, texts, strict=True)] + [(9, 1, None), (10, 0, ["unseen", "w1", "w39"])]
    return spark.createDataFrame(data, "id long, y int, tokens array<string>").repartition(3)


@pytest.fixture(scope="module")
def index(spark, rows):
    known = rows.where("id is null or id <> 10")
    return word_index(vocabulary(known)).localCheckpoint()


@pytest.fixture(scope="module")
def vectors(spark):
    """Vectors that are exact floats, one that is not, one missing (w5) and one null."""
    rng = np.random.default_rng(4)
    data = [(w, [float(np.float32(x)) for x in rng.normal(size=4)]) for w in WORDS if w != "w5"]
    data[2] = (data[2][0], [0.1, 0.2, 0.7, -0.3 / 7])
    data[30] = (data[30][0], [0.1, -0.9, 1 / 3, 0.3])
    data[3] = (data[3][0], None)
    return spark.createDataFrame(data, "token string, vec array<double>")


def unk():
    return F.array(*[F.lit(x) for x in (0.1, 0.2, -0.3, 0.4)])


@pytest.fixture
def small_batches(spark):
    """Rows that go on over many batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _collected(df, col):
    return sorted(((r.id, r[col]) for r in df.collect()), key=str)


def _plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as buf:
        df.explain()
    return buf.getvalue()


@pytest.mark.parametrize("share", [6])
def test_ids_equal_plain_join(spark, rows, index, share, small_batches):
    local = LocalIndex(index.where(F.col("id") < share))
    got = encode_fixed(rows, index, 20, keep=("y",), hot=local)
    want = encode_fixed(rows, index, 20, keep=("y",))
    assert _collected(got, "ids") == _collected(want, "ids") and _collected(got, "y") == _collected(want, "y")
    assert _collected(word_ids(rows, index, hot=local), "ids") == _collected(word_ids(rows, index), "ids")
    ids = want.where("id <> 8").select("id", F.concat("ids", F.array(F.lit(10**9))).alias("ids"))  # an unknown id
    assert _collected(decode_ids(ids, index, hot=local), "tokens") == _collected(decode_ids(ids, index), "tokens")
    assert _collected(encode_capped(rows, index, 12, 16, hot=local), "ids") == _collected(
        encode_capped(rows, index, 12, 16), "ids")


def test_whole_index_needs_no_join(spark, rows, index):
    """Capped ids: all that is looked up is sent to the workers, so one shuffle brings
    rows of one id together and no word moves."""
    capped = LocalIndex(index.where("id < 12"), whole=True)
    got = encode_capped(rows, index, 12, 16, hot=capped)
    plan = _plan(got)
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert _collected(got, "ids") == _collected(encode_capped(rows, index, 12, 16), "ids")


def test_long_words_are_left_to_the_join(spark):
    long = "x" * 300
    rows = spark.createDataFrame([(1, ["a", long, "b"])], "id long, tokens array<string>")
    index = word_index(vocabulary(rows))
    local = LocalIndex(index, whole=True)
    assert not local.whole
    assert _collected(word_ids(rows, index, hot=local), "ids") == _collected(word_ids(rows, index), "ids")


@pytest.mark.parametrize("pool", [mean_pool, attention_pool])
@pytest.mark.parametrize("hot", [0, 8])
def test_pools_equal_plain_join(spark, rows, vectors, pool, hot, small_batches):
    some = vectors.where(F.col("token").isin(WORDS[:hot]))
    keep = {"keep": ("y",)} if pool is mean_pool else {}
    for cut in (None,) if hot else (5,):
        got = pool(rows, vectors, 4, unk=unk(), method="join", hot=some, max_items=cut, **keep)
        want = pool(rows, vectors, 4, unk=unk(), method="join", max_items=cut, **keep)
        a, b = _collected(got, "features"), _collected(want, "features")
        assert [i for i, _ in a] == [i for i, _ in b] and len(a) == 10
        x, y = ({str(i): v for i, v in s} for s in (a, b))
        assert all(np.allclose(x[i], y[i], atol=1e-12) for i in y)
        if keep:
            assert _collected(got, "y") == _collected(want, "y")


def test_frequent_vectors_are_not_joined(spark, rows, vectors):
    """The frequent vectors reach the workers outside the plan: no broadcast join
    with them, and only the vectors of other items are moved."""
    for pool in (mean_pool, attention_pool):
        plan = _plan(pool(rows, vectors, 4, unk=unk(), method="join", hot=vectors.where("token < 'w2'")))
        assert "_hot" not in plan and "collect_list" not in plan and "aggregate_metrics" not in plan


def test_frequent_items_are_weighted_where_the_text_lies(spark, rows, vectors, monkeypatch):
    """Only texts whose last word is not frequent bring their frequent items to the merge."""
    written = {}
    monkeypatch.setattr(frequent, "materialize", lambda df, name: written.setdefault(name, df.localCheckpoint()))
    attention_pool(rows, vectors, 4, unk=unk(), method="join", hot=vectors.where(F.col("token").isin(WORDS[:8]))).collect()
    local = written["frequent-items"]
    moved = local.groupBy("_last").agg(F.sum(F.size("_codes")).alias("n")).collect()
    assert {r["n"] for r in moved if r["_last"] != -1} == {0}
    assert sum(r["n"] for r in moved if r["_last"] == -1) > 0


def test_attention_with_far_scores(spark, small_batches):
    """Scores from -800 to 800 in one text, frequent or not, its query too; rows of one id are one."""
    vecs = {"a": [20.0, 1.0], "b": [-40.0, 2.0], "c": [40.0, 3.0], "d": [20.0, -1.0], "e": [-20.0, 5.0]}
    texts = [(1, list("abcda")), (1, list("ccbe")), (2, list("bbbbda")), (2, list("be")), (3, list("b")), (4, []),
             (5, list("bed")), (6, list("bea"))]
    table = spark.createDataFrame(list(vecs.items()), "token string, vec array<double>")
    rows = spark.createDataFrame(texts, "id long, tokens array<string>").repartition(2)
    want = {}
    for i in {i for i, _ in texts}:
        h = [(np.dot(vecs[w], vecs[t[-1]]), np.array(vecs[w])) for j, t in texts if j == i for w in t]
        e = [np.exp(s - max(s for s, _ in h)) for s, _ in h]
        want[i] = sum(x * v for x, (_, v) in zip(e, h, strict=True)) / sum(e) if h else np.zeros(2)
    for hot in ("abcde", "abc", "de", "bd", ""):
        got = attention_pool(rows, table, 2, method="join", hot=table.where(F.col("token").isin(list(hot) or ["-"]))).collect()
        assert len(got) == len(want) and all(np.allclose(r.features, want[r.id], atol=1e-12) for r in got)


@pytest.mark.parametrize("hot", [6])
def test_cnn_rows_equal_joined_ones(spark, rows, index, vectors, hot, small_batches):
    enc = encode_fixed(rows.where("id <> 8"), index, 20, keep=("y",))
    lookup = index.join(vectors, "token", "left").select("id", F.coalesce("vec", unk()).alias("vec")).localCheckpoint()
    model = CNNText(2, 4)
    runner = CNNRunner(enc, lookup, 4, 20, budget=0, hot=lambda: lookup.where(F.col("id") < hot))
    plain = CNNRunner(enc, lookup, 4, 20, budget=0)
    a, b = ({r.id: r.probs for r in x.score(model).collect()} for x in (runner, plain))
    assert a.keys() == b.keys() and all(np.allclose(a[i], b[i], atol=1e-12) for i in a)
    a, b = (x.gradient_frame(model, kind="pl", epoch=3).first() for x in (runner, plain))
    assert a["n"] == b["n"] and np.allclose(a["grad"], b["grad"], atol=1e-12)
    plan = _plan(runner.data)  # written once: a pass over the rows joins and moves nothing
    assert "Join" not in plan and "Exchange" not in plan
