"""Physical-plan checks of the scale claims in the README."""

import contextlib
import io

from pyspark.sql import functions as F

from sievetext.operators.encode import encode_fixed
from sievetext.operators.lm import next_token_pairs
from sievetext.operators.noise import inject_noise
from sievetext.operators.vectors import mean_pool
from sievetext.operators.vocab import vocabulary
from sievetext.plans.features import Vectors
from sievetext.plans.prepare import prepare

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_encode_one_shuffle_broadcast_index_pruned_scan(spark):
    p = prepare(spark, SF)
    plan = _plan(encode_fixed(p.tokens, p.index, 64))
    assert plan.count("Exchange hashpartitioning") == 1          # regroup by row id only
    assert "BroadcastHashJoin" in plan                             # small index: no token shuffle
    assert "partial_collect_list" in plan                          # combined before the shuffle
    assert "ReadSchema: struct<id:bigint,tokens:array<string>>" in plan


def test_noise_cut_off_moves_no_rows(spark):
    wide = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 4).cast("int").alias("label"))
    plan = _plan(inject_noise(wide, 4, 0.3, "exc"))
    assert "Exchange" not in plan


def test_next_token_pairs_row_local(spark):
    p = prepare(spark, SF)
    assert "Exchange" not in _plan(next_token_pairs(p.tokens))


def test_vocabulary_partial_aggregate(spark):
    p = prepare(spark, SF)
    plan = _plan(vocabulary(p.tokens))
    # map-side HashAggregate, one exchange, final HashAggregate
    assert plan.count("HashAggregate(keys=[token") == 2 and plan.count("Exchange") == 1


def test_local_pool_has_no_shuffle(spark):
    p = prepare(spark, SF)
    v = Vectors(p)
    plan = _plan(mean_pool(p.tokens, v.token_vecs, v.dim, max_items=254, unk=v.unk, method="local"))
    assert "Exchange" not in plan and "MapInArrow" in plan.replace("PythonMapInArrow", "MapInArrow")


def test_split_lookup_shuffles_only_rare_rows(spark):
    p = prepare(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(encode_fixed(p.tokens, p.index, 64, hot=p.hot_index(50)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    # the hot words are resolved by a broadcast join on the token rows ...
    assert any("BroadcastHashJoin" in ln and "LeftOuter" in ln for ln in lines)
    # ... and the token-keyed shuffle of the rare branch sits above the "not hot" filter
    rare = next(i for i, ln in enumerate(lines) if "SortMergeJoin" in ln and "LeftOuter" in ln)
    exch = next(i for i in range(rare, len(lines)) if "Exchange hashpartitioning(token" in lines[i])
    assert any("isnull(_hot" in ln for ln in lines[exch:exch + 4])


def test_attention_join_path_moves_states_only(spark):
    """No window; after the look-up one exchange, of states, not of item vectors."""
    from sievetext.operators.vectors import attention_pool

    p = prepare(spark, SF)
    v = Vectors(p)
    plan = _plan(attention_pool(p.tokens, v.token_vecs, v.dim, unk=v.unk, method="join"))
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1
