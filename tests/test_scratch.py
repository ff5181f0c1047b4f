"""Scratch tables that a plan leaves on disk."""

from sievetext import session

SF = "/root/testdata/sf0.001"


def test_training_leaves_only_the_tables_it_reads(spark):
    """train_nl, train_pl, train_nl_selnl_selpl: the tables of the preparation stayed on disk."""
    from sievetext.plans.nlnl import NLNLConfig, noisy_feature_set

    spark.conf.set("spark.sievetext.broadcastBytes", 20_000)  # the look-up by frequent words
    other = session.materialize(spark.range(3), "of-another-query")
    since = session.written_mark()
    try:
        data = noisy_feature_set(spark, SF, NLNLConfig())
    finally:
        spark.conf.unset("spark.sievetext.broadcastBytes")
    names = sorted(p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in session._WRITTEN[since:])
    assert names == ["noisy-features", "test-features"]
    assert other.count() == 3
    assert data.train.count() and data.dev.count() and data.test.count()
