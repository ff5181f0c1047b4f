"""Streaming encode and the driver entry points."""

from pyspark.sql import functions as F

from sievetext.functions.text import tokenize
from sievetext.operators.encode import encode_fixed
from sievetext.operators.vocab import vocabulary, word_index
from sievetext.session import scratch_path
from sievetext.streaming.encode_stream import start_encoding

SF = "/root/testdata/sf0.001"


def test_stream_encode_matches_batch(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toks = docs.select(F.col("doc_id").alias("id"), tokenize("text").alias("tokens"))
    idx = word_index(vocabulary(toks))
    stream = spark.readStream.schema(docs.schema).parquet(f"{SF}/documents.parq[u]et")
    out = scratch_path(spark, "stream-test")
    q = start_encoding(stream.select(F.col("doc_id").alias("id"), "text"), idx, 16, out,
                       scratch_path(spark, "stream-test-ckpt"), available_now=True)
    q.awaitTermination()
    got = {r.id: r.ids for r in spark.read.parquet(out).collect()}
    want = {r.id: r.ids for r in encode_fixed(toks, idx, 16).collect()}
    assert got == want and len(got) == docs.count()


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 50
    from sievetext.queries import QUERIES

    # the library's own registry has none of the subpackage's queries
    assert not any(k.startswith("op") or "pipeline" in k for k in QUERIES) and set(QUERIES) <= set(qs)
    df = e.entry(spark)
    assert df.columns == ["id", "y", "label_clean", "is_flipped", "p_y", "pred", "kept"]
    assert df.count() > 0


def test_reference_flow_by_name(spark):
    from sievetext import compat
    from sievetext.sources.tables import labeled_corpus

    corpus = labeled_corpus(spark, SF)
    vocab = compat.create_vocab(corpus)
    index = compat.load_word_idx_maps(vocab)
    loader = compat.create_dataloader(corpus, index, max_length=32, batch_size=16)
    rows = loader.collect()
    assert len(rows) == corpus.count() and max(r.batch_id for r in rows) == (len(rows) - 1) // 16
    with_comp = compat.choose_complement_targets(loader, 4, epoch=1).collect()
    assert all(r.comp != r.y for r in with_comp)
    toks = corpus.select("id", "y", tokenize("text").alias("tokens"))
    train, valid, widx = compat.load_data_set(toks, max_len=20, vocab_size=500, batch_size=8, n_valid=50)
    assert valid.count() == 50 and train.count() % 8 == 0
    assert {r.token: r.id for r in widx.where("id < 3").collect()} == {"<PAD>": 0, "<START>": 1, "<UNK>": 2}
    assert all(len(r.ids) == 20 for r in valid.collect())


def test_scratch_tables_can_be_dropped(spark):
    import os

    from sievetext import session

    kept, session._WRITTEN = session._WRITTEN, []
    try:
        session.materialize(spark.range(5), "dropped")
        path = session._WRITTEN[0].removeprefix("file:")
        assert os.path.isdir(path) and session.drop_scratch(spark) == 1 and not os.path.exists(path)
    finally:
        session._WRITTEN = kept


def test_only_a_local_master_makes_its_own_folder(monkeypatch):
    from sievetext import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {"spark.checkpoint.dir": None}

    import pytest
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(Session())
