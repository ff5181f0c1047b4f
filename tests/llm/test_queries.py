"""Every registered query on awkward and on empty tables."""

import pytest

from fixtures import ROWS, TALK
from sievetext.llm.queries import QUERIES

PER_DOCUMENT = ["op2_pii", "op3_language_id", "op4_quality_rules", "op5_simhash",
                "op6_decontaminate", "op7_secrets", "op8_toxicity", "op12_merkle", "op13_lm_scoring"]


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_per_document(spark, awkward, name):
    got = [r.doc_id for r in QUERIES[name](spark, awkward).collect()]
    assert sorted(got, key=str) == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    assert [r.conv_id for r in rows] == [-1] if name.startswith("op1_") else rows == []


def test_all_conversations(spark, awkward):
    rows = QUERIES["op1_chat_format"](spark, awkward).collect()
    assert sorted(str(r.conv_id) for r in rows) == sorted({str(r[0]) for r in TALK} | {"-1"})
    assert sum(r.n_turns for r in rows) == len(TALK) + 2


def test_packed_documents(spark, awkward):
    rows = QUERIES["op10_packing"](spark, awkward).collect()
    assert sorted({str(r.doc_id) for r in rows}) == sorted({str(r[0]) for r in ROWS})
    assert sum(r.length for r in rows if r.doc_id == 3) == 1 and all(0 < r.length <= 4096 for r in rows)


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0
    kept = {r.doc_id for r in corpus_pipeline.run(spark, awkward).collect()}
    assert kept <= {r[0] for r in ROWS} and 2 not in kept and 3 not in kept


def test_stages_keep_the_columns(spark, awkward):
    import corpus_pipeline

    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, awkward)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


@pytest.mark.parametrize("name", ["op4_quality_rules", "op6_decontaminate", "op11_collocations", "op12_merkle",
                                  "op13_lm_scoring"])
def test_sql_on_awkward_tables(spark, awkward, name):
    import duckdb

    from sievetext.llm.queries import ORACLES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{awkward}/{t}.parquet/*.parquet')")
    got = QUERIES[name](spark, awkward)
    rel = con.execute(ORACLES[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(got.columns)
    want = [dict(zip(names, r, strict=True)) for r in rel.fetchall()]
    assert sorted(str(sorted(r.items())) for r in want) == sorted(str(sorted(r.asDict().items())) for r in got.collect())
