"""The pipeline against its stages done plainly in Python, one after the other."""

import corpus_pipeline
import pytest
from fixtures import documents, small, write_tables
from sievetext.llm import decontaminate, packing, pii
from test_decontaminate import brute as brute_hits
from test_packing import check_pieces
from test_quality import plain_verdicts
from test_simhash import brute_components, brute_print


def plain(docs, items):
    """Text by id of what the first four stages leave of ``(id, text, host)``."""
    verdicts = plain_verdicts(docs)
    kept = [(i, t) for i, t, _ in docs if verdicts[i]]
    prints = [(i, brute_print(t)) for i, t in kept]
    first = set(brute_components(prints))
    automaton = decontaminate.ItemAutomaton([(str(n), t) for n, t in items])
    out = {}
    for i, text in kept:
        if i not in first:
            continue
        n, hit, _ = brute_hits(text, items)
        if hit <= 0.5 * n:
            text = decontaminate.cut_words(text, automaton.scan(text)[2])
            out[i] = pii.redact_text(text, pii.find_spans(text))
    return out


def test_run_equals_plain_stages(spark):
    docs = [(r.doc_id, r.text, r.source) for r in small(spark).collect()]
    items = [(r.item_id, r.text) for r in small(spark, "benchmark").collect()]
    want = plain(docs, items)
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    check_pieces(rows, want, packing.WINDOW)
    assert 0 < len(want) < len(docs)


PROSE = [" ".join(f"topic{k} word{i * k % 97} tail{i}" for i in range(60)) for k in range(1, 9)]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    leak = " ".join(f"exam{i}" for i in range(14))
    rows = [(k, t, "en", "h") for k, t in enumerate(PROSE)]
    rows += [(100, PROSE[0], "en", "h"), (101, PROSE[1].upper(), "en", "h"), (102, "too short", "en", "h"),
             (103, f"{PROSE[2]} {leak} end here " + " ".join(f"more{i}" for i in range(60)), "en", "h"),
             (104, "spam spam spam " * 40, "en", "h"),
             (105, PROSE[3][::-1] + " mail bob@site.example.org now", "en", "h"), (106, None, "en", "h")]
    folder = tmp_path_factory.mktemp("planted") / "t"
    return write_tables(spark, folder, rows, bench=[(1, leak)])


def test_each_stage_on_its_own_input(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality rules", "simhash near-dedup", "benchmark decontamination", "pii", "packing"]

    def run(name):
        return {r.doc_id: r.text for r in stage[name](spark, docs, planted).collect()}

    assert set(range(8)) | {100, 101, 103, 105} == set(run("quality rules"))
    kept = set(run("simhash near-dedup"))
    assert {0, 1} <= kept and not kept & {100, 101}
    clean = run("benchmark decontamination")
    assert len(clean) == 15 and "exam" not in clean[103] and "end here" in clean[103] and clean[0] == PROSE[0]
    hidden = run("pii")
    assert "<EMAIL>" in hidden[105] and "bob" not in hidden[105] and hidden[1] == PROSE[1] and hidden[106] is None


def test_documents_without_columns_of_their_own_names(spark):
    docs = documents(spark, [(1, PROSE[0], "en", "h")], extra=True)
    for _, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 1
