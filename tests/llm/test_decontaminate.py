import weakref
import hashlib
import re

from fixtures import BENCH, ROWS, small
from hypothesis import given, settings
from hypothesis import strategies as st
from sievetext.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def brute(text, items, window=10):
    """Words, hit words and items by comparing every window at every place."""
    doc, hit, names = split(text), set(), set()
    places = {}
    for n in range(1, window + 1):
        for i in range(len(doc) - n + 1):
            places.setdefault(tuple(doc[i:i + n]), []).append(i)
    for name, body in items:
        w = split(body)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            for i in places.get(tuple(w[j:j + n]), ()):
                hit.update(range(i, i + n))
                names.add(name)
    return len(doc), len(hit), sorted(str(n) for n in names if n is not None)


def check(text, items, window):
    a = dc.ItemAutomaton([(None if n is None else str(n), t) for n, t in items], window)
    n, _, spans, names = a.scan(text)
    assert (n, sum(b - s for s, b in spans), names) == brute(text, items, window)


WORDS = st.lists(st.sampled_from(["a", "b", "c"]), max_size=14).map(" ".join)


@settings(max_examples=400, deadline=None)
@given(WORDS, st.lists(WORDS, max_size=5), st.integers(2, 5))
def test_automaton_against_all_windows(text, items, window):
    check(text, list(enumerate(items)), window)


def test_documents_against_all_windows(spark):
    items = [(r.item_id, r.text) for r in small(spark, "benchmark").collect()]
    bodies = [r.text for r in small(spark).collect()]
    got = {r.doc_id: r for r in dc.contamination_digest(small(spark), small(spark, "benchmark")).collect()}
    hits = 0
    for r, text in zip(small(spark).collect(), bodies, strict=True):
        n, hit, names = brute(text, items)
        g = got[r.doc_id]
        assert (g.n_words, g.n_hit, g.n_items, g.contaminated) == (n, hit, len(names), hit > 0)
        assert g.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        hits += hit > 0
    assert hits


def test_awkward_rows_and_blocks(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    bench = spark.read.parquet(f"{awkward}/benchmark.parquet")
    whole = {r.doc_id: r.c for r in dc.with_contamination(docs, bench, output="c").collect()}
    parts = {r.doc_id: r.c for r in dc.with_contamination(docs, bench, output="c", block_chars=30).collect()}
    assert len(dc.item_blocks(bench, block_chars=30)) > 1
    for i, text, *_ in ROWS:
        want = brute(text, BENCH)
        for c in (whole[i], parts[i]):
            assert (c.n_words, c.n_hit, c["items"]) == want


def test_removal(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    bench = spark.createDataFrame([(1, "wind weht über")], "item_id long, text string")
    got = {r.doc_id: r for r in dc.remove_contamination(docs, bench).collect()}
    assert got[8].text.startswith("Die Tür ist offen und der das Feld") and got[8].n_chars == len(got[8].text)
    assert got[1].text == ROWS[0][1] and got[3].text is None
    full = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert 10 not in {r.doc_id for r in dc.remove_contamination(docs, full).collect()}


def test_cut_words():
    assert dc.cut_words("A b, c d. E", [(1, 3)]) == "A d. E"
    assert dc.cut_words("A b", [(0, 2)]) == ""


def test_one_block_and_many_blocks_cut_alike(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = ({r.doc_id: (r.text, r.n_chars) for r in dc.remove_contamination(docs, bench, block_chars=n).collect()}
                 for n in (dc.BLOCK_CHARS, 4000))
    assert one == many
    before = {r.doc_id: r.text for r in docs.collect()}
    assert any(t != before[d] for d, (t, _) in one.items())
    dirty = {r.doc_id for r in dc.contamination_digest(docs, bench).where("contaminated").collect()}
    assert all(one[d][0] == t for d, t in before.items() if d not in dirty)
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    left = dc.ItemAutomaton(items)
    assert sum(bool(left.scan(t)[2]) for t, _ in one.values()) <= 1  # a cut may join new neighbours


def test_one_automaton_at_a_time(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = {r.doc_id: r.c for r in dc.with_contamination(docs.select("doc_id", "text"), bench, output="c").collect()}
    alive, most, drops, build = [0], [0], [], dc.ItemAutomaton.__init__

    def gone():
        alive[0] -= 1

    def counted(self, *args):
        build(self, *args)
        alive[0] += 1
        most[0] = max(most[0], alive[0])
        weakref.finalize(self, gone)

    shared = dc._shared

    def held(items, window):
        assert all(b.destroyed for b in drops)
        b = shared(items, window)
        drop = b.destroy
        b.destroyed = False

        def destroy():
            b.destroyed = True
            drop()

        b.destroy = destroy
        drops.append(b)
        return b

    monkeypatch.setattr(dc.ItemAutomaton, "__init__", counted)
    monkeypatch.setattr(dc, "_shared", held)
    many = dc.with_contamination(docs.select("doc_id", "text"), bench, output="c", block_chars=2000)
    assert len(drops) > 3 and all(b.destroyed for b in drops) and most[0] == 1
    assert {r.doc_id: r.c for r in many.collect()} == want
