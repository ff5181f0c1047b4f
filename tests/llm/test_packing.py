import random
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import ROWS, small
from sievetext.llm import matrices, packing
from sievetext.session import scratch_path


def sequential(lengths, window):
    """Best-fit decreasing, one piece after the other."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            best = min(fit, key=lambda i: rooms[i])
            rooms[best] -= n
        else:
            rooms.append(window - n)
    return Counter(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_sequential_best_fit(seed):
    rng = random.Random(seed)
    window = rng.choice([7, 16, 50, 64])
    lengths = [rng.randint(1, window) for _ in range(rng.randint(1, 400))]
    counts = Counter(lengths)
    used, ranks = {}, Counter()
    for length, first, n, start, offset in packing.plan_windows(counts, window):
        assert first == ranks[length]
        ranks[length] += n
        for w in range(start, start + n):
            assert used.get(w, 0) == offset  # gapless, in order
            used[w] = offset + length
    assert ranks == counts and max(used.values()) <= window
    assert sorted(used) == list(range(len(used)))
    assert Counter(window - u for u in used.values()) == sequential(lengths, window)


def test_room_tree():
    tree = packing.RoomTree(10)
    for c in (3, 7, 10):
        tree.set(c, True)
    assert [tree.tightest(n) for n in (1, 3, 4, 7, 8, 10)] == [3, 3, 7, 7, 10, 10]
    tree.set(10, False)
    assert tree.tightest(8) is None


def direct(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [packing.END_ID] for x in texts]


def test_encoder_equals_the_tokenizer(spark):
    texts = [r.text for r in small(spark).collect()] + [t for _, t, *_ in ROWS] + [
        "it's   don't we'll Á \x1c x\x85y <|endoftext|> a<|startoftext|>b ́x ΑΣ Σİ"]
    encoder = packing.Encoder(packing.tokenizer_path())
    for text, want in zip(texts, direct(texts), strict=True):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want


def check_pieces(rows, texts, window):
    """Each id lies in one piece; windows are gapless and hold at most ``window``."""
    ids = dict(zip(texts, direct(texts.values()), strict=True))
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_window.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for doc, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[doc])
            at += p.length
            assert p.ids_crc32 == zlib.crc32(np.array(ids[doc][p.start:at], "<u4").tobytes())
        assert at == len(ids[doc])
    assert sorted(by_window) == list(range(len(by_window)))
    for parts in by_window.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return by_window


def test_packed_documents(spark):
    rows = packing.pack_documents(small(spark)).collect()
    windows = check_pieces(rows, {r.doc_id: r.text for r in small(spark).collect()}, packing.WINDOW)
    lengths = [r.length for r in rows]
    assert Counter(packing.WINDOW - sum(p.length for p in w) for w in windows.values()) == sequential(
        lengths, packing.WINDOW)


@pytest.mark.parametrize("max_broadcast", [matrices.MAX_BROADCAST, 0])
def test_matrices_round_trip(spark, max_broadcast):
    docs = small(spark).select("doc_id", "text").repartition(3)
    out = scratch_path(spark, "test-matrices")
    matrices.write_matrices(docs, out, packing.tokenizer_path(), window=512, rows=8, pad_id=9,
                            max_broadcast=max_broadcast)
    written = spark.read.parquet(out)
    for m in written.collect():
        ids = np.frombuffer(m.ids, "<u4").reshape(m.n_rows, 512)
        assert m.n_rows <= 8 and sum(m.row_segments) == len(m.position_resets) == len(m.doc_starts)
        at = 0
        for r, n in enumerate(m.row_segments):
            cu = m.cu_seqlens[at:at + n + 1]
            assert cu[0] == 0 and cu == sorted(cu) and (ids[r, cu[-1]:] == 9).all()
            at += n + 1
    # Segments put back together by their place in a document give its ids.
    got = Counter()
    for r in matrices.read_sequences(written).collect():
        ids = np.frombuffer(r.ids, "<u4")
        for a, b, reset, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.position_resets, r.doc_starts, strict=False):
            assert reset == a
            got[(start, ids[a:b].tobytes())] += 1
    want = Counter()
    for ids in direct([r.text for r in docs.collect()]):
        for start, n in packing.cut(len(ids), 512):
            want[(start, np.array(ids[start:start + n], "<u4").tobytes())] += 1
    assert got == want


def test_documents_are_rebuilt_from_their_own_segments(spark):
    rows = [(r.doc_id, r.text) for r in small(spark).collect()]
    # Long documents of one length, whose windows have the same starts.
    rows += [(10**6 + k, f"word{k} and more of it " * 400) for k in range(5)] + [(None, "a row without an id " * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = scratch_path(spark, "test-rebuilt")
    matrices.write_matrices(docs, out, packing.tokenizer_path(), window=512, rows=8)
    parts = {}
    for r in matrices.read_sequences(spark.read.parquet(out)).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(r.doc_ids) == len(r.doc_starts)
        for a, b, start, doc in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_starts, r.doc_ids, strict=False):
            assert parts.setdefault(doc, {}).setdefault(start, ids[a:b]) is not None
    got = {doc: [v for s in sorted(found) for v in found[s]] for doc, found in parts.items()}
    assert got == dict(zip([i for i, _ in rows], direct([t for _, t in rows]), strict=True))


def test_other_key_columns(spark):
    docs = spark.createDataFrame([("x", 1, "one two"), ("x", 2, "three"), (None, 1, "")],
                                 "start string, length int, body string")
    out = scratch_path(spark, "test-keys")
    matrices.write_matrices(docs, out, packing.tokenizer_path(), text_col="body", window=8, keys=["start", "length"])
    found = matrices.read_sequences(spark.read.parquet(out)).collect()
    assert sorted((str(a), b) for r in found for a, b in zip(r.starts, r.lengths, strict=True)) == [
        ("None", 1), ("x", 1), ("x", 2)]


def test_digest_names_the_documents(spark):
    ids = {r.doc_id for r in small(spark).collect()}
    rows = matrices.matrix_digest(small(spark)).collect()
    assert {int(v) for r in rows for v in r.doc_ids.split(",")} == ids
    assert all(len(r.doc_ids.split(",")) == r.n_segments for r in rows)


def test_windows_wider_than_15_bits(spark):
    docs = spark.createDataFrame([(i, "word " * n) for i, n in enumerate([39_999, 20_000, 60_000, 5, 19_000])],
                                 "doc_id long, text string")
    rows = packing.pack(docs, packing.tokenizer_path(), window=40_000).collect()
    taken = {}
    for r in rows:
        taken.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    for spans in taken.values():  # gapless, and no two pieces in one place
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 40_000
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert sum(r.length for r in rows) == 39_999 + 20_000 + 60_000 + 5 + 19_000 + 5
    with pytest.raises(ValueError, match="windows"):
        packing.pack(docs, packing.tokenizer_path(), window=1 << 23)
