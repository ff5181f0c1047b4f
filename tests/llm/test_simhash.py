import random

import xxhash
from fixtures import ROWS, small
from sievetext.llm import simhash
from sievetext.llm.graph import components


def brute_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_components(prints):
    """Least id reachable over links of at most three bits, by comparing all pairs."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [least.get(root(i)) for i in range(len(prints))]


def test_quadruples_cover_every_damage():
    from itertools import combinations
    assert len(simhash.QUADS) == 14
    assert all(any(not set(q) & set(d) for q in simhash.QUADS) for d in combinations(range(8), 3))


def test_documents_against_all_pairs(spark):
    rows = [(r.doc_id, brute_print(r.text)) for r in small(spark).collect()]
    want = {d: (f"{p:016x}", c) for (d, p), c in zip(rows, brute_components(rows), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id)
           for r in simhash.near_duplicate_digest(small(spark)).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_awkward_rows(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    rows = [(i, brute_print(t)) for i, t, *_ in ROWS]
    want = sorted(((d, f"{p:016x}", c) for (d, p), c in zip(rows, brute_components(rows), strict=True)), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicate_digest(docs).collect()), key=str) == want
    kept = simhash.keep_one(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(c) for c in {c for *_, c in want})


def _cluster(seed, n, flips, centers=3):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(centers)]
    out = {rng.getrandbits(64) for _ in range(20)}
    while len(out) < n:
        v = rng.choice(base)
        for _ in range(rng.randrange(flips + 1)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return sorted(out)


def _linked(spark, values, **kw):
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), **kw)
    for a, b in edges.collect():
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
    roots = {r.node: r.root for r in components(edges).collect()}
    groups = {}
    for v, (s,) in zip(values, signed, strict=True):
        groups.setdefault(roots.get(s, s), set()).add(v)
    return {frozenset(g) for g in groups.values()}


def test_links_of_dense_clusters(spark):
    """Short postings are paired, over-long ones linked through neighbourhoods:
    the same components, whatever the limit."""
    values = _cluster(1, 160, 3)
    ids = list(enumerate(values))
    groups = {}
    for (_, v), c in zip(ids, brute_components(ids), strict=True):
        groups.setdefault(c, set()).add(v)
    want = {frozenset(g) for g in groups.values()}
    for limit in (1, 4, 1000):
        assert _linked(spark, values, max_posting=limit) == want


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3), (1, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 140)}}
