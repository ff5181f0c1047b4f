import hashlib
import zlib

import pytest
from fixtures import documents, small
from pyspark.sql import functions as F
from sievetext.llm import merkle

UP = str.maketrans(merkle.UPPER, merkle.LOWER)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """Levels from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha(*now[i:i + 8]) for i in range(0, len(now), 8)])
    return levels


def siblings(levels, i):
    for now in levels[:-1]:
        first = i - i % 8
        yield now[first:i], now[i + 1:first + 8]
        i //= 8


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda v: v[:3])
        trees.append(tree([v[2] for v in groups[g]]))
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, own, r) in enumerate(groups[g]):
            key = "" if r.doc_id is None else str(r.doc_id)
            text = r.text if zlib.crc32(key.encode()) % 3 or r.text is None else r.text.translate(UP)
            now, proof = leaf(r, text), []
            for before, after in [*siblings(trees[k], i), *siblings(top, k)]:
                now = sha(*before, now, *after)
                proof += before + after
            root = top[-1][0]
            out.append((r.doc_id, own, trees[k][-1][0], root, sha(*proof), now, now == root))
    return sorted(out, key=str)


def check(docs):
    got = sorted((tuple(r) for r in merkle.manifest_digest(docs).collect()), key=str)
    assert got == brute(docs.collect())
    return got


def test_documents(spark):
    got = check(small(spark))
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_awkward_rows(spark):
    check(documents(spark, extra=True))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_sizes_of_one_group(spark, n):
    check(documents(spark, [(k * 7 % n, f"Text {k}", "en", "h") for k in range(n)]))


def test_many_groups_of_uneven_height(spark):
    rows = [(k, f"T{k}", f"lang{k % 70}" if k % 70 else None, "h") for k in range(400)]
    rows += [(k, f"U{k}", "big", "h") for k in range(600)] + [(5, "same", "one", "h")]
    check(documents(spark, rows))


def test_repeated_rows_share_records(spark):
    rows = [(1, "same", "en", "h")] * 700 + [(2, "Other", "en", None)]
    check(documents(spark, rows))
    manifest = merkle.build(documents(spark, rows))
    assert manifest.records.count() == manifest.records.select("digest").distinct().count() < 40


def test_requested_leaves_only(spark):
    docs = small(spark)
    manifest = merkle.build(docs)
    wanted = manifest.leaves.where("id % 40 = 3").select("tree", "idx")
    folded = merkle.fold(F.col("digest"), F.col("path"))
    got = merkle.descend(manifest, wanted).withColumn("root", folded).collect()
    assert sorted(r.id for r in got) == [k for k in range(200) if k % 40 == 3]
    assert {r.root for r in got} == {manifest.root}


def test_a_changed_sibling_changes_the_root(spark):
    docs = documents(spark, [(k, f"t{k}", "en", "h") for k in range(30)])
    other = documents(spark, [(k, "changed" if k == 17 else f"t{k}", "en", "h") for k in range(30)])
    assert merkle.build(docs).root != merkle.build(other).root
    assert merkle.build(docs).root == merkle.build(docs.repartition(7)).root


def test_height():
    assert [merkle.height(n) for n in (0, 1, 2, 8, 9, 64, 65, 512, 513)] == [0, 0, 1, 1, 2, 2, 3, 3, 4]
