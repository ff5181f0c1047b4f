"""Merkle manifest of a table: per-row digests, a hash tree per group, proofs.

Every row is a leaf, the SHA-256 of its fields; the leaves of a group, in order,
are hashed in runs of eight until one digest is left (the group's subroot), and
the subroots, in order of their groups, likewise up to the root of the table.

The tree is kept as a content-addressed store of digest-to-children records,
each digest once.  A proof is read back by descent: from the root, the base-8
digits of a leaf's rank choose the child to follow, the other children are
collected, and the segments are reversed at the end, so they lead from the leaf
up.  Leaves of one run share their whole path, so the descent carries one row
per run and meets the leaves at the bottom only.

Texts are hashed where they lie; what moves are digests.  A run has eight
children at most, whatever the size of its group, and the store is joined on
digests, so no group is held by one task.

Defined cases: a null field counts as ``-`` and differs from the empty text; a
null group is a group of its own, before all others; leaves ascend by id (null
first), rows of one id by their digest, so repeated rows are leaves of their
own; a group of one leaf has it as subroot, a table of one group its subroot as
root; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import with_ordinal
from ..session import materialize
from .common import LOWER, UPPER, crc_mod, crc_sql

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node; ``DIGIT`` bits of the rank choose one.
FANOUT = 8
DIGIT = 3


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 (hex) of the fields: ``-`` if null, else byte count, ``:``, value."""
    parts = []
    for c in fields:
        value = c.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def _digest(children: Column) -> Column:
    return F.sha2(F.array_join(children, ""), 256)


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _height(n: Column, most: int) -> Column:
    """:func:`height` as a column, up to ``most``."""
    level = F.lit(0)
    for k in range(most):
        level = level + (n > FANOUT ** k).cast("int")
    return level


def _grow(nodes: DataFrame, largest: int) -> tuple[DataFrame | None, DataFrame]:
    """From leaves ``(tree, idx, digest, n)`` of trees of ``n`` leaves each, at
    most ``largest``: the records ``(digest, children)`` and the roots ``(tree,
    digest)``.  A level is one aggregate on (tree, run); finished trees wait."""
    records, roots, now = None, None, nodes
    for _ in range(height(largest)):
        done = now.where("n = 1").select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        now = materialize(
            now.where("n > 1")
            .groupBy("tree", F.shiftright("idx", DIGIT).alias("idx"))
            .agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"), F.max("n").alias("n"))
            .select("tree", "idx", F.col("run.digest").alias("children"), _digest(F.col("run.digest")).alias("digest"),
                    F.ceil(F.col("n") / FANOUT).alias("n")), "merkle-level")
        found = now.select("digest", "children")
        records = found if records is None else records.unionByName(found)
    done = now.where("n = 1").select("tree", "digest")
    return records, done if roots is None else roots.unionByName(done)


@dataclass
class Manifest:
    """``leaves``: ``tree``, ``idx`` (rank), ``digest``, ``n`` and the carried
    columns; ``groups``: ``tree``, ``rank``, ``subroot``, ``n``; ``records``:
    ``digest``, ``children`` (None where no node has children); the root."""

    leaves: DataFrame
    groups: DataFrame
    records: DataFrame | None
    root: str | None
    n_groups: int
    largest: int


def build(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields=FIELDS,
          carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``; ``carry`` adds columns of a row to its leaf."""
    named = {c: F.col(c) for c in fields}
    plain = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("tree"),
        F.col(id_col).alias("id"), leaf_digest(*named.values()).alias("digest"),
        *[c.alias(k) for k, c in (carry or {}).items()],
    ).withColumn("row", F.monotonically_increasing_id())  # splits ranges of equal rows
    ordered = materialize(with_ordinal(plain, ["tree", "id", "digest", "row"]).drop("row"), "leaves")
    sizes = materialize(ordered.groupBy("tree").agg(F.min("pos").alias("first"), F.count("*").alias("n")), "groups")
    leaves = ordered.join(sizes, "tree").withColumn("idx", F.col("pos") - F.col("first")).drop("pos", "first")
    top = sizes.agg(F.count("*").alias("groups"), F.max("n").alias("largest")).first()
    n_groups, largest = int(top["groups"]), int(top["largest"] or 0)
    records, subroots = _grow(leaves.select("tree", "idx", "digest", "n"), largest)
    ranked = materialize(with_ordinal(subroots.join(sizes.drop("first"), "tree"), ["tree"], name="rank"), "subroots")
    above, roots = _grow(ranked.select(F.lit("").alias("tree"), F.col("rank").alias("idx"), "digest",
                                       F.lit(n_groups).cast("long").alias("n")), n_groups)
    root = roots.first()
    if above is not None:
        records = above if records is None else records.unionByName(above)
    if records is not None:
        records = materialize(records.dropDuplicates(["digest"]), "records")
    return Manifest(leaves, ranked.withColumnRenamed("digest", "subroot"), records,
                    root["digest"] if root else None, n_groups, largest)


def _step(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """Every node of the frontier gives way to its children; the path of each
    gains the joined digests before and after it."""
    kept = [c for c in frontier.columns if c not in ("digest", "idx", "path")]
    children = frontier.join(records, "digest").select(
        *kept, "idx", "path", "children", F.posexplode("children").alias("at", "child"))
    return children.select(
        *kept, (F.col("idx") * FANOUT + F.col("at")).alias("idx"), F.col("child").alias("digest"),
        F.concat("path", F.array(_segment(F.col("children"), F.col("at")))).alias("path"))


def _segment(children: Column, at: Column) -> Column:
    return F.struct(F.array_join(F.slice(children, F.lit(1), at), "").alias("before"),
                    F.array_join(F.slice(children, at + 2, F.lit(FANOUT)), "").alias("after"))


def _requested(frontier: DataFrame, requests: DataFrame | None, level: Column, most: int) -> DataFrame:
    """Nodes at ``level`` (up to ``most``) above the leaves that lead to a requested leaf."""
    if requests is None:
        return frontier
    at = frontier.withColumn("_level", level)
    levels = F.explode(F.sequence(F.lit(0), F.lit(most)))
    wanted = requests.select("tree", "idx", levels.alias("_level")).select(
        "tree", "_level", F.call_function("shiftright", F.col("idx"), F.col("_level") * DIGIT).alias("idx")).distinct()
    return at.join(wanted, ["tree", "_level", "idx"], "left_semi").select(*frontier.columns)


def descend(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """``manifest.leaves`` (of the requested ``(tree, idx)`` only, where given)
    plus ``subroot`` and ``path``: the segments ``(before, after)`` of siblings,
    leaf first."""
    spark = manifest.leaves.sparkSession
    path = "array<struct<before:string,after:string>>"
    frontier = spark.createDataFrame([(0, manifest.root or "", [])], f"idx bigint, digest string, path {path}")
    for _ in range(height(manifest.n_groups)):
        frontier = _step(frontier, manifest.records)
    most = height(manifest.largest)
    frontier = manifest.groups.join(
        frontier.select(F.col("idx").alias("rank"), "path"), "rank").select(
        "tree", "subroot", _height(F.col("n"), most).alias("height"), F.lit(0).cast("long").alias("idx"),
        F.col("subroot").alias("digest"), "path")
    bottom = None
    for k in range(max(1, most)):
        # Nodes of this round are k levels below their subroots.
        frontier = materialize(_requested(frontier, requests, F.col("height") - k, most), "frontier")
        last = frontier.where(F.col("height") <= k + 1)
        bottom = last if bottom is None else bottom.unionByName(last)
        if k + 1 < most:
            frontier = _step(frontier.where(F.col("height") > k + 1), manifest.records)
    if manifest.records is None:
        runs = bottom.withColumn("children", F.lit(None).cast("array<string>"))
    else:
        runs = bottom.join(manifest.records, "digest", "left")
    # A group of one leaf has no run; its subroot may be another's record.
    runs = runs.select("tree", F.col("idx").alias("_run"), "subroot", F.col("path").alias("_path"),
                       F.when(F.col("height") > 0, F.col("children")).alias("_children"))
    leaves = manifest.leaves if requests is None else manifest.leaves.join(
        requests.select("tree", "idx").distinct(), ["tree", "idx"], "left_semi")
    met = leaves.withColumn("_run", F.shiftright("idx", DIGIT)).join(runs, ["tree", "_run"])
    own = F.array(_segment(F.col("_children"), F.pmod("idx", F.lit(FANOUT)).cast("int")))
    down = F.when(F.col("_children").isNull(), F.col("_path")).otherwise(F.concat("_path", own))
    return met.select(*leaves.columns, "subroot", F.reverse(down).alias("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf digest and the siblings of its path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, leaf first, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The rows of the registered query."""
    changed = [lower_ascii(F.col("text")) if c == "text" else F.col(c) for c in FIELDS]
    tampered = F.when(crc_mod("doc_id", 3) == 0, leaf_digest(*changed))
    manifest = build(docs.select(*FIELDS), carry={"tampered": tampered})
    root = F.lit(manifest.root).cast("string")
    return (descend(manifest)
            .withColumn("folded_root", fold(F.coalesce("tampered", "digest"), F.col("path")))
            .select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", root.alias("root"),
                    proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == root).alias("verified")))


def _sql() -> str:
    def field(c, v):
        return f"case when {c} is null then '-' else strlen(cast({v} as varchar)) || ':' || cast({v} as varchar) end"

    def hashed(text):
        return "sha256(" + " || ".join(field(c, text if c == "text" else c) for c in FIELDS) + ")"

    def levels(name, n):
        return "".join(f"""
{name}{k + 1} as (
  select g, r // 8 as r, case when max(n) = 1 then max(h) else sha256(string_agg(h, '' order by r)) end as h,
    (max(n) + 7) // 8 as n from {name}{k} group by g, r // 8),
{name}run{k} as (select g, r // 8 as p, list(h order by r) as c from {name}{k} where n > 1 group by g, r // 8),"""
                       for k in range(n))

    def climb(name, k, old, g, r):
        pos = f"({r} // {8 ** k}) % 8"
        before, after = f"array_to_string(c[1:{pos}], '')", f"array_to_string(c[{pos} + 2:], '')"
        return f"""
{name}path{k} as (
  select o.* exclude (h, proof), case when c is null then o.h else sha256({before} || o.h || {after}) end as h,
    proof || case when c is null then '' else {before} || {after} end as proof
  from {old} o left join {name}run{k} x on x.g = {g} and x.p = {r} // {8 ** (k + 1)}),"""

    low, high = 7, 3
    climbs, old = "", "start"
    for k in range(low):
        climbs, old = climbs + climb("t", k, old, "o.g", "o.r"), f"tpath{k}"
    climbs += f"\nmiddle as (select o.*, s0.r as gr from {old} o join s0 using (sg)),"
    old = "middle"
    for k in range(high):
        climbs, old = climbs + climb("s", k, old, "''", "o.gr"), f"spath{k}"
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    return f"""
with d as (
  select doc_id, coalesce('=' || lang, '') as g, {hashed('text')} as leaf, {hashed(lowered)} as tampered,
    {crc_sql('doc_id')} as crc from documents),
t as (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as r,
    count(*) over (partition by g) as n from d),
t0 as (select g, r, leaf as h, n from t),{levels('t', low)}
s0 as (select g as sg, '' as g, row_number() over (order by g) - 1 as r, h, count(*) over () as n from t{low}),
{levels('s', high)}
start as (
  select doc_id, g, g as sg, r, leaf, case when crc % 3 = 0 then tampered else leaf end as h, '' as proof from t),{climbs}
done as (select {old}.*, t{low}.h as subroot, s{high}.h as root from {old} join t{low} on t{low}.g = {old}.sg, s{high})
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, h as folded_root, h = root as verified from done
"""


ORACLE_SQL = _sql()
