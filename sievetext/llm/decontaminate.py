"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every word sequence of the benchmark items.  A document is
streamed through it word by word; the state keeps the longest suffix of the
words read that occurs in an item.  A match of ``window`` words or more marks
those words; an item of fewer words marks its whole occurrences.

The benchmark is split by a hash into blocks of about ``block_chars`` characters
(a million make about 95 MB of automaton; a longer item is a block's worth by
itself).  One block is one row-local pass.  Several are passes one after the
other over documents written once with a row number: each collects, builds and
broadcasts its block, writes the matches of the rows that have some, and
releases the automaton, so the driver and a worker hold one block at a time.
The matches join by row number at the end; texts are never shuffled.

Defined cases: null and empty texts have no words; items without words mark
nothing; an item without id marks words but is not listed; repeated items are
listed once per id; an empty benchmark marks nothing.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import BLOCK_CHARS, free_name, give_back, small_batches, without

WINDOW = 10
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
# ASCII bytes that are neither digits nor lower-case letters separate words.
_SEPARATE = bytes(b if b >= 128 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32
                  for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Normalised words (UTF-8, A-Z lowered) of a text."""
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").lower().translate(_SEPARATE).split()


class ItemAutomaton:
    """Generalised suffix automaton over the words of test items, with the
    items of every ``window``-word sequence and of every shorter item."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.edges: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = []
        for name, text in items:
            seq = [self.ids.setdefault(w, len(self.ids)) for w in words(text)]
            if seq:
                coded.append((name, seq))
                last = 0
                for c in seq:
                    last = self._append(last, c)
        self._annotate(coded)

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.edges.append(edges)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of ``q`` that ends the shorter strings reached from ``p``."""
        copy = self._state(self.length[p] + 1, dict(self.edges[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.edges[p].get(c) == q:
            self.edges[p][c] = copy
            p = self.link[p]
        return copy

    def _append(self, last: int, c: int) -> int:
        known = self.edges[last].get(c)
        if known is not None:
            fits = self.length[known] == self.length[last] + 1
            return known if fits else self._split(last, c, known)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.edges[p]:
            self.edges[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.edges[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _holder(self, state: int, n: int) -> int:
        """The state that ends the last ``n`` words of what ``state`` ends."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _annotate(self, coded):
        window = self.window
        seen: dict[int, dict] = {}
        short: dict[int, dict] = {}
        for name, seq in coded:
            state = 0
            for i, c in enumerate(seq):
                state = self.edges[state][c]
                if i + 1 >= window:
                    seen.setdefault(self._holder(state, window), {})[name] = None
            if len(seq) < window:
                short.setdefault(self._holder(state, len(seq)), {})[(len(seq), name)] = None
        n = len(self.length)
        # State that ends the last `window` words, and its items, by state.
        self.at_window: list[tuple | None] = [None] * n
        # Short items that end wherever a state does, inherited along links.
        self.at_short: list[tuple] = [()] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= window:
                self.at_window[s] = (tuple(seen.get(s, ())) if self.length[up] < window
                                     else self.at_window[up])
            own = tuple(short.get(s, ()))
            self.at_short[s] = self.at_short[up] + own if own else self.at_short[up]

    def scan(self, text: str | None) -> tuple[int, int, list[tuple[int, int]], list[str]]:
        """Number of words, longest match, merged hit spans as word positions
        (end exclusive), and the ids of the items with occurring windows."""
        seq = words(text)
        known = self.ids.get
        edges, link, length, window = self.edges, self.link, self.length, self.window
        at_window, at_short = self.at_window, self.at_short
        state = run = longest = 0
        marks: list[tuple[int, int]] = []
        items: dict[str, None] = {}
        for i, c in enumerate(map(known, seq)):
            if c is None:
                state = run = 0
                continue
            to = edges[state].get(c)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = edges[state].get(c)
            if to is None:
                continue
            state = to
            run += 1
            if run > longest:
                longest = run
            if run >= window:
                marks.append((i + 1 - window, i + 1))
                items.update(dict.fromkeys(at_window[state]))
            for n, name in at_short[state]:
                if n <= run:
                    marks.append((i + 1 - n, i + 1))
                    items[name] = None
        items.pop(None, None)
        return len(seq), longest, merge_spans(marks), sorted(items)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, ascending; touching spans become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_RESULT = pa.struct([
    ("n_words", pa.int64()), ("longest", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("items", pa.list_(pa.string())), ("cleaned", pa.string())])
_RESULT_DDL = ("struct<n_words:bigint,longest:bigint,spans:array<struct<start:bigint,end:bigint>>,"
               "items:array<string>,cleaned:string>")


def _scan_udf(shared, cut: bool):
    """Matches with one automaton; with ``cut`` also the text less its hit words
    (null where there are none)."""
    @F.arrow_udf(_RESULT_DDL)
    def scan(texts: pa.Array) -> pa.Array:
        automaton = shared.value
        rows = []
        for t in texts:
            text = t.as_py()
            n, longest, spans, items = automaton.scan(text)
            rows.append({"n_words": n, "longest": longest, "items": items,
                         "spans": [{"start": a, "end": b} for a, b in spans],
                         "cleaned": cut_words(text, spans) if cut and spans else None})
        done = pa.array(rows, type=_RESULT)
        del rows
        give_back()
        return done

    return scan


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                block_chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """The benchmark as ``(name, body)`` in hash blocks of about ``block_chars`` characters."""
    items = benchmark.select(F.col(id_col).cast("string").alias("name"),
                             F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    chars = items.agg(F.sum(F.length("body")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-int(chars) // block_chars))
    block = F.pmod(F.xxhash64("name", "body"), F.lit(n_blocks))
    return [items.where(block == k) for k in range(n_blocks)]


def _shared(items: DataFrame, window: int):
    """The automaton of a block as a broadcast; the driver keeps no other copy."""
    return items.sparkSession.sparkContext.broadcast(
        ItemAutomaton([(r["name"], r["body"]) for r in items.collect()], window))


def _covered(spans: Column) -> Column:
    """Length of the union of the spans of one document."""
    step = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"),
                                   s["end"] - F.greatest(s["start"], acc["upto"]))).alias("n"),
            F.greatest(acc["upto"], s["end"]).alias("upto")))
    return step["n"]


def with_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                       output: str = "contamination", window: int = WINDOW,
                       block_chars: int = BLOCK_CHARS, cut: bool = False) -> DataFrame:
    """``docs`` plus ``output``: struct of ``n_words``, ``n_hit``, ``longest``,
    ``spans`` (hit words, as word positions), ``items`` (ids as strings) and,
    with ``cut``, ``cleaned`` (the text less its hit words where it has some).

    One block cuts in the pass that finds the words; several blocks cut in a
    pass of their own, once the spans of all are known."""
    blocks = item_blocks(benchmark, block_chars=block_chars)
    out = without(small_batches(docs), output)
    text = F.col(text_col).cast("string")
    if len(blocks) == 1:
        found = free_name(out, "block0")
        out = out.withColumn(found, _scan_udf(_shared(blocks[0], window), cut)(text))
        spans, own = F.col(f"{found}.spans"), [F.col(f"{found}.cleaned").alias("cleaned")] if cut else []
        more, drop = [F.col(f"{found}.{c}") for c in ("n_words", "longest", "items")], [found]
    else:
        row, matches, n_words = (free_name(out, n) for n in ("row_number", "matches", "n_words"))
        out = materialize(out.withColumn(row, F.monotonically_increasing_id()), "numbered")
        per_block = None
        for k, items in enumerate(blocks):
            shared = _shared(items, window)
            each = out.select(row, _scan_udf(shared, False)(text).alias("m")).select(
                row, *[F.col(f"m.{c}").alias(c) for c in ("n_words", "longest", "spans", "items")])
            # The first pass also counts the words of every row.
            each = materialize(each if k == 0 else each.where("longest > 0"), "matches")
            shared.destroy()
            per_block = each if per_block is None else per_block.unionByName(each)
        met = per_block.groupBy(row).agg(
            F.max("n_words").alias("n_words"), F.max("longest").alias("longest"),
            F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        out = out.join(met.select(row, F.struct("longest", "spans", "items").alias(matches),
                                  F.col("n_words").alias(n_words)), row)
        spans = F.col(f"{matches}.spans")
        own = [F.when(F.size(spans) > 0, _cut_udf()(text, spans)).alias("cleaned")] if cut else []
        more, drop = [F.col(n_words), F.col(f"{matches}.longest"), F.col(f"{matches}.items")], [row, matches, n_words]
    return out.withColumn(output, F.struct(
        *own, more[0].alias("n_words"), _covered(spans).alias("n_hit"), more[1].alias("longest"),
        F.array_sort(spans).alias("spans"), F.sort_array(F.array_distinct(more[2])).alias("items"))).drop(*drop)


def _cut_udf():
    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([cut_words(t.as_py(), [(s["start"], s["end"]) for s in (p.as_py() or ())])
                         for t, p in zip(texts, spans, strict=True)], pa.string())

    return cut


def cut_words(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` less the words at the spans (word positions, end exclusive) and
    what stands between them; what is left is joined with a blank."""
    if not text or not spans:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    out, done = [], 0
    for a, b in merge_spans(spans):
        out.append(text[done:at[a][0]].rstrip())
        done = at[b - 1][1]
    out.append(text[done:].lstrip())
    return " ".join(p for p in out if p)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                         max_coverage: float = 0.5, window: int = WINDOW,
                         length_col: str | None = "n_chars",
                         block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Drop documents whose hit words exceed ``max_coverage`` of their words;
    cut the hit words out of the others.  Clean documents stay as they are;
    columns and their order stay."""
    state = free_name(docs, "contamination")
    new = free_name(docs, "cleaned")
    found = with_contamination(docs, benchmark, text_col, state, window, block_chars, cut=True)
    kept = found.where(F.col(f"{state}.n_hit") <= F.lit(max_coverage) * F.col(f"{state}.n_words"))
    out = kept.withColumn(new, F.when(F.col(f"{state}.n_hit") > 0, F.col(f"{state}.cleaned"))
                          .otherwise(F.col(text_col).cast("string")))
    length = F.length(F.col(new)).cast("long")
    return out.select(*[
        F.col(new).alias(c) if c == text_col
        else F.when(F.col(c).isNull() | (F.col(f"{state}.n_hit") == 0), F.col(c)).otherwise(length).alias(c)
        if c == length_col else F.col(c) for c in docs.columns])


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts and item digests per document: the rows of the registered query."""
    found = with_contamination(docs.select("doc_id", "text"), benchmark, output="c")
    return found.select(
        "doc_id", F.col("c.n_words").alias("n_words"), F.col("c.n_hit").alias("n_hit"),
        F.size("c.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("c.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("c.n_hit") > 0).alias("contaminated"))


_SQL_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
ORACLE_SQL = f"""
with d as (select row_number() over () as k, doc_id, {_SQL_WORDS} as w from documents),
b as (select item_id, {_SQL_WORDS} as w from benchmark),
item as (select item_id, w, least({WINDOW}, len(w)) as n from b where len(w) > 0),
item_window as (
  select distinct item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as gram
  from (select *, unnest(range(1, len(w) - n + 2)) as i from item)),
sizes as (select distinct n from item_window),
doc_window as (
  select k, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as gram
  from (select k, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hit as (select k, i, n, item_id from doc_window join item_window using (n, gram)),
hit_words as (select k, count(distinct p) as n_hit
              from (select distinct k, unnest(range(i, i + n)) as p from hit) group by k),
hit_items as (select k, count(*) as n_items, string_agg(v, ',' order by v) as names
              from (select distinct k, cast(item_id as varchar) as v from hit where item_id is not null) group by k)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (k) left join hit_items using (k)
"""
