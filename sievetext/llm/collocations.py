"""Phrase collocations per language: frequent phrases of 2 to 5 words, scored by
how much more often they occur than their parts would by chance.

1. Words are counted (partial counts per task), those of at least ``min_count``
   get codes, and every text becomes a row of codes once, with breaks where a
   piece ends or a rarer word stands: no frequent phrase crosses a break.
2. Candidates grow word by word.  A phrase is proposed where a candidate one
   word shorter is followed by a word such that its last words are a candidate
   too (a bit table of hashes, which may only err towards proposing), and stays
   if its tally reaches ``min_count``: every part of a candidate is a candidate.
3. Candidates are compiled into double-array tries (``base``, ``check``).  Numpy
   moves the states of all positions of a row one level down at a time, bin
   counts of the accepting states are summed over the tasks.

Tries and code tables are broadcast in blocks of a fixed number of entries, one
after the other, each released before the next: there are as many passes over
the codes as blocks, and no broadcast grows with the data.  Texts never move;
tallies and counts are combined in the task before they are shuffled.

Words meet as 63-bit hashes while they are coded; two words of one hash, one of
them frequent, are looked for in the word counts and raise an error.

Defined cases: null and empty texts have no words; a null language is ``und``;
repeated rows count each; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import with_ordinal
from ..session import materialize
from .common import lower_sql, small_batches

MAX_WORDS = 5
MIN_COUNT = 100
ABSORB_PERCENT = 100
TOP = 2000
NO_LANGUAGE = "und"
#: Words (24 bytes) and phrases (about 50 bytes) of one broadcast block.
BLOCK_WORDS = 2_000_000
BLOCK_PHRASES = 1_000_000
#: Bits of the table of candidate hashes.
HASH_BITS = 25
#: Entries that a task tallies before it hands them on.
TALLY = 1_000_000
BREAKS = ".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(BREAKS.encode(), b"." * len(BREAKS))


def words(text: bytes) -> list[bytes]:
    """Words of a text in ASCII lower case, with ``.`` where pieces end."""
    return text.lower().translate(_TABLE).replace(b".", b" . ").split()


# --- words and codes ---------------------------------------------------------

def count_words(texts: DataFrame) -> DataFrame:
    """``(lang, word, n)`` of ``(lang, body)``; words stay binary."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def out(seen: dict[str, Counter]) -> pa.RecordBatch:
        rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)],
                                          schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for lang, body in zip(batch["lang"].to_pylist(), batch["body"].to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words(body))
            if sum(map(len, seen.values())) > 300_000:
                yield out(seen)
                seen.clear()
        yield out(seen)

    counted = texts.mapInArrow(run, "lang string, word binary, n bigint").where(F.col("word") != F.lit(b"."))
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_hash() -> Column:
    """63 bits, never 0, as :class:`Codes` computes them."""
    return F.greatest(F.shiftrightunsigned(F.xxhash64("lang", "word"), 1), F.lit(1))


def vocabulary(counted: DataFrame, min_count: int) -> DataFrame:
    """``(code, lang, word, n, h)`` of the frequent words, codes from 1 by falling
    count.  A word that shares its hash with a frequent one is an error."""
    hashed = counted.withColumn("h", word_hash())
    twice = hashed.groupBy("h").agg(F.count("*").alias("k"), F.max("n").alias("n")).where(
        (F.col("k") > 1) & (F.col("n") >= min_count)).count()
    if twice:
        raise ValueError(f"{twice} hashes of frequent words stand for two words")
    frequent = with_ordinal(hashed.where(F.col("n") >= min_count), [F.desc("n"), F.col("lang"), F.col("word")])
    return materialize(frequent.select((F.col("pos") + 1).alias("code"), "lang", F.col("word").cast("string").alias("word"),
                                       "n", "h"), "words")


#: Neither a hash nor a code.
_UNKNOWN = np.iinfo(np.int64).min


class Codes:
    """Codes of words: negative where the block has the word, else its hash."""

    def __init__(self, hashes: np.ndarray, codes: np.ndarray):
        self.hashes, self.codes = hashes, codes
        self.seeds: dict[str, int] = {}
        self.known: dict[str, dict[bytes, int]] = {}

    def find(self, h: np.ndarray) -> np.ndarray:
        """Hashes of this block become negative codes; other numbers stay."""
        if not len(self.hashes):
            return h
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, -self.codes[at], h)

    def encode(self, lang: str, body: bytes) -> np.ndarray:
        from xxhash import xxh64_intdigest as digest

        if sum(map(len, self.known.values())) > 300_000:
            self.known.clear()
        known, found = self.known.setdefault(lang, {b".": 0}), words(body)
        out = np.fromiter(map(known.get, found, repeat(_UNKNOWN)), np.int64, len(found))
        missing = np.flatnonzero(out == _UNKNOWN)
        if len(missing):
            met = [found[i] for i in missing.tolist()]
            new = list(set(met))
            seed = self.seeds.setdefault(lang, digest(lang.encode(), seed=42))
            h = np.array([max(digest(w, seed=seed) >> 1, 1) for w in new], dtype=np.int64)
            known.update(zip(new, self.find(h).tolist(), strict=True))
            out[missing] = list(map(known.__getitem__, met))
        return out


def runs_only(values: np.ndarray) -> np.ndarray:
    """Codes of runs of two words or more, a 0 after each run."""
    known = np.append(values < 0, False)
    before = np.append(False, known[:-1])
    known &= before | np.append(known[1:], False)
    keep = known | np.append(False, known[:-1])
    return np.where(known, -np.append(values, 0), 0)[keep].astype(np.int32)


def coded(texts: DataFrame, vocab: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Rows ``codes`` (binary int32, 0 is a break) of all texts, written."""
    spark, size = texts.sparkSession, vocab.count()
    blocks = max(1, -(-size // block))
    now = texts
    for b in range(blocks):
        rows = vocab.where((F.col("code") > b * block) & (F.col("code") <= (b + 1) * block)).select("h", "code").toArrow()
        h, c = (rows[k].to_numpy().astype(np.int64) for k in ("h", "code"))
        order = np.argsort(h)
        shared = spark.sparkContext.broadcast((h[order], c[order]))
        now = materialize(now.mapInArrow(_coder(shared, b == 0, b + 1 == blocks), "codes binary"), "codes")
        shared.unpersist()
    return now


def _coder(shared, first: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Codes(*shared.value)
        for batch in batches:
            if first:
                parts = [np.zeros(1, np.int64)]
                for lang, body in zip(batch["lang"].to_pylist(), batch["body"].to_pylist(), strict=True):
                    parts += [table.encode(lang, body), np.zeros(1, np.int64)]
                rows = [np.concatenate(parts)]
            else:
                rows = [table.find(np.frombuffer(r, np.int64)) for r in batch["codes"].to_pylist()]
            done = [runs_only(r).tobytes() if last else r.tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.binary())], ["codes"])

    return run


# --- double-array tries ------------------------------------------------------

#: Bits of a letter: a code is so many letters, the highest first, that no node has
#: more than ``1 << LETTER_BITS`` children and the arrays stay dense.
LETTER_BITS = 10
_LETTERS = 1 << LETTER_BITS
#: Nodes of so many children get cells of their own, one after the other.
_WIDE = 64


@dataclass
class Trie:
    """Phrases of codes, each code ``digits`` letters from 1: the child of state s by
    letter x is ``base[s] + x``, and exists if ``check`` of it is s.  ``accept`` has
    the phrase of a state or -1.  Behind the last state is room for any letter, where
    ``base`` of states without children points."""

    digits: int
    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray

    def walk(self, row: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each level: the start positions that are still in the trie, and
        their states.  ``row`` ends with a 0."""
        limit = 1 << (LETTER_BITS * self.digits)
        start = np.flatnonzero((row > 0) & (row < limit))
        code, state = row[start], np.zeros(len(start), np.int64)
        for level in range(depth):
            if level:
                code = row[start + level]
                inside = (code > 0) & (code < limit)
                start, state, code = start[inside], state[inside], code[inside]
            for k in reversed(range(self.digits)):
                there = self.base[state] + ((code >> (LETTER_BITS * k)) & (_LETTERS - 1)) + 1
                inside = self.check[there] == state
                start, state, code = start[inside], there[inside], code[inside]
            yield start, state


def compile_trie(phrases: np.ndarray, ids: np.ndarray) -> Trie:
    """A double-array trie of distinct phrases (rows of codes, 0 behind their end)."""
    digits = max(1, -(-int(phrases.max(initial=1)).bit_length() // LETTER_BITS))
    order = np.lexsort(phrases.T[::-1])
    ids = np.asarray(ids, np.int64)[order]
    rows = np.zeros((len(phrases), phrases.shape[1] * digits), np.int16)
    for d, column in enumerate(phrases.T):
        column = column[order]
        for k in range(digits):
            letter = ((column >> (LETTER_BITS * (digits - 1 - k))) & (_LETTERS - 1)) + 1
            rows[:, d * digits + k] = np.where(column > 0, letter, 0)
    # Nodes are the distinct beginnings; those of one parent lie together.
    new = np.zeros(len(rows), bool)
    above, total = np.zeros(len(rows), np.int64), 1
    parents, letters, accepted = [], [], [np.full(1, -1, np.int64)]
    for d in range(rows.shape[1]):
        new[0] = True
        new[1:] |= rows[1:, d] != rows[:-1, d]
        fresh = new & (rows[:, d] > 0)
        node = total - 1 + np.cumsum(fresh)
        parents.append(above[fresh])
        letters.append(rows[fresh, d].astype(np.int64))
        ends = (rows[:, d] > 0) & (rows[:, d + 1] == 0 if d + 1 < rows.shape[1] else True)
        accept = np.full(int(fresh.sum()), -1, np.int64)
        accept[node[ends] - total] = ids[ends]
        accepted.append(accept)
        above, total = node, total + int(fresh.sum())
    parent, letter = np.concatenate(parents), np.concatenate(letters)
    offset = _place(parent, letter, total)
    cell = np.append(0, offset[parent] + letter)
    size = int(cell.max()) + 1
    kind = np.int32 if ids.max(initial=0) < 1 << 31 else np.int64
    room = size + _LETTERS + 1
    trie = Trie(digits, np.full(room, size, np.int32), np.full(room, -1, np.int32), np.full(room, -1, kind))
    inner = np.unique(parent)
    trie.base[cell[inner]] = offset[inner]
    trie.check[cell[1:]] = cell[parent]
    trie.accept[cell] = np.concatenate(accepted)
    return trie


def _place(parent: np.ndarray, letter: np.ndarray, total: int) -> np.ndarray:
    """Offsets per node such that all ``offset[parent] + letter`` differ and are
    above 0.  Nodes of many children get a stretch each; the others, those of more
    children first, try free cells all at once, and those whose cells are all free
    and no other's stay; only children fill the cells that are left."""
    offset = np.zeros(total, np.int64)
    n = np.bincount(parent, minlength=total)
    first = np.cumsum(n) - n
    wide = np.flatnonzero(n >= _WIDE)
    least, most = letter[first[wide]], letter[first[wide] + n[wide] - 1]
    ends = np.cumsum(most - least + 1)
    offset[wide] = ends - (most - least) - least  # the first of them from cell 1
    top = int(ends[-1]) + 1 if len(wide) else 1
    used = np.zeros(2 * len(parent) + top + 2 * _LETTERS, bool)
    used[0] = True
    mine = n[parent] >= _WIDE
    used[offset[parent[mine]] + letter[mine]] = True
    top += _LETTERS
    few = np.flatnonzero((n > 1) & (n < _WIDE))
    size, rng = np.log2(n[few]).astype(np.int64), np.random.default_rng(0)
    owner = np.zeros(len(used), np.int32)
    for k in np.unique(size)[::-1]:
        left, tries = few[size == k], 0
        while len(left):
            if tries % 4 == 0:
                if len(used) < top + _LETTERS:
                    used, owner = (np.append(x, np.zeros(top + _LETTERS, x.dtype)) for x in (used, owner))
                free = np.flatnonzero(~used[:top])
            own = n[left]
            begin = np.cumsum(own) - own
            which = np.repeat(np.arange(len(left)), own)
            letters = letter[(first[left] - begin)[which] + np.arange(len(which))]
            place = free[rng.integers(len(free), size=len(left))] - letter[first[left]]
            cells = place[which] + letters
            owner[cells] = which
            good = np.logical_and.reduceat(~used[cells] & (owner[cells] == which), begin)
            used[cells[good[which]]] = True
            offset[left[good]] = place[good]
            left, tries = left[~good], tries + 1
            if 50 * np.count_nonzero(good) < len(good):  # too full for nodes of this size
                top, tries = top + max(_LETTERS, len(which)), 0
    only = np.flatnonzero(n == 1)
    free = np.flatnonzero(~used)
    if len(free) < len(only):
        free = np.append(free, len(used) + np.arange(len(only)))
    offset[only] = free[:len(only)] - letter[first[only]]
    return offset


# --- candidates ---------------------------------------------------------------

def _collected(phrases: DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray]:
    rows = phrases.select("cid", "codes").toArrow()
    matrix = np.zeros((rows.num_rows, depth), np.int32)
    lists = rows["codes"].combine_chunks()
    at = np.diff(lists.offsets.to_numpy())
    matrix[np.arange(depth) < at[:, None]] = lists.flatten().to_numpy()
    return matrix, rows["cid"].to_numpy()


def _blocks(phrases: DataFrame, block: int) -> list[DataFrame]:
    """Phrases in parts of about ``block``, by the hash of their first two words:
    longer beginnings are in one part only."""
    n = max(1, -(-phrases.count() // block))
    part = F.pmod(F.xxhash64(F.slice("codes", 1, 2)), F.lit(n))
    return [phrases.where(part == b) for b in range(n)]


def _slot(codes: list[np.ndarray]) -> np.ndarray:
    """Place of a sequence of codes in the bit table."""
    h = np.zeros(len(codes[0]), np.uint64)
    for c in codes:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - HASH_BITS)).astype(np.int64)


class Tally:
    """Counts of (state, next code), handed on whenever they are many."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, state: np.ndarray, code: np.ndarray) -> bool:
        key, n = np.unique((state.astype(np.int64) << 32) | code.astype(np.int64), return_counts=True)
        self.parts.append((key, n))
        self.held += len(key)
        return self.held > TALLY

    def take(self, accept: np.ndarray | None, ids: np.ndarray | None) -> pa.RecordBatch:
        if self.parts:
            key, back = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
            n = np.bincount(back, np.concatenate([c for _, c in self.parts]), len(key)).astype(np.int64)
        else:
            key = n = np.zeros(0, np.int64)
        self.parts, self.held = [], 0
        state = key >> 32
        return pa.RecordBatch.from_arrays(
            [pa.array(state if ids is None else ids[accept[state]]), pa.array(key & 0xFFFFFFFF), pa.array(n)],
            ["cid", "code", "n"])


def _propose(shared, bits, length: int):
    """Candidates of ``length`` words: a phrase one word shorter (its id), the
    next code and how often they met.  Pairs need no trie: the first word's code
    is its state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, ids = shared.value if shared else (None, None)
        accept = trie.accept if trie else None
        tally = Tally()
        for batch in batches:
            for raw in batch["codes"].to_pylist():
                row = np.frombuffer(raw, np.int32).astype(np.int64)
                if not len(row):
                    continue
                if trie is None:
                    start = np.flatnonzero((row[:-1] > 0) & (row[1:] > 0))
                    state = row[start]
                else:
                    for start, state in trie.walk(row, length - 1):
                        pass
                    following = row[start + length - 1] > 0
                    start, state = start[following], state[following]
                    slots = _slot([row[start + k] for k in range(1, length)])
                    safe = (bits.value[slots >> 3] >> (slots & 7)) & 1 > 0
                    start, state = start[safe], state[safe]
                if tally.add(state, row[start + length - 1]):
                    yield tally.take(accept, ids)
        yield tally.take(accept, ids)

    return run


#: Phrases whose counts travel together.
COUNT_PART = 1 << 16


def _count(shared, depth: int):
    """Bin counts of a task's accepting states, in parts of :data:`COUNT_PART` phrases."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, ids = shared.value
        seen, held, n = np.zeros(len(ids), np.int64), [], 0
        for batch in batches:
            for raw in batch["codes"].to_pylist():
                row = np.frombuffer(raw, np.int32).astype(np.int64)
                if len(row):
                    for _, state in trie.walk(row, depth):
                        met = trie.accept[state]
                        held.append(met[met >= 0])
                        n += len(held[-1])
                if n > TALLY:
                    seen += np.bincount(np.concatenate(held), minlength=len(seen))
                    held, n = [], 0
        if held:
            seen += np.bincount(np.concatenate(held), minlength=len(seen))
        parts = [(k, seen[k:k + COUNT_PART]) for k in range(0, len(seen), COUNT_PART)]
        parts = [(k, v) for k, v in parts if v.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int64()),
                                          pa.array([v.tobytes() for _, v in parts], pa.binary())], ["first", "counts"])

    return run


def _sum(shared):
    """``(cid, n)`` from the parts of all tasks, equal ones next to each other."""
    def out(first: int, total: np.ndarray) -> pa.RecordBatch:
        met = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(shared.value[1][first + met]), pa.array(total[met])], ["cid", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0, np.int64)
        for batch in batches:
            for first, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if first != now:
                    yield out(now or 0, total)
                    now, total = first, np.zeros(len(raw) // 8, np.int64)
                total = total + np.frombuffer(raw, np.int64)
        yield out(now or 0, total)

    return run


def count_phrases(codes: DataFrame, phrases: DataFrame, depth: int, block: int = BLOCK_PHRASES) -> DataFrame:
    """``(cid, n)``: occurrences of ``phrases`` ``(cid, codes)`` in the coded texts."""
    spark, out = codes.sparkSession, None
    for part in _blocks(phrases, block):
        matrix, ids = _collected(part, depth)
        if not len(ids):
            continue
        shared = spark.sparkContext.broadcast((compile_trie(matrix, np.arange(len(ids))), ids))
        parts = codes.mapInArrow(_count(shared, depth), "first bigint, counts binary")
        summed = parts.repartition("first").sortWithinPartitions("first").mapInArrow(_sum(shared), "cid bigint, n bigint")
        counts = materialize(summed, "phrase-counts")
        shared.unpersist()
        out = counts if out is None else out.unionByName(counts)
    return out if out is not None else spark.createDataFrame([], "cid bigint, n bigint")


def longer(codes: DataFrame, shorter: DataFrame | None, vocab: DataFrame, length: int, min_count: int,
           block: int = BLOCK_PHRASES) -> DataFrame:
    """Candidates ``(cid, lang, codes, phrase)`` of ``length`` words from those one
    word shorter (None: pairs)."""
    spark, ddl = codes.sparkSession, "cid bigint, code bigint, n bigint"
    if shorter is None:
        met = codes.mapInArrow(_propose(None, None, length), ddl)
        before = vocab.select(F.col("code").alias("cid"), "lang", F.array("code").alias("codes"), F.col("word").alias("phrase"))
        tallies = [met]
    else:
        before, tallies = shorter, []
        table = np.zeros(1 << (HASH_BITS - 3), np.uint8)
        for part in _blocks(shorter, block):
            matrix, _ = _collected(part, length - 1)
            slots = _slot(list(matrix.T))
            np.bitwise_or.at(table, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
        bits = spark.sparkContext.broadcast(table)
        for part in _blocks(shorter, block):
            matrix, ids = _collected(part, length - 1)
            if len(ids):
                shared = spark.sparkContext.broadcast((compile_trie(matrix, np.arange(len(ids))), ids))
                met = codes.mapInArrow(_propose(shared, bits, length), ddl)
                tallies.append(materialize(met.groupBy("cid", "code").agg(F.sum("n").alias("n")).where(
                    F.col("n") >= min_count), "tally"))
                shared.unpersist()
        bits.unpersist()
    found = tallies[0] if tallies else spark.createDataFrame([], ddl)
    for more in tallies[1:]:
        found = found.unionByName(more)
    frequent = found.groupBy("cid", "code").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    grown = frequent.select("cid", "code").join(before, "cid").join(
        vocab.select("code", F.col("word").alias("next")), "code")
    return materialize(grown.select(
        (F.monotonically_increasing_id() * 8 + length).alias("cid"), "lang",
        F.concat("codes", F.array("code")).alias("codes"), F.concat_ws(" ", "phrase", "next").alias("phrase")), "candidates")


# --- scores -------------------------------------------------------------------

def scored(phrases: DataFrame, counts: DataFrame, vocab: DataFrame, sizes: DataFrame, min_count: int,
           absorb_percent: int = ABSORB_PERCENT) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)`` of the candidates that no longer one
    absorbs.  Products are decimals of 38 digits; a larger one raises."""
    known = materialize(phrases.join(counts, "cid").where(F.col("n") >= min_count).withColumnRenamed("n", "a"), "counted")
    parts = known.select("codes", F.col("a").alias("f")).unionByName(
        vocab.select(F.array("code").alias("codes"), F.col("n").alias("f")))
    cuts = known.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("codes") - 1))).select(
        "cid", "lang", "phrase", "codes", "a", "k", F.slice("codes", F.lit(1), F.col("k")).alias("first"),
        F.slice("codes", F.col("k") + 1, F.size("codes")).alias("rest"))
    cuts = (cuts.join(parts.select(F.col("codes").alias("first"), F.col("f").alias("l")), "first")
            .join(parts.select(F.col("codes").alias("rest"), F.col("f").alias("r")), "rest")
            .join(sizes, "lang"))
    big = [F.col(c).cast("decimal(38,0)") for c in ("a", "n", "l", "r")]
    cuts = cuts.withColumn("top", F.lit(1000).cast("decimal(38,0)") * big[0] * big[1]).withColumn(
        "under", big[2] * big[3]).withColumn("score", F.expr("top div under"))
    best = cuts.groupBy("cid").agg(F.min(F.struct("score", "k", "l", "r", "n", "a", "lang", "phrase", "codes")).alias("s"))
    best = best.select("s.*")
    # (start, length) of every shorter phrase of two words or more.
    inner = known.withColumn("m", F.size("codes")).where("m > 2").select(
        "a", "m", "codes", F.explode(F.expr("sequence(2, m - 1)")).alias("size")).select(
        "a", "codes", "size", F.explode(F.expr("sequence(1, m - size + 1)")).alias("at")).select(
        F.slice("codes", F.col("at"), F.col("size")).alias("codes"), "a").groupBy("codes").agg(F.max("a").alias("within"))
    kept = best.join(inner, "codes", "left").where(
        F.col("within").isNull() | (100 * F.col("within") < absorb_percent * F.col("a")))
    return kept.select("lang", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT,
                 max_words: int = MAX_WORDS, absorb_percent: int = ABSORB_PERCENT, block_words: int = BLOCK_WORDS,
                 block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """All collocations of each language with their counts and scores."""
    texts = small_batches(docs).select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))
    counted = materialize(count_words(texts), "word-counts")
    sizes = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    vocab = vocabulary(counted, min_count)
    codes = coded(texts, vocab, block_words)
    levels: list[DataFrame] = []
    for length in range(2, max_words + 1):
        levels.append(longer(codes, levels[-1] if levels else None, vocab, length, min_count, block_phrases))
    phrases = levels[0]
    for more in levels[1:]:
        phrases = phrases.unionByName(more)
    counts = count_phrases(codes, phrases, max_words, block_phrases)
    return scored(phrases, counts, vocab, sizes, min_count, absorb_percent)


def collocation_digest(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The rows of the registered query: each language's first ``top``, which are
    among the first of its parts by hash."""
    best = [F.desc("score"), F.desc("a"), "phrase"]
    found = collocations(docs.select("lang", "text")).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best)))
    ranked = found.where(F.col("rank") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)))
    return ranked.where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = f"""
with pieces as (
  select coalesce(lang, '{NO_LANGUAGE}') as lang,
    unnest(regexp_split_to_array({lower_sql('text')}, '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
lists as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from lists),
grams as (
  select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase
  from starts, (select unnest(range(1, {MAX_WORDS + 1})) as m) where i + m - 1 <= len(w)),
f as (select lang, m, phrase, count(*) as f from grams group by all),
sizes as (select lang, cast(sum(f) as bigint) as n from f where m = 1 group by lang),
candidates as (select lang, m, phrase, f as a from f where m > 1 and f >= {MIN_COUNT}),
cuts as (
  select c.*, k, x.f as l, y.f as r, n, (1000::hugeint * a * n) // (x.f::hugeint * y.f) as score
  from (select *, unnest(range(1, m)) as k, string_split(phrase, ' ') as w from candidates) c
  join f x on x.lang = c.lang and x.phrase = array_to_string(w[1:k], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(w[k + 1:], ' ')
  join sizes s on s.lang = c.lang),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
kept as (
  select * from best b where not exists (
    select 1 from candidates q where q.lang = b.lang and q.m > b.m and 100 * q.a >= {ABSORB_PERCENT} * b.a
      and contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' ')))
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
where rank <= {TOP}
"""
