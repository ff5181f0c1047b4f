"""Best-fit-decreasing packing of token sequences into windows.

Documents longer than a window are first cut into full windows; what is left
of each (1 to ``window`` ids) is placed, longest first, into the open window
with the least room that still holds it, found with a segment tree over the
remaining capacities.

Only the *counts* of pieces per length (at most ``window`` numbers) decide the
packing, so the plan is made from that histogram: equal pieces take equal
windows in whole ranges, and a piece finds its window through its rank among
the pieces of its length.  Ranks come from two levels (hash bucket, then
length), so one very common length is dealt over many tasks.

Defined cases: an empty or null text is one piece of the end id alone; repeated
rows are packed as rows of their own; an empty table has no pieces.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import give_back, small_batches

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Rank buckets; pieces of one length are numbered per bucket.
BUCKETS = 256
#: Chunks whose ids an encoder keeps (about 200 bytes each).
CACHE_CHUNKS = 400_000
#: The same where nothing else is held beside them.
LARGE_CACHE = 800_000
#: Texts whose chunks are held at once.
TOGETHER = 64
#: Bits of a piece's rank and of a window's length in one 63-bit key.
RANK_BITS, MAX_WINDOW_BITS = 40, 23
# Fixed value: the vocabulary's mark of a word's last token.
WORD_END = "</w>"
# Points between a letter or digit and ASCII white space (or the end); not
# behind the one letter that lower case ends with a mark.
_POINTS = re.compile(r"[.,;:!?](?<=[^\W_\u0130].)[.,;:!?]*(?=[ \t-\r]|\Z)")


class RoomTree:
    """Segment tree over remaining capacities 0..size: leaf c tells whether a
    window with c ids of room is open; ``tightest(n)`` is the least c >= n."""

    def __init__(self, size: int):
        self.leaves = 1 << max(1, size).bit_length()
        self.open = [False] * (2 * self.leaves)

    def set(self, c: int, value: bool):
        k = self.leaves + c
        while k:
            self.open[k] = value
            k >>= 1
            if k:
                value = self.open[2 * k] or self.open[2 * k + 1]

    def tightest(self, n: int) -> int | None:
        k = self.leaves + n
        if self.open[k]:
            return n
        while k > 1:
            if k % 2 == 0 and self.open[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.open[2 * k] else 2 * k + 1
                return k - self.leaves
            k >>= 1
        return None


def plan_windows(counts: dict[int, int], window: int = WINDOW,
                 first_id: int = 0) -> list[tuple[int, int, int, int, int]]:
    """Best-fit-decreasing over piece counts by length.  Rows ``(length,
    first_rank, n, first_window, offset)``: the pieces of that length with ranks
    ``first_rank .. first_rank + n`` go to consecutive windows at ``offset``."""
    tree = RoomTree(window)
    rooms: dict[int, list[tuple[int, int]]] = {}
    plan, next_id = [], first_id

    def give_back(room: int, first: int, n: int):
        if room > 0:
            if not rooms.get(room):
                rooms[room] = []
                tree.set(room, True)
            rooms[room].append((first, n))

    for length in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = window, next_id, max(1, left // (window // length))
                next_id += n
            else:
                first, n = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, False)
            # A window that took one of these is the tightest for the next, so
            # it takes `each` of them before another window is opened.
            each = min(left, room // length)
            used = min(n, left // each)
            for k in range(each):
                plan.append((length, rank, used, first, window - room + k * length))
                rank += used
            left -= used * each
            if used < n:
                give_back(room, first + used, n - used)
            give_back(room - each * length, first, used)
    return plan


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: a
    fixed public mapping, printable Latin-1 characters for themselves and the
    others, in order, from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class MergeRanks:
    """The same merges as a table from bytes to rank, which a faster public
    library applies: a word and the blank behind it, which stands for the mark of
    its last token.  Only for vocabularies of single bytes and one merge for
    every other token, so a rank tells its pair."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, bytes_of = model["vocab"], byte_of_char()

        def raw(token: str) -> bytes:
            return bytes(bytes_of[c] for c in token.removesuffix(WORD_END)) + b" " * token.endswith(WORD_END)

        single = sorted((t for t in vocab if len(t.removesuffix(WORD_END)) == 1), key=lambda t: t.endswith(WORD_END))
        tokens = single + ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ranks = {raw(t): k for k, t in enumerate(tokens)}
        if len(single) != 512 or len(ranks) != len(tokens):
            raise ValueError("not a vocabulary of single bytes and one merge per token")
        self.ids = np.array([vocab[t] for t in tokens], "<u4")
        self.coder = tiktoken.Encoding("merges", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def encode(self, line: str) -> np.ndarray:
        """Ids of words between single blanks."""
        return self.ids[self.coder.encode_to_numpy(line + " ", disallowed_special=())]


class Encoder:
    """Ids of whole texts with a public tokenizer that lowers case and splits
    texts into runs of letters, digits and runs of other characters.

    These pieces never cross white space, and points behind a letter or digit
    are a piece of their own, so ids are kept in a bounded cache per chunk
    between blanks, in lower case, points apart.  Only unseen chunks are encoded,
    all of a batch at once; those that are one run of letters, and that
    normalising leaves alone, by their merges: the vocabulary marks the last
    token of a run, which cuts the ids apart again."""

    def __init__(self, path: str, end_id: int = END_ID, cache_chunks: int = CACHE_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks in parallel
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = MergeRanks(path)  # for words that normalising leaves alone
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.last = np.fromiter(((self.tokenizer.id_to_token(i) or "").endswith(WORD_END)
                                 for i in range(size)), bool, size)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.cache_chunks = cache_chunks
        self.end = np.uint32(end_id).astype("<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Little-endian uint32 ids of the text and the end id."""
        return self._encode_some([text])[0]

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """:meth:`encode` of every text, :data:`TOGETHER` at a time; chunks that
        none of the two generations of known ones has are encoded together."""
        for k in range(0, len(texts), TOGETHER):
            yield from self._encode_some(texts[k:k + TOGETHER])

    def _encode_some(self, texts: list[str | None]) -> list[bytes]:
        chunked = [_POINTS.sub(r" \g<0> ", t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        if len(self.known) > self.cache_chunks // 2:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        unseen = []
        for c in set().union(*chunked).difference(known):
            ids = before.get(c)
            if ids is None:
                unseen.append(c)
            else:
                known[c] = ids
        if unseen:
            self._encode(unseen)
        return [b"".join([known[c] for c in chunks]) + self.end for chunks in chunked]

    def _encode(self, pieces: list[bytes]):
        """Ids of chunks that each stand alone, into the cache."""
        known = self.known
        texts = b" ".join(pieces).decode("utf-8", "replace").split(" ")
        plain = [t.isalpha() and (t.isascii() or (t == t.lower() and unicodedata.is_normalized("NFC", t))) for t in texts]
        run = list(compress(pieces, plain))
        if run:
            ids = self.merges.encode(" ".join(compress(texts, plain)))
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            raw = ids.tobytes()
            known.update(zip(run, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        if len(run) < len(pieces):
            others = [(p, t) for p, t, fits in zip(pieces, texts, plain, strict=True) if not fits]
            done = self.tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False)
            for (p, _), e in zip(others, done, strict=True):
                known[p] = np.array(e.ids, dtype="<u4").tobytes()


_ENCODERS: dict[tuple, Encoder] = {}


def worker_encoder(path: str, end_id: int = END_ID, cache_chunks: int = CACHE_CHUNKS) -> Encoder:
    """The encoder of this Python worker, which serves task after task: what one
    task has met is known to the next.  A worker holds one at a time."""
    key = (path, end_id, cache_chunks)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def cut(n: int, window: int) -> Iterator[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids: full windows, then the rest."""
    for start in range(0, n, window):
        yield start, min(window, n - start)


def pieces(docs: DataFrame, path: str, keys: list[str], text_col: str = "text",
           window: int = WINDOW, end_id: int = END_ID,
           cache_chunks: int = CACHE_CHUNKS, keep: bool = True) -> DataFrame:
    """One row per piece: the key columns, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``.  Workers keep their encoder for later tasks, or with ``keep``
    false give its memory back after each."""
    piece = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    result = pa.struct([("doc_tokens", pa.int64()), ("pieces", pa.list_(piece))])

    @F.arrow_udf("struct<doc_tokens:bigint,"
                 "pieces:array<struct<start:bigint,length:bigint,ids_crc32:bigint>>>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = worker_encoder(path, end_id, cache_chunks) if keep else Encoder(path, end_id, cache_chunks)
        for texts in batches:
            rows = []
            for ids in coder.encode_all(texts.to_pylist()):
                n = len(ids) // 4
                parts = []
                for start, length in cut(n, window):
                    parts.append({"start": start, "length": length,
                                  "ids_crc32": zlib.crc32(ids[4 * start:4 * (start + length)])})
                rows.append({"doc_tokens": n, "pieces": parts})
            yield pa.array(rows, type=result)
            del rows
            give_back()
        if not keep:
            del coder
            give_back(now=True)

    coded = small_batches(docs).select(*[F.col(k) for k in keys], encode(F.col(text_col).cast("string")).alias("_doc"))
    return (coded.select(*keys, F.col("_doc.doc_tokens").alias("doc_tokens"),
                         F.explode("_doc.pieces").alias("_piece"))
            .select(*keys, "doc_tokens", "_piece.*"))


def _rank_bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys, "start", "ids_crc32", "doc_tokens"), F.lit(BUCKETS)).cast("int")


def assign(cuts: DataFrame, keys: list[str], window: int = WINDOW) -> DataFrame:
    """``sequence_id`` and ``offset`` for written pieces.

    Full windows and shorter pieces alike are ranked within (bucket, length);
    bucket offsets are running sums over at most :data:`BUCKETS` counts a
    length.  The histogram on the driver has at most ``window`` numbers, the
    plan that goes back is about as many rows."""
    spark = cuts.sparkSession
    ranked = cuts.withColumn("_bucket", _rank_bucket(keys))
    starts, place = plan_ranks(ranked.groupBy("length", "_bucket").agg(F.count("*").alias("_n")),
                               "_bucket", window)
    own = Window.partitionBy("length", "_bucket").orderBy(*keys, "start", "ids_crc32", "doc_tokens")
    numbered = (ranked.withColumn("_row", F.row_number().over(own) - 1)
                .join(starts, ["length", "_bucket"])
                .withColumn("_place", place("length", (F.col("_row") + F.col("_before")).cast("long"))))
    return numbered.select(*cuts.columns, "_place.sequence_id", "_place.offset")


def plan_ranks(counts: DataFrame, group: str, window: int):
    """From piece counts ``(length, group, _n)``: how many pieces of the length
    are in earlier groups (``_before``, written), and a function that places a
    piece by its length and rank."""
    if window >= 1 << MAX_WINDOW_BITS:
        raise ValueError(f"windows hold less than {1 << MAX_WINDOW_BITS} ids")
    spark = counts.sparkSession
    order = Window.partitionBy("length").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(counts.select("length", group, "_n", F.coalesce(
        F.sum("_n").over(order), F.lit(0)).alias("_before")), "piece-counts")
    sizes = {int(r["length"]): int(r["n"])
             for r in starts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    if max(sizes.values(), default=0) >= 1 << RANK_BITS:
        raise ValueError(f"2**{RANK_BITS} pieces or more have one length")
    shared = spark.sparkContext.broadcast(
        np.array(sorted(plan_windows(sizes, window)), dtype=np.int64).reshape(-1, 5))

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        rows = shared.value
        n, r = lengths.to_numpy(), ranks.to_numpy()
        # Lengths and ranks are bounded above: one ordered key.
        at = np.searchsorted((rows[:, 0] << RANK_BITS) + rows[:, 1], (n << RANK_BITS) + r, side="right") - 1
        return pa.StructArray.from_arrays(
            [pa.array(rows[at, 3] + r - rows[at, 1]), pa.array(rows[at, 4])], ["sequence_id", "offset"])

    return starts.drop("_n"), place


def pack(docs: DataFrame, path: str, keys: list[str] | None = None, text_col: str = "text",
         window: int = WINDOW, end_id: int = END_ID, cache_chunks: int = CACHE_CHUNKS, keep: bool = True) -> DataFrame:
    """Pieces of all documents with their window and place in it: key columns,
    ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.
    ``cache_chunks`` and ``keep`` trade a worker's memory for time; the result is the same."""
    keys = keys or ["doc_id"]
    cuts = materialize(pieces(docs, path, keys, text_col, window, end_id, cache_chunks, keep), "pieces")
    return assign(cuts, keys, window)


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public vocabulary file; it is never copied into the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, cache_chunks: int = LARGE_CACHE, keep: bool = True) -> DataFrame:
    """The rows of the registered query."""
    return pack(docs.select("doc_id", "text"), tokenizer_path(), cache_chunks=cache_chunks, keep=keep).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
