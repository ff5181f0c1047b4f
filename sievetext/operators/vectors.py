"""Word vectors, lookup tables and pooled features.

Vectors are ``array<double>`` columns.  Sums over rows use the JVM vector
aggregate of ``pyspark.ml.stat.Summarizer`` (partial aggregation map-side),
so pooling never collects a group's vectors into one list.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import DRAW_RANGE, draw, draw_mod
from ..functions.text import WS_CLASS
from .frequent import fill_vector, hot_attention, hot_mean, hot_rows, packed, unpacked
from ..session import materialize
from .order import with_ordinal
from .vocab import PAD_ID, UNK_ID

DEFAULT_BROADCAST_BYTES = 128 * 1024 * 1024
#: Vectors that a pooling task gathers at a time.
SLICE_ITEMS = 16_384


# ---------------------------------------------------------------- sizing

def broadcast_budget(spark) -> int:
    """Byte budget for broadcasting a table: ``spark.sievetext.broadcastBytes``
    (default 128 MiB)."""
    from ..session import setting

    return setting(spark, "broadcastBytes", DEFAULT_BROADCAST_BYTES)


def broadcast_if_small(df: DataFrame, bytes_per_row: int,
                       budget: int | None = None) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only when its row count proves it fits ``budget``;
    otherwise return it unchanged for a shuffle join (AQE splits skew)."""
    budget = broadcast_budget(df.sparkSession) if budget is None else budget
    n = df.count()
    small = n * max(1, bytes_per_row) <= budget
    return (F.broadcast(df) if small else df), small


# ---------------------------------------------------------------- word-vector files

def format_vector_lines(vectors: DataFrame, token_col: str = "token", vec_col: str = "vec") -> DataFrame:
    """``word v1 v2 ... vd`` lines, one blank between (the text format)."""
    nums = F.col(vec_col).cast("array<string>")
    return vectors.select(F.concat_ws(" ", F.col(token_col), F.array_join(nums, " ")).alias("value"))


def write_word_vectors(vectors: DataFrame, path: str, token_col: str = "token",
                       vec_col: str = "vec") -> str:
    format_vector_lines(vectors, token_col, vec_col).write.mode("overwrite").text(path)
    return path


def parse_vector_lines(spark: SparkSession, path: str, vocab: DataFrame | None = None) -> DataFrame:
    """Parse lines into ``(token, vec, _line)`` (T5), keeping only vocabulary words.

    The vocabulary filter is a left-semi join.  A vocabulary that can be broadcast
    comes *before* the numbers are parsed, so unneeded lines are never converted;
    with a larger one the parsed vectors are moved, a fifth of their text.
    ``_line`` orders lines by file, split and position in the split (for "last
    line wins").
    """
    # Only \n ends a line; bytes that are not UTF-8 are ignored.
    whole = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(
        F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")))
    raw = spark.read.option("lineSep", "\n").text(path).select(
        whole.alias("value"),
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                 F.monotonically_increasing_id()).alias("_line"))
    stripped = F.regexp_replace("value", f"{WS_CLASS}+$", "")
    parts = raw.select(F.split(stripped, " ").alias("_parts"), "_line")
    words = parts.select(F.element_at("_parts", 1).alias("token"), "_parts", "_line")
    small = False
    if vocab is not None:
        vocab, small = broadcast_if_small(vocab.select("token"), 256)
    if small:
        words = words.join(vocab, "token", "left_semi")
    nums = F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0)))
    parsed = words.select("token", F.transform(nums, lambda x: x.try_cast("double")).alias("vec"),
                          F.size(nums).alias("_dim"), "_line")
    if vocab is None or small:
        return parsed
    moved = parsed.select("token", *packed(), "_dim", "_line").join(vocab, "token", "left_semi")
    return moved.select("token", unpacked().alias("vec"), "_dim", "_line")


def read_word_vectors(spark: SparkSession, path: str, vocab: DataFrame | None = None,
                      dim: int | None = None, on_error: str = "raise") -> tuple[DataFrame, dict]:
    """Read a word-vector text file into ``(token, vec)``.

    * duplicate word: the last line wins (by file, split, position);
    * lines whose length differs from ``dim`` (default: the most common
      length, A7) are dropped and counted -- a ``count dim`` header is one;
    * an unparsable number raises, or with ``on_error="drop"`` drops the line.

    Returns the table and a dict of counts (``dim``, ``dropped_length``,
    ``malformed``).  The lines are parsed once and written; only words that come
    on several lines are grouped.
    """
    if on_error not in ("raise", "drop"):
        raise ValueError("on_error must be 'raise' or 'drop'")
    bad_num = F.exists("vec", lambda x: x.isNull()).alias("_bad")
    lines = materialize(parse_vector_lines(spark, path, vocab).select("token", *packed(), "_dim", "_line", bad_num),
                        "vector-lines")
    # lines and malformed lines per length, the wanted length first
    by_dim = lines.groupBy("_dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("_bad").alias("bad"))
    wanted = F.lit(False) if dim is None else F.col("_dim") == F.lit(dim)
    best = by_dim.withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(0)))).orderBy(
        wanted.desc(), F.col("n").desc(), "_dim").first()
    found = best is not None and (dim is None or best["_dim"] == dim)
    dim = best["_dim"] if best is not None and dim is None else dim
    info = {"dim": dim, "dropped_length": int(best["all"] - (best["n"] if found else 0)) if best else 0,
            "malformed": int(best["bad"]) if found else 0}
    if info["malformed"] and on_error == "raise":
        raise ValueError(f"{info['malformed']} word-vector lines have a malformed number")
    good = lines.where((F.col("_dim") == F.lit(dim)) & ~F.col("_bad")).select("token", unpacked().alias("vec"), "_line")
    again = materialize(good.groupBy("token").count().where("count > 1").select("token"), "repeated-words")
    if not again.count():
        return good.select("token", "vec"), info
    last = good.join(again, "token", "left_semi").groupBy("token").agg(F.max_by("vec", "_line").alias("vec"))
    return good.join(again, "token", "left_anti").select("token", "vec").unionByName(last), info


# ---------------------------------------------------------------- vectors from the given tables

def _numbered(embeddings: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    base = embeddings.select(id_col, F.col(vec_col).alias("vec"))
    return with_ordinal(base, [id_col], name="row").select("row", "vec")


def embedding_rows(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(row, vec)``: the vector table in ``id_col`` order with dense row numbers."""
    return _numbered(embeddings, id_col, vec_col).select("row", F.col("vec").cast("array<double>").alias("vec"))


def assign_vectors(vocab: DataFrame, embeddings: DataFrame, seed: int = 7,
                   id_col: str = "vec_id", vec_col: str = "embedding",
                   n: int | None = None) -> DataFrame:
    """Give every vocabulary word a vector of a vector table:
    ``row = draw(seed,'wv',token) % count`` in ``id_col`` order -> ``(token, vec)``.

    This stands in for a pre-trained vector file built from the given data.
    ``n``: the table's row count when the caller already has it.
    """
    n = embeddings.count() if n is None else int(n)
    if n == 0:
        raise ValueError("empty vector table")
    keyed = vocab.select("token", draw_mod(seed, "wv", n, "token").alias("row"))
    rows = _numbered(embeddings, id_col, vec_col)  # moved as they are, doubles only after the join
    return keyed.join(rows, "row").select("token", F.col("vec").cast("array<double>").alias("vec"))


# ---------------------------------------------------------------- lookup table

def special_vector(special_id: int | Column, dim: int, seed: int = 7) -> Column:
    """Keyed vector of a special id: zeros for <PAD>, else uniform in
    [-1, 1) / sqrt(dim) per component (the reference draws these at random)."""
    sid = F.lit(special_id) if isinstance(special_id, int) else special_id
    scale = F.lit(1.0 / math.sqrt(dim))
    comp = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda j: (F.lit(2.0) * draw(seed, "special", sid, j) / F.lit(float(DRAW_RANGE)) - F.lit(1.0)) * scale)
    zeros = F.array_repeat(F.lit(0.0), dim)
    return F.when(sid == F.lit(PAD_ID), zeros).otherwise(comp)


def lookup_table(index: DataFrame, vectors: DataFrame, dim: int, seed: int = 7,
                 specials=(0, 1, 2, 3)) -> DataFrame:
    """``(id, token, vec)`` for every id of the word index.

    Words without a vector take the <UNK> vector (Q5: ids stay dense and
    correct instead of pointing at the wrong row).  Specials get
    :func:`special_vector`.
    """
    return filled_lookup(index.join(vectors.select("token", "vec"), "token", "left"), dim, seed, specials)


def filled_lookup(joined: DataFrame, dim: int, seed: int = 7, specials=(0, 1, 2, 3)) -> DataFrame:
    """:func:`lookup_table` of an index that has its vectors (null where there is none)."""
    unk = special_vector(UNK_ID, dim, seed)
    is_special = F.col("id").isin(*specials)
    vec = F.when(is_special, special_vector(F.col("id").cast("int"), dim, seed)).otherwise(
        F.coalesce(F.col("vec"), unk))
    return joined.select("id", "token", vec.alias("vec"))


def token_vectors(index: DataFrame, lookup: DataFrame) -> DataFrame:
    """``(token, vec)`` for the words of the index (specials excluded)."""
    return index.where(F.col("id") > F.lit(UNK_ID)).join(lookup.select("id", "vec"), "id").select("token", "vec")


# ---------------------------------------------------------------- pooling

def _vector_table(table: DataFrame, key: str, dim: int, broadcast: bool | None) -> DataFrame:
    t = table.select(key, "vec")
    if broadcast is None:
        t, _ = broadcast_if_small(t, 8 * dim + 64)
    elif broadcast:
        t = F.broadcast(t)
    return t


def _gather(df: DataFrame, id_col: str, items: Column, table: DataFrame, key: str,
            dim: int, unk: Column | None, broadcast: bool | None, keep=()) -> DataFrame:
    """``id, *keep, _n, h``: one row per distinct item of a row with its number
    of occurrences (and one row with ``_n`` 0 and a zero vector for a row without
    items).  Counting before the look-up sends each distinct item once, however
    long the text."""
    exploded = df.select(id_col, *keep, F.explode_outer(items).alias(key))
    counted = exploded.groupBy(id_col, key).agg(
        F.count(key).alias("_n"), *[F.first(c).alias(c) for c in keep])
    return _look_up(counted, id_col, table, key, dim, unk, broadcast, keep)


def _counted_items(df: DataFrame, id_col: str, items_col: str, key: str, keep=()) -> DataFrame:
    """``id, *keep, key, _n``: the distinct items of every row with their counts,
    made where the row lies (and one row with a null item and ``_n`` 0 for a row
    without items)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import types as T

    item = T.StructField(key, df.schema[items_col].dataType.elementType)
    schema = T.StructType([df.schema[id_col], *[df.schema[c] for c in keep], item, T.StructField("_n", T.LongType())])

    def run(batches):
        for rb in batches:
            col = rb.column(items_col)
            lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(col).dictionary_encode()
            rows = np.repeat(np.arange(len(lens)), lens)
            code = flat.indices.fill_null(len(flat.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            size = len(flat.dictionary) + 1
            pairs, n = np.unique(rows * size + code, return_counts=True)
            none = np.flatnonzero(lens == 0)  # a null item
            at = np.concatenate([pairs // size, none])
            code = np.concatenate([pairs % size, np.full(len(none), size - 1)])
            n = np.concatenate([n, np.zeros(len(none), np.int64)])
            for k in range(0, len(at), SLICE_ITEMS):
                part = slice(k, k + SLICE_ITEMS)
                taken = pa.array(at[part])
                token = flat.dictionary.take(pa.array(code[part], mask=code[part] == size - 1))
                yield pa.RecordBatch.from_arrays(
                    [*[rb.column(c).take(taken) for c in (id_col, *keep)], token, pa.array(n[part])],
                    names=[id_col, *keep, key, "_n"])

    return df.select(id_col, *keep, items_col).mapInArrow(run, schema)


def _look_up(counted: DataFrame, id_col: str, table: DataFrame, key: str, dim: int, unk: Column | None,
             broadcast: bool | None, keep=()) -> DataFrame:
    """``id, *keep, _n, h`` of counted items."""
    joined = counted.join(_vector_table(table, key, dim, broadcast), key, "left")
    zeros = F.array_repeat(F.lit(0.0), dim)
    fill = unk if unk is not None else zeros
    h = F.when(F.col("_n") == 0, zeros).otherwise(F.coalesce(F.col("vec"), fill))
    return joined.select(id_col, *keep, "_n", h.alias("h"))


def broadcast_vector_table(table: DataFrame, key: str, dim: int, unk: Column | None = None,
                           budget: int | None = None):
    """``(keys, M)`` of a vector table as a Spark broadcast, or ``None`` when its
    row count does not prove it fits ``budget``.  ``M`` (:class:`.frequent.Rows`)
    has one extra row, -1: the vector for items missing from the table (``unk``
    or zeros)."""
    budget = broadcast_budget(table.sparkSession) if budget is None else budget
    n = table.count()
    if n * (8 * dim + 64) > budget:
        return None
    return hot_rows(table, key, dim, fill_vector(table.sparkSession, dim, unk))


def _segment_sums(M, idx, rows, n: int, weights):
    """Sum of ``M[idx]`` (times ``weights``) by row, ``SLICE_ITEMS`` vectors at a
    time; ``rows`` ascends."""
    import numpy as np

    out = np.zeros((n, M.dim))
    for a in range(0, len(idx), SLICE_ITEMS):
        r, V = rows[a:a + SLICE_ITEMS], M.take(idx[a:a + SLICE_ITEMS])
        if weights is not None:
            V = V * weights[a:a + SLICE_ITEMS, None]
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        out[r[first]] += np.add.reduceat(V, first, axis=0)
    return out


def _attended(M, idx, rows, lens):
    """Softmax-attention sums by row; the query is the row's last vector."""
    import numpy as np

    if not len(idx):
        return np.zeros((len(lens), M.dim))
    starts = (np.cumsum(lens) - lens)[lens > 0]
    last = np.zeros(len(lens), np.int64)
    last[lens > 0] = idx[starts + lens[lens > 0] - 1]
    s = np.empty(len(idx))
    for a in range(0, len(idx), SLICE_ITEMS):
        part = slice(a, a + SLICE_ITEMS)
        s[part] = np.einsum("td,td->t", M.take(idx[part]), M.take(last[rows[part]]))
    top = np.zeros(len(lens))
    top[lens > 0] = np.maximum.reduceat(s, starts)
    e = np.exp(s - top[rows])
    z = np.ones(len(lens))
    z[lens > 0] = np.add.reduceat(e, starts)
    return _segment_sums(M, idx, rows, len(lens), e) / z[:, None]


def _local_pool(df: DataFrame, bc, dim: int, id_col: str, items_col: str, max_items: int | None,
                keep, out_col: str, how: str) -> DataFrame:
    """Row-local pooling over Arrow batches with a broadcast vector table: the
    items of a row are looked up with ``pyarrow.compute.index_in`` and reduced
    with NumPy segment sums -- no shuffle."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import types as T

    from .model import list_column

    fields = [df.schema[id_col]] + [df.schema[c] for c in keep]
    schema = T.StructType(fields + [T.StructField(out_col, T.ArrayType(T.DoubleType()), False)])
    names = [f.name for f in fields]

    def run(batches):
        keys, M = bc.value
        for rb in batches:
            col = rb.column(items_col)
            if max_items is not None:
                col = pc.list_slice(col, 0, max_items)
            lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(col)
            idx = pc.fill_null(pc.index_in(flat, value_set=keys), -1).to_numpy(zero_copy_only=False)
            idx = idx.astype(np.int64)
            rows = np.repeat(np.arange(len(lens)), lens)
            if how == "mean":
                out = _segment_sums(M, idx, rows, len(lens), None) / np.maximum(lens, 1)[:, None]
            else:
                out = _attended(M, idx, rows, lens)
            yield pa.RecordBatch.from_arrays([rb.column(c) for c in names] + [list_column(out)],
                                             names=names + [out_col])

    return df.select(id_col, *keep, items_col).mapInArrow(run, schema)


def mean_pool(df: DataFrame, table: DataFrame, dim: int, id_col: str = "id",
              items_col: str = "tokens", key: str = "token", max_items: int | None = None,
              unk: Column | None = None, broadcast: bool | None = None,
              out_col: str = "features", keep=(), method: str = "auto",
              hot=None) -> DataFrame:
    """Mean of the vectors of each row's items.

    ``items_col`` holds tokens (``key='token'``, ``table=(token, vec)``) or ids
    (``key='id'``, ``table=(id, vec)``); items missing from ``table`` take
    ``unk`` (default: zeros); rows without items get a zero vector.

    ``method="local"`` (chosen by ``"auto"`` when the table's row count
    proves it fits the broadcast budget): the table is broadcast and each row
    is pooled where it lies, with Arrow look-ups and NumPy segment sums -- no
    shuffle.  ``method="join"`` (beyond the budget): explode -> count per row
    and item -> join with the vector table (shuffle join with AQE skew
    splitting) -> per-row JVM vector sum, partially aggregated before its
    shuffle.  Whole rows are pooled unless ``max_items`` says otherwise; both
    methods give the same result.  ``hot``: a bounded subset of ``table`` (or a
    function that makes it: the vectors of the most frequent items); with it the
    join path sums those where the row lies and moves the vectors of the other
    items only (:func:`.frequent.hot_mean`).
    """
    if method in ("auto", "local"):
        bc = broadcast_vector_table(table, key, dim, unk, budget=None if method == "auto" else 1 << 62)
        if bc is not None:
            return _local_pool(df, bc, dim, id_col, items_col, max_items, keep, out_col, "mean")
    items = F.col(items_col) if max_items is None else F.slice(items_col, 1, max_items)
    if hot is not None:
        return hot_mean(df, table, hot() if callable(hot) else hot, dim, id_col, items, key, unk, keep, out_col)
    g = _gather(df, id_col, items, table, key, dim, unk, broadcast, keep)
    weighted = array_to_vector(F.transform("h", lambda x: x * F.col("_n")))
    sums = g.groupBy(id_col).agg(Summarizer.sum(weighted).alias("_s"), F.sum("_n").alias("_n"),
                                 *[F.first(c).alias(c) for c in keep])
    mean = F.transform(vector_to_array("_s"), lambda x: x / F.greatest(F.col("_n"), F.lit(1)))
    return sums.select(id_col, *keep, mean.alias(out_col))


def attention_pool(df: DataFrame, table: DataFrame, dim: int, id_col: str = "id",
                   items_col: str = "tokens", key: str = "token", max_items: int | None = None,
                   unk: Column | None = None, broadcast: bool | None = None,
                   out_col: str = "features", method: str = "auto",
                   hot=None) -> DataFrame:
    """Softmax attention pooling (M6): ``w_t = softmax_t(h_t . q)``, result
    ``sum_t w_t h_t``, with ``h_t`` the item vectors and ``q`` the vector of the
    last item.  ``method`` and ``hot`` as in :func:`mean_pool`; on the join path
    each distinct item of a row is weighted once, and an online softmax merges
    partial states: without ``hot`` no vector of an item is shuffled to its row,
    with it those of the items that it lacks are (:func:`.frequent.hot_attention`).
    """
    if method in ("auto", "local"):
        bc = broadcast_vector_table(table, key, dim, unk, budget=None if method == "auto" else 1 << 62)
        if bc is not None:
            return _local_pool(df, bc, dim, id_col, items_col, max_items, (), out_col, "attention")

    items = F.col(items_col) if max_items is None else F.slice(items_col, 1, max_items)
    if hot is not None:
        return hot_attention(df, table, hot() if callable(hot) else hot, dim, id_col, items, key, unk, out_col)
    # The query vector of a row comes first, one look-up a row, and goes with its
    # items to theirs; where they meet, states are made and only states move.
    last = df.select(id_col, items.alias("_items"), F.when(F.size(items) > 0, F.element_at(items, -1)).alias(key))
    zeros = F.array_repeat(F.lit(0.0), dim)
    fill = F.when(F.col(key).isNull(), zeros).otherwise(unk if unk is not None else zeros)
    asked = last.join(_vector_table(table, key, dim, broadcast), key, "left").select(
        id_col, "_items", F.coalesce("vec", fill).alias("_q"))
    h = _look_up(_counted_items(asked, id_col, "_items", key, ("_q",)), id_col, table, key, dim, unk, broadcast,
                 ("_q",))
    return _online_softmax(h, dim, id_col, out_col)


def _online_softmax(h: DataFrame, dim: int, id_col: str, out_col: str) -> DataFrame:
    """``sum_t w_t h_t`` per row from rows ``id, _q, _n, h``, with mergeable states:
    the maximum score, the sum of the weights below it and the weighted sum of
    vectors.  Every batch of items gives one state per row id, and the states of
    a row, next to each other after the shuffle, are merged one by one."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    from .model import list_column, matrix

    id_field = h.schema[id_col]
    id_type = to_arrow_type(id_field.dataType)
    state = T.StructType([id_field, T.StructField("_m", T.DoubleType()), T.StructField("_z", T.DoubleType()),
                          T.StructField("_s", T.ArrayType(T.DoubleType()))])
    result = T.StructType([id_field, T.StructField(out_col, T.ArrayType(T.DoubleType()), False)])

    def reduced(at, scores, weights, vectors):
        """States by row number ``at`` (ascending) of scored, weighted vectors."""
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        top = np.maximum.reduceat(scores, first)
        number = np.cumsum(np.append(False, at[1:] != at[:-1]))
        e = weights * np.exp(scores - top[number])
        return first, top, np.add.reduceat(e, first), np.add.reduceat(vectors * e[:, None], first, axis=0)

    def part(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            ids = rb.column(id_col).dictionary_encode()
            at = ids.indices.fill_null(len(ids.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            V = matrix(rb.column("h"), dim)[order]
            scores = np.einsum("td,td->t", V, matrix(rb.column("_q"), dim)[order])
            n = rb.column("_n").to_numpy(zero_copy_only=False).astype(np.float64)[order]
            first, top, z, s = reduced(at[order], scores, n, V)
            own = rb.column(id_col).take(pa.array(order[first]))
            yield pa.RecordBatch.from_arrays([own, pa.array(top), pa.array(z), list_column(s)],
                                             names=[id_col, "_m", "_z", "_s"])

    def merge(batches):
        held = None  # id, maximum, weights, sum of the row that may go on
        for rb in batches:
            done = []
            states = zip(rb.column(id_col).to_pylist(), rb.column("_m").to_pylist(), rb.column("_z").to_pylist(),
                         matrix(rb.column("_s"), dim), strict=True)
            for row, m, z, s in states:
                if held is None or held[0] != row:
                    if held is not None:
                        done.append(held)
                    held = (row, m, z, s)
                else:
                    top = max(held[1], m)
                    a, b = np.exp(held[1] - top), np.exp(m - top)
                    held = (row, top, held[2] * a + z * b, held[3] * a + s * b)
            if done:
                yield out(done)
        if held is not None:
            yield out([held])

    def out(rows):
        sums = np.stack([s / (z if z > 0 else 1.0) for _, _, z, s in rows])
        ids = pa.array([r[0] for r in rows], id_type)
        return pa.RecordBatch.from_arrays([ids, list_column(sums)], names=[id_col, out_col])

    states = h.select(id_col, "_q", "_n", "h").mapInArrow(part, state)
    return states.repartition(id_col).sortWithinPartitions(id_col).mapInArrow(merge, result)


def vector_dim(vectors: DataFrame, vec_col: str = "vec") -> DataFrame:
    """Most common vector length and the number of vectors."""
    return vectors.agg(F.mode(F.size(vec_col)).cast("long").alias("dim"),
                       F.count(F.lit(1)).alias("n_vectors"))
