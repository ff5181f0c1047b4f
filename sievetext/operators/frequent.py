"""Look-ups answered where the rows lie, by the frequent rows of a large table.

Word frequencies are Zipfian: a bounded set of frequent keys (the caller bounds
it) answers most occurrences.  That set goes to the Python workers once, as
Arrow keys and NumPy values; a batch of texts is looked up in it as it is, so
its items are never exploded.  Only the other items become rows, are joined with
the whole table and brought back to their text.  Nothing is capped or dropped.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize

#: Texts that are looked up at a time, and vectors that are gathered at a time.
SLICE_TEXTS = 2_048
SLICE_ITEMS = 16_384
#: Vectors that are weighted at a time: few enough for a core's cache.
STATE_ITEMS = 4_096
#: Longer keys are never sent to the workers; the join answers them.
KEY_BYTES = 256


# ---------------------------------------------------------------- ids

class LocalIndex:
    """The frequent rows ``(token, id)`` of a word index, sent to the workers.
    ``whole``: they are all the rows that count, so other tokens are unknown."""

    def __init__(self, hot: DataFrame, whole: bool = False):
        at = hot.where(F.octet_length("token") <= KEY_BYTES).select("token", "id").toArrow()
        tokens, ids = (pa.chunked_array(at.column(c).chunks, at.column(c).type).combine_chunks() for c in ("token", "id"))
        self.whole = whole and len(tokens) == hot.count()
        self.bc = hot.sparkSession.sparkContext.broadcast({"token": tokens, "id": ids})


def _lists(values: pa.Array, lens: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _items(rb: pa.RecordBatch, col: str):
    """Items of a batch, the row of each and the number of items by row (a null
    list has none)."""
    lists = rb.column(col)
    lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.list_flatten(lists), np.repeat(np.arange(len(lens)), lens), lens


def _sliced(batches):
    for rb in batches:
        for a in range(0, rb.num_rows, SLICE_TEXTS):
            yield rb.slice(a, SLICE_TEXTS)


def indexed_items(df: DataFrame, index: DataFrame, local: LocalIndex, items: Column, id_col: str, key: str,
                  value: str, keep: Sequence[str] = (), missing=None, whole: bool = False,
                  below: int | None = None) -> DataFrame:
    """``id, *keep, _items``: the ``value`` of every item of a row in order, as
    ``explode`` -> left join on ``key`` -> ``collect_list`` by ``id`` gives it
    (rows that share an id are merged by position).  ``missing`` stands for an
    item that the index lacks, and for ids that are not ``below``; null items are
    left out."""
    bc, other = local.bc, "id" if key == "token" else "token"
    whole = whole and local.whole
    kinds = {"token": T.StringType(), "id": T.LongType()}
    source = df.select(id_col, *keep, items.alias("_in"))
    schema = T.StructType([*[source.schema[c] for c in (id_col, *keep)],
                           T.StructField("_found", T.ArrayType(kinds[other])),
                           T.StructField("_at", T.ArrayType(T.IntegerType())),
                           T.StructField("_rest", T.ArrayType(kinds[key]))])

    def run(batches):
        keys, values = bc.value[key], bc.value[other]
        if below is not None:
            values = pc.if_else(pc.less(values, below), values, missing)
        for rb in _sliced(batches):
            flat, rows, lens = _items(rb, "_in")
            hit = pc.index_in(flat, value_set=keys.cast(flat.type))
            found = values.take(hit)
            rest = pc.and_(pc.is_null(hit), pc.is_valid(flat))
            if whole:
                found = pc.if_else(rest, pa.scalar(missing, found.type), found)
                rest = pa.array(np.zeros(len(flat), bool))
            mask = rest.to_numpy(zero_copy_only=False)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
            n_rest = np.bincount(rows[mask], minlength=len(lens))
            yield pa.RecordBatch.from_arrays(
                [*[rb.column(c) for c in (id_col, *keep)], _lists(found, lens),
                 _lists(pa.array(pos[mask].astype(np.int32)), n_rest), _lists(flat.filter(rest), n_rest)],
                names=[id_col, *keep, "_found", "_at", "_rest"])

    found = source.mapInArrow(run, schema)
    if not whole:
        found = materialize(found, "looked-up")  # read twice: what was found, and the rest
    rows = found.select(id_col, *keep, "_found", F.lit(None).cast("int").alias("_p"),
                        F.lit(None).cast(kinds[other]).alias("_w"))
    if not whole:
        rest = found.select(id_col, F.explode(F.arrays_zip("_at", "_rest")).alias("_r")).select(
            id_col, F.col("_r._at").alias("_p"), F.col("_r._rest").alias("_k"))
        table = index.select(F.col(key).alias("_k"), F.col(value).alias("_w"))
        if below is not None:
            table = table.where(F.col("_w") < below)
        rest = rest.join(table, "_k", "left").select(
            id_col, "_p", F.coalesce("_w", F.lit(missing).cast(kinds[other])).alias("_w"))
        rows = rows.unionByName(rest, allowMissingColumns=True)
    pair = F.when(F.col("_p").isNotNull(), F.struct(F.col("_p").alias("p"), F.col("_w").alias("w")))
    g = rows.groupBy(id_col).agg(F.collect_list("_found").alias("_l"), F.collect_list(pair).alias("_r"),
                                 *[F.first(c, ignorenulls=True).alias(c) for c in keep])
    placed = F.flatten(F.transform("_l", lambda a: F.filter(
        F.transform(a, lambda x, i: F.struct(i.alias("p"), x.alias("w"))), lambda x: x.w.isNotNull())))
    merged = F.array_sort(F.concat(placed, "_r"))
    plain = (F.size("_l") == 1) & (F.size("_r") == 0)
    return g.select(id_col, *keep, F.when(plain, F.array_compact(F.get("_l", F.lit(0)))).otherwise(
        merged["w"]).alias("_items"))


# ---------------------------------------------------------------- vectors

def packed(vec: str | Column = "vec") -> list[Column]:
    """A vector column as two: ``_f`` single precision where that is exact, else
    ``_d``; half the bytes of vectors that come from floats."""
    vec = F.col(vec) if isinstance(vec, str) else vec
    single = vec.cast("array<float>")
    exact = F.coalesce(single.cast("array<double>") == vec, F.lit(False))
    return [F.when(exact, single).alias("_f"), F.when(~exact, vec).alias("_d")]


def unpacked() -> Column:
    return F.coalesce(F.col("_f").cast("array<double>"), F.col("_d"))


def vectors_of(rb, dim: int, fill: np.ndarray) -> np.ndarray:
    """The packed vectors of a batch (n x dim); ``fill`` where there is none."""
    out = np.empty((rb.num_rows, dim))
    out[:] = fill
    for name in ("_f", "_d"):
        col = rb.column(name)
        if col.null_count < len(col):
            valid = pc.is_valid(col).to_numpy(zero_copy_only=False)
            out[valid] = pc.list_flatten(col).to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out


class Rows:
    """A matrix by row number: single precision where that is exact, the few other
    rows (``odd``, ascending) beside it.  Row -1 is ``fill``."""

    def __init__(self, single: np.ndarray, odd: np.ndarray, exact: np.ndarray, fill: np.ndarray):
        self.single = single
        self.odd = np.concatenate([[-1], odd]).astype(np.int64)
        self.exact = np.concatenate([np.asarray(fill, np.float64)[None], exact])

    @property
    def dim(self) -> int:
        return self.exact.shape[1]

    def take(self, idx: np.ndarray) -> np.ndarray:
        """float64 rows (len(idx) x dim)."""
        if len(self.single):
            out = self.single.take(idx, axis=0, mode="wrap").astype(np.float64)
        else:
            out = np.zeros((len(idx), self.dim))
        at = np.searchsorted(self.odd, idx)
        at[at == len(self.odd)] = 0
        hit = self.odd[at] == idx
        out[hit] = self.exact[at[hit]]
        return out


def fill_vector(spark, dim: int, unk: Column | None) -> np.ndarray:
    """The vector of items that the table lacks."""
    return np.zeros(dim) if unk is None else np.asarray(spark.range(1).select(unk.alias("v")).first()["v"], np.float64)


def collected_rows(table: DataFrame, key: str, dim: int, fill: np.ndarray, by_key: bool = False) -> tuple[pa.Array, Rows]:
    """``(keys, Rows)`` of a bounded table ``(key, vec)`` on the driver.  Tasks pack
    and write the vectors, and the driver reads what was written a partition at a time
    into one matrix, so it holds no second copy.  ``by_key``: a vector's row number is
    its key, rows without a key are zeros."""
    source = table.dropDuplicates([key]).select(key, *packed())
    schema = T.StructType([T.StructField("_keys", T.ArrayType(source.schema[key].dataType)), T.StructField("_single", T.BinaryType()),
                           T.StructField("_odd", T.ArrayType(T.IntegerType())), T.StructField("_exact", T.BinaryType())])

    def pack(batches):
        for rb in batches:
            for a in range(0, rb.num_rows, SLICE_ITEMS):
                part = rb.slice(a, SLICE_ITEMS)
                f = part.column("_f")
                valid = pc.is_valid(f).to_numpy(zero_copy_only=False)
                single = np.zeros((len(f), dim), np.float32)
                single[valid] = pc.list_flatten(f).to_numpy(zero_copy_only=False).reshape(-1, dim)
                odd = np.flatnonzero(~valid)
                exact = vectors_of(part.take(pa.array(odd)), dim, fill)
                yield pa.RecordBatch.from_arrays(
                    [_lists(part.column(key), np.array([len(f)])), pa.array([single.tobytes()], pa.binary()),
                     _lists(pa.array(odd.astype(np.int32)), np.array([len(odd)])), pa.array([exact.tobytes()], pa.binary())],
                    names=schema.names)

    written = materialize(source.mapInArrow(pack, schema), "sent-vectors")
    n = written.agg(F.max(F.array_max("_keys")) + 1 if by_key else F.sum(F.size("_keys"))).first()[0] or 0
    single, keys, odd, exact, at = np.zeros((n, dim), np.float32), [], [np.zeros(0, np.int64)], [np.zeros((0, dim))], 0
    for row in written.toLocalIterator():
        keys.append(pa.array(row["_keys"], to_arrow_type(source.schema[key].dataType)))
        to = keys[-1].to_numpy(zero_copy_only=False) if by_key else np.arange(at, at + len(keys[-1]))
        single[to] = np.frombuffer(row["_single"], np.float32).reshape(-1, dim)
        odd.append(to[np.asarray(row["_odd"], np.int64)])
        exact.append(np.frombuffer(row["_exact"]).reshape(-1, dim))
        at += len(to)
    odd, exact = np.concatenate(odd), np.concatenate(exact)
    order = np.argsort(odd)
    keys = pa.concat_arrays(keys) if keys else pa.array([], to_arrow_type(source.schema[key].dataType))
    return keys, Rows(single, odd[order], exact[order], fill)


def hot_rows(hot: DataFrame, key: str, dim: int, fill: np.ndarray):
    """``(keys, Rows)`` of the frequent vectors as a Spark broadcast."""
    return hot.sparkSession.sparkContext.broadcast(collected_rows(hot, key, dim, fill))


def _counted(codes: np.ndarray, rows: np.ndarray, n: int, size: int):
    """Distinct ``(row, code)`` pairs with their counts, and the pairs by row."""
    pairs, times = np.unique(rows * size + codes, return_counts=True)
    at = pairs // size
    return at, pairs % size, times, np.bincount(at, minlength=n)


def _rest_items(flat: pa.Array, rows: np.ndarray, mask: np.ndarray, n: int):
    """Lists by row of the distinct items under ``mask`` and of their counts."""
    rest = flat.filter(pa.array(mask)).dictionary_encode()
    code = rest.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, code, times, lens = _counted(code, rows[mask], n, max(1, len(rest.dictionary)))
    return _lists(rest.dictionary.take(pa.array(code)), lens), _lists(pa.array(times.astype(np.int64)), lens)


def _codes(flat: pa.Array, keys: pa.Array):
    """Row numbers of the items among ``keys`` (-1: not there) and which items are to
    be joined."""
    hit = pc.index_in(flat, value_set=keys.cast(flat.type))
    codes = pc.fill_null(hit, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    valid = pc.is_valid(flat).to_numpy(zero_copy_only=False)
    return codes, valid & (codes < 0), valid


def _runs(codes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))


def _numbers(col) -> np.ndarray:
    """Equal numbers for equal values of a column."""
    coded = col.dictionary_encode()
    return coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)


def hot_mean(df: DataFrame, table: DataFrame, hot: DataFrame, dim: int, id_col: str, items: Column, key: str,
             unk: Column | None, keep: Sequence[str], out_col: str) -> DataFrame:
    """Mean of the vectors of each row's items: frequent items are summed where the
    row lies, the vectors of the others are brought to that sum, next to each
    other after one shuffle, and added one batch after the other.  Rows that
    share an id are one, as in the plain join."""
    from .model import list_column

    fill = fill_vector(df.sparkSession, dim, unk)
    bc = hot_rows(hot, key, dim, fill)
    source = df.select(id_col, *keep, items.alias("_in"))
    own = [source.schema[c] for c in (id_col, *keep)]
    names = [f.name for f in own]
    schema = T.StructType([*own, T.StructField("_n", T.LongType()), T.StructField("_d", T.ArrayType(T.DoubleType())),
                           T.StructField("_rest", source.schema["_in"].dataType),
                           T.StructField("_times", T.ArrayType(T.LongType()))])

    def run(batches):
        keys, M = bc.value
        for rb in _sliced(batches):
            flat, rows, lens = _items(rb, "_in")
            codes, rest, valid = _codes(flat, keys)
            at, code, times, _ = _counted(codes[codes >= 0], rows[codes >= 0], len(lens), len(keys) + 1)
            sums = np.zeros((len(lens), dim))
            for a in range(0, len(at), SLICE_ITEMS):
                part = slice(a, a + SLICE_ITEMS)
                first = _runs(at[part])
                sums[at[part][first]] += np.add.reduceat(M.take(code[part]) * times[part, None], first, axis=0)
            yield pa.RecordBatch.from_arrays(
                [*[rb.column(c) for c in names], pa.array(np.bincount(rows[valid], minlength=len(lens)).astype(np.int64)),
                 list_column(sums), *_rest_items(flat, rows, rest, len(lens))],
                names=[*names, "_n", "_d", "_rest", "_times"])

    local = materialize(source.mapInArrow(run, schema), "pooled-frequent")
    rest = local.select(id_col, F.explode(F.arrays_zip("_rest", "_times")).alias("_r")).select(
        id_col, F.col("_r._rest").alias("_k"), F.col("_r._times").alias("_times"))
    vecs = rest.join(table.select(F.col(key).alias("_k"), *packed()), "_k", "left").select(
        id_col, F.lit(1).alias("_kind"), "_times", "_f", "_d")
    heads = local.select(*names, F.lit(0).alias("_kind"), "_n", F.lit(1).cast("long").alias("_times"), "_d")
    rows = heads.unionByName(vecs, allowMissingColumns=True)

    def merge(batches):
        held = None  # head, id, count and sum of the row that may go on

        def out(heads, n, sums):
            return pa.RecordBatch.from_arrays([*[heads.column(c) for c in names], list_column(sums / np.maximum(n, 1)[:, None])],
                                              names=[*names, out_col])

        for rb in batches:
            if not rb.num_rows:
                continue
            first = _runs(_numbers(rb.column(id_col)))
            times = rb.column("_times").to_numpy(zero_copy_only=False).astype(np.float64)
            n = np.add.reduceat(pc.fill_null(rb.column("_n"), 0).to_numpy(zero_copy_only=False), first)
            sums = np.add.reduceat(vectors_of(rb, dim, fill) * times[:, None], first, axis=0)
            heads = rb.select(names).take(pa.array(first))
            ids = [rb.column(id_col)[int(i)].as_py() for i in (first[0], first[-1])]
            start = 0
            if held is not None:
                if held[1] == ids[0]:
                    n[0], sums[0], start = n[0] + held[2][0], sums[0] + held[3][0], 1
                    held = (held[0], held[1], n[:1], sums[:1])
                if start and len(first) == 1:
                    continue
                yield out(held[0], held[2], held[3])
            if len(first) - 1 > start:
                yield out(heads.slice(start, len(first) - 1 - start), n[start:-1], sums[start:-1])
            held = (heads.slice(len(first) - 1), ids[1], n[-1:].copy(), sums[-1:].copy())
        if held is not None:
            yield out(held[0], held[2], held[3])

    result = T.StructType([*own, T.StructField(out_col, T.ArrayType(T.DoubleType()), False)])
    return rows.repartition(id_col).sortWithinPartitions(id_col, "_kind").mapInArrow(merge, result)


def _soft_states(M: Rows, Q: np.ndarray, at: np.ndarray, codes: np.ndarray, times: np.ndarray, n: int):
    """Softmax states by row of items ``codes``, of rows ``at`` (ascending): the
    maximum score with the row's query in ``Q``, the sum of the weights below it and
    the weighted sum of vectors, ``STATE_ITEMS`` vectors at a time."""
    m, z, s = np.full(n, -np.inf), np.zeros(n), np.zeros((n, M.dim))
    for a in range(0, len(at), STATE_ITEMS):
        part = slice(a, a + STATE_ITEMS)
        r, V = at[part], M.take(codes[part])
        first = _runs(r)
        own = r[first]
        scores = np.einsum("td,td->t", V, Q[r])
        top = np.maximum(np.maximum.reduceat(scores, first), m[own])
        e = times[part] * np.exp(scores - np.repeat(top, np.diff(np.append(first, len(r)))))
        old = np.exp(m[own] - top)
        z[own] = z[own] * old + np.add.reduceat(e, first)
        s[own] = s[own] * old[:, None] + np.add.reduceat(V * e[:, None], first, axis=0)
        m[own] = top
    return m, z, s


def _merged(m: np.ndarray, z: np.ndarray, s: np.ndarray, first: np.ndarray):
    """Softmax states of the runs that begin at ``first`` as one each."""
    top = np.maximum.reduceat(m, first)
    base = np.where(np.isneginf(top), 0.0, top)  # a run without items
    f = np.exp(m - np.repeat(base, np.diff(np.append(first, len(m)))))
    return top, np.add.reduceat(z * f, first), np.add.reduceat(s * f[:, None], first, axis=0)


def hot_attention(df: DataFrame, table: DataFrame, hot: DataFrame, dim: int, id_col: str, items: Column, key: str,
                  unk: Column | None, out_col: str) -> DataFrame:
    """Softmax attention with the last item's vector as the query, online: the
    maximum score, the sum of the weights and the weighted sum of a row's frequent
    items are made where the row lies, if its query is frequent.  That state, the
    query and the vectors of the other items meet after one shuffle, a query that
    is not frequent first, and are merged a batch at a time; only rows with such a
    query bring their frequent items (row numbers of the broadcast vectors)."""
    from .model import list_column

    fill = fill_vector(df.sparkSession, dim, unk)
    bc = hot_rows(hot, key, dim, fill)
    source = df.select(id_col, items.alias("_in"))
    id_field = source.schema[id_col]
    kind = source.schema["_in"].dataType
    ints = T.ArrayType(T.LongType())
    schema = T.StructType([id_field, T.StructField("_last", T.LongType()), T.StructField("_query", kind.elementType),
                           T.StructField("_m", T.DoubleType()), T.StructField("_z", T.DoubleType()),
                           T.StructField("_d", T.ArrayType(T.DoubleType())),
                           T.StructField("_codes", ints), T.StructField("_counts", ints),
                           T.StructField("_rest", kind), T.StructField("_times", ints)])

    def run(batches):
        keys, M = bc.value
        for rb in _sliced(batches):
            flat, rows, lens = _items(rb, "_in")
            codes, rest, valid = _codes(flat, keys)
            at, code, times, _ = _counted(codes[codes >= 0], rows[codes >= 0], len(lens), len(keys) + 1)
            ends = (np.cumsum(lens) - 1)[lens > 0]
            last = np.full(len(lens), -2)  # no query: a vector of zeros
            last[lens > 0] = np.where(valid[ends], codes[ends], -2)
            query = np.zeros(len(lens), np.int64)
            query[lens > 0] = ends
            asked = flat.take(pa.array(query, mask=last != -1))
            Q = np.zeros((len(lens), dim))
            Q[last >= 0] = M.take(last[last >= 0])
            here = last[at] != -1
            m, z, s = _soft_states(M, Q, at[here], code[here], times[here], len(lens))
            n = np.bincount(at[~here], minlength=len(lens))
            yield pa.RecordBatch.from_arrays(
                [rb.column(id_col), pa.array(last), asked, pa.array(m), pa.array(z), list_column(s),
                 _lists(pa.array(code[~here]), n), _lists(pa.array(times[~here].astype(np.int64)), n),
                 *_rest_items(flat, rows, rest, len(lens))],
                names=schema.names)

    local = materialize(source.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "frequent-items")
    asked = local.where(F.col("_last") == -1).select(id_col, "_row", F.lit(0).alias("_kind"),
                                                     F.col("_query").alias("_k"), F.lit(0).cast("long").alias("_times"))
    others = local.select(id_col, "_row", F.lit(2).alias("_kind"), F.explode(F.arrays_zip("_rest", "_times")).alias("_r")).select(
        id_col, "_row", "_kind", F.col("_r._rest").alias("_k"), F.col("_r._times").alias("_times"))
    vecs = asked.unionByName(others).join(table.select(F.col(key).alias("_k"), *packed()), "_k", "left").drop("_k")
    heads = local.select(id_col, "_row", F.lit(1).alias("_kind"), "_last", "_m", "_z", "_d", "_codes", "_counts")
    rows = heads.unionByName(vecs, allowMissingColumns=True)

    def merge(batches):
        _, M = bc.value
        held = None  # the id that may go on and its state, its last text and that text's query

        def out(ids, z, s):
            return pa.RecordBatch.from_arrays([ids, list_column(s / np.where(z > 0, z, 1.0)[:, None])], names=[id_col, out_col])

        for rb in batches:
            if not rb.num_rows:
                continue
            V = vectors_of(rb, dim, fill)
            kinds, at = (rb.column(c).to_numpy(zero_copy_only=False) for c in ("_kind", "_row"))
            times = pc.fill_null(rb.column("_times"), 0).to_numpy(zero_copy_only=False).astype(np.float64)
            last = pc.fill_null(rb.column("_last"), -2).to_numpy(zero_copy_only=False)
            m = pc.fill_null(rb.column("_m"), -np.inf).to_numpy(zero_copy_only=False).copy()
            z = pc.fill_null(rb.column("_z"), 0.0).to_numpy(zero_copy_only=False).copy()
            texts = _runs(at)
            text = np.repeat(np.arange(len(texts)), np.diff(np.append(texts, len(at))))
            Q = np.zeros((len(texts), dim))
            if held is not None and held[4] == at[0]:
                Q[0] = held[5]
            asked, known, late, rest = (np.flatnonzero(x) for x in (
                kinds == 0, last >= 0, last == -1, kinds == 2))
            Q[text[known]] = M.take(last[known])
            Q[text[asked]] = V[asked]
            V[asked] = 0.0
            if len(late):
                lists = rb.select(["_codes", "_counts"]).take(pa.array(late))
                code, own, _ = _items(lists, "_codes")
                n = lists.column("_counts").flatten().to_numpy(zero_copy_only=False)
                m[late], z[late], V[late] = _soft_states(M, Q[text[late]], own, code.to_numpy(zero_copy_only=False), n, len(late))
            m[rest], z[rest] = np.einsum("td,td->t", V[rest], Q[text[rest]]), times[rest]
            V[rest] *= times[rest, None]
            first = _runs(_numbers(rb.column(id_col)))
            ids = rb.column(id_col).take(pa.array(first))
            m, z, s = _merged(m, z, V, first)
            if held is not None:
                if held[0][0].as_py() == ids[0].as_py():
                    m[:1], z[:1], s[:1] = _merged(*(np.concatenate([x, y[:1]]) for x, y in zip(held[1:4], (m, z, s), strict=True)),
                                                  np.zeros(1, np.int64))
                else:
                    yield out(held[0], held[2], held[3])
            if len(ids) > 1:
                yield out(ids.slice(0, len(ids) - 1), z[:-1], s[:-1])
            held = ids.slice(len(ids) - 1), m[-1:].copy(), z[-1:].copy(), s[-1:].copy(), at[-1], Q[-1].copy()
        if held is not None:
            yield out(held[0], held[2], held[3])

    result = T.StructType([id_field, T.StructField(out_col, T.ArrayType(T.DoubleType()), False)])
    return rows.repartition(id_col).sortWithinPartitions(id_col, "_row", "_kind").mapInArrow(merge, result)


def hot_sequences(df: DataFrame, lookup: DataFrame, bc, dim: int, id_col: str, ids_col: str,
                  keep: Sequence[str]) -> DataFrame:
    """``id, *keep, _codes, _at, _x`` of fixed-length id rows, written: the row
    numbers of their frequent ids in the broadcast vectors (-1: not there), and
    the positions and vectors (binary; single precision where exact) of the
    others, so a pass over the rows needs no join."""
    own = [df.schema[c] for c in (id_col, *keep)]
    names = [f.name for f in own]
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    coded = [T.StructField("_codes", ints), T.StructField("_at", ints)]

    def run(batches):
        keys, _ = bc.value
        for rb in _sliced(batches):
            flat, rows, lens = _items(rb, ids_col)
            codes, rest, _ = _codes(flat, keys)
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
            n = np.bincount(rows[rest], minlength=len(lens))
            yield pa.RecordBatch.from_arrays(
                [*[rb.column(c) for c in names], _lists(pa.array(codes.astype(np.int32)), lens),
                 _lists(pa.array(pos[rest].astype(np.int32)), n), _lists(flat.filter(pa.array(rest)), n)],
                names=[*names, "_codes", "_at", "_rest"])

    schema = T.StructType([*own, *coded, T.StructField("_rest", longs)])
    local = materialize(df.select(*names, ids_col).mapInArrow(run, schema)
                        .withColumn("_row", F.monotonically_increasing_id()), "frequent-ids")
    rest = local.select("_row", F.explode(F.arrays_zip("_at", "_rest")).alias("_r")).select(
        "_row", F.col("_r._at").alias("_pos"), F.col("_r._rest").alias("_wid"))
    vecs = rest.join(lookup.select(F.col("id").alias("_wid"), *packed()), "_wid", "left").drop("_wid")
    heads = local.select("_row", F.lit(-1).alias("_pos"), *names, "_codes")
    rows = heads.unionByName(vecs, allowMissingColumns=True)
    zeros = np.zeros(dim)

    def pack(table):
        """Whole rows, each a head and then its vectors."""
        pos = table.column("_pos").to_numpy(zero_copy_only=False)
        head = np.flatnonzero(pos == -1)
        ends = np.append(head[1:], len(pos))
        V = vectors_of(table, dim, zeros)
        V32 = V.astype(np.float32)
        single = np.append(0, np.cumsum((V32 != V).any(axis=1)))  # rows that are not, so far
        x = [(V32 if single[a + 1] == single[b] else V)[a + 1:b].tobytes() for a, b in zip(head, ends, strict=True)]
        return pa.RecordBatch.from_arrays(
            [*[table.column(c).take(pa.array(head)) for c in (*names, "_codes")],
             _lists(pa.array(pos[pos >= 0].astype(np.int32)), ends - head - 1), pa.array(x, pa.binary())],
            names=[*names, "_codes", "_at", "_x"])

    def join(batches):
        held = None
        for rb in batches:
            if not rb.num_rows:
                continue
            if held is not None:
                rb = pa.Table.from_batches([held, rb]).combine_chunks().to_batches()[0]
            start = int(np.flatnonzero(rb.column("_pos").to_numpy(zero_copy_only=False) == -1)[-1])
            if start:
                yield pack(rb.slice(0, start))
            held = rb.slice(start)
        if held is not None:
            yield pack(held)

    result = T.StructType([*own, *coded, T.StructField("_x", T.BinaryType())])
    return materialize(rows.repartition("_row").sortWithinPartitions("_row", "_pos").mapInArrow(join, result), "sequences")


def sequence_inputs(rb, M: Rows, dim: int, length: int) -> np.ndarray:
    """The vectors (n x length x dim) of a batch of :func:`hot_sequences`."""
    codes = rb.column("_codes").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = rb.num_rows
    out = M.take(codes).reshape(n, length, dim)
    pos, rows, lens = _items(rb, "_at")
    if len(rows):
        parts = [np.frombuffer(x, np.float32 if len(x) == 4 * dim * k else np.float64).astype(np.float64)
                 for x, k in zip(rb.column("_x").to_pylist(), lens.tolist(), strict=True) if k]
        out[rows, pos.to_numpy(zero_copy_only=False)] = np.concatenate(parts).reshape(-1, dim)
    return out
