"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame
computed over the whole given tables.  ``ORACLES`` holds the equivalent
DuckDB SQL where the result is SQL-expressible.

Array results are emitted as blank-joined strings and floats rounded to 6
decimals so both engines print the same values.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import sqlref as S
from .functions.text import normalize, python_tokenizer, sql_normalize, tokenize
from .operators.encode import decode_ids, encode_capped, encode_fixed, ids_to_string, pad_left
from .operators.labels import class_count
from .operators.vocab import frequency_index, token_counts
from .plans.prepare import prepare
from .sources.tables import documents, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = (S.corpus_cte(), S.toks_cte())
INDEX = BASE + (S.VOCAB_CTE, S.WORD_INDEX_CTE)


def _prep(spark: SparkSession, sf_dir: str, label: str = "lang"):
    return prepare(spark, sf_dir, label=label)


# ---------------------------------------------------------------- text

@query("normalize_text", f"""
SELECT doc_id, {S.normalize('text')} AS norm_text FROM documents""")
def q_normalize_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", normalize("text").alias("norm_text"))


@query("tokenize_docs", _with(*BASE) + """
SELECT id AS doc_id, array_to_string(tokens, ' ') AS tokens, CAST(len(tokens) AS BIGINT) AS n_tokens
FROM toks""")
def q_tokenize_docs(spark, sf_dir):
    docs = documents(spark, sf_dir).where(F.col("text").isNotNull())
    toks = docs.select("doc_id", tokenize("text").alias("_t"))
    return toks.select("doc_id", F.array_join("_t", " ").alias("tokens"),
                       F.size("_t").cast("long").alias("n_tokens"))


def _letters_and_others(text: str) -> list[str]:
    """A user's tokeniser: runs of a-z, and runs of anything else but blanks."""
    return re.findall("[a-z]+|[^a-z ]+", text)


@query("tokenize_user", f"""
SELECT doc_id, array_to_string(t, ' ') AS tokens, CAST(len(t) AS BIGINT) AS n_tokens
FROM (SELECT doc_id, regexp_extract_all({sql_normalize("text")}, '[a-z]+|[^a-z ]+') AS t FROM documents
      WHERE text IS NOT NULL)""")
def q_tokenize_user(spark, sf_dir):
    """Tokens by a function of the user's own (F1)."""
    docs = documents(spark, sf_dir).where(F.col("text").isNotNull())
    toks = docs.select("doc_id", tokenize("text", python_tokenizer(_letters_and_others)).alias("_t"))
    return toks.select("doc_id", F.array_join("_t", " ").alias("tokens"),
                       F.size("_t").cast("long").alias("n_tokens"))


# ---------------------------------------------------------------- corpus, labels

@query("labeled_corpus", _with(S.corpus_cte()) + """
SELECT id, text, label, y, split FROM corpus""")
def q_labeled_corpus(spark, sf_dir):
    return _prep(spark, sf_dir).corpus.select("id", "text", "label", "y", "split")


@query("corpus_audit", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (text IS NULL) AS BIGINT) AS n_without_text,
       CAST(count(*) FILTER (lang IS NULL AND text IS NOT NULL) AS BIGINT) AS n_without_label,
       CAST(count(*) FILTER (lang IS NOT NULL AND text IS NOT NULL) AS BIGINT) AS n_kept FROM documents""")
def q_corpus_audit(spark, sf_dir):
    from .sources.tables import corpus_audit

    return corpus_audit(spark, sf_dir)


@query("label_codes", _with(S.corpus_cte()) + """
SELECT label, y AS code, CAST(count(*) AS BIGINT) AS n_rows FROM corpus GROUP BY label, y""")
def q_label_codes(spark, sf_dir):
    return (_prep(spark, sf_dir).corpus.groupBy("label", F.col("y").alias("code"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


@query("class_count", """
SELECT CAST(count(DISTINCT lang) AS BIGINT) AS num_classes, max(lang) AS max_label
FROM documents WHERE text IS NOT NULL""")
def q_class_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return class_count(docs, "lang")


# ---------------------------------------------------------------- vocabulary

@query("vocab", _with(*BASE, S.VOCAB_CTE) + "SELECT token FROM vocab")
def q_vocab(spark, sf_dir):
    return _prep(spark, sf_dir).vocab


@query("word_index", _with(*INDEX) + "SELECT token, id FROM word_index")
def q_word_index(spark, sf_dir):
    return _prep(spark, sf_dir).index


# ---------------------------------------------------------------- encoding

@query("encode_fixed", _with(*INDEX, S.encode_ctes(256)) + """
SELECT e.id, e.y, c.split, array_to_string(e.ids, ' ') AS ids
FROM enc e JOIN corpus c ON e.id = c.id""")
def q_encode_fixed(spark, sf_dir):
    p = _prep(spark, sf_dir)
    enc = encode_fixed(p.tokens, p.index, 256, keep=("y", "split"), hot=p.lookup_hot())
    return enc.select("id", "y", "split", ids_to_string("ids").alias("ids"))


@query("decode_ids", _with(*INDEX, S.encode_ctes(256)) + """,
dec AS (
  SELECT e.id, list(w.token ORDER BY u.pos) AS toks
  FROM enc e, unnest(e.ids) WITH ORDINALITY AS u(wid, pos)
  LEFT JOIN word_index w ON u.wid = w.id GROUP BY e.id)
SELECT id, array_to_string(toks, ' ') AS text FROM dec""")
def q_decode_ids(spark, sf_dir):
    p = _prep(spark, sf_dir)
    hot = p.lookup_hot()
    enc = encode_fixed(p.tokens, p.index, 256, hot=hot)
    dec = decode_ids(enc, p.index, hot=hot)
    return dec.select("id", F.array_join("tokens", " ").alias("text"))


@query("pad_left", _with(*INDEX) + """,
ex AS (SELECT t.id, u.token, u.pos FROM toks t, unnest(t.tokens) WITH ORDINALITY AS u(token, pos)),
seqs AS (
  SELECT t.id, coalesce(list(coalesce(w.id, 3) ORDER BY e.pos) FILTER (WHERE e.pos IS NOT NULL), []::BIGINT[]) AS s
  FROM toks t LEFT JOIN ex e ON t.id = e.id LEFT JOIN word_index w ON e.token = w.token GROUP BY t.id)
SELECT id, array_to_string(CASE WHEN len(s) >= 256 THEN list_slice(s, len(s) - 255, len(s))
       ELSE list_concat(list_transform(range(256 - len(s)), lambda x: 0::BIGINT), s) END, ' ') AS ids
FROM seqs""")
def q_pad_left(spark, sf_dir):
    from .operators.encode import word_ids

    p = _prep(spark, sf_dir)
    # the operator keeps the last 256 ids, so only those tokens are looked up
    n = F.least(F.size("tokens"), F.lit(256))
    last = p.tokens.withColumn("tokens", F.when(n > 0, F.slice("tokens", -n, n)).otherwise(F.col("tokens")))
    seqs = word_ids(last, p.index, hot=p.lookup_hot())
    return seqs.select("id", ids_to_string(pad_left("ids", 256)).alias("ids"))


def _capped_sql(splits: str) -> str:
    """Capped, left-padded sequences ``seqs(id, s)``; the index counts ``splits``."""
    return _with(*BASE) + f""",
counts AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(tokens) AS token FROM toks
           WHERE split IN ({splits})) GROUP BY token),
findex AS (SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token) + 3 AS BIGINT) AS id FROM counts),
last AS (
  SELECT id, len(tokens) AS n,
         CASE WHEN len(tokens) = 0 THEN []::VARCHAR[]
              ELSE list_slice(tokens, len(tokens) - least(len(tokens), 128) + 1, len(tokens)) END AS lt
  FROM toks),
ex AS (SELECT l.id, u.token, u.pos FROM last l, unnest(l.lt) WITH ORDINALITY AS u(token, pos)),
mapped AS (
  SELECT l.id, l.n,
         coalesce(list(CASE WHEN f.id IS NULL OR f.id >= 1000 THEN 2 ELSE f.id END ORDER BY e.pos)
                  FILTER (WHERE e.pos IS NOT NULL), []::BIGINT[]) AS ids
  FROM last l LEFT JOIN ex e ON l.id = e.id LEFT JOIN findex f ON e.token = f.token GROUP BY l.id, l.n),
seqs AS (SELECT id, CASE WHEN n + 1 <= 128 THEN list_concat([1::BIGINT], ids) ELSE ids END AS s FROM mapped)
"""


_CAPPED_IDS = ("array_to_string(list_concat(list_transform(range(128 - len(s)), lambda x: 0::BIGINT), s), ' ') AS ids")


@query("encode_capped", _capped_sql("'train', 'dev'") + f"SELECT id, {_CAPPED_IDS} FROM seqs")
def q_encode_capped(spark, sf_dir):
    from .plans.prepare import capped_ids
    from .session import materialize

    p = _prep(spark, sf_dir)
    counts = token_counts(p.tokens.where(F.col("split").isin("train", "dev")))
    findex = materialize(frequency_index(counts, specials=()), "frequency-index")
    enc = encode_capped(p.tokens, findex, num_words=1000, max_len=128, hot=capped_ids(findex, 1000))
    return enc.select("id", ids_to_string("ids").alias("ids"))


@query("capped_index", _capped_sql("'train', 'dev'") + "SELECT token, id FROM findex WHERE id < 300")
def q_capped_index(spark, sf_dir):
    """The part of the frequency index that a cap of 300 words keeps (T8), by heavy hitters."""
    from .operators.vocab import capped_index

    p = _prep(spark, sf_dir)
    return capped_index(p.tokens.where(F.col("split").isin("train", "dev")), num_words=300)


@query("load_multiclass", _capped_sql("'train', 'test'") + f""",
padded AS (SELECT seqs.id, toks.y, toks.split, {_CAPPED_IDS} FROM seqs JOIN toks ON seqs.id = toks.id),
whole AS (
  SELECT t.id, t.y, t.split, array_to_string(list_concat([1::BIGINT], coalesce(
    list(CASE WHEN f.id IS NULL OR f.id >= 1000 THEN 2 ELSE f.id END ORDER BY e.pos) FILTER (WHERE e.pos IS NOT NULL),
    []::BIGINT[])), ' ') AS ids
  FROM toks t LEFT JOIN (SELECT t.id, u.token, u.pos FROM toks t, unnest(t.tokens) WITH ORDINALITY AS u(token, pos)) e
    ON t.id = e.id LEFT JOIN findex f ON e.token = f.token GROUP BY t.id, t.y, t.split),
numbered AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM padded WHERE split = 'train')
SELECT 'train batches' AS part, id, y, CAST(pos // 64 AS BIGINT) AS batch_id, ids FROM numbered WHERE pos < n // 64 * 64
UNION ALL SELECT 'train', id, y, NULL, ids FROM whole WHERE split = 'train'
UNION ALL SELECT 'test', id, y, NULL, ids FROM whole WHERE split = 'test'
UNION ALL SELECT 'test padded', id, y, NULL, ids FROM padded WHERE split = 'test'
UNION ALL SELECT 'index', id, NULL, NULL, token FROM findex
UNION ALL SELECT 'index', id, NULL, NULL, token FROM (VALUES
  ('<PAD>', 0::BIGINT), ('<START>', 1::BIGINT), ('<UNK>', 2::BIGINT), ('<EOS>', 3::BIGINT)) s(token, id)""")
def q_load_multiclass(spark, sf_dir):
    """All five results of the multi-class pre-encoded data set (S5), by part."""
    from .compat import load_data_set_multiclass

    p = _prep(spark, sf_dir)
    rows = [p.tokens.where(F.col("split") == s).select("id", "y", "tokens") for s in ("train", "test")]
    found = load_data_set_multiclass(*rows, max_len=128, vocab_size=1000, batch_size=64)
    none = F.lit(None).cast("long").alias("batch_id")
    out = found[0].select(F.lit("train batches").alias("part"), "id", "y", "batch_id", ids_to_string("ids").alias("ids"))
    for part, df in zip(("train", "test", "test padded"), found[1:4], strict=True):
        out = out.unionByName(df.select(F.lit(part).alias("part"), "id", "y", none, ids_to_string("ids").alias("ids")))
    return out.unionByName(found[4].select(F.lit("index").alias("part"), F.col("id").cast("long").alias("id"),
                                           F.lit(None).cast("int").alias("y"), none, F.col("token").alias("ids")))


@query("encode_with_vocab", _with(*INDEX) + """,
btoks AS (SELECT item_id AS id, NULL::INTEGER AS y, """ + S.sql_tokenize_text() + """ AS tokens
          FROM benchmark WHERE text IS NOT NULL),
""" + S.encode_ctes(256, src="btoks", name="benc") + """
SELECT id AS item_id, array_to_string(ids, ' ') AS ids FROM benc""")
def q_encode_with_vocab(spark, sf_dir):
    p = _prep(spark, sf_dir)
    bench = (table(spark, sf_dir, "benchmark").where(F.col("text").isNotNull())
             .select(F.col("item_id").alias("id"), tokenize("text").alias("tokens")))
    enc = encode_fixed(bench, p.index, 256, hot=p.lookup_hot())
    return enc.select(F.col("id").alias("item_id"), ids_to_string("ids").alias("ids"))


# ---------------------------------------------------------------- noise, complements

def _ord_sql(src: str = "corpus", purpose: str = "shuffle") -> str:
    return f"""ord AS (
  SELECT *, CAST(row_number() OVER (ORDER BY {S.shuffle_key(purpose, 'id')}, id) - 1 AS BIGINT) AS shuffle_pos,
         count(*) OVER () AS n FROM {src})"""


def _noise_sql(kind: str, c: int = 4, ratio: float = 0.3) -> str:
    new = (f"{S.draw('inc', 'id')} % {c}" if kind == "inc"
           else f"(label_clean + 1 + {S.draw('exc', 'id')} % {c - 1}) % {c}")
    return f"""nz AS (
  SELECT id, y AS label_clean, shuffle_pos,
         shuffle_pos >= trunc((1.0::DOUBLE - {ratio}::DOUBLE) * n) AS is_noisy_row FROM ord),
noisy AS (
  SELECT id, label_clean, shuffle_pos, is_noisy_row,
         CAST(CASE WHEN is_noisy_row THEN {new} ELSE label_clean END AS INTEGER) AS label FROM nz)"""


def _noise_spark(spark, sf_dir, kind: str):
    from .operators.noise import inject_noise

    p = _prep(spark, sf_dir)
    return inject_noise(p.corpus.select("id", "y"), p.num_classes, 0.3, kind=kind, label_col="y",
                        with_position=True)


for _kind in ("inc", "exc"):
    def _make(kind):
        def q(spark, sf_dir):
            out = _noise_spark(spark, sf_dir, kind)
            return out.select("id", "label_clean", F.col("y").alias("label"), "is_noisy_row",
                              "is_flipped", "shuffle_pos")
        return q
    query(f"noise_{_kind}", _with(S.corpus_cte(), _ord_sql(), _noise_sql(_kind)) + """
SELECT id, label_clean, label, is_noisy_row, label <> label_clean AS is_flipped, shuffle_pos FROM noisy""")(
        _make(_kind))


@query("noise_split", _with(S.corpus_cte(), _ord_sql()) + """
SELECT id, shuffle_pos, shuffle_pos >= trunc((1.0::DOUBLE - 0.3::DOUBLE) * n) AS is_noisy_row FROM ord""")
def q_noise_split(spark, sf_dir):
    from .operators.order import shuffled_ordinal

    p = _prep(spark, sf_dir)
    o = shuffled_ordinal(p.corpus.select("id"), name="shuffle_pos", total="_n")
    return o.select("id", "shuffle_pos",
                    (F.col("shuffle_pos") >= F.floor(F.lit(1.0 - 0.3) * F.col("_n"))).alias("is_noisy_row"))


@query("noise_sizes", _with(S.corpus_cte(), _ord_sql(), _noise_sql("inc").replace("nz AS", "nzi AS").replace(
    "noisy AS", "noisy_inc AS").replace("FROM nz)", "FROM nzi)"), _noise_sql("exc").replace(
    "nz AS", "nze AS").replace("noisy AS", "noisy_exc AS").replace("FROM nz)", "FROM nze)")) + """
SELECT 'inc' AS kind, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(CASE WHEN is_noisy_row THEN 0 ELSE 1 END) AS BIGINT) AS n_clean,
       CAST(sum(CASE WHEN is_noisy_row THEN 1 ELSE 0 END) AS BIGINT) AS n_noisy,
       CAST(sum(CASE WHEN label <> label_clean THEN 1 ELSE 0 END) AS BIGINT) AS n_flipped FROM noisy_inc
UNION ALL
SELECT 'exc', CAST(count(*) AS BIGINT), CAST(sum(CASE WHEN is_noisy_row THEN 0 ELSE 1 END) AS BIGINT),
       CAST(sum(CASE WHEN is_noisy_row THEN 1 ELSE 0 END) AS BIGINT),
       CAST(sum(CASE WHEN label <> label_clean THEN 1 ELSE 0 END) AS BIGINT) FROM noisy_exc""")
def q_noise_sizes(spark, sf_dir):
    parts = []
    for kind in ("inc", "exc"):
        out = _noise_spark(spark, sf_dir, kind)
        parts.append(out.agg(
            F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.when(F.col("is_noisy_row"), 0).otherwise(1)).cast("long").alias("n_clean"),
            F.sum(F.when(F.col("is_noisy_row"), 1).otherwise(0)).cast("long").alias("n_noisy"),
            F.sum(F.when(F.col("is_flipped"), 1).otherwise(0)).cast("long").alias("n_flipped")))
    return parts[0].unionByName(parts[1])


@query("complement_targets", _with(S.corpus_cte()) + f"""
SELECT id, y, CAST(e.epoch AS INTEGER) AS epoch,
       CAST((y + 1 + {S.draw('comp', 'e.epoch', 'id')} % 3) % 4 AS INTEGER) AS comp
FROM corpus, (VALUES (0), (1), (2)) e(epoch)""")
def q_complement_targets(spark, sf_dir):
    from .operators.noise import complement_label

    p = _prep(spark, sf_dir)
    rows = p.corpus.select("id", "y", F.explode(F.array(*[F.lit(e) for e in range(3)])).alias("epoch"))
    return rows.select("id", "y", "epoch",
                       complement_label("y", p.num_classes, F.col("epoch"), id_col="id").alias("comp"))


# ---------------------------------------------------------------- splits, batches, unions

@query("valid_split", _with(S.corpus_cte(), _ord_sql(purpose="valid")) + """
SELECT id, shuffle_pos AS pos, shuffle_pos >= n - trunc(0.2::DOUBLE * n) AS is_valid FROM ord""")
def q_valid_split(spark, sf_dir):
    from .operators.order import exact_split

    p = _prep(spark, sf_dir)
    return exact_split(p.corpus.select("id"), 0.2, purpose="valid").select("id", "pos", "is_valid")


@query("valid_flags", _with(S.corpus_cte(), _ord_sql(purpose="valid")) + """
SELECT id, shuffle_pos >= n - trunc(0.2::DOUBLE * n) AS is_valid FROM ord""")
def q_valid_flags(spark, sf_dir):
    """The exact share without positions: no row moves."""
    from .operators.order import exact_split

    p = _prep(spark, sf_dir)
    return exact_split(p.corpus.select("id"), 0.2, purpose="valid", with_position=False).select("id", "is_valid")


@query("noise_flags", _with(S.corpus_cte(), _ord_sql(), _noise_sql("exc")) + """
SELECT id, label, is_noisy_row FROM noisy""")
def q_noise_flags(spark, sf_dir):
    """Noise by the dispatcher (N3), without positions."""
    from .operators.noise import generate_noise

    p = _prep(spark, sf_dir)
    out = generate_noise(p.corpus.select("id", "y"), "exc", p.num_classes, 0.3, label_col="y")
    return out.select("id", F.col("y").alias("label"), "is_noisy_row")


TAIL = 250


@query("tail_valid_split", _with(S.corpus_cte()) + f""",
cat AS (SELECT id, CASE WHEN split = 'test' THEN 1 ELSE 0 END AS part FROM corpus),
ord AS (SELECT id, CAST(row_number() OVER (ORDER BY part, id) - 1 AS BIGINT) AS pos,
        count(*) OVER () AS n FROM cat)
SELECT id, pos, pos >= n - {TAIL} AS is_valid FROM ord""")
def q_tail_valid_split(spark, sf_dir):
    from .operators.order import tail_split

    p = _prep(spark, sf_dir)
    train = p.corpus.where(F.col("split") != "test").select("id", F.lit(0).alias("part"))
    test = p.corpus.where(F.col("split") == "test").select("id", F.lit(1).alias("part"))
    cat = train.unionByName(test)
    return tail_split(cat, TAIL, order_by=["part", "id"]).select("id", "pos", "is_valid")


def _batches_sql(drop_last: bool, shuffled: bool) -> str:
    order = f"{S.shuffle_key('shuffle', 'id')}, id" if shuffled else "id"
    where = "WHERE pos < floor(n / 64) * 64" if drop_last else ""
    return _with(S.corpus_cte()) + f""",
ord AS (SELECT id, CAST(row_number() OVER (ORDER BY {order}) - 1 AS BIGINT) AS pos, count(*) OVER () AS n
        FROM corpus WHERE split = 'train')
SELECT id, pos, CAST(floor(pos / 64) AS BIGINT) AS batch_id FROM ord {where}"""


def _batches_q(drop_last: bool, shuffled: bool):
    def q(spark, sf_dir):
        from .operators.order import batches

        p = _prep(spark, sf_dir)
        train = p.corpus.where(F.col("split") == "train").select("id")
        return batches(train, 64, drop_last=drop_last, shuffle=shuffled).select("id", "pos", "batch_id")
    return q


query("batches", _batches_sql(False, False))(_batches_q(False, False))
query("batches_drop_last", _batches_sql(True, False))(_batches_q(True, False))
query("batches_shuffled", _batches_sql(False, True))(_batches_q(False, True))


@query("train_dev_union", _with(S.corpus_cte()) + """
SELECT id, split FROM corpus WHERE split = 'train' UNION ALL SELECT id, split FROM corpus WHERE split = 'dev'""")
def q_train_dev_union(spark, sf_dir):
    c = _prep(spark, sf_dir).corpus
    return (c.where(F.col("split") == "train").select("id", "split")
            .unionByName(c.where(F.col("split") == "dev").select("id", "split")))


# ---------------------------------------------------------------- vectors

def _vectors(spark, sf_dir):
    from .plans.features import build_vectors

    return build_vectors(spark, sf_dir, _prep(spark, sf_dir))


def _long(df, id_col: str, vec_col: str):
    """One row per vector component: ``id, j, value`` (rounded)."""
    return df.select(id_col, F.posexplode(vec_col).alias("j", "_v")).select(
        id_col, "j", (F.round("_v", 6) + F.lit(0.0)).alias("value"))


def _checksums(df, key: str, vec_col: str = "vec"):
    return df.select(key, F.size(vec_col).cast("long").alias("dim"),
                     (F.round(F.aggregate(vec_col, F.lit(0.0), lambda a, x: a + x), 6)
                      + F.lit(0.0)).alias("v_sum"),
                     (F.round(F.aggregate(vec_col, F.lit(0.0), lambda a, x: a + x * x), 6)
                      + F.lit(0.0)).alias("v_sq"))


_CHK_SQL = ("CAST(len(vec) AS BIGINT) AS dim, round(list_reduce(list_prepend(0.0::DOUBLE, vec), "
            "lambda a, x: a + x), 6) + 0.0::DOUBLE AS v_sum, round(list_reduce(list_prepend(0.0::DOUBLE, vec), "
            "lambda a, x: a + x * x), 6) + 0.0::DOUBLE AS v_sq")

VEC_BASE = INDEX + (S.VOCAB_ALL_CTE, S.DIM_CTE, S.EMB_CTE)


def _roundtrip_vectors(spark, sf_dir, in_vocab: bool):
    from .operators.vectors import read_word_vectors, write_word_vectors
    from .session import scratch_path

    v = _vectors(spark, sf_dir)
    path = write_word_vectors(v.vectors, scratch_path(spark, "word-vectors"))
    vocab = v.prep.vocab if in_vocab else None
    got, _info = read_word_vectors(spark, path, vocab=vocab)
    return _checksums(got, "token")


@query("read_word_vectors", _with(*VEC_BASE, S.wv_cte()) + f"""
SELECT token, {_CHK_SQL} FROM wv""")
def q_read_word_vectors(spark, sf_dir):
    return _roundtrip_vectors(spark, sf_dir, in_vocab=False)


@query("word_vectors_in_vocab", _with(*VEC_BASE, S.wv_cte()) + f"""
SELECT token, {_CHK_SQL} FROM wv WHERE token IN (SELECT token FROM vocab)""")
def q_word_vectors_in_vocab(spark, sf_dir):
    return _roundtrip_vectors(spark, sf_dir, in_vocab=True)


@query("word_vector_audit", _with(*VEC_BASE) + """
SELECT dimt.d AS dim, CAST(1 AS BIGINT) AS dropped_length, CAST(1 AS BIGINT) AS malformed,
       CAST((SELECT count(*) FROM vocab_all) AS BIGINT) AS n_words FROM dimt""")
def q_word_vector_audit(spark, sf_dir):
    """A ``count dim`` header is dropped and counted, so is a line with a
    malformed number."""
    from .operators.vectors import format_vector_lines, read_word_vectors
    from .session import scratch_path

    v = _vectors(spark, sf_dir)
    head = spark.createDataFrame([(f"{v.n_vectors} {v.dim}",), ("<bad>" + " x" * v.dim,)], "value string")
    path = scratch_path(spark, "word-vectors")
    format_vector_lines(v.vectors).unionByName(head).write.mode("overwrite").text(path)
    got, info = read_word_vectors(spark, path, on_error="drop")
    return got.agg(F.lit(info["dim"]).cast("long").alias("dim"),
                   F.lit(info["dropped_length"]).cast("long").alias("dropped_length"),
                   F.lit(info["malformed"]).cast("long").alias("malformed"),
                   F.count(F.lit(1)).alias("n_words"))


@query("lookup_table", _with(*VEC_BASE, S.lookup_ctes()) + f"""
SELECT id, {_CHK_SQL} FROM lookup""")
def q_lookup_table(spark, sf_dir):
    return _checksums(_vectors(spark, sf_dir).lookup, "id")


@query("vector_dim", """
SELECT CAST(mode(len(embedding)) AS BIGINT) AS dim, CAST(count(*) AS BIGINT) AS n_vectors FROM embeddings""")
def q_vector_dim(spark, sf_dir):
    from .operators.vectors import vector_dim

    return vector_dim(table(spark, sf_dir, "embeddings"), "embedding")


@query("mean_pool_features", _with(*VEC_BASE, S.lookup_ctes(), S.pool_mean_ctes()) + """
SELECT id, j, round(value, 6) + 0.0::DOUBLE AS value FROM feat""")
def q_mean_pool_features(spark, sf_dir):
    from .plans.features import pooled_features

    return _long(pooled_features(_vectors(spark, sf_dir)), "id", "features")


@query("attention_pool", _with(*VEC_BASE, S.lookup_ctes()) + """,
ex AS (SELECT t.id, u.token, u.pos FROM toks t, unnest(t.tokens) WITH ORDINALITY AS u(token, pos)),
h AS (SELECT e.id, e.pos, coalesce(tv.vec, unkv.vec) AS h FROM ex e CROSS JOIN unkv LEFT JOIN tv ON e.token = tv.token),
q AS (SELECT id, arg_max(h, pos) AS q FROM h GROUP BY id),
sc AS (SELECT h.id, h.pos, h.h, list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(h.h, q.q), lambda p: p[1] * p[2])),
       lambda a, x: a + x) AS s FROM h JOIN q ON h.id = q.id),
ex2 AS (SELECT id, h, exp(s - max(s) OVER (PARTITION BY id)) AS e FROM sc),
z AS (SELECT id, sum(e) AS z FROM ex2 GROUP BY id),
el AS (SELECT x.id, CAST(u.j - 1 AS INTEGER) AS j, sum(u.v * x.e) AS num
       FROM ex2 x, unnest(x.h) WITH ORDINALITY AS u(v, j) GROUP BY x.id, u.j)
SELECT t.id, CAST(r.j AS INTEGER) AS j, round(coalesce(el.num / z.z, 0.0::DOUBLE), 6) + 0.0::DOUBLE AS value
FROM toks t CROSS JOIN dimt CROSS JOIN range(dimt.d) r(j)
LEFT JOIN el ON el.id = t.id AND el.j = r.j LEFT JOIN z ON z.id = t.id""")
def q_attention_pool(spark, sf_dir):
    from .operators.vectors import attention_pool

    v = _vectors(spark, sf_dir)
    pooled = attention_pool(v.prep.tokens, v.token_vecs, v.dim, unk=v.unk, hot=v.hot_vecs)
    return _long(pooled, "id", "features")


# ---------------------------------------------------------------- scores, losses, selection, audit
# (M1 M3 M4 O5 A4 A5 P4 P5 P6 A6 G6 G7 G1 G2) on `embeddings` with centroid weights

def _emb(spark, sf_dir):
    from .operators.labels import collect_labels, encode_labels
    from .operators.model import centroid_model
    from .plans.features import embeddings_dim

    emb = table(spark, sf_dir, "embeddings").where(F.col("label").isNotNull())
    labels = collect_labels(emb, "label")
    df = encode_labels(emb, labels, "label", "y", strict=False).select(
        "vec_id", "y", F.col("embedding").cast("array<double>").alias("features"))
    model = centroid_model(df, len(labels), embeddings_dim(emb), scale=S.CENTROID_SCALE)
    return df, model, len(labels)


def _scored(spark, sf_dir, log: bool = False):
    from .operators.model import score

    df, model, c = _emb(spark, sf_dir)
    return score(df, model, log=log), c


def _r6(col):
    return (F.round(col, 6) + F.lit(0.0))


@query("linear_logits", _with(S.EMB_SCORE_CTES) + """
SELECT vec_id, CAST(k AS INTEGER) AS k, round(z, 6) + 0.0::DOUBLE AS logit FROM logit""")
def q_linear_logits(spark, sf_dir):
    from .operators.model import score

    df, model, _c = _emb(spark, sf_dir)
    z = score(df, model, out_col="z", raw=True)
    # outer + filter: a plain posexplode would re-evaluate the layer in an inferred filter
    ex = z.select("vec_id", F.posexplode_outer("z").alias("k", "_z")).where(F.col("k").isNotNull())
    return ex.select("vec_id", "k", _r6(F.col("_z")).alias("logit"))


@query("log_softmax_scores", _with(S.EMB_SCORE_CTES) + """
SELECT vec_id, CAST(k AS INTEGER) AS k, round(logp, 6) + 0.0::DOUBLE AS log_prob FROM prob""")
def q_log_softmax_scores(spark, sf_dir):
    s, _c = _scored(spark, sf_dir, log=True)
    return s.select("vec_id", F.posexplode("probs").alias("k", "_l")).select(
        "vec_id", "k", _r6(F.col("_l")).alias("log_prob"))


@query("predicted_class", _with(S.EMB_SCORE_CTES) + "SELECT vec_id, y, pred FROM pred")
def q_predicted_class(spark, sf_dir):
    from .functions.vecmath import argmax

    s, _c = _scored(spark, sf_dir)
    return s.select("vec_id", "y", argmax("probs").alias("pred"))


@query("accuracy", _with(S.EMB_SCORE_CTES) + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN pred = y THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
       round(100.0::DOUBLE * avg(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pred""")
def q_accuracy(spark, sf_dir):
    from .operators.metrics import accuracy

    s, _c = _scored(spark, sf_dir)
    a = accuracy(s)
    return a.select("n_rows", "n_correct", F.round("accuracy", 6).alias("accuracy"))


BS = 128


def _loss_sql(loss_expr: str, src: str, extra: str = "") -> str:
    return f""",
rowloss AS (SELECT vec_id, {loss_expr} AS loss{extra} FROM {src}),
b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / {BS}) AS BIGINT) AS batch_id FROM rowloss),
bm AS (SELECT batch_id, avg(loss) AS m FROM b GROUP BY batch_id)
SELECT CAST((SELECT count(*) FROM rowloss) AS BIGINT) AS n_rows,
       round((SELECT avg(loss) FROM rowloss), 6) AS loss_mean,
       round((SELECT sum(m) FROM bm) / (SELECT count(*) FROM rowloss), 6) AS loss_reported"""


@query("pl_loss", _with(S.EMB_SCORE_CTES) + _loss_sql("-ln(greatest(p_y, 1e-12::DOUBLE))", "py"))
def q_pl_loss(spark, sf_dir):
    from .functions.vecmath import nll
    from .operators.metrics import epoch_loss

    s, _c = _scored(spark, sf_dir)
    rows = s.select("vec_id", nll("probs", "y").alias("loss"))
    return epoch_loss(rows, "loss", BS, order_by=["vec_id"])


@query("nl_loss", _with(S.EMB_SCORE_CTES, S.comp_sql(0)) + _loss_sql(
    "-ln(greatest(1.0::DOUBLE - p, 1e-12::DOUBLE))",
    "(SELECT prob.vec_id, prob.p FROM prob JOIN comp ON prob.vec_id = comp.vec_id AND prob.k = comp.k)",
    ", ln(greatest(p, 1e-12::DOUBLE)) - 1.0::DOUBLE AS loss_w") + """,
       round((SELECT avg(loss_w) FROM rowloss), 6) AS loss_as_written_mean""")
def q_nl_loss(spark, sf_dir):
    from .functions.vecmath import negative_nll
    from .operators.metrics import epoch_loss
    from .operators.noise import complement_label

    s, c = _scored(spark, sf_dir)
    rows = s.select("vec_id", complement_label("y", c, 0, id_col="vec_id").alias("comp"), "probs")
    rows = rows.select("vec_id", negative_nll("probs", "comp").alias("loss"),
                       negative_nll("probs", "comp", form="as_written").alias("loss_w"))
    out = epoch_loss(rows, "loss", BS, order_by=["vec_id"], extra_means={"loss_w": "loss_as_written_mean"})
    return out


def _select_q(kind: str):
    def q(spark, sf_dir):
        from .operators.selection import confident_rows, selection_threshold

        s, c = _scored(spark, sf_dir)
        t = selection_threshold(kind, c)
        kept = confident_rows(s, t, probs_col="probs", y_col="y")
        return kept.select("vec_id", "y", _r6(F.col("p_y")).alias("p_y"))
    return q


query("select_selnl", _with(S.EMB_SCORE_CTES) + """
SELECT vec_id, y, round(p_y, 6) + 0.0::DOUBLE AS p_y FROM py WHERE p_y > 1.0::DOUBLE / (SELECT c FROM nc)""")(
    _select_q("selnl"))
query("select_selpl", _with(S.EMB_SCORE_CTES) + """
SELECT vec_id, y, round(p_y, 6) + 0.0::DOUBLE AS p_y FROM py WHERE p_y > 0.5::DOUBLE""")(_select_q("selpl"))


@query("label_audit", _with(S.EMB_SCORE_CTES) + """
SELECT vec_id, y AS actual_label, pred AS predicted_label, CASE WHEN y = pred THEN 1 ELSE 0 END AS is_equal FROM pred""")
def q_label_audit(spark, sf_dir):
    from .functions.vecmath import argmax
    from .operators.metrics import label_audit

    s, _c = _scored(spark, sf_dir)
    preds = s.select("vec_id", F.col("y").alias("actual_label"), argmax("probs").alias("predicted_label"))
    return label_audit(preds)


@query("label_audit_all", _with(S.EMB_SCORE_CTES) + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN y = pred THEN 1 ELSE 0 END) AS BIGINT) AS n_equal,
       bool_and(y IS NOT DISTINCT FROM pred) AS all_equal FROM pred""")
def q_label_audit_all(spark, sf_dir):
    from .functions.vecmath import argmax
    from .operators.metrics import label_audit_all

    s, _c = _scored(spark, sf_dir)
    preds = s.select(F.col("y").alias("actual_label"), argmax("probs").alias("predicted_label"))
    return label_audit_all(preds)


def _grad_sql(g_expr: str, src: str) -> str:
    return f""",
g AS (SELECT vec_id, k, {g_expr} AS g FROM {src}),
grad AS (SELECT g.k, ex.j, sum(g.g * ex.v) AS s FROM g JOIN ex ON g.vec_id = ex.vec_id GROUP BY g.k, ex.j
         UNION ALL SELECT k, -1 AS j, sum(g) AS s FROM g GROUP BY k)
SELECT CAST(k AS INTEGER) AS k, CAST(j AS INTEGER) AS j, round(s / (SELECT n FROM nc), 6) + 0.0::DOUBLE AS grad FROM grad"""


def _grad_long(spark, frame, c: int, d: int):
    """Long form ``k, j, grad`` (mean); bias as j = -1."""
    exploded = frame.select(F.col("n"), F.posexplode("grad").alias("_i", "_g"))
    k = F.floor(F.col("_i") / F.lit(d + 1)).cast("int")
    j = F.pmod(F.col("_i"), F.lit(d + 1)).cast("int")
    return exploded.select(k.alias("k"), F.when(j == d, F.lit(-1)).otherwise(j).alias("j"),
                           _r6(F.col("_g") / F.col("n")).alias("grad"))


@query("pl_gradient", _with(S.EMB_SCORE_CTES) + _grad_sql(
    "p - CASE WHEN k = y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "prob"))
def q_pl_gradient(spark, sf_dir):
    from .operators.model import gradient_frame

    df, model, c = _emb(spark, sf_dir)
    return _grad_long(spark, gradient_frame(df, model, kind="pl"), c, model.dim)


@query("nl_gradient", _with(S.EMB_SCORE_CTES, S.comp_sql(0)) + """,
pk AS (SELECT prob.vec_id, comp.k AS kbar, prob.p AS p_k FROM prob JOIN comp ON prob.vec_id = comp.vec_id AND prob.k = comp.k),
src AS (SELECT prob.vec_id, prob.k, prob.p, pk.kbar, pk.p_k FROM prob JOIN pk ON prob.vec_id = pk.vec_id)""" + _grad_sql(
    "p_k / greatest(1.0::DOUBLE - p_k, 1e-12::DOUBLE) * (CASE WHEN k = kbar THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - p)",
    "src"))
def q_nl_gradient(spark, sf_dir):
    from .operators.model import gradient_frame
    from .operators.noise import complement_label

    df, model, c = _emb(spark, sf_dir)
    df = df.withColumn("comp", complement_label("y", c, 0, id_col="vec_id"))
    return _grad_long(spark, gradient_frame(df, model, kind="nl", comp_col="comp"), c, model.dim)


NL_GRADIENT_SQL = ORACLES["nl_gradient"]


@query("nl_gradient_exact", NL_GRADIENT_SQL)
def q_nl_gradient_exact(spark, sf_dir):
    """The gradient of a negative pass, added without rounding."""
    from .operators.model import gradient_frame
    from .operators.noise import complement_label

    df, model, c = _emb(spark, sf_dir)
    df = df.withColumn("comp", complement_label("y", c, 0, id_col="vec_id"))
    return _grad_long(spark, gradient_frame(df, model, kind="nl", comp_col="comp", exact=True), c, model.dim)


# ---------------------------------------------------------------- training

QUERY_EPOCHS = 5


def _nlnl(spark, sf_dir, stages, epochs=QUERY_EPOCHS):
    from .plans.nlnl import NLNLConfig, run_nlnl

    cfg = NLNLConfig(nl_epochs=epochs, selnl_epochs=epochs, selpl_epochs=epochs)
    return run_nlnl(spark, sf_dir, cfg, stages=stages)


def _history(spark, res):
    from .plans.train import history_frame

    h = history_frame(spark, res.history)
    return h.select("step", "stage", "epoch", "n_rows", _r6(F.col("train_loss")).alias("train_loss"),
                    _r6(F.col("train_pos_loss")).alias("train_pos_loss"),
                    _r6(F.col("dev_loss")).alias("dev_loss"), "test_accuracy", "stopped")


@query("train_nl")
def q_train_nl(spark, sf_dir):
    return _history(spark, _nlnl(spark, sf_dir, ("nl",)))


@query("train_pl")
def q_train_pl(spark, sf_dir):
    return _history(spark, _nlnl(spark, sf_dir, ("pl",)))


@query("training_history")
def q_training_history(spark, sf_dir):
    return _history(spark, _nlnl(spark, sf_dir, ("nl", "selnl", "selpl")))


@query("train_nl_selnl_selpl")
def q_train_nl_selnl_selpl(spark, sf_dir):
    from .plans.nlnl import scored_rows

    res = _nlnl(spark, sf_dir, ("nl", "selnl", "selpl"))
    return scored_rows(res).select("id", "y", "label_clean", "is_flipped",
                                   _r6(F.col("p_y")).alias("p_y"), "pred", "kept")


@query("weights_roundtrip", _with(S.EMB_SCORE_CTES) + """
SELECT CAST(k AS INTEGER) AS k, CAST(j AS INTEGER) AS j, round(w, 6) + 0.0::DOUBLE AS w FROM cent
UNION ALL SELECT CAST(k AS INTEGER), -1, 0.0::DOUBLE FROM (SELECT DISTINCT k FROM cent)""")
def q_weights_roundtrip(spark, sf_dir):
    from .plans.train import load_weights, save_weights
    from .session import scratch_path

    _df, model, _c = _emb(spark, sf_dir)
    path = save_weights(spark, model, scratch_path(spark, "weights"))
    back = load_weights(spark, path)
    assert back.W.shape == model.W.shape
    # long form straight from the written table (no driver round trip of values)
    rows = spark.read.parquet(path)
    w = rows.where(F.col("name") == "weight").select(
        F.element_at("shape", 2).alias("_d"), F.posexplode("values").alias("_i", "_v"))
    b = rows.where(F.col("name") == "bias").select(F.posexplode("values").alias("k", "_v"))
    return (w.select((F.floor(F.col("_i") / F.col("_d"))).cast("int").alias("k"),
                     F.pmod(F.col("_i"), F.col("_d")).cast("int").alias("j"), _r6(F.col("_v")).alias("w"))
            .unionByName(b.select(F.col("k").cast("int"), F.lit(-1).alias("j"), _r6(F.col("_v")).alias("w"))))


# ---------------------------------------------------------------- language-model targets

@query("lm_next_token", _with(*BASE) + """,
ex AS (SELECT t.id, CAST(u.pos - 1 AS INTEGER) AS pos, u.token
       FROM toks t, unnest(t.tokens) WITH ORDINALITY AS u(token, pos))
SELECT id, pos, token, lead(token) OVER (PARTITION BY id ORDER BY pos) AS next_token FROM ex""")
def q_lm_next_token(spark, sf_dir):
    from .operators.lm import next_token_pairs

    return next_token_pairs(_prep(spark, sf_dir).tokens)


@query("lm_stream_batches", _with(*BASE) + """,
ex AS (SELECT t.id, u.pos, u.token FROM toks t, unnest(t.tokens) WITH ORDINALITY AS u(token, pos)),
stream AS (SELECT row_number() OVER o - 1 AS g, token, lead(token) OVER o AS target, count(*) OVER () AS total
           FROM ex WINDOW o AS (ORDER BY id, pos)),
cols AS (SELECT *, (total - 1 + 47) // 48 AS l FROM stream WHERE g < total - 1)
SELECT CAST((g % l) // 70 AS BIGINT) AS batch, CAST(g // l AS BIGINT) AS "row", CAST((g % l) % 70 AS INTEGER) AS position,
       token, target FROM cols""")
def q_lm_stream_batches(spark, sf_dir):
    """Batches of 48 columns and 70 tokens of the stream of all texts."""
    from .operators.lm import stream_batches

    return stream_batches(_prep(spark, sf_dir).tokens, 48, 70)


# ---------------------------------------------------------------- sources and sinks

@query("read_labeled_csv", _with(S.corpus_cte()) + "SELECT label, text FROM corpus")
def q_read_labeled_csv(spark, sf_dir):
    from .session import scratch_path
    from .sources.files import read_csv, write_csv

    c = _prep(spark, sf_dir).corpus
    path = write_csv(c.select("label", "text"), scratch_path(spark, "labeled-csv"))
    return read_csv(spark, path)


@query("read_csv_split", _with(S.corpus_cte()) + "SELECT label, text FROM corpus")
def q_read_csv_split(spark, sf_dir):
    """The same table by the reader that gives one file to several tasks."""
    from .session import scratch_path
    from .sources.files import read_csv, write_csv

    c = _prep(spark, sf_dir).corpus
    path = write_csv(c.select("label", "text"), scratch_path(spark, "labeled-csv"))
    return read_csv(spark, path, splittable=True)


@query("export_csv_roundtrip", _with(S.corpus_cte()) + """
SELECT CAST(id AS VARCHAR) AS id, label, text FROM corpus WHERE split IN ('train', 'dev')""")
def q_export_csv_roundtrip(spark, sf_dir):
    from pyspark.sql import types as T

    from .session import scratch_path
    from .sources.files import read_csv, write_csv

    c = _prep(spark, sf_dir).corpus
    train_dev = (c.where(F.col("split") == "train").select("id", "label", "text")
                 .unionByName(c.where(F.col("split") == "dev").select("id", "label", "text")))
    path = write_csv(train_dev, scratch_path(spark, "export-csv"))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "label", "text")])
    return read_csv(spark, path, schema)


@query("read_predictions_json", _with(S.EMB_SCORE_CTES) + """
SELECT CAST(vec_id AS BIGINT) AS id, CAST(y AS BIGINT) AS actual_label, CAST(pred AS BIGINT) AS predicted_label,
       CASE WHEN y = pred THEN 1 ELSE 0 END AS is_equal FROM pred""")
def q_read_predictions_json(spark, sf_dir):
    from .functions.vecmath import argmax
    from .operators.metrics import label_audit
    from .session import scratch_path
    from .sources.files import PREDICTIONS_SCHEMA
    from .sources.splits import read_json_array, write_json_array

    s, _c = _scored(spark, sf_dir)
    preds = s.select(F.col("vec_id").alias("id"), F.col("y").cast("long").alias("actual_label"),
                     argmax("probs").cast("long").alias("predicted_label"))
    path = write_json_array(preds, scratch_path(spark, "predictions-json"))
    return label_audit(read_json_array(spark, path, PREDICTIONS_SCHEMA))


@query("read_text_folder", """
SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL""")
def q_read_text_folder(spark, sf_dir):
    from .session import scratch_path
    from .sources.files import read_text_folder, write_text_folder

    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select(
        F.col("doc_id").alias("id"), "text")
    path = write_text_folder(docs, scratch_path(spark, "text-folder"))
    return read_text_folder(spark, path).select("id", "text")


@query("text_records_roundtrip", "SELECT doc_id AS id, text FROM documents")
def q_text_records_roundtrip(spark, sf_dir):
    from .session import scratch_path
    from .sources.files import read_text_records, write_text_records

    docs = table(spark, sf_dir, "documents")
    path = write_text_records(docs, scratch_path(spark, "text-records"), 8, "doc_id")
    return read_text_records(spark, path)


@query("prepared_roundtrip", _with(*INDEX, S.encode_ctes(256)) + """
SELECT id, y, array_to_string(ids, ' ') AS ids FROM enc""")
def q_prepared_roundtrip(spark, sf_dir):
    from .session import scratch_path
    from .sources.files import read_parquet, write_parquet

    p = _prep(spark, sf_dir)
    path = write_parquet(encode_fixed(p.tokens, p.index, 256, keep=("y",), hot=p.lookup_hot()), scratch_path(spark, "prepared"))
    back = read_parquet(spark, path)
    return back.select("id", "y", ids_to_string("ids").alias("ids"))


# ---------------------------------------------------------------- CNN

CNN_LEN = 256


def _cnn_setup(spark, sf_dir, length=CNN_LEN):
    from .operators.cnn import CNNRunner, CNNText
    from .plans.features import Vectors
    from .session import materialize

    p = _prep(spark, sf_dir)
    v = Vectors(p)
    enc = encode_fixed(p.tokens, p.index, length, keep=("y", "split"), hot=p.lookup_hot())
    return p, v, materialize(enc, "cnn-ids"), CNNRunner, CNNText


@query("cnn_scores", _with(*VEC_BASE, S.lookup_ctes(), S.encode_ctes(CNN_LEN),
                           "nclass AS (SELECT count(DISTINCT lang) AS c FROM documents "
                           "WHERE text IS NOT NULL AND lang IS NOT NULL)",
                           S.cnn_ctes(CNN_LEN)) + """
SELECT id, CAST(k AS INTEGER) AS k, round(p, 6) + 0.0::DOUBLE AS prob FROM cnnprob""")
def q_cnn_scores(spark, sf_dir):
    p, v, enc, CNNRunner, CNNText = _cnn_setup(spark, sf_dir)
    runner = CNNRunner(enc, v.lookup, v.dim, CNN_LEN, keep=("y",), hot=v.hot_lookup)
    s = runner.score(CNNText(p.num_classes, v.dim))
    return s.select("id", F.posexplode("probs").alias("k", "_p")).select("id", "k", _r6(F.col("_p")).alias("prob"))


@query("train_cnn")
def q_train_cnn(spark, sf_dir):
    from .operators.noise import inject_noise
    from .plans.train import fit_cnn, history_frame
    from .session import materialize

    p, v, enc, CNNRunner, CNNText = _cnn_setup(spark, sf_dir)
    train = enc.where(F.col("split") == "train")
    noisy = materialize(inject_noise(train, p.num_classes, 0.3, kind="exc", label_col="y")
                        .select("id", "y", "ids"), "cnn-train")
    runner = CNNRunner(noisy, v.lookup, v.dim, CNN_LEN, keep=("y",), hot=v.hot_lookup)
    model, hist = fit_cnn(runner, CNNText(p.num_classes, v.dim), 3, kind="nl", lr=0.01, stage="nl")
    model, hist = fit_cnn(runner, model, 3, kind="pl", lr=0.01, select="selpl", stage="selpl", history=hist)
    return history_frame(spark, hist).select("step", "stage", "epoch", "n_rows",
                                             _r6(F.col("train_loss")).alias("train_loss"), "stopped")


@query("cnn_gradient", _with(*VEC_BASE, S.lookup_ctes(), S.encode_ctes(CNN_LEN),
                             "nclass AS (SELECT count(DISTINCT lang) AS c FROM documents "
                             "WHERE text IS NOT NULL AND lang IS NOT NULL)",
                             S.cnn_ctes(CNN_LEN), S.cnn_gradient_ctes()) + """
SELECT rate, CAST(i AS INTEGER) AS i, round(g, 6) + 0.0::DOUBLE AS g FROM cnngrad""")
def q_cnn_gradient(spark, sf_dir):
    """Mean gradient of the positive loss by parameter, without and with dropout."""
    p, v, enc, CNNRunner, CNNText = _cnn_setup(spark, sf_dir)
    runner = CNNRunner(enc, v.lookup, v.dim, CNN_LEN, keep=("y",), hot=v.hot_lookup)
    out = None
    for rate in (0.0, 0.1):
        sums = runner.gradient_frame(CNNText(p.num_classes, v.dim, dropout=rate), kind="pl", epoch=3)
        rows = sums.select(F.lit(rate).alias("rate"), "n", F.posexplode("grad").alias("i", "_g")).select(
            "rate", "i", _r6(F.col("_g") / F.col("n")).alias("g"))
        out = rows if out is None else out.unionByName(rows)
    return out


# ---------------------------------------------------------------- streaming encode

@query("stream_encode", _with(*INDEX) + """,
stoks AS (SELECT doc_id AS id, NULL::INTEGER AS y, """ + S.sql_tokenize_text() + """ AS tokens
          FROM documents WHERE text IS NOT NULL),
""" + S.encode_ctes(256, src="stoks", name="senc") + """
SELECT id, array_to_string(ids, ' ') AS ids FROM senc""")
def q_stream_encode(spark, sf_dir):
    from .session import scratch_path
    from .streaming.encode_stream import read_encoded, start_encoding

    p = _prep(spark, sf_dir)
    schema = table(spark, sf_dir, "documents").schema
    # a glob, so the file's folder is the stream's directory
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(
        f"{sf_dir.rstrip('/')}/documents.parq[u]et")
    out = scratch_path(spark, "stream-encoded")
    q = start_encoding(stream.select(F.col("doc_id").alias("id"), "text"), p.index, 256, out,
                       scratch_path(spark, "stream-checkpoint"), available_now=True, hot=p.lookup_hot())
    q.awaitTermination()
    return read_encoded(spark, out).select("id", ids_to_string("ids").alias("ids"))


# ---------------------------------------------------------------- loaders by name

@query("labeled_corpus_quality", _with(S.corpus_cte("quality")) + """
SELECT id, CAST(label AS BIGINT) AS label, y, split FROM corpus""")
def q_labeled_corpus_quality(spark, sf_dir):
    from .sources.registry import load_dataset

    df, _classes = load_dataset(spark, "documents_quality", sf_dir)
    return df.select("id", F.col("label").cast("long").alias("label"), "y", "split")


@query("conversations_corpus", """
SELECT conv_id * 4294967296 + turn AS id, role AS label,
       CAST(dense_rank() OVER (ORDER BY role) - 1 AS INTEGER) AS y,
       CASE WHEN """ + S.draw("split", "conv_id * 4294967296 + turn") + """ % 10 < 8 THEN 'train'
            WHEN """ + S.draw("split", "conv_id * 4294967296 + turn") + """ % 10 = 8 THEN 'dev' ELSE 'test' END AS split
FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL""")
def q_conversations_corpus(spark, sf_dir):
    from .sources.registry import load_dataset

    df, _classes = load_dataset(spark, "conversations_role", sf_dir)
    return df.select("id", "label", "y", "split")


@query("subset_batches", _with(S.EMB_SCORE_CTES) + """,
sel AS (SELECT vec_id FROM py WHERE p_y > 1.0::DOUBLE / (SELECT c FROM nc)),
ord AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS pos
        FROM e WHERE vec_id IN (SELECT vec_id FROM sel))
SELECT vec_id, pos, CAST(floor(pos / 64) AS BIGINT) AS batch_id FROM ord""")
def q_subset_batches(spark, sf_dir):
    from .operators.order import batches, subset
    from .operators.selection import confident_rows, selection_threshold

    s, c = _scored(spark, sf_dir)
    chosen = confident_rows(s, selection_threshold("selnl", c)).select("vec_id")
    rows = subset(s.select("vec_id"), chosen, "vec_id")
    return batches(rows, 64, order_by=["vec_id"]).select("vec_id", "pos", "batch_id")


@query("adam_first_step", _with(S.EMB_SCORE_CTES, S.comp_sql(1)) + """,
kk AS (SELECT k.k FROM nc CROSS JOIN range(nc.c) k(k)),
g AS (SELECT e.vec_id, kk.k,
             (1.0::DOUBLE / nc.c) / (1.0::DOUBLE - 1.0::DOUBLE / nc.c)
             * (CASE WHEN kk.k = comp.k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - 1.0::DOUBLE / nc.c) AS g
      FROM e JOIN comp ON e.vec_id = comp.vec_id CROSS JOIN nc CROSS JOIN kk),
grad AS (SELECT g.k, ex.j, sum(g.g * ex.v) / (SELECT n FROM nc) AS s FROM g JOIN ex ON g.vec_id = ex.vec_id
         GROUP BY g.k, ex.j
         UNION ALL SELECT k, -1 AS j, sum(g) / (SELECT n FROM nc) AS s FROM g GROUP BY k)
SELECT CAST(k AS INTEGER) AS k, CAST(j AS INTEGER) AS j,
       round(-0.3::DOUBLE * s / (abs(s) + 1e-8::DOUBLE), 6) + 0.0::DOUBLE AS w FROM grad""")
def q_adam_first_step(spark, sf_dir):
    """Weights after one full-batch NL step from zero (G1 + G3): the training
    loop's first step, checkable in SQL because p is uniform at zero."""
    from .plans.train import Adam, Trainer, weights_frame

    df, _model, c = _emb(spark, sf_dir)
    tr = Trainer(c, _model.dim, Adam(lr=0.3))
    tr.fit(df.withColumnRenamed("vec_id", "id"), 1, "nl")
    rows = weights_frame(spark, tr.model)
    w = rows.where(F.col("name") == "weight").select(
        F.element_at("shape", 2).alias("_d"), F.posexplode("values").alias("_i", "_v"))
    b = rows.where(F.col("name") == "bias").select(F.posexplode("values").alias("k", "_v"))
    return (w.select(F.floor(F.col("_i") / F.col("_d")).cast("int").alias("k"),
                     F.pmod(F.col("_i"), F.col("_d")).cast("int").alias("j"), _r6(F.col("_v")).alias("w"))
            .unionByName(b.select(F.col("k").cast("int"), F.lit(-1).alias("j"), _r6(F.col("_v")).alias("w"))))


@query("adam_first_step_pl", _with(S.EMB_SCORE_CTES) + """,
kk AS (SELECT k.k FROM nc CROSS JOIN range(nc.c) k(k)),
g AS (SELECT e.vec_id, kk.k,
             1.0::DOUBLE / nc.c - CASE WHEN kk.k = e.y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS g
      FROM e CROSS JOIN nc CROSS JOIN kk),
grad AS (SELECT g.k, ex.j, sum(g.g * ex.v) / (SELECT n FROM nc) AS s FROM g JOIN ex ON g.vec_id = ex.vec_id
         GROUP BY g.k, ex.j
         UNION ALL SELECT k, -1 AS j, sum(g) / (SELECT n FROM nc) AS s FROM g GROUP BY k)
SELECT CAST(k AS INTEGER) AS k, CAST(j AS INTEGER) AS j,
       round(-0.3::DOUBLE * s / (abs(s) + 1e-8::DOUBLE), 6) + 0.0::DOUBLE AS w FROM grad""")
def q_adam_first_step_pl(spark, sf_dir):
    """Weights after one full-batch PL step from zero (G2 + G3, clipping at 10)."""
    from .plans.train import Adam, Trainer, weights_frame

    df, _model, c = _emb(spark, sf_dir)
    tr = Trainer(c, _model.dim, Adam(lr=0.3))
    tr.fit(df.withColumnRenamed("vec_id", "id"), 1, "pl")
    rows = weights_frame(spark, tr.model)
    w = rows.where(F.col("name") == "weight").select(
        F.element_at("shape", 2).alias("_d"), F.posexplode("values").alias("_i", "_v"))
    b = rows.where(F.col("name") == "bias").select(F.posexplode("values").alias("k", "_v"))
    return (w.select(F.floor(F.col("_i") / F.col("_d")).cast("int").alias("k"),
                     F.pmod(F.col("_i"), F.col("_d")).cast("int").alias("j"), _r6(F.col("_v")).alias("w"))
            .unionByName(b.select(F.col("k").cast("int"), F.lit(-1).alias("j"), _r6(F.col("_v")).alias("w"))))


# ---------------------------------------------------------------- three training steps in SQL
# (G1 G2 G3 G4 G9 M8 P4): NL, SelNL and SelPL, one step each, from the centroid
# weights, with both Adam moments carried on; features are scaled so that the
# gradient norm of the positive step is over the clip.

STEP_LR = 0.002
STEP_SCALE = 200.0
STEPS = (("nl", None), ("nl", "1.0::DOUBLE / (SELECT c FROM nc)"), ("pl", "0.5::DOUBLE"))


def _probs_sql(i: int) -> str:
    return f"""lg{i} AS (SELECT xb.vec_id, w{i - 1}.k, sum(xb.v * w{i - 1}.w) AS z FROM xb JOIN w{i - 1} ON xb.j = w{i - 1}.j GROUP BY xb.vec_id, w{i - 1}.k),
sh{i} AS (SELECT vec_id, k, exp(z - max(z) OVER (PARTITION BY vec_id)) AS ez FROM lg{i}),
pr{i} AS (SELECT vec_id, CAST(k AS INTEGER) AS k, ez / sum(ez) OVER (PARTITION BY vec_id) AS p FROM sh{i}),
py{i} AS (SELECT e.vec_id, e.y, pr{i}.p FROM e JOIN pr{i} ON e.vec_id = pr{i}.vec_id AND e.y = pr{i}.k)"""


def _step_sql(i: int, kind: str, threshold: str | None, only: str | None = None) -> str:
    comp = S.comp_sql(i).replace("comp AS", f"comp{i} AS", 1)
    conditions = ([f"py{i}.p > {threshold}"] if threshold else []) + ([only] if only else [])
    keep = f"WHERE {' AND '.join(conditions)}" if conditions else ""
    if kind == "pl":
        g = f"pr{i}.p - CASE WHEN pr{i}.k = sel{i}.y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
        join, clip = "", "least(1.0::DOUBLE, 10.0::DOUBLE / (sqrt(sum(s * s) OVER ()) + 1e-6::DOUBLE))"
    else:
        g = (f"pc{i}.p / greatest(1.0::DOUBLE - pc{i}.p, 1e-12::DOUBLE) "
             f"* (CASE WHEN pr{i}.k = comp{i}.k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - pr{i}.p)")
        join = (f"JOIN comp{i} ON comp{i}.vec_id = sel{i}.vec_id "
                f"JOIN pr{i} pc{i} ON pc{i}.vec_id = sel{i}.vec_id AND pc{i}.k = comp{i}.k")
        clip = "1.0::DOUBLE"
    return f"""{comp},
{_probs_sql(i)},
sel{i} AS (SELECT vec_id, y FROM py{i} {keep}),
g{i} AS (SELECT sel{i}.vec_id, pr{i}.k, {g} AS g FROM sel{i} JOIN pr{i} ON pr{i}.vec_id = sel{i}.vec_id {join}),
mean{i} AS (SELECT g{i}.k, xb.j, sum(g{i}.g * xb.v) / (SELECT count(*) FROM sel{i}) AS s
            FROM g{i} JOIN xb ON xb.vec_id = g{i}.vec_id GROUP BY g{i}.k, xb.j),
cut{i} AS (SELECT k, j, s, s * {clip} AS d, sqrt(sum(s * s) OVER ()) AS norm FROM mean{i}),
w{i} AS (SELECT c.k, c.j, 0.9::DOUBLE * p.m + 0.1::DOUBLE * c.d AS m, 0.999::DOUBLE * p.q + 0.001::DOUBLE * c.d * c.d AS q,
         p.w - {STEP_LR}::DOUBLE * ((0.9::DOUBLE * p.m + 0.1::DOUBLE * c.d) / (1.0::DOUBLE - pow(0.9::DOUBLE, {i})))
           / (sqrt((0.999::DOUBLE * p.q + 0.001::DOUBLE * c.d * c.d) / (1.0::DOUBLE - pow(0.999::DOUBLE, {i}))) + 1e-8::DOUBLE) AS w
         FROM cut{i} c JOIN w{i - 1} p ON p.k = c.k AND p.j = c.j)"""


@query("three_training_steps", _with(
    S.EMB_SCORE_CTES,
    f"xb AS (SELECT vec_id, j, v * {STEP_SCALE}::DOUBLE AS v FROM ex UNION ALL SELECT vec_id, -1, 1.0::DOUBLE FROM e)",
    f"w0 AS (SELECT k, j, w / {STEP_SCALE}::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS q FROM cent "
    "UNION ALL SELECT DISTINCT k, -1, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM cent)",
    *[_step_sql(i + 1, *s) for i, s in enumerate(STEPS)]) + """
SELECT CAST(w3.k AS INTEGER) AS k, CAST(w3.j AS INTEGER) AS j, round(w3.w, 6) + 0.0::DOUBLE AS w,
       CAST((SELECT count(*) FROM sel2) AS BIGINT) AS n_selnl, CAST((SELECT count(*) FROM sel3) AS BIGINT) AS n_selpl,
       (SELECT max(norm) FROM cut3) > 10 AS clipped FROM w3""")
def q_three_training_steps(spark, sf_dir):
    """Weights after NL, SelNL and SelPL steps of the training loop."""
    from .operators.model import SoftmaxHead
    from .plans.train import Adam, Trainer, weights_frame

    df, model, c = _emb(spark, sf_dir)
    rows = df.select(F.col("vec_id").alias("id"), "y",
                     F.transform("features", lambda x: x * F.lit(STEP_SCALE)).alias("features"))
    tr = Trainer(c, model.dim, Adam(lr=STEP_LR), model=SoftmaxHead(model.W / STEP_SCALE))
    tr.fit(rows, 1, "nl")
    tr.fit(rows, 1, "nl", select="selnl")
    tr.fit(rows, 1, "pl", select="selpl", gamma=0.5)
    log = tr.history
    both = weights_frame(spark, tr.model)
    w = both.where(F.col("name") == "weight").select(
        F.element_at("shape", 2).alias("_d"), F.posexplode("values").alias("_i", "_v")).select(
        F.floor(F.col("_i") / F.col("_d")).cast("int").alias("k"),
        F.pmod(F.col("_i"), F.col("_d")).cast("int").alias("j"), _r6(F.col("_v")).alias("w"))
    b = both.where(F.col("name") == "bias").select(F.posexplode("values").alias("k", "_v")).select(
        F.col("k").cast("int"), F.lit(-1).alias("j"), _r6(F.col("_v")).alias("w"))
    return w.unionByName(b).select(
        "k", "j", "w", F.lit(log[1]["n_rows"]).cast("long").alias("n_selnl"),
        F.lit(log[2]["n_rows"]).cast("long").alias("n_selpl"), F.lit(log[2]["grad_norm"] > 10).alias("clipped"))


# ---------------------------------------------------------------- the epoch log in SQL
# The same three steps over a keyed split into dev, test and training rows, each
# with its evaluation, and a fourth that stops because nothing is selected.

LOG_STAGES = ("nl", "selnl", "selpl")
LOG_PARTS = 5  # parts of a keyed draw: 0 dev, 1 test, the others training


def _mean_loss_sql(i: int, kind: str, rows: str, probs: int) -> str:
    """Mean loss over ``rows(vec_id)`` with the probabilities before step ``probs``
    and the complementary labels of step ``i``."""
    if kind == "pl":
        return f"(SELECT avg(-ln(greatest(p, 1e-12::DOUBLE))) FROM py{probs} WHERE vec_id IN (SELECT vec_id FROM {rows}))"
    return (f"(SELECT avg(-ln(greatest(1.0::DOUBLE - q.p, 1e-12::DOUBLE))) FROM pr{probs} q JOIN comp{i} "
            f"ON comp{i}.vec_id = q.vec_id AND comp{i}.k = q.k WHERE q.vec_id IN (SELECT vec_id FROM {rows}))")


def _accuracy_sql(i: int, rows: str) -> str:
    return (f"(SELECT round(100.0::DOUBLE * sum(CASE WHEN k = y THEN 1 ELSE 0 END) / count(*), 6) + 0.0::DOUBLE FROM top{i} "
            f"WHERE vec_id IN (SELECT vec_id FROM {rows}))")


def _epoch_log_sql() -> str:
    def r6(x):
        return f"round({x}, 6) + 0.0::DOUBLE"

    steps, tops, rows = [], [], []
    for i, (kind, threshold) in enumerate(STEPS, 1):
        steps.append(_step_sql(i, kind, threshold, f"py{i}.vec_id IN (SELECT vec_id FROM train_rows)"))
        tops.append(f"""top{i} AS (SELECT vec_id, y, k FROM (SELECT e.vec_id, e.y, q.k,
          row_number() OVER (PARTITION BY e.vec_id ORDER BY q.p DESC, q.k) AS r
          FROM e JOIN pr{i + 1} q ON q.vec_id = e.vec_id) WHERE r = 1)""")
        loss, n = _mean_loss_sql(i, kind, f"sel{i}", i), f"(SELECT count(*) FROM sel{i})"
        rows.append(f"""SELECT {i}::BIGINT AS step, '{LOG_STAGES[i - 1]}' AS stage, {n}::BIGINT AS n_rows,
       {r6(loss)} AS train_loss, {r6(_mean_loss_sql(i, 'pl', f'sel{i}', i))} AS train_pos_loss,
       {r6(f'{loss} / {n} * 1000')} AS reported_loss_1000, {r6(f'(SELECT max(norm) FROM cut{i})')} AS grad_norm,
       {r6(_mean_loss_sql(i, kind, 'dev_rows', i + 1))} AS dev_loss,
       {_accuracy_sql(i, 'train_rows')} AS train_accuracy, {_accuracy_sql(i, 'test_rows')} AS test_accuracy,
       false AS stopped""")
    part = f"{S.draw('part', 'vec_id')} % {LOG_PARTS}"
    return _with(
        S.EMB_SCORE_CTES,
        f"part AS (SELECT vec_id, {part} AS part FROM e)",
        "dev_rows AS (SELECT vec_id FROM part WHERE part = 0)", "test_rows AS (SELECT vec_id FROM part WHERE part = 1)",
        "train_rows AS (SELECT vec_id FROM part WHERE part > 1)",
        f"xb AS (SELECT vec_id, j, v * {STEP_SCALE}::DOUBLE AS v FROM ex UNION ALL SELECT vec_id, -1, 1.0::DOUBLE FROM e)",
        f"w0 AS (SELECT k, j, w / {STEP_SCALE}::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS q FROM cent "
        "UNION ALL SELECT DISTINCT k, -1, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM cent)",
        *steps, _probs_sql(4), *tops) + "\nUNION ALL ".join(rows) + """
UNION ALL SELECT 4, 'selpl', (SELECT count(*) FROM py4 WHERE p > 1.0::DOUBLE AND vec_id IN (SELECT vec_id FROM train_rows)),
       NULL, NULL, NULL, NULL, NULL, NULL, NULL, true"""


@query("epoch_log", _epoch_log_sql())
def q_epoch_log(spark, sf_dir):
    """What the hook is told after each step, and the step that stops."""
    from .functions.draws import draw_mod
    from .operators.model import SoftmaxHead
    from .plans.train import Adam, Trainer, history_frame
    from .session import materialize

    df, model, c = _emb(spark, sf_dir)
    rows = materialize(df.select(
        F.col("vec_id").alias("id"), "y",
        F.transform("features", lambda x: x * F.lit(STEP_SCALE)).alias("features"),
        draw_mod(S.SEED, "part", LOG_PARTS, "vec_id").alias("part")), "epoch-log")
    sets = {"dev": rows.where("part = 0"), "test": rows.where("part = 1")}
    train, told = rows.where("part > 1"), []
    tr = Trainer(c, model.dim, Adam(lr=STEP_LR), model=SoftmaxHead(model.W / STEP_SCALE), eval_every=1,
                 reproducible=True, on_epoch_end=told.append)
    tr.fit(train, 1, "nl", **sets)
    tr.fit(train, 1, "nl", select="selnl", **sets)
    tr.fit(train, 1, "pl", select="selpl", gamma=0.5, **sets)
    tr.fit(train, 1, "pl", select="selpl", gamma=1.0, **sets)
    log = history_frame(spark, told + [h for h in tr.history if h["stopped"]])
    return log.select("step", "stage", "n_rows", *[_r6(F.col(x)).alias(x) for x in ("train_loss", "train_pos_loss")],
                      _r6(F.col("reported_loss") * 1000).alias("reported_loss_1000"),
                      *[_r6(F.col(x)).alias(x) for x in ("grad_norm", "dev_loss", "train_accuracy", "test_accuracy")],
                      "stopped")


# ---------------------------------------------------------------- mini-batches as local SGD (W2 with G1 G2)
# From zero weights the probabilities are uniform, so SQL can follow the first
# step of every shard.  Shards of about a third of a batch hold one batch each.

MINIBATCH_SHARD_ROWS = 160


def _minibatch_sql() -> str:
    shard = f"{S.draw('shard', 'e.vec_id')} % greatest((nc.n + {MINIBATCH_SHARD_ROWS - 1}) // {MINIBATCH_SHARD_ROWS}, 1)"
    return _with(S.EMB_SCORE_CTES, S.comp_sql(1)) + f""",
kk AS (SELECT k.k FROM nc CROSS JOIN range(nc.c) k(k)),
sh AS (SELECT e.vec_id, {shard} AS shard FROM e CROSS JOIN nc),
sizes AS (SELECT shard, count(*) AS n FROM sh GROUP BY shard),
g AS (SELECT e.vec_id, sh.shard, kk.k,
             (1.0::DOUBLE / nc.c) / (1.0::DOUBLE - 1.0::DOUBLE / nc.c)
             * (CASE WHEN kk.k = comp.k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END - 1.0::DOUBLE / nc.c) AS g
      FROM e JOIN comp ON e.vec_id = comp.vec_id JOIN sh ON sh.vec_id = e.vec_id CROSS JOIN nc CROSS JOIN kk),
grad AS (SELECT g.shard, g.k, ex.j, sum(g.g * ex.v) / any_value(s.n) AS s, any_value(s.n) AS n
         FROM g JOIN ex ON g.vec_id = ex.vec_id JOIN sizes s ON s.shard = g.shard GROUP BY g.shard, g.k, ex.j
         UNION ALL SELECT g.shard, k, -1, sum(g) / any_value(s.n), any_value(s.n)
         FROM g JOIN sizes s ON s.shard = g.shard GROUP BY g.shard, k)
SELECT CAST(k AS INTEGER) AS k, CAST(j AS INTEGER) AS j,
       round(sum(n * (-0.3::DOUBLE * s / (abs(s) + 1e-8::DOUBLE))) / any_value((SELECT n FROM nc)), 6) + 0.0::DOUBLE AS w,
       CAST((SELECT count(*) FROM sizes) AS BIGINT) AS batches
FROM grad GROUP BY k, j"""


@query("train_minibatch", _minibatch_sql())
def q_train_minibatch(spark, sf_dir):
    """Averaged weights after a pass in which every shard takes its first step from zero."""
    from .plans.minibatch import train_minibatch
    from .plans.train import weights_frame

    df, model, c = _emb(spark, sf_dir)
    done, log = train_minibatch(df, c, model.dim, 1, "nl", lr=0.3, shard_rows=MINIBATCH_SHARD_ROWS, id_col="vec_id")
    rows = weights_frame(spark, done)
    w = rows.where(F.col("name") == "weight").select(
        F.element_at("shape", 2).alias("_d"), F.posexplode("values").alias("_i", "_v")).select(
        F.floor(F.col("_i") / F.col("_d")).cast("int").alias("k"),
        F.pmod(F.col("_i"), F.col("_d")).cast("int").alias("j"), _r6(F.col("_v")).alias("w"))
    b = rows.where(F.col("name") == "bias").select(F.posexplode("values").alias("k", "_v")).select(
        F.col("k").cast("int"), F.lit(-1).alias("j"), _r6(F.col("_v")).alias("w"))
    return w.unionByName(b).withColumn("batches", F.lit(log[0]["batches"]).cast("long"))


@query("train_minibatch_epochs")
def q_train_minibatch_epochs(spark, sf_dir):
    """NL, SelNL and SelPL by mini-batches of 512 over the pooled text features."""
    from .plans.minibatch import pack_shards, shard_count, train_minibatch
    from .plans.nlnl import NLNLConfig, noisy_feature_set
    from .plans.train import test_accuracy

    data = noisy_feature_set(spark, sf_dir, NLNLConfig())
    shards = pack_shards(data.train, data.dim, shard_count(data.train.count(), data.dim))
    model, log = None, []
    for kind, select in (("nl", None), ("nl", "selnl"), ("pl", "selpl")):
        model, log = train_minibatch(data.train, data.num_classes, data.dim, QUERY_EPOCHS, kind, select, lr=0.1,
                                     model=model, shards=shards, history=log)
    right = test_accuracy(data.test, model)
    rows = [(r["step"], r["stage"], r["epoch"], r["n_rows"], r.get("batches"), r.get("train_loss"), right) for r in log]
    return spark.createDataFrame(rows, "step long, stage string, epoch long, n_rows long, batches long, "
                                       "train_loss double, final_test_accuracy double")
