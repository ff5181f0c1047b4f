"""The operators written as plain SQL (DuckDB dialect), for the oracle checks.

Each builder returns a CTE body or an expression; ``__spark_entry__.oracle_sql``
composes them.  These are specifications of the results, not an execution
path of the library.
"""

from __future__ import annotations

from .functions.draws import sql_draw, sql_shuffle_key
from .functions.text import sql_normalize, sql_tokenize

SEED = 7


def corpus_cte(label: str = "lang") -> str:
    split = f"{sql_draw(SEED, 'split', 'doc_id')} % 10"
    if label == "lang":
        return f"""corpus AS (
  SELECT doc_id AS id, text, lang AS label,
         CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS y,
         CASE WHEN {split} < 8 THEN 'train' WHEN {split} = 8 THEN 'dev' ELSE 'test' END AS split
  FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)"""
    return f"""corpus AS (
  SELECT d.doc_id AS id, d.text, l.{label} AS label,
         CAST(dense_rank() OVER (ORDER BY l.{label}) - 1 AS INTEGER) AS y,
         CASE WHEN {split.replace('doc_id', 'd.doc_id')} < 8 THEN 'train'
              WHEN {split.replace('doc_id', 'd.doc_id')} = 8 THEN 'dev' ELSE 'test' END AS split
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  WHERE d.text IS NOT NULL AND l.{label} IS NOT NULL)"""


def toks_cte(src: str = "corpus") -> str:
    return f"""toks AS (SELECT id, y, split, {sql_tokenize('text')} AS tokens FROM {src})"""


VOCAB_CTE = """vocab AS (SELECT DISTINCT unnest(tokens) AS token FROM toks
  WHERE split IN ('train', 'dev'))"""

WORD_INDEX_CTE = """word_index AS (
  SELECT token, CAST(row_number() OVER (ORDER BY token) + 3 AS BIGINT) AS id FROM vocab
  UNION ALL SELECT * FROM (VALUES ('<PAD>', 0::BIGINT), ('<START>', 1::BIGINT),
                                  ('<END>', 2::BIGINT), ('<UNK>', 3::BIGINT)) s(token, id))"""


def encode_ctes(max_length: int, src: str = "toks", name: str = "enc") -> str:
    """``name(id, y, ids list)`` framed to ``max_length`` (needs word_index)."""
    room = max_length - 2
    return f"""{name}_ex AS (
  SELECT id, pos, token FROM (
    SELECT id, unnest(list_slice(tokens, 1, {room})) AS token,
           unnest(range(1, len(list_slice(tokens, 1, {room})) + 1)) AS pos FROM {src})),
{name}_ids AS (
  SELECT e.id, list(coalesce(w.id, 3) ORDER BY e.pos) AS ids
  FROM {name}_ex e LEFT JOIN word_index w ON e.token = w.token GROUP BY e.id),
{name} AS (
  SELECT t.id, t.y, list_concat([1::BIGINT], coalesce(i.ids, []::BIGINT[]), [2::BIGINT],
         list_transform(range({room} - len(coalesce(i.ids, []::BIGINT[]))), lambda x: 0::BIGINT)) AS ids
  FROM {src} t LEFT JOIN {name}_ids i ON t.id = i.id)"""


def ids_str(expr: str) -> str:
    return f"array_to_string({expr}, ' ')"


def normalize(expr: str) -> str:
    return sql_normalize(expr)


def shuffle_key(purpose: str, key: str) -> str:
    return sql_shuffle_key(SEED, purpose, key)


def draw(purpose: str, *keys: str) -> str:
    return sql_draw(SEED, purpose, *keys)


def sql_tokenize_text(expr: str = "text") -> str:
    return sql_tokenize(expr)


# ---- vectors ------------------------------------------------------------

VOCAB_ALL_CTE = """vocab_all AS (SELECT DISTINCT unnest(tokens) AS token FROM toks)"""

DIM_CTE = """dimt AS (SELECT CAST(mode(len(embedding)) AS BIGINT) AS d, count(*) AS n FROM embeddings)"""

EMB_CTE = """emb AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS row,
                    list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings)"""


def wv_cte() -> str:
    return f"""wv AS (SELECT v.token, e.vec FROM vocab_all v CROSS JOIN dimt
  JOIN emb e ON e.row = {draw('wv', 'v.token')} % dimt.n)"""


def special_vec_sql(id_expr: str) -> str:
    """Needs ``dimt`` in scope (column ``d``)."""
    comp = (f"list_transform(range(dimt.d), lambda j: ((2.0::DOUBLE * {draw('special', id_expr, 'j')}"
            f" / 4294967296.0::DOUBLE) - 1.0::DOUBLE) * (1.0::DOUBLE / sqrt(dimt.d::DOUBLE)))")
    zeros = "list_transform(range(dimt.d), lambda j: 0.0::DOUBLE)"
    return f"(CASE WHEN {id_expr} = 0 THEN {zeros} ELSE {comp} END)"


def lookup_ctes() -> str:
    """``lookup(id, vec)`` and ``tv(token, vec)``; needs word_index, vocab_all, dimt, emb."""
    return f"""{wv_cte()},
lookup AS (
  SELECT w.id, CASE WHEN w.id IN (0, 1, 2, 3) THEN {special_vec_sql('w.id')}
                    ELSE coalesce(v.vec, {special_vec_sql('3')}) END AS vec
  FROM word_index w CROSS JOIN dimt LEFT JOIN wv v ON w.token = v.token),
tv AS (SELECT w.token, l.vec FROM word_index w JOIN lookup l ON w.id = l.id WHERE w.id > 3),
unkv AS (SELECT vec FROM lookup WHERE id = 3)"""


def pool_mean_ctes(name: str = "feat") -> str:
    """``{name}(id, j, value)`` long-format mean of token vectors (needs toks, tv, unkv, dimt)."""
    return f"""{name}_ex AS (
  SELECT t.id, u.token, u.pos FROM toks t, unnest(t.tokens) WITH ORDINALITY AS u(token, pos)),
{name}_g AS (
  SELECT e.id, coalesce(tv.vec, unkv.vec) AS vec FROM {name}_ex e CROSS JOIN unkv LEFT JOIN tv ON e.token = tv.token),
{name}_el AS (
  SELECT g.id, CAST(u.j - 1 AS INTEGER) AS j, avg(u.v) AS value
  FROM {name}_g g, unnest(g.vec) WITH ORDINALITY AS u(v, j) GROUP BY g.id, u.j),
{name} AS (
  SELECT t.id, CAST(r.j AS INTEGER) AS j, coalesce(el.value, 0.0::DOUBLE) AS value
  FROM toks t CROSS JOIN dimt CROSS JOIN range(dimt.d) r(j)
  LEFT JOIN {name}_el el ON el.id = t.id AND el.j = r.j)"""


# ---- scoring over `embeddings` with centroid weights -----------------------

# ---- fixed values ------------------------------------------------------
CENTROID_SCALE = 40.0  # logits = scale x class centroid . x (fixed oracle weights)
# -------------------------------------------------------------------------

EMB_SCORE_CTES = """e AS (SELECT vec_id, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS y, embedding
       FROM embeddings WHERE label IS NOT NULL),
nc AS (SELECT count(DISTINCT y) AS c, count(*) AS n FROM e),
ex AS (SELECT e.vec_id, e.y, CAST(u.j - 1 AS INTEGER) AS j, CAST(u.v AS DOUBLE) AS v
       FROM e, unnest(e.embedding) WITH ORDINALITY AS u(v, j)),
cent AS (SELECT y AS k, j, avg(v) * {scale}::DOUBLE AS w FROM ex GROUP BY y, j),
logit AS (SELECT ex.vec_id, ex.y, cent.k, sum(ex.v * cent.w) AS z
          FROM ex JOIN cent ON ex.j = cent.j GROUP BY ex.vec_id, ex.y, cent.k),
sm AS (SELECT vec_id, y, k, z, z - max(z) OVER (PARTITION BY vec_id) AS zs FROM logit),
prob AS (SELECT vec_id, y, k, z, exp(zs) / sum(exp(zs)) OVER (PARTITION BY vec_id) AS p,
                zs - ln(sum(exp(zs)) OVER (PARTITION BY vec_id)) AS logp FROM sm),
pred AS (SELECT vec_id, y, CAST(k AS INTEGER) AS pred FROM (
           SELECT vec_id, y, k, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS r FROM prob) WHERE r = 1),
py AS (SELECT vec_id, y, p AS p_y FROM prob WHERE k = y)""".replace("{scale}", repr(CENTROID_SCALE))


def comp_sql(epoch: int = 0) -> str:
    """``comp`` CTE: complementary label per row of ``e`` (needs nc)."""
    return f"""comp AS (SELECT e.vec_id, CAST((e.y + 1 + {draw('comp', str(epoch), 'e.vec_id')} % (nc.c - 1)) % nc.c AS INTEGER) AS k
  FROM e CROSS JOIN nc)"""


# ---- CNN scores (weights from keyed draws) ---------------------------------

def cnn_ctes(length: int, sizes=(2, 3, 4, 5, 6), n_filters: int = 5) -> str:
    """``cnnprob(id, k, p)``; needs enc (ids of ``length``), lookup, dimt, nclass(c)."""
    widths = ", ".join(f"({w})" for w in sizes)
    nf = n_filters * len(sizes)
    u = lambda *keys: f"({draw('cnn', *keys)} / 4294967296.0::DOUBLE)"
    return f"""widths AS (SELECT * FROM (VALUES {widths}) v(width)),
cw AS (SELECT w.width, f.f, j.j, list_transform(range(dimt.d), lambda e:
         (2.0::DOUBLE * {u("'conv' || CAST(w.width AS VARCHAR)", 'f.f', 'j.j', 'e')} - 1.0::DOUBLE)
         * (1.0::DOUBLE / sqrt((w.width * dimt.d)::DOUBLE))) AS wv
       FROM widths w CROSS JOIN range({n_filters}) f(f) CROSS JOIN range({max(sizes)}) j(j) CROSS JOIN dimt
       WHERE j.j < w.width),
cb AS (SELECT w.width, f.f, (2.0::DOUBLE * {u("'conv' || CAST(w.width AS VARCHAR) || '_b'", 'f.f')} - 1.0::DOUBLE)
         * (1.0::DOUBLE / sqrt((w.width * dimt.d)::DOUBLE)) AS b
       FROM widths w CROSS JOIN range({n_filters}) f(f) CROSS JOIN dimt),
cx AS (SELECT e.id, CAST(u.pos - 1 AS BIGINT) AS pos, l.vec
       FROM enc e, unnest(e.ids) WITH ORDINALITY AS u(wid, pos) JOIN lookup l ON l.id = u.wid),
proj AS (SELECT cx.id, cx.pos, cw.width, cw.f, cw.j, list_dot_product(cx.vec, cw.wv) AS pr FROM cx CROSS JOIN cw),
conv AS (SELECT id, width, f, pos - j AS t, sum(pr) AS s FROM proj
         WHERE pos - j >= 0 AND pos - j <= {length} - width GROUP BY id, width, f, pos - j),
pooled AS (SELECT c.id, c.width, c.f, max(greatest(c.s + cb.b, 0.0::DOUBLE)) AS h
           FROM conv c JOIN cb ON c.width = cb.width AND c.f = cb.f GROUP BY c.id, c.width, c.f),
fcw AS (SELECT k.k, m.m, (2.0::DOUBLE * {u("'fc'", 'k.k', 'm.m')} - 1.0::DOUBLE) * (1.0::DOUBLE / sqrt({nf}.0::DOUBLE)) AS w
        FROM nclass CROSS JOIN range(nclass.c) k(k) CROSS JOIN range({nf}) m(m)),
fcb AS (SELECT k.k, (2.0::DOUBLE * {u("'fc_b'", 'k.k')} - 1.0::DOUBLE) * (1.0::DOUBLE / sqrt({nf}.0::DOUBLE)) AS b
        FROM nclass CROSS JOIN range(nclass.c) k(k)),
clogit AS (SELECT p.id, fcw.k, sum(p.h * fcw.w) + fcb.b AS z
           FROM pooled p JOIN fcw ON fcw.m = (p.width - {min(sizes)}) * {n_filters} + p.f
           JOIN fcb ON fcb.k = fcw.k GROUP BY p.id, fcw.k, fcb.b),
cshift AS (SELECT id, k, exp(z - max(z) OVER (PARTITION BY id)) AS ez FROM clogit),
cnnprob AS (SELECT id, k, ez / sum(ez) OVER (PARTITION BY id) AS p FROM cshift)"""


def cnn_gradient_ctes(rates=(0.0, 0.1), epoch: int = 3, sizes=(2, 3, 4, 5, 6), n_filters: int = 5) -> str:
    """``cnngrad(rate, i, g)``: mean gradient of the NLL by place in the flat
    parameters, per dropout rate; needs the CTEs of :func:`cnn_ctes`."""
    nf, low = n_filters * len(sizes), min(sizes)
    wide = 18446744073709551616

    def mixed(x, shift, factor):
        y = f"xor(CAST({x} AS UHUGEINT), CAST({x} AS UHUGEINT) >> {shift})"
        return f"(({y}) * {factor}::UHUGEINT) % {wide}::UHUGEINT" if factor else y

    start = (f"((g.id::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT) % {wide}::UHUGEINT"
             f" + (g.m::UHUGEINT * {0xBF58476D1CE4E5B9}::UHUGEINT) % {wide}::UHUGEINT"
             f" + {(SEED * 1000003 + epoch) & 0xFFFFFFFF}::UHUGEINT) % {wide}::UHUGEINT")
    before = " + ".join(f"CASE WHEN g.width > {w} THEN {n_filters} * ({w} * dimt.d + 1) ELSE 0 END" for w in sizes)
    convs = " + ".join(f"{n_filters} * ({w} * dimt.d + 1)" for w in sizes)
    rows = ", ".join(f"({r}::DOUBLE)" for r in rates)
    return f"""rates AS (SELECT * FROM (VALUES {rows}) v(rate)),
best AS (SELECT id, width, f, t, v, CAST((width - {low}) * {n_filters} + f AS BIGINT) AS m FROM (
  SELECT c.id, c.width, c.f, c.t, c.s + cb.b AS v, row_number() OVER (
           PARTITION BY c.id, c.width, c.f ORDER BY greatest(c.s + cb.b, 0.0::DOUBLE) DESC, c.t) AS r
  FROM conv c JOIN cb ON c.width = cb.width AND c.f = cb.f) WHERE r = 1),
m0 AS (SELECT g.*, {start} AS x FROM best g),
m1 AS (SELECT * REPLACE ({mixed('x', 30, 0xBF58476D1CE4E5B9)} AS x) FROM m0),
m2 AS (SELECT * REPLACE ({mixed('x', 27, 0x94D049BB133111EB)} AS x) FROM m1),
m3 AS (SELECT * REPLACE ({mixed('x', 31, None)} AS x) FROM m2),
hid AS (SELECT m3.* EXCLUDE (x), rate, CASE WHEN rate = 0 THEN 1.0::DOUBLE
          WHEN CAST(x >> 11 AS DOUBLE) / 9007199254740992.0::DOUBLE >= rate THEN 1.0::DOUBLE / (1.0::DOUBLE - rate)
          ELSE 0.0::DOUBLE END AS mask FROM m3 CROSS JOIN rates),
gz AS (SELECT h.rate, h.id, fcw.k, sum(greatest(h.v, 0.0::DOUBLE) * h.mask * fcw.w) + any_value(fcb.b) AS z
       FROM hid h JOIN fcw ON fcw.m = h.m JOIN fcb ON fcb.k = fcw.k GROUP BY h.rate, h.id, fcw.k),
ge AS (SELECT *, exp(z - max(z) OVER (PARTITION BY rate, id)) AS ez FROM gz),
dz AS (SELECT ge.rate, ge.id, ge.k, ez / sum(ez) OVER (PARTITION BY ge.rate, ge.id)
              - CASE WHEN e.y = ge.k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dz FROM ge JOIN enc e ON e.id = ge.id),
dh AS (SELECT h.rate, h.id, h.width, h.f, h.t,
              sum(dz.dz * fcw.w) * any_value(h.mask) * CASE WHEN any_value(h.v) > 0 THEN 1 ELSE 0 END AS dh
       FROM hid h JOIN dz ON dz.id = h.id AND dz.rate = h.rate JOIN fcw ON fcw.m = h.m AND fcw.k = dz.k
       GROUP BY h.rate, h.id, h.width, h.f, h.t),
shifted AS (SELECT g.*, j.j, cx.vec FROM dh g CROSS JOIN range({max(sizes)}) j(j)
            JOIN cx ON cx.id = g.id AND cx.pos = g.t + j.j WHERE j.j < g.width AND g.dh <> 0),
flat AS (
  SELECT g.rate, {before} + (g.f * g.width + g.j) * dimt.d + u.e - 1 AS i, sum(g.dh * u.v) AS g
  FROM shifted g CROSS JOIN dimt, unnest(g.vec) WITH ORDINALITY AS u(v, e) GROUP BY ALL
  UNION ALL SELECT g.rate, {before} + {n_filters} * g.width * dimt.d + g.f, sum(g.dh)
  FROM dh g CROSS JOIN dimt GROUP BY ALL
  UNION ALL SELECT h.rate, {convs} + dz.k * {nf} + h.m, sum(dz.dz * greatest(h.v, 0.0::DOUBLE) * h.mask)
  FROM hid h JOIN dz ON dz.id = h.id AND dz.rate = h.rate CROSS JOIN dimt GROUP BY ALL
  UNION ALL SELECT dz.rate, {convs} + (SELECT c FROM nclass) * {nf} + dz.k, sum(dz.dz) FROM dz CROSS JOIN dimt GROUP BY ALL),
places AS (SELECT rate, i.i FROM rates CROSS JOIN dimt CROSS JOIN nclass, range({convs} + c * ({nf} + 1)) i(i)),
cnngrad AS (SELECT p.rate, p.i, coalesce(g, 0.0::DOUBLE) / (SELECT count(*) FROM enc) AS g
            FROM places p LEFT JOIN flat ON flat.rate = p.rate AND flat.i = p.i)"""
