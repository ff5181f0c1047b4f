"""Language labels by a linear-chain conditional random field over words.

Every word has affix features (its beginnings and ends of two to four letters),
character n-grams (one to three letters, with word ends) and the lexicon it
belongs to; languages follow each other with learned transition weights.
Forward-backward gives every word's label probabilities in a possibly
code-switched text, and their mean over the words gives the text's language.

The field is fitted on the driver over a bounded sample (about ``SAMPLE_DOCS``
documents a language by a hash of the id, ``SAMPLE_TOTAL`` in all, the first
``SAMPLE_CHARS`` characters of each).  Its training sequences join stretches of two languages, so switches
are learned from data although documents carry one label each.  Labelling runs
over whole texts in place; documents are not shuffled.

Defined cases: null texts and texts without letters are ``und`` with score 0;
rows with a null language are labelled but not learned from; with no usable row
everything is ``und``; repeated rows are labelled each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, small_batches, without

UNDETERMINED = "und"
SAMPLE_DOCS = 200
SAMPLE_TOTAL = 2000
SAMPLE_CHARS = 1_600_000
MAX_LANGUAGES = 200
FOLDS, HELD_OUT_FOLD = 3, 1
BITS, LEXICON_BITS = 18, 20
GROUP_CHARS = 1 << 21
BLOCK = 32
#: Languages up to which the two sizes above hold; with more, blocks grow and groups shrink.
_FEW = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _slot(key: np.ndarray, bits: int = BITS) -> np.ndarray:
    return ((key * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Words:
    """The words of some texts: padded code points (0: no letter), first letter,
    length, text and hash of every word."""

    code: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    text: np.ndarray
    key: np.ndarray

    def slots(self, pick: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Feature slots of the words at ``pick``: where their letters start, three
        slots per letter (n-grams that end there), six per word (affixes)."""
        c, begin, length = self.code, self.begin[pick], self.length[pick]
        start = np.cumsum(length) - length
        at = np.arange(int(length.sum())) + np.repeat(begin - start, length)
        u = np.uint64
        here, one = c[at], c[at - 1]
        two = np.where(one > 0, c[at - 2], u(0))
        chars = [_slot(here * u(8) + u(1)), _slot((here << u(21) | one) * u(8) + u(2)),
                 _slot(((here << u(42)) ^ (one << u(21)) ^ two) * u(8) + u(3))]
        ends = []
        for side, edge, step in ((u(4), begin, 1), (u(5), begin + length - 1, -1)):
            key, inside = c[edge], np.ones(len(edge), bool)
            for n in range(1, 4):
                inside = inside & (c[edge + step * n] > 0)
                key = key * u(1000003) + np.where(inside, c[edge + step * n], u(0)) + u(n)
                ends.append(_slot(key * u(8) + side))
        return start, chars, ends


class Featurizer:
    """Words of texts, found on arrays of code points."""

    def __init__(self):
        self.letter = _letters()

    def __call__(self, texts: list[str]) -> Words:
        low = [t.lower() for t in texts]
        sizes = np.fromiter((len(t) + 1 for t in low), np.int64, len(low))
        raw = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        # Zeros around keep all neighbours inside the array.
        c = np.zeros(len(raw) + 8, np.uint64)
        c[4:-4] = raw * self.letter[raw]
        border = np.flatnonzero((c[1:] > 0) != (c[:-1] > 0)) + 1
        begin, length = border[::2], border[1::2] - border[::2]
        start = np.cumsum(length) - length
        at = np.arange(int(length.sum())) + np.repeat(begin - start, length)
        power = _powers(int(length.max()) if len(length) else 1)
        place = at - np.repeat(begin, length)
        key = np.add.reduceat(c[at] * power[place], start) if len(start) else np.zeros(0, np.uint64)
        text = np.searchsorted(np.cumsum(sizes), begin - 4, side="right")
        return Words(c, begin, length, text, key)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x100000001B3, np.uint64)
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Field:
    """Weights: a row of feature weights per slot, lexicon rows after them, the
    language of each lexicon slot (-1: none), and transitions."""

    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    transitions: np.ndarray

    def lexical(self, key: np.ndarray) -> np.ndarray:
        """Weight row of the word's lexicon; the last row is for none."""
        found = self.lexicon[_slot(key, LEXICON_BITS)].astype(np.int64)
        return (1 << BITS) + np.where(found < 0, len(self.languages), found)

    def emissions(self, words: Words) -> np.ndarray:
        """Score of every word (rows) for every language; equal words are scored once."""
        _, pick, place = np.unique(words.key, return_index=True, return_inverse=True)
        start, chars, ends = words.slots(pick)
        out = np.add.reduceat(sum(self.weights[s] for s in chars), start, axis=0)
        for s in (*ends, self.lexical(words.key[pick])):
            out = out + self.weights[s]
        return out[place]


def block_words(languages: int) -> int:
    """Words of a block: a block has a matrix of languages x languages, so blocks
    grow with its size and the matrices of a text do not."""
    return BLOCK * max(1, -(-languages * languages // (_FEW * _FEW)))


def group_chars(languages: int) -> int:
    """Characters that are labelled together: every word has a number per language."""
    return max(1, GROUP_CHARS * _FEW // max(_FEW, languages))


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward label probabilities of chains laid end to end (every
    chain has a word; a chain starts from any label).

    Chains are cut into blocks of :func:`block_words` words; all blocks move in step,
    once to get their transfer matrices, and once from the states that these
    give at the block borders, so a long chain needs few array steps.  Blocks
    are laid out longest first: those with a word at a step are a prefix."""
    n, k = scores.shape
    width = min(block_words(k), int(lengths.max()))
    blocks = -(-lengths // width)
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    size = np.full(total, width)
    size[first + blocks - 1] = lengths - (blocks - 1) * width
    order = np.argsort(-size, kind="stable")
    spot = np.empty(total, np.int64)
    spot[order] = np.arange(total)
    active = (total - np.searchsorted(np.sort(size), np.arange(width), side="right")).tolist()
    chain = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    where = (place % width, spot[first[chain] + place // width])
    e = np.ones((width, total, k), scores.dtype)
    e[where] = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -15.0))
    t = np.exp(transitions - transitions.max()).astype(scores.dtype)

    def scaled(x):
        return x / x.max(axis=tuple(range(1, x.ndim)), keepdims=True)

    transfer = np.broadcast_to(np.eye(k, dtype=e.dtype), (total, k, k)).copy()
    for s, m in enumerate(active):
        step = (transfer[:m].reshape(-1, k) @ t).reshape(m, k, k) * e[s, :m, None, :]
        transfer[:m] = scaled(step) if s % 2 else step
    transfer = scaled(transfer)
    before = np.full((total, k), 1.0 / k, e.dtype)
    after = np.ones((total, k), e.dtype)
    for j in range(1, int(blocks.max())):
        b = first[blocks > j] + j
        before[spot[b]] = scaled(np.einsum("bi,bij->bj", before[spot[b - 1]], transfer[spot[b - 1]]))
    for j in range(int(blocks.max()) - 2, -1, -1):
        b = first[blocks > j + 1] + j
        after[spot[b]] = scaled(np.einsum("bij,bj->bi", transfer[spot[b + 1]], after[spot[b + 1]]))
    alpha = np.empty_like(e)
    state = before
    for s, m in enumerate(active):
        state = (state[:m] @ t) * e[s, :m]
        state = scaled(state) if s % 2 else state
        alpha[s, :m] = state
    for s in range(width - 1, -1, -1):
        m = active[s]
        alpha[s, :m] *= after[:m]
        step = (e[s, :m] * after[:m]) @ t.T
        after[:m] = scaled(step) if s % 2 else step
    out = alpha[where]
    return out / out.sum(axis=1, keepdims=True)


def _pair_gradient(scores, labels, lengths, transitions):
    """Marginals, and the gradient of the transition weights (expected less
    observed pairs) of equally long chains, each started from any label."""
    k = scores.shape[1]
    size = int(lengths[0])
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(-1, size, k)
    y = labels.reshape(-1, size)
    t = np.exp(transitions - transitions.max())
    a = np.empty_like(e)
    state = np.full((len(e), k), 1.0 / k)
    for s in range(size):
        state = (state @ t) * e[:, s]
        state /= state.sum(axis=1, keepdims=True)
        a[:, s] = state
    b = np.ones((len(e), k))
    grad = np.zeros((k, k))
    p = np.empty_like(e)
    for s in range(size - 1, -1, -1):
        p[:, s] = a[:, s] * b
        p[:, s] /= p[:, s].sum(axis=1, keepdims=True)
        if s:
            pair = a[:, s - 1, :, None] * t * (e[:, s] * b)[:, None, :]
            grad += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            np.add.at(grad, (y[:, s - 1], y[:, s]), -1.0)
        b = (e[:, s] * b) @ t.T
        b /= b.sum(axis=1, keepdims=True)
    return p.reshape(-1, k), grad


def fit(texts: list[str], labels: list[str], steps: int = 30, rate: float = 0.2, l2: float = 1e-6,
        size: int = 24, seed: int = 7) -> Field:
    """A field from labelled texts, by full-batch Adam on the likelihood of
    word labels in sequences of up to ``size`` words; half of the sequences go
    on with words of another text.  Short texts and remainders are sequences too."""
    languages = sorted(set(labels))
    k = len(languages)
    featurize, rng = Featurizer(), np.random.default_rng(seed)
    words = featurize(texts)
    code = {name: i for i, name in enumerate(languages)}
    label = np.array([code[v] for v in labels], np.int64)[words.text] if len(words.text) else np.zeros(0, np.int64)
    lexicon = np.full(1 << LEXICON_BITS, -1, np.int16)
    field = Field(languages, np.zeros(((1 << BITS) + k + 1, k), np.float32), lexicon, np.zeros((k, k)))
    if k < 2 or not len(label):
        return field
    # Lexicon: words seen three times or more, nine in ten of them in one language.
    slot = _slot(words.key, LEXICON_BITS)
    seen = np.stack([np.bincount(slot[label == i], minlength=1 << LEXICON_BITS) for i in range(k)], axis=1)
    share = seen / np.maximum(1, np.bincount(label, minlength=k))
    best = share.argmax(axis=1)
    sure = (seen.sum(axis=1) >= 3) & (share.max(axis=1) >= 0.9 * share.sum(axis=1))
    lexicon[sure] = best[sure]
    # Sequences: the texts in runs of up to `size` words; half of the runs, cut
    # at random where long enough, go on with the end of another run.
    first = np.flatnonzero(np.append(True, words.text[1:] != words.text[:-1]))
    count = np.diff(np.append(first, len(label)))
    runs = -(-count // size)
    nth = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
    start = np.repeat(first, runs) + nth * size
    length = np.minimum(size, np.repeat(first + count, runs) - start)
    other = rng.permutation(len(start))
    switch = rng.random(len(start)) < 0.5
    cut = rng.integers(3, np.maximum(4, length - 2))
    head = np.where(switch & (length > 5), cut, length)
    tail = np.where(switch, np.minimum(length[other], size - head), 0)
    rest = (start + length)[other] - tail
    # Equally long sequences lie together.
    order = np.argsort(head + tail, kind="stable")
    start, head, tail, rest = (x[order] for x in (start, head, tail, rest))
    lengths = head + tail
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    chosen = inside + np.where(inside < np.repeat(head, lengths), np.repeat(start, lengths),
                               np.repeat(rest - head, lengths))
    group = np.searchsorted(lengths, np.unique(lengths))
    edges = np.append(np.append(0, np.cumsum(lengths))[group], len(chosen))
    y = label[chosen]
    # Features of the chosen words as (feature, word) pairs.
    _, chars, ends = words.slots(chosen)
    owner = np.repeat(np.arange(len(chosen)), words.length[chosen])
    whole = [*ends, field.lexical(words.key[chosen])]
    feature = np.concatenate(chars + whole)
    owner = np.concatenate([owner] * len(chars) + [np.arange(len(chosen))] * len(whole))
    order = np.argsort(owner, kind="stable")
    feature, owner = feature[order], owner[order]
    used, feature = np.unique(feature, return_inverse=True)
    begin = np.searchsorted(owner, np.arange(len(chosen)))
    w, tr = np.zeros((len(used), k)), np.zeros((k, k))
    m1, v1, m2, v2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)
    onehot = np.eye(k)[y]
    p = np.empty((len(chosen), k))
    for step in range(1, steps + 1):
        scores = np.add.reduceat(w[feature], begin, axis=0)
        pairs = np.zeros((k, k))
        for at, a, b in zip(group, edges, edges[1:], strict=False):
            p[a:b], part = _pair_gradient(scores[a:b], y[a:b], lengths[at:], tr)
            pairs += part
        g = (p - onehot) / len(start)
        grad = np.stack([np.bincount(feature, weights=g[owner, i], minlength=len(used))
                         for i in range(k)], axis=1) + l2 * w
        pairs = pairs / len(start) + l2 * tr
        c1, c2 = 1 - 0.9 ** step, 1 - 0.999 ** step
        for x, d, m, v in ((w, grad, m1, v1), (tr, pairs, m2, v2)):
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            x -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-5)
    field.weights[used] = w
    field.transitions[:] = tr
    return field


def label_texts(field: Field, featurize: Featurizer, texts: list[str | None]) -> list[dict]:
    """Language, score, words, switches and words by language of each text.
    Texts are taken together up to about :func:`group_chars` characters."""
    most = group_chars(len(field.languages))
    out: list[dict] = []
    group: list[str] = []
    chars = 0
    for t in texts:
        group.append(t or "")
        chars += len(group[-1])
        if chars >= most:
            out += _label_group(field, featurize, group)
            group, chars = [], 0
    return out + (_label_group(field, featurize, group) if group else [])


def _label_group(field: Field, featurize: Featurizer, texts: list[str]) -> list[dict]:
    words = featurize(texts)
    lengths = np.bincount(words.text, minlength=len(texts)) if len(words.text) else np.zeros(len(texts), np.int64)
    languages = field.languages
    k = len(languages)
    none = {"lang": UNDETERMINED, "score": 0.0, "words": 0, "switches": 0, "mix": []}
    if not k or not len(words.text):
        return [none] * len(texts)
    has = np.flatnonzero(lengths)
    p = marginals(field.emissions(words), lengths[has], field.transitions)
    begin = np.cumsum(lengths[has]) - lengths[has]
    mean = np.add.reduceat(p, begin, axis=0) / lengths[has][:, None]
    best = p.argmax(axis=1)
    change = np.append(0, (best[1:] != best[:-1]).astype(np.int64))
    change[begin] = 0
    switches = np.add.reduceat(change, begin)
    counts = np.add.reduceat(np.eye(k, dtype=np.int64)[best], begin, axis=0)
    out = [none] * len(texts)
    for i, d in enumerate(has.tolist()):
        top = int(mean[i].argmax())
        out[d] = {"lang": languages[top], "score": min(1.0, float(mean[i, top])),
                  "words": int(lengths[d]), "switches": int(switches[i]),
                  "mix": [{"lang": languages[j], "words": int(counts[i, j])} for j in np.flatnonzero(counts[i])]}
    return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS,
          max_languages: int = MAX_LANGUAGES) -> Field:
    """Field from documents with a language whose crc32(id) modulo 3 is not 1.

    The sample is of whole texts, drawn by a hash of the id: at most
    ``sample_docs`` a language, and an equal share of ``sample_chars`` characters
    in all for each (but one text at least, the shortest of those drawn where
    all are longer).  More than ``max_languages`` languages are an error."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                        & (crc_mod("doc_id", FOLDS) != HELD_OUT_FOLD))
    counts = (usable.groupBy("lang").agg(F.count("*").alias("n"))
              .orderBy(F.col("n").desc(), "lang").limit(max_languages + 1).collect())
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages to learn; raise max_languages or join some")
    share = F.lit(0.0)
    sample_docs = min(sample_docs, max(1, SAMPLE_TOTAL // max(1, len(counts))))
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, sample_docs / r["n"]))).otherwise(share)
    most = sample_chars // max(1, len(counts))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = usable.where(draw < share).select("doc_id", "lang", F.col("text").alias("body"), draw.alias("draw"),
                                              F.length("text").cast("long").alias("n"))
    long = F.col("n") > most
    order = Window.partitionBy("lang").orderBy(long, F.when(long, F.col("n")), "draw", "doc_id", "body")
    ranked = drawn.withColumns({"upto": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)),
                                "rank": F.row_number().over(order)})
    rows = (ranked.where((F.col("upto") <= most) | (F.col("rank") == 1)).select("doc_id", "lang", "body")
            .orderBy("doc_id", "lang", "body").collect())
    return fit([r["body"] for r in rows], [r["lang"] for r in rows])


_RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("words", pa.int64()),
                     ("switches", pa.int64()),
                     ("mix", pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())])))])
_RESULT_DDL = ("struct<lang:string,score:double,words:bigint,switches:bigint,"
               "mix:array<struct<lang:string,words:bigint>>>")


def with_language(docs: DataFrame, field: Field, text_col: str = "text",
                  output: str = "language") -> DataFrame:
    """``docs`` plus ``output``: language, score, words, switches, words by language."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf(_RESULT_DDL)
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        featurize = Featurizer()
        for texts in batches:
            yield pa.array(label_texts(shared.value, featurize, texts.to_pylist()), type=_RESULT)

    return without(small_batches(docs), output).withColumn(output, label(F.col(text_col).cast("string")))


def language_digest(docs: DataFrame) -> DataFrame:
    """The rows of the registered query."""
    field = train(docs)
    found = with_language(docs.select("doc_id", "text"), field, output="l")
    return found.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT_FOLD).alias("held_out"),
                        F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"),
                        F.col("l.words").alias("n_words"), F.col("l.switches").alias("n_switches"),
                        F.array_join(F.transform("l.mix", lambda m: F.concat_ws(":", m["lang"], m["words"])),
                                     ",").alias("mix"))
