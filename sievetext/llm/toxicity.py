"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a logistic score over its
words; a document is toxic if any sentence is, so its score is the noisy-or of
the sentence scores.  Only document labels train the sentence weights.

The model is fitted on the driver over a bounded sample of labelled documents:
``SAMPLE_DOCS`` of them, half of each class where there are so many, the least
by a hash, as far as their whole texts stay within ``SAMPLE_CHARS`` characters
in all.  The bias is then corrected for the classes' sampling rates.  The model
is a table of word weights and serves all documents, whole texts, in place.
Documents are not shuffled; their ids and lengths meet the labels.

Defined cases: null and empty texts, and texts without words, have no sentence
and score 0; documents with several label rows count once per row in training;
an empty training sample gives score 0 everywhere; repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import crc_mod, small_batches, without

SAMPLE_DOCS = 6000
SAMPLE_CHARS = 20_000_000
MIN_DOCS = 5
STEMS = (4, 5, 6)
CACHE_WORDS = 200_000
MAX_FEATURES = 2000
HELD_OUT = 5
_SENTENCE = re.compile(r"[^.!?\n]+")
# Bytes that end sentences become line ends; other ASCII that is neither a
# letter nor a digit separates words.
_SPLIT = bytes(10 if chr(b) in ".!?\n" else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def sentences(text: str | None) -> list[list[bytes]]:
    """Word lists of the sentences that have words."""
    if not text:
        return []
    lines = text.lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split(b"\n")
    return [w for w in (s.split() for s in lines) if w]


def features(word: bytes) -> tuple[bytes, ...]:
    """The word, and its beginnings (stems of inflected words) as ``stem*``."""
    return (word, *(word[:n] + b"*" for n in STEMS if len(word) >= n))


@dataclass
class Model:
    """Feature weights and bias of the sentence score."""

    weights: dict[bytes, float]
    bias: float
    known: dict[bytes, float] = field(default_factory=dict, repr=False)

    def weight(self, word: bytes) -> float:
        """Sum of the word's feature weights, kept in a bounded cache."""
        w = self.known.get(word)
        if w is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            get = self.weights.get
            w = self.known[word] = sum(get(f, 0.0) for f in features(word))
        return w

    def logits(self, bag: list[list[bytes]]) -> list[float]:
        """Sentence logits; a feature counts once a sentence, its words too."""
        return [self.bias + sum(map(self.weight, set(s))) for s in bag]

    def score(self, text: str | None) -> float:
        """Noisy-or of the sentence scores."""
        bag = sentences(text)
        log_clean = -sum(math.log1p(math.exp(z)) if z < 30 else z for z in self.logits(bag))
        return -math.expm1(log_clean)

    def locate(self, text: str | None, threshold: float = 0.5) -> list[tuple[int, int, float]]:
        """Sentences ``(start, end, score)`` at or above the threshold, in code
        points; in a toxic document at least its worst one."""
        found = []
        for m in _SENTENCE.finditer(text or ""):
            bag = sentences(m.group())
            if bag:
                z = max(-30.0, min(30.0, self.logits(bag)[0]))
                found.append((m.start(), m.end(), 1 / (1 + math.exp(-z))))
        over = [s for s in found if s[2] >= threshold]
        if not over and found and self.score(text) >= threshold:
            over = [max(found, key=lambda s: s[2])]
        return over


def screened(bags: list[list[list[bytes]]], y: np.ndarray, min_docs: int) -> dict[bytes, int]:
    """The features of ``min_docs`` documents or more whose shares of toxic and
    clean documents differ most, by the two-sample z of the shares."""
    seen: dict[bytes, list[int]] = {}
    for bag, label in zip(bags, y, strict=True):
        for f in {f for w in {w for s in bag for w in s} for f in features(w)}:
            seen.setdefault(f, [0, 0])[int(label > 0)] += 1
    names = sorted(f for f, n in seen.items() if sum(n) >= min_docs)
    counts = np.array([seen[f] for f in names], float).reshape(-1, 2)
    total = np.array([(y <= 0).sum(), (y > 0).sum()], float)
    share = counts / total
    both = counts.sum(1) / total.sum()
    z = np.abs(share[:, 1] - share[:, 0]) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / total).sum())
    top = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    return {names[k]: i for i, k in enumerate(sorted(top.tolist()))}


def fit(bags: list[list[list[bytes]]], labels: list[int], min_docs: int = MIN_DOCS,
        l1: float = 5e-5, steps: int = 150, rate: float = 0.2) -> Model:
    """Full-batch Adam on the noisy-or likelihood of document labels; the step
    of an absolute-value penalty after each update keeps only useful features."""
    y = np.array([v for v, bag in zip(labels, bags, strict=True) if bag], float)
    bags = [bag for bag in bags if bag]
    if not bags or y.min() == y.max():
        return Model({}, -30.0 if not bags or y.max() < 1 else 30.0)
    vocab = screened(bags, y, min_docs)
    word, row, doc = [], [], []
    n = 0
    for d, bag in enumerate(bags):
        for s in bag:
            ids = [vocab[f] for w in set(s) for f in features(w) if f in vocab]
            word += ids
            row += [n] * len(ids)
            doc.append(d)
            n += 1
    word, row, doc = (np.array(a, np.int64) for a in (word, row, doc))
    theta = np.zeros(len(vocab) + 1)
    theta[-1] = math.log(y.mean() * len(y) / n)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = theta[-1] + np.bincount(row, weights=theta[word], minlength=n)
        z = np.clip(z, -30, 30)
        log_clean = np.bincount(doc, weights=-np.log1p(np.exp(z)), minlength=len(y))
        p = np.clip(-np.expm1(log_clean), 1e-9, 1 - 1e-9)
        # Derivative of the loss by a sentence's logit: its score, times 1 in
        # clean documents and -(1 - p) / p in toxic ones.
        g_z = np.where(y[doc] > 0, -(1 - p[doc]) / p[doc], 1.0) / (1 + np.exp(-z)) / len(y)
        grad = np.empty_like(theta)
        grad[:-1] = np.bincount(word, weights=g_z[row], minlength=len(vocab))
        grad[-1] = g_z.sum()
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        size = rate / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-6)
        theta -= size * (m / (1 - 0.9 ** t))
        shrink = np.maximum(np.abs(theta[:-1]) - size[:-1] * l1, 0.0)
        theta[:-1] = np.sign(theta[:-1]) * shrink
    keep = np.abs(theta[:-1]) > 1e-3
    return Model({w: float(theta[k]) for w, k in vocab.items() if keep[k]}, float(theta[-1]))


def sample_places(clean: list[int], toxic: list[int], docs: int, chars: int) -> tuple[list[int], list[int]]:
    """Which texts of both classes, given their lengths in sample order, fill
    ``docs`` places and ``chars`` characters: either class may use half of both,
    and what the other leaves.  A text that no longer fits is passed over."""
    def fill(lengths: list[int], other: list[int], used: int, part: int = 1) -> list[int]:
        out, space = [], chars // part - used
        for k, n in enumerate(lengths):
            if len(out) >= docs // part - len(other):
                break
            if n <= space:
                out.append(k)
                space -= n
        return out

    half = fill(toxic, [], 0, 2)
    picked = fill(clean, half, sum(toxic[k] for k in half))
    return picked, fill(toxic, picked, sum(clean[k] for k in picked))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS,
          held_out: int = HELD_OUT, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Model from labelled documents whose crc32(id) is not 0 modulo ``held_out``."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()
                          & (crc_mod("doc_id", held_out) != 0))
    # Only labelled documents that have words take places.
    bodies = docs.select("doc_id", F.col("text").alias("body")).where(
        F.col("body").rlike("[0-9A-Za-z]|[^\x00-\x7F]")).withColumn("hash", F.xxhash64("body"))
    found = materialize(
        bodies.select("doc_id", "hash", F.length("body").alias("chars"))
        .join(usable.select("doc_id", F.col("toxic").cast("int").alias("label")), "doc_id"), "labelled")
    rank = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("label"), F.col("hash")]
    clean, toxic = (found.where((F.col("label") > 0) == F.lit(c)).orderBy(*rank).limit(sample_docs).collect()
                    for c in (False, True))
    kept = sample_places([r["chars"] for r in clean], [r["chars"] for r in toxic], sample_docs, sample_chars)
    copies = Counter((r[k]["doc_id"], r[k]["hash"], r[k]["label"])
                     for r, picked in zip((clean, toxic), kept, strict=True) for k in picked)
    chosen = docs.sparkSession.createDataFrame(
        sorted({c[:2] for c in copies}), found.select("doc_id", "hash").schema)
    texts = {(r["doc_id"], r["hash"]): sentences(r["body"])
             for r in bodies.join(F.broadcast(chosen), ["doc_id", "hash"])
             .dropDuplicates(["doc_id", "hash"]).collect()}
    rows = [(texts[c[:2]], c[2]) for c, n in sorted(copies.items()) for _ in range(n)]
    model = fit([bag for bag, _ in rows], [label for _, label in rows])
    if all(kept):
        # The classes were sampled at different rates; the odds go back to the labels'.
        n = {r["y"]: r["count"] for r in found.groupBy((F.col("label") > 0).alias("y")).count().collect()}
        model.bias += math.log(len(kept[0]) / n[False]) - math.log(len(kept[1]) / n[True])
    return model


_RESULT = pa.struct([("score", pa.float64()), ("sentences", pa.list_(pa.struct([
    ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])
_RESULT_DDL = "struct<score:double,sentences:array<struct<start:int,end:int,score:double>>>"


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text",
                  output: str = "toxicity", threshold: float = 0.5) -> DataFrame:
    """``docs`` plus ``output``: the document score and its offending sentences."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_RESULT_DDL)
    def judge(texts: pa.Array) -> pa.Array:
        model, rows = shared.value, []
        for t in texts:
            text = t.as_py()
            score = model.score(text)
            found = model.locate(text, threshold) if score >= threshold else []
            rows.append({"score": score, "sentences": [
                {"start": a, "end": b, "score": s} for a, b, s in found]})
        return pa.array(rows, type=_RESULT)

    return without(small_batches(docs), output).withColumn(output, judge(F.col(text_col).cast("string")))


def held_out(n: int = HELD_OUT) -> Column:
    return crc_mod("doc_id", n) == 0


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of the registered query."""
    model = train(docs, labels)
    found = with_toxicity(docs.select("doc_id", "text"), model, output="t")
    worst = F.array_max(F.transform("t.sentences", lambda s: F.struct(
        s["score"].alias("score"), s["start"].alias("start"), s["end"].alias("end"))))
    return found.select("doc_id", held_out().alias("held_out"), F.col("t.score").alias("score"),
                        (F.col("t.score") >= 0.5).cast("int").alias("predicted"),
                        F.size("t.sentences").cast("long").alias("n_toxic_sentences"),
                        worst["start"].alias("worst_start"), worst["end"].alias("worst_end"))
