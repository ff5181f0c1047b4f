"""Vector side of the preparation: word vectors -> lookup table -> pooled
features (the frozen-embedding input of the classifiers)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frequent import packed, unpacked
from ..operators.joins import hot_keys
from ..operators.vectors import (assign_vectors, broadcast_budget, filled_lookup, mean_pool,
                                 special_vector)
from ..operators.vocab import UNK_ID
from ..session import materialize
from ..sources.tables import table
from .prepare import Prepared, prepare


def embeddings_dim(embeddings: DataFrame, vec_col: str = "embedding") -> int:
    """Most common vector length of a vector table."""
    return int(embeddings.agg(F.mode(F.size(vec_col))).first()[0])


class Vectors:
    """Word vectors for a prepared corpus.

    ``vectors``: ``(token, vec)`` for every word of the corpus, the content a
    pre-trained vector file would have (built from ``embeddings`` by a keyed
    rule).  ``table``: ``(id, token, vec)`` for every id of the word index,
    written once, in single precision where that is exact; ``lookup`` and ``token_vecs`` are projections of it.
    """

    def __init__(self, prep: Prepared, seed: int = 7):
        self.prep, self.seed = prep, seed
        self.embeddings = table(prep.spark, prep.sf_dir, "embeddings")
        # dimension (most common length, A7) and row count in one pass
        stats = self.embeddings.agg(F.mode(F.size("embedding")).alias("d"),
                                    F.count(F.lit(1)).alias("n")).first()
        self.dim, self.n_vectors = int(stats["d"]), int(stats["n"])

    @cached_property
    def vectors(self) -> DataFrame:
        return assign_vectors(self.prep.vocab_all, self.embeddings, seed=self.seed, n=self.n_vectors)

    @cached_property
    def table(self) -> DataFrame:
        t = self.prep.index.join(self.vectors.select("token", *packed()), "token", "left")
        t = materialize(t, "lookup") if self.prep.materialized else t
        return filled_lookup(t.select("id", "token", unpacked().alias("vec")), self.dim, self.seed)

    @property
    def lookup(self) -> DataFrame:
        return self.table.select("id", "vec")

    @property
    def token_vecs(self) -> DataFrame:
        return self.table.where(F.col("id") > F.lit(UNK_ID)).select("token", "vec")

    @property
    def unk(self):
        return special_vector(UNK_ID, self.dim, self.seed)

    def hot_vecs(self, budget: int | None = None) -> DataFrame:
        """Vectors of the most frequent words, as many as ``budget`` bytes hold:
        the broadcast half of a split look-up when the whole table is too big."""
        budget = broadcast_budget(self.prep.spark) if budget is None else budget
        k = max(1, budget // (8 * self.dim + 64))
        hot = hot_keys(self.prep.words.where(F.col("in_vocab")), "token", "n_occ", k)
        return self.token_vecs.join(hot, "token", "left_semi")


    def hot_lookup(self, budget: int | None = None) -> DataFrame:
        """``(id, vec)`` of the specials and the most frequent words, as many as
        ``budget`` bytes hold (the CNN's split gather)."""
        budget = broadcast_budget(self.prep.spark) if budget is None else budget
        k = max(1, budget // (8 * self.dim + 64))
        return self.lookup.join(self.prep.hot_index(k).select("id"), "id", "left_semi")


def build_vectors(spark: SparkSession, sf_dir: str, prep: Prepared | None = None,
                  seed: int = 7) -> Vectors:
    return Vectors(prep or prepare(spark, sf_dir), seed=seed)


def pooled_features(v: Vectors, max_tokens: int | None = None,
                    broadcast: bool | None = None) -> DataFrame:
    """``id, y, split, features``: mean of the vectors of all tokens of a text
    (of the first ``max_tokens`` where that is given), unknown words through the
    <UNK> vector."""
    return mean_pool(v.prep.tokens, v.token_vecs, v.dim, max_items=max_tokens,
                     unk=v.unk, broadcast=broadcast, keep=("y", "split"), hot=v.hot_vecs)
