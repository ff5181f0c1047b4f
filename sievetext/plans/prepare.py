"""The data-preparation chain of the reference as Spark stages:

labelled text -> normalise + tokenise -> vocabulary (train + dev) -> word index
-> fixed-length id sequences.

Stages that several consumers read (the token table, the vocabulary with its
split flag, the word index) are written once to the shared scratch folder on
first use, like the reference keeps them in memory; everything else stays a
lazy plan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Tokenizer, tokenize
from ..operators.encode import encode_fixed
from ..operators.frequent import LocalIndex
from ..operators.joins import hot_keys
from ..operators.vocab import UNK_ID, explode_tokens, vocabulary, word_index
from ..session import materialize, setting
from ..sources.tables import labeled_corpus_and_classes

MAX_LENGTH = 256  # sequence length of the reference runner
HOT_WORDS = 1_000_000  # bounded broadcast half of the split token look-up
HOT_WORD_BYTES = 256  # longer words are never broadcast, they take the shuffle join
VOCAB_SPLITS = ("train", "dev")


def with_tokens(df: DataFrame, text_col: str = "text", tokenizer: Tokenizer = "blank",
                out_col: str = "tokens") -> DataFrame:
    return df.withColumn(out_col, tokenize(text_col, tokenizer))


def vocab_of(toks: DataFrame, splits=VOCAB_SPLITS) -> DataFrame:
    """Vocabulary of the given splits (train + dev; test-only words stay unknown, Q14)."""
    return vocabulary(toks.where(F.col("split").isin(*splits)))


def vocab_with_flag(toks: DataFrame, splits=VOCAB_SPLITS) -> DataFrame:
    """``(token, in_vocab, n_occ)`` over all splits in one aggregation: every
    word of the corpus, flagged when it occurs in one of ``splits``, with its
    number of occurrences (partial aggregation before the shuffle)."""
    flag = F.col("split").isin(*splits)
    ex = explode_tokens(toks.withColumn("_f", flag), "tokens", "_f")
    return ex.groupBy("token").agg(F.max("_f").alias("in_vocab"),
                                   F.count(F.lit(1)).alias("n_occ"))


class Prepared:
    """Lazy handle on the prepared corpus; stages are built on first access."""

    def __init__(self, spark: SparkSession, sf_dir: str, label: str = "lang",
                 tokenizer: Tokenizer = "blank", materialized: bool = True):
        self.spark, self.sf_dir, self.label = spark, sf_dir, label
        self.tokenizer = tokenizer
        self.materialized = materialized
        self.corpus, self.labels = labeled_corpus_and_classes(spark, sf_dir, label=label)
        self.num_classes = len(self.labels)

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name) if self.materialized else df

    @cached_property
    def tokens(self) -> DataFrame:
        """``id, y, split, tokens``."""
        toks = with_tokens(self.corpus, tokenizer=self.tokenizer).select("id", "y", "split", "tokens")
        return self._keep(toks, "tokens")

    @cached_property
    def words(self) -> DataFrame:
        """``token, in_vocab`` for every word of the corpus."""
        return self._keep(vocab_with_flag(self.tokens), "words")

    @property
    def vocab(self) -> DataFrame:
        return self.words.where(F.col("in_vocab")).select("token")

    @property
    def vocab_all(self) -> DataFrame:
        return self.words.select("token")

    @cached_property
    def index(self) -> DataFrame:
        """``token, id``: specials 0-3, words from 4 in token order."""
        return self._keep(word_index(self.vocab), "word-index")

    def lookup_hot(self, k: int | None = None) -> LocalIndex | None:
        """``None`` when the whole index has at most ``k`` rows (it is
        broadcast by its measured size), else :meth:`hot_index`, sent to the
        workers once.  ``k`` defaults to ``spark.sievetext.hotWords`` (1 000 000).
        Counting the written index reads parquet metadata only."""
        k = setting(self.spark, "hotWords", HOT_WORDS) if k is None else k
        return None if self.index.count() <= k else LocalIndex(self.hot_index(k))

    def hot_index(self, k: int = HOT_WORDS) -> DataFrame:
        """The index rows of the ``k`` most frequent vocabulary words and of the
        specials (``<PAD>`` is the most frequent id of padded sequences): the
        broadcast half of a split look-up (at most ``k + 4`` rows of words of
        at most ``HOT_WORD_BYTES`` bytes)."""
        short = F.col("in_vocab") & (F.octet_length("token") <= HOT_WORD_BYTES)
        hot = hot_keys(self.words.where(short), "token", "n_occ", k)
        return (self.index.join(hot, "token", "left_semi")
                .unionByName(self.index.where(F.col("id") <= F.lit(UNK_ID))))


def frequent_ids(index: DataFrame) -> DataFrame | None:
    """The broadcast half of a split look-up in a written frequency index, whose
    first ids are the most frequent words; ``None`` where the whole index has no
    more rows than that (``spark.sievetext.hotWords``)."""
    k = setting(index.sparkSession, "hotWords", HOT_WORDS)
    return None if index.count() <= k else index.where(F.col("id") <= k)


def capped_ids(index: DataFrame, num_words: int) -> DataFrame | LocalIndex | None:
    """The same for a capped encoding of a frequency index, whose words from
    ``num_words`` on count as unknown: those below it, all that are looked up, sent
    to the workers; :func:`frequent_ids` where they are too many for that."""
    if num_words > setting(index.sparkSession, "hotWords", HOT_WORDS):
        return frequent_ids(index)
    return LocalIndex(index.where(F.col("id") < num_words), whole=True)


def prepare(spark: SparkSession, sf_dir: str, label: str = "lang",
            tokenizer: Tokenizer = "blank", materialized: bool = True) -> Prepared:
    return Prepared(spark, sf_dir, label=label, tokenizer=tokenizer, materialized=materialized)


def encoded(prep: Prepared, max_length: int = MAX_LENGTH) -> DataFrame:
    """``id, y, split, ids`` for all splits."""
    return encode_fixed(prep.tokens, prep.index, max_length, keep=("y", "split"),
                        hot=prep.lookup_hot())
