"""The reference's data-side entry points by name, over the Spark operators.

Each returns DataFrames (never Python dicts or tensors): a word index is a
``(token, id)`` table, a data loader is the encoded table with batch ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import Tokenizer, tokenize
from .operators.encode import encode_capped, encode_fixed, word_ids
from .operators.noise import complement_label, generate_noise  # noqa: F401 - re-exported
from .operators.order import batches, tail_split
from .operators.vectors import lookup_table, read_word_vectors
from .operators.vocab import (KERAS_OOV_ID, KERAS_SPECIALS, KERAS_SPECIALS_EOS, START_ID,
                              frequency_index, specials_frame, token_counts, vocabulary, word_index)
from .plans.prepare import capped_ids
from .session import materialize


def create_vocab(corpus: DataFrame, tokenizer: Tokenizer = "blank", text_col: str = "text",
                 splits=("train", "dev")) -> DataFrame:
    """Distinct tokens of the train and dev rows of a corpus with a ``split`` column."""
    rows = corpus.where(F.col("split").isin(*splits))
    return vocabulary(rows.select(tokenize(text_col, tokenizer).alias("tokens")))


def load_word_idx_maps(vocab: DataFrame) -> DataFrame:
    """Word index with the specials; both directions are this one table."""
    return word_index(vocab)


def load_vectors(spark: SparkSession, location: str, vocab: DataFrame) -> DataFrame:
    """Word vectors of the vocabulary words from a text file (last line wins)."""
    return read_word_vectors(spark, location, vocab=vocab)[0]


def load_lookup_table(vectors: DataFrame, index: DataFrame, dim: int) -> DataFrame:
    """``(id, token, vec)`` for every id of the index."""
    return lookup_table(index, vectors, dim)


def choose_complement_targets(df: DataFrame, num_classes: int, epoch: int, label_col: str = "y",
                              id_col: str = "id", seed: int = 7) -> DataFrame:
    """Adds ``comp``: a class other than the label, drawn for ``epoch``."""
    return df.withColumn("comp", complement_label(label_col, num_classes, epoch, seed, id_col))


def create_dataloader(corpus: DataFrame, index: DataFrame, max_length: int = 256,
                      batch_size: int = 32, shuffle: bool = False, tokenizer: Tokenizer = "blank",
                      text_col: str = "text", label_col: str = "y",
                      hot: DataFrame | None = None) -> DataFrame:
    """``id, y, ids, pos, batch_id``: texts encoded to ``max_length`` ids, in
    consecutive batches (keyed shuffle when asked).  ``hot``: a bounded subset
    of ``index`` (the most frequent words) for the split look-up."""
    toks = corpus.select("id", F.col(label_col).alias("y"), tokenize(text_col, tokenizer).alias("tokens"))
    enc = encode_fixed(toks, index, max_length, keep=("y",), hot=hot)
    return batches(enc, batch_size, shuffle=shuffle)


def load_data_set(sequences: DataFrame, max_len: int, vocab_size: int, batch_size: int,
                  n_valid: int = 1000, tokens_col: str = "tokens"
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keras-style preparation of token sequences: frequency ids offset by 3,
    capped at ``vocab_size``, left-padded to ``max_len``; all but the last
    ``n_valid`` rows (in id order) batched with ``drop_last``.  Returns the
    training batches, the validation rows and the word index (with the
    specials)."""
    words = frequency_index(token_counts(sequences, tokens_col=tokens_col), specials=())
    enc = encode_capped(sequences, words, vocab_size, max_len, tokens_col=tokens_col, keep=("y",))
    split = tail_split(enc, n_valid, order_by=["id"]).drop("pos")
    train = batches(split.where(~F.col("is_valid")).drop("is_valid"), batch_size, drop_last=True)
    index = specials_frame(sequences.sparkSession, KERAS_SPECIALS).unionByName(words)
    return train, split.where(F.col("is_valid")).drop("is_valid"), index


def load_data_set_multiclass(train: DataFrame, test: DataFrame, max_len: int, vocab_size: int,
                             batch_size: int, tokens_col: str = "tokens"
                             ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The multi-class form of :func:`load_data_set` over tables ``id, y, tokens``:
    all training rows are batched (no validation tail, ``drop_last``) and the
    index knows ``<EOS>`` = 3.  Returns the training batches, the training and
    the test set as unpadded id sequences, the padded test rows and the index."""
    words = materialize(frequency_index(
        token_counts(train, test, tokens_col=tokens_col), specials=()), "frequency-index")
    hot = capped_ids(words, vocab_size)

    def padded(rows):
        return encode_capped(rows, words, vocab_size, max_len, tokens_col=tokens_col, keep=("y",), hot=hot)

    def unpadded(rows):
        ids = word_ids(rows, words, tokens_col=tokens_col, unk_id=KERAS_OOV_ID, hot=hot)
        capped = F.transform("ids", lambda i: F.when(i >= vocab_size, F.lit(KERAS_OOV_ID).cast("long")).otherwise(i))
        start = F.array(F.lit(START_ID).cast("long"))
        return rows.select("id", "y").join(ids.select("id", F.concat(start, capped).alias("ids")), "id")

    index = specials_frame(train.sparkSession, KERAS_SPECIALS_EOS).unionByName(words)
    return (batches(padded(train), batch_size, drop_last=True), unpadded(train), unpadded(test),
            padded(test), index)
