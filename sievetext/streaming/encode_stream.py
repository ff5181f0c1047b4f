"""Encoding a stream of texts (T1-T3, J1 on an unbounded source).

The reference has no streaming.  The preparation steps are row-local or
stream-static joins, so a stream of new texts is encoded with the word index
built on the batch corpus.  The per-row regroup after the index join is a
batch aggregation; it runs per micro-batch through ``foreachBatch``, which
keeps no state between batches and gives the sink exactly the batch result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokenize
from ..operators.encode import encode_fixed


def encode_batch(batch: DataFrame, index: DataFrame, max_length: int, id_col: str = "id",
                 text_col: str = "text", hot: DataFrame | None = None) -> DataFrame:
    toks = batch.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), tokenize(text_col).alias("tokens"))
    return encode_fixed(toks, index, max_length, hot=hot)


def read_encoded(spark, out_path: str) -> DataFrame:
    """What the stream has written so far (``id, ids``, all micro-batches)."""
    return spark.read.parquet(out_path).drop("epoch")


def start_encoding(stream: DataFrame, index: DataFrame, max_length: int, out_path: str,
                   checkpoint: str, id_col: str = "id", text_col: str = "text",
                   available_now: bool = False, hot: DataFrame | None = None) -> StreamingQuery:
    """Encode every micro-batch of ``stream`` as parquet under ``out_path``.

    Each micro-batch has a folder of its own, ``epoch=<n>``, which is
    overwritten: a batch that runs again after a failure leaves its rows once.
    """
    def write(batch: DataFrame, epoch: int):
        encode_batch(batch, index, max_length, id_col, text_col, hot).write.mode("overwrite").parquet(
            f"{out_path.rstrip('/')}/epoch={epoch}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
