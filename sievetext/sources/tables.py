"""Readers for the parquet tables and the labelled corpora built from them (S3).

Normal form of a labelled corpus: ``id bigint, text string, label, y int,
split string`` with splits keyed by a draw, so a row's split never depends
on partitioning: ``draw(seed,'split',id) % 10`` 0-7 train, 8 dev, 9 test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import draw_mod
from ..operators.labels import collect_labels, encode_labels
from ..session import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# ---- fixed values --------------------------------------------------------
SPLIT_BUCKETS = 10        # draw % 10
TRAIN_BUCKETS = 8         # 0..7 train
DEV_BUCKET = 8            # 8 dev, 9 test
DEFAULT_SEED = 7
# --------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def split_expr(id_col: str = "id", seed: int = DEFAULT_SEED):
    b = draw_mod(seed, "split", SPLIT_BUCKETS, id_col)
    return (F.when(b < TRAIN_BUCKETS, F.lit("train"))
            .when(b == DEV_BUCKET, F.lit("dev")).otherwise(F.lit("test")))


def labeled_corpus(spark: SparkSession, sf_dir: str, label: str = "lang",
                   seed: int = DEFAULT_SEED, labels: list | None = None) -> DataFrame:
    return labeled_corpus_and_classes(spark, sf_dir, label, seed, labels)[0]


def labeled_corpus_and_classes(spark: SparkSession, sf_dir: str, label: str = "lang",
                               seed: int = DEFAULT_SEED,
                               labels: list | None = None) -> tuple[DataFrame, list]:
    """``documents`` as a labelled corpus: ``id, text, label, y, split``.

    ``label`` is ``lang`` (4 classes) or ``quality`` / ``toxic`` (binary,
    through an inner join with ``labels`` on ``doc_id``).  Rows with null text
    (the reference asserts text is a string) or null label are rejected;
    :func:`corpus_audit` counts them.  Labels missing from a given ``labels``
    list raise.
    """
    docs = table(spark, sf_dir, "documents")
    if label == "lang":
        base = docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))
    elif label in ("quality", "toxic"):
        lab = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))
        base = docs.select("doc_id", "text").join(lab, "doc_id").select(
            F.col("doc_id").alias("id"), "text", "label")
    else:
        raise ValueError(f"unknown label {label!r}")
    base = base.where(F.col("text").isNotNull() & F.col("label").isNotNull())
    classes = labels if labels is not None else collect_labels(base, "label")
    base = spread(base, "id")
    # a class list taken from these very rows lacks none of them; a given one may
    coded = encode_labels(base, classes, "label", "y", strict=labels is not None)
    return coded.withColumn("split", split_expr("id", seed)), classes


def corpus_audit(spark: SparkSession, sf_dir: str, label: str = "lang") -> DataFrame:
    """One row of counts over the rows that :func:`labeled_corpus` reads: all,
    without text, without label, and kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    if label != "lang":
        lab = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("lang"))
        docs = docs.drop("lang").join(lab, "doc_id")
    no_text, no_label = F.col("text").isNull(), F.col("lang").isNull()
    return docs.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.count_if(no_text).alias("n_without_text"),
                    F.count_if(no_label & ~no_text).alias("n_without_label"),
                    F.count_if(~no_text & ~no_label).alias("n_kept"))


def conversations_corpus_and_classes(spark: SparkSession, sf_dir: str,
                                     seed: int = DEFAULT_SEED) -> tuple[DataFrame, list]:
    """``conversations`` turns labelled by ``role``; id = conv_id * 2**32 + turn
    (no two turns below 2**32 meet)."""
    conv = table(spark, sf_dir, "conversations")
    base = conv.select((F.col("conv_id") * F.lit(1 << 32) + F.col("turn")).alias("id"),
                       "text", F.col("role").alias("label")).where(
        F.col("text").isNotNull() & F.col("role").isNotNull())
    classes = collect_labels(base, "label")
    coded = encode_labels(spread(base, "id"), classes, "label", "y", strict=False)
    return coded.withColumn("split", split_expr("id", seed)), classes


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` spread over the cluster's parallelism (by ``doc_id``) when
    the scan alone would leave tasks idle."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")
