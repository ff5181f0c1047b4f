"""Data-set loaders by name (F3: the reference picks its reader through a
variable).  Each loader returns the normal form ``id, text, label, y, split``
and its class list."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import conversations_corpus_and_classes, labeled_corpus_and_classes

Loader = Callable[[SparkSession, str], tuple[DataFrame, list]]

READERS: dict[str, Loader] = {
    "documents_lang": lambda spark, loc: labeled_corpus_and_classes(spark, loc, "lang"),
    "documents_quality": lambda spark, loc: labeled_corpus_and_classes(spark, loc, "quality"),
    "documents_toxic": lambda spark, loc: labeled_corpus_and_classes(spark, loc, "toxic"),
    "conversations_role": lambda spark, loc: conversations_corpus_and_classes(spark, loc),
}


def register_reader(name: str, loader: Loader) -> None:
    READERS[name] = loader


def load_dataset(spark: SparkSession, name: str, location: str) -> tuple[DataFrame, list]:
    try:
        loader = READERS[name]
    except KeyError:
        raise ValueError(f"unknown data set {name!r}; known: {sorted(READERS)}") from None
    return loader(spark, location)
