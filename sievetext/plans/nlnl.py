"""Three-stage learning from noisy labels (G9): NL -> SelNL -> SelPL.

1. NL: train on a random complementary label per row and epoch.
2. SelNL: same, only on rows whose current ``p[y] > 1/c``.
3. SelPL: ordinary training on rows whose current ``p[y] > gamma``.

The model and optimizer carry over between stages, as in the reference.
Data: ``documents`` text, label ``lang``, mean of frozen word vectors as
features, controlled noise on every row outside the test bucket.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vecmath import argmax, pick
from ..operators.model import score
from ..operators.noise import inject_noise
from ..session import drop_unread, materialize, written_mark
from .features import build_vectors, pooled_features
from .prepare import prepare
from .train import Adam, Trainer


@dataclass
class NLNLConfig:
    noise_kind: str = "exc"
    noise_ratio: float = 0.3
    nl_epochs: int = 20
    selnl_epochs: int = 20
    selpl_epochs: int = 20
    lr: float = 0.3
    gamma: float = 0.5
    seed: int = 7
    label: str = "lang"


@dataclass
class NoisySet:
    train: DataFrame   # id, y (noisy), label_clean, is_flipped, features
    dev: DataFrame
    test: DataFrame    # id, y (clean), features
    num_classes: int
    dim: int


@dataclass
class NLNLResult:
    trainer: Trainer
    data: NoisySet
    history: list = field(default_factory=list)

    @property
    def model(self):
        return self.trainer.model


def noisy_feature_set(spark: SparkSession, sf_dir: str, cfg: NLNLConfig) -> NoisySet:
    mark = written_mark()
    prep = prepare(spark, sf_dir, label=cfg.label)
    vecs = build_vectors(spark, sf_dir, prep, seed=cfg.seed)
    # What a step has read goes before the next one writes: the tables of the
    # preparation are as large as the corpus.
    pooled = pooled_features(vecs)
    drop_unread(spark, mark, pooled)
    feats = materialize(pooled, "features")
    drop_unread(spark, mark, feats)
    nontest = feats.where(F.col("split") != "test")
    noisy = inject_noise(nontest, prep.num_classes, cfg.noise_ratio, kind=cfg.noise_kind,
                         seed=cfg.seed, label_col="y")
    data = materialize(noisy.select("id", "y", "label_clean", "is_flipped", "split", "features"),
                       "noisy-features")
    test = materialize(feats.where(F.col("split") == "test").select("id", "y", "features"),
                       "test-features")
    drop_unread(spark, mark, data, test)
    return NoisySet(data.where(F.col("split") == "train").drop("split"),
                    data.where(F.col("split") == "dev").drop("split"),
                    test, prep.num_classes, vecs.dim)


def run_nlnl(spark: SparkSession, sf_dir: str, cfg: NLNLConfig | None = None,
             stages=("nl", "selnl", "selpl")) -> NLNLResult:
    cfg = cfg or NLNLConfig()
    data = noisy_feature_set(spark, sf_dir, cfg)
    trainer = Trainer(data.num_classes, data.dim, Adam(lr=cfg.lr), seed=cfg.seed)
    common = dict(dev=data.dev, test=data.test)
    if "nl" in stages:
        trainer.fit(data.train, cfg.nl_epochs, "nl", stage="nl", **common)
    if "selnl" in stages:
        trainer.fit(data.train, cfg.selnl_epochs, "nl", select="selnl", stage="selnl", **common)
    if "selpl" in stages:
        trainer.fit(data.train, cfg.selpl_epochs, "pl", select="selpl", gamma=cfg.gamma,
                    stage="selpl", **common)
    if "pl" in stages:
        trainer.fit(data.train, cfg.selpl_epochs, "pl", stage="pl", **common)
    return NLNLResult(trainer, data, trainer.history)


def scored_rows(res: NLNLResult, gamma: float = 0.5) -> DataFrame:
    """Training rows with the final model's view: ``p_y``, ``pred`` and ``kept``
    (``p_y > gamma``), beside the clean label, for judging the cleaning."""
    s = score(res.data.train, res.model)
    return s.select("id", "y", "label_clean", "is_flipped",
                    pick("probs", "y").alias("p_y"), argmax("probs").alias("pred")).withColumn(
        "kept", F.col("p_y") > F.lit(float(gamma)))
