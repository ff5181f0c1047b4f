"""Training passes and the epoch loop.

The driver holds the weights (c x (d+1) numbers) and the Adam state, nothing
else.  One epoch is one Spark job: the current weights travel with the task
closure, every partition returns partial sums, the JVM adds them, the driver
steps.  Features are written once to the shared scratch folder (the cluster's
checkpoint directory), so an epoch never re-runs the text preparation and a
lost executor re-reads that table instead of the lineage.

Each step is a full-batch step instead of the reference's 512-row
mini-batches (one job per mini-batch would not scale); the learning rate is
larger accordingly (Adam moves each weight by about ``lr`` per step).
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from typing import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.metrics import accuracy
from ..operators.model import SoftmaxHead, gradient, gradients_by_role, score
from ..operators.noise import complement_label

# ---- fixed values of the reference runner ---------------------------------
REFERENCE_LR = 0.001
GRAD_CLIP_PL = 10.0      # clip_grad_norm_ in positive training only (Q13)
EVAL_EVERY = 5           # accuracy each 5th epoch
# ----------------------------------------------------------------------------
DEFAULT_LR = 0.3         # full-batch steps (SURVEY 7.3)


@dataclass
class Adam:
    lr: float = DEFAULT_LR
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    t: int = 0
    m: np.ndarray | None = None
    v: np.ndarray | None = None

    def step(self, params: np.ndarray, grad: np.ndarray) -> np.ndarray:
        if self.m is None:
            self.m = np.zeros_like(params)
            self.v = np.zeros_like(params)
        self.t += 1
        self.m = self.beta1 * self.m + (1 - self.beta1) * grad
        self.v = self.beta2 * self.v + (1 - self.beta2) * grad * grad
        mhat = self.m / (1 - self.beta1 ** self.t)
        vhat = self.v / (1 - self.beta2 ** self.t)
        return params - self.lr * mhat / (np.sqrt(vhat) + self.eps)


def clip_by_norm(grad: np.ndarray, max_norm: float | None) -> tuple[np.ndarray, float]:
    """Global-norm clipping (M8); returns the clipped gradient and the norm."""
    norm = float(np.linalg.norm(grad))
    if max_norm is not None and norm > max_norm:
        grad = grad * (max_norm / (norm + 1e-6))
    return grad, norm


def with_epoch_complement(df: DataFrame, num_classes: int, epoch: int, seed: int = 7,
                          id_col: str = "id", y_col: str = "y") -> DataFrame:
    return df.withColumn("comp", complement_label(y_col, num_classes, epoch, seed, id_col))


@dataclass
class Trainer:
    """Driver loop over full-batch passes.

    ``kind``: ``"nl"`` (complementary labels, redrawn per epoch) or ``"pl"``.
    ``select``: ``None`` (all rows), ``"selnl"`` (``p[y] > 1/c``) or ``"selpl"``
    (``p[y] > gamma``); the selection is made with the current weights in the
    same pass, every epoch, as the reference's ``threshold_data`` is.
    """
    num_classes: int
    dim: int
    optimizer: Adam = field(default_factory=Adam)
    seed: int = 7
    form: str = "complement"
    eval_every: int = EVAL_EVERY
    reproducible: bool = False  # sums without rounding: the same bits for any partitioning
    on_epoch_end: Callable[[dict], None] | None = None
    history: list = field(default_factory=list)
    model: SoftmaxHead | None = None

    def __post_init__(self):
        if self.model is None:
            self.model = SoftmaxHead.zeros(self.num_classes, self.dim)

    def _threshold(self, select: str | None, gamma: float) -> float | None:
        if select is None:
            return None
        if select == "selnl":
            return 1.0 / self.num_classes
        if select == "selpl":
            return float(gamma)
        raise ValueError("select must be None, 'selnl' or 'selpl'")

    def _frame(self, train: DataFrame | None, dev: DataFrame | None, test: DataFrame | None, kind: str,
               step: int) -> DataFrame:
        """Rows of one pass: training rows (role 0) and, when given, the dev and
        test rows (roles 1 and 2) that evaluate the previous step's weights.
        Complementary labels are keyed by the step each role stands for."""
        cols = ["id", "y", "features"]
        frame = None
        for role, rows in enumerate((train, dev, test)):
            if rows is not None:
                part = rows.select(*cols).withColumn("_role", F.lit(role))
                frame = part if frame is None else frame.unionByName(part)
        if kind == "nl":
            c = self.num_classes
            comp = F.when(F.col("_role") == 0, complement_label("y", c, step, self.seed)).otherwise(
                complement_label("y", c, step - 1, self.seed))
            frame = frame.withColumn("comp", comp)
        return frame

    def fit(self, train: DataFrame, epochs: int, kind: str = "nl", select: str | None = None,
            gamma: float = 0.5, dev: DataFrame | None = None, test: DataFrame | None = None,
            stage: str | None = None, clip: float | None = "auto",
            state_path: str | None = None, save_every: int = 5) -> SoftmaxHead:
        """Run up to ``epochs`` steps; one Spark job per step.

        What the log says of step e (dev loss, test accuracy, training accuracy,
        all with the weights after step e, as the reference evaluates) is counted
        in the same scan as step e+1's gradient, which uses exactly those
        weights; only the last step needs one more scan.
        """
        if kind not in ("nl", "pl"):
            raise ValueError("kind must be 'nl' or 'pl'")
        max_norm = (GRAD_CLIP_PL if kind == "pl" else None) if clip == "auto" else clip
        threshold = self._threshold(select, gamma)
        stage = stage or (kind if select is None else select)
        c, d = self.num_classes, self.dim
        pending = None  # last row, waiting for its evaluation

        def run(with_train, row, step):
            """One job: the sums by role, with the rows that evaluate ``row``."""
            frame = self._frame(train if with_train else None, dev if row else None,
                                test if row and "test_accuracy" in row else None, kind, step)
            res = gradients_by_role(frame, self.model, kind=kind, form=self.form, threshold=threshold,
                                    comp_col="comp" if kind == "nl" else None, exact=self.reproducible)
            if row:
                if dev is not None:
                    row["dev_loss"] = res.get(1, {"loss": float("nan")})["loss"]
                for name, role in (("train_accuracy", 0), ("test_accuracy", 2)):
                    if name in row:
                        seen = res.get(role, {"seen": 0})["seen"]
                        row[name] = 100.0 * res[role]["correct"] / seen if seen else float("nan")
                if self.on_epoch_end:
                    self.on_epoch_end(row)
            return res

        for epoch in range(1, epochs + 1):
            t0 = time.time()
            step = len(self.history) + 1
            g = run(True, pending, step).get(0, {"n": 0})
            pending = None
            if g["n"] == 0:  # empty selection: the reference stops the stage
                self.history.append({"step": step, "stage": stage, "epoch": epoch, "n_rows": 0,
                                     "seconds": time.time() - t0, "stopped": True})
                break
            grad, norm = clip_by_norm(g["grad"], max_norm)
            self.model = SoftmaxHead.from_flat(self.optimizer.step(self.model.flat(), grad), c, d)
            row = {"step": step, "stage": stage, "epoch": epoch, "n_rows": g["n"],
                   "train_loss": g["loss"], "train_pos_loss": g["aux_loss"] if kind == "nl" else g["loss"],
                   # the reference prints the sum of batch means over the rows (Q11);
                   # a full-batch step has one batch
                   "reported_loss": g["loss"] / g["n"], "grad_norm": norm, "stopped": False}
            if test is not None and (epoch % self.eval_every == 0 or epoch == epochs):
                row["test_accuracy"] = None
            if epoch % self.eval_every == 0:
                row["train_accuracy"] = None
            row["seconds"] = time.time() - t0
            self.history.append(row)
            if dev is not None or "test_accuracy" in row or "train_accuracy" in row:
                pending = row
            elif self.on_epoch_end:
                self.on_epoch_end(row)
            if state_path and epoch % save_every == 0:
                # the last saved row may still wait for its evaluation; a resumed
                # run continues from the same weights and optimizer state
                self.save_state(train.sparkSession, state_path)
        if pending is not None:
            run("train_accuracy" in pending, pending, pending["step"] + 1)
        if state_path:
            self.save_state(train.sparkSession, state_path)
        return self.model

    def history_frame(self, spark: SparkSession) -> DataFrame:
        return history_frame(spark, self.history)

    # ---- resuming (the reference's ``jump_to_epoch``) ----------------------
    def save_state(self, spark: SparkSession, path: str) -> str:
        """Write weights, optimizer state and history as one parquet row to
        ``path/step-NNNNNN`` (a new folder per save; earlier saves stay valid)."""
        opt = self.optimizer
        zeros = np.zeros_like(self.model.flat())
        row = (len(self.history), self.model.flat().tolist(),
               (opt.m if opt.m is not None else zeros).tolist(),
               (opt.v if opt.v is not None else zeros).tolist(), int(opt.t),
               json.dumps(self.history))
        out = f"{path.rstrip('/')}/step-{len(self.history):06d}"
        spark.createDataFrame([row], STATE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(out)
        return out

    def load_state(self, spark: SparkSession, path: str) -> bool:
        """Resume from the latest save under ``path``; ``False`` if there is none."""
        try:
            rows = spark.read.schema(STATE_SCHEMA).parquet(f"{path.rstrip('/')}/step-*") \
                .orderBy(F.col("step").desc()).limit(1).collect()
        except Exception:  # noqa: BLE001 - no save yet
            return False
        if not rows:
            return False
        r = rows[0]
        self.model = SoftmaxHead.from_flat(np.asarray(r["params"]), self.num_classes, self.dim)
        self.optimizer.m, self.optimizer.v = np.asarray(r["adam_m"]), np.asarray(r["adam_v"])
        self.optimizer.t = int(r["adam_t"])
        self.history = json.loads(r["history"])
        return True


STATE_SCHEMA = T.StructType([
    T.StructField("step", T.LongType()), T.StructField("params", T.ArrayType(T.DoubleType())),
    T.StructField("adam_m", T.ArrayType(T.DoubleType())), T.StructField("adam_v", T.ArrayType(T.DoubleType())),
    T.StructField("adam_t", T.LongType()), T.StructField("history", T.StringType()),
])

HISTORY_SCHEMA = T.StructType([
    T.StructField("step", T.LongType()), T.StructField("stage", T.StringType()),
    T.StructField("epoch", T.LongType()), T.StructField("n_rows", T.LongType()),
    T.StructField("train_loss", T.DoubleType()), T.StructField("train_pos_loss", T.DoubleType()),
    T.StructField("reported_loss", T.DoubleType()), T.StructField("dev_loss", T.DoubleType()),
    T.StructField("train_accuracy", T.DoubleType()), T.StructField("test_accuracy", T.DoubleType()),
    T.StructField("grad_norm", T.DoubleType()), T.StructField("seconds", T.DoubleType()),
    T.StructField("stopped", T.BooleanType()),
])


def history_frame(spark: SparkSession, history: list) -> DataFrame:
    """The epoch log (S11) as a DataFrame: one row per step."""
    rows = [tuple(h.get(f.name) for f in HISTORY_SCHEMA.fields) for h in history]
    return spark.createDataFrame(rows, HISTORY_SCHEMA)


# ---------------------------------------------------------------- weights

WEIGHTS_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("shape", T.ArrayType(T.IntegerType()), False),
    T.StructField("values", T.ArrayType(T.DoubleType()), False),
])


def weights_frame(spark: SparkSession, model: SoftmaxHead) -> DataFrame:
    return spark.createDataFrame(
        [("weight", list(model.W.shape), model.W.ravel().tolist()),
         ("bias", list(model.b.shape), model.b.tolist())], WEIGHTS_SCHEMA)


def save_weights(spark: SparkSession, model: SoftmaxHead, path: str) -> str:
    weights_frame(spark, model).coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load_weights(spark: SparkSession, path: str) -> SoftmaxHead:
    rows = {r["name"]: r for r in spark.read.schema(WEIGHTS_SCHEMA).parquet(path).collect()}
    W = np.asarray(rows["weight"]["values"]).reshape(rows["weight"]["shape"])
    return SoftmaxHead(W, np.asarray(rows["bias"]["values"]))


def fit_cnn(runner, model, epochs: int, kind: str = "nl", lr: float = 0.01,
            select: str | None = None, gamma: float = 0.5, seed: int = 7,
            stage: str | None = None, history: list | None = None, optimizer: Adam | None = None):
    """The same epoch loop for the CNN (G5 through G1/G2): one Spark job per
    step, dropout masks keyed by (row, feature, step)."""
    history = history if history is not None else []
    opt = optimizer or Adam(lr=lr)
    c = model.num_classes
    threshold = None if select is None else (1.0 / c if select == "selnl" else gamma)
    max_norm = GRAD_CLIP_PL if kind == "pl" else None
    for epoch in range(1, epochs + 1):
        t0 = time.time()
        step = len(history) + 1
        data, comp = runner.data, None
        if kind == "nl":
            data, comp = with_epoch_complement(runner.data, c, step, seed), "comp"
        row = runner.gradient_frame(model, kind=kind, epoch=step, comp_col=comp,
                                    threshold=threshold, data=data).first()
        n = int(row["n"] or 0)
        if n == 0:
            history.append({"step": step, "stage": stage or kind, "epoch": epoch, "n_rows": 0,
                            "seconds": time.time() - t0, "stopped": True})
            break
        grad, norm = clip_by_norm(np.asarray(row["grad"]) / n, max_norm)
        model = model.with_flat(opt.step(model.flat(), grad))
        history.append({"step": step, "stage": stage or kind, "epoch": epoch, "n_rows": n,
                        "train_loss": row["loss"] / n,
                        "train_pos_loss": (row["aux_loss"] if kind == "nl" else row["loss"]) / n,
                        "grad_norm": norm, "seconds": time.time() - t0, "stopped": False})
    return model, history


# ---------------------------------------------------------------- single passes by name
# The reference's per-pass functions, as one Spark job each over a table of
# ``id, y, features`` rows.

def evaluate_pl(df: DataFrame, model: SoftmaxHead) -> float:
    """Mean NLL of the labels (G6), no update."""
    return gradient(df, model, kind="pl")["loss"]


def evaluate_nl(df: DataFrame, model: SoftmaxHead, num_classes: int, epoch: int,
                seed: int = 7, form: str = "complement") -> float:
    """Mean complementary-label loss (G6) with labels drawn for ``epoch``."""
    d = with_epoch_complement(df, num_classes, epoch, seed)
    return gradient(d, model, kind="nl", form=form, comp_col="comp")["loss"]


def test_accuracy(df: DataFrame, model: SoftmaxHead) -> float:
    """Percent of rows whose arg-max class is the label (A5)."""
    return float(accuracy(score(df, model)).first()["accuracy"])


test_accuracy.__test__ = False  # not a pytest test despite the name


def train_pl(df: DataFrame, trainer: "Trainer", **kw) -> float:
    """One positive step over all rows (G2); returns the step's mean loss."""
    trainer.fit(df, 1, "pl", **kw)
    return trainer.history[-1].get("train_loss", float("nan"))


def train_nl(df: DataFrame, trainer: "Trainer", **kw) -> tuple[float, float]:
    """One negative step (G1); returns (negative loss, positive loss)."""
    trainer.fit(df, 1, "nl", **kw)
    h = trainer.history[-1]
    return h.get("train_loss", float("nan")), h.get("train_pos_loss", float("nan"))


def threshold_data(df: DataFrame, model: SoftmaxHead, threshold: float):
    """Rows whose ``p[y]`` is over ``threshold``, or ``None`` when none is."""
    from ..operators.selection import selection_or_none

    return selection_or_none(score(df, model, drop_features=False), threshold)
