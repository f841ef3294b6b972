"""Kernel support-vector machines for a whole grid in shared passes (M1 + M3).

All grid points, folds and class pairs are columns of a few weight matrices;
one pass over a written table of normalised rows gives the loss and the
gradient of every column (matrix products per block, summed per task, then per
feature map).  Each column runs its own quasi-Newton steps on the driver, which
holds weights and nothing per row; a pass is shared by all columns, so the
whole grid takes a few dozen jobs.

Kernels: ``linear``; ``rbf`` and ``sigmoid`` through landmarks (the train rows
of smallest seeded keys, a documented bound): a row is mapped to its kernel
values with the landmarks, whitened by the landmarks' own kernel matrix (the
positive part of it: the sigmoid kernel is not definite).  The kernel width is
the reference's ``scale``: one over dimension times variance of the fit's train
rows.  The loss is the squared hinge, summed and weighted by C, beside half the
squared norm; classes are compared pairwise and vote, the first of equal ones
wins, as the reference's classifier does for either shape of its decision
function.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexis.functions.arrays import l2_normalize, seeded_key
from lexis.operators.boosting import ALL_ROWS, matrix
from lexis.session import written

# The reference's grid (its third axis never changes a prediction).
SVM_C = [0.1, 1.0, 10.0, 20.0]
SVM_KERNELS = ["rbf", "linear", "sigmoid"]

LANDMARKS = 256
"""Rows that carry the kernel map; more give a closer kernel, at the square of the work."""

MAX_PASSES = 60
GRADIENT_TOLERANCE = 1e-3
MEMORY = 8
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class Point:
    c: float
    kernel: str

    def params(self) -> str:
        return json.dumps({"C": self.c, "kernel": self.kernel}, sort_keys=True)


def svm_points(cs=SVM_C, kernels=SVM_KERNELS) -> list[Point]:
    return [Point(*p) for p in product(cs, kernels)]


@dataclass(frozen=True)
class KernelMap:
    """Rows -> features of one kernel and fold; the last feature is constant."""

    kernel: str
    gamma: float
    landmarks: np.ndarray
    project: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = x if self.kernel == "linear" else kernel_values(self.kernel, x, self.landmarks, self.gamma) @ self.project
        return np.hstack([z, np.ones((len(z), 1))])

    @property
    def width(self) -> int:
        return (self.landmarks.shape[1] if self.kernel == "linear" else self.project.shape[1]) + 1


def kernel_values(kernel: str, x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    if kernel == "sigmoid":
        return np.tanh(gamma * (x @ y.T))
    return np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0.0))


def kernel_map(kernel: str, gamma: float, landmarks: np.ndarray) -> KernelMap:
    if kernel == "linear":
        return KernelMap(kernel, gamma, landmarks[:1], np.zeros((0, 0)))
    e, u = np.linalg.eigh(kernel_values(kernel, landmarks, landmarks, gamma))
    keep = e > 1e-8 * max(e.max(initial=0.0), 1e-300)
    return KernelMap(kernel, gamma, landmarks, u[:, keep] / np.sqrt(e[keep]))


@dataclass
class Columns:
    """The problems that share one feature map: every C and class pair of one fold."""

    map: KernelMap
    fold: int
    cs: np.ndarray
    first: np.ndarray
    second: np.ndarray


def pair_targets(labels: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """+1 for rows of the first class of a pair, -1 for the second, 0 for rows of neither (rows x columns)."""
    return (labels[:, None] == first[None, :]).astype(float) - (labels[:, None] == second[None, :])


def hinge_parts(z: np.ndarray, targets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Summed squared hinge (first row) and its gradient by weight (other rows) of every column."""
    slack = np.maximum(0.0, 1.0 - targets * (z @ weights)) * (targets != 0)
    return np.vstack([(slack * slack).sum(axis=0), z.T @ (-2.0 * targets * slack)])


def normalised_blocks(train: DataFrame, vec_col: str, label_col: str, fold_col: str, dim: int) -> DataFrame:
    """A written table of blocks of L2-normalised rows with their labels and folds."""
    rows = train.select(F.col(label_col).cast("int").alias("label"), F.col(fold_col).cast("int").alias("fold"), l2_normalize(vec_col).alias("v"))

    def pack(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                labels, folds = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int32).tobytes() for c in ("label", "fold"))
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (labels, folds, matrix(part.column("v"), dim).tobytes())], names=["labels", "folds", "x"])

    return written(rows.mapInArrow(pack, "labels binary, folds binary, x binary"), "svm-rows")


def _read(batches, dim: int):
    for batch in batches:
        for row in batch.to_pylist():
            yield np.frombuffer(row["labels"], np.int32), np.frombuffer(row["folds"], np.int32), np.frombuffer(row["x"], float).reshape(-1, dim)


def loss_and_gradient(blocks: DataFrame, columns: list[Columns], weights: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """``hinge_parts`` of every column group over its train rows: one job for the whole grid."""
    def run(batches):
        sums = [np.zeros((w.shape[0] + 1, w.shape[1])) for w in weights]
        for labels, folds, x in _read(batches, dim):
            for i, (group, w) in enumerate(zip(columns, weights)):
                mine = folds != group.fold
                if mine.any():
                    sums[i] += hinge_parts(group.map.features(x[mine]), pair_targets(labels[mine], group.first, group.second), w)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([s.tobytes() for s in sums], pa.binary())], names=["grp", "part"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(x.as_buffer(), float) for batch in batches for x in batch.column("part"))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.asarray(total).tobytes()], pa.binary())], names=["grp", "part"])

    rows = blocks.mapInArrow(run, "grp int, part binary").groupBy("grp").applyInArrow(add, "grp int, part binary").collect()
    found = {r["grp"]: np.frombuffer(bytes(r["part"]), float) for r in rows}
    return [found[i].reshape(w.shape[0] + 1, w.shape[1]) if i in found else np.zeros((w.shape[0] + 1, w.shape[1])) for i, w in enumerate(weights)]


class _Steps:
    """Limited-memory quasi-Newton steps of all columns of one group, each with its own length."""

    def __init__(self, width: int, cs: np.ndarray):
        n = len(cs)
        self.cs, self.w = cs, np.zeros((width, n))
        self.loss, self.gradient = np.full(n, np.inf), np.zeros((width, n))
        self.direction, self.length = np.zeros((width, n)), np.ones(n)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.start = np.zeros(n)
        self.done = np.zeros(n, bool)
        self.fresh = True

    def trial(self) -> np.ndarray:
        return self.w + self.direction * np.where(self.done, 0.0, self.length)

    def tell(self, parts: np.ndarray) -> None:
        """Loss and gradient at the trial point: accepted columns move on, the others halve their step."""
        at = self.trial()
        loss = 0.5 * (at * at).sum(axis=0) + self.cs * parts[0]
        gradient = at + parts[1:] * self.cs
        slope = (self.gradient * self.direction).sum(axis=0) * self.length
        good = (loss <= self.loss + 1e-4 * slope) & ~self.done
        if self.fresh:
            self.start, self.fresh = np.linalg.norm(gradient, axis=0), False
        else:
            # columns that stay have no part in the new pair
            self.pairs = [*self.pairs, (np.where(good, at - self.w, 0.0), np.where(good, gradient - self.gradient, 0.0))][-MEMORY:]
        self.w, self.gradient = np.where(good, at, self.w), np.where(good, gradient, self.gradient)
        self.loss = np.where(good, loss, self.loss)
        self.length = np.where(good, 1.0, self.length / 2)
        self.done |= (np.linalg.norm(self.gradient, axis=0) <= GRADIENT_TOLERANCE * self.start) | (self.length < 1e-10)
        self.direction = np.where(good, self._towards(), self.direction)

    def _towards(self) -> np.ndarray:
        q, kept = self.gradient.copy(), []
        for s, y in reversed(self.pairs):
            sy = (s * y).sum(axis=0)
            rho = np.divide(1.0, sy, out=np.zeros_like(sy), where=sy > 1e-12)
            a = rho * (s * q).sum(axis=0)
            q -= a * y
            kept.append((s, y, rho, a))
        scale = np.full(q.shape[1], np.nan)
        for s, y in reversed(self.pairs):
            yy, sy = (y * y).sum(axis=0), (s * y).sum(axis=0)
            use = np.isnan(scale) & (sy > 1e-12)
            scale = np.where(use, np.divide(sy, yy, out=np.ones_like(sy), where=yy > 0), scale)
        q *= np.where(np.isnan(scale), 1.0 / np.maximum(np.linalg.norm(self.gradient, axis=0), 1.0), scale)
        for s, y, rho, a in reversed(kept):
            q += s * (a - rho * (y * q).sum(axis=0))
        return -q


def votes(margins: np.ndarray, first: np.ndarray, second: np.ndarray, classes: int) -> np.ndarray:
    """Class with most won pairs; the first of equal ones."""
    won = np.where(margins > 0, first[None, :], second[None, :])
    return np.stack([(won == c).sum(axis=1) for c in range(classes)], axis=1).argmax(axis=1)


def _scales(train: DataFrame, vec_col: str, fold_col: str, dim: int, folds: list[int]) -> dict[int, float]:
    """1 / (dimension x variance of all entries) over the normalised rows outside each fold."""
    rows = train.select(F.col(fold_col).alias("fold"), l2_normalize(vec_col).alias("v"))
    one = rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("s"),
                                   F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("q")).collect()
    out = {}
    for fold in folds:
        mine = [r for r in one if r["fold"] != fold]
        n = sum(r["n"] for r in mine) * dim
        var = sum(r["q"] for r in mine) / n - (sum(r["s"] for r in mine) / n) ** 2 if n else 0.0
        out[fold] = 1.0 / (dim * var) if var > 0 else 1.0
    return out


class KernelSvm(Model):
    """A fitted machine of one grid point; ``transform`` adds ``prediction`` in one Arrow-batched pass."""

    def __init__(self, map_: KernelMap, weights: np.ndarray, first: np.ndarray, second: np.ndarray, classes: int, vec_col: str):
        super().__init__()
        self.map, self.weights, self.first, self.second, self.classes, self.vec_col = map_, weights, first, second, classes, vec_col

    def _transform(self, dataset: DataFrame) -> DataFrame:
        map_, weights, first, second, classes = self.map, self.weights, self.first, self.second, self.classes

        @F.pandas_udf("double")
        def predicted(vectors):
            import pandas as pd

            out = [votes(map_.features(np.stack(vectors.iloc[lo:lo + BLOCK_ROWS].to_numpy()).astype(float)) @ weights, first, second, classes)
                   for lo in range(0, len(vectors), BLOCK_ROWS)]
            return pd.Series(np.concatenate(out).astype(float) if out else np.zeros(0))

        return dataset.withColumn("prediction", predicted(l2_normalize(self.vec_col)))

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """``pair_first, pair_second, position, coefficient`` in feature space (the last position is the constant)."""
        rows = [(int(a), int(b), i, float(w)) for a, b, column in zip(self.first, self.second, self.weights.T) for i, w in enumerate(column)]
        return spark.createDataFrame(rows, "pair_first int, pair_second int, position int, coefficient double")

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        self.coefficients(spark).write.mode("overwrite").parquet(f"{path}/coefficients")
        table = lambda m: [(i, [float(x) for x in row]) for i, row in enumerate(m)]
        for name, values in (("landmarks", self.map.landmarks), ("projection", self.map.project)):
            spark.createDataFrame(table(values), "place int, entries array<double>").write.mode("overwrite").parquet(f"{path}/{name}")
        meta = {"class": f"{type(self).__module__}.{type(self).__name__}", "kernel": self.map.kernel, "gamma": self.map.gamma,
                "classes": self.classes, "vec_col": self.vec_col, "width": int(self.weights.shape[0])}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @staticmethod
    def load(path: str) -> "KernelSvm":
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        read = lambda name: np.array([r["entries"] for r in spark.read.parquet(f"{path}/{name}").orderBy("place").collect()], float)
        project = read("projection")
        map_ = KernelMap(meta["kernel"], meta["gamma"], read("landmarks"), project if project.size else np.zeros((0, 0)))
        first, second = _pairs(meta["classes"])
        at = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(first, second))}
        weights = np.zeros((meta["width"], len(first)))
        for r in spark.read.parquet(f"{path}/coefficients").collect():
            weights[r["position"], at[r["pair_first"], r["pair_second"]]] = r["coefficient"]
        return KernelSvm(map_, weights, first, second, meta["classes"], meta["vec_col"])


def _pairs(classes: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = list(combinations(range(classes), 2)) or [(0, 1)]
    return np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])


def svm_search(train: DataFrame, classes: int, dim: int, id_col: str, vec_col: str = "vec", label_col: str = "label", fold_col: str = "fold",
               points: list[Point] | None = None, folds: int = 3, landmarks: int = LANDMARKS, seed: str = "42",
               max_passes: int = MAX_PASSES) -> tuple[KernelSvm, str, dict[str, float], int]:
    """Grid search on mean fold accuracy: best model on all train rows, its parameters, every point's accuracy, passes made.

    Labels are codes 0..classes-1; rows with a null label, fold or vector are
    left out.  Of equally good points the first of the grid wins.
    """
    points = points or svm_points()
    train = train.filter(F.col(label_col).isNotNull() & F.col(fold_col).isNotNull() & F.col(vec_col).isNotNull())
    blocks = normalised_blocks(train, vec_col, label_col, fold_col, dim)
    which = [*range(folds), ALL_ROWS]
    gamma = _scales(train, vec_col, fold_col, dim, which)
    first, second = _pairs(classes)
    keyed = train.select(seeded_key(f"{seed}-landmark", id_col).alias("k"), F.col(fold_col).alias("fold"), l2_normalize(vec_col).alias("v"))
    columns, cs_of = [], {k: [p.c for p in points if p.kernel == k] for k in dict.fromkeys(p.kernel for p in points)}
    for fold in which:
        rows = keyed.filter(F.col("fold") != fold).orderBy("k").limit(landmarks).collect()
        marks = np.array([r["v"] for r in rows], float).reshape(-1, dim)
        for kernel, cs in cs_of.items():
            map_ = kernel_map(kernel, gamma[fold], marks if len(marks) else np.zeros((1, dim)))
            columns.append(Columns(map_, fold, np.repeat(cs, len(first)), np.tile(first, len(cs)), np.tile(second, len(cs))))
    steps = [_Steps(g.map.width, g.cs) for g in columns]
    passes = 0
    while passes < max_passes and not all(s.done.all() for s in steps):
        todo = [i for i, s in enumerate(steps) if not s.done.all()]
        for i, parts in zip(todo, loss_and_gradient(blocks, [columns[i] for i in todo], [steps[i].trial() for i in todo], dim)):
            steps[i].tell(parts)
        passes += 1
    mean = _fold_accuracy(blocks, columns, steps, points, classes, dim, first, second)
    best = max(range(len(points)), key=lambda i: (round(mean[points[i].params()], 12), -i))
    chosen = next(i for i, g in enumerate(columns) if g.fold == ALL_ROWS and g.map.kernel == points[best].kernel)
    mine = steps[chosen].w[:, columns[chosen].cs == points[best].c]
    return KernelSvm(columns[chosen].map, mine, first, second, classes, vec_col), points[best].params(), mean, passes


def _fold_accuracy(blocks, columns, steps, points, classes, dim, first, second) -> dict[str, float]:
    weights = [s.w for s in steps]

    def run(batches):
        for labels, folds, x in _read(batches, dim):
            out = []
            for i, (group, w) in enumerate(zip(columns, weights)):
                mine = folds == group.fold
                if group.fold == ALL_ROWS or not mine.any():
                    continue
                margins = group.map.features(x[mine]) @ w
                for j, c in enumerate(np.unique(group.cs)):
                    chosen = votes(margins[:, group.cs == c], first, second, classes)
                    out.append((i, float(c), int(mine.sum()), int((chosen == labels[mine]).sum())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int32(), pa.float64(), pa.int64(), pa.int64()))], names=["grp", "c", "n", "hits"])

    rows = blocks.mapInArrow(run, "grp int, c double, n long, hits long").groupBy("grp", "c").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).collect()
    share: dict[tuple[str, float], list[float]] = {}
    for r in rows:
        share.setdefault((columns[r["grp"]].map.kernel, r["c"]), []).append(r["hits"] / r["n"])
    return {p.params(): float(np.mean(share.get((p.kernel, p.c), [0.0]))) for p in points}
