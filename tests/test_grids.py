"""Grid searches in shared passes: kernels against brute force, whole searches on separable data, stored models."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexis.operators import boosting as B
from lexis.operators import kernel_svm as K
from lexis.operators import prep as P
from lexis.operators import train as T
from lexis.sources import stored as S


def plain_split(cells, g, h, bins):
    """Best split of one node by trying every feature and bin."""
    best = (-np.inf, 0, 0)
    score = lambda a, b: a * a / (b + 1.0)
    for f in range(cells.shape[1]):
        for b in range(bins - 1):
            left = cells[:, f] <= b
            gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[~left].sum(), h[~left].sum()
            if hl >= 1 and hr >= 1:
                gain = round(score(gl, hl) + score(gr, hr) - score(gl + gr, hl + hr), 9)
                if gain > best[0]:
                    best = (gain, f, b)
    return best


def test_split_equals_brute_force():
    rng = np.random.default_rng(0)
    for n in (8, 60, 300):
        cells = rng.integers(0, 6, (n, 5)).astype(np.uint8)
        g, h = rng.normal(size=n), rng.uniform(0.1, 0.5, n)
        hist = B.histogram(cells + np.arange(5) * 6, np.zeros(n, int), g, h, 1, 30)
        f, b, gain = B.best_splits(hist, 5, 6)[0][:3]
        want = plain_split(cells, g, h, 6)
        assert (gain, int(f), int(b)) == want or (gain == want[0] == -np.inf)


def test_binning_and_routing():
    edges = np.array([[0.0, 1.0, 1.0], [5.0, 6.0, 7.0]])
    cells = B.binned(np.array([[0.0, 5.0], [0.5, 5.5], [1.0, 8.0], [2.0, 0.0]]), edges)
    assert cells.tolist() == [[0, 0], [1, 1], [1, 3], [3, 0]]
    feature, cut = np.array([[0, -1, 1, -1, -1, -1, -1]]), np.array([[0, 0, 1, 0, 0, 0, 0]])
    assert B.routed(cells, feature, cut, 2)[:, 0].tolist() == [1, 5, 6, 5]


@pytest.fixture(scope="module")
def blobs(spark):
    """Three classes around three centres, one of them holding half of the rows, plus rows without label or vector."""
    rng = np.random.default_rng(3)
    centres = np.array([[2, 0, 0, 0], [0, 2, 0, 0], [0, 0, 2, 2]])
    label = np.r_[np.zeros(60, int), np.ones(30, int), np.full(30, 2)]
    rows = [(i, int(c), (centres[c] + rng.normal(scale=0.5, size=4)).astype(float).tolist()) for i, c in enumerate(label)]
    df = spark.createDataFrame(rows, "doc_id long, label int, vec array<double>")
    extra = spark.createDataFrame([(900, None, [0.0] * 4), (901, 1, None)], "doc_id long, label int, vec array<double>")
    return P.stratified_folds(df.unionByName(extra), "label", "doc_id").cache()


def accuracy(model, df):
    out = model.transform(df.filter("label IS NOT NULL AND vec IS NOT NULL"))
    return out.filter(F.col("prediction") == F.col("label")).count() / out.count()


def test_tree_search(spark, blobs):
    points = B.tree_points([0.3, 0.01], [0.0, 1000.0], [2, 3])
    model, params, mean = B.boosted_search(blobs, 3, 4, points=points, rounds=6, bins=8, keep_every=2)
    assert '"eta": 0.3' in params and '"gamma": 0.0' in params and len(mean) == 8
    assert accuracy(model, blobs) > 0.95 and max(mean.values()) > 0.9
    # no split lowers the loss by 1000, so such a point knows the class sizes at best
    assert mean[B.Point(0.3, 1000.0, 2).params()] == pytest.approx(0.5)
    path = tempfile.mkdtemp(prefix="lexis-trees-", dir="/tmp")
    model.save(path)
    back = S.load_model(path)
    assert isinstance(back, B.BoostedTrees)
    a, b = (m.transform(blobs.filter("vec IS NOT NULL")).select("doc_id", "prediction").orderBy("doc_id").collect() for m in (model, back))
    assert a == b


def test_tree_passes_do_not_depend_on_the_layout(spark, blobs, monkeypatch):
    """One row partition, several with summed histograms, narrow passes, scores kept or not: the same trees."""
    train = blobs.filter("label IS NOT NULL AND vec IS NOT NULL")
    edges = B.quantile_edges(train, "vec", 4, 8)
    fits = [B.Fit(B.Point(0.5, 0.0, 3), f) for f in (0, B.ALL_ROWS)]

    def grown(parts):
        state = B.share(train, fits, 3, 4, edges, "vec", slots=2)
        state.row_parts = parts
        first = B.grow_round(state)
        state.pending.append(first)
        if parts == 1:
            state = B.keep_scores(state)
        return first, B.grow_round(state)

    want = grown(1)
    # workers keep their own PASS_BYTES; the narrow passes of the driver's level loop are what is set here
    for parts, size in ((3, B.PASS_BYTES), (3, 4 * 8 * 16)):
        monkeypatch.setattr(B, "PASS_BYTES", size)
        for a, b in zip(want, grown(parts)):
            assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.value, b.value)


def test_hinge_gradient_against_differences():
    rng = np.random.default_rng(1)
    z, w = rng.normal(size=(40, 5)), rng.normal(size=(5, 2))
    y = K.pair_targets(rng.integers(0, 3, 40), np.array([0, 1]), np.array([1, 2]))
    at = K.hinge_parts(z, y, w)
    for i in range(5):
        for j in range(2):
            up = w.copy()
            up[i, j] += 1e-6
            assert (K.hinge_parts(z, y, up)[0, j] - at[0, j]) / 1e-6 == pytest.approx(at[i + 1, j], rel=1e-3, abs=1e-3)


def test_svm_search(spark, blobs):
    model, params, mean, passes = K.svm_search(blobs, 3, 4, "doc_id", points=K.svm_points([0.1, 10.0]), landmarks=30)
    assert len(mean) == 6 and max(mean.values()) > 0.9 and passes <= K.MAX_PASSES
    assert accuracy(model, blobs) > 0.9
    path = tempfile.mkdtemp(prefix="lexis-svm-", dir="/tmp")
    model.save(path)
    back = S.load_model(path)
    a, b = (m.transform(blobs.filter("vec IS NOT NULL")).select("doc_id", "prediction").orderBy("doc_id").collect() for m in (model, back))
    assert a == b
    for kernel in ("rbf", "sigmoid"):
        assert K.svm_search(blobs, 3, 4, "doc_id", points=K.svm_points([1.0], [kernel]), landmarks=30)[2][K.Point(1.0, kernel).params()] > 0.85


def test_svm_reaches_the_minimum():
    """The column steps end where a plain solver of the same loss ends."""
    rng = np.random.default_rng(4)
    z = np.hstack([rng.normal(size=(80, 3)), np.ones((80, 1))])
    labels = (z[:, 0] + 0.3 * rng.normal(size=80) > 0).astype(int)
    y = K.pair_targets(labels, np.array([0, 0]), np.array([1, 1]))
    steps = K._Steps(4, np.array([0.1, 10.0]))
    for _ in range(80):
        steps.tell(K.hinge_parts(z, y, steps.trial()))
    for j, c in enumerate((0.1, 10.0)):
        w = np.zeros(4)
        for _ in range(40000):
            w -= 2e-4 / c * (w + c * K.hinge_parts(z, y[:, :1], w[:, None])[1:, 0]) if c > 1 else 2e-3 * (w + c * K.hinge_parts(z, y[:, :1], w[:, None])[1:, 0])
        assert np.allclose(steps.w[:, j], w, atol=2e-2)


def test_exact_stratified_folds(spark, monkeypatch):
    rows = [(i, "a" if i % 3 else "b") for i in range(100)] + [(200 + i, None) for i in range(7)] + [(5, "c"), (5, "c"), (None, "c"), (None, "c")]
    df = spark.createDataFrame(rows, "doc_id long, lang string").repartition(5)
    for digits in (1, 5):
        monkeypatch.setattr(P, "BUCKET_HEX", digits)
        out = P.stratified_folds(df, "lang", "doc_id").collect()
        assert sorted(((r["doc_id"], r["lang"]) for r in out), key=str) == sorted(rows, key=str)
        sizes: dict = {}
        for r in out:
            sizes.setdefault(r["lang"], [0, 0, 0])[r["fold"]] += 1
        assert all(max(s) - min(s) <= 1 for s in sizes.values()) and set(sizes) == {"a", "b", "c", None}
    assert P.stratified_folds(df.limit(0), "lang", "doc_id").collect() == []


def test_grids_are_whole():
    assert len(K.svm_points()) == 12 and len(B.tree_points()) == 18 and B.TREE_ROUNDS == 100
    assert isinstance(T.svm_grid(), T.GridSearch) and isinstance(T.gbt_grid(), T.GridSearch)


def test_round_in_one_job_equals_levels_and_groups_are_even(spark, blobs):
    """Rows moved down level by level give the trees of rows routed from the root; deep trees are dealt over all groups, a task each."""
    train = blobs.filter("label IS NOT NULL AND vec IS NOT NULL")
    fits = [B.Fit(p, f) for p in B.tree_points([0.3, 1.0], [0.0, 0.5], [3, 6]) for f in (0, 1, 2, B.ALL_ROWS)]
    state = B.share(train, fits, 3, 4, B.quantile_edges(train, "vec", 4, 8), "vec", slots=4)
    assert len(state.groups) == 4 and {sum(fits[f].point.max_depth for f in g) for g in state.groups} == {36}
    assert sorted(f for g in state.groups for f in g) == list(range(len(fits)))
    held = state.table.select(F.spark_partition_id().alias("p"), "grp").distinct().collect()
    assert len({r["p"] for r in held}) == 4
    for _ in range(3):
        whole, levels = B.round_pass(state), B.grow_round(state, [])
        assert (whole.feature == levels.feature).all() and (whole.cut == levels.cut).all() and np.allclose(whole.value, levels.value)
        state.pending.append(whole)
    assert (whole.feature[:, 3:] >= 0).any()
