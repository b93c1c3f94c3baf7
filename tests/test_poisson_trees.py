import numpy as np
import pytest

from kerbflow.operators import poisson_trees as trees

SETTINGS = trees.Settings(depth=2, rate=0.3, most_trees=12, patience=3, least_rows=5.0)
FEATURES = ["a", "b", "c"]


def panel(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = rng.poisson(np.exp(0.3 + 0.9 * (x[:, 0] > 0.2) - 0.8 * (x[:, 1] > -0.3)))
    split = np.where(np.arange(n) % 5 == 0, "val", np.where(np.arange(n) % 5 == 1, "test", "train"))
    x[::50, 2] = np.nan
    rows = [(i, str(split[i]), int(y[i]), float(x[i, 0]), float(x[i, 1]), None if np.isnan(x[i, 2]) else float(x[i, 2]), "spare") for i in range(n)]
    return spark.createDataFrame(rows, "zone_id int, split string, violation_count int, a double, b double, c double, weight string"), x, y, split


def plain_split(x, g, h, cuts, settings):
    """Best split of the given rows by loops over all features and cuts."""
    best = (1e-9, 0, trees.BINS)
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + settings.ridge)
    for f in range(x.shape[1]):
        for cut in range(len(cuts[f]) + 1):
            left = np.isnan(x[:, f]) if cut == 0 else np.isnan(x[:, f]) | (x[:, f] <= cuts[f][cut - 1])
            if min(left.sum(), (~left).sum()) >= settings.least_rows:
                gain = round(score(left) + score(~left) - score(np.ones(len(x), bool)), 9)
                best = max(best, (gain, -f, -cut)) if best[2] == trees.BINS or gain > best[0] else best
    return best


def test_first_tree_against_loops(spark):
    df, x, y, split = panel(spark)
    cuts = trees.feature_cuts(df.where("split = 'train'"), FEATURES)
    rows = trees.condensed(df, FEATURES, cuts, "violation_count", "split")
    model, _ = trees.grow(rows, FEATURES, cuts, SETTINGS, ("train",), 1)
    learn = split == "train"
    x, y = x[learn], y[learn].astype(float)
    mean = y.mean()
    assert model.base == pytest.approx(np.log(mean)) and len(model.trees) == 1
    g, h, tree, inside = mean - y, np.full(len(y), mean), model.trees[0], [np.ones(len(y), bool)]
    for place in range(3):
        here = inside[place]
        gain, f, cut = plain_split(x[here], g[here], h[here], cuts, SETTINGS)
        assert gain > 1e-9 and (tree.feature[place], tree.cut[place]) == (-f, -cut)
        below = np.isnan(x[:, -f]) if cut == 0 else np.isnan(x[:, -f]) | (x[:, -f] <= cuts[-f][-cut - 1])
        inside += [here & below, here & ~below]
    for leaf, here in enumerate(inside[3:]):
        assert tree.value[leaf] == pytest.approx(-SETTINGS.rate * g[here].sum() / (h[here].sum() + SETTINGS.ridge))


def test_early_stop_refit_and_prediction(spark):
    df, x, y, split = panel(spark)
    cuts = trees.feature_cuts(df.where("split = 'train'"), FEATURES)
    rows = trees.condensed(df, FEATURES, cuts, "violation_count", "split")
    tuned, losses = trees.grow(rows, FEATURES, cuts, SETTINGS, ("train",))
    assert len(tuned.trees) == int(np.argmin(losses)) and losses[len(tuned.trees)] < losses[0]
    model = trees.fit(df, FEATURES, settings=SETTINGS)
    assert len(model.trees) == len(tuned.trees)
    got = {r.zone_id: r.pred for r in trees.predict(model, df, ["zone_id"], settings=SETTINGS).collect()}
    matrix = np.stack([trees.binned(x[:, f], model.cuts[f]) for f in range(3)], axis=1)
    expected = np.exp(trees.margins(model, matrix, SETTINGS.depth))
    assert [got[i] for i in range(len(x))] == pytest.approx(list(expected))
    deviance = lambda p: np.mean(p - y * np.log(p))
    assert deviance(expected) < deviance(np.full(len(y), y.mean())) - 0.05


def test_no_rows_and_constant_labels(spark):
    df, *_ = panel(spark, 60)
    flat = df.selectExpr("zone_id", "split", "3 AS violation_count", "1D AS a", "CAST(NULL AS DOUBLE) AS b", "c")
    model = trees.fit(flat, FEATURES, settings=SETTINGS)
    assert {round(r.pred, 6) for r in trees.predict(model, flat, ["zone_id"], settings=SETTINGS).collect()} == {3.0}
    assert trees.fit(flat.limit(0), FEATURES, settings=SETTINGS).trees == []


def test_rows_pass_a_tree_by_whole_columns():
    """Histograms of stored rows equal loops over rows, in a slice of a batch too."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    bins = rng.integers(0, trees.BINS, (300, 3)).astype(np.uint8)
    draw = lambda: trees.Tree([int(f) for f in rng.integers(0, 3, 3)], [int(c) for c in rng.integers(3, 30, 3)], [float(v) for v in rng.normal(size=4)])
    model, growing = trees.Model(FEATURES, [[]] * 3, -0.2, [draw() for _ in range(5)]), draw()
    split, weight, total = rng.choice(["train", "val"], 300), rng.integers(1, 9, 300).astype(float), rng.poisson(3, 300).astype(float)
    batch = pa.RecordBatch.from_arrays([pa.array(split), pa.array([r.tobytes() for r in bins], pa.binary()), pa.array(weight), pa.array(total)], ["split", "bins", "weight", "total"])

    expected = np.zeros((3, 2 * 3 * trees.BINS))
    for i in range(10, 290):
        if split[i] == "train":
            margin = model.base
            for t in model.trees:
                margin += t.value[_walk(t, bins[i], 2)]
            mean, node = weight[i] * np.exp(margin), _walk(growing, bins[i], 1)
            for f in range(3):
                expected[:, (node * 3 + f) * trees.BINS + bins[i, f]] += [mean - total[i], mean, weight[i]]
    out = next(trees._histograms(model, growing, 1, 2, ("train",))(iter([batch.slice(10, 280)])))
    cell = np.asarray(out.column("cell"))
    got = np.zeros_like(expected)
    for k, name in enumerate(("gradient", "hessian", "weight")):
        got[k, cell[cell >= 0]] = np.asarray(out.column(name))[cell >= 0]
    assert got == pytest.approx(expected)


class Columns(np.ndarray):
    """A matrix that is read by whole columns alone."""

    def __getitem__(self, key):
        assert isinstance(key, tuple) and key[0] == slice(None) and np.ndim(key[1]) == 0, "a row was looked up by itself"
        return np.asarray(self)[key]


def test_trees_read_whole_columns():
    """Looking each row's feature up by itself made the trees so far most of a level's work."""
    bins = np.asfortranarray(np.random.default_rng(2).integers(0, trees.BINS, (50, 4)).astype(np.uint8))
    tree = trees.Tree([0, 1, 2, 3, 0, 1, 2], [9, 12, 15, 18, 21, 24, 27], [0.1 * k for k in range(8)])
    got = trees.margins(trees.Model(list("abcd"), [[]] * 4, 0.5, [tree]), bins.view(Columns), 3)
    assert got == pytest.approx([0.5 + tree.value[_walk(tree, row, 3)] for row in bins])


def _walk(tree, row, levels):
    node = 0
    for level in range(levels):
        at = 2 ** level - 1 + node
        node = 2 * node + int(row[tree.feature[at]] > tree.cut[at])
    return node
