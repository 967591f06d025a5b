"""The tree learner against plain code, and the same trees from any partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import explain, training, trees

WIDTH = 5


def rows_of(seed, n):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 2, n), rng.integers(0, 6, n), rng.random(n).round(2), rng.exponential(size=n)])
    y = (x[:, 0] + x[:, 1] * x[:, 3] * 2 + rng.normal(size=n) * 0.7 > 0.6).astype(int)
    return x, y


@pytest.fixture(scope="module")
def table(spark):
    x, y = rows_of(1, 1500)
    return spark.createDataFrame([(*map(float, r), int(v), int(i % 3)) for i, (r, v) in enumerate(zip(x, y))],
                                 ", ".join(f"x{i} double" for i in range(WIDTH)) + ", label int, fold int").cache()


FEATURES = [f"x{i}" for i in range(WIDTH)]
SPECS = [
    {"trees": 13, "rate": 0.3, "depth": 4, "l2": 1.0, "l1": 0.1, "gamma": 0.1, "min_curvature": 3.0, "subsample": 0.8, "colsample": 0.8},
    {"trees": 4, "rate": 0.1, "leaves": 31, "min_rows": 20, "min_curvature": 0.001, "without_fold": 1},
    {"trees": 6, "forest": True, "per_node": 2, "weights": (1.0, 2.5)},
    {"trees": 3, "forest": True, "per_node": 2, "depth": 3, "without_fold": 0},
]


def same(a, b):
    return all(np.array_equal(getattr(a, n), getattr(b, n)) for n in ("feature", "bin", "threshold", "left", "right", "value", "cover", "gain"))


@pytest.fixture(scope="module")
def alone(table):
    return trees.fit_trees(table, FEATURES, SPECS, 1, "fold")


def test_the_same_trees_from_one_block_and_from_many(table, alone):
    in_step = trees.fit_trees(table, FEATURES, SPECS, 7, "fold")
    assert [len(f) for f in in_step] == [s["trees"] for s in SPECS] == [len(f) for f in alone]
    for one, other in zip(alone, in_step):
        assert all(same(a, b) for a, b in zip(one, other))


@pytest.mark.parametrize("small", [40, 400])
def test_small_nodes_are_grown_by_tasks(table, alone, small, monkeypatch):
    """Forests in step down to small nodes, whose rows go to one task each; cells are added up by tasks."""
    monkeypatch.setattr(trees, "GATHERED", 20_000 if small == 400 else trees.GATHERED)
    monkeypatch.setattr(trees, "WAVE", 4)
    grown = trees.fit_trees(table, FEATURES, SPECS, 5, "fold", small)
    for one, other in zip(alone, grown):
        assert len(one) == len(other) and all(same(a, b) for a, b in zip(one, other))


@pytest.mark.parametrize("spec", [SPECS[2], SPECS[3], {"forest": True, "per_node": 3, "min_split": 5, "min_rows": 4, "seed": 7, "colsample": 0.8}])
def test_whole_levels_give_the_trees_of_single_nodes(spec):
    x, y = rows_of(5, 700)
    cuts = [(np.unique(c)[:-1] + np.unique(c)[1:])[:: 1 + len(np.unique(c)) // 255] / 2 for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1).astype(np.uint8)
    spec, done = {**trees.DEFAULTS, **spec}, []
    block = trees.Block(bins, y.astype(np.int8), np.arange(700) * 7919, (np.arange(700) % 3).astype(np.int8))
    fit = trees.boost(spec, 0, np.array([len(c) + 1 for c in cuts]), cuts, 1, done, range(2, 3))
    request = next(fit)
    while request is not None:
        try:
            request = fit.send(block.sums(spec, request, done))
        except StopIteration:
            request = None
    assert same(done[0], trees.grow_alone(spec, 2, cuts, bins, block.label, block.draws(spec, 2))) and len(done[0].left) > 9


def test_one_task_may_hold_its_rows_in_pieces(table, alone, monkeypatch):
    """Rows beyond one block, as the training rows of 1 GB, still need no job for every step."""
    for one, other in zip(alone, trees.fit_trees(table, FEATURES, SPECS, 1, "fold", pieces=7)):
        assert len(one) == len(other) and all(same(a, b) for a, b in zip(one, other))

    def refused(*_):
        raise AssertionError("a job for every step")

    monkeypatch.setattr(trees, "_fit_in_step", refused)
    df = table.sparkSession.range(250_000).select((F.col("id") % 7).alias("x0"), (F.col("id") % 2).alias("x1"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    models = training.train_many(df, [{"kind": "boosted", "n_estimators": 2, "num_leaves": 4}, {"kind": "forest", "n_estimators": 11, "max_depth": 2}], ["x0", "x1"])
    assert [len(training.classifier_of(m).members()) for m in models] == [2, 11]
    assert {float(t.cover[0]) for t in training.classifier_of(models[0]).members()} == {250_000.0}


def test_features_counted_together_give_the_sums_of_each():
    rng = np.random.default_rng(3)
    widths = np.array([2, 57, 256, 2, 5, 2, 1, 256, 2])
    bins = np.stack([rng.integers(0, w, 900) for w in widths], axis=1).astype(np.uint8)
    groups = trees.joint_features(widths)
    assert sorted(sum(groups, [])) == list(range(9)) and len(groups) < 5 and all(widths[g].prod() <= trees.JOINT for g in groups)
    block = trees.Block(bins, (rng.random(900) < 0.4).astype(np.int8), np.arange(900) * 31, np.zeros(900, np.int8))
    spec = {**trees.DEFAULTS, "subsample": 0.7}
    request = trees.Request(0, 3, ([1], [20], [1], [2]), [2, 1], [[0, 1, 4, 7], [0, 1, 4, 7]], widths)
    request.splits = [np.array(a, np.int32) for a in ([1, 0, 0], [20, 0, 0], [1, -1, -1], [2, -1, -1])]
    found = block.sums(spec, request, [])
    weights = block.gradients(spec, 3, lambda: np.zeros(900))
    for i, here in enumerate((bins[:, 1] > 20, bins[:, 1] <= 20)):
        for j, f in enumerate((0, 1, 4, 7)):
            for total, w in zip(found, weights):
                at = request.offsets[i, j]
                assert np.array_equal(total[at : at + widths[f]], np.bincount(bins[here, f], w[here], widths[f]))


def test_rows_of_one_block_need_no_steps(spark, monkeypatch):
    """72,000 rows, the training rows of 0.1 GB, are one block: hundreds of jobs would take longer than the fit."""
    def refused(*_):
        raise AssertionError("a job for every step")

    monkeypatch.setattr(trees, "_fit_in_step", refused)
    df = spark.range(72_000).select((F.col("id") % 7).alias("x0"), (F.col("id") % 2).alias("x1"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    models = training.train_many(df, [{"kind": "boosted", "n_estimators": 2, "num_leaves": 4}], ["x0", "x1"])
    assert len(training.classifier_of(models[0]).members()) == 2


def test_votes_share_their_members(table, monkeypatch):
    fitted, fit = [], training._Rows.fit
    monkeypatch.setattr(training._Rows, "fit", lambda self, wanted, threads=3: fitted.append(len(wanted)) or fit(self, wanted, threads))
    members = ({"kind": "forest", "n_estimators": 2, "max_depth": 2}, {"kind": "boosted", "n_estimators": 2, "max_depth": 2})
    soft, hard = training.train_votes(table, members, FEATURES)
    assert fitted == [2] and "probability" in soft.transform(table).columns and "probability" not in hard.transform(table).columns


def plain_boosted(x, y, spec, cuts):
    """Best leaf first, every split tried on the rows themselves."""
    margin, out = np.zeros(len(y)), []
    for _ in range(spec["trees"]):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def worth(rows):
            return g[rows].sum() ** 2 / (h[rows].sum() + spec["l2"])

        def best(rows):
            top = (0.0, None)
            for f in range(x.shape[1]):
                for cut in cuts[f]:
                    low = x[rows, f] <= cut
                    a, b = rows[low], rows[~low]
                    if min(len(a), len(b)) >= spec["min_rows"] and min(h[a].sum(), h[b].sum()) >= spec["min_curvature"]:
                        gain = 0.5 * (worth(a) + worth(b) - worth(rows)) - spec["gamma"]
                        if gain > top[0] + 1e-6:
                            top = (gain, (f, cut, a, b))
            return top

        leaves = [(np.arange(len(y)), 0, *best(np.arange(len(y))))]
        while spec["leaves"] is None or len(leaves) < spec["leaves"]:
            able = [i for i, leaf in enumerate(leaves) if leaf[3] is not None and leaf[1] < spec["depth"]]
            if not able:
                break
            _, depth, _, (_, _, a, b) = leaves.pop(max(able, key=lambda i: leaves[i][2]))
            leaves += [(a, depth + 1, *best(a)), (b, depth + 1, *best(b))]
        for rows, *_ in leaves:
            margin[rows] -= spec["rate"] * g[rows].sum() / (h[rows].sum() + spec["l2"])
        out.append(len(leaves))
    return margin, out


@pytest.mark.parametrize("changes", [{"depth": 3, "l2": 1.0, "gamma": 0.2, "min_curvature": 2.0}, {"leaves": 9, "min_rows": 15, "min_curvature": 0.001}])
def test_boosting_against_plain_code(spark, changes):
    x, y = rows_of(2, 250)
    x = x.round(1)
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], ", ".join(f"x{i} double" for i in range(WIDTH)) + ", label int")
    spec = {**trees.DEFAULTS, "trees": 4, "rate": 0.3, **changes}
    grown = trees.fit_trees(df, FEATURES, [spec], 1)[0]
    margin, leaves = plain_boosted(x, y, spec, trees.fit_cuts(df, FEATURES))
    assert [int((t.left < 0).sum()) for t in grown] == leaves
    assert trees.margins(grown, x, False) == pytest.approx(margin, abs=1e-4)


def test_limits_hold(alone, table):
    boosted, leafwise, forest, shallow = alone
    assert max(int((t.left < 0).sum()) for t in leafwise) == 31 and all(t.cover[t.left < 0].min() >= 20 for t in leafwise)
    assert max(int((t.left < 0).sum()) for t in boosted) <= 16 and max(int((t.left < 0).sum()) for t in shallow) <= 8
    for tree in forest:  # grown to the end: a leaf is pure or cannot be told apart by the features it drew
        assert ((tree.value >= 0) & (tree.value <= 1)).all() and np.isin(tree.value[tree.left < 0], (0.0, 1.0)).mean() > 0.8
    rows = table.count()
    assert {t.cover[0] for t in leafwise} == {rows - table.filter("fold = 1").count()}
    assert 0.7 * rows < boosted[0].cover[0] < 0.9 * rows and forest[0].cover[0] != forest[1].cover[0]


def test_many_values_and_missing_ones(spark):
    df = spark.range(3000).select((F.col("id") / 7).alias("x0"), F.when(F.col("id") % 5 != 0, F.col("id") % 3).cast("double").alias("x1"),
                                  (F.col("id") % 5 == 0).cast("int").alias("label"))
    cuts = trees.fit_cuts(df, ["x0", "x1"])
    assert len(cuts[0]) == 255 and cuts[1].tolist() == [0.5, 1.5]
    tree = trees.fit_trees(df, ["x0", "x1"], [{"trees": 1, "forest": True, "per_node": 2, "depth": 4}], 3)[0][0]
    assert trees.margins([tree], np.array([[10.0, np.nan], [10.0, 1.0]]), True).round(3)[1] == 0.0


def test_packed_trees_come_back(alone):
    assert all(same(a, b) for fit in alone for a, b in zip(fit, trees.unpack_trees(trees.pack_trees(fit))))


def test_trees_saved_by_earlier_versions_come_back(alone):
    import base64
    import io

    data, fit = io.BytesIO(), list(alone[2])
    np.savez_compressed(data, sizes=np.array([len(t.left) for t in fit]), **{n: np.concatenate([getattr(t, n) for t in fit]) for n in (
        "feature", "bin", "threshold", "left", "right", "value", "cover", "gain")})
    back = trees.unpack_trees(base64.b64encode(data.getvalue()).decode())
    assert len(back) == len(fit) and all(same(a, b) for a, b in zip(fit, back))


def test_credits_by_pattern_are_those_of_the_rows(alone, monkeypatch):
    """Leaves of few features are credited by 2**features patterns, and not for every row anew."""
    x, _ = rows_of(9, 800)
    x[::50, 1] = np.nan
    for tree in [*alone[0][:3], *alone[3]]:
        tables, sizes, credit = explain.leaf_tables(tree), [], explain._credit
        with monkeypatch.context() as m:
            m.setattr(explain, "_credit", lambda inside, *rest: sizes.append(inside.shape) or credit(inside, *rest))
            looked_up = explain.shapley_batch(x, tables)
            assert all(patterns == 1 << width for _, patterns, width in sizes)
            m.setattr(explain, "PATTERN_WIDTH", 0)
            assert explain.shapley_batch(x, tables) == pytest.approx(looked_up, abs=1e-12)


def test_long_paths_are_credited_by_class(alone):
    """Rows that are inside the same features of a path are credited once."""
    x, _ = rows_of(9, 800)
    x[::50, 1] = np.nan
    for tree in [*alone[0][:3], *alone[2], *alone[3]]:
        widest = explain.widest_path(tree)
        assert widest == max(t[0].shape[1] for t in explain.leaf_tables(tree))
        assert explain.shapley_by_class(x, tree, widest, 0.5) == pytest.approx(explain.shapley_batch(x, explain.leaf_tables(tree, 0.5)), abs=1e-12)
    rng, width = np.random.default_rng(4), 12  # a path of twelve features, two of them tested twice
    order = [*range(width), 3, 7]
    nodes = {"feature": [], "threshold": [], "left": [], "right": [], "value": [], "cover": []}
    for i, f in enumerate(order):
        for column, cells in zip(nodes.values(), ((f, 0), (0.3 if i >= width else 0.5, 0.0), (2 * i + 2, -1), (2 * i + 1, -1), (0.0, rng.normal()), (2.0 ** -i, 2.0 ** -i * 0.4))):
            column += cells
    count = 2 * len(order) + 1
    for column, last in zip(nodes.values(), (0, 0.0, -1, -1, 1.0, 2.0 ** -len(order))):
        column.append(last)
    tree = trees.Tree(nodes["feature"], np.zeros(count), nodes["threshold"], nodes["left"], nodes["right"], nodes["value"], nodes["cover"], np.zeros(count))
    x = rng.random((300, width))
    assert explain.widest_path(tree) == width > explain.PATTERN_WIDTH
    assert explain.shapley_by_class(x, tree, width) == pytest.approx(explain.shapley_batch(x, explain.leaf_tables(tree)), abs=1e-12)


def test_trees_with_long_paths_are_dealt_out(table, monkeypatch):
    """Blocks of rows and trees go to tasks of their own; rows that repeat a key, or have none, stay as they are."""
    rows = table.withColumn("key", F.when(F.col("x2") > 0, F.col("x2").cast("string")))
    model = training.train(rows, {"kind": "forest", "n_estimators": 5, "max_depth": 6}, FEATURES)
    listed = lambda df: sorted((str(r["key"]), *r["feature_values"], r["base"], *np.round(r["contributions"], 12)) for r in df.collect())
    want = listed(explain.explain(rows, model, "key", FEATURES))
    monkeypatch.setattr(explain, "PATTERN_WIDTH", 0)
    monkeypatch.setattr(explain, "BLOCK_ROWS", 400)
    dealt, spread = [], explain._spread
    monkeypatch.setattr(explain, "_spread", lambda *args: dealt.append(args) or spread(*args))
    got = explain.explain(rows, model, "key", FEATURES)
    assert len(dealt) == 1 and got.columns == ["key", "feature_values", "base", "contributions"]
    assert np.allclose([r[1:] for r in listed(got)], [r[1:] for r in want], atol=1e-11) and len(want) == 1500
    assert explain.explain(rows.limit(0), model, "key", FEATURES).count() == 0


@pytest.mark.parametrize("kind", ["vote", "stack"])
def test_ensembles_are_explained(table, kind):
    members = ({"kind": "logistic"}, {"kind": "forest", "n_estimators": 3, "max_depth": 4},
               {"kind": "boosted", "n_estimators": 5, "learning_rate": 0.2, "num_leaves": 6})
    rows = table.withColumn("key", F.monotonically_increasing_id().cast("string"))
    rows = rows.sparkSession.createDataFrame(rows.collect(), rows.schema)
    model = training.train_voting(rows, members, FEATURES) if kind == "vote" else training.train_stacking(rows, "key", members, FEATURES, 3)
    explained = explain.explain(rows, model, "key", FEATURES)
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, b: a + b)
    output = total if kind == "vote" else 1 / (1 + F.exp(-total))
    gap = explained.join(model.transform(rows).select("key", "probability"), "key").agg(F.max(F.abs(output - F.col("probability"))), F.count("*")).first()
    assert gap[0] < 1e-9 and gap[1] == 1500
    listed = training.feature_importance(rows.sparkSession, model, FEATURES).collect()
    assert sum(r["importance"] for r in listed) == pytest.approx(1) and listed[0]["feature"] == "x0"
