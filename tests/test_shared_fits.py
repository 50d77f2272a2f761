"""Fits that share scans -- quantiles, folds, Newton steps, trees, starts -- against direct computations."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from marketlens.functions import quantiles as Q
from marketlens.operators import cart, classify as C, fold_moments as FM, kmeans, newton, prep, recommend as R, recommender as M, segment as G
from marketlens.operators.models import LeastSquares, PerTarget
from marketlens.plans.q_classify import cls_data
from marketlens.plans.q_prepare import reg_prepared
from marketlens.schema import CLASSIFICATION_FEATURES, PRODUCT_COLUMNS, STAGE_FEATURE_SETS
from marketlens.session import materialize

from conftest import SF_SMALL


def jobs_of(spark, run):
    """Result of ``run`` and the number of Spark jobs it started."""
    group = f"jobs-{id(run)}"
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "rest")
    return out, n


# quantiles

def table_of(spark, rng, n=900):
    cell = rng.integers(0, 6, n)
    columns = {"a": rng.normal(size=n) * 10.0 ** rng.integers(-8, 9, n), "b": rng.integers(-3, 4, n).astype(float), "c": np.full(n, 7.25),
               "d": np.where(rng.random(n) < 0.9, 1.0, rng.normal(size=n)), "e": np.full(n, np.nan), "f": rng.normal(size=n)}
    columns["f"][rng.random(n) < 0.3] = np.nan
    columns["b"][:3] = [-0.0, 0.0, -0.0]
    columns["a"][:2] = [np.inf, -np.inf]
    rows = [(int(cell[i]), *[None if np.isnan(v[i]) and i % 2 else float(v[i]) for v in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "cell int, a double, b double, c double, d double, e double, f double").repartition(5), cell, columns


@pytest.mark.parametrize("bins, gather", [(512, 2048), (4, 2), (3, 0), (512, 0)])
def test_quantiles_of_groups(spark, monkeypatch, bins, gather):
    monkeypatch.setattr(Q, "BINS", bins)
    monkeypatch.setattr(Q, "GATHER", gather)
    df, cell, columns = table_of(spark, np.random.default_rng(bins + gather), 900 if gather else 120)
    groups = {"all": set(range(6)), "even": {0, 2, 4}, "but 1": {0, 2, 3, 4, 5}, "none": {9}}
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = Q.quantiles_by_group(df, list(columns), probs, groups, F.col("cell"))
    for g, cells in groups.items():
        for c, v in columns.items():
            own = v[np.isin(cell, list(cells)) & ~np.isnan(v)]
            if not len(own):
                assert got[g][c] == [None] * len(probs)
                continue
            own = np.sort(own)
            for p, x in zip(probs, got[g][c]):
                h = p * (len(own) - 1)
                low, high = own[math.floor(h)], own[math.ceil(h)]
                assert x == pytest.approx(low + (h - math.floor(h)) * (high - low) if high > low else low, rel=1e-12, abs=0)


def test_quantile_passes_send_counts_only(spark):
    df = spark.range(200_000).select((F.col("id") * 1.37).alias("x"), F.sqrt("id").alias("y")).repartition(8)
    stored = materialize(df.select(F.lit(0).cast("long").alias("_cell"), "x", "y"))
    got, jobs = jobs_of(spark, lambda: Q.exact_quantiles(stored, ["x", "y"], (0.1, 0.5), stored=True))
    assert got["x"] == [pytest.approx(1.37 * 19_999.9), pytest.approx(1.37 * 99_999.5)] and jobs <= 12
    told = stored.mapInArrow(Q._task_fn(["x", "y"], {0: [(0, 1 << 62)]}, set(), Q.BINS), Q._SCHEMA)
    assert told.count() <= Q.BINS * stored.rdd.getNumPartitions()
    plan = told.groupBy("c").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("MapInArrow")  # nothing is exchanged below the counting
    assert Q.exact_quantiles(df.limit(0), ["x"]) == {"x": [None]}


# folds of the recommender

@pytest.fixture(scope="module")
def targets(spark):
    """Prepared rows with missing numbers and categories added."""
    data = M.prepared_targets(reg_prepared(spark, SF_SMALL))
    return materialize(data.withColumn("Income", F.when(F.col("ID") % 11 != 0, F.col("Income"))).withColumn("Recency", F.when(F.col("ID") % 7 != 1, F.col("Recency")))
                       .withColumn("Education", F.when(F.col("ID") % 13 != 2, F.col("Education"))))


def test_fold_fits_equal_direct_fits(spark, targets):
    fits = M.FoldFits(targets, STAGE_FEATURE_SETS, PRODUCT_COLUMNS, 5, True)
    assert len({id(t) for t in fits.terms.values()}) == 1  # one scan for all stages
    for stage, subset in [("New-user", 0), ("Existing-customer", 3), ("Early-behavior", "holdout"), ("Existing-customer", "holdout")]:
        train = targets.where(~F.col("is_test")) if subset == "holdout" else targets.where(F.col("fold") != subset)
        direct = prep.fit_stage(train, STAGE_FEATURE_SETS[stage])
        mine = fits.preprocessor(stage, subset)
        assert mine.output_names() == direct.output_names() and mine.modes == direct.modes and mine.levels == direct.levels
        for part in ("medians", "means", "scales"):
            a, b = getattr(mine, part), getattr(direct, part)
            assert a.keys() == b.keys() and all(a[c] == pytest.approx(b[c], rel=1e-10, abs=1e-10) for c in a)
        for name, model in M.REGRESSORS.items():
            want = M.fit_stage_model(train, stage, STAGE_FEATURE_SETS[stage], name, pre=direct).linear
            got = fits.model(stage, name, model, subset)[0].linear
            assert np.abs(got.coef - want.coef).max() < 1e-8 * max(1.0, np.abs(want.coef).max()) and np.abs(got.intercept - want.intercept).max() < 1e-8
            if subset == "holdout":
                continue
            rows = targets.where(F.col("fold") == subset).select("*", *[F.col(c).alias("a_" + c) for c in PRODUCT_COLUMNS])
            sm = M.StageModel(stage, name, STAGE_FEATURE_SETS[stage], direct, want)
            pred = sm.predict_raw(rows, ["ID", *["a_" + c for c in PRODUCT_COLUMNS]]).withColumnsRenamed({c: "p_" + c for c in PRODUCT_COLUMNS})
            assert fits.fold_r2(stage, name, model, subset) == pytest.approx(M._scores(pred.agg(*R.error_sums(PRODUCT_COLUMNS)).first(), PRODUCT_COLUMNS)[0], abs=1e-8)


def test_all_folds_from_few_jobs(spark, targets):
    _, jobs = jobs_of(spark, lambda: M.FoldFits(targets, STAGE_FEATURE_SETS, PRODUCT_COLUMNS, 5, True))
    assert jobs <= 14


def test_stages_with_too_many_products_have_scans_of_their_own(spark, targets, monkeypatch):
    shared = M.FoldFits(targets, STAGE_FEATURE_SETS, PRODUCT_COLUMNS, 5, False)
    monkeypatch.setattr(FM, "MAX_MONOMIALS", len(shared.terms["New-user"].monomials) - 1)
    own = M.FoldFits(targets, STAGE_FEATURE_SETS, PRODUCT_COLUMNS, 5, False)
    assert len({id(t) for t in own.terms.values()}) == 3
    for stage in STAGE_FEATURE_SETS:
        assert own.fold_r2(stage, M.LINEAR, M.REGRESSORS[M.LINEAR], 1) == pytest.approx(shared.fold_r2(stage, M.LINEAR, M.REGRESSORS[M.LINEAR], 1), abs=1e-10)


def test_any_model_by_mapping(spark):
    prepared = materialize(reg_prepared(spark, SF_SMALL))
    estimator = LinearRegression(regParam=0.0, solver="normal")
    sets = {"New-user": STAGE_FEATURE_SETS["New-user"]}
    models = {"plain": LeastSquares(), "ridge": LeastSquares(ridge=5.0), "ridge 2": LeastSquares(degree2=True, ridge=5.0), "estimator": estimator,
              "own": PerTarget(LinearRegression(regParam=0.1))}
    run = M.compare_recommenders(prepared, sets, models)
    rows = {r["Regression Model"]: r for r in run.summary.collect()}
    assert set(rows) == set(models) and run.final_key[1] in models and run.final_predictions.count() > 0
    for column in ("CV R2 Mean", "CV R2 Std", "Test R2", "Test MAE", "Recommendation Match Rate"):
        assert rows["estimator"][column] == pytest.approx(rows["plain"][column], abs=1e-6)
    assert rows["ridge"]["CV R2 Mean"] != rows["plain"]["CV R2 Mean"]
    ridge = run.models["New-user", "ridge"]
    train = M.prepared_targets(prepared, sets).where(~F.col("is_test"))
    x = ridge.pre.transform_columns(train, keep=["ID", *PRODUCT_COLUMNS]).toPandas()
    y, x = x[PRODUCT_COLUMNS].to_numpy(), x[ridge.pre.output_names()].to_numpy()
    xc, yc = x - x.mean(axis=0), y - y.mean(axis=0)
    assert np.allclose(ridge.linear.coef, np.linalg.solve(xc.T @ xc + 5.0 * np.eye(x.shape[1]), xc.T @ yc), atol=1e-9)
    direct = M.fit_stage_model(train, "New-user", sets["New-user"], "ridge", model=models["ridge"])
    assert np.allclose(direct.linear.coef, ridge.linear.coef, atol=1e-9)
    with pytest.raises(ValueError, match="registered"):
        M.compare_recommenders(prepared, sets, ["no such model"])


# logistic models and trees of all folds

@pytest.fixture(scope="module")
def responses(spark):
    data = cls_data(spark, SF_SMALL)
    return materialize(data.withColumn("Income", F.when(F.col("ID") % 9 != 0, F.col("Income"))))


def test_newton_gradient_vanishes_for_all_fits(spark, responses):
    fits = C.SplitFits(responses, CLASSIFICATION_FEATURES, 5, C.LABEL)
    rows = materialize(responses.select(fits.cell.cast("long").alias("cell"), fits.terms.array().alias("z"), F.col(C.LABEL).cast("int").alias("y")))
    wanted = {(b, s): newton.Fit(cells, C._balanced(*fits.counts(s)) if b else (1.0, 1.0), FM.design(fits.terms, fits.pre[s], False))
              for b in (False, True) for s, cells in fits.train.items()}
    models, jobs = jobs_of(spark, lambda: newton.fit_many(rows, wanted))
    assert len(models) == 12 and jobs <= 24 and max(m.steps for m in models.values()) <= 10  # at most two jobs a pass
    for (balanced, s), m in models.items():
        train = fits.vectors(s, False).select(vector_to_array("features").alias("x"), C.LABEL).collect()
        x, y = np.array([r["x"] for r in train]), np.array([r[C.LABEL] for r in train], dtype=float)
        w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if balanced else np.ones(len(y))
        p = 1 / (1 + np.exp(-(x @ m.coefficients + m.intercept)))
        assert np.abs(x.T @ (w * (p - y)) + m.coefficients).max() / len(y) < 1e-8 and abs((w * (p - y)).sum()) / len(y) < 1e-8


def test_newton_halves_steps_that_overshoot(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2)) * 30
    y = (x[:, 0] > 0).astype(int)  # separable: only the penalty keeps it finite
    rows = spark.createDataFrame([(0, x[i].tolist(), int(y[i])) for i in range(60)], "cell long, z array<double>, y int").cache()
    m = newton.fit_many(rows, {0: newton.Fit({0}, (1.0, 1.0), np.array([[0, 0], [1, 0], [0, 1.0]]), penalty=1e-6)})[0]
    p = 1 / (1 + np.exp(-np.clip(x @ m.coefficients + m.intercept, -700, 700)))
    assert np.abs(x.T @ (p - y) + 1e-6 * m.coefficients).max() / 60 < 1e-8


def brute_tree(x, y, w, depth, min_leaf):
    """Nested ``(feature, threshold, left, right)`` or the weighted share of class 1."""
    c = np.array([(y == 0).sum(), (y == 1).sum()])
    leaf = c[1] * w[1] / (c * w).sum()
    if depth == 0 or c.min() == 0 or len(y) < 2 * min_leaf:
        return leaf
    best = None
    for i in range(x.shape[1]):
        values = np.unique(x[:, i])
        for v, nxt in zip(values, values[1:]):
            left = x[:, i] <= v
            if min(left.sum(), (~left).sum()) < min_leaf:
                continue
            loss = 0.0
            for side in (left, ~left):
                a, b = (y[side] == 0).sum() * w[0], (y[side] == 1).sum() * w[1]
                loss -= (a * a + b * b) / (a + b)
            if best is None or (loss, i, v) < best[:3]:
                best = (loss, i, v, (v + nxt) / 2)
    if best is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    return (best[1], best[3], brute_tree(x[left], y[left], w, depth - 1, min_leaf), brute_tree(x[~left], y[~left], w, depth - 1, min_leaf))


def nested(tree, node=1):
    if node not in tree.splits:
        return tree.score_of(node)
    return (*tree.splits[node], nested(tree, 2 * node), nested(tree, 2 * node + 1))


def same_tree(a, b):
    if not isinstance(a, tuple) or not isinstance(b, tuple):
        return a == pytest.approx(b, abs=1e-12)
    return a[0] == b[0] and a[1] == pytest.approx(b[1]) and same_tree(a[2], b[2]) and same_tree(a[3], b[3])


def test_trees_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    n = 400
    x = np.stack([rng.normal(size=n), rng.integers(0, 4, n), rng.normal(size=n).round(1), np.ones(n), rng.integers(0, 2, n)], axis=1)
    y = (x[:, 0] + 0.7 * x[:, 1] + rng.normal(size=n) > 1.4).astype(int)
    missing = rng.random(n) < 0.1
    cell = rng.integers(0, 3, n)
    rows = spark.createDataFrame([(int(cell[i]), [None if missing[i] else float(x[i, 0]), *map(float, x[i, 1:])], int(y[i])) for i in range(n)],
                                 "cell long, x array<double>, y int").repartition(6).cache()
    specs = {"all": ({0, 1, 2}, (1.0, 1.0), 0.1, 5, 20), "two": ({0, 2}, (0.6, 2.3), -0.4, 5, 20)}
    grown = cart.grow(rows, {k: cart.Tree(cells, w, np.array([fill, 0, 0, 0, 0])) for k, (cells, w, fill, *_) in specs.items()})
    for k, (cells, w, fill, depth, leaf) in specs.items():
        own = np.isin(cell, list(cells))
        filled = x.copy()
        filled[missing, 0] = fill
        assert same_tree(nested(grown[k]), brute_tree(filled[own], y[own], np.array(w), depth, leaf))
    deep = cart.grow(rows, {0: cart.Tree({1}, (1.0, 1.0), np.zeros(5))}, max_depth=4, min_leaf=1)[0]
    filled = x.copy()
    filled[missing, 0] = 0
    assert same_tree(nested(deep), brute_tree(filled[cell == 1], y[cell == 1], np.ones(2), 4, 1))
    one = cart.grow(rows.where("y = 1"), {0: cart.Tree({0, 1, 2}, (1.0, 1.0), np.zeros(5))})[0]
    assert nested(one) == 1.0 and nested(cart.grow(rows.limit(0), {0: cart.Tree({0}, (1.0, 1.0), np.zeros(5))})[0]) == 0.0


def test_trees_beyond_the_window_bound(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, cell = rng.normal(size=(300, 2)).round(2), rng.integers(0, 2, 300)
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    rows = spark.createDataFrame([(int(cell[i]), x[i].tolist(), int(y[i])) for i in range(300)], "cell long, x array<double>, y int").cache()
    grow = lambda: nested(cart.grow(rows, {0: cart.Tree({0, 1}, (1.0, 2.0), np.zeros(2))}, min_leaf=5)[0])
    want = grow()
    monkeypatch.setattr(cart, "WINDOW_VALUES", 10)
    assert same_tree(grow(), want) and isinstance(want, tuple)


def test_prediction_table_equals_single_fits(spark, responses):
    table = C.prediction_table(responses, CLASSIFICATION_FEATURES, ["logistic_regression_balanced", "decision_tree_balanced", "dummy_most_frequent"]).cache()
    for fold in (-1, 2):
        train = responses.where(~F.col("is_test")) if fold == -1 else responses.where(F.col("fold") != fold)
        test = responses.where("is_test") if fold == -1 else responses.where(F.col("fold") == fold)
        pre = prep.fit_by_dtype(train, CLASSIFICATION_FEATURES)
        tr, te = pre.transform(train, keep=["ID", C.LABEL]), pre.transform(test, keep=["ID", C.LABEL])
        for name in ("logistic_regression_balanced", "decision_tree_balanced", "dummy_most_frequent"):
            want = {r["ID"]: (r["prediction"], r["score"]) for r in C.fit_predict(name, tr, te).collect()}
            got = {r["ID"]: (r["prediction"], r["score"]) for r in table.where((F.col("model") == name) & (F.col("fold") == fold)).collect()}
            assert got.keys() == want.keys()
            assert all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], abs=1e-8) for i in got)


def test_holdout_alone_equals_the_holdout_of_all_splits(spark, responses):
    names = ["knn_k15", "logistic_regression", "decision_tree_balanced", "dummy_most_frequent"]
    rows = lambda table: sorted((r["model"], r["ID"], r["label"], r["prediction"], round(r["score"], 9)) for r in table.collect())
    alone = C.prediction_table(responses, CLASSIFICATION_FEATURES, names, folds=(-1,))
    assert {r["fold"] for r in alone.select("fold").distinct().collect()} == {-1}
    assert rows(alone) == rows(C.prediction_table(responses, CLASSIFICATION_FEATURES, names).where("fold = -1"))


def test_holdout_queries_fit_no_folds(spark, monkeypatch):
    from marketlens.plans import q_classify, registry
    registry.forget_results()
    asked = []
    table = C.prediction_table
    monkeypatch.setattr(C, "prediction_table", lambda *a, **k: asked.append(k.get("folds")) or table(*a, **k))
    alone = sorted(map(tuple, registry.REGISTRY["confusion_matrices"].fn(spark, SF_SMALL).collect()))
    assert asked == [(-1,)]
    q_classify.all_predictions(spark, SF_SMALL)
    assert sorted(map(tuple, registry.REGISTRY["confusion_matrices"].fn(spark, SF_SMALL).collect())) == alone and asked == [(-1,), None]


def test_any_classifier_by_mapping(spark, responses):
    def coin(train, test, label):
        return test.select("ID", label, F.lit(1).alias("prediction"), F.lit(0.75).alias("score"))
    models = {"mine": "logistic_regression", "estimator": LogisticRegression(regParam=1e-4), "coin": coin}
    table = C.prediction_table(responses, CLASSIFICATION_FEATURES, models).cache()
    assert {(r["model"], r["fold"]) for r in table.select("model", "fold").distinct().collect()} == {(m, f) for m in models for f in range(-1, 5)}
    ranked = C.ranked_models(C.compare_classifiers(table)).collect()
    assert {r["model"] for r in ranked} == set(models) and {r["test_roc_auc"] for r in ranked if r["model"] == "coin"} == {0.5}
    with pytest.raises(ValueError, match="registered"):
        C.prediction_table(responses, CLASSIFICATION_FEATURES, ["unheard of"])


# many starts of K-Means

def blobs(spark, parts=4):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.4, size=(60, 3)) for c in (-3, 0, 3, 8)]) + 50
    return x, spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))], "ID long, f array<double>").select("ID", array_to_vector("f").alias("features")).repartition(parts)


def test_starts_advance_together(spark):
    x, df = blobs(spark)
    many, jobs = jobs_of(spark, lambda: kmeans.fit_many(df, range(2, 6), n_init=5))
    most = max(m.iterations for m in many.models.values())
    assert jobs <= 6 + 2 * 2 * 5 + 2 * 40 and most < 40
    for k, m in many.models.items():
        far = ((x[:, None] - m.centres[None]) ** 2).sum(axis=2)
        at = far.argmin(axis=1)
        assert m.cost == pytest.approx(far.min(axis=1).sum(), rel=1e-9)
        assert np.abs(np.array([x[at == c].mean(axis=0) for c in range(k)]) - m.centres).max() < 0.05
        got = {r["ID"]: r["Cluster"] for r in m.transform(df).collect()}
        assert [got[i] for i in range(len(x))] == at.tolist()
    truth = sum(((x[i:i + 60] - x[i:i + 60].mean(axis=0)) ** 2).sum() for i in range(0, 240, 60))
    assert many.models[4].cost == pytest.approx(truth, rel=1e-9)
    for k, score in many.silhouettes().items():
        assert score == pytest.approx(G.silhouette_sq(many.models[k].transform(df), "features").first()[0], abs=1e-9)


def test_seeding_does_not_depend_on_partitions(spark):
    runs = []
    for parts in (1, 7):
        _, df = blobs(spark, parts)
        rows = kmeans.stored_vectors(df)
        runs.append(kmeans.seed_centres(rows, [(3, 1), (4, 9)], np.full(3, 50.0)))
    assert all(np.allclose(runs[0][s], runs[1][s]) for s in runs[0]) and len(np.unique(runs[0][4, 9], axis=0)) == 4


def test_draws_follow_the_squared_distance(spark):
    df = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([0.0] * 10 + [1.0] * 10 + [3.0] * 10)], "ID long, features array<double>")
    rows = kmeans.stored_vectors(df)
    starts = {(2, s): np.array([[0.0]]) for s in range(600)}
    drawn = kmeans._draw(rows, starts, dict.fromkeys(starts, 1), 1, np.zeros(1))
    share = np.mean([drawn[s, 0][0] == 3.0 for s in starts])
    assert abs(share - 0.9) < 0.05 and not any(drawn[s, 0][0] == 0.0 for s in starts)


def test_vectors_are_stored_as_blocks_dealt_to_the_cores(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "BLOCK_ROWS", 16)
    x, df = blobs(spark, 1)  # one partition, as of a file with one row group
    rows = kmeans.stored_vectors(df)
    cores = spark.sparkContext.defaultParallelism
    held = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert rows.rdd.getNumPartitions() == cores and sum(r["n"] for r in held) == len(x) // 16 and len(held) > 1
    n, mean, variance = kmeans._moments(rows)
    assert n == len(x) and np.allclose(mean, x.mean(axis=0), rtol=1e-14) and np.allclose(variance, x.var(axis=0), rtol=1e-12)
    monkeypatch.setattr(kmeans, "_CELLS", 100)  # several parts of a block
    starts = {(2, 1): x[[0, 70]], (3, 4): x[[5, 100, 200]], (2, 0): x[[130, 239]]}
    got = kmeans._advance(rows, starts, mean)
    cost = kmeans._potentials(rows, starts, {(s, t): x[20 * t + 7] for s in starts for t in (0, 1)}, mean)
    for s, c in starts.items():
        far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        at, moved = far.argmin(axis=1), x - mean
        assert got[s][1].tolist() == np.bincount(at, minlength=len(c)).tolist() and got[s][2] == pytest.approx(far.min(axis=1).sum())
        for i in range(len(c)):
            assert np.allclose(got[s][0][i], moved[at == i].sum(axis=0)) and got[s][3][i] == pytest.approx((moved[at == i] ** 2).sum())
        for t in (0, 1):
            assert cost[s, t] == pytest.approx(np.minimum(far.min(axis=1), ((x - x[20 * t + 7]) ** 2).sum(axis=1)).sum())
    with pytest.raises(Exception, match="differ in length"):
        kmeans.stored_vectors(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0, 3.0])], "ID long, features array<double>").coalesce(1))


def test_fewer_distinct_rows_than_clusters(spark):
    df = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(20)], "ID long, features array<double>")
    model = G.fit_kmeans(df, 4, n_init=2)
    assert model.cost == pytest.approx(0.0, abs=1e-12) and model.centres.shape == (4, 2) and model.transform(df).select("Cluster").distinct().count() == 2
    with pytest.raises(ValueError, match="no vectors"):
        G.fit_kmeans(df.limit(0), 2)
