"""Distributed operators against brute force on small inputs (NumPy / pandas)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from conftest import SF_SMALL
from marketlens.functions.quantiles import exact_quantiles, quantiles_by_group
from marketlens.functions.ranking import sum_before
from marketlens.operators import classify as C, knn, segment as G, split as S
from marketlens.operators.linreg import fit_least_squares


def _embeddings(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("ID"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
                    "label")


def test_knn_equals_brute_force_on_embeddings(spark):
    e = _embeddings(spark)
    train = e.filter(F.col("ID") % 4 != 0)
    test = e.filter(F.col("ID") % 4 == 0)
    got = knn.knn_neighbours(train, test, k=7).toPandas()
    tr, te = train.toPandas(), test.toPandas()
    tv, qv = np.stack(tr["vec"]), np.stack(te["vec"])
    for i, qid in enumerate(te["ID"]):
        d2 = ((tv - qv[i]) ** 2).sum(axis=1)
        order = np.lexsort((tr["ID"].to_numpy(), d2))[:7]
        want = list(tr["ID"].to_numpy()[order])
        have = list(got[got.qid == qid].sort_values("rank")["tid"])
        assert have == want


def test_silhouette_and_inertia_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    lab = rng.integers(0, 3, size=60)
    lab[0] = 3  # a singleton cluster scores 0
    df = spark.createDataFrame([(i, x[i].tolist(), int(lab[i])) for i in range(60)], "ID long, f array<double>, Cluster int")
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    s = []
    for i in range(60):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d2[i, own].sum() / (own.sum() - 1)
        b = min(d2[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    assert G.silhouette_sq(df, "f").first()[0] == pytest.approx(np.mean(s), abs=1e-9)
    inert = sum(((x[lab == c] - x[lab == c].mean(0)) ** 2).sum() for c in set(lab))
    assert G.inertia(df, "f").first()[0] == pytest.approx(inert, abs=1e-9)


def test_auc_equals_pairwise_definition(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300)
    sc = np.round(rng.random(300), 1)  # many ties
    pred = spark.createDataFrame([("m", 0, int(a), float(b)) for a, b in zip(y, sc)],
                                 "model string, fold int, label int, score double").repartition(7)
    pos, neg = sc[y == 1], sc[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert C.roc_auc(pred).first()["roc_auc"] == pytest.approx(want, abs=1e-12)


def test_sum_before_matches_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 200), "o": rng.permutation(200), "v": rng.integers(0, 5, 200)})
    got = sum_before(spark.createDataFrame(pdf), ["g"], "o", ["v"], n_parts=5).toPandas()
    pdf = pdf.sort_values(["g", "o"])
    pdf["want"] = pdf.groupby("g")["v"].cumsum() - pdf["v"]
    m = got.merge(pdf, on=["g", "o"])
    assert (m["v_before"] == m["want"]).all()


def test_split_partition_invariant_and_exact(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("ID"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    a = S.split_flag(df.repartition(1), strata=["y"]).toPandas().sort_values("ID")
    b = S.split_flag(df.repartition(16), strata=["y"]).toPandas().sort_values("ID")
    assert (a["is_test"].to_numpy() == b["is_test"].to_numpy()).all()
    counts = a.groupby("y")["is_test"].sum().to_dict()
    assert counts == {0: int(np.ceil(0.2 * 667)), 1: int(np.ceil(0.2 * 333))}
    f = S.fold_column(df, strata=["y"]).toPandas()
    assert set(f["fold"]) == {0, 1, 2, 3, 4}
    sizes = f.groupby(["y", "fold"]).size()
    assert (sizes.groupby(level=0).max() - sizes.groupby(level=0).min()).max() <= 1


def test_ntile_labels_match_sql_ntile(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"ID": np.arange(103), "TotalSpending": rng.integers(0, 5, 103)})
    got = G.ntile_labels(spark.createDataFrame(pdf), 4).toPandas().set_index("ID")["Cluster"]
    order = pdf.sort_values(["TotalSpending", "ID"])["ID"].to_numpy()
    sizes = [26, 26, 26, 25]
    want = {}
    pos = 0
    for t, n in enumerate(sizes):
        for i in order[pos:pos + n]:
            want[i] = t
        pos += n
    assert all(got[i] == want[i] for i in want)


def test_gramian_ols_min_norm(spark):
    rng = np.random.default_rng(0)
    n, p = 300, 4
    x = rng.normal(size=(n, p))
    x[:, 3] = x[:, 0] + x[:, 1]  # collinear
    y = x @ rng.normal(size=(p, 2)) + 1.5
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i, 0]), float(y[i, 1])) for i in range(n)],
                               "ID long, f array<double>, a double, b double").repartition(3)
    m = fit_least_squares(df, "f", ["a", "b"])
    ref, *_ = np.linalg.lstsq(x - x.mean(0), y - y.mean(0), rcond=None)
    assert np.abs(m.coef - ref).max() < 1e-9
    pred = m.predict(df).toPandas().sort_values("ID")[["a", "b"]].to_numpy()
    assert np.abs(pred - y).max() < 1e-9


def test_knn_fits_a_bounded_number_of_rows(spark):
    """The rows that come first in hash order are the model, the others have no influence."""
    e = _embeddings(spark)
    train, test = e.filter(F.col("ID") % 4 != 0), e.filter(F.col("ID") % 4 == 0)
    model = knn.fitted_rows(train, max_train_rows=20)
    assert model.count() == 20
    got = knn.knn_neighbours(train, test, k=5, max_train_rows=20)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, knn.knn_neighbours(model, test, k=5).collect()))


def test_knn_rows_to_fit_are_cut_before_they_reach_the_driver(spark):
    """Same rows as a sorted limit (null and repeated keys included), without as many rows from every task."""
    keys = [None, None, *range(-40, 260), *[77] * 30]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "ID long, n int").repartition(6)
    for n in (0, 1, 2, 3, 50, 150, 200, 250, len(keys) - 1, len(keys), len(keys) + 5):
        want = df.orderBy(S.key_hash("ID", knn.PICK_SEED), "ID").limit(n)
        got = knn.fitted_rows(df, max_train_rows=n)
        count = lambda rows: sorted(((r["ID"] is not None, r["ID"]) for r in rows.collect()), key=str)
        assert count(got) == count(want) and got.columns == df.columns, n
        assert "TakeOrderedAndProject" not in got._jdf.queryExecution().executedPlan().toString()
    few = knn.fitted_rows(spark.range(5000).select(F.col("id").alias("ID")), max_train_rows=700)
    assert few.rdd.getNumPartitions() > 1 and few.count() == 700


def test_knn_bound_by_groups_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    t, q = rng.integers(0, 4, (700, 3)).astype(float), rng.integers(0, 4, (40, 3)).astype(float)  # many ties
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ID long, vec array<double>")
    got = {(r["qid"], r["rank"]): (r["tid"], r["d2"]) for r in knn.knn_neighbours(frame(t), frame(q), k=15).collect()}
    d2 = ((q[:, None] - t[None]) ** 2).sum(axis=2)
    assert got == {(i, j + 1): (int(c), d2[i, c]) for i in range(40) for j, c in enumerate(np.lexsort((np.arange(700), d2[i]))[:15])}


def test_knn_shuffles_nothing(spark):
    e = _embeddings(spark)
    plan = knn.knn_classify(e, e, k=3, label="label")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def _brute_votes(t, ids, y, q, k):
    d2 = ((q[:, None] - t[None]) ** 2).sum(axis=2)
    return [float(y[np.lexsort((ids, far))[:k]].mean()) for far in d2]


def test_knn_votes_of_all_rows_beyond_the_broadcast(spark, monkeypatch):
    """More labelled rows than are broadcast: all of them vote; ties, repeated and null keys, and null kept values included."""
    for name, size in (("TRAIN_BLOCK", 3000), ("QUERY_BLOCK", 16), ("TRAIN_PART", 9000), ("QUERY_PART", 64)):
        monkeypatch.setattr(knn, name, size, raising=False)
    rng = np.random.default_rng(4)
    n = knn.MAX_TRAIN_ROWS + 2500
    t, q = rng.integers(0, 12, (n, 4)).astype(float), rng.integers(0, 12, (90, 4)).astype(float)
    ids, y = rng.permutation(n), rng.integers(0, 2, n)
    keys = [None, 7, 7, *range(100, 187)]
    train = spark.createDataFrame(pd.DataFrame({"ID": ids, "vec": list(t), "label": y}))
    test = spark.createDataFrame([(k, v.tolist(), None if i % 5 == 0 else f"n{i}") for i, (k, v) in enumerate(zip(keys, q))], "ID long, vec array<double>, note string")
    got = knn.knn_classify(train, test, k=5, keep=("note",))
    assert got.columns == ["ID", "note", "score", "prediction"]
    want = [(k, None if i % 5 == 0 else f"n{i}", s, int(s > 0.5)) for i, (k, s) in enumerate(zip(keys, _brute_votes(t, ids, y, q, 5)))]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    vectors = train.select("ID", array_to_vector("vec").alias("features"), "label")
    told = {r["ID"]: r["score"] for r in C.predict_knn(vectors, vectors.where("ID < 60"), k=3).collect()}
    some = np.flatnonzero(ids < 60)
    assert told == dict(zip(ids[some].tolist(), _brute_votes(t, ids, y, t[some], 3)))


@pytest.mark.parametrize("scale, shift", [(1.0, 1e6), (1e-18, 0.0), (1e18, 0.0)])
def test_knn_blocks_keep_exact_distances(spark, monkeypatch, scale, shift):
    monkeypatch.setattr(knn, "MAX_TRAIN_ROWS", 100)
    for name, size in (("TRAIN_BLOCK", 64), ("QUERY_BLOCK", 16), ("TRAIN_PART", 200)):
        monkeypatch.setattr(knn, name, size, raising=False)
    rng = np.random.default_rng(8)
    t, q = rng.normal(size=(500, 6)) * scale + shift, rng.normal(size=(40, 6)) * scale + shift
    t[:20, 0] += 1000 * scale  # far rows
    y = rng.integers(0, 2, 500)
    frame = lambda x: spark.createDataFrame([(i, v.tolist(), int(y[i])) for i, v in enumerate(x)], "ID long, vec array<double>, label int").repartition(3)
    got = {r["ID"]: r["score"] for r in knn.knn_classify(frame(t), frame(q), k=15, max_train_rows=None).collect()}
    assert got == dict(enumerate(_brute_votes(t, np.arange(500), y, q, 15)))


def test_knn_blocks_equal_the_broadcast_rows(spark, monkeypatch):
    """The bound of the first block comes from sums in another order than the distances: no neighbour at the bound may be lost."""
    rng = np.random.default_rng(6)
    turn = rng.normal(size=(4, 38))  # few axes tell the order, so that the bound is the farthest neighbour itself
    frame = lambda n: spark.createDataFrame([(i, (rng.normal(size=4) @ turn).tolist(), int(rng.random() < 0.4)) for i in range(n)], "ID long, vec array<double>, label int")
    train, test = frame(400).coalesce(1).cache(), frame(300).cache()
    rows = lambda df: sorted((r["ID"], round(r["score"], 12), r["prediction"]) for r in df.collect())
    want = rows(knn.knn_classify(train, test, 15))
    monkeypatch.setattr(knn, "MAX_TRAIN_ROWS", 100)
    assert rows(knn.knn_classify(train, test, 15)) == want
    monkeypatch.setattr(knn, "PART_NUMBERS", 38 * 100)
    assert rows(knn.knn_classify(train, test, 15)) == want


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    x = [None if v > 90 else float(v) for v in rng.integers(0, 100, 333)]
    df = spark.createDataFrame([(a, float(i), None) for i, a in enumerate(x)], "a double, b double, c double")
    got = exact_quantiles(df, ["a", "b", "c"], (0.25, 0.5, 0.9))
    assert np.allclose(got["a"], np.quantile([v for v in x if v is not None], [0.25, 0.5, 0.9]))
    assert np.allclose(got["b"], np.quantile(range(333), [0.25, 0.5, 0.9])) and got["c"] == [None] * 3
    plan = sum_before(df.groupBy("a").agg(F.count("*").alias("n")), [], "a", ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan


def test_latest_enrolment_year_rules_the_classification_age(spark):
    """In a table whose latest enrolment is not 2001 the two tracks differ."""
    from marketlens.operators import features as P
    rows = spark.createDataFrame([(1, 1960, "05-03-1999"), (2, 1970, "1-1-1997"), (3, 1980, "31-13-2000")], "ID long, Year_Birth int, Dt_Customer string")
    dated = P.parse_enrollment_date(rows)
    assert {r.ID: r.Age for r in P.customer_age(dated, "max").collect()} == {1: 39, 2: 29, 3: 19}
    assert {r.ID: r.Age for r in P.customer_age(dated).collect()} == {1: 41, 2: 31, 3: 21}


def test_knn_with_many_identical_rows(spark):
    """A third of the training rows are the same customer vector: ties go to the smaller key."""
    rng = np.random.default_rng(9)
    n = 300
    x = rng.normal(size=(n, 4))
    x[: n // 3] = 0.25  # hot cell: identical rows
    q = rng.normal(size=(40, 4)) * 0.3
    train = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "ID long, vec array<double>")
    test = spark.createDataFrame([(1000 + i, q[i].tolist()) for i in range(len(q))], "ID long, vec array<double>")
    got = knn.knn_neighbours(train, test, k=15).toPandas()
    ids = np.arange(n)
    for i in range(len(q)):
        d2 = ((x - q[i]) ** 2).sum(axis=1)
        want = list(ids[np.lexsort((ids, d2))][:15])
        have = list(got[got.qid == 1000 + i].sort_values("rank")["tid"])
        assert have == want


def test_profile_partition_invariant(spark):
    from marketlens.sources.profile import customer_profile
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = customer_profile(spark, SF_SMALL).toPandas().sort_values("ID").reset_index(drop=True)
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        b = customer_profile(spark, SF_SMALL).toPandas().sort_values("ID").reset_index(drop=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    pd.testing.assert_frame_equal(a, b)


def test_split_and_folds_equal_separate_calls(spark):
    df = spark.range(1, 501).select(F.col("id").alias("ID"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    both = S.split_and_folds(df, strata=["y"]).toPandas().sort_values("ID").reset_index(drop=True)
    sep = S.fold_column(S.split_flag(df, strata=["y"]), strata=["y"]).toPandas().sort_values("ID").reset_index(drop=True)
    pd.testing.assert_frame_equal(both[["ID", "y", "is_test", "fold"]], sep[["ID", "y", "is_test", "fold"]])


def test_poly2_numpy_matches_spark_polynomial_expansion(spark):
    from pyspark.ml.feature import PolynomialExpansion
    from pyspark.ml.linalg import Vectors
    from marketlens.operators.linreg import poly2_numpy
    x = np.array([[1.5, -2.0, 3.0]])
    df = spark.createDataFrame([(Vectors.dense(x[0].tolist()),)], ["v"])
    ml = PolynomialExpansion(degree=2, inputCol="v", outputCol="p").transform(df).first()["p"].toArray()
    assert np.allclose(poly2_numpy(x)[0], ml)
