"""Fitted objects saved and loaded, also in another process; result sets published at once; lookups."""

import os
import subprocess
import sys

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from marketlens.operators import knn, prep, recommend as R, recommender as M, saved
from marketlens.plans.q_classify import cls_data
from marketlens.plans.q_prepare import profile, reg_prepared
from marketlens.schema import CLASSIFICATION_FEATURES, STAGE_FEATURE_SETS, numeric_and_categorical
from marketlens.session import materialize
from marketlens.sources import files, results
from marketlens.streaming.scoring import start_scoring_stream

from conftest import SF_SMALL


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def prepared(spark):
    return materialize(reg_prepared(spark, SF_SMALL))


@pytest.fixture(scope="module")
def run(prepared):
    sets = {s: STAGE_FEATURE_SETS[s] for s in ("New-user", "Existing-customer")}
    return M.compare_recommenders(prepared, sets, {**M.REGRESSORS, "estimator": LinearRegression(regParam=0.01)})


def test_preprocessor_in_a_pipeline(spark):
    data = materialize(cls_data(spark, SF_SMALL))
    numeric, categorical = numeric_and_categorical(data, CLASSIFICATION_FEATURES)
    pipeline = Pipeline(stages=[saved.TablePreprocessor(numeric=numeric, categorical=categorical), LogisticRegression(labelCol="label", maxIter=5)])
    path = files.scratch_path(spark, "pipeline")
    pipeline.save(path + "-unfitted")
    model = Pipeline.load(path + "-unfitted").fit(data)
    model.write().save(path)
    again = PipelineModel.load(path)
    pick = lambda m: rows_of(m.transform(data).select("ID", "features", "probability"))
    assert pick(again) == pick(model)
    direct = prep.fit_by_dtype(data, CLASSIFICATION_FEATURES)
    assert vars(again.stages[0].fitted) == vars(direct)
    assert rows_of(again.stages[0].transform(data).select("ID", "features")) == rows_of(direct.transform(data))


@pytest.mark.parametrize("key", [("Existing-customer", M.POLY), ("New-user", "estimator")])
def test_recommender_models(spark, run, key):
    path = files.scratch_path(spark, "recommender")
    saved.ShareRecommenderModel.of(run.models[key], run.prior, run.fill_status).write().save(path)
    customers = profile(spark, SF_SMALL)
    want = rows_of(M.score_customers(customers, run, key))
    assert len(want) > 100 and rows_of(saved.ShareRecommenderModel.load(path).transform(customers)) == want


def test_estimator_equals_the_fit(spark, prepared):
    model = saved.ShareRecommender(stage="New-user").fit(prepared)
    train = M.prepared_targets(prepared).filter(~F.col("is_test"))
    direct = M.fit_stage_model(train, "New-user", STAGE_FEATURE_SETS["New-user"], M.LINEAR)
    assert abs(model.stage_model().linear.coef - direct.linear.coef).max() < 1e-9
    with pytest.raises(ValueError, match="cannot be saved"):
        saved.ShareRecommenderModel.of(M.StageModel("s", "m", [], direct.pre, object()), R.fitted_prior(train), None)


def test_neighbours(spark):
    data = materialize(cls_data(spark, SF_SMALL))
    vectors = prep.fit_by_dtype(data, CLASSIFICATION_FEATURES).transform(data, keep=["ID", "label"])
    model = saved.NearestNeighbours(k=7, maxRows=100).fit(vectors)
    path = files.scratch_path(spark, "neighbours")
    model.write().save(path)
    again = saved.NearestNeighboursModel.load(path)
    arrays = vectors.select("ID", "label", vector_to_array("features").alias("vec"))
    want = rows_of(knn.knn_classify(arrays, arrays, 7, max_train_rows=100).select("ID", "score", "prediction"))
    assert rows_of(again.transform(vectors).select("ID", "score", "prediction")) == want
    assert again.rows.count() == 100


def test_run_scores_the_same_in_a_new_process_and_a_stream(spark, run, tmp_path):
    folder = saved.save_run(run, str(tmp_path / "run"))
    again = saved.load_run(spark, folder)
    assert again.final_key == run.final_key and set(again.models) == set(run.models) and again.fill_status == run.fill_status
    assert rows_of(again.summary) == rows_of(run.summary) and again.summary.columns == run.summary.columns and rows_of(again.baseline) == rows_of(run.baseline)
    customers = str(tmp_path / "in")
    profile(spark, SF_SMALL).repartition(2).write.parquet(customers)
    want = rows_of(M.score_customers(spark.read.parquet(customers), run))
    code = ("import sys; from marketlens.session import get_spark; from marketlens.operators import recommender as M, saved; s = get_spark('local[2]', 2); "
            "M.score_customers(s.read.parquet(sys.argv[2]), saved.load_run(s, sys.argv[1])).write.parquet(sys.argv[3])")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code, folder, customers, str(tmp_path / "out")], check=True, env=os.environ | {"PYTHONPATH": root}, timeout=300, capture_output=True)
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == want
    stream = start_scoring_stream(spark, customers, folder, str(tmp_path / "sink"), str(tmp_path / "ckpt"))
    stream.awaitTermination()
    assert rows_of(spark.read.parquet(str(tmp_path / "sink")).drop("epoch")) == want


def test_unfinished_runs_cannot_be_loaded(spark, run, tmp_path):
    folder = str(tmp_path / "half")
    saved.ShareRecommenderModel.of(run.models[run.final_key], run.prior, None).write().save(f"{folder}/models/0")
    with pytest.raises(Exception):
        saved.load_run(spark, folder)


# result sets

def small(spark, n, mark):
    return spark.range(n).select(F.col("id").alias("ID"), F.lit(mark).alias("mark"), (F.col("id") / 3).alias("x"), F.lit(None).cast("string").alias("none"))


def test_all_tables_appear_at_once(spark, tmp_path):
    folder = str(tmp_path)
    assert results.versions(spark, folder) == {}
    with pytest.raises(FileNotFoundError):
        results.read_result(spark, folder, "a")
    tables = lambda mark: {"a": small(spark, 5, mark), "b": results.Table(small(spark, 3, mark), "csv"), "c": results.Table(small(spark, 4, mark), "json")}
    first = results.publish(spark, folder, tables("one"))

    broken = tables("two") | {"z": results.Table(spark.range(4).select(F.expr("cast(raise_error('lost') as int)").alias("x")))}
    with pytest.raises(Exception, match="lost"):
        results.publish(spark, folder, broken)
    assert list(results.versions(spark, folder)) == [first]  # half a version is none
    for name, n in (("a", 5), ("b", 3), ("c", 4)):
        got = results.read_result(spark, folder, name)
        assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("ID", "bigint"), ("mark", "string"), ("x", "double"), ("none", "string")]
        assert rows_of(got) == rows_of(small(spark, n, "one"))
    second = results.publish(spark, folder, tables("three"))
    assert results.read_result(spark, folder, "a").first()["mark"] == "three" and results.read_result(spark, folder, "a", first).first()["mark"] == "one"
    assert results.drop_versions(spark, folder) == [first] and list(results.versions(spark, folder)) == [second]
    with pytest.raises(ValueError, match="format"):
        results.publish(spark, folder, {"a": results.Table(small(spark, 1, "x"), "xml")})
    with pytest.raises(ValueError, match="clustered"):
        results.publish(spark, folder, {"a": results.Table(small(spark, 1, "x"), "csv", "ID")})


def scan_rows(df):
    """Rows that the scan of an executed frame read."""
    df.collect()
    plan, found = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            plan.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().get("numOutputRows").get().value())
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    return sum(found)


def test_lookup_reads_one_row_group(spark, tmp_path):
    n = 200_000
    table = spark.range(n).select(F.xxhash64("id").alias("ID"), *[F.rand(i).alias(f"x{i}") for i in range(6)]).repartition(6)
    path = str(tmp_path / "by_key")
    results.clustered(table, "ID", path, row_group_bytes=1 << 18, n_parts=4)
    for wanted in (5, 77_777):
        key = spark.range(1).select(F.xxhash64(F.lit(wanted).cast("long"))).first()[0]
        one = spark.read.parquet(path).where(F.col("ID") == F.lit(key))
        assert scan_rows(one) < n / 20 and one.count() == 1
        assert "PushedFilters: [IsNotNull(ID), EqualTo(ID" in one._jdf.queryExecution().executedPlan().toString()
    folder = str(tmp_path / "set")
    results.publish(spark, folder, {"scores": results.Table(table.limit(1000), key="ID"), "plain": table.limit(3)})
    some = results.read_result(spark, folder, "scores").first()["ID"]
    assert results.lookup(spark, folder, "scores", some).count() == 1
    with pytest.raises(ValueError, match="not clustered"):
        results.lookup(spark, folder, "plain", some)
