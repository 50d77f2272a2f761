"""Names, hot keys and rows without ids; the posterior of the quality classifier in plain Python."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import common, packing, quality, secret_ledger, suffix_dedup
from marketlens.llm.common import lookup, read_table
from marketlens.llm.words import letter_table, white_space_table, word_hashes

from conftest import SF_SMALL


def hashes_of(words):
    data = " ".join(words).encode()
    return word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]), white_space_table())[0]


def test_no_family_of_words_collides():
    for n in (4, 6, 8, 10, 12):
        turn = [bin(i).count("1") % 2 for i in range(1 << n)]
        a, b = "".join("ab"[t] for t in turn), "".join("ba"[t] for t in turn)
        assert len(set(hashes_of([a, b, a + "a", b + "a", "a" * (1 << n), "a" * ((1 << n) + 1)]).tolist())) == 6
    rng = random.Random(1)
    words = list({"".join(rng.choice("ab") for _ in range(rng.randint(1, 200))) for _ in range(20_000)})
    got = hashes_of(words)
    assert len(set(got.tolist())) == len(words) and (hashes_of(words[::-1])[::-1] == got).all()


def test_stems_are_hashes_of_beginnings():
    data = b"abcdefgh abcde ab"
    whole, _, _, four = word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]), letter_table(), (4,))
    assert four[0] == four[1] == hashes_of(["abcd"])[0] and four[2] == whole[2] == hashes_of(["ab"])[0]


@pytest.mark.parametrize("hot", [3, 10_000])
def test_lookup_of_hot_and_null_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, f"x{i}"])) for i in range(300)]
    table = [("a", 1, [1]), ("b", 2, []), ("x5", 3, None), ("unused", 4, [])]
    df, t = spark.createDataFrame(rows, "id long, k string"), spark.createDataFrame(table, "k string, v int, w array<int>")
    known = {k: (v, w) for k, v, w in table}
    got = sorted((r["id"], r["k"], r["v"], r["w"]) for r in lookup(df, t, "k").collect())
    assert got == sorted((i, k, *known.get(k, (None, None))) for i, k in rows)
    assert lookup(df.limit(0), t, "k").count() == 0 and lookup(df, t.limit(0), "k").count() == 300


def test_hot_keys_do_not_move(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), "id")).alias("k")).repartition(4)
    t = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, v int")
    assert lookup(df, t, "k").agg(F.sum("v")).first()[0] == 1002
    big = common.written(df.groupBy("k").agg(F.count("*").alias("__n")).where("__n >= 10"), "probe")
    assert [r["k"] for r in big.collect()] == ["hot"]


def test_secrets_of_a_hot_blob(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    texts = ["token=abcdefgh12345 end"] * 40 + [""] * 30 + [None] * 20 + [f"password: secret{i:04d}x" for i in range(20)] + ["nothing"] * 9
    df = spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)], "doc_id long, text string, blob string")
    found = {r["doc_id"]: len(r["spans"]) for r in secret_ledger.scan(df).collect()}
    assert found == {i: int(bool(t) and t != "nothing") for i, t in enumerate(texts)}
    clean = {r["doc_id"]: r["text"] for r in secret_ledger.redact(df).collect()}
    assert len(clean) == len(texts) and not any("abcdefgh" in (t or "") or "secret0" in (t or "") for t in clean.values())
    assert [clean[i] for i in range(70, 90)] == [None] * 20


def test_packing_of_rows_without_ids(spark):
    rng = random.Random(2)
    rows = [(None if i % 3 else 7, rng.randint(1, 90)) for i in range(3000)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), n_buckets=3, budget=400, cell_rows=16).collect()
    assert len(packed) == 3000 and sorted(r["n_tokens"] for r in packed) == sorted(n for _, n in rows)
    places = {}
    for r in packed:
        room = max(1, 400 // r["bucket_len"])
        places.setdefault(r["bucket"], []).append(r["batch"] * room + r["slot"])
        assert r["slot"] < room and r["n_tokens"] <= r["bucket_len"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_repeats_of_rows_without_ids(spark):
    long = "This passage has more than fifty bytes and is in all of the texts here. "
    rows = [(None, long * 2)] * 30 + [(1, long), (2, "x " + long), (None, None)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0 and r["kept"] in (long * 2, "") and r["n_bytes"] == len(r["kept"])
    assert {r["doc_id"]: r["n_removed"] > 0 for r in got if r["doc_id"]} == {1: False, 2: True}


# quality

def test_posterior_in_plain_python(spark):
    docs, labels = read_table(spark, SF_SMALL, "documents"), read_table(spark, SF_SMALL, "labels")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 17 == 0, None).when(F.col("doc_id") % 17 == 1, "").otherwise(F.col("source")))
    features = common.written(quality.document_features(docs, "text", F.col("source"), F.col("lang"), ["doc_id"]), "f")
    model = quality.fit_quality(features, labels, "doc_id", "quality")
    raw = {r["doc_id"]: r["p"] for r in features.select("doc_id", (1 / (1 + F.exp(-model.log_odds))).alias("p")).collect()}
    site = {r["doc_id"]: (r["source"], r["lang"]) for r in docs.select("doc_id", "source", "lang").collect()}
    assert {None, ""} <= {s for s, _ in site.values()}
    by_host, by_path = {}, {}
    for i, (h, p) in site.items():
        by_host.setdefault(h, []).append(i)
        by_path.setdefault((h, p), []).append(i)
    mean = sum(raw.values()) / len(raw)
    assert model.mean == pytest.approx(mean)
    var = sum((p - mean) ** 2 for p in raw.values()) / len(raw)
    avg = lambda ids: sum(raw[i] for i in ids) / len(ids)
    n = len(raw)
    between = sum(len(ids) * (avg(ids) - mean) ** 2 for ids in by_host.values())
    assert model.host_strength == pytest.approx(quality.prior_strength(mean, len(by_host) - 1, n, sum(len(x) ** 2 for x in by_host.values()) / n, between, var))
    between = sum(len(ids) * (avg(ids) - avg(by_host[h])) ** 2 for (h, _), ids in by_path.items())
    squares = sum(len(ids) ** 2 / len(by_host[h]) for (h, _), ids in by_path.items())
    assert model.path_strength == pytest.approx(quality.prior_strength(mean, len(by_path) - len(by_host), n, squares, between, var))
    a, b = model.host_strength, model.path_strength
    for r in quality.score_quality(docs, labels).collect():
        i, p = r["doc_id"], raw[r["doc_id"]]
        h, key = site[i][0], site[i]
        host = (a * mean + sum(raw[j] for j in by_host[h]) - p) / (a + len(by_host[h]) - 1)
        path = (b * host + sum(raw[j] for j in by_path[key]) - p) / (b + len(by_path[key]) - 1)
        inside = min(max(path, 1e-6), 1 - 1e-6)
        odds = math.log(p / (1 - p)) + math.log(inside / (1 - inside)) - math.log(mean / (1 - mean))
        assert r["host"] == h and r["path"] == key[1] and r["p_document"] == pytest.approx(p)
        assert r["host_mean"] == pytest.approx(host) and r["path_mean"] == pytest.approx(path)
        assert r["posterior"] == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-9) and r["keep"] == (r["posterior"] >= 0.5)


def test_prior_strength_follows_the_spread():
    rng = np.random.default_rng(0)
    for truth in (4.0, 40.0):
        means = rng.beta(0.6 * truth, 0.4 * truth, 3000)
        hits = rng.binomial(50, means)
        total, mean = 50 * len(means), hits.sum() / (50 * len(means))
        between = (50 * (hits / 50 - mean) ** 2).sum()
        within = (hits / 50 * (1 - hits / 50)).sum() * 50 / (total - len(means))
        assert quality.prior_strength(mean, len(means) - 1, total, 50.0, between, within) == pytest.approx(truth, rel=0.2)
    assert quality.prior_strength(0.5, 10, 100, 10, 0.0, 0.25) == 1e6


def test_quality_of_documents_that_were_held_out(spark):
    sf = SF_SMALL.replace("0.001", "0.1")
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scored = quality.score_quality(docs, labels.where(~held)).join(labels.where(held).where("quality is not null").select("doc_id", "quality"), "doc_id")
    rows = [(r["posterior"], r["quality"]) for r in scored.collect()]
    good, bad = ([p for p, q in rows if q == x] for x in (1, 0))
    rank = np.argsort(np.argsort([p for p, _ in rows])) + 1
    auc = (rank[[q == 1 for _, q in rows]].sum() - len(good) * (len(good) + 1) / 2) / (len(good) * len(bad))
    accuracy = np.mean([(p >= 0.5) == (q == 1) for p, q in rows])
    assert len(rows) > 500 and zlib.crc32(b"0") >= 0
    print("held-out quality:", len(rows), round(float(auc), 4), round(float(accuracy), 4))
    assert auc > 0.9 and accuracy > 0.85


def test_written_tables_can_be_dropped(spark):
    one = common.written(spark.range(5).toDF("x"), "probe")
    folder = one.inputFiles()[0].rsplit("/", 1)[0]
    kept = common._FOLDERS.pop(spark.sparkContext.applicationId)
    common._FOLDERS[spark.sparkContext.applicationId] = kept[-1:]  # tables of other tests stay
    assert one.count() == 5 and common.drop_written(spark) == 1 and common.drop_written(spark) == 0
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    common._FOLDERS[spark.sparkContext.applicationId] = kept[:-1]


def test_larger_groups_get_longer_keys():
    from marketlens.llm import itq_dedup
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    mean, axes = itq_dedup.learn_rotation(x / np.linalg.norm(x, axis=1)[:, None])
    projected = itq_dedup.projections(x, mean, axes)
    sizes = [itq_dedup.key_bits(projected, itq_dedup.widest(0.98), group) for group in (10.0, 5e3, 1e6, 1e9)]
    assert sizes[0][0] >= sizes[-1][0] and sizes[-1][1] > 16 and [w for _, w in sizes] == sorted(w for _, w in sizes), sizes
