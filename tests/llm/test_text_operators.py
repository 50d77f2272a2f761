"""Packing, BPE, secrets, quality and toxicity against plain Python."""

import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from marketlens.llm import bpe_prefix, packing, quality, queries, secret_ledger, toxicity
from marketlens.llm.common import new_folder, read_table
from marketlens.plans.verify import compare

from conftest import SF_SMALL

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, bucket int, blob string, host string, id string"


def frame(spark, texts, ids=None):
    """Documents with columns whose names clash with those that operators make."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "k", 7, "b", "h", "x") for i, t in zip(ids, texts)], SCHEMA)


# packing

def brute_padding(lengths, counts, k):
    best = None
    for n in range(1, min(k, len(lengths)) + 1):
        for cuts in itertools.combinations(range(1, len(lengths)), n - 1):
            ends = [*cuts, len(lengths)]
            cost, a = 0, 0
            for b in ends:
                cost += sum(c * (lengths[b - 1] - x) for x, c in zip(lengths[a:b], counts[a:b]))
                a = b
            best = cost if best is None else min(best, cost)
    return best


def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts))


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        counts = [rng.randint(1, 50) for _ in lengths]
        k = rng.randint(1, 5)
        ends = packing.best_boundaries(np.array(lengths), np.array(counts), k)
        assert len(ends) <= k and ends == sorted(ends) and ends[-1] == lengths[-1]
        assert padding(lengths, counts, ends) == brute_padding(lengths, counts, k)
    assert packing.best_boundaries(np.array([]), np.array([]), 4) == []


@pytest.mark.parametrize("cell_rows", [4096, 3])
def test_pack_places_every_word_once(spark, cell_rows):
    rng = random.Random(1)
    texts = [None, "", " \n", *[" ".join("w" for _ in range(rng.randint(1, 70))) for _ in range(60)], "w " * 333]
    docs = frame(spark, texts, [*range(len(texts) - 1), 500]).unionByName(frame(spark, ["a b c"], [4]))
    rows = packing.pack(packing.word_lengths(docs), n_buckets=4, max_len=64, budget=200, cell_rows=cell_rows).collect()
    words = sum(len((t or "").split()) for t in texts) + 3
    assert sum(r.n_tokens for r in rows) == words
    assert all(r.bucket is None and r.batch is None for r in rows if r.n_tokens == 0) and sum(r.n_tokens == 0 for r in rows) == 3
    long = sorted((r.chunk, r.start, r.n_tokens) for r in rows if r.doc_id == 500)
    assert long == [(c, 64 * c, min(64, 333 - 64 * c)) for c in range(6)]
    full = [r for r in rows if r.n_tokens]
    assert all(r.n_tokens <= r.bucket_len for r in full)
    assert len({(r.bucket, r.batch, r.slot) for r in full}) == len(full)
    for bucket in {r.bucket for r in full}:
        mine = [r for r in full if r.bucket == bucket]
        room = max(1, 200 // mine[0].bucket_len)
        assert sorted(r.batch * room + r.slot for r in mine) == list(range(len(mine)))  # batches are full but for the last


def test_pack_of_nothing(spark):
    assert packing.pack(packing.word_lengths(frame(spark, []))).count() == 0
    assert [r.bucket for r in packing.pack(packing.word_lengths(frame(spark, [""]))).collect()] == [None]


# byte-level BPE

@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_prefix.load_ranks(RANKS), special_tokens={})


def test_ids_equal_the_library(spark, library):
    rng = random.Random(2)
    letters = [chr(i) for i in range(32, 127)] + list("éßç漢字 \n\t") + ["\U0001f600", "\x00"]
    texts = [None, "", " ", "a" * 3000, "<|endoftext|>", *["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(200)]]
    rows = {r.doc_id: r for r in bpe_prefix.encode_texts(frame(spark, texts), RANKS, public_tokenizers.PATTERN, with_digests=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe_prefix.encode_texts(frame(spark, texts), RANKS, public_tokenizers.PATTERN)
    back = {r.doc_id: r.text for r in bpe_prefix.decode_texts(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_whole_documents_equal_the_library(spark, library):
    rows = {r.doc_id: r for r in queries.op10_bpe(spark, SF_SMALL).collect()}
    docs = read_table(spark, SF_SMALL, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text)
        assert rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_appends_and_edits_are_exact():
    bpe = bpe_prefix.PrefixBpe(bpe_prefix.load_ranks(RANKS))
    rng = random.Random(5)
    for _ in range(150):
        data = bytes(rng.choices(b"the quick brown fox ing tion", k=rng.randint(1, 400)))
        table = bpe.extend(data, [])
        a = rng.randint(0, len(data))
        b = min(len(data), a + rng.randint(0, 8))
        new = bytes(rng.choices(b"abc the", k=rng.randint(0, 6)))
        changed, again, read = bpe.replace(data, table, a, b, new)
        assert changed == data[:a] + new + data[b:] and again == bpe.extend(changed, [])
        assert read <= len(changed) - a
        longer, more = bpe.append(data, list(table), new)
        assert more == bpe.extend(longer, []) and more[:len(table)] == table
        assert bpe.decode(bpe.read_back(table)) == data
    big = b"the quick brown fox " * 500
    assert bpe.replace(big, bpe.extend(big, []), 100, 101, b"z")[2] < 1000  # near the edit only


def test_memory_of_cuts_may_overflow():
    codec = bpe_prefix.TextCodec(RANKS, public_tokenizers.PATTERN, cache_cuts=3)
    wide = bpe_prefix.TextCodec(RANKS, public_tokenizers.PATTERN)
    for text in ("one two three four five six", "two seven", "", "one two three four five six"):
        assert codec.ids(text) == wide.ids(text)


def test_bpe_of_nothing(spark):
    assert bpe_prefix.encode_texts(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


# secrets

BASE = [("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32)]


def brute_spans(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p, g, n) in enumerate(BASE) for m in p.finditer(text or "") if len(m[g]) >= n]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


TRICKY = [None, "", "x", "password=abcdefgh", "PassWord : 'abcdefgh9' token=short", "token=secret:abcdefgh", "token=secret:abcdefghij api_key=\"zzzzzzzzzz\"",
          "é漢\U0001f600 AKIA" + "A1" * 8 + " AKIAAKIA " + "AKIA" * 5, "0123456789abcdef" * 3 + "g" + "a" * 31, "apikey:" + "f" * 40, "SECRET=12345678" * 3,
          "pasſword=abcdefgh toKen=abcdefgh", "a" * 100_000 + " token=abcdefgh1", "passwd = = abcdefghi", "token=abcdefgh\ntoken=ijklmnop"]


def test_spans_equal_plain_search(spark):
    rng = random.Random(4)
    parts = ["token", "=", ":", " ", "'", '"', "abcdefgh", "AKIA", "Z9", "password", "0f", "é", "secret", "api_key", "deadbeef" * 4]
    texts = TRICKY + ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(150)]
    found = secret_ledger.scan(frame(spark, texts)).withColumn("s", secret_ledger.joined_spans(F.col("spans")))
    assert {r.doc_id: r.s for r in found.collect()} == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_oracle(spark, duck_small):
    res = compare(queries.op9_secrets(spark, SF_SMALL), duck_small, queries.ORACLE_SQL["op9_secrets"])
    assert res["columns_match"] and res["types_match"] and res["match"], res


def test_ledger_scans_only_what_is_new(spark):
    ledger = new_folder(spark, "ledger-test")
    first = frame(spark, ["token=abcdefgh", "token=abcdefgh", "clean"])
    secret_ledger.scan(first, ledger).count()
    assert spark.read.parquet(f"{ledger}/scanned").count() == 2  # equal texts are one blob
    more = frame(spark, ["token=abcdefgh", "new AKIA" + "B" * 14], [9, 10])
    rows = {r.doc_id: len(r.spans) for r in secret_ledger.scan(more, ledger).collect()}
    assert rows == {9: 1, 10: 1}
    assert spark.read.parquet(f"{ledger}/scanned").count() == 3 and spark.read.parquet(f"{ledger}/findings").count() == 2
    # a new revision of a rule scans known blobs by that rule only; a run that died after its findings repeats them harmlessly
    newer = (secret_ledger.Rule("assign", r"(token)=([a-z]+)", 2, 4, revision=2), *secret_ledger.BASE_RULES[1:])
    rows = {r.doc_id: len(r.spans) for r in secret_ledger.scan(first, ledger, newer).collect()}
    assert rows == {0: 1, 1: 1, 2: 0}
    spark.read.parquet(f"{ledger}/findings").write.mode("append").parquet(f"{ledger}/findings-again")
    spark.read.parquet(f"{ledger}/findings-again").write.mode("append").parquet(f"{ledger}/findings")
    assert {r.doc_id: len(r.spans) for r in secret_ledger.findings_by_path(first, ledger).collect()} == {0: 1, 1: 1, 2: 0}


def test_redaction(spark):
    texts = ["a token=abcdefgh b", None, "", "é" + "0123456789abcdef" * 2 + "! token=" + "ab" * 20, "clean"]
    rows = {r.doc_id: r for r in secret_ledger.redact(frame(spark, texts)).collect()}
    assert [rows[i].text for i in range(5)] == ["a [secret] b", None, "", "é[secret]! [secret]", "clean"]
    assert rows[0].blob == "b" and rows[0].keep == "k"
    assert secret_ledger.scan(frame(spark, [])).count() == 0


# quality

def test_quality_follows_the_labels(spark):
    docs, labels = read_table(spark, SF_SMALL, "documents"), read_table(spark, SF_SMALL, "labels")
    got = quality.score_quality(docs, labels)
    assert got.count() == docs.count()
    joined = got.join(labels, "doc_id").collect()
    assert np.mean([r.keep == bool(r.quality) for r in joined]) > 0.95
    assert all(0 <= r.posterior <= 1 and 0 <= r.path_mean <= 1 for r in joined)


def test_sites_shrink_towards_their_parents(spark):
    """A site of two documents stays near the corpus; one of hundreds of bad ones does not; own evidence is left out."""
    good, bad = "plain words that make a decent sentence of some length.", "||| $$$ ### !!! ||| 9999 ###"
    rows = [(i, good, "a", "good", 1) for i in range(300)] + [(1000 + i, bad, "a", "bad", 0) for i in range(300)] \
        + [(2000 + i, bad, "a", "tiny", 0) for i in range(2)] + [(3000, good, "a", "bad", 1), (3001, None, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality int")
    got = {r.doc_id: r for r in quality.score_quality(table, table.select("doc_id", "quality")).collect()}
    assert len(got) == 604
    assert got[1000].host_mean < 0.1 < got[2000].host_mean < 0.9 < got[0].host_mean
    assert got[3000].posterior < got[3000].p_document and got[0].posterior > 0.5 > got[1000].posterior


def test_quality_edge_cases(spark):
    docs = frame(spark, [None, "", "x", "x", "y" * 50_000], [0, 1, 2, 2, None])
    none = spark.createDataFrame([], "doc_id long, quality int")
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == 5  # no labels: neutral
    assert {r.keep for r in kept.collect()} == {"k"}  # the input's own column
    some = spark.createDataFrame([(0, 0), (0, 1), (1, None), (2, 1), (None, 1), (99, 0)], "doc_id long, quality int")
    assert quality.score_quality(docs, some).count() == 5
    assert quality.score_quality(frame(spark, []), some).count() == 0


def test_kept_texts_go_to_the_tasks_once(spark, monkeypatch):
    sent, send = [], quality.map_batches
    monkeypatch.setattr(quality, "map_batches", lambda df, run, schema: sent.append(df.schema.simpleString()) or send(df, run, schema))
    rows = [(1, None, "a b c", "s"), (2, 7, None, "s"), (3, 8, "", None), (3, 8, "é " * 5000, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text_size int, text string, source string").withColumn("lang", F.lit("x")).repartition(1)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted(map(str, quality.keep_good(docs, none).collect())) == sorted(map(str, docs.collect()))
    assert "__row" in sent[-1] and "__text" not in sent[-1] and "__text" in sent[0]
    # a text that is no string is cast, in a column of its own
    assert quality.keep_good(docs.withColumn("text", F.lit(5)), none).count() == 4 and "__text" in sent[-1]


def test_workers_give_back_what_arrow_holds(monkeypatch):
    import pyarrow as pa

    from marketlens.llm import common
    told, batch = [], pa.RecordBatch.from_pydict({"x": [1]})

    class Pool:
        def release_unused(self):
            told.append("released")

    class Frame:
        sparkSession = None

        def mapInArrow(self, run, schema):  # noqa: N802
            for _ in run(iter([batch, batch])):
                told.append("batch")

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    monkeypatch.setattr(common, "ship", lambda spark: None)
    common.map_batches(Frame(), lambda batches: (b for b in batches), "x long")
    assert told == ["batch", "batch", "released"]
    assert common.tidied(batch) is batch and told[3:] == ["released"]


def test_url_sites(spark):
    row = spark.createDataFrame([("HTTPS://Blog.X.org/en/1?p=2",), ("bad url",), (None,)], "u string").select(
        quality.url_host(F.col("u")).alias("h"), quality.url_path(F.col("u")).alias("p")).collect()
    assert (row[0].h, row[0].p) == ("blog.x.org", "en") and row[2].h == ""


# toxicity

def test_toxicity_on_held_out_rows(spark):
    got = queries.op3_toxicity(spark, "/root/testdata/sf0.01")
    labels = read_table(spark, "/root/testdata/sf0.01", "labels")
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == read_table(spark, "/root/testdata/sf0.01", "documents").count()
    out = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.85
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    flipped = labels.withColumn("toxic", F.when(toxicity.learnable(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    again = toxicity.score_toxicity(docs, flipped)  # labels of held-out rows have no influence
    a, b = ({r.doc_id: r.score for r in x.collect()} for x in (got, again))
    assert a == b


def test_toxicity_edge_cases(spark):
    docs = frame(spark, [None, "", "you idiot", "1d10t!", "i d i o t", "x", "x"], [0, 1, 2, 3, 4, 5, 5])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, none).collect()
    assert len(rows) == 7 and {r.score for r in rows} == {0.0}
    assert toxicity.score_toxicity(frame(spark, []), none).count() == 0
    import pyarrow as pa

    from marketlens.llm.common import text_buffer
    buf, offsets = text_buffer(pa.array(["you idiot", "1d10t!", "i d i o t", "", "plain"]))
    f = dict(zip(toxicity.FEATURES, toxicity.dense_features(buf, offsets, np.sort(toxicity._hash_words(toxicity.SEED_WORDS))).T))
    assert f["lexicon"].tolist() == [50, 0, 0, 0, 0] and f["near_second"][0] > 0
    assert f["hidden_lexicon"][1] > 0 and f["spelled_out"][2] > 0 and f["hidden_lexicon"][4] == 0
