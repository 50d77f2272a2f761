"""N-gram join, suffix dedup, vector search and vector dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import itq_dedup, jaccard_trie, queries, rotated_bits, suffix_dedup, words
from marketlens.llm.common import read_table
from marketlens.llm.components import connected_components
from marketlens.llm.id_filter import may_hold

from conftest import SF_SMALL

SCHEMA = "doc_id long, text string, id string, sig string, n string, bucket string, kept string"


def frame(spark, rows):
    """Documents with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in rows], SCHEMA)


def union(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# components and helpers

def test_components(spark):
    rng = random.Random(0)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    edges = spark.createDataFrame([*pairs, (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    want = union(300, pairs)
    assert set(got) == {x for p in pairs for x in p} | {7}
    assert len({(got[x], want[x]) for x in got}) == len(set(got.values())) == len({want[x] for x in got})
    assert connected_components(edges.limit(0)).count() == 0


def test_id_filter_loses_nothing(spark):
    rows = spark.range(3000).withColumn("text", F.lit("t"))
    kept = may_hold(rows, "id", spark.range(0, 3000, 100)).collect()
    assert {r.id for r in kept} >= set(range(0, 3000, 100)) and len(kept) < 100


@pytest.mark.parametrize("pass_bytes", [1 << 21, 37])
def test_word_hashes(monkeypatch, pass_bytes):
    import pyarrow as pa

    from marketlens.llm.common import text_buffer
    monkeypatch.setattr(words, "PASS_BYTES", pass_bytes)
    monkeypatch.setattr(words, "_POWERS", {})
    rng = random.Random(3)
    texts = [None, "", " x\ty ", "É ß a", "a\x0bb\x0cc\rd", "A b C d a B c D"] + ["".join(rng.choices("abAB \n", k=rng.randint(0, 200))) for _ in range(300)]
    buf, offsets = text_buffer(pa.array(texts))
    hashes, _, first = words.word_hashes(buf, offsets, words.white_space_table())
    sets, names = words.shingle_sets(buf, offsets, 4), {}
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    for t, s, a, b in zip(texts, sets, first, first[1:]):
        found = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        assert len(found) == b - a
        assert all(names.setdefault(w, h) == h for w, h in zip(found, hashes[a:b]))
        assert len(s) == (len({tuple(found[i:i + 4]) for i in range(len(found) - 3)}) if len(found) >= 4 else min(1, len(found)))
    assert len(set(names.values())) == len(names)


def test_zero_byte_is_part_of_a_word():
    import pyarrow as pa

    from marketlens.llm.common import text_buffer
    texts = ["a\x00b c", "a\x00b", "aab", "aAb", "a b", "\x00", "\x00\x00 \x00"]
    hashes, lengths, first = words.word_hashes(*text_buffer(pa.array(texts)), words.white_space_table())
    found = [w.lower() for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert np.diff(first).tolist() == [2, 1, 1, 1, 2, 1, 2] and lengths.tolist() == list(map(len, found))
    assert len(set(zip(found, hashes.tolist()))) == len(set(found)) == len(set(hashes.tolist()))


# n-gram Jaccard join

def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    group = union(len(rows), pairs)
    least = {}
    for i, g in enumerate(group):
        if rows[i][0] is not None:
            least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), least[g]) for i, g in enumerate(group) if rows[i][0] is not None)


def near_copies(rng, n):
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 90))] for _ in range(6)]
    rows = [(1000, None), (1001, ""), (1002, " \t "), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "x " * 5000)]
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
        rows.append((i, " ".join(w)))
    return rows + [rows[-1], rows[-2]]


@pytest.mark.parametrize("few,block,k,percent", [(48, 1_500_000, 4, 85), (2, 300, 4, 85), (3, 1_500_000, 5, 80)])
def test_join_equals_brute_force(spark, monkeypatch, few, block, k, percent):
    """Also with all n-grams common, and with groups that must be split."""
    monkeypatch.setattr(jaccard_trie, "FEW", few)
    rows = near_copies(random.Random(few), 150)
    got = jaccard_trie.similar_sets(frame(spark, rows).repartition(3), k=k, percent=percent, block_ngrams=block)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(tuple(r) for r in got.collect()) == brute_components(rows, k, percent)


def test_join_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in read_table(spark, SF_SMALL, "documents").collect()]
    assert sorted(tuple(r) for r in queries.op5_ngram_jaccard(spark, SF_SMALL).collect()) == brute_components(rows, 4, 85)


def test_join_edge_cases(spark):
    assert jaccard_trie.similar_sets(frame(spark, [])).count() == 0
    rows = jaccard_trie.similar_sets(frame(spark, [(None, "a b c d e"), (5, "a b c d e"), (None, None)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("5", "5"), ("None", "5"), ("None", "None")]


def test_join_of_rows_without_an_id_of_their_own(spark, monkeypatch):
    """A near copy and a bridge without an id, and one id with many texts."""
    word = lambda *changed: " ".join(f"x{i}" if i in changed else f"w{i}" for i in range(100))
    near = [(5, word()), (None, word(50))]
    bridge = [(7, word(0, 1, 2, 3, 4, 5, 6).replace("w", "v")), (None, word(0, 1, 2, 3).replace("w", "v")),
              (8, word(0, 1, 2, 3, 99, 98, 97, 96, 95).replace("w", "v"))]
    many = [(9, word(i).replace("w", f"u{i % 2}")) for i in range(40)] + [(9, word(3).replace("w", "u1"))] * 5
    rows = near + bridge + many + [(None, word(i).replace("w", "t")) for i in (1, 2)] + [(3, word(3).replace("w", "t")), (None, None)]
    seen = []
    join = jaccard_trie.join_groups
    monkeypatch.setattr(jaccard_trie, "join_groups", lambda grouped, *a: seen.append(grouped.count()) or join(grouped, *a))
    got = sorted(tuple(map(str, r)) for r in jaccard_trie.similar_sets(frame(spark, rows).repartition(3)).select("doc_id", "component_id").collect())
    want = [(5, 5), (None, 5), (7, 7), (None, 7), (8, 7), *[(9, 9)] * 45, (None, 3), (None, 3), (3, 3), (None, None)]
    assert got == sorted(tuple(map(str, r)) for r in want)
    assert seen == [len({t for _, t in rows if t})]  # each text once


def test_trie_equals_pairs():
    rng = random.Random(2)
    for _ in range(150):
        width, percent = rng.choice([12, 40, 200]), rng.choice([50, 80, 85])
        base = set(rng.sample(range(width), rng.randint(1, 12)))
        sets = {frozenset(base ^ {rng.randrange(width) for _ in range(rng.randint(0, 5))}) for _ in range(rng.randint(1, 30))} - {frozenset()}
        sets = [np.array(sorted(s), dtype=np.uint64) for s in sets] or [np.array([1], dtype=np.uint64)]
        got = jaccard_trie.SetTrie(sets, percent).join()
        pairs = [(i, j) for i in range(len(sets)) for j in range(i)
                 if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= percent * (len(sets[i]) + len(sets[j]) - both)]
        want = union(len(sets), pairs)
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


# suffix dedup

def brute_cut(rows, least):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        covered = np.zeros(len(data) + 1, dtype=bool)
        for j in range(len(data) - least + 1):
            if seen.setdefault(data[j:j + least], i) < i:
                covered[j:j + least] = True
        spans = int((covered[:-1] & ~np.r_[False, covered[:-2]]).sum()) if len(data) else 0
        kept = bytes(np.frombuffer(data, np.uint8)[~covered[:-1]])
        out.append((i, len(data), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeating(rng, n):
    shared = ["".join(rng.choices("abcdé ", k=rng.randint(30, 300))) for _ in range(8)]
    rows = [(500, None), (501, ""), (502, "short"), (503, "a" * 3000), (504, "a" * 2000), (505, "ab" * 900 + "c" * 49), (506, "\x00" * 80), (507, "\x00" * 70)]
    for i in range(n):
        text = "".join(rng.choice([rng.choice(shared), "".join(rng.choices("abcdefgh ", k=rng.randint(0, 60)))]) for _ in range(rng.randint(0, 6)))
        rows.append((i - n // 2, text[rng.randint(0, 3):]))
    return rows + [rows[9], rows[10]]


@pytest.mark.parametrize("many,bucket,common,least", [(2000, 12_000_000, 4, 50), (1, 3000, 2, 50), (2, 2000, 10**9, 40)])
def test_cut_equals_brute_force(spark, monkeypatch, many, bucket, common, least):
    """Also with every group of contexts large, many buckets, and copies settled early or never."""
    for name, value in (("MANY", many), ("BUCKET_BYTES", bucket), ("COMMON", common)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = repeating(random.Random(least), 120)
    got = suffix_dedup.remove_repeats(frame(spark, rows).repartition(3), least=least)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_cut(rows, least))


def test_cut_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in read_table(spark, SF_SMALL, "documents").collect()]
    assert sorted(tuple(r) for r in queries.op8_suffix_dedup(spark, SF_SMALL).collect()) == sorted(brute_cut(rows, 50))


def test_cut_edge_cases(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0
    text = "".join(chr(97 + i % 26) + str(i) for i in range(40))
    rows = suffix_dedup.remove_repeats(frame(spark, [(1, text), (1, text), (None, text), (2, "é" + text)]), carry=("kept", "id"), with_text=True).collect()
    assert {(r[0], r.n_removed) for r in rows} == {(1, 0), (None, 0), (2, len(text))} and len(rows) == 4
    assert [r.asDict() for r in rows if r.doc_id == 2][0]["id"] == "a"
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(frame(spark, []), least=20)


def test_maximal_repeats_equal_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        texts = [bytes(rng.choices(b"ab", k=rng.randint(0, 14))) for _ in range(rng.randint(1, 5))]
        least = 2
        places = {}
        for i, t in enumerate(texts):
            for a in range(len(t)):
                for b in range(a + least, len(t) + 1):
                    places.setdefault(t[a:b], []).append((i, a))
        want = []
        for s, at in places.items():
            left = {texts[i][a - 1] if a else (i,) for i, a in at}
            right = {texts[i][a + len(s)] if a + len(s) < len(texts[i]) else (i, a) for i, a in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.append((len(s), sorted(at)))
        assert sorted(suffix_dedup.maximal_repeats(texts, least)) == sorted(want)


# vectors

VECTORS = "vec_id long, embedding array<float>, label int, code string, id string, rank string"


def vectors(spark, rng):
    base = rng.standard_normal((40, 32))
    rows = [(int(i), (base[i % 40] + rng.standard_normal(32) * 0.05).astype(np.float32).tolist(), int(i % 3)) for i in range(1, 260)]
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(60)]  # copies
    rows += [(2000, None, 1), (2100, [0.0] * 32, 1), (2200, [float("nan")] * 32, 1), (2300, [None] * 32, 1), (2400, [1.0, 2.0], 1), (2500, [], 1),
             (2600, [float("inf")] + [1.0] * 31, 1), (2700, rows[5][1], None), (None, rows[5][1], rows[5][2]), (200, rows[3][1], rows[3][2])]
    return rows, spark.createDataFrame([(*r, "c", "i", "r") for r in rows], VECTORS)


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("block,query_rows", [(8192, 1024), (40, 2)])
def test_search_finds_the_nearest(spark, block, query_rows):
    rows, table = vectors(spark, np.random.default_rng(1))
    index, centre = rotated_bits.build_index(table)
    got = rotated_bits.search(index, centre, F.col("id") % 100 == 0, k=10, block_rows=block, query_rows=query_rows).collect()
    able = [(i, np.array(v, dtype=np.float64)) for i, v, _ in rows if good(v) and i is not None]
    found = total = 0
    for q, v in {i: v for i, v in able if i % 100 == 0 and i != 200}.items():
        near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in able if i != q and len(w) == len(v))[:10]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == list(range(1, len(near) + 1))
        assert [s for _, _, s in mine] == sorted(s for _, _, s in mine)
        found += len({i for _, i in near} & {i for _, i, _ in mine})
        total += len(near)
    assert total and found >= 0.95 * total
    assert not any(r.vec_id == r.query_id for r in got)


@pytest.mark.parametrize("block,query_rows", [(8192, 1024), (40, 2)])
def test_search_answers_repeated_queries_once(spark, block, query_rows):
    """A query that is there three times, and two vectors under one id."""
    rows, table = vectors(spark, np.random.default_rng(1))
    table = table.unionByName(table.where("vec_id = 100")).unionByName(table.where("vec_id = 100"))
    index, centre = rotated_bits.build_index(table)
    got = rotated_bits.search(index, centre, F.col("id") % 100 == 0, k=10, block_rows=block, query_rows=query_rows).collect()
    able = [(i, np.array(v, dtype=np.float64)) for i, v, _ in rows if good(v) and i is not None and len(v) == 32]
    found = total = 0
    for q, times in ((100, 1), (200, 2)):
        asked = [v for i, v in able if i == q]
        assert len(asked) == times
        near = [(q, r, d, i) for v in asked
                for r, (d, i) in enumerate(sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in able if i != q)[:10], 1)]
        mine = [r for r in got if r.query_id == q]
        assert sorted(r["rank"] for r in mine) == sorted(r for _, r, _, _ in near)
        assert times > 1 or len({r.vec_id for r in mine}) == 10
        found += len({(q, r, i) for q, r, _, i in near} & {(q, r["rank"], r.vec_id) for r in mine})
        total += len({(q, r, i) for q, r, _, i in near})
    assert found >= 0.9 * total


def test_search_recall_on_embeddings(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_rotated_bits(spark, sf).collect()
    rows = read_table(spark, sf, "embeddings").collect()
    x, ids = np.array([r.embedding for r in rows], dtype=np.float64), np.array([r.vec_id for r in rows])
    found = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        found += len(set(ids[np.lexsort((ids, d))[:10]]) & {r.vec_id for r in got if r.query_id == q})
    assert found >= 0.9 * 10 * (ids % 100 == 0).sum()


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((2000, 48)), rng.standard_normal((5, 48))
    code, length, correction = rotated_bits.encode(x, np.zeros(48))
    bits = rotated_bits.code_bits(48)
    signs = (np.unpackbits(code, axis=1, count=bits) * 2.0 - 1) / np.sqrt(bits)
    estimate = (q / np.linalg.norm(q, axis=1)[:, None]) @ rotated_bits.rotation(48).T @ signs.T / correction
    true = (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / length[:, None]).T
    error = rotated_bits.EPSILON * np.sqrt((1 - correction ** 2) / correction ** 2) / np.sqrt(bits - 1)
    assert np.mean(np.abs(estimate - true) <= error) > 0.95 and abs(np.mean(estimate - true)) < 0.01


def test_vector_links_equal_brute_force(spark):
    rows, table = vectors(spark, np.random.default_rng(3))
    got = sorted(((r.vec_id is None, r.vec_id), r.n_links, r.component_id, r.kept) for r in itq_dedup.linked_vectors(table, cosine=0.98).collect())
    unit = [np.array(v, dtype=np.float64) / np.linalg.norm(v) if good(v) and label is not None else None for _, v, label in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2]
             and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98]
    group = union(len(rows), pairs)
    least, links = {}, [0] * len(rows)
    for i, g in enumerate(group):
        if rows[i][0] is not None:
            least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    want = sorted(((r[0] is None, r[0]), links[i], least.get(group[i]), r[0] == least.get(group[i])) for i, r in enumerate(rows))
    assert got == want


@pytest.mark.parametrize("d,off", [(7, 0.0), (16, 0.0), (32, 0.0), (32, 1.5), (64, 0.0), (64, 2.0), (80, 0.0)])
def test_vector_links_at_the_threshold(spark, d, off):
    """Pairs placed at the threshold, also of vectors that share a mean component ``off`` times the size of the rest."""
    rng = np.random.default_rng(d)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    a = unit(unit(rng.standard_normal((400, d))) + off * unit(rng.standard_normal((1, d))))
    side = rng.standard_normal((400, d))
    side = unit(side - (side * a).sum(axis=1)[:, None] * a)
    c = 0.98 + 1e-6
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * side])
    near = x @ x.T >= 0.98
    assert near[np.arange(400), np.arange(400, 800)].all()
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in itq_dedup.linked_vectors(table, cosine=0.98).collect()}
    assert [got[i] for i in range(800)] == (near.sum(axis=1) - 1).tolist()


def test_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert itq_dedup.linked_vectors(empty).count() == 0
    index, centre = rotated_bits.build_index(empty)
    assert rotated_bits.search(index, centre, F.col("id") % 100 == 0).count() == 0
