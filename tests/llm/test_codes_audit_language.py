"""Vector codes, conversation repair and language profiles against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import conversation_audit as ca, hyper_language as hl, queries, vector_codes as vc
from marketlens.llm.common import read_table

from conftest import SF_SMALL

# vector codes

VECTORS = "vec_id long, embedding array<double>, label int, id string, vector string, code int, error string, __label int"


def vector_frame(spark, rows):
    """Rows of (id, vector, label) with columns whose names clash with those that the operator makes."""
    return spark.createDataFrame([(i, v, label, "x", "y", 1, "z", 5) for i, v, label in rows], VECTORS)


def brute_codes(rows, d, n_parts=8, k=16, rounds=6, scale=4096):
    """Everything in Python's whole numbers, every pair compared."""
    w = -(-d // n_parts)
    whole = [[math.floor(scale * x) for x in v] + [0] * (w * n_parts - d) for _, v, _ in rows]
    parts = [[tuple(v[p * w:(p + 1) * w]) for p in range(n_parts)] for v in whole]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:k]
    books = [[parts[i][p] for i in first] for p in range(n_parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(n_parts):
            members = {}
            for row in parts:
                members.setdefault(nearest(row[p], books[p])[1], []).append(row[p])
            books[p] = [tuple(sum(c) // len(members[j]) for c in zip(*members[j])) if j in members else e for j, e in enumerate(books[p])]
    found = [[nearest(row[p], books[p]) for p in range(n_parts)] for row in parts]
    codes, errors = ["".join(f"{j:02x}" for _, j in f) for f in found], [sum(e for e, _ in f) for f in found]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return codes, errors, digest


def check_codes(spark, rows, d, **parameters):
    out, _ = vc.compress(vector_frame(spark, rows), **parameters)
    got = sorted(tuple(r) for r in out.select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").na.fill(-1, ["vec_id", "label"]).collect())
    codes, errors, digest = brute_codes(rows, d, **{{"n_entries": "k"}.get(n, n): v for n, v in parameters.items()})
    total = {}
    for (_, _, label), e in zip(rows, errors):
        total[label] = total.get(label, 0) + e
    fill = lambda x: -1 if x is None else x
    assert got == sorted((fill(i), fill(label), c, e, total[label], digest) for (i, _, label), c, e in zip(rows, codes, errors))


@pytest.mark.parametrize("d, n", [(16, 300), (8, 40), (13, 90), (64, 70), (3, 50)])
def test_codes_equal_brute_force(spark, d, n):
    rng = np.random.default_rng(d)
    centres = rng.normal(size=(5, d))
    rows = [(int(i), (centres[rng.integers(5)] + 0.05 * rng.normal(size=d)).tolist(), [None, 0, 1, 2][rng.integers(4)]) for i in rng.permutation(n)]
    rows += rows[:7] + [(None, [0.0] * d, None)] * 2  # repeated rows, null ids, zero vectors
    check_codes(spark, rows, d)
    check_codes(spark, rows, d, n_entries=3, rounds=2)


def test_codes_with_ties_few_rows_and_one_vector(spark):
    check_codes(spark, [(i, [float(i % 2), 0.0], 1) for i in range(40)], 2, n_entries=4)
    check_codes(spark, [(5, [0.25, -0.75, 1.5], None)], 3)
    check_codes(spark, [(i, [float(x) for x in (i % 3, -i % 5, i % 2, 0)], i % 2) for i in range(90)], 4, scale=1)


def test_codes_of_vectors_that_do_not_fit(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [0.1 * i, -0.2], 0) for i in range(20)]
    odd = [(100, None, 0), (101, [None, 1.0], 0), (102, [nan, 1.0], 0), (103, [inf, 1.0], 0), (104, [1.0, 2.0, 3.0], 0), (105, [1e300, 0.0], 1), (106, [], 0)]
    out, books = vc.compress(vector_frame(spark, good + odd))
    got = {r["vec_id"]: r for r in out.collect()}
    assert set(got) == set(range(20)) | {104, 105, 106} and books.shape == (8, 16, 1)
    assert all(got[i]["code"] is None and got[i]["error"] is None for i in (104, 105, 106)) and got[105]["label_error"] is None
    codes, errors, digest = brute_codes(good, 2)
    assert [got[i]["code"] for i in range(20)] == codes and got[104]["label_error"] == sum(errors) and got[0]["codebooks_sha256"] == digest
    empty, books = vc.compress(vector_frame(spark, good).limit(0))
    assert empty.collect() == [] and books is None
    only, books = vc.compress(vector_frame(spark, odd[:4] + odd[6:]))
    assert [r["code"] for r in only.collect()] == [None] and books is None
    huge, _ = vc.compress(vector_frame(spark, [(1, [1e300], 1)]))
    assert [(r["code"], r["error"]) for r in huge.collect()] == [(None, None)]


def test_labels_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(i, [i / 7.0, 1.0], None if i % 3 else i % 4) for i in range(80)]
    want = sorted(tuple(r) for r in vc.compress(vector_frame(spark, rows))[0].na.fill(-1).collect())
    monkeypatch.setattr(vc, "BROADCAST_LABELS", 0)
    assert sorted(tuple(r) for r in vc.compress(vector_frame(spark, rows))[0].na.fill(-1).collect()) == want


def test_boxes_leave_out_most_pairs_and_never_an_answer():
    rng = np.random.default_rng(4)
    points = np.floor(4096 * (rng.normal(size=(4, 3))[rng.integers(4, size=5000)] + 0.02 * rng.normal(size=(5000, 3)))).astype(np.int64)
    entries = points[rng.integers(5000, size=16)]
    blocks = vc.Blocks.build(points)
    every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    nearest, distance = blocks.assign(entries)
    assert (nearest == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    sums, counts, compared = blocks.add_up(entries)
    assert (counts == np.bincount(nearest, minlength=16)).all()
    assert all((sums[j] == points[nearest == j].sum(axis=0)).all() for j in range(16))
    assert blocks.shortlists(entries).mean() < 0.2 and compared < len(points)
    centres = np.stack([points[(np.abs(points - p) < 1000).all(axis=1)].mean(axis=0) for p in points[:40]]).astype(np.int64)
    assert blocks.add_up(np.unique(centres, axis=0))[2] < len(points) / 10  # far apart: blocks go whole


def test_hilbert_order_visits_neighbours():
    grid = np.array(list(itertools.product(range(8), repeat=2)))
    path = grid[vc.hilbert_order(grid)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    assert sorted(map(tuple, path)) == sorted(map(tuple, grid))
    assert list(vc.hilbert_order(np.zeros((3, 70), np.int64))) == [0, 1, 2]


# conversation repair

TALKS = "conv_id long, turn long, role string, text string, copies string, audit int, __row int, repeated string, __kind int"


def talk_frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, "x", 3) for r in rows], TALKS)


def brute_repair(initials, must_go, broken):
    """Cheapest edits by best-first search over (rows read, state) with whole strings; the least of the cheapest."""
    n, best = len(initials), {}
    best[0, 0] = (0, "")
    accept = {0: {"u": 2, "s": 1}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def offer(key, value):
        if key not in best or value < best[key]:
            best[key] = value
    for i in range(n + 1):
        for _ in range(3):
            for q in range(4):
                if (i, q) in best:
                    cost, audit = best[i, q]
                    for x, to in accept[q].items():
                        if x in "ua":
                            offer((i, to), (cost + 2, audit + "I"))
        if i < n:
            for q in range(4):
                if (i, q) in best:
                    cost, audit = best[i, q]
                    offer((i + 1, q), (cost + 3, audit + "D"))
                    if not must_go[i]:
                        for x, to in accept[q].items():
                            if x == initials[i]:
                                offer((i + 1, to), (cost + broken[i], audit + "K"))
                            if x in "ua":
                                offer((i + 1, to), (cost + 2 + broken[i], audit + "R"))
    return min(best[n, q] for q in (0, 3) if (n, q) in best)


def brute_talks(rows):
    talks = {}
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        had = talks.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        had += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, had in talks.items():
        had.sort()
        turns = [t for known, t, *_ in had if known]
        seen, blank, again, broken = set(), [], [], []
        for _, _, role, text in had:
            body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            blank.append(not body)
            again.append(bool(body) and (role, text) in seen)
            broken.append(bool(body) and not again[-1] and body[-1] not in ".!?")
            seen.add((role, text))
        initials = [role[:1] for _, _, role, _ in had]
        cost, audit = brute_repair(initials, [b or a for b, a in zip(blank, again)], broken)
        lines, i, state = [], 0, "a"
        for letter in audit:
            want = "assistant" if state == "u" else "user"
            if letter == "I":
                lines.append(want + ":")
            else:
                _, _, role, text = had[i]
                i += 1
                if letter == "D":
                    continue
                lines.append(f"{role if letter == 'K' else want}:{text}")
            state = lines[-1][0]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        assert not lines or re.fullmatch("s?(ua)+", "".join(line[0] for line in lines))
        out[conv] = (gaps, sum(blank), sum(again), sum(broken), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_talks(seed, n=250, most=9):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "so be it", "", " \t", "a ", "Why?  ", "été.", None, "..", "x" * 50]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ux"]
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, most)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(roles), rng.choice(texts)))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rng.shuffle(rows)
    return rows


def check_talks(spark, rows, **bounds):
    out = ca.repair(ca.damaged(talk_frame(spark, rows)), **bounds)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = out.collect()
    assert len({r[0] for r in got}) == len(got)
    assert {r[0]: tuple(r)[1:] for r in got} == brute_talks(rows)


def test_repairs_equal_brute_force(spark):
    check_talks(spark, random_talks(1))


@pytest.mark.parametrize("bounds", [{"long_rows": 4}, {"long_rows": 0}, {"long_chars": 20}])
def test_long_conversations_take_two_passes(spark, bounds):
    check_talks(spark, random_talks(2, 60, 30), **bounds)


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["Well.", f"Number {t}.", "and so"])) for t in range(600)] + random_talks(6, 10)
    rows = [r for r in rows if r[0] != 7 or r[1] is not None]
    check_talks(spark, rows, long_rows=100)
    check_talks(spark, rows)


def test_empty_and_dropped_conversations(spark):
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    check_talks(spark, [(gone, 0, "user", "Hello."), (gone, 0, "assistant", "Hello.")])
    assert ca.repair(ca.damaged(talk_frame(spark, [(1, 1, "user", "x")]).limit(0))).collect() == []


def letters_of(program_rows, **options):
    program = ca.AuditProgram(**options)
    for row in program_rows:
        program.row(*row)
    return program.finish()


def test_audits_with_colliding_hashes_and_rebasing():
    rng = random.Random(9)
    for trial in range(400):
        rows = [(rng.choice("suatx"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randint(0, 24))]
        want = brute_repair([r[0] for r in rows], [r[1] for r in rows], [r[2] and not r[1] for r in rows])
        rows = [(a, b, c and not b) for a, b, c in rows]
        for options in ({}, {"mod": 1}, {"mod": 2}, {"mod": 5}, {"rebase_rows": 1}, {"rebase_rows": 3, "mod": 3}):
            assert letters_of(rows, **options) == want


def test_prefix_search_and_collisions_are_seen():
    def path(text, mod):
        node = ca.Edits(None)
        for c in text:
            node = ca.Edits(node, c, mod)
        return node
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("DK") for _ in range(rng.randint(0, 12))) for _ in range(2))
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        for mod in (1, 3, ca._MOD):
            x, y = path(a, mod), path(b, mod)
            found, misled = ca.first_difference(x, y)
            assert found == n and (misled or mod != 1 or n == min(len(a), len(b))) and not (misled and mod == ca._MOD)
            assert ca.compare(x, "", y, "") == (a > b) - (a < b) and ca.compare(x, "I", y, "R") == (a + "I" > b + "R") - (a + "I" < b + "R")
            assert x.letters() == a


def test_memory_follows_open_alternatives():
    program = ca.AuditProgram(rebase_rows=64)
    for i in range(5000):
        program.row("ua"[i % 2], False, False)
    assert max(b[1].depth for b in program.best if b) <= 200 and program.finish() == (0, "K" * 5000)


# language

DOCS = "doc_id long, text string, lang string, source string, language string, id string, held_out string, __score int"


def doc_frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "l", "x", "h", 1) for i, t, lang in rows], DOCS)


def brute_profile(text, d):
    out, line = np.zeros(d, np.int64), "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    vector = lambda c: hl.letter_vector(ord(c), d).astype(np.int64)
    for a, b, c in zip(line, line[1:], line[2:]):
        if b != " ":
            out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return out


def test_profiles_are_sums_of_bound_letters():
    texts = ["The cat", "", "  12 ", "éa Ñandú x", "日本語 テスト", "a" * 50, "𝔘x"]
    got = hl.profiles(texts, hl.Letters(256))
    assert (got == np.stack([brute_profile(t, 256) for t in texts])).all()
    many = "".join(chr(0x4E00 + i) for i in range(400))  # a large alphabet: sorted codes
    assert (hl.profiles([many, "abc"], hl.Letters(64)) == np.stack([brute_profile(many, 64), brute_profile("abc", 64)])).all()


def test_long_texts_are_cut_without_a_trace():
    rng = random.Random(2)
    text = "".join(rng.choice("abc de, 1") for _ in range(40_000))
    assert "".join(hl.pieces(text, 100)) == text and max(map(len, hl.pieces(text, 100))) < 200
    whole = hl.profiles([text], hl.Letters(64))
    cut = sum(hl.profiles([p], hl.Letters(64)) for p in hl.pieces(text, 100))
    assert (whole == cut).all()
    assert list(hl.pieces("x" * 500, 100)) == ["x" * 500]


def test_runs_of_texts_do_not_matter(monkeypatch):
    texts = ["ab cd", None, "efg " * 200, "", "hi", "zz top"] * 3
    want = np.concatenate([hl.profiles([t or ""], hl.Letters(64)) for t in texts])
    monkeypatch.setattr(hl, "PASS_CHARS", 100)
    monkeypatch.setattr(hl, "PIECE_CHARS", 30)
    got = np.concatenate([p for _, p in hl.batch_profiles(texts, hl.Letters(64))])
    assert (got == want).all()


def test_language_equals_brute_force(spark):
    rng = random.Random(8)
    words = {"xx": ["ba", "bab", "abba", "ab"], "yy": ["lo", "olo", "lol", "ollo"], "zz": ["ti", "tit", "itti"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 9))), rng.choice([lang, lang, None])) for i, lang in
            enumerate(rng.choice(list(words)) for _ in range(120))]
    rows += [(500, None, "xx"), (501, "", "yy"), (502, "123 !", "zz"), (None, "bab ab", "yy"), rows[3], rows[3]]
    got = sorted((tuple(r) for r in hl.identify(doc_frame(spark, rows), dimensions=256).collect()), key=str)
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 3 == 1
    sums = {}
    for i, text, lang in rows:
        if text is not None and lang is not None and not held(i):
            sums[lang] = sums.get(lang, 0) + brute_profile(text, 256)
    unit = lambda v: v / np.linalg.norm(v)
    shared = np.mean([unit(sums[k]) for k in sorted(sums)], axis=0)
    want = []
    for i, text, _ in rows:
        p = brute_profile(text or "", 256)
        cosine = {k: unit(unit(p) - shared) @ unit(unit(sums[k]) - shared) for k in sorted(sums)} if p.any() else {}
        best = max(cosine, key=cosine.get, default="und")
        want.append((i, held(i), best, (1 + cosine[best]) / 2 if cosine else 0.0))
    for g, w in zip(got, sorted(want, key=str)):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=1e-9)


def test_nothing_to_learn_and_too_many_languages(spark):
    rows = [(0, "abc", None), (1, None, None)]
    assert {(r["lang_pred"], r["score"]) for r in hl.identify(doc_frame(spark, rows)).collect()} == {("und", 0.0)}
    assert hl.identify(doc_frame(spark, rows).limit(0)).collect() == []
    one = hl.identify(doc_frame(spark, [(i, "hello there", "en") for i in range(9)])).collect()
    assert {r["lang_pred"] for r in one} == {"en"} and all(0 <= r["score"] <= 1 for r in one)
    with pytest.raises(Exception, match="languages"):
        hl.identify(doc_frame(spark, [(i, f"word {chr(97 + i % 20)}", f"l{i}") for i in range(60)]), max_languages=5)


def test_held_out_accuracy(spark):
    docs = read_table(spark, SF_SMALL.replace("0.001", "0.01"), "documents")
    found = queries.op13_hyper_language(spark, SF_SMALL.replace("0.001", "0.01")).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
