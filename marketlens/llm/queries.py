"""The subpackage's registered queries: each operator over its whole table, with the digest columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from marketlens.llm import (bpe_prefix, conversation_audit, hyper_language, itq_dedup, jaccard_trie, mincut_html, packing, quality, rotated_bits,
                            secret_ledger, suffix_dedup, toxicity, vector_codes)
from marketlens.llm.common import read_table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return add


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document; hosts are sources, paths are languages below them."""
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length buckets of least padding and token-budget batches over every document; tokens are words."""
    return packing.pack(packing.word_lengths(read_table(spark, sf_dir, "documents")))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity of every document."""
    return toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


_OP4_SQL = """
WITH vectors AS (SELECT row_number() OVER () AS r, vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
                 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                   AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.id AS query_id, v.id AS vec_id,
                 sqrt(list_reduce([CAST(0 AS DOUBLE)] || list_transform(list_zip(v.e, q.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda s, x: s + x)) AS score
          FROM (SELECT DISTINCT id, e FROM vectors WHERE id % 100 = 0) q JOIN vectors v ON v.id <> q.id AND len(v.e) = len(q.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""


@query("op4_rotated_bits", _OP4_SQL)
def op4_rotated_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest embeddings of every embedding whose id is divisible by 100."""
    index, centre = rotated_bits.build_index(read_table(spark, sf_dir, "embeddings"))
    return rotated_bits.search(index, centre, F.col("id") % 100 == 0, k=10)


def _components_sql(nodes: str, links: str) -> str:
    """Table expressions ``reach`` and ``least``: the smallest id that each of ``nodes`` reaches over ``links`` (a, b in both directions)."""
    return (f"reach AS (SELECT id AS a, id AS b FROM {nodes} UNION SELECT r.a, l.b FROM reach r JOIN {links} l ON l.a = r.b), "
            "least AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)")


_OP5_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS MATERIALIZED (SELECT id, count(*) AS n FROM shingles GROUP BY id),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id),
half AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
links AS MATERIALIZED (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
{_components_sql('words', 'links')}
SELECT w.id AS doc_id, coalesce(n, 0) AS n_shingles, component AS component_id FROM words w LEFT JOIN sizes USING (id) JOIN least USING (id)
"""


@query("op5_ngram_jaccard", _OP5_SQL)
def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by 4-word shingles and a Jaccard similarity of 0.85."""
    return jaccard_trie.similar_sets(read_table(spark, sf_dir, "documents"), k=4, percent=85)


@query("op6_mincut_html")
def op6_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return mincut_html.extract(read_table(spark, sf_dir, "pages"))


_OP7_SQL = f"""
WITH RECURSIVE vectors AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
usable AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM vectors WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
           AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.id <> b.id
                       WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
{_components_sql('vectors', 'links')}
SELECT v.id AS vec_id, (SELECT count(*) FROM links l WHERE l.a = v.id) AS n_links, component AS component_id, v.id = component AS kept
FROM vectors v JOIN least USING (id)
"""


@query("op7_itq_dedup", _OP7_SQL)
def op7_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings of one label with a cosine of 0.98."""
    return itq_dedup.linked_vectors(read_table(spark, sf_dir, "embeddings"), cosine=0.98)


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that start in a document with a smaller id."""
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), least=50)


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
_OP9_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
rules AS (SELECT * FROM (VALUES
    ('assign', 1, '(?:{_KEYWORDS})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 8),
    ('access', 2, '(AKIA[A-Z0-9]+)', 16),
    ('hex', 3, '([0-9a-f]+)', 32)) AS r(kind, place, pattern, least)),
cut AS (SELECT doc_id, kind, place, least, list_transform(string_split_regex(x, pattern), lambda s: length(s)) AS gaps,
               list_transform(regexp_extract_all(x, pattern, 0), lambda s: length(s)) AS taken,
               list_transform(regexp_extract_all(x, pattern, 1), lambda s: length(s)) AS worth
        FROM texts, rules),
flat AS (SELECT doc_id, kind, place, least, generate_subscripts(taken, 1) AS i, unnest(gaps[1:len(taken)]) AS gap,
                unnest(taken) AS took, unnest(worth) AS worth FROM cut),
spans AS (SELECT doc_id, kind, place, least, worth, took,
                 sum(gap + took) OVER (PARTITION BY doc_id, place ORDER BY i) AS stop FROM flat),
good AS (SELECT doc_id, kind, place, stop - took AS start, kind || ':' || (stop - took) || ':' || stop AS span
         FROM spans WHERE worth >= least),
per_doc AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k,
                   count(*) FILTER (kind = 'hex') AS h, string_agg(span, ',' ORDER BY start, place) AS spans
            FROM good GROUP BY doc_id)
SELECT t.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN per_doc p USING (doc_id)
"""


@query("op9_secrets", _OP9_SQL)
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document through a new blob ledger."""
    found = secret_ledger.scan(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = secret_ledger.joined_spans(F.col("spans"))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    """Token ids of every document and the bytes decoded from them, as digests."""
    return bpe_prefix.encode_texts(
        read_table(spark, sf_dir, "documents"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN, with_ids=False, with_digests=True)


def _op11_sql(n_parts: int = 8, n_entries: int = 16, rounds: int = 6) -> str:
    """Every round as a table expression: all distances by brute force."""
    distance = "list_sum(list_transform(list_zip(p.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [f"""
kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
                list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
         WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p.i AS part, v[p.i * (len(v) // {n_parts}) + 1:(p.i + 1) * (len(v) // {n_parts})] AS v
                       FROM kept, (SELECT unnest(range({n_parts})) AS i) p),
books0 AS (SELECT part, r - 1 AS entry, v FROM parts WHERE r <= {n_entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""
near{i} AS MATERIALIZED (SELECT r, part, v, entry, d FROM (SELECT p.r, p.part, p.v, e.entry, {distance} AS d,
               row_number() OVER (PARTITION BY p.r, p.part ORDER BY {distance}, e.entry) AS place
               FROM parts p JOIN books{i} e USING (part)) WHERE place = 1)""")
        if i < rounds:
            steps.append(f"""
books{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM books{i} b LEFT JOIN (
    SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
        SELECT part, entry, i, sum(x) AS s, count(*) AS n FROM (
            SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{i}) GROUP BY part, entry, i)
    GROUP BY part, entry) m USING (part, entry))""")
    return "WITH " + ",".join(steps) + f""",
coded AS (SELECT k.vec_id, k.label, c.code, c.error FROM kept k JOIN (
    SELECT r, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r) c USING (r)),
totals AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded GROUP BY label),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS h FROM books{rounds})
SELECT c.vec_id, c.code, c.error, t.label_error, (SELECT h FROM digest) AS codebooks_sha256
FROM coded c JOIN totals t ON c.label IS NOT DISTINCT FROM t.label
"""


@query("op11_vector_codes", _op11_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every embedding under codebooks learned from all of them."""
    coded, _ = vector_codes.compress(read_table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _op12_sql() -> str:
    """The least repair by a program over whole audit strings: ``c`` cost, ``a`` audit, ``o`` repaired lines of each state."""
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR))"

    def add(s: str, cost: str, letter: str, line: str) -> str:
        return f"CASE WHEN {s} IS NULL THEN {none} ELSE {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'o': {s}.o || {line}}} END"

    def best(*options: str) -> str:
        return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"

    def stay(s: str, initial: str, role: str) -> str:
        kept, rerole = add(s, "f.broken", "K", "chr(10) || f.role || ':' || f.text"), add(s, "f.broken + 2", "R", f"chr(10) || '{role}:' || f.text")
        return f"CASE WHEN f.must_go THEN {none} WHEN f.initial = '{initial}' THEN {kept} ELSE {rerole} END"

    def inserts(source: str) -> str:
        user = lambda s: add(s, "2", "I", "chr(10) || 'user:'")
        return (f"SELECT c, i, f0, f1, g2, {best('f3', add('g2', '2', 'I', 'chr(10) || ' + chr(39) + 'assistant:' + chr(39)))} AS g3 FROM ("
                f"SELECT c, i, f0, f1, f3, {best('f2', user('f0'), user('f1'), user('f3'))} AS g2 FROM {source})")

    delete = lambda s: add(s, "3", "D", "''")
    system = f"CASE WHEN NOT f.must_go AND f.initial = 's' THEN {add('g.f0', 'f.broken', 'K', 'chr(10) || f.role || ' + chr(39) + ':' + chr(39) + ' || f.text')} ELSE {none} END"
    space = r"\x20\x09-\x0D"
    return f"""
WITH RECURSIVE named AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                                                   lambda b: CAST(ascii(b) AS BIGINT)),
        lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)),
        4294967295) % 20 AS kind FROM conversations),
copied AS (SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM named WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM copied),
judged AS (SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^{space}]') AS blank,
    row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][{space}]*$') AS open_end,
    lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) || substr(role, 1, 1) AS pair FROM placed),
facts AS MATERIALIZED (SELECT c, i, role, text, initial, blank OR again AS must_go, CASE WHEN open_end THEN 1 ELSE 0 END AS broken FROM judged),
counts AS (SELECT c, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (open_end AND NOT again AND NOT blank) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM judged GROUP BY c),
steps AS (
    SELECT c, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}} AS f0, {none} AS f1, {none} AS f2, {none} AS f3 FROM (SELECT DISTINCT c FROM named)
    UNION ALL
    SELECT g.c, f.i, {delete('g.f0')}, {best(delete('g.f1'), system)},
           {best(delete('g.g2'), stay('g.f0', 'u', 'user'), stay('g.f1', 'u', 'user'), stay('g.g3', 'u', 'user'))},
           {best(delete('g.g3'), stay('g.g2', 'a', 'assistant'))}
    FROM ({inserts('steps')}) g JOIN facts f ON f.c = g.c AND f.i = g.i + 1),
ends AS (SELECT s.* FROM steps s LEFT JOIN counts k USING (c) WHERE s.i = coalesce(k.n, 0)),
done AS (SELECT c, {best('f0', 'g3')} AS r FROM ({inserts('ends')}))
SELECT n.conv_id, coalesce(k.gaps, 0) AS gaps, coalesce(k.blank, 0) AS blank, coalesce(k.duplicate, 0) AS duplicate, coalesce(k.truncated, 0) AS truncated,
       coalesce(k.illegal, 0) AS illegal, r.c AS cost, r.a AS audit, sha256(substr(r.o, 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM named) n JOIN done USING (c) LEFT JOIN counts k USING (c)
"""


@query("op12_conversation_audit", _op12_sql())
def op12_conversation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its audit of every damaged conversation."""
    return conversation_audit.repair(conversation_audit.damaged(read_table(spark, sf_dir, "conversations")))


@query("op13_hyper_language")
def op13_hyper_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the prototypes of two thirds of them."""
    return hyper_language.identify(read_table(spark, sf_dir, "documents"))
