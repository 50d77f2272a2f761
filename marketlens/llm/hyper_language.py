"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``DIMENSIONS`` signs, made from its code point alone.  A trigram ``abc`` inside a word (an edge of the word is a
letter of its own) is bound: the vector of ``a`` permuted twice, times that of ``b`` permuted once, times that of ``c``, component by
component.  A document's profile is the bundle (sum) of the vectors of all its trigrams, one for each of its letters; a language's
prototype is the bundle of the profiles of its training documents.  A document gets the language whose prototype has the largest cosine with its
profile, less what all languages share: the mean of the unit prototypes is taken off both sides before the cosine.

Bundles are sums, so they are formed as ``counts x vectors``: a batch of texts becomes a matrix of trigram counts, and one matrix product
with the vectors of the trigrams that occur gives all its profiles.  All sums are whole numbers and exact.  Training returns one vector for each task
and language, added up in the shuffle; prototypes (languages x dimensions) are all that reaches the driver.

Long texts are cut between words into pieces whose profiles add up, so memory does not follow the longest text.

Edge cases: ``language`` is ``und`` and the score 0 when the text is null or has no letter, or when nothing could be learned; rows with a null language,
text or no letter teach nothing; a null id is in no training fold's complement by itself (its hash is null) and counts as held out; ties
go to the language that comes first; repeated rows count each; an empty table gives no rows.  More than ``max_languages`` languages are an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import map_batches, mix64

DIMENSIONS = 1024
#: Code points and rows of one matrix product, and code points of a piece of a long text.
PASS_CHARS, PASS_ROWS, PIECE_CHARS = 1 << 18, 1 << 11, 1 << 16
UNKNOWN = "und"
_EDGE = 0x20
#: Trigram codes up to this number are looked up in a table, others are sorted.
_TABLE = 1 << 22
_CUT = re.compile(r"[\W\d_]")


def letter_vector(code_point: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signs (-1, 1) that depend on the code point only."""
    words = mix64(mix64(np.uint64(code_point + 1)) + np.arange(1, dimensions // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(words.view(np.uint8)).astype(np.int8) * 2 - 1


class Letters:
    """Vectors of the letters seen by a task, and which code points are letters."""

    def __init__(self, dimensions: int):
        self.dimensions, self.rows, self.vectors = dimensions, {}, np.zeros((0, dimensions), np.int8)
        self.kinds: dict[int, bool] = {}

    def are_letters(self, points: np.ndarray) -> np.ndarray:
        for p in points.tolist():
            if p not in self.kinds:
                self.kinds[p] = chr(p).isalpha()
        return np.fromiter((self.kinds[p] for p in points.tolist()), bool, len(points))

    def of(self, points: np.ndarray) -> np.ndarray:
        fresh = [p for p in points.tolist() if p not in self.rows]
        if fresh:
            if len(self.rows) > 1 << 14:  # a task keeps a bounded number of them
                self.rows, self.vectors = {}, self.vectors[:0]
                fresh = points.tolist()
            self.rows |= {p: len(self.rows) + i for i, p in enumerate(fresh)}
            self.vectors = np.concatenate([self.vectors, *[letter_vector(p, self.dimensions)[None] for p in fresh]])
        return self.vectors[[self.rows[p] for p in points.tolist()]]


def bound(letters: Letters, points: np.ndarray, trigrams: np.ndarray) -> np.ndarray:
    """Vectors of trigrams, given as places in ``points``: each letter permuted by its distance from the end, then multiplied."""
    vectors = letters.of(points)
    out = np.roll(vectors, 2, axis=1)[trigrams[:, 0]]
    out = out * np.roll(vectors, 1, axis=1)[trigrams[:, 1]]
    return out * vectors[trigrams[:, 2]]


def profiles(texts: list[str], letters: Letters) -> np.ndarray:
    """Bundles of the texts (rows x dimensions, whole numbers as doubles); zeros without a letter.

    A text may have at most 2^24 letters, so that single precision holds every sum exactly.
    """
    coded = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(c) for c in coded])
    edge = np.array([_EDGE], np.uint32)
    line = np.concatenate([edge, *[x for c in coded for x in (c, edge)]])
    row = np.concatenate([[0], np.repeat(np.arange(len(texts)), sizes + 1)])
    occurs = np.zeros(int(line.max()) + 1, bool)
    occurs[line] = True
    points = np.flatnonzero(occurs).astype(np.uint32)
    points = points[letters.are_letters(points)]
    place = np.zeros(len(occurs), np.int64)
    place[points] = np.arange(1, len(points) + 1)
    at = place[line]  # 0: the edge of a word, whatever stands there
    points = np.concatenate([edge, points])
    middle = np.flatnonzero(at[1:-1]) + 1
    n = len(points)
    code = (at[middle - 1] * n + at[middle]) * n + at[middle + 1]
    if n ** 3 <= _TABLE:
        seen = np.zeros(n ** 3, bool)
        seen[code] = True
        kinds = np.flatnonzero(seen)
        column = np.zeros(n ** 3, np.int64)
        column[kinds] = np.arange(len(kinds))
        column = column[code]
    else:
        kinds, column = np.unique(code, return_inverse=True)
    out = np.zeros((len(texts), letters.dimensions))
    step = max(1, (1 << 24) // max(1, len(texts)))  # trigrams of one product, so that the matrix of counts stays small
    for a in range(0, len(kinds), step):
        some = kinds[a:a + step]
        inside = slice(None) if len(kinds) <= step else (column >= a) & (column < a + step)
        cell = row[middle][inside] * len(some) + column[inside] - a
        counts = np.bincount(cell, minlength=len(texts) * len(some)).reshape(len(texts), -1).astype(np.float32)
        vectors = bound(letters, points, np.stack([some // (n * n), some // n % n, some % n], axis=1))
        out += counts @ vectors.astype(np.float32)
    return out


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """Parts of a text, cut where no letter stands; a longer run of letters stays whole."""
    a = 0
    while len(text) - a > most:
        found = _CUT.search(text, a + most)
        if found is None:
            break
        yield text[a:found.start()]
        a = found.start()
    yield text[a:]


def batch_profiles(texts: list[str | None], letters: Letters) -> Iterator[tuple[int, np.ndarray]]:
    """``(first row, profiles)`` of runs of texts; a long text is a run of its own."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and b - a < PASS_ROWS and (b == a or size + len(texts[b] or "") <= PASS_CHARS):
            size += len(texts[b] or "")
            b += 1
        if size > PASS_CHARS:
            total = np.zeros((1, letters.dimensions))
            for piece in pieces(texts[a]):
                total += profiles([piece], letters)
            yield a, total
        else:
            yield a, profiles([t or "" for t in texts[a:b]], letters)
        a = b


def learn(rows: DataFrame, text: str, language: str, dimensions: int = DIMENSIONS, max_languages: int = 4096) -> dict[str, np.ndarray]:
    """Prototype of every language: the sum of the profiles of its rows."""

    def run(batches):
        letters, sums = Letters(dimensions), {}
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, found in batch_profiles(texts, letters):
                for i, profile in enumerate(found):
                    had = sums.setdefault(names[a + i], np.zeros(dimensions, np.int64))
                    had += profile.astype(np.int64)
            if len(sums) > max_languages:
                raise ValueError(f"more than {max_languages} languages")
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.int64()))], names=["language", "s"])

    taught = rows.where(F.col(text).isNotNull() & F.col(language).isNotNull()).select(F.col(text).cast("string"), F.col(language).cast("string"))
    told = map_batches(taught, run, "language string, s array<long>").select("language", F.posexplode("s").alias("i", "x"))
    total = told.groupBy("language", "i").agg(F.sum("x").alias("x")).groupBy("language").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    found = total.limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    learned = {r["language"]: np.array([x["x"] for x in r["s"]], dtype=np.float64) for r in found}
    return {name: learned[name] for name in sorted(learned) if learned[name].any()}


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def predict(rows: DataFrame, prototypes: dict[str, np.ndarray], text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """``rows`` with ``__language`` and ``__score`` ((1 + cosine) / 2)."""
    names = list(prototypes)
    units = _unit(np.stack([prototypes[n] for n in names])) if names else np.zeros((0, dimensions))
    shared = units.mean(axis=0) if len(names) > 1 else np.zeros(dimensions)
    apart = _unit(units - shared).T.copy()
    columns = [c for c in rows.columns if c != text]

    def run(batches):
        letters = Letters(dimensions)
        for batch in batches:
            texts = batch.column(len(columns)).to_pylist()
            language, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if names:
                for a, found in batch_profiles(texts, letters):
                    cosine = _unit(_unit(found) - shared) @ apart
                    best = cosine.argmax(axis=1)
                    for i in np.flatnonzero(found.any(axis=1)):
                        language[a + i] = names[best[i]]
                        score[a + i] = min(1.0, max(0.0, (1 + cosine[i, best[i]]) / 2))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(language, pa.string()), pa.array(score)], names=[*columns, "__language", "__score"])

    schema = T.StructType([rows.schema[c] for c in columns] + [T.StructField("__language", T.StringType()), T.StructField("__score", T.DoubleType())])
    return map_batches(rows.select(*columns, F.col(text).cast("string").alias(text)), run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text: str = "text", language: str = "lang", folds: int = 3, held: int = 1,
             dimensions: int = DIMENSIONS, max_languages: int = 4096) -> DataFrame:
    """``id_col, held_out, lang_pred, score`` of every row; rows whose crc32 of the id leaves ``held`` teach nothing."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    told = docs.select(F.col(id_col).alias("id"), F.coalesce(fold == held, F.lit(True)).alias("held_out"), F.col(text).alias("text"), F.col(language).alias("language"))
    prototypes = learn(told.where(~F.col("held_out")), "text", "language", dimensions, max_languages)
    found = predict(told.drop("language"), prototypes, "text", dimensions)
    return found.select(F.col("id").alias(id_col), "held_out", F.col("__language").alias("lang_pred"), F.col("__score").alias("score"))
