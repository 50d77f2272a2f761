"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: density and variety of lexicon words, how many of them stand near a
second-person word, second-person density, capitals, punctuation, and how much of
the text is obfuscated (lexicon words that appear only after undoing look-alike characters, mixed tokens,
spelled-out letters).  The lexicon is a short fixed list plus words and word beginnings learned from
labelled texts, kept as hashes.

Fitting uses at most ``max_fit_rows`` labelled rows in hash order: half for the lexicon, four tenths for the
trees, one tenth for the isotonic regression that maps the trees' probability to the observed share of toxic texts.

Labels come only from rows the caller allows; ids, sources, languages and labels are never inputs of a score.

Edge cases: null and empty texts have all-zero features and get the score of such texts; several labels of one
id are averaged, null labels do not count; without labels of both classes every score is the share of
toxic labels (0 without any); rows that repeat are scored each; extra columns are not carried; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import map_batches, mix64, passes, text_buffer, written
from marketlens.llm.quality import labelled_sample
from marketlens.llm.words import letter_table, white_space_table, word_hashes

#: Insults that count before anything is learned.
SEED_WORDS = ("idiot", "moron", "stupid", "scum", "loser", "trash", "worthless", "pathetic", "disgusting", "clown",
              "dumb", "imbecile", "vermin", "filth", "garbage", "ugly", "hate", "freak", "creep", "coward")
#: Words that address the reader.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "youre", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu",
                 "te", "toi", "ton", "ta", "vous", "votre", "usted", "ustedes", "vosotros", "ti", "tú")
#: Characters read as letters when obfuscation is undone.
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

FEATURES = ("lexicon", "stems", "lexicon_kinds", "lexicon_hits", "near_second", "second_person", "upper", "caps_words", "marks", "bangs",
            "questions", "hidden_lexicon", "mixed_tokens", "spelled_out", "log_words", "mean_word")

#: Most labelled documents that fitting reads.
MAX_FIT_ROWS = 30_000
#: Byte lengths of word beginnings that may enter the lexicon, for inflected forms that no label shows.
STEMS = (4, 5, 6, 7)
#: Words between a lexicon word and a second-person word that count as near.
NEAR = 5


def _hash_words(words) -> np.ndarray:
    column = pa.array(list(words))
    buf, offsets = text_buffer(column)
    return word_hashes(buf, offsets, letter_table())[0] if len(column) else np.zeros(0, np.uint64)


def _lexicon_keys(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, lengths and first indices of the words, and a row of keys for each word: itself and its stems (0: no longer than the stem)."""
    hashes, lengths, first, *stems = word_hashes(buf, offsets, letter_table(), STEMS)
    keys = [hashes] + [np.where(lengths > n, mix64(h + np.uint64(n)), np.uint64(0)) for n, h in zip(STEMS, stems, strict=True)]
    return hashes, lengths, first, np.stack(keys)


def _class_table(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[[ord(c) for c in chars]] = 1
    return table


_UPPER = _class_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARK = _class_table("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_BANG, _QUESTION = _class_table("!"), _class_table("?")


def dense_features(buf: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text; ``lexicon`` holds sorted word hashes."""
    n = len(offsets) - 1
    if n == 0 or len(buf) == 0:
        return np.zeros((n, len(FEATURES)))
    sizes = np.diff(offsets)
    some = sizes > 0

    def share(table: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        out[some] = np.add.reduceat(table[buf], offsets[:-1][some]) / sizes[some]
        return out

    hashes, lengths, first, keys = _lexicon_keys(buf, offsets)
    words = np.diff(first)
    per_word = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), words)
    total = lambda flags: np.bincount(owner, weights=flags, minlength=n)

    known = np.isin(keys, lexicon)
    bad, second = known.any(axis=0), np.isin(hashes, _hash_words(SECOND_PERSON))
    seconds = np.concatenate([[0], np.cumsum(second)])
    at = np.flatnonzero(bad)
    low, high = np.maximum(at - NEAR, first[owner[at]]), np.minimum(at + NEAR + 1, first[owner[at] + 1])
    near = np.bincount(owner[at], weights=seconds[high] > seconds[low], minlength=n)
    hits = total(bad)
    kinds = np.zeros(n)
    if len(at):
        pairs = np.unique(np.stack([owner[at].astype(np.uint64), hashes[at]]), axis=1)
        kinds = np.bincount(pairs[0].astype(np.int64), minlength=n).astype(float)
    single = lengths == 1
    run = np.zeros(len(hashes), dtype=bool)
    if len(hashes) > 2:
        run[2:] = single[2:] & single[1:-1] & single[:-2] & (owner[2:] == owner[:-2])

    plain, _, begin = word_hashes(buf, offsets, letter_table(LOOK_ALIKES))
    reader = np.repeat(np.arange(n), np.diff(begin))
    hidden = np.bincount(reader, weights=np.isin(plain, lexicon), minlength=n) - total(known[0])
    # tokens that have both letters and other characters inside: more letter runs than tokens
    tokens = np.diff(word_hashes(buf, offsets, white_space_table())[2])
    caps = share(_UPPER)
    return np.column_stack([
        100 * total(known[0]) / per_word, 100 * hits / per_word, kinds, np.log1p(hits), 100 * near / per_word, 100 * total(second) / per_word, caps,
        np.where(caps > 0.5, 1.0, 0.0), share(_MARK), share(_BANG), share(_QUESTION), 100 * np.maximum(hidden, 0) / per_word,
        np.maximum(words - tokens, 0) / np.maximum(tokens, 1), total(run) / per_word, np.log1p(words),
        total(lengths) / per_word])


def document_features(docs: DataFrame, id_col: str, text_col: str, lexicon: np.ndarray) -> DataFrame:
    """``id_col, f`` (array of ``FEATURES``)."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("f", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            made = [dense_features(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], lexicon) for a, b in passes(offsets)]
            flat = np.concatenate(made).ravel() if made else np.zeros(0)
            f = pa.FixedSizeListArray.from_arrays(pa.array(flat), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), f], names=schema.names)

    return map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")), run, schema)


def learned_lexicon(labelled: DataFrame, text_col: str = "text", min_docs: int = 5, min_share: float = 0.6) -> np.ndarray:
    """Hashes of words and stems that mark toxic texts: of the texts that hold them at least ``min_docs`` are toxic, and at
    least the share ``min_share``.

    Each task counts the texts of each key before the shuffle.  The bound on labelled rows bounds what can be learned; nothing else does.
    """

    def run(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column(0))
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in passes(offsets):
                _, _, first, keys = _lexicon_keys(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                owner = np.tile(np.repeat(np.arange(a, b), np.diff(first)), len(keys))
                order = np.lexsort((owner, keys.ravel()))
                key, owner = keys.ravel()[order], owner[order]
                new = np.ones(len(key), dtype=bool)
                new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
                key, toxic = key[new], labels[owner[new]]
                key, at = np.unique(key, return_inverse=True)
                a_counts = np.bincount(at, weights=toxic, minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(a_counts), pa.array(np.bincount(at, minlength=len(key)) - a_counts)],
                    names=["key", "toxic", "clean"])

    found = (map_batches(labelled.select(F.col(text_col).cast("string").alias("text"), "label"), run, "key long, toxic long, clean long")
             .groupBy("key").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
             .where((F.col("key") != 0) & (F.col("a") >= min_docs) & (F.col("a") >= min_share * (F.col("a") + F.col("b"))))
             .select("key"))
    return np.array([r["key"] for r in found.collect()], dtype=np.int64).view(np.uint64)


class ToxicityModel:
    """Fitted lexicon, trees and calibration; all three are small and do not grow with the corpus."""

    def __init__(self, lexicon: np.ndarray, trees=None, calibration=None, constant: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def score(self, features: DataFrame, id_col: str) -> DataFrame:
        """``id_col, score`` from ``id_col, f``."""
        if self.trees is None:
            return features.select(id_col, F.lit(self.constant).alias("score"))
        raw = self.trees.transform(features.select(id_col, array_to_vector("f").alias("features")))
        raw = raw.select(id_col, vector_to_array("probability")[1].alias("raw"))
        level = self.calibration.transform(raw)
        # a thousandth of the trees' own probability orders texts on one step of the calibration
        return level.select(id_col, F.least(F.greatest(0.999 * F.col("level") + 0.001 * F.col("raw"), F.lit(0.0)), F.lit(1.0)).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_fit_rows: int = MAX_FIT_ROWS, rounds: int = 25, depth: int = 4) -> tuple[ToxicityModel, DataFrame]:
    """Fit on at most ``max_fit_rows`` labelled rows; also returns the features of all ``docs`` (written)."""
    part = F.pmod(F.xxhash64(id_col, F.lit("part")), F.lit(10))
    sample = written(labelled_sample(docs, labels, id_col, label_col, max_fit_rows).withColumn("part", part), "toxicity-labels")
    small = F.broadcast(sample)  # at most max_fit_rows rows
    # words are learned on one half and the trees on the other, so that the trees see how far the words can be trusted
    lexicon = learned_lexicon(docs.select(id_col, text_col).join(small, id_col).where("part < 5"), text_col)
    lexicon = np.unique(np.concatenate([_hash_words(SEED_WORDS), lexicon]))
    features = written(document_features(docs, id_col, text_col, lexicon), "toxicity-features")
    table = written(features.join(small, id_col).where("part >= 5")
                    .select(array_to_vector("f").alias("features"), "label", (F.col("part") >= 9).alias("calibrates")), "toxicity-fit")
    parts = {(r[0], r[1]): r[2] for r in table.groupBy("calibrates", "label").count().collect()}
    n = sum(parts.values())
    if len(parts) < 4:  # too few labels to fit and to calibrate
        toxic = sum(c for (_, label), c in parts.items() if label == 1.0)
        return ToxicityModel(lexicon, constant=toxic / n if n else 0.0), features
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, minInstancesPerNode=5, seed=7).fit(table.where("not calibrates"))
    raw = trees.transform(table.where("calibrates")).select(vector_to_array("probability")[1].alias("raw"), "label")
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="level").fit(raw)
    return ToxicityModel(lexicon, trees, calibration), features


def learnable(id_col: str = "doc_id") -> Column:
    """Rows whose labels may be learned: crc32 of the id as text is no multiple of 5 (a null id is held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 != 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", **fit_options) -> DataFrame:
    """``id_col, held_out, score, predicted`` for every row of ``docs``; labels of held-out rows are never read."""
    model, features = fit(docs, labels.where(learnable(id_col)), id_col, text_col, label_col, **fit_options)
    return model.score(features, id_col).select(
        id_col, (~learnable(id_col)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
