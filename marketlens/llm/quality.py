"""Document quality by hierarchical empirical Bayes.

Three layers of evidence meet in one posterior for each document:

1. a document classifier (logistic regression over surface features) gives ``p``, the
   probability that the document is good, and ``log odds(p)``;
2. the *host* the document comes from has a Beta posterior over its share of
   good documents, shrunk towards the corpus mean;
3. the *path* below the host has a Beta posterior shrunk towards its host.

Prior strengths are not chosen but estimated: the spread of group means beyond what chance
would give fixes how many documents a prior is worth (method of moments).  Sites with
few documents therefore stay near their parent, and large ones speak for themselves.

A document's own evidence is taken out of its site before the two are
combined, so nothing counts twice:

    posterior odds = odds(p) * odds(path mean without the document) / odds(corpus mean)

All site statistics are sums over all documents, combined before the shuffle.

Edge cases: a null text is empty; a null host or path is a group of its own; labels that are null, or of
documents that are not there, do not count; several labels of one id are averaged; without labels of both
classes the classifier is neutral (``p`` 0.5) and everything is kept.  Rows that repeat
are scored each; ties in a score have no influence; extra columns are not carried; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import map_batches, passes, text_buffer, written
from marketlens.llm.words import white_space_table, word_hashes

FEATURES = ("log_words", "mean_word", "long_words", "upper", "digits", "marks", "pipes", "bangs", "odd_marks", "lines",
            "repeats", "distinct", "no_letter")

#: Most labelled documents the classifier is fitted on.
MAX_FIT_ROWS = 20_000


def _class_table(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=np.int64)
    table[[ord(c) for c in chars]] = 1
    return table


_UPPER = _class_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _class_table("0123456789")
_MARK = _class_table("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_ODD = _class_table("#$%&*+<=>@\\^_`{}~")
_LETTER = _class_table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = 1


def surface_features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text; all zero for an empty one."""
    n = len(offsets) - 1
    if n == 0 or len(buf) == 0:
        return np.zeros((n, len(FEATURES)))
    sizes = np.diff(offsets)
    some = sizes > 0
    at = offsets[:-1][some]

    def share(table: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        out[some] = np.add.reduceat(table[buf], at) / sizes[some]
        return out

    hashes, lengths, first = word_hashes(buf, offsets, white_space_table())
    words = np.diff(first)
    per_word = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), words)

    def word_mean(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=values, minlength=n) / per_word

    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(first, first[1:], strict=False)])
    letters = share(_LETTER)
    return np.column_stack([
        np.log1p(words), word_mean(lengths), word_mean(lengths > 25), share(_UPPER), share(_DIGIT), share(_MARK),
        share(_class_table("|")), share(_class_table("!")), share(_ODD), share(_class_table("\n")),
        word_mean(again), distinct / np.sqrt(per_word), np.where(some, 1 - letters, 0)])


def _site(name: Column) -> Column:
    """Key of a host or path: a null one is a group of its own, apart from the empty one."""
    return F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit(""))


def _site_name(key: str) -> Column:
    return F.when(F.col(key) != "", F.substring(key, 2, (1 << 31) - 1))


def document_features(docs: DataFrame, text_col: str, host: Column, path: Column, carry: list[str], text_at: int | None = None) -> DataFrame:
    """The columns in ``carry`` with ``__host``, ``__path`` and ``__f`` (array of ``FEATURES``).

    ``text_at`` is the place of the text in the struct that ``carry`` begins with; the text then goes to the tasks once.
    """
    schema = T.StructType([docs.schema[c] for c in carry] + [
        T.StructField("__host", T.StringType()), T.StructField("__path", T.StringType()), T.StructField("__f", T.ArrayType(T.DoubleType()))])
    kept = len(carry) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(kept) if text_at is None else batch.column(0).field(text_at))
            made = [surface_features(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in passes(offsets)]
            flat = np.concatenate(made).ravel() if made else np.zeros(0)
            f = pa.FixedSizeListArray.from_arrays(pa.array(flat), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], f], names=schema.names)

    text = [F.col(text_col).cast("string").alias("__text")] if text_at is None else []
    narrow = docs.select(*carry, _site(host).alias("__host"), _site(path).alias("__path"), *text)
    return map_batches(narrow, run, schema)


def url_host(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def url_path(url: Column) -> Column:
    """First step of the path."""
    return F.element_at(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("/")), "/"), 2)


def labelled_sample(ids: DataFrame, labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """At most ``most`` labelled ids in hash order: ``id_col, label`` (0.0 or 1.0)."""
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(id_col).agg(F.when(F.avg(label_col) >= 0.5, 1.0).otherwise(0.0).alias("label")))
    return (known.join(ids.select(id_col).distinct(), id_col, "left_semi")
            .orderBy(F.xxhash64(id_col), id_col).limit(most))


def document_log_odds(features: DataFrame, labels: DataFrame, id_col: str, label_col: str,
                      max_fit_rows: int = MAX_FIT_ROWS) -> Column:
    """The fitted classifier as an expression over ``__f``: log odds that a document is good."""
    sample = written(labelled_sample(features, labels, id_col, label_col, max_fit_rows), "quality-labels")
    if sample.select("label").distinct().count() < 2:
        return F.lit(0.0)
    # at most max_fit_rows rows are broadcast
    fit = features.join(F.broadcast(sample), id_col).select(array_to_vector("__f").alias("features"), "label")
    model = LogisticRegression(regParam=1e-3, maxIter=50, standardization=True).fit(written(fit, "quality-fit"))
    score = F.lit(float(model.intercept))
    for i, w in enumerate(model.coefficients.toArray()):
        score = score + F.col("__f")[i] * F.lit(float(w))
    return score


def prior_strength(mean: float, groups: float, total: float, squares: float, between: float, within: float) -> float:
    """Documents a Beta prior around ``mean`` is worth.

    ``between`` is the sum of n*(group mean - parent mean)^2 over ``groups`` groups, ``squares`` the sum of n^2/total, ``within``
    the variance of documents inside groups.  Little spread beyond chance means a strong prior.
    """
    room = total - squares
    spread = (between - groups * within) / room if room > 0 else 0.0
    if spread <= 1e-9:
        return 1e6
    return float(min(1e6, max(1.0, mean * (1 - mean) / spread - 1)))


@dataclass
class QualityModel:
    """Classifier, site sums (``__host, __path, n_path, s_path, n_host, s_host``), corpus mean and the strengths of both priors."""

    log_odds: Column
    sites: DataFrame
    mean: float
    host_strength: float
    path_strength: float

    def apply(self, features: DataFrame, threshold: float = 0.5) -> DataFrame:
        """``features`` with ``p_document, host_mean, path_mean, posterior, keep``; the means leave the row's own evidence out."""
        mean = min(max(self.mean, 1e-6), 1 - 1e-6)
        p = F.col("p_document")
        host = (F.lit(self.host_strength * mean) + F.col("__s_host") - p) / (F.lit(self.host_strength) + F.col("__n_host") - 1)
        path = (self.path_strength * F.col("host_mean") + F.col("__s_path") - p) / (F.lit(self.path_strength) + F.col("__n_path") - 1)
        inside = F.least(F.greatest(F.col("path_mean"), F.lit(1e-6)), F.lit(1 - 1e-6))
        shift = F.log(inside / (1 - inside)) - float(np.log(mean / (1 - mean)))
        return (features.withColumn("__z", self.log_odds).drop("__f")
                .withColumn("p_document", 1 / (1 + F.exp(-F.col("__z"))))
                .join(self.sites, ["__host", "__path"])
                .withColumn("host_mean", host).withColumn("path_mean", path)
                .withColumn("posterior", 1 / (1 + F.exp(-(F.col("__z") + shift))))
                .withColumn("keep", F.col("posterior") >= threshold)
                .drop("__z", "__n_path", "__s_path", "__n_host", "__s_host"))


def fit_quality(features: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_fit_rows: int = MAX_FIT_ROWS) -> QualityModel:
    """Fit the classifier, then sum its evidence over all documents by path and host."""
    log_odds = document_log_odds(features, labels, id_col, label_col, max_fit_rows)
    p = 1 / (1 + F.exp(-log_odds))
    paths = written(features.select("__host", "__path", p.alias("p")).groupBy("__host", "__path").agg(
        F.count("*").cast("double").alias("__n_path"), F.sum("p").alias("__s_path"), F.sum(F.col("p") * F.col("p")).alias("q")),
        "quality-paths")
    hosts = paths.groupBy("__host").agg(F.sum("__n_path").alias("__n_host"), F.sum("__s_path").alias("__s_host"))
    sites = paths.join(hosts, "__host")
    total = paths.agg(F.sum("__n_path").alias("n"), F.sum("__s_path").alias("s"), F.sum("q").alias("q")).first()
    plain = sites.drop("q")
    if not total["n"]:
        return QualityModel(log_odds, plain, 0.5, 1.0, 1.0)
    n, mean = total["n"], total["s"] / total["n"]
    m_path, m_host = F.col("__s_path") / F.col("__n_path"), F.col("__s_host") / F.col("__n_host")
    h = hosts.agg(F.count("*").alias("k"), F.sum(F.col("__n_host") ** 2).alias("n2"),
                  F.sum(F.col("__n_host") * (m_host - mean) ** 2).alias("b")).first()
    x = sites.agg(F.count("*").alias("k"), F.sum(F.col("__n_path") ** 2 / F.col("__n_host")).alias("n2"),
                  F.sum(F.col("__n_path") * (m_path - m_host) ** 2).alias("b")).first()
    var = max(total["q"] / n - mean ** 2, 1e-12)
    return QualityModel(log_odds, plain, mean, prior_strength(mean, max(h["k"] - 1, 0), n, h["n2"] / n, h["b"], var),
                        prior_strength(mean, max(x["k"] - h["k"], 0), n, x["n2"], x["b"], var))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", host: Column | None = None, path: Column | None = None,
                  threshold: float = 0.5, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """Posterior quality of every row of ``docs``.

    ``host`` and ``path`` default to the columns ``source`` and ``lang``; for web pages pass
    ``url_host(url)`` and ``url_path(url)``.  Returns ``id_col, host, path, p_document, host_mean, path_mean, posterior, keep``.
    """
    where = (F.col("source") if host is None else host, F.col("lang") if path is None else path)
    features = written(document_features(docs, text_col, *where, [id_col]), "quality-features")
    model = fit_quality(features, labels, id_col, label_col, max_fit_rows)
    return model.apply(features, threshold).select(
        id_col, _site_name("__host").alias("host"), _site_name("__path").alias("path"), "p_document", "host_mean", "path_mean", "posterior", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
              host: Column | None = None, path: Column | None = None, threshold: float = 0.5,
              max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that ``score_quality`` keeps; texts meet only the small table of sites."""
    where = (F.col("source") if host is None else host, F.col("lang") if path is None else path)
    features = written(document_features(docs, text_col, *where, [id_col]), "quality-features")
    model = fit_quality(features, labels, id_col, label_col, max_fit_rows)
    whole = docs.withColumn("__row", F.struct(*docs.columns))  # names of the input cannot clash with those made here
    text_at = next((i for i, f in enumerate(docs.schema) if f.name == text_col and f.dataType == T.StringType()), None)
    return model.apply(document_features(whole, text_col, *where, ["__row"], text_at), threshold).where("keep").select("__row.*")
