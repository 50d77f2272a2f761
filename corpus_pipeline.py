"""Cleaning and packing of a text corpus in five stages.

Each stage is a function of (spark, docs, sf_dir) and calls one operator; its result is written as Parquet and read
again as the next one's documents.  All stages but the last return the columns of ``documents``:

1. quality: documents whose posterior quality is below one half go;
2. near duplicates: of each group of documents with a Jaccard similarity of 0.8 over five-word shingles, the smallest id stays, and
   repeated rows of it once;
3. repeats: strings of 50 bytes that also start in a document with a smaller id are cut out of the text;
4. secrets: findings are replaced by a mark;
5. packing: every text becomes sequences in length buckets and token-budget batches.

Documents keep their row after stages 3 and 4, even with an empty text; a null text is then empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import jaccard_trie, packing, quality, secret_ledger, suffix_dedup
from marketlens.llm.common import read_table, written


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_trie.similar_sets(docs, k=5, percent=80, with_row=True)
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("row").alias("__row")).distinct()
    rows = docs.join(stay, jaccard_trie.row_hash("doc_id", "text") == F.col("__row")).drop("__row")
    return rows.dropDuplicates(["doc_id", "text"])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rows = docs.withColumn("__rest", F.struct(F.lit(0).alias("__none"), *rest))  # names of the input cannot clash with those made here
    cut = suffix_dedup.remove_repeats(rows, least=50, carry=("__rest",), with_text=True)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return cut.select(*[made.get(c, F.col("__rest").getField(c)).alias(c) for c in docs.columns])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_ledger.redact(docs).withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.word_lengths(docs))


STAGES = [
    ("quality", keep_good_documents),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: The classifier, the join and the dynamic program are not for SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
