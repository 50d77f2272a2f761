"""Packing into optimal length buckets.

Sequences are grouped by length so that padding costs least: dynamic programming
over the histogram of all lengths chooses the bucket boundaries (each bucket pads
to its longest length).  Inside each bucket, sequences fill batches of a token
budget one after the other: a batch holds ``budget // bucket_len`` sequences.

The histogram has at most ``max_len`` rows, whatever the corpus has, so the program
runs on the driver.  Places inside a bucket are counted without bringing a bucket
together: sequences are dealt by hash into cells of a bounded mean size, ranked inside
their cell, and shifted by the number of sequences in the cells before (by groups of cells, then in the group).  The hash takes a number of the row, so
that rows with null or equal ids are dealt like any others.

A text longer than ``max_len`` becomes several sequences, none dropped.

Edge cases: a null or empty text is a sequence of 0 tokens that takes no room
(``bucket``, ``bucket_len``, ``batch`` and ``slot`` are null); rows that repeat are
packed each; a null id is packed like any other; with an empty table there
are no rows.  Ties in length fall into the same bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import parts_for, text_or_empty, written

#: A token here is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_tokens``: number of words of each whole text (0 for null)."""
    return docs.select(id_col, F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("n_tokens"))


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Boundaries (upper lengths, ascending) of at most ``n_buckets`` buckets with the least padding.

    Sequences of ``lengths[i]`` tokens occur ``counts[i]`` times; ``lengths`` ascends.
    Of plans that cost the same, the one with fewer buckets is taken, then the lower last boundaries.
    """
    m = len(lengths)
    if m == 0:
        return []
    lengths, counts = lengths.astype(object), counts.astype(object)  # whole numbers of any size: sums stay exact
    seqs, tokens = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])

    def cost(j: int) -> np.ndarray:
        """Padding of the bucket of lengths i..j-1, for every i < j."""
        return lengths[j - 1] * (seqs[j] - seqs[:j]) - (tokens[j] - tokens[:j])

    costs = [None] + [cost(j) for j in range(1, m + 1)]
    best = np.array([0] + [c[0] for c in costs[1:]], dtype=object)  # one bucket
    cuts: list[list[int]] = [[0] * (m + 1)]
    totals = [best[m]]
    for k in range(1, min(n_buckets, m)):
        now, cut = best.copy(), [0] * (m + 1)
        for j in range(k + 1, m + 1):
            whole = best[k:j] + costs[j][k:]
            i = int(np.argmin(whole))
            now[j], cut[j] = whole[i], i + k
        best = now
        cuts.append(cut)
        totals.append(best[m])
    k = int(np.argmin(np.array(totals, dtype=object)))
    ends, j = [], m
    while j > 0:
        ends.append(int(lengths[j - 1]))
        j, k = cuts[k][j], k - 1
    return ends[::-1]


def pack(lengths: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", n_buckets: int = 16,
         max_len: int = 2048, budget: int = 65536, cell_rows: int = 4096) -> DataFrame:
    """Bucket, batch and slot of every sequence.

    Returns ``id_col, chunk, start, n_tokens, bucket, bucket_len, batch, slot``: tokens
    ``[start, start + n_tokens)`` of the text are sequence ``chunk``, in place ``slot`` of batch
    ``batch`` of the bucket, padded to ``bucket_len``.  ``budget`` is the most padded tokens of a batch
    (a batch has one sequence at least).
    """
    n = F.greatest(F.coalesce(F.col(length_col), F.lit(0)).cast("long"), F.lit(0))
    last = F.greatest(F.ceil(n / max_len) - 1, F.lit(0)).cast("long")
    chunks = (lengths.select(F.col(id_col), n.alias("whole"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
              .select(id_col, "chunk", (F.col("chunk") * max_len).alias("start"),
                      F.least(F.col("whole") - F.col("chunk") * max_len, F.lit(max_len)).cast("long").alias("n_tokens"),
                      F.monotonically_increasing_id().alias("__row")))  # written, so it stays as it is
    chunks = written(chunks, "chunks")
    histogram = chunks.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("c")).orderBy("n_tokens").collect()
    ends = best_boundaries(np.array([r[0] for r in histogram]), np.array([r[1] for r in histogram]), n_buckets)

    if not ends:
        none = [F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("long").alias("bucket_len"),
                F.lit(None).cast("long").alias("batch"), F.lit(None).cast("long").alias("slot")]
        return chunks.select(id_col, "chunk", "start", "n_tokens", *none)

    upper = F.array(*[F.lit(e).cast("long") for e in ends])
    place = F.size(F.filter(upper, lambda e: e < F.col("n_tokens")))
    placed = chunks.where("n_tokens > 0").withColumn("bucket", place.cast("int"))
    n_cells = parts_for(sum(r[1] for r in histogram), cell_rows)
    placed = placed.withColumn("cell", F.pmod(F.xxhash64(id_col, "chunk", "__row"), F.lit(n_cells)))
    sizes = written(placed.groupBy("bucket", "cell").agg(F.count("*").alias("size")).withColumn("part", F.floor(F.col("cell") / cell_rows)), "cells")
    ahead = lambda *by: F.coalesce(F.sum("size").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("bucket", "part").agg(F.sum("size").alias("size")).select("bucket", "part", ahead("bucket", "part").alias("before"))
    offsets = (sizes.select("bucket", "part", "cell", ahead("bucket", "part", "cell").alias("inside")).join(parts, ["bucket", "part"])
               .select("bucket", "cell", (F.col("before") + F.col("inside")).alias("offset")))
    rank = F.row_number().over(Window.partitionBy("bucket", "cell").orderBy(id_col, "chunk", "n_tokens", "__row"))
    at = F.col("offset") + F.col("rank") - 1
    length = F.element_at(upper, F.col("bucket") + 1)
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / length))
    packed = (placed.withColumn("rank", rank).join(offsets, ["bucket", "cell"])
              .select(id_col, "chunk", "start", "n_tokens", "bucket", length.alias("bucket_len"),
                      F.floor(at / room).cast("long").alias("batch"), F.pmod(at, room).cast("long").alias("slot")))
    empty = chunks.where("n_tokens = 0").select(
        id_col, "chunk", "start", "n_tokens", F.lit(None).cast("int").alias("bucket"),
        F.lit(None).cast("long").alias("bucket_len"), F.lit(None).cast("long").alias("batch"), F.lit(None).cast("long").alias("slot"))
    return packed.unionByName(empty)
