"""Nearest neighbours through randomly rotated one-bit codes.

A vector minus the corpus mean has a length and a direction.  The direction is padded to
``bits`` dimensions, rotated at random, and only signs are kept: the code.  With the stored
correction ``a`` (inner product of the direction with its own code) the inner product of a query's direction with
that of the vector is estimated without bias as ``<code, query> / a``, and the error stays below

    epsilon * sqrt((1 - a^2) / a^2) / sqrt(bits - 1)

but for a chance that falls fast with ``epsilon``.  From the estimate follow bounds of the distance.  In a block of
vectors, a query reranks with original vectors those whose lower bound does not exceed the k-th
smallest upper bound; so few vectors are read in full, and how many follows from the bounds, not from a fixed number.

All vectors are indexed and every query meets all codes, block by block: blocks of vectors and of queries have bounded
mean sizes, and a block gives its k best only.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id;
vectors of different length are never compared; a row with the query's id is the query's own; repeated rows are candidates
each, but a query that is repeated is answered once; different vectors under one id are queries of their own, each with its ``k``
neighbours and ranks 1 to ``k`` under that id; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import map_batches, parts_for, ship, written
from marketlens.llm.vectors import by_dimension, matrix, means, takes_part

#: Code bits for each dimension.
BITS_PER_DIMENSION = 4
#: Width of the error bounds.
EPSILON = 2.2
#: Mean rows of a block of vectors and of a block of queries.
BLOCK_ROWS, QUERY_ROWS = 8192, 1024

_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(dimension: int, seed: int = 17) -> np.ndarray:
    """The first ``dimension`` columns of a random rotation in code space."""
    if (dimension, seed) not in _ROTATIONS:
        bits = code_bits(dimension)
        q, r = np.linalg.qr(np.random.default_rng(seed + dimension).standard_normal((bits, bits)))
        _ROTATIONS[dimension, seed] = (q * np.sign(np.diag(r)))[:, :dimension]
    return _ROTATIONS[dimension, seed]


def code_bits(dimension: int) -> int:
    return max(64, -(-dimension * BITS_PER_DIMENSION // 8) * 8)


def encode(vectors: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, lengths and corrections."""
    apart = vectors - mean
    length = np.linalg.norm(apart, axis=1)
    turned = (apart / np.maximum(length, 1e-300)[:, None]) @ rotation(vectors.shape[1]).T
    code = turned > 0
    correction = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return np.packbits(code, axis=1), length, np.where(length > 0, correction, 1.0)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, dict[int, np.ndarray]]:
    """``id, dimension, code, length, correction, vector`` of all vectors that take part (written), and the means."""
    valid = vectors.where(takes_part(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    centre = means(valid, "vector")

    def run(batches):
        for batch in batches:
            for d, rows in by_dimension(batch.column(1)).items():
                some = batch.take(pa.array(rows))
                code, length, correction = encode(matrix(some.column(1)), centre[d])
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(rows), d), pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()),
                     pa.array(length), pa.array(correction), some.column(1)],
                    names=["id", "dimension", "code", "length", "correction", "vector"])

    schema = "id long, dimension int, code binary, length double, correction double, vector array<double>"
    return written(map_batches(valid, run, schema), "codes"), centre


def _best(query_ids, queries, ids, vectors, codes, length, correction, mean, k: int, epsilon: float):
    """The k best of one block of vectors for each query: (query place, vector place, distance)."""
    bits = code_bits(vectors.shape[1])
    apart = queries - mean
    reach = np.linalg.norm(apart, axis=1)
    turned = (apart / np.maximum(reach, 1e-300)[:, None]) @ rotation(vectors.shape[1]).T
    signs = (np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(bits))
    inner = (turned.astype(np.float32) @ signs.T) / correction
    error = epsilon * np.sqrt(np.maximum(1 - correction ** 2, 0) / correction ** 2) / np.sqrt(bits - 1)
    out = []
    for i in range(len(queries)):
        other = ids != query_ids[i]
        base = length ** 2 + reach[i] ** 2
        cross = 2 * length * reach[i]
        low = base - cross * np.minimum(inner[i] + error, 1)
        high = np.where(other, base - cross * np.maximum(inner[i] - error, -1), np.inf)
        limit = np.partition(high, k - 1)[k - 1] if len(high) > k else np.inf
        some = np.flatnonzero(other & (low <= limit))
        squares = np.zeros(len(some))
        for gap in (vectors[some] - queries[i]).T:  # added in order of the components, as plain SQL does
            squares += gap * gap
        distance = np.sqrt(squares)
        first = np.lexsort((ids[some], distance))[:k]
        out.append((np.full(len(first), i), some[first], distance[first]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def search(index: DataFrame, centre: dict[int, np.ndarray], queries: Column, k: int = 10, epsilon: float = EPSILON,
           block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every distinct indexed id and vector for which ``queries`` holds, its ``k`` nearest others.

    ``queries`` is a condition on ``id``; ``score`` is the Euclidean distance of the original vectors.
    """
    ship(index.sparkSession)
    asked = (index.where(queries).select("id", F.xxhash64("vector").alias("query"), "dimension", "vector")
             .dropDuplicates(["id", "query"]))
    n, n_asked = index.count(), asked.count()
    blocks, query_blocks = parts_for(n, block_rows), parts_for(n_asked, query_rows)
    some = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    left = index.withColumn("block", block(blocks, "id")).withColumn("query_block", some(query_blocks))
    right = asked.withColumn("query_block", block(query_blocks, "id", "query")).withColumn("block", some(blocks))

    def run(vectors: pa.Table, questions: pa.Table) -> pa.Table:
        names = ["query_id", "query", "vec_id", "score"]
        if not vectors.num_rows or not questions.num_rows:
            return pa.table([*[pa.array([], pa.int64())] * 3, pa.array([], pa.float64())], names=names)
        d = vectors.column("dimension")[0].as_py()
        ids, query_ids = vectors.column("id").to_numpy(), questions.column("id").to_numpy()
        codes = np.frombuffer(b"".join(vectors.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        at_query, at, distance = _best(query_ids, matrix(questions.column("vector")), ids, matrix(vectors.column("vector")), codes,
                                       vectors.column("length").to_numpy(), vectors.column("correction").to_numpy(), centre[d], k, epsilon)
        query = questions.column("query").to_numpy()
        return pa.table([pa.array(query_ids[at_query]), pa.array(query[at_query]), pa.array(ids[at]), pa.array(distance)], names=names)

    keys = ["dimension", "block", "query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, query long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
