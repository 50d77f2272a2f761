"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned on a bounded sample: principal axes first, then turns that bring the rotated
data close to the corners of a cube (iterative quantisation), so that the bits are balanced and small angles change few of them.
Every vector gets a code of at most 64 bits, the signs of its projections.  Codes are cut into pieces, each a hash table: four of 16 bits, three of 21 or two of
32, whichever makes least work for groups as large as the table's.

*No pair is lost.*  Unit vectors with cosine ``c`` are at most ``sqrt(2 - 2 c)`` apart, and their projections no further, so in some
piece the squared distance is at most the ``1 / pieces`` part of ``2 - 2 c``.  There, bits differ only where the projections of both
add up to no more than that, so one of the two can turn the other's key into its own with bits whose squares
add up to half of it.  Every vector probes all such keys in every table.  Pairs that meet go on to the comparison with
the original vectors unless signs and sizes of the projections already tell that they are too far apart.

Tables use as many bits of a piece as cost least: more give smaller buckets, but more keys to probe.  That is read from the
sample, and changes the cost only.  Vectors far from all axes (longer than 64 and without main directions, or close to
their mean) need short keys and meet many others.

Equal vectors of one label are one entry with a count; links of an entry count all its copies, but copies are
never paired with each other.

The sample for the rotation is at most ``SAMPLE_ROWS`` vectors in hash order.

Edge cases: vectors that are null, zero or hold null or non-finite components and rows with a null label link with nothing; so
do vectors of different length; rows that repeat are linked copies; a null id is never the smallest;
an empty table gives no rows; columns besides the three named are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import map_batches, written
from marketlens.llm.components import connected_components
from marketlens.llm.vectors import by_dimension, matrix, takes_part

#: Most vectors of one length that the rotation is learned on.
SAMPLE_ROWS = 20_000
#: Bits of a code are a multiple of this (if there are that many); a piece has at least these bits and at most twice as many.
PIECE = 16
_ROUNDS = 40
#: Sample rows that choose the key length, and rows whose probes are made at a time.
_TRIED, _SLICE = 500, 1000


def learn_rotation(sample: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimension x bits) of iterative quantisation on unit vectors."""
    d = sample.shape[1]
    bits = min(64, d // PIECE * PIECE or d)
    mean = sample.mean(axis=0)
    apart = sample - mean
    _, vectors = np.linalg.eigh(apart.T @ apart)
    axes = vectors[:, ::-1][:, :bits]
    projected = apart @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    for _ in range(_ROUNDS):
        u, _, v = np.linalg.svd(np.where(projected @ turn >= 0, 1.0, -1.0).T @ projected)
        turn = (u @ v).T
    return mean, axes @ turn


def projections(vectors: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Of the vectors' directions; no two are further apart than the directions are."""
    return (vectors / np.linalg.norm(vectors, axis=1)[:, None] - mean) @ axes


def packed(bits: np.ndarray) -> np.ndarray:
    """Up to 64 bits a row as one number; unused bits are 0."""
    return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def widest(cosine: float) -> float:
    """Greatest squared distance of directions with this cosine, rounded up."""
    return max(2 - 2 * cosine, 0.0) + 1e-9


def probes(piece: np.ndarray, budget: float):
    """After each bit of the piece: the row and the key of every probe, all keys of the bits so far whose turned bits cost up to ``budget``."""
    rows = np.arange(len(piece))
    keys, spent = np.zeros(len(piece), dtype=np.int64), np.zeros(len(piece))
    yield rows, keys
    for i in range(piece.shape[1]):
        own = (piece[:, i] >= 0).astype(np.int64)
        cost = spent + piece[rows, i] ** 2
        turned = cost <= budget
        keys = np.concatenate([keys | own[rows] << i, (keys | (1 - own[rows]) << i)[turned]])
        rows, spent = np.concatenate([rows, rows[turned]]), np.concatenate([spent, cost[turned]])
        yield rows, keys


def pieces_of(projected: np.ndarray, n: int) -> list[np.ndarray]:
    return np.array_split(projected, n, axis=1)


def key_bits(projected: np.ndarray, far: float, group: float) -> tuple[int, int]:
    """Number of pieces, and how many of their bits make keys: those with the fewest probes and meetings, for groups of this many entries."""
    tried, best = projected[:_TRIED], None
    most = max(1, projected.shape[1] // PIECE)
    for n in range(most, max(1, -(-projected.shape[1] // (2 * PIECE))) - 1, -1):
        pieces = pieces_of(tried, n)
        width = min(p.shape[1] for p in pieces)
        budget, here = far / n / 2, None
        for w, made in enumerate(zip(*[probes(p[:, :width], budget) for p in pieces], strict=True)):
            asked = sum(len(rows) for rows, _ in made) / len(tried)  # in all tables
            cost = asked * (1 + group / 2 ** w)
            if here is None or cost < here[0]:
                here = cost, n, w
            if asked > here[0]:
                break
        if best is None or here[0] < best[0]:
            best = here
    return best[1], best[2]


def with_codes(entries: DataFrame, cosine: float, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``entry, label, d, code, large, most, held, asked``, by a rotation learned for each vector length.

    ``large`` marks the bits whose projections are large, ``most`` is how much of them pairs may differ in (``candidate_pairs``);
    ``held`` are the entry's keys in all tables, ``asked`` those to probe.
    """
    fitted, far = {}, widest(cosine)
    for row in entries.groupBy(F.size("vector").alias("d")).agg((F.count("*") / F.count_distinct("label")).alias("group")).collect():
        sample = (entries.where(F.size("vector") == row["d"]).orderBy(F.xxhash64("entry"), "entry").limit(sample_rows)
                  .select("vector").toArrow().column(0))
        x = matrix(sample)
        mean, axes = learn_rotation(x / np.linalg.norm(x, axis=1)[:, None])
        projected = projections(x, mean, axes)
        size = max(float(np.median(np.abs(projected))), 1e-6)
        n_pieces, width = key_bits(projected, far, row["group"])
        fitted[row["d"]] = mean, axes, size, min(int(far / size ** 2 + 1e-6), 1000), far / n_pieces / 2, n_pieces, width

    def run(batches):
        for batch in batches:
            for d, rows in by_dimension(batch.column(2)).items():
                mean, axes, size, most, budget, n_pieces, width = fitted[d]
                for a in range(0, len(rows), _SLICE):
                    some = batch.take(pa.array(rows[a: a + _SLICE]))
                    n, projected = some.num_rows, projections(matrix(some.column(2)), mean, axes)
                    owners, keys, held = [], [], []
                    for table, piece in enumerate(pieces_of(projected, n_pieces)):
                        *_, (owner, key) = probes(piece[:, :width], budget)
                        owners.append(owner)
                        keys.append(key | table << 32)
                        held.append(keys[-1][:n])  # the first of every row is its own key
                    owner, key = np.concatenate(owners), np.concatenate(keys)
                    turn = np.argsort(owner, kind="stable")
                    lists = lambda sizes, flat: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [*some.columns[:2], pa.array(np.full(n, d), pa.int32()), pa.array(packed(projected >= 0)),
                         pa.array(packed(np.abs(projected) >= size)), pa.array(np.full(n, most), pa.int32()),
                         lists(np.full(n, len(held)), np.stack(held, axis=1).ravel()), lists(np.bincount(owner, minlength=n), key[turn])],
                        names=["entry", "label", "d", "code", "large", "most", "held", "asked"])

    schema = (f"entry long, label {entries.schema['label'].dataType.simpleString()}, d int, code long, large long, most int, "
              "held array<long>, asked array<long>")
    return written(map_batches(entries.select("entry", "label", "vector"), run, schema), "vector-codes")


def candidate_pairs(coded: DataFrame) -> DataFrame:
    """``a, b`` with ``a < b``: entries that meet in a table and may be near (those of several labels or lengths only if hashes of keys collide).

    A bit that differs puts the two projections apart by the size of a large one if one of them is large, by twice that if both are.
    """
    def side(keys, name):
        return (coded.select(F.col("entry").alias(name), "label", "d", F.col("code").alias(f"code_{name}"), F.col("large").alias(f"large_{name}"),
                             "most", F.explode(keys).alias("key"))
                .withColumn("key", F.xxhash64("label", "d", "key")).drop("label", "d"))
    differ = F.col("code_x").bitwiseXOR(F.col("code_y"))
    one = F.bit_count(differ.bitwiseAND(F.col("large_x").bitwiseXOR(F.col("large_y"))))
    both = F.bit_count(differ.bitwiseAND(F.col("large_x").bitwiseAND(F.col("large_y"))))
    return (side("held", "x").drop("most").join(side("asked", "y"), "key")
            .where((F.col("x") != F.col("y")) & (one + 4 * both <= F.col("most")))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def linked_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   cosine: float = 0.98, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row: links to vectors of its label with at least ``cosine``."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    able = takes_part("vector") & F.col("label").isNotNull()
    rows = rows.withColumn("entry", F.when(able, F.xxhash64("label", "vector")))
    entries = written(rows.where("entry is not null").groupBy("entry").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("id").alias("least")), "entries")
    pairs = candidate_pairs(with_codes(entries, cosine, sample_rows))
    side = lambda s: entries.select(F.col("entry").alias(s), F.col("label").alias(f"l{s}"), F.col("vector").alias(f"v{s}"), F.col("copies").alias(f"n{s}"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    near = dot("va", "vb") / (F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb")))
    links = written(pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("la") == F.col("lb")) & (near >= cosine)).select("a", "b", "na", "nb"), "vector-links")
    degree = (links.select(F.col("a").alias("entry"), F.col("nb").alias("n"))
              .unionByName(links.select(F.col("b").alias("entry"), F.col("na").alias("n")))
              .groupBy("entry").agg(F.sum("n").alias("others")))
    groups = connected_components(links).select(F.col("node").alias("entry"), "component")
    known = (entries.select("entry", "copies", "least").join(degree, "entry", "left").join(groups, "entry", "left")
             .withColumn("component", F.coalesce("component", "entry")))
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "component").select(
        "entry", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), "component_id")
    return (rows.select("id", "entry").join(known, "entry", "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "id").cast("long").alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))
