"""Compressing vectors to codes over Hilbert-sorted flat blocks.

Components become whole numbers (``floor(scale * x)``), a vector becomes equal consecutive parts, and every part
position has a codebook of a few entries, refined in rounds: each part goes to its nearest entry, and each entry moves to the
floor of the mean of its parts.  A vector's code is the list of its parts' entries.

No round looks at every (part, entry) pair.  Vectors lie in chunks; in a chunk the parts of one position are sorted along a
Hilbert curve and cut into flat blocks of ``BLOCK_ROWS`` parts, each stored with its box (componentwise minimum and maximum) and its
sum.  Each round, the entry with the least largest distance to a box is its pivot; an entry that is farther than the pivot from every place of the
box is nearest to none of the block's parts, and the others are the block's shortlist.  A block with a shortlist of one adds its stored sum and is not read further;
for the rest small kernels compare the parts with their shortlist in 64-bit whole numbers.  So results are exact, ties included.

Chunks are written once and scanned by every round; a task returns one sum for each entry, added up in the shuffle, and only the
codebooks reach the driver.  Codes come back in the order of the chunk's rows: no vector is shuffled.

Edge cases: vectors that are null or hold null or non-finite components are left out, all zeros are not.  Codebooks belong to one vector
length, the commonest (the shorter of equally common ones); kept vectors of another length, or with a component whose squared distances
could leave 64 bits (about 2^27 after scaling at 64 dimensions), have null ``code`` and ``error`` and train nothing.  Lengths that the number of parts does
not divide are filled up with zeros.  Rows with null ids come last among the smallest ids, equal ids in the order of their vectors, and
repeated rows count each.  With fewer rows than entries there is an entry for each row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import map_batches, written

#: Parts of a flat block; a chunk is an Arrow batch of rows (10,000 rows or 64 MB at most by Spark's settings).
BLOCK_ROWS = 32
#: Totals by label are broadcast up to this many rows, and joined with salted labels beyond.
BROADCAST_LABELS = 100_000
_SALTS = 32


def is_finite(vector: str) -> Column:
    """Not null and without null or non-finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & good, F.lit(False))


def hilbert_order(points: np.ndarray) -> np.ndarray:
    """Row order along a Hilbert curve through the points' own box (Skilling's transform, all rows at once).

    The order only decides how tight the boxes are.  Columns after the 62nd are not looked at.
    """
    points = points[:, :62]
    n, dims = points.shape
    if n == 0 or dims == 0:
        return np.arange(n)
    bits = max(1, min(16, 62 // dims))
    low = points.min(axis=0)
    width = np.maximum(points.max(axis=0) - low + 1, 1).astype(np.float64)
    x = [np.minimum((points[:, i] - low[i]) / width[i] * (1 << bits), (1 << bits) - 1).astype(np.int64) for i in range(dims)]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(flip, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[dims - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | (((x[i] ^ turn) >> b) & 1)
    return np.argsort(key, kind="stable")


class Blocks:
    """The parts of one position in one chunk: sorted, cut into blocks, with boxes and sums."""

    def __init__(self, order: np.ndarray, parts: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.order, self.parts, self.low, self.high, self.sums = order, parts, low, high, sums

    @classmethod
    def build(cls, parts: np.ndarray) -> Blocks:
        order = hilbert_order(parts)
        ordered = parts[order]
        room = -len(parts) % BLOCK_ROWS  # the last block is filled up with its last part, which changes no box
        full = np.concatenate([ordered, np.repeat(ordered[-1:], room, axis=0)]).reshape(-1, BLOCK_ROWS, parts.shape[1])
        sums = np.add.reduceat(ordered, np.arange(0, len(parts), BLOCK_ROWS), axis=0)
        return cls(order, full, full.min(axis=1), full.max(axis=1), sums)

    def sizes(self) -> np.ndarray:
        n = np.full(len(self.parts), BLOCK_ROWS)
        n[-1] -= len(self.parts) * BLOCK_ROWS - len(self.order)
        return n

    def shortlists(self, entries: np.ndarray) -> np.ndarray:
        """For each block and entry, whether the entry can be nearest to a part of the block."""
        low, high, e = self.low[:, None, :], self.high[:, None, :], entries[None]
        far = np.maximum(np.abs(e - low), np.abs(e - high))
        pivot = entries[(far * far).sum(axis=2).argmin(axis=1)][:, None, :]
        # distance to the pivot less distance to the entry is linear in the part: largest at a corner of the box
        at_low = (low - pivot) ** 2 - (low - e) ** 2
        at_high = (high - pivot) ** 2 - (high - e) ** 2
        return np.maximum(at_low, at_high).sum(axis=2) >= 0

    def compare(self, blocks: np.ndarray, listed: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of every part of ``blocks``, whose shortlists have one length."""
        names = np.nonzero(listed[blocks])[1].reshape(len(blocks), -1)  # ascending: the first smallest wins ties
        parts, chosen = self.parts[blocks], entries[names]
        d = np.zeros((len(blocks), BLOCK_ROWS, names.shape[1]), np.int64)
        for i in range(parts.shape[2]):
            gap = parts[:, :, None, i] - chosen[:, None, :, i]
            d += gap * gap
        at = d.argmin(axis=2)
        return np.take_along_axis(names, at, axis=1), np.take_along_axis(d, at[:, :, None], axis=2)[:, :, 0]

    def add_up(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Sum and number of the parts nearest to each entry, and how many parts were compared one by one."""
        sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
        listed, sizes, compared = self.shortlists(entries), self.sizes(), 0
        length = listed.sum(axis=1)
        whole = np.flatnonzero(length == 1)
        to = listed[whole].argmax(axis=1)
        np.add.at(sums, to, self.sums[whole])
        np.add.at(counts, to, sizes[whole])
        for s in np.unique(length[length > 1]):
            blocks = np.flatnonzero(length == s)
            nearest, _ = self.compare(blocks, listed, entries)
            real = np.arange(BLOCK_ROWS)[None] < sizes[blocks][:, None]
            to, parts = nearest[real], self.parts[blocks][real]
            compared += len(to)
            counts += np.bincount(to, minlength=len(entries))
            for i in range(parts.shape[1]):  # whole numbers: added exactly
                np.add.at(sums[:, i], to, parts[:, i])
        return sums, counts, compared

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of every part, in the order of the chunk's rows."""
        listed = self.shortlists(entries)
        length = listed.sum(axis=1)
        nearest = np.zeros((len(self.parts), BLOCK_ROWS), np.int64)
        distance = np.zeros_like(nearest)
        for s in np.unique(length):
            blocks = np.flatnonzero(length == s)
            nearest[blocks], distance[blocks] = self.compare(blocks, listed, entries)
        n = len(self.order)
        out = np.empty(n, np.int64), np.empty(n, np.int64)
        out[0][self.order], out[1][self.order] = nearest.ravel()[:n], distance.ravel()[:n]
        return out


def _packed(arrays: list[np.ndarray], kind) -> bytes:
    return b"".join(np.ascontiguousarray(a, dtype=kind).tobytes() for a in arrays)


def _chunk_row(rows: pa.RecordBatch, vectors: np.ndarray, n_parts: int, owner_type: pa.DataType) -> dict:
    blocks = [Blocks.build(p) for p in np.split(vectors, n_parts, axis=1)]
    owners = pa.StructArray.from_arrays([rows.column(0), rows.column(1)], fields=list(owner_type))
    return {"owners": pa.ListArray.from_arrays(pa.array([0, len(owners)], pa.int32()), owners),
            "places": _packed([b.order for b in blocks], np.int32), "parts": _packed([b.parts for b in blocks], np.int32),
            "low": _packed([b.low for b in blocks], np.int32), "high": _packed([b.high for b in blocks], np.int32),
            "sums": _packed([b.sums for b in blocks], np.int64)}


def _read_blocks(row: dict, n: int, n_parts: int, width: int) -> list[Blocks]:
    n_blocks = -(-n // BLOCK_ROWS)

    def get(name: str, kind, *shape: int) -> np.ndarray:
        return np.frombuffer(row[name], dtype=kind).astype(np.int64).reshape(n_parts, *shape)
    places, parts = get("places", np.int32, n), get("parts", np.int32, n_blocks, BLOCK_ROWS, width)
    low, high, sums = (get(name, kind, n_blocks, width) for name, kind in (("low", np.int32), ("high", np.int32), ("sums", np.int64)))
    return [Blocks(places[p], parts[p], low[p], high[p], sums[p]) for p in range(n_parts)]


def _whole_numbers(column, dimension: int, filled: int, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    vectors = np.zeros((len(column), filled), np.int64)
    vectors[:, :dimension] = np.floor(scale * flat.reshape(len(column), dimension))
    return vectors


def store_chunks(fit: DataFrame, dimension: int, n_parts: int, scale: int) -> DataFrame:
    """Chunks of ``(id, label, vector)`` rows with their blocks, written once."""
    filled = -(-dimension // n_parts) * n_parts

    def run(batches):
        for rows in batches:
            if rows.num_rows:
                owner_type = pa.struct([pa.field("id", rows.schema.field(0).type), pa.field("label", rows.schema.field(1).type)])
                made = _chunk_row(rows, _whole_numbers(rows.column(2), dimension, filled, scale), n_parts, owner_type)
                yield pa.RecordBatch.from_arrays([made["owners"]] + [pa.array([made[c]], pa.binary()) for c in ("places", "parts", "low", "high", "sums")],
                                                 names=["owners", "places", "parts", "low", "high", "sums"])

    types = {f.name: f.dataType for f in fit.schema.fields}
    owner = T.StructType([T.StructField("id", types["id"]), T.StructField("label", types["label"])])
    schema = T.StructType([T.StructField("owners", T.ArrayType(owner)), *[T.StructField(c, T.BinaryType()) for c in ("places", "parts", "low", "high", "sums")]])
    return written(map_batches(fit.select("id", "label", "vector"), run, schema), "chunks")


def _round_sums(chunks: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of the parts of every entry; one row of numbers a task goes into the shuffle."""
    n_parts, k, width = books.shape

    def run(batches):
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((n_parts, k), np.int64)
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column(0).offsets))
            for row, n in zip(batch.drop_columns(["owners"]).to_pylist(), sizes):
                for p, blocks in enumerate(_read_blocks(row, int(n), n_parts, width)):
                    s, c, _ = blocks.add_up(books[p])
                    sums[p] += s
                    counts[p] += c
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([sums.ravel(), counts.ravel()])], pa.list_(pa.int64()))], names=["s"])

    told = map_batches(chunks, run, "s array<long>")
    total = told.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    flat = np.zeros(books.size + n_parts * k, dtype=object)
    for r in total:
        flat[r["i"]] = int(r["x"])
    return flat[:books.size].reshape(books.shape), flat[books.size:].reshape(n_parts, k)


def _coded(chunks: DataFrame, books: np.ndarray) -> DataFrame:
    """``id, label, code, error`` of every chunk's rows."""
    n_parts, _, width = books.shape

    def run(batches):
        for batch in batches:
            for i, row in enumerate(batch.drop_columns(["owners"]).to_pylist()):
                owners = batch.column(0)[i].values
                n = len(owners)
                found = [b.assign(books[p]) for p, b in enumerate(_read_blocks(row, n, n_parts, width))]
                digits = np.stack([f[0] for f in found], axis=1).astype(np.uint8).tobytes().hex()
                size = 2 * n_parts
                yield pa.RecordBatch.from_arrays(
                    [owners.field(0), owners.field(1), pa.array([digits[j * size:(j + 1) * size] for j in range(n)], pa.string()),
                     pa.array(sum(f[1] for f in found), pa.int64())], names=["id", "label", "code", "error"])

    owner = chunks.schema["owners"].dataType.elementType
    return map_batches(chunks, run, T.StructType([*owner.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, in decimals joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def _with_label_error(rows: DataFrame) -> DataFrame:
    totals = written(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label"), "label-errors")
    same = F.col("label").eqNullSafe(F.col("__label"))
    if totals.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(totals), same, "left").drop("__label")
    salted = totals.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64("id", "code"), F.lit(_SALTS)).cast("int"))
    return dealt.join(salted, same & (F.col("__part") == F.col("__salt")), "left").drop("__label", "__salt", "__part")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label_col: str = "label", n_parts: int = 8,
             n_entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray | None]:
    """Codes of all kept rows, and the codebooks (parts x entries x width; ``None`` without rows to learn from).

    The rows are ``id_col, code, error, label_col, label_error, codebooks_sha256``: two hex digits for each part's entry, the squared distance to
    the entries, and its sum over equal labels (null labels together).
    """
    if not 1 <= n_entries <= 256:
        raise ValueError("an entry's number is two hex digits")
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    kept = vectors.where(is_finite(vector)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), doubles.alias("vector"))
    lengths = kept.where(F.size("vector") > 0).groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    commonest = lengths.orderBy(F.desc("n"), "d").limit(1).collect()
    names = F.col("id").alias(id_col), "code", "error", F.col("label").alias(label_col)
    none = kept.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not commonest:
        return none.select(*names, F.lit(None).cast("long").alias("label_error"), F.lit(books_digest(np.zeros(0))).alias("codebooks_sha256")), None
    d = commonest[0]["d"]
    most = math.isqrt(2 ** 61 // d)
    fits = (F.size("vector") == d) & F.forall("vector", lambda x: F.abs(x) * scale < F.lit(float(most)))
    fit = kept.where(fits)
    smallest = fit.orderBy(F.asc_nulls_last("id"), "vector").limit(n_entries).collect()
    filled = -(-d // n_parts) * n_parts
    start = np.zeros((len(smallest), filled), np.int64)
    for i, r in enumerate(smallest):
        start[i, :d] = np.floor(scale * np.array(r["vector"]))
    books = np.stack(np.split(start, n_parts, axis=1))
    chunks = store_chunks(fit, d, n_parts, scale)
    for _ in range(rounds if len(smallest) else 0):
        sums, counts = _round_sums(chunks, books)
        moved = sums // np.maximum(counts, 1)[:, :, None]
        books = np.where((counts > 0)[:, :, None], moved, books.astype(object)).astype(np.int64)
    odd = kept.where(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    rows = written(_coded(chunks, books).unionByName(odd) if len(smallest) else odd, "codes")
    return _with_label_error(rows).select(*names, "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")), books
