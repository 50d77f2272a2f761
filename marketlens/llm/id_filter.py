"""A bounded bitmap of hashed ids, to leave rows out before they are shuffled for a join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import map_batches

#: Bits of the map: 8 MB are broadcast, whatever the number of ids.
BITS = 26
_BLOCK_BITS = 14


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)


def bitmap(ids: DataFrame, id_col: str) -> np.ndarray:
    """Bits set for the hashes of ``ids``; tasks set their own and blocks are joined in the shuffle."""

    def mark(batches):
        bits = np.zeros(1 << BITS, dtype=bool)
        for batch in batches:
            bits[_bit(batch.column(0).to_numpy(zero_copy_only=False))] = True
        blocks = np.packbits(bits).reshape(-1, 1 << _BLOCK_BITS >> 3)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([blocks[i].tobytes() for i in some], pa.binary())],
                                         names=["block", "bits"])

    def join(batches):
        joined: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                had = joined.setdefault(block, np.zeros(len(bits), dtype=np.uint8))
                had |= np.frombuffer(bits, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(joined), pa.int64()), pa.array([b.tobytes() for b in joined.values()], pa.binary())],
                                         names=["block", "bits"])

    schema = "block long, bits binary"
    hashed = ids.select(F.xxhash64(id_col).alias("h"))
    blocks = map_batches(map_batches(hashed, mark, schema).repartition("block"), join, schema)
    whole = np.zeros((1 << BITS >> _BLOCK_BITS, 1 << _BLOCK_BITS >> 3), dtype=np.uint8)
    for row in blocks.toLocalIterator():  # 2**BITS bits in all
        whole[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return whole.ravel()


def may_hold(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows of ``rows`` whose id may be in ``ids`` (column of the same name): all that are, and few others while ids are fewer than bits."""
    held = rows.sparkSession.sparkContext.broadcast(bitmap(ids, id_col))
    columns = rows.columns

    def run(batches):
        for batch in batches:
            at = _bit(batch.column(len(columns)).to_numpy(zero_copy_only=False))
            keep = (held.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            yield batch.select(columns).filter(pa.array(keep.astype(bool)))

    return map_batches(rows.withColumn("__hash", F.xxhash64(id_col)), run, rows.schema)
