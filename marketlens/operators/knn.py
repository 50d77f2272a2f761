"""K-nearest-neighbour classification in one pass over the rows to classify.

Distances between all rows and all training rows grow with the product of both, and in some 38 dimensions no index
prunes them.  A caller may therefore fit the classifier on a bounded number of labelled rows: ``max_train_rows`` of them, those that
come first in the order of a hash of their key (all of them if there are fewer).  Counts by hash say where that order is cut, so the
driver gets those rows only, whatever the number of tasks.  That matrix is the model; it
is broadcast, its size known beforehand, and every Arrow batch of other rows is compared with it in slices.  No row is
shuffled, copied or joined.

Without a bound (``max_train_rows=None``) every labelled row counts.  As many as ``MAX_TRAIN_ROWS`` are broadcast as above.  More are packed into blocks,
the rows to classify too, and every block of the ones meets every block of the others in a nested loop of partitions of known size; only the neighbours
found travel on.  A task leaves out a pair of rows by a lower bound of its distance: the main axes of the block, in single precision less its rounding.

Slices of a matrix product choose the neighbours: the training rows fall into groups, and no neighbour is farther than the ``k``-th smallest of
the groups' smallest distances.  Distances of the rows within that are then taken again from the differences, so that ties are exact
and go to the smaller training key.  Within the rows that fit, the result equals brute force.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.operators.split import BUCKET_SHIFT, key_hash, key_hash_sql
from marketlens.session import materialize

#: Labelled rows that are broadcast at most, and that a bounded classifier is fitted on.
MAX_TRAIN_ROWS = 20_000
#: Seed of the hash order that picks them.
PICK_SEED = 7
#: Distances in memory at once in a task; few, so that they stay in the processor's cache.
_CELLS = 1_000_000
#: Rows of a block to compare with and of a block to classify, and numbers in a block at most.
TRAIN_BLOCK, QUERY_BLOCK, BLOCK_NUMBERS = 8192, 2048, 1 << 19
#: Labelled rows, their numbers, and rows to classify of a task at most, when not all labelled rows are broadcast.
TRAIN_PART, PART_NUMBERS, QUERY_PART = 300_000, 1 << 24, 16_384
#: Share of the variance in the axes that lower bounds are taken from.
_AXES = 0.95
#: Relative error of a squared distance in single precision, generously.
_ROUNDING = 1e-5


def _before(c: str, value) -> Column:
    """Whether a column comes before ``value`` in ascending order (nulls first)."""
    return F.lit(False) if value is None else F.col(c).isNull() | (F.col(c) < F.lit(value))


def fitted_rows(train: DataFrame, key: str = "ID", max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """At most ``max_train_rows`` training rows, those that come first in hash order of the key.

    A sorted limit would send that many rows of every task to the driver.  Instead, counts by hash bucket tell the bucket of the last
    row wanted, and counts by key in that bucket tell its key: each one row.
    """
    if max_train_rows <= 0:
        return train.limit(max_train_rows)
    place = train.select(key_hash(key, PICK_SEED).alias("_h"), F.col(key).alias("_key")).withColumn("_b", F.shiftright("_h", BUCKET_SHIFT))

    def crossing(rows: DataFrame, by: list[str], want: int):
        """Group of ``rows`` in which the row at place ``want`` lies, with the rows up to its end."""
        upto = F.sum("_cnt").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
        counted = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_cnt")).withColumn("_upto", upto)
        return counted.where((F.col("_upto") >= want) & (F.col("_upto") - F.col("_cnt") < want)).first()

    bucket = crossing(place, ["_b"], max_train_rows)
    if bucket is None:
        return train
    need = max_train_rows - (bucket["_upto"] - bucket["_cnt"])
    last = crossing(place.where(F.col("_b").eqNullSafe(F.lit(bucket["_b"]))), ["_h", "_key"], need)
    rows = train.withColumn("_h", key_hash(key, PICK_SEED))
    same = F.col("_h").eqNullSafe(F.lit(last["_h"]))
    earlier = _before("_h", last["_h"]) | (same & _before(key, last["_key"]))
    at = same & F.col(key).eqNullSafe(F.lit(last["_key"]))
    if last["_upto"] == need:
        return rows.where(earlier | at).drop("_h")
    return rows.where(earlier).unionByName(rows.where(at).limit(need - (last["_upto"] - last["_cnt"]))).drop("_h")


def fitted_rows_sql(source: str, key: str = "ID", max_train_rows: int = MAX_TRAIN_ROWS) -> str:
    return f"SELECT * FROM {source} ORDER BY {key_hash_sql(key, PICK_SEED)}, {key} LIMIT {max_train_rows}"


def _nearest_fn(model, k: int, key: str, keep: list[str]):
    def run(batches):
        tid, tv, label = model.value
        norms = (tv * tv).sum(axis=1)
        step = max(1, _CELLS // max(1, len(tid)))
        moved = np.ascontiguousarray(np.concatenate([-2.0 * tv, norms[:, None]], axis=1).T)
        groups = max(k, 16, int(np.sqrt(k * len(tid))))  # of about as many rows as give few minima and few rows within the bound
        size = len(tid) // groups
        buffer = np.empty((step, len(tid)))
        for pdf in batches:
            for a in range(0, len(pdf), step):
                part = pdf.iloc[a:a + step]
                qv = np.stack(part["qv"].to_numpy()).astype(float)
                near = np.matmul(np.concatenate([qv, np.ones((len(qv), 1))], axis=1), moved, out=buffer[:len(qv)])  # squared distance less the query's own norm
                if near.shape[1] > k:
                    least = near[:, :size * groups].reshape(len(qv), size, groups).min(axis=1) if size > 1 else near
                    kth = np.partition(least, k - 1, axis=1)[:, k - 1]
                    slack = 1e-9 * (1.0 + norms.max() + (qv * qv).sum(axis=1))
                    rows, cols = np.divmod(np.flatnonzero(near <= (kth + slack)[:, None]), near.shape[1])
                else:
                    rows, cols = (x.ravel() for x in np.indices(near.shape))
                diff = qv[rows] - tv[cols]
                d2 = np.einsum("ij,ij->i", diff, diff)
                order = np.lexsort((tid[cols], d2, rows))
                rows, cols, d2 = rows[order], cols[order], d2[order]
                rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") + 1
                rows, cols, d2, rank = (x[rank <= k] for x in (rows, cols, d2, rank))
                if label is None:
                    yield pd.DataFrame({"qid": part[key].to_numpy()[rows], "tid": tid[cols], "d2": d2, "rank": rank.astype("int32")})
                else:
                    score = np.bincount(rows, weights=label[cols], minlength=len(part)) / np.bincount(rows, minlength=len(part))
                    yield part[[key, *keep]].assign(score=score, prediction=(score > 0.5).astype("int32"))
    return run


def _model(train: DataFrame, key: str, vec: str, label: str | None, max_train_rows: int):
    cols = [F.col(key).alias("tid"), F.col(vec).alias("tv")] + ([F.col(label).cast("double").alias("y")] if label else [])
    rows = fitted_rows(train, key, max_train_rows).select(*cols).collect()  # max_train_rows rows
    if not rows:
        raise ValueError("no labelled rows to compare with")
    tid = np.array([r["tid"] for r in rows], dtype=np.int64)
    tv = np.array([r["tv"] for r in rows], dtype=float)
    return train.sparkSession.sparkContext.broadcast((tid, tv, np.array([r["y"] for r in rows]) if label else None))


def knn_neighbours(train: DataFrame, test: DataFrame, k: int = 15, key: str = "ID", vec: str = "vec",
                   max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(query key ``qid``, neighbour key ``tid``, squared distance ``d2``, rank 1..k)."""
    model = _model(train, key, vec, None, max_train_rows)
    return test.select(key, F.col(vec).alias("qv")).mapInPandas(
        _nearest_fn(model, k, key, []), "qid long, tid long, d2 double, rank int")


def _pack_fn(rows: int, numbers: int, meta: int, names: list[str]):
    """Blocks from Arrow batches whose last column is the vector: the first ``meta`` columns as lists, the others as bytes."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vectors = batch.column(batch.num_columns - 1)
            if vectors.null_count or len(set(np.diff(vectors.offsets.to_numpy()).tolist())) != 1:
                raise ValueError("vectors are null or differ in length")
            x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            size = -(-n // -(-n // max(1, min(rows, numbers // max(1, x.shape[1])))))  # blocks of a batch are about equal
            for a in range(0, n, size):
                lists = [pa.array([c.slice(a, size).to_pylist()], pa.list_(c.type)) for c in batch.columns[:meta]]
                plain = [c.slice(a, size).to_numpy(zero_copy_only=False) for c in batch.columns[meta:-1]]
                yield pa.RecordBatch.from_arrays(lists + [pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in [*plain, x[a:a + size]]], names=names)
    return run


def _meet_fn(k: int):
    """The ``k`` nearest of the labelled rows met in this task, for each block ``b`` of rows to classify: squared distances, keys and labels as bytes."""
    def axes(tv):
        """Main axes of the rows, from the longest, with most of their variance."""
        size, vectors = np.linalg.eigh(np.cov(tv, rowvar=False).reshape(tv.shape[1], -1)) if len(tv) > 1 else (np.ones(tv.shape[1]), np.eye(tv.shape[1]))
        share = np.cumsum(size[::-1]) / max(size.sum(), 1e-300)
        return vectors[:, ::-1][:, :int(np.searchsorted(share, _AXES)) + 1]

    def advance(state, qv, tv, tid, y):
        best, key, label = state
        centre = tv.mean(axis=0)
        q, t = qv - centre, tv - centre
        qn, tn = (q * q).sum(axis=1), (t * t).sum(axis=1)
        turn = axes(t) if np.isfinite(t).all() else np.eye(t.shape[1])
        q, t = q @ turn, t @ turn
        qa, ta = (q * q).sum(axis=1), (t * t).sum(axis=1)
        kind = np.float32 if max(qn.max(), tn.max()) < 1e30 else np.float64
        # near = |t|^2 - 2qt, less its rounding; more columns, to whole words of the mask, are never near
        moved = np.zeros((t.shape[1] + 1, -(-len(t) // 8) * 8), kind)
        moved[:-1, :len(t)] = -2.0 * t.T
        moved[-1] = np.inf
        moved[-1, :len(t)] = ta - _ROUNDING * tn - 1e-30
        step = max(1, _CELLS // 2 // moved.shape[1])
        buffer = np.empty((step, moved.shape[1]), kind)
        for a in range(0, len(q), step):
            b = min(len(q), a + step)
            near = np.matmul(np.concatenate([q[a:b], np.ones((b - a, 1))], axis=1).astype(kind), moved, out=buffer[:b - a])
            worst = best[a:b, -1]
            if len(t) > k and np.isinf(worst).any():  # some k rows tell how far the neighbours are at most
                some = np.argpartition(near[:, :len(t)], k - 1, axis=1)[:, :k]
                worst = np.fmin(worst, ((qv[a:b, None] - tv[some]) ** 2).sum(axis=2).max(axis=1))
            worst = worst * (1 + 1e-12)  # sums of the same terms may differ in their last bits
            least = np.nextafter((worst - qa[a:b] + _ROUNDING * qn[a:b]).astype(kind), kind(np.inf))
            mask = near <= least[:, None]
            words = np.flatnonzero(mask.view(np.uint64))
            place, bit = np.nonzero(mask.reshape(-1, 8)[words])
            rows, cols = np.divmod(words[place] * 8 + bit, moved.shape[1])
            real = cols < len(t)
            rows, cols = rows[real], cols[real]
            diff = qv[a + rows] - tv[cols]
            d2 = np.einsum("ij,ij->i", diff, diff)
            close = d2 <= worst[rows]
            rows, cols, d2 = rows[close], cols[close], d2[close]
            if not len(rows):
                continue
            own = np.unique(rows)
            at = np.concatenate([np.repeat(own, k), rows])
            far, ids, ones = (np.concatenate([old[a + own].ravel(), new]) for old, new in ((best, d2), (key, tid[cols]), (label, y[cols])))
            order = np.lexsort((ids, far, at))
            first = order[np.searchsorted(at[order], own)[:, None] + np.arange(k)]
            best[a + own], key[a + own], label[a + own] = far[first], ids[first], ones[first]

    def run(batches):
        import pyarrow as pa
        states: dict = {}
        for batch in batches:
            for b, q, tid, y, t in zip(*batch.columns):
                tid, y = np.frombuffer(tid.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), float)
                tv = np.frombuffer(t.as_buffer(), float).reshape(len(tid), -1)
                qv = np.frombuffer(q.as_buffer(), float).reshape(-1, tv.shape[1])
                if b.as_py() not in states:
                    states[b.as_py()] = np.full((len(qv), k), np.inf), np.full((len(qv), k), np.iinfo(np.int64).max), np.zeros((len(qv), k))
                advance(states[b.as_py()], qv, tv, tid, y)
        for b, state in states.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), *[pa.array([s.tobytes()], pa.binary()) for s in state]], names=["b", "far", "ids", "ones"])
    return run


def _vote_fn(k: int):
    """Share of positive labels among the ``k`` nearest that any task found, for the rows of a block."""
    def run(table):
        import pyarrow as pa
        far, ids, ones = (np.concatenate([np.frombuffer(v.as_buffer(), kind).reshape(-1, k) for v in table.column(c)], axis=1)
                          for c, kind in (("far", float), ("ids", np.int64), ("ones", float)))
        order = np.lexsort((ids, far), axis=1)[:, :k]
        known = np.isfinite(np.take_along_axis(far, order, axis=1))
        score = (np.take_along_axis(ones, order, axis=1) * known).sum(axis=1) / np.maximum(known.sum(axis=1), 1)
        return pa.table({"b": table.column("b").slice(0, 1), "score": pa.array([score.tolist()], pa.list_(pa.float64()))})
    return run


def _classify_blocks(train: DataFrame, test: DataFrame, n_train: int, k: int, key: str, vec: str, label: str, keep: tuple[str, ...]) -> DataFrame:
    """:func:`knn_classify` by all of ``train``, block against block."""
    n_test, cores = test.count(), train.sparkSession.sparkContext.defaultParallelism
    width = train.select(F.size(vec)).first()[0]
    pieces = max(-(-n_train // TRAIN_PART), -(-n_train * width // PART_NUMBERS))
    parts = max(1, -(-n_test // QUERY_PART), min(-(-n_test // QUERY_BLOCK), -(-3 * cores // pieces)))
    held = train.select(F.coalesce(F.col(key).cast("long"), F.lit(-2 ** 63)).alias("tid"), F.col(label).cast("double").alias("y"), F.col(vec).alias("t"))
    held = held.mapInArrow(_pack_fn(TRAIN_BLOCK, BLOCK_NUMBERS, 0, ["tid", "y", "t"]), "tid binary, y binary, t binary").repartition(pieces)
    names = [f"m{i}" for i in range(1 + len(keep))]
    kinds = ["bigint", *[test.schema[c].dataType.simpleString() for c in keep]]
    asked = test.select(F.col(key).cast("long"), *keep, F.col(vec).alias("q"))
    asked = asked.mapInArrow(_pack_fn(QUERY_BLOCK, BLOCK_NUMBERS, len(names), [*names, "q"]), "".join(f"{m} array<{t}>, " for m, t in zip(names, kinds)) + "q binary")
    asked = asked.withColumn("b", F.monotonically_increasing_id()).repartition(parts)
    held, asked = held.persist(StorageLevel.DISK_ONLY), asked.persist(StorageLevel.DISK_ONLY)
    try:
        pairs = asked.select("b", "q").crossJoin(held.hint("shuffle_replicate_nl")).select("b", "q", "tid", "y", "t")
        near = pairs.mapInArrow(_meet_fn(k), "b long, far binary, ids binary, ones binary")
        scores = near.groupBy("b").applyInArrow(_vote_fn(k), "b long, score array<double>")
        rows = asked.drop("q").join(scores, "b").select(F.inline(F.arrays_zip(*names, "score")))
        return materialize(rows.select(*[F.col(m).alias(c) for m, c in zip(names, (key, *keep))], "score", (F.col("score") > 0.5).cast("int").alias("prediction")))
    finally:
        held.unpersist()
        asked.unpersist()


def knn_classify(train: DataFrame, test: DataFrame, k: int = 15, key: str = "ID", vec: str = "vec",
                 label: str = "label", keep: tuple[str, ...] = (), max_train_rows: int | None = None) -> DataFrame:
    """(key, the columns in ``keep``, score = share of positive neighbours, prediction = majority class).

    All rows of ``train`` may be neighbours, or with ``max_train_rows`` the first ones in hash order of the key.
    """
    if max_train_rows is None:
        n_train = train.count()
        if n_train > MAX_TRAIN_ROWS:
            return _classify_blocks(train, test, n_train, k, key, vec, label, keep)
        max_train_rows = MAX_TRAIN_ROWS
    model = _model(train, key, vec, label, max_train_rows)
    kept = "".join(f"{c} {test.schema[c].dataType.simpleString()}, " for c in keep)
    return test.select(key, *keep, F.col(vec).alias("qv")).mapInPandas(
        _nearest_fn(model, k, key, list(keep)), f"{key} long, {kept}score double, prediction int")
