"""M7 / M8: K-Means with many starts that advance together.

The vectors are stored once, as blocks of some thousand rows dealt evenly to the cores, so that a pass reads matrices and converts no row, however many files or row groups
the table has.  All starts (every k and every seed) share each pass over the vectors: a task multiplies its blocks with the centres of all open starts at once and returns
one row with their sums, counts and costs; the rows are added up in the JVM and only ``centres x dimensions`` numbers reach the driver.  So an iteration is one job for
all starts, and a start leaves when its centres stop moving.

Seeding is greedy D-squared sampling as in the published setting's library: the next centre is, of ``2 + ln k`` candidates drawn with probability proportional to the
squared distance to the centres so far, the one that lowers the cost most.  A candidate is drawn as a weighted reservoir of one: every row has an exponential key, from a hash
of its id, the seed, the step and the trial, divided by its weight, and the smallest key wins.  So draws do not depend on how the rows are partitioned, and a step is two
jobs (draw, compare) for all starts.

A cluster that loses all its rows keeps its centre.  Ties go to the smaller cluster number, equal costs to the smaller seed.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.rowexpr import double
from marketlens.session import materialize

TOLERANCE = 1e-4
MAX_ITERATIONS = 300


@dataclass
class CentroidModel:
    """Centres (k x dimensions) and the cost of the rows they were fitted on."""

    centres: np.ndarray
    cost: float
    features: str = "features"
    iterations: int = 0

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.centres)

    def transform(self, df: DataFrame, output: str = "Cluster") -> DataFrame:
        """Number of the nearest centre, as one projection with the centres as literals."""
        x = F.col(self.features) if df.schema[self.features].dataType.typeName() == "array" else vector_to_array(self.features)
        far = [F.aggregate(F.zip_with(x, F.expr(f"array({', '.join(map(double, c))})"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
               for c in self.centres]
        d = F.array(*far)
        return df.withColumn(output, (F.array_position(d, F.array_min(d)) - 1).cast("int"))


#: Rows and numbers of one stored block of vectors at most.
BLOCK_ROWS, BLOCK_NUMBERS = 4096, 1 << 18
#: Distances in memory at once in a task; few, so that they stay in the processor's cache.
_CELLS = 1 << 18


def _pack_fn(block_rows: int, block_numbers: int):
    """Blocks of hashes and vectors from Arrow batches of ``h, x``."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vectors = batch.column(1)
            if vectors.null_count:
                raise ValueError("vectors to cluster are null")
            h, flat = batch.column(0).to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
            if len(set(np.diff(vectors.offsets.to_numpy()).tolist())) != 1:
                raise ValueError("vectors to cluster differ in length")
            x = flat.reshape(n, -1)
            size = max(1, min(block_rows, block_numbers // max(1, x.shape[1])))
            for a in range(0, n, size):
                yield pa.RecordBatch.from_arrays([pa.array([v[a:a + size].tobytes()], pa.binary()) for v in (h, x)], names=["h", "x"])
    return run


def _blocks_fn():
    """Task code: hashes and vectors of each stored block, the vectors in parts of about ``cells / width`` rows."""
    def blocks(batches, width, cells):
        for batch in batches:
            for h, x in zip(batch.column(0), batch.column(1)):
                h = np.frombuffer(h.as_buffer(), np.int64)
                x = np.frombuffer(x.as_buffer(), float).reshape(len(h), -1)
                step = max(64, cells // max(1, width))
                for a in range(0, len(h), step):
                    yield h[a:a + step], x[a:a + step]
    return blocks


def _told_fn():
    """Task code: one row of sums as a batch."""
    def told(sums):
        import pyarrow as pa
        return pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], names=["s"])
    return told


def _distance_fn():
    """Squared distances of centres (rows) to vectors (columns), both moved by a shift so that little cancels, less the vectors' own squared lengths."""
    def matrix(centres):
        return np.concatenate([-2.0 * centres, (centres * centres).sum(axis=1)[:, None]], axis=1)

    def extended(moved):
        return np.concatenate([moved, np.ones((len(moved), 1))], axis=1)

    def least(at_once, moved, square, k):
        """Smallest distance to each of several starts of ``k`` centres, given centre by centre (``matrix`` of all first centres, all second ones, ...)."""
        far = (at_once @ moved.T).reshape(k, -1, len(moved))
        return np.maximum(far.min(axis=0) + square, 0.0)
    return matrix, extended, least


def _summed(rows: DataFrame) -> np.ndarray:
    return rows.select(Summarizer.sum(array_to_vector("s")).alias("s")).first()["s"].toArray()


def stored_vectors(vectors: DataFrame, features: str = "features", key: str = "ID") -> DataFrame:
    """Blocks of ``h`` (hashes of the key) and ``x`` (vectors), written once for all passes and dealt evenly to the cores."""
    x = F.col(features) if vectors.schema[features].dataType.typeName() == "array" else vector_to_array(features)
    pairs = vectors.select(F.xxhash64(key).alias("h"), F.transform(x, lambda v: v.cast("double")).alias("x"))
    blocks = pairs.mapInArrow(_pack_fn(BLOCK_ROWS, BLOCK_NUMBERS), "h binary, x binary")
    return materialize(blocks.repartition(vectors.sparkSession.sparkContext.defaultParallelism))


def _moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and variance of the rows."""
    blocks, told = _blocks_fn(), _told_fn()

    def run_about(centre):
        def run(batches):
            n, first, second = 0, 0.0, 0.0
            for h, x in blocks(batches, 1, 1 << 12):
                moved = x - centre
                n, first, second = n + len(h), first + moved.sum(axis=0), second + (moved * moved).sum(axis=0)
            if n:
                yield told(np.concatenate([[n], first, second]))
        return run

    def sums(centre):
        flat = _summed(rows.mapInArrow(run_about(centre), "s array<double>"))
        return flat[0], flat[1:(len(flat) + 1) // 2] / flat[0], flat[(len(flat) + 1) // 2:] / flat[0]

    n, mean, _ = sums(0.0)
    _, off, square = sums(mean)
    return round(n), mean + off, square - off * off


def _uniform_fn():
    def uniform(h, seed, step, trial):
        """Numbers in (0, 1) from hashes (splitmix64)."""
        salt = (seed * 0x9E3779B97F4A7C15 + step * 0xD1B54A32D192ED03 + trial * 0x8CB92BA72F3D8DD7 + 1) % (1 << 64)
        with np.errstate(over="ignore"):
            z = h.view(np.uint64) + np.uint64(salt)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
            z = z ^ (z >> np.uint64(31))
        return ((z >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
    return uniform


def _by_size(starts: Mapping[tuple[int, int], np.ndarray], shift: np.ndarray) -> list[tuple[list, int, np.ndarray]]:
    """Starts with equally many centres: their names, that number, and the centres moved by ``shift`` (all first ones, all second ones, ...)."""
    sizes: dict[int, list] = {}
    for name, c in starts.items():
        sizes.setdefault(len(c), []).append(name)
    return [(names, k, np.stack([starts[s] - shift for s in names], axis=1).reshape(k * len(names), len(shift))) for k, names in sizes.items()]


def _draw(rows: DataFrame, starts: Mapping[tuple[int, int], np.ndarray], trials: Mapping[tuple[int, int], int], step: int, shift: np.ndarray) -> dict:
    """For every start, the rows its trials draw."""
    groups, names, count = _by_size(starts, shift), list(starts), dict(trials)
    place = {name: i for i, name in enumerate(names)}
    blocks, (matrix, extended, least), uniform = _blocks_fn(), _distance_fn(), _uniform_fn()
    width, cells = sum(len(c) for _, _, c in groups), _CELLS

    def run(batches):
        import pyarrow as pa
        best: dict[tuple[int, int], tuple] = {}
        at_once = [matrix(c) for _, _, c in groups]
        for h, x in blocks(batches, width, cells):
            moved = x - shift
            square, with_one = (moved * moved).sum(axis=1), extended(moved)
            for (members, k, _), m in zip(groups, at_once):
                weights = least(m, with_one, square, k) if k else np.ones((len(members), len(x)))
                for name, weight in zip(members, weights):
                    for t in range(count[name]):
                        i = place[name]
                        u = uniform(h, name[1] * 1000 + name[0], step, t)
                        own, limit = slice(None), best[i, t][0][0] if (i, t) in best else np.inf
                        if np.isfinite(limit):  # -ln u is no less than 1 - u: only these rows can have a smaller key
                            own = np.flatnonzero(1.0 - u <= limit * weight * (1 + 1e-9))
                            if not len(own):
                                continue
                        w, hashes = weight[own], h[own]
                        with np.errstate(divide="ignore"):
                            keys = np.where(w > 0, -np.log(u[own]) / w, np.inf)
                        j = int(keys.argmin())
                        found = (float(keys[j]), int(hashes[j]))
                        if (i, t) not in best or found < best[i, t][0]:
                            best[i, t] = (found, x[own][j].copy())
        if best:
            columns = zip(*[(i, t, *found, row) for (i, t), (found, row) in best.items()])
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), ty) for c, ty in zip(columns, types)], names=["i", "t", "key", "h", "x"])

    told = rows.mapInArrow(run, "i long, t long, key double, h long, x array<double>")
    first = told.groupBy("i", "t").agg(F.min(F.struct("key", "h", "x")).alias("m")).collect()
    return {(names[r["i"]], r["t"]): np.array(r["m"]["x"]) for r in first}


def _potentials(rows: DataFrame, starts: Mapping[tuple[int, int], np.ndarray], drawn: Mapping[tuple, np.ndarray], shift: np.ndarray) -> dict:
    """Cost of every start with each of its candidates added."""
    groups, order = _by_size(starts, shift), sorted(drawn)
    blocks, (matrix, extended, least), told = _blocks_fn(), _distance_fn(), _told_fn()
    candidates = {name: [j for j, (start, _) in enumerate(order) if start == name] for name in starts}
    points = np.stack([drawn[o] for o in order]) - shift
    width, cells = sum(len(c) for _, _, c in groups) + len(order), _CELLS

    def run(batches):
        sums = np.zeros(len(order))
        at_once, new = [matrix(c) for _, _, c in groups], matrix(points)
        for _, x in blocks(batches, width, cells):
            moved = x - shift
            square, with_one = (moved * moved).sum(axis=1), extended(moved)
            extra = least(new, with_one, square, 1)
            for (members, k, _), m in zip(groups, at_once):
                now = least(m, with_one, square, k) if k else np.full((len(members), len(x)), np.inf)
                for name, own in zip(members, now):
                    for j in candidates[name]:
                        sums[j] += np.minimum(extra[j], own).sum()
        yield told(sums)
    return dict(zip(order, _summed(rows.mapInArrow(run, "s array<double>"))))


def seed_centres(rows: DataFrame, starts: Sequence[tuple[int, int]], shift: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """First centres of every start ``(k, seed)``."""
    d = len(shift)
    centres = {s: np.zeros((0, d)) for s in starts}
    for step in range(max(k for k, _ in starts)):
        growing = {s: c for s, c in centres.items() if s[0] > step}
        trials = {s: 1 if step == 0 else 2 + int(math.log(s[0])) for s in growing}
        drawn = _draw(rows, growing, trials, step, shift)
        cost = _potentials(rows, growing, drawn, shift) if step else dict.fromkeys(drawn, 0.0)
        for s in growing:
            t = min((t for name, t in drawn if name == s), key=lambda t: (cost[s, t], t))
            centres[s] = np.concatenate([centres[s], drawn[s, t][None]])
    return centres


def _advance(rows: DataFrame, starts: Mapping[tuple[int, int], np.ndarray], shift: np.ndarray) -> dict:
    """For every start: sums around ``shift`` and counts by cluster, cost, and sums of squared lengths around ``shift`` by cluster."""
    groups, d = _by_size(starts, shift), len(shift)
    blocks, (matrix, extended, _), told = _blocks_fn(), _distance_fn(), _told_fn()
    width, cells = max(len(c) for _, _, c in groups), _CELLS

    def run(batches):
        at_once = [matrix(c) for _, _, c in groups]
        sums = [np.zeros((len(c), d + 2)) for _, _, c in groups]
        cost = [np.zeros(len(members)) for members, _, _ in groups]
        for _, x in blocks(batches, width, cells):
            moved = x - shift
            with_one, square = extended(moved), (moved * moved).sum(axis=1)
            added = np.concatenate([with_one, square[:, None]], axis=1)
            for g, (members, k, c) in enumerate(groups):
                far = (at_once[g] @ with_one.T).reshape(k, len(members), len(x))
                nearest, at = far[0].copy(), np.zeros(far[0].shape, np.int32)
                for i in range(1, k):
                    np.copyto(at, i, where=far[i] < nearest)  # ties to the smaller number
                    np.minimum(nearest, far[i], out=nearest)
                cost[g] += np.maximum(nearest + square, 0.0).sum(axis=1)
                for i in range(k):
                    np.equal(at, i, out=far[i], casting="unsafe")  # from here on: whether a row is a member
                sums[g] += far.reshape(len(c), -1) @ added
        yield told(np.concatenate([*(s.ravel() for s in sums), *cost]))

    flat = _summed(rows.mapInArrow(run, "s array<double>"))
    out, at, costs = {}, 0, (d + 2) * sum(len(c) for _, _, c in groups)
    for members, k, c in groups:
        own = flat[at:at + len(c) * (d + 2)].reshape(k, len(members), d + 2)
        for j, name in enumerate(members):
            out[name] = own[:, j, :d], np.rint(own[:, j, d]), float(flat[costs + j]), own[:, j, d + 1]
        at, costs = at + len(c) * (d + 2), costs + len(members)
    return out


def lloyd(rows: DataFrame, first: Mapping[tuple[int, int], np.ndarray], shift: np.ndarray, max_iter: int = MAX_ITERATIONS, tolerance: float = 0.0) -> dict:
    """Final centres and iterations of every start; an iteration is one job for all starts still moving."""
    centres = {s: np.array(c, dtype=float) for s, c in first.items()}
    rounds = dict.fromkeys(centres, 0)
    moving = set(centres)
    for _ in range(max_iter):
        if not moving:
            break
        for s, (sums, counts, _, _) in _advance(rows, {s: centres[s] for s in sorted(moving)}, shift).items():
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None] + shift, centres[s])
            step = float(((new - centres[s]) ** 2).sum())
            centres[s], rounds[s] = new, rounds[s] + 1
            if step <= tolerance:
                moving.discard(s)
    return {s: (centres[s], rounds[s]) for s in centres}


@dataclass
class ManyStarts:
    """Best model for each k, with the cluster sums that the silhouette needs."""

    models: dict[int, CentroidModel]
    sums: dict[int, tuple]
    rows: DataFrame
    shift: np.ndarray

    def silhouettes(self) -> dict[int, float]:
        """Mean silhouette (squared distances, see ``segment.silhouette_sq``) for every k, in one job."""
        ks, shift = list(self.models), self.shift
        centres = {k: self.models[k].centres for k in ks}
        stats = {k: (self.sums[k][0], self.sums[k][1], self.sums[k][3]) for k in ks}
        blocks, (matrix, extended, _), told = _blocks_fn(), _distance_fn(), _told_fn()
        width, cells = max(ks), _CELLS

        def run(batches):
            total, n = np.zeros(len(ks)), 0
            at_once = {k: matrix(c - shift) for k, c in centres.items()}
            for _, x in blocks(batches, width, cells):
                moved = x - shift
                xx, with_one = (moved * moved).sum(axis=1), extended(moved)
                n += len(x)
                for j, k in enumerate(ks):
                    sums, counts, square = stats[k]
                    at = (with_one @ at_once[k].T).argmin(axis=1)
                    apart = counts[None] * xx[:, None] - 2 * moved @ sums.T + square[None]
                    own, i = counts[at], np.arange(len(x))
                    a = apart[i, at] / np.maximum(own - 1, 1)
                    mean = np.where(counts[None] > 0, apart / np.maximum(counts, 1)[None], np.inf)
                    mean[i, at] = np.inf
                    b = mean.min(axis=1)
                    larger = np.maximum(a, b)
                    score = np.where((own > 1) & np.isfinite(b) & (larger > 0), (b - a) / np.where(larger > 0, larger, 1.0), 0.0)
                    total[j] += score.sum()
            yield told(np.array([*total.tolist(), float(n)]))
        flat = _summed(self.rows.mapInArrow(run, "s array<double>"))
        return {k: float(flat[j] / flat[-1]) for j, k in enumerate(ks)}


def fit_many(vectors: DataFrame, ks: Sequence[int], seed: int = 42, n_init: int = 10, max_iter: int = MAX_ITERATIONS, features: str = "features",
             key: str = "ID", tolerance: float = TOLERANCE) -> ManyStarts:
    """Best of ``n_init`` starts for every k, all advancing in the same passes.

    ``tolerance`` is relative to the mean variance of the features, as in the published setting's library.
    """
    rows = stored_vectors(vectors, features, key)
    if rows.isEmpty():
        raise ValueError("no vectors to cluster")
    _, shift, variance = _moments(rows)
    starts = [(int(k), s) for k in ks for s in range(seed, seed + n_init)]
    found = lloyd(rows, seed_centres(rows, starts, shift), shift, max_iter, tolerance * float(variance.mean()))
    last = _advance(rows, {s: c for s, (c, _) in found.items()}, shift)
    models, sums = {}, {}
    for k in ks:
        best = min((s for s in starts if s[0] == k), key=lambda s: (last[s][2], s[1]))
        models[k] = CentroidModel(found[best][0], last[best][2], features, found[best][1])
        sums[k] = last[best]
    return ManyStarts(models, sums, rows, shift)
