"""Exact Jaccard self-join of word n-gram sets through prefix trees.

*Order.*  All n-grams get one global order, rare ones first: by a table of counters over the whole corpus,
then by hash.  Counters may be shared by several n-grams; that changes only how well the
order separates, not the result.

*Candidates.*  Two sets that reach the threshold share an n-gram among the first
``n - ceil(t n) + 1`` of each.  Sets with equal content are one set from the start.  N-grams
that few sets have there give pairs, and a pair survives if the n-grams it shares there and
all that may follow can reach the overlap needed.  An n-gram that many sets have gives a chain
through them in order of size, never all pairs; a task that meets such an n-gram
hands on one set for each step of size only.

*Join.*  Candidates fall into groups (connected components), whose sets are stored in a trie in the order
common-first, so that sets share long paths.  A probe walks the trie with the overlap so
far; a subtree is left when the overlap plus what can remain of either set is too small, when
its sizes cannot match, or when all its sets are already connected with the probe.  Overlaps are
exact, and so are the links.  Large groups are dealt into blocks of bounded size; every two blocks meet once.

Edge cases: null and empty texts have no n-gram, link with nothing and are their own component; a text
with fewer than ``k`` words has one n-gram, its whole sequence; rows that repeat are linked with each other;
rows that share an id but differ in text count as different texts; a null id is never the smallest, but its row is linked
like any other; an empty table gives no rows; ties in the order are broken by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import lookup, map_batches, mix64, passes, ship, text_buffer, tidied, written
from marketlens.llm.components import connected_components
from marketlens.llm.id_filter import may_hold
from marketlens.llm.words import shingle_hashes, shingle_sets, white_space_table, word_hashes

#: Counters of the global order: 2**COUNTER_BITS of 4 bytes are broadcast, whatever the corpus has.
COUNTER_BITS = 22
#: Rows of the counter table that travel as one.
_BLOCK = 1 << 14
#: Sets that share an early n-gram and are still paired one by one.
FEW = 48
#: N-grams of the sets that one trie holds at most (one set may have more).
BLOCK_NGRAMS = 1_500_000


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def count_ngrams(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """Occurrences of all n-grams of the corpus by counter (saturating).

    Tasks add up their part; blocks of counters are summed in the shuffle; the table has a fixed size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, dtype=np.uint32)
        for batch in batches:
            buf, offsets = text_buffer(batch.column(0))
            for a, b in passes(offsets):
                part = offsets[a:b + 1] - offsets[a]
                hashes, _, first = word_hashes(buf[offsets[a]:offsets[b]], part, white_space_table())
                slots, times = np.unique(_slot(shingle_hashes(hashes, first, k)[0]), return_counts=True)
                total[slots] += times.astype(np.uint32)
        total = np.minimum(total, 65535).astype(np.uint16).reshape(-1, _BLOCK)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([total[i].tobytes() for i in some], pa.binary())],
                                         names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                had = sums.setdefault(block, np.zeros(_BLOCK, dtype=np.uint32))
                had += np.frombuffer(counts.as_buffer(), dtype=np.uint16)
                np.minimum(had, 1 << 30, out=had)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
                                         names=["block", "counts"])

    schema = "block long, counts binary"
    parts = map_batches(docs.select(F.col(text_col).cast("string").alias("text")), count, schema)
    blocks = map_batches(parts.repartition("block"), add, schema)
    table = np.zeros((1 << COUNTER_BITS) // _BLOCK * _BLOCK, dtype=np.uint32).reshape(-1, _BLOCK)
    for row in blocks.toLocalIterator():  # 2**COUNTER_BITS counters in all
        table[row["block"]] = np.frombuffer(row["counts"], dtype=np.uint32)
    return table.ravel()


def prefix_length(n, percent: int):
    """N-grams of a set of ``n`` among which any partner must have one."""
    return n - -(-percent * n // 100) + 1


def least_overlap(n_a, n_b, percent: int):
    """Overlap that two sets of these sizes need."""
    return -(-percent * (n_a + n_b) // (100 + percent))


def signature(ngrams: np.ndarray) -> np.int64:
    """64-bit name of a set's content."""
    with np.errstate(over="ignore"):
        name = mix64(np.array([mix64(ngrams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(ngrams))]))
    return name.view(np.int64)[0]


def _may_chain(n_small, n_large, percent: int):
    """Whether sets of these sizes may stand next to each other in a chain: within two steps of size, rounded towards yes."""
    return n_large * (percent - 1) ** 2 <= n_small * 10_000


def _size_step(n, percent: int):
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent)).astype(np.int64)


def signatures(docs: DataFrame, counters, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """For each row its set's name and size, its first n-grams, and what its task already saw of common ones.

    ``id, row, sig, n, tokens, common, links``: ``row`` is a hash of id and text; ``tokens`` are the first n-grams that are rare in the batch, ``common`` those that many
    sets of the batch have and for which this set stands, ``links`` sets chained with this one for such n-grams.
    Only the first of equal sets of a batch has n-grams.
    """
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("row", "sig", "n")],
        *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("tokens", "common", "links")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = counters.value
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            sigs, sizes, early, seen = [], [], [], set()
            for a, b in passes(offsets):
                for s in shingle_sets(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], k):
                    name = signature(s) if len(s) else None
                    sigs.append(name)
                    sizes.append(len(s))
                    if name is None or name in seen:
                        early.append(s[:0])
                        continue
                    seen.add(name)
                    p = prefix_length(len(s), percent)
                    counts = order[_slot(s)]
                    if p < len(s):  # only what can be among the first needs the full order
                        limit = np.partition(counts, p - 1)[p - 1]
                        kept = counts <= limit
                        s, counts = s[kept], counts[kept]
                    early.append(s[np.lexsort((s, counts))[:p]])
            n_early = np.array([len(e) for e in early])
            token = np.concatenate(early) if early else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(early)), n_early)
            sizes = np.array(sizes, dtype=np.int64)
            by = np.lexsort((sizes[owner], token))
            token, owner = token[by], owner[by]
            new = np.ones(len(token), dtype=bool)
            new[1:] = token[1:] != token[:-1]
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > FEW if len(token) else np.zeros(0, bool)
            # within a common n-gram: chain neighbours in size, and let one set stand for each step of size
            step = _size_step(sizes[owner], percent)
            stands = many & (new | np.r_[True, step[1:] != step[:-1]]) if len(token) else many
            chained = np.flatnonzero(many & ~new)
            chained = chained[_may_chain(sizes[owner[chained - 1]], sizes[owner[chained]], percent)]
            lists = [[[] for _ in early] for _ in range(3)]
            for what, at in ((0, np.flatnonzero(~many)), (1, np.flatnonzero(stands))):
                turn = at[np.argsort(owner[at], kind="stable")]
                cuts = np.searchsorted(owner[turn], np.arange(len(early) + 1))
                for i in np.flatnonzero(np.diff(cuts)):
                    lists[what][i] = token[turn[cuts[i]:cuts[i + 1]]].view(np.int64)
            for x, y in set(zip(owner[chained].tolist(), owner[chained - 1].tolist(), strict=True)):
                lists[2][x].append(sigs[y])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int64()),
                 *[pa.array(x, pa.list_(pa.int64())) for x in lists]], names=schema.names)

    text = F.col(text_col).cast("string").alias("text")
    return map_batches(docs.select(F.col(id_col), text, row_hash(id_col, text_col).alias("row")), run, schema)


def row_hash(id_col: str, text_col: str) -> Column:
    """Name of a row by id and text, also where the id is null or repeated."""
    return F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))


def candidate_edges(sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: edges whose components hold every pair that reaches the threshold."""
    rare = sets.select(F.explode("tokens").alias("token"), "sig", "n", F.lit(False).alias("common"))
    common = sets.select(F.explode("common").alias("token"), "sig", "n", F.lit(True).alias("common"))
    rows = rare.unionByName(common).repartition("token").sortWithinPartitions("token", "n", "sig")

    def pairs_of(token, sig, n, common, out):
        """Pairs of the small groups and chains of the others; the rows hold whole groups."""
        new = np.ones(len(token), dtype=bool)
        new[1:] = token[1:] != token[:-1]
        same = np.zeros(len(token), dtype=bool)  # equal sets from several batches
        same[1:] = ~new[1:] & (sig[1:] == sig[:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group, weights=common)[group] > 0
        token, sig, n, group, many = (x[~same] for x in (token, sig, n, group, many))
        count = np.bincount(group)
        many |= count[group] > FEW
        start = np.r_[0, np.cumsum(count)][group]
        at = np.flatnonzero(many)
        at = at[at > start[at]]
        at = at[_may_chain(n[at - 1], n[at], percent)]
        out.append((sig[at - 1], sig[at], n[at - 1], n[at], np.ones(len(at), dtype=bool)))
        place = np.arange(len(sig)) - start
        for d in range(1, FEW):
            at = np.flatnonzero(~many & (place >= d))
            if not len(at):
                break
            at = at[n[at] * percent <= n[at - d] * 100]
            a, b = np.minimum(sig[at - d], sig[at]), np.maximum(sig[at - d], sig[at])
            out.append((a, b, n[at - d], n[at], np.zeros(len(at), dtype=bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _and_last(batches):
            if batch is not None:
                cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
                cols = cols if rest is None else [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
                last = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
                if last == 0 and len(cols[0]) > 4 * FEW:
                    # one n-gram fills the batch: chain all but its end, which goes on
                    cols[3] = np.ones(len(cols[0]), dtype=bool)
                    last = len(cols[0]) - 1
                    ready, rest = cols, [c[last:] for c in cols]
                else:
                    ready, rest = [c[:last] for c in cols], [c[last:] for c in cols]
            else:
                ready = rest
            if ready is None or not len(ready[0]):
                continue
            out: list = []
            pairs_of(*ready, out)
            for made in out:
                if len(made[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=["a", "b", "n_a", "n_b", "chain"])

    pairs = map_batches(rows, run, "a long, b long, n_a long, n_b long, chain boolean")
    shared = pairs.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("chain").alias("chain"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    after = F.greatest(*[F.ceil(percent * F.col(x) / 100) - 1 for x in ("n_a", "n_b")])  # of the set that ends first in the order
    needed = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    return (shared.where(F.col("chain") | (F.col("c") + after >= needed)).select("a", "b")
            .unionByName(sets.select(F.col("sig").alias("a"), F.explode("links").alias("b"))))


def _and_last(batches):
    yield from batches
    yield None


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``[start, start + size)`` one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class SetTrie:
    """Trie of distinct sets over a common-first order; connected sets are joined as links are found.

    The nodes lie on *ways*: from its first node a way follows the child with the most sets, and every other child
    begins a way of its own.  A probe looks at ways in whole generations, so that a step is a few array operations, and
    there are at most as many generations as the logarithm of the number of sets.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.count = percent, len(sets)
        values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(values), dtype=np.int64)
        rank[np.lexsort((values, -times))] = np.arange(len(values))
        cuts = np.cumsum([0] + [len(s) for s in sets])
        ranked, weight = rank[place], times[place].astype(np.float64)
        paths = [np.sort(ranked[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.turn = sorted(range(self.count), key=lambda i: paths[i].astype(">u4").tobytes())
        self.paths = [paths[i] for i in self.turn]  # from here on, sets are known by their place in the order of the trie
        self.central = np.array([weight[cuts[i]:cuts[i + 1]].mean() for i in self.turn])
        self.member = np.zeros(len(values), dtype=bool)
        self.label = np.arange(self.count)
        self._ways(*self._nodes())

    def _nodes(self):
        """Nodes of the path-compressed trie: parent, depth, last set's place, and the node where each set ends."""
        parent, depth, upper, ends = [-1], [0], [0], []
        way, before = [0], np.zeros(0, np.int64)
        for i, path in enumerate(self.paths):
            m = min(len(before), len(path))
            differ = np.flatnonzero(before[:m] != path[:m])
            same = int(differ[0]) if len(differ) else m
            child = -1
            while depth[way[-1]] > same:
                child = way.pop()
            if depth[way[-1]] < same:  # the last edge is cut in two
                parent.append(way[-1])
                depth.append(same)
                upper.append(i)
                parent[child] = len(parent) - 1
                way.append(len(parent) - 1)
            if len(path) > same:
                parent.append(way[-1])
                depth.append(len(path))
                upper.append(i)
                way.append(len(parent) - 1)
            ends.append(way[-1])
            for v in way:
                upper[v] = i
            before = path
        return parent, depth, upper, ends

    def _ways(self, parent, depth, upper, ends) -> None:
        n = len(parent)
        lower = [self.count] * n  # first set below
        for i, v in enumerate(ends):
            lower[v] = min(lower[v], i)
        by_depth = sorted(range(n), key=lambda v: -depth[v])
        for v in by_depth:  # children are deeper than parents
            if parent[v] >= 0:
                lower[parent[v]] = min(lower[parent[v]], lower[v])
        heavy = [-1] * n
        for v in by_depth:
            u = parent[v]
            if u >= 0 and (heavy[u] < 0 or upper[v] - lower[v] > upper[heavy[u]] - lower[heavy[u]]):
                heavy[u] = v
        sizes = np.array([len(p) for p in self.paths])
        way_of, ways = [-1] * n, []
        for v in sorted(range(n), key=lambda v: depth[v]):
            u = parent[v]
            if u < 0 or heavy[u] != v:
                way_of[v] = len(ways)
                ways.append([v, v])
            else:
                way_of[v] = way_of[u]
                ways[way_of[v]][1] = v
        start = np.array([0 if parent[f] < 0 else depth[parent[f]] for f, _ in ways])
        stop = np.array([depth[l] for _, l in ways])
        some = [lower[f] for f, _ in ways]
        last = [lower[l] for _, l in ways]  # a set that runs along the whole way
        self.tokens = np.concatenate([self.paths[i][a:b] for i, a, b in zip(last, start, stop, strict=True)])
        self.size = stop - start
        self.first_token = np.cumsum(np.r_[0, self.size[:-1]])
        self.depth = start
        self.before = np.array([self.paths[i][a - 1] if a else -1 for i, a in zip(some, start, strict=True)])
        self.low, self.high = np.array(some), np.array([upper[f] for f, _ in ways])
        self.short = np.array([sizes[a:b + 1].min() for a, b in zip(self.low, self.high, strict=True)])
        self.long = np.array([sizes[a:b + 1].max() for a, b in zip(self.low, self.high, strict=True)])
        above = np.array([-1 if parent[f] < 0 else way_of[parent[f]] for f, _ in ways])
        kids = np.argsort(above, kind="stable")[1:]
        self.kids, self.n_kids = kids, np.bincount(above[kids], minlength=len(ways))
        self.first_kid = np.cumsum(np.r_[0, self.n_kids[:-1]])
        home = np.array([way_of[v] for v in ends])
        self.here, self.n_here = np.argsort(home, kind="stable"), np.bincount(home, minlength=len(ways))
        self.first_here = np.cumsum(np.r_[0, self.n_here[:-1]])
        self.sizes = sizes

    def probe(self, i: int, changes: np.ndarray) -> np.ndarray:
        """Sets outside the component of set ``i`` that reach the threshold with it.

        ``changes`` counts changes of component along the order of the sets.
        """
        path, n, percent, member = self.paths[i], len(self.paths[i]), self.percent, self.member
        member[path] = True
        ways, base, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(ways):
            sizes = self.size[ways]
            sums = np.r_[0, np.cumsum(member[self.tokens[_spans(self.first_token[ways], sizes)]])]
            zero = np.r_[0, np.cumsum(sizes)[:-1]]  # where each way begins in the sums
            base = base - sums[zero]
            # sets that end on these ways
            at = np.repeat(np.arange(len(ways)), self.n_here[ways])
            sets = self.here[_spans(self.first_here[ways], self.n_here[ways])]
            m = self.sizes[sets]
            overlap = base[at] + sums[zero[at] + m - self.depth[ways[at]]]
            found.append(sets[100 * overlap >= percent * (n + m - overlap)])
            # ways that begin on these ways, with the overlap up to there
            at = np.repeat(np.arange(len(ways)), self.n_kids[ways])
            kids = self.kids[_spans(self.first_kid[ways], self.n_kids[ways])]
            overlap = base[at] + sums[zero[at] + self.depth[kids] - self.depth[ways[at]]]
            short, long = self.short[kids], self.long[kids]
            left = np.minimum(long - self.depth[kids], n - np.searchsorted(path, self.before[kids], side="right"))
            needed = least_overlap(n, np.maximum(short, -(-percent * n // 100)), percent)
            done = (changes[self.low[kids]] == changes[self.high[kids]]) & (self.label[self.low[kids]] == self.label[i])
            stay = (long * 100 >= percent * n) & (short * percent <= 100 * n) & (overlap + left >= needed) & ~done
            ways, base = kids[stay], overlap[stay]
        member[path] = False
        return np.concatenate(found)

    def join(self) -> list[int]:
        """Component of each set.  Central sets go first: they connect most, and what is connected is skipped."""
        changes = np.arange(self.count)
        for i in np.argsort(-self.central, kind="stable"):
            if changes[-1] == 0:
                break
            met = np.unique(self.label[self.probe(i, changes)])
            if len(met) > 1 or len(met) == 1 and met[0] != self.label[i]:
                self.label[np.isin(self.label, met)] = self.label[i]
                changes = np.r_[0, np.cumsum(self.label[1:] != self.label[:-1])]
        component = np.empty(self.count, dtype=np.int64)
        component[self.turn] = np.array(self.turn)[self.label]
        return component.tolist()


def join_groups(grouped: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b``: links that connect the sets of each trie (``comp, x, y, text``) as the threshold does; ``b`` stands for its component."""
    ship(grouped.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        buf, offsets = text_buffer(pa.array(pdf["text"], pa.string()))
        made = {}
        for a, b in passes(offsets):
            for s in shingle_sets(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], k):
                if len(s):
                    made[signature(s)] = s
        if len(made) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        names = np.array(list(made), dtype=np.int64)
        root = np.array(SetTrie(list(made.values()), percent).join())
        apart = root != np.arange(len(names))
        return pd.DataFrame({"a": names[apart], "b": names[root[apart]]})

    return grouped.groupBy("comp", "x", "y").applyInPandas(lambda pdf: tidied(run(pdf)), "a long, b long")


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85,
                 block_ngrams: int = BLOCK_NGRAMS, with_row: bool = False) -> DataFrame:
    """Components of texts whose n-gram sets have a Jaccard similarity of ``percent`` / 100 or more.

    Returns ``id_col, n_shingles, component_id``: one row for each row of ``docs``; ``with_row`` adds its ``row_hash`` as ``row``.
    """
    spark = docs.sparkSession
    counters = spark.sparkContext.broadcast(count_ngrams(docs, text_col, k))
    sets = written(signatures(docs, counters, id_col, text_col, k, percent), "signatures")
    groups = connected_components(candidate_edges(sets, percent)).select(F.col("node").alias("sig"), F.col("component").alias("comp"))

    # one row stands for each set; its text goes to the trie of its group
    chosen = (sets.where("sig is not null").groupBy("sig").agg(F.min("row").alias("row"), F.first("n").alias("n"))
              .join(groups, "sig"))
    chosen = written(chosen, "candidates")
    sizes = chosen.groupBy("comp").agg(F.sum("n").alias("ngrams"), F.count("*").alias("members"))
    blocks = F.ceil(F.col("ngrams") / block_ngrams).cast("int")
    placed = (chosen.join(sizes.where("members > 1").select("comp", blocks.alias("blocks")), "comp")
              .withColumn("block", F.pmod(F.xxhash64("sig", F.lit("block")), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
                  F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("block")))))
              .select("row", "comp", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")))
    # only candidates' texts are shuffled to their tries, one for each set
    texts = may_hold(docs.select(row_hash(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text")), "row", placed.select("row"))
    texts = texts.groupBy("row").agg(F.first("text").alias("text"))
    links = written(join_groups(placed.join(texts, "row").select("comp", "x", "y", "text"), k, percent), "links")

    # links of a group that was not split end at its component; those of split groups are chained
    linked = connected_components(links)
    # the smallest id first of every set, then of every component, and back: a hot set or component moves as one row
    per_set = written(sets.where("sig is not null").groupBy("sig").agg(F.min("id").alias("least"))
                      .join(linked.select(F.col("node").alias("sig"), "component"), "sig", "left")
                      .withColumn("component", F.coalesce("component", "sig")), "sets")
    first = per_set.groupBy("component").agg(F.min("least").alias("first"))
    known = lookup(per_set.select("sig", "component"), first, "component").select("sig", "first")
    own = lookup(sets.select("id", "row", "sig", "n"), written(known, "components-of-sets"), "sig")
    return own.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("first", "id").alias("component_id"), *["row"] * with_row)
