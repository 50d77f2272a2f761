"""Removal of repeated byte strings through a partitioned, sparse enhanced suffix array.

A byte goes when a string of ``least`` bytes that covers it also starts in a text with a smaller id.

*Partitioning the suffixes.*  Sorting the suffixes of a whole corpus in one place does not scale, so they are dealt out
by an *anchor*: each window of ``least`` bytes picks one ``ANCHOR``-byte substring of its own (the place of its least
short code, modulo the number of choices).  Equal windows pick the same anchor at the same place, so all
occurrences of a repeat meet in the bucket of its anchor.  Neighbouring windows mostly pick the same anchor; such a *run* of
windows travels as one entry: hash of the anchor, hash of all bytes the run covers (its *context*), id.

*Whole runs.*  Entries with equal anchor and context repeat all windows of the run.

*Common-prefix intervals.*  Where an anchor has several contexts, runs agree in part.  The contexts of such an anchor (one for
each content) become a suffix array with common-prefix lengths; a stack scan gives the interval tree.  Every interval of at least
``least`` bytes is a repeat with all its occurrences; it is *maximal* when the bytes to the left differ.  The least id
of an interval keeps it, the others lose the bytes.  An anchor with more than ``MANY`` contexts would make one large array;
its windows are dealt out by their own hash instead, the least id of each window first inside the task.

Copies in one batch of texts are settled there: only the least id of a common run goes on.

Edge cases: null and empty texts have 0 bytes and the hash of nothing; rows with a null id take no part; rows that share an id
never take from each other; matches never cross texts; overlapping matches join into one span; texts shorter
than ``least`` lose nothing; an empty table gives no rows; columns named in ``carry`` pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import map_batches, mix64, parts_for, passes, ship, text_buffer, tidied
from marketlens.llm.words import _BASE, _BASE_INVERSE, _CODE, _powers

#: Bytes of an anchor and of the codes that choose it.
ANCHOR, CODE = 28, 5
#: Contexts of one anchor that are sorted together at most.
MANY = 2000
#: Occurrences of one run in a batch from which only the least id goes on.
COMMON = 4
#: Text bytes for each bucket.
BUCKET_BYTES = 6_000_000


class Runs:
    """The runs of a buffer of texts: first and last window, anchor place, text index, hashes."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, least: int):
        self.least, n = least, len(buf)
        windows = n - least + 1
        self.total = np.zeros(n + 1, dtype=np.uint64)
        self.back = _powers(_BASE_INVERSE, n + 1)
        with np.errstate(over="ignore"):
            np.cumsum(_CODE[buf] * _powers(_BASE, n), out=self.total[1:])
        if windows <= 0:
            self.first = self.last = self.anchor = self.owner = np.zeros(0, np.int64)
            self.kh = self.ch = np.zeros(0, np.uint64)
            return
        chosen = self._anchors(buf, windows)
        inside = np.zeros(windows, dtype=bool)  # windows that lie in one text
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            inside[a:max(a, b - least + 1)] = True
        new = inside.copy()
        new[1:] &= (chosen[1:] != chosen[:-1]) | ~inside[:-1]
        new[offsets[:-1][offsets[:-1] < windows]] &= True
        starts = np.zeros(windows, dtype=bool)
        starts[offsets[:-1][offsets[:-1] < windows]] = True
        new |= starts & inside
        self.first = np.flatnonzero(new)
        stop = np.zeros(windows, dtype=bool)
        stop[:-1] = inside[:-1] & (new[1:] | ~inside[1:])
        stop[-1] = inside[-1]
        self.last = np.flatnonzero(stop)
        self.anchor = chosen[self.first]
        self.owner = np.searchsorted(offsets, self.first, side="right") - 1
        self.kh = self.hash(self.anchor, self.anchor + ANCHOR)
        with np.errstate(over="ignore"):
            self.ch = mix64(self.hash(self.first, self.last + least) + (self.anchor - self.first).astype(np.uint64))

    def _anchors(self, buf: np.ndarray, windows: int) -> np.ndarray:
        """Place of each window's anchor."""
        code = np.zeros(len(buf) - CODE + 1, dtype=np.uint64)
        for j in range(CODE):
            code |= buf[j: len(code) + j].astype(np.uint64) << np.uint64(8 * j)
        with np.errstate(over="ignore"):
            code *= np.uint64(0x9E3779B97F4A7C15)
        code &= np.uint64(0xFFFFFFFF00000000)
        code |= np.arange(len(code), dtype=np.uint64)  # the first of equal codes
        wide, most = 1, self.least - CODE + 1
        while 2 * wide <= most:
            code = np.minimum(code[:-wide], code[wide:])
            wide *= 2
        best = np.minimum(code[:windows], code[most - wide: most - wide + windows]) if wide < most else code[:windows]
        at = np.arange(windows)
        choices = self.least - ANCHOR + 1
        return at + ((best & np.uint64(0xFFFFFFFF)).astype(np.int64) - at) % choices

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.total[b] - self.total[a]) * self.back[a])

    def keys(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64(self.kh + self.ch * np.uint64(0xD1342543DE82EF95))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``[start, start + size)`` one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def lcp_intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Interval tree of a suffix array by a stack scan: ``(length, left, right)`` of every interval of at least ``least``.

    ``lcp[i]`` is the common prefix of suffixes ``i - 1`` and ``i``; children come before their parents.
    """
    heights = lcp.tolist()
    stack: list[tuple[int, int]] = []
    for i in np.flatnonzero((lcp >= least) | (np.r_[0, lcp[:-1]] >= least)).tolist() + [len(heights)]:
        height = heights[i] if i < len(heights) else 0
        left = i - 1
        while stack and stack[-1][0] > height:
            length, left = stack.pop()
            yield length, left, i - 1
        if height >= least and (not stack or stack[-1][0] < height):
            stack.append((height, left))


class ContextArray:
    """Enhanced suffix array of contexts, group by group; suffixes are the starts of whole windows."""

    def __init__(self, group: np.ndarray, sizes: np.ndarray, data: np.ndarray, least: int):
        begin = np.cumsum(np.r_[0, sizes[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        n = sizes - least + 1
        self.context = np.repeat(np.arange(len(sizes)), n)
        self.place = np.arange(len(self.context)) - np.repeat(np.cumsum(n) - n, n)
        at = begin[self.context] + self.place
        left = sizes[self.context] - self.place
        width = int(left.max()) if len(left) else 0
        words = -(-width // 8)
        rows = np.zeros((len(at), words * 8), dtype=np.uint8)
        for j in range(width):
            some = left > j
            rows[some, j] = data[at[some] + j]
        keys = rows.view(">u8")
        # equal bytes up to the end of the shorter: the shorter comes first
        order = np.lexsort((left, *[keys[:, j] for j in range(words - 1, -1, -1)], group[self.context]))
        self.context, self.place, rows, left = self.context[order], self.place[order], rows[order], left[order]
        self.group = group[self.context]
        self.lcp = np.zeros(len(order), dtype=np.int64)
        if len(order) > 1:
            differ = rows[1:] != rows[:-1]
            same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
            same = np.minimum(same, np.minimum(left[1:], left[:-1]))
            self.lcp[1:] = np.where(self.group[1:] == self.group[:-1], same, 0)
        at = begin[self.context] + self.place
        self.before = np.where(self.place > 0, data[np.maximum(at - 1, 0)].astype(np.int64), -1 - self.context)

    def maximal_repeats(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length, first and last suffix of every maximal repeat of at least ``least`` bytes.

        An interval is maximal when its suffixes have different bytes to the left.  The first byte of a context has
        an unknown neighbour, which differs from all.  Any two occurrences of a string are extended to the left until they are
        diverse, so maximal repeats hold every repeat.
        """
        found = np.array(list(lcp_intervals(self.lcp, least)), dtype=np.int64).reshape(-1, 3)
        changes = np.r_[0, np.cumsum(self.before[1:] != self.before[:-1])] if len(self.before) else np.zeros(0, np.int64)
        length, left, right = found[changes[found[:, 1]] != changes[found[:, 2]]].T
        return length, left, right


def _ints(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int64)


def _raw(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def bucket_of(ids: np.ndarray, n: int) -> np.ndarray:
    """Bucket of an id; ``bucket_column`` says the same in Spark."""
    return (np.mod(ids, 2147483647) * 1103515245 + 12345) % 2147483648 % n


def bucket_column(id_col: str, n: int) -> Column:
    return ((F.pmod(F.col(id_col), F.lit(2147483647)) * 1103515245 + 12345) % 2147483648 % n).cast("int")


def _dealt(bucket: np.ndarray, n: int, arrays: list[np.ndarray], more=None) -> Iterator[list]:
    """One row of packed arrays for each bucket that has entries."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        at = order[cuts[b]:cuts[b + 1]]
        yield [int(b), *[_raw(x[at]) for x in arrays], *([more(at)] if more else [])]


def _table(rows: list[list], names: list[str]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    kinds = [pa.int32()] + [pa.binary()] * (len(names) - 1)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


_RUNS = ["bucket", "kh", "ch", "who", "ids", "known"]
_VERDICTS = ["bucket", "ids", "keys", "groups"]
_PIECES = ["bucket", "kind", "ids", "hashes", "starts", "sizes", "groups", "data"]
_COVERS = ["bucket", "ids", "hashes", "starts", "sizes"]


def _schema(names: list[str]) -> str:
    return ", ".join(f"{c} {'int' if c == 'bucket' else 'binary'}" for c in names)


def _entries(batches: Iterator[pa.RecordBatch], least: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries of the runs of each batch, dealt by anchor; ``known`` are those whose run has a smaller id here."""
    for batch in batches:
        buf, offsets = text_buffer(batch.column(1))
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        kh, ch, who = [], [], []
        for a, b in passes(offsets):
            runs = Runs(buf[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], least)
            kh.append(runs.kh)
            ch.append(runs.ch)
            who.append(runs.owner + a)
        kh, ch, who = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (kh, ch, who))
        order = np.lexsort((ids[who.astype(np.int64)], ch, kh))
        kh, ch, who = kh[order], ch[order], who[order].astype(np.int64)
        new = np.ones(len(kh), dtype=bool)
        new[1:] = (kh[1:] != kh[:-1]) | (ch[1:] != ch[:-1])
        once = new.copy()  # one entry for each text
        once[1:] |= ids[who[1:]] != ids[who[:-1]]
        kh, ch, who, new = kh[once], ch[once], who[once], new[once]
        group = np.cumsum(new) - 1
        settled = ~new & (np.bincount(group)[group] >= COMMON) if len(group) else new
        with np.errstate(over="ignore"):
            keys = mix64(kh + ch * np.uint64(0xD1342543DE82EF95))
        bucket = _anchor_bucket(kh, n_buckets)
        rows = []
        cuts = np.searchsorted(bucket, np.arange(n_buckets + 1))  # in order of the hash, so in order of the buckets
        for b in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[b], cuts[b + 1])
            go = ~settled[part]
            held, place = np.unique(who[part][go], return_inverse=True)
            known = np.stack([ids[who[part][~go]], keys[part][~go].view(np.int64)])
            rows.append([int(b), _raw(kh[part][go].astype(np.uint32)), _raw(ch[part][go]), _raw(place.astype(np.uint32 if len(held) > 65535 else np.uint16)),
                         _raw(ids[held]), _raw(known)])
        yield from _table(rows, _RUNS).to_batches()


def _anchor_bucket(kh: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((kh >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def _judge(table: pa.Table, n_texts: int) -> pa.Table:
    """Verdicts on the entries of one bucket of anchors, dealt by text.

    ``groups`` is -1 where the whole run repeats a smaller id; otherwise the run's context is wanted for that group of contexts;
    from ``1 << 62`` on the group is large.
    """
    kh, ch, ids, known = [], [], [], []
    for row in table.to_pylist():
        kh.append(np.frombuffer(row["kh"], np.uint32))
        ch.append(np.frombuffer(row["ch"], np.uint64))
        held = np.frombuffer(row["ids"], np.int64)
        ids.append(held[np.frombuffer(row["who"], np.uint32 if len(held) > 65535 else np.uint16)])
        known.append(np.frombuffer(row["known"], np.int64).reshape(2, -1))
    bucket = table.column("bucket")[0].as_py()
    kh, ch, ids, known = np.concatenate(kh), np.concatenate(ch), np.concatenate(ids), np.concatenate(known, axis=1)
    order = np.lexsort((ids, ch, kh))
    kh, ch, ids = kh[order], ch[order], ids[order]
    new = np.ones(len(kh), dtype=bool)
    new[1:] = kh[1:] != kh[:-1]
    anchor = np.cumsum(new) - 1
    new[1:] |= ch[1:] != ch[:-1]
    first = np.flatnonzero(new)
    least_id = ids[first][np.cumsum(new) - 1]
    covered = ids > least_id
    contexts = np.bincount(anchor[first])[anchor] if len(first) else np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else first
    spread = (np.maximum.reduceat(ids, starts) != np.minimum.reduceat(ids, starts))[anchor] if len(ids) else covered
    wanted = new & (contexts > 1) & spread
    # the full hash of the anchor is not at hand; the bucket and its lower half name the group
    name = (np.int64(bucket) << 32 | kh.astype(np.int64)) + np.where(contexts > MANY, np.int64(1) << 62, 0)
    keys = _pair_key(bucket, kh, ch)
    take = covered | wanted
    out_ids = np.concatenate([ids[take], known[0]])
    out_keys = np.concatenate([keys[take], known[1]])
    groups = np.concatenate([np.where(covered, -1, name)[take], np.full(known.shape[1], -2)])
    return _table(list(_dealt(bucket_of(out_ids, n_texts), n_texts, [out_ids, out_keys, groups])), _VERDICTS)


def _pair_key(bucket, kh32: np.ndarray, ch: np.ndarray) -> np.ndarray:
    """Name of a run in verdicts: from what a bucket holds of it."""
    with np.errstate(over="ignore"):
        return mix64((kh32.astype(np.uint64) | np.uint64(bucket) << np.uint64(32)) + ch * np.uint64(0xD1342543DE82EF95)).view(np.int64)


def _apply_verdicts(docs: pa.Table, verdicts: pa.Table, least: int, n_buckets: int) -> pa.Table:
    """Covered spans and wanted contexts of one bucket of texts, dealt by group.

    ``kind`` 0: contexts with their bytes; 1: windows of large groups, ``groups`` being their hashes; 2: spans that are known.
    """
    if not verdicts.num_rows or not docs.num_rows:
        return _table([], _PIECES)
    v_ids, v_keys, v_groups = (_ints(verdicts.column(c)) for c in ("ids", "keys", "groups"))
    buf, offsets = text_buffer(docs.column("text"))
    ids = docs.column("id").to_numpy()
    hashes = docs.column("hash").to_numpy()
    with np.errstate(over="ignore"):
        v_name = mix64(v_ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + v_keys.view(np.uint64))
    order = np.argsort(v_name, kind="stable")
    v_name, v_groups = v_name[order], v_groups[order]
    spans, wanted, windows = [], [], []
    data = []
    for a, b in passes(offsets):
        part = offsets[a:b + 1] - offsets[a]
        runs = Runs(buf[offsets[a]:offsets[b]], part, least)
        if not len(runs.first):
            continue
        owner = runs.owner + a
        with np.errstate(over="ignore"):
            keys = [_pair_key_each(_anchor_bucket(runs.kh, n_buckets), runs.kh, runs.ch), mix64(runs.kh + runs.ch * np.uint64(0xD1342543DE82EF95))]
            base = ids[owner].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        start = runs.first - part[runs.owner]
        size = runs.last - runs.first + least
        for which, key in enumerate(keys):
            with np.errstate(over="ignore"):
                name = mix64(base + key)
            at = np.minimum(np.searchsorted(v_name, name), len(v_name) - 1)
            hit = v_name[at] == name
            group = np.where(hit, v_groups[at], -3)
            sure = group == (-1 if which == 0 else -2)
            spans.append(np.stack([ids[owner[sure]], hashes[owner[sure]], start[sure], size[sure]]))
            if which:
                continue
            few = np.flatnonzero((group >= 0) & (group < 1 << 62))
            wanted.append(np.stack([ids[owner[few]], hashes[owner[few]], start[few], size[few], group[few]]))
            first = runs.first[few] + offsets[a]
            data.append(buf[np.repeat(first - np.r_[0, np.cumsum(size[few])[:-1]], size[few]) + np.arange(size[few].sum())] if len(few) else buf[:0])
            many = np.flatnonzero(group >= 1 << 62)
            n = runs.last[many] - runs.first[many] + 1
            each = np.repeat(many, n)
            at = runs.first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            windows.append(np.stack([ids[owner[each]], hashes[owner[each]], at - part[runs.owner[each]],
                                     np.full(len(each), least), runs.hash(at, at + least).view(np.int64)]))
    rows = []
    empty = np.zeros((5, 0), dtype=np.int64)
    w = np.concatenate([empty, *windows], axis=1)
    w = w[:, np.lexsort((w[0], w[4]))]
    new = np.ones(w.shape[1], dtype=bool)
    new[1:] = w[4, 1:] != w[4, :-1]
    smaller = w[0] > w[0][np.flatnonzero(new)][np.cumsum(new) - 1] if w.shape[1] else new
    s = np.concatenate([empty[:4], *spans, w[:4, smaller]], axis=1)
    w = w[:, ~smaller]
    c = np.concatenate([empty, *wanted], axis=1)
    text = np.concatenate([np.zeros(0, np.uint8), *data])
    begin = np.cumsum(np.r_[0, c[3][:-1]]).astype(np.int64)
    pick = lambda at: _raw(np.concatenate([text[begin[i]:begin[i] + c[3][i]] for i in at]))
    name = lambda g: _anchor_bucket(mix64(g.view(np.uint64)), n_buckets)
    rows += [[r[0], b"0", *r[1:]] for r in _dealt(name(c[4]), n_buckets, list(c), pick)]
    rows += [[r[0], b"1", *r[1:], b""] for r in _dealt(name(w[4]), n_buckets, list(w))]
    s = _merged(s)
    rows += [[r[0], b"2", *r[1:], b"", b""] for r in _dealt(bucket_of(s[0], n_buckets), n_buckets, list(s))]
    return _table(rows, _PIECES)


def _pair_key_each(bucket: np.ndarray, kh: np.ndarray, ch: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        low = kh & np.uint64(0xFFFFFFFF)
        return mix64((low | bucket.astype(np.uint64) << np.uint64(32)) + ch * np.uint64(0xD1342543DE82EF95))


def _merged(spans: np.ndarray) -> np.ndarray:
    """Spans (id, hash, start, size) with overlapping and touching ones of a text joined."""
    if not spans.shape[1]:
        return spans
    spans = spans[:, np.lexsort((spans[2], spans[1], spans[0]))]
    ident, start = spans[:2], spans[2]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (ident[:, 1:] != ident[:, :-1]).any(axis=0)
    text = np.cumsum(new)
    wide = int((spans[2] + spans[3]).max()) + 1
    reach = np.maximum.accumulate(start + spans[3] + text * wide) - text * wide  # furthest end so far in the text
    new[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    return np.stack([ident[0][first], ident[1][first], start[first], reach[last] - start[first]])


def _scan_groups(table: pa.Table, least: int, n_texts: int) -> pa.Table:
    """Spans that lose their bytes, from the pieces of one bucket of groups, dealt by text."""
    spans = [np.zeros((4, 0), dtype=np.int64)]
    packed: dict[str, list] = {"0": [], "1": []}
    data = []
    for row in table.to_pylist():
        kind = row["kind"].decode()
        cols = [np.frombuffer(row[c], np.int64) for c in ("ids", "hashes", "starts", "sizes")]
        if kind == "2":
            spans.append(np.stack(cols))
            continue
        packed[kind].append(np.stack([*cols, np.frombuffer(row["groups"], np.int64)]))
        data.append(np.frombuffer(row["data"], np.uint8))
    if packed["1"]:
        w = np.concatenate(packed["1"], axis=1)
        w = w[:, np.lexsort((w[0], w[4]))]
        new = np.r_[True, w[4, 1:] != w[4, :-1]]
        spans.append(w[:4, w[0] > w[0][np.flatnonzero(new)][np.cumsum(new) - 1]])
    if packed["0"]:
        c = np.concatenate(packed["0"], axis=1)
        array = ContextArray(c[4], c[3], np.concatenate(data), least)
        ids = c[0][array.context]
        length, left, right = array.maximal_repeats(least)
        n = right - left + 1
        at = _spans(left, n)  # every occurrence of every maximal repeat
        least_id = np.minimum.reduceat(ids[at], np.cumsum(n) - n) if len(n) else ids[:0]
        lose = ids[at] > np.repeat(least_id, n)
        at, length = at[lose], np.repeat(length, n)[lose]
        which = array.context[at]
        spans.append(np.stack([c[0][which], c[1][which], c[2][which] + array.place[at], length]))
    s = _merged(np.concatenate(spans, axis=1))
    return _table(list(_dealt(bucket_of(s[0], n_texts), n_texts, list(s))), _COVERS)


def _cut(docs: pa.Table, covers: pa.Table, carry: list[str], names: list[str], kinds: list, with_text: bool) -> pa.Table:
    """The texts of one bucket without their covered spans."""
    columns = [_ints(covers.column(c)) if covers.num_rows else np.zeros(0, np.int64) for c in _COVERS[1:]]
    s = _merged(np.stack(columns))
    s_from: dict[tuple[int, int], int] = {}
    new = np.flatnonzero(np.r_[True, (s[:2, 1:] != s[:2, :-1]).any(axis=0)]) if s.shape[1] else []
    ends = np.r_[new[1:], s.shape[1]] if len(new) else []
    for a, b in zip(new, ends, strict=True):
        s_from[int(s[0, a]), int(s[1, a])] = (int(a), int(b))
    buf, offsets = text_buffer(docs.column("text"))
    out: list[list] = [[] for _ in range(5)]
    for i, key in enumerate(zip(docs.column("id").to_pylist(), docs.column("hash").to_pylist(), strict=True)):
        text = buf[offsets[i]:offsets[i + 1]]
        a, b = s_from.get(key, (0, 0))
        kept, removed = [], 0
        at = 0
        for start, size in zip(s[2, a:b].tolist(), s[3, a:b].tolist(), strict=True):
            kept.append(text[at:start])
            at = start + size
            removed += size
        kept.append(text[at:])
        left = np.concatenate(kept).tobytes()
        for column, value in zip(out, (len(text), removed, b - a, hashlib.sha256(left).hexdigest(),
                                       left.decode("utf-8", "ignore") if with_text else None), strict=True):
            column.append(value)
    arrays = [docs.column("id"), *[docs.column(c) for c in carry], *out[: 5 if with_text else 4]]
    return pa.table([a.cast(k) if isinstance(a, pa.ChunkedArray) else pa.array(a, k) for a, k in zip(arrays, kinds, strict=True)], names=names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50,
                   carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Every text without the bytes that repeat a text with a smaller id.

    Ids are whole numbers.  Returns ``id_col``, the columns in ``carry``, ``n_bytes, n_removed, n_spans, kept_sha256`` and, as asked, ``kept``
    (what is left; bytes that are no longer whole characters go).
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if least <= ANCHOR + CODE:
        raise ValueError(f"least must be more than {ANCHOR + CODE}")
    ship(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    n = parts_for(total, BUCKET_BYTES)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    every = docs.select(F.coalesce(bucket_column(id_col, n), F.lit(0)).alias("bucket"), F.col(id_col).cast("long").alias("id"), text.alias("text"),
                       F.xxhash64(text).alias("hash"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    held = every.where("id is not null")
    entries = map_batches(held.select("id", "text"), lambda batches: _entries(batches, least, n), _schema(_RUNS))
    verdicts = entries.groupBy("bucket").applyInArrow(lambda t: tidied(_judge(t, n)), _schema(_VERDICTS))
    texts = held.groupBy("bucket")
    pieces = texts.cogroup(verdicts.groupBy("bucket")).applyInArrow(
        lambda a, b: tidied(_apply_verdicts(a, b, least, n)), _schema(_PIECES))
    covers = pieces.groupBy("bucket").applyInArrow(lambda t: tidied(_scan_groups(t, least, n)), _schema(_COVERS))
    fields = [T.StructField("id", T.LongType()), *[T.StructField(f"carry_{c}", docs.schema[c].dataType) for c in carry],
              T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
              T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept", T.StringType())] * with_text
    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]
    carried = [f"carry_{c}" for c in carry]
    cut = texts.cogroup(covers.groupBy("bucket")).applyInArrow(lambda a, b: tidied(_cut(a, b, carried, names, kinds, with_text)), T.StructType(fields))
    # rows with a null id lose nothing and need no partner
    zero = F.lit(0).cast("long")
    whole = every.where("id is null").select("id", *carried, F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"),
                                             F.sha2("text", 256).alias("kept_sha256"), *[F.col("text").alias("kept")] * with_text)
    return cut.unionByName(whole).select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *[F.col(f"carry_{c}").alias(c) for c in carry],
                      *names[1 + len(carry):])


def maximal_repeats(contexts: list[bytes], least: int = 50) -> list[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats of a group of byte strings: length and all occurrences as (string, place)."""
    sizes = np.array([len(c) for c in contexts])
    use = np.flatnonzero(sizes >= least)
    if not len(use):
        return []
    data = np.frombuffer(b"".join(contexts[i] for i in use), np.uint8)
    array = ContextArray(np.zeros(len(use), np.int64), sizes[use], data, least)
    return [(int(length), sorted((int(use[array.context[j]]), int(array.place[j])) for j in range(left, right + 1)))
            for length, left, right in zip(*array.maximal_repeats(least), strict=True)]
