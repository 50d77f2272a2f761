"""Repairing the structure of conversations at least cost, with an audit of the edits.

The rows of a conversation, in order of their turns, are kept (0), given the role user or assistant (2) or deleted (3), and empty turns of user or
assistant are inserted (2) until the initials of the roles read ``(s?(ua)+)?``.  Blank and repeated rows have to be deleted; a row
that stays although its text breaks off adds 1.  Of the cheapest repairs, the one whose audit (the initials of its edits) is least in ASCII is taken.

Persistent audit program: for each prefix of rows and each of the four states of the pattern, the best edits are a node that links to the node of
the edits before, so prefixes are shared and never copied.  A node holds a rolling hash of its whole path and its ancestors 1, 2, 4, ... steps
up.  Repairs of one cost are compared by a search for their longest common prefix over those ancestors; hashes that agree are verified on the
links themselves, and a collision falls back to comparing letters.  An audit determines rows, roles and cost, so no best prefix of one
state and cost begins another, and the least prefix stays least whatever follows.  Every ``REBASE_ROWS`` rows, the part of the paths that all live
nodes share is written out and forgotten, so memory follows the open alternatives, not the conversation.

Rows meet by conversation in one sorted exchange and stream through the program.  A conversation is a sequence and its digest a sequential hash, so one
task reads it, but no task holds it when it is long (over ``LONG_ROWS`` rows or ``LONG_CHARS`` characters): then repeated rows are found by
Spark, spread by text, one pass yields the audit, and a second pass hashes the rows behind their audit as they stream by.

Edge cases: a null role or text is one space (so a null text is blank); rows with a null conversation id are one conversation with a null id; null turns come
first; rows of one turn follow by role and text; a conversation without rows (all dropped) has zeros, an empty audit and the hash of the empty text;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.common import map_batches, written

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
ENDS = ".!?"
#: Conversations beyond either are not held by a task.
LONG_ROWS, LONG_CHARS = 100_000, 1 << 24
#: Rows after which settled edits are written out.
REBASE_ROWS = 4096
#: Conversations that need the second pass are named in a broadcast up to this number.
BROADCAST_NAMES = 100_000

KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1
#: States of the pattern: nothing yet, after system, after user, after assistant; a user may follow all but the third.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_MOD, _BASE = (1 << 61) - 1, 1_000_003


class Edits:
    """A prefix of edits: its last letter, its parent and further ancestors, its length and hash."""

    __slots__ = ("up", "letter", "depth", "hash")

    def __init__(self, parent: Edits | None, letter: str = "", mod: int = _MOD):
        self.letter = letter
        if parent is None:
            self.up, self.depth, self.hash = (), 0, 0
            return
        self.depth, self.hash = parent.depth + 1, (parent.hash * _BASE + ord(letter)) % mod
        up, k = [parent], 0
        while k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1
        self.up = tuple(up)

    def ancestor(self, depth: int) -> Edits:
        node = self
        while node.depth > depth:
            node = node.up[(node.depth - depth).bit_length() - 1]
        return node

    def letters(self, base: Edits | None = None) -> str:
        out, node = [], self
        while node is not base and node.up:
            out.append(node.letter)
            node = node.up[0]
        return "".join(reversed(out))


def _same(a: Edits, b: Edits) -> bool:
    """Whether two paths of one length have the same letters; ends where they share a node."""
    while a is not b and a.up:
        if a.letter != b.letter:
            return False
        a, b = a.up[0], b.up[0]
    return True


def first_difference(a: Edits, b: Edits) -> tuple[int, bool]:
    """Length of the longest common prefix, and whether a hash collision was met on the way."""
    m = min(a.depth, b.depth)
    x, y = a.ancestor(m), b.ancestor(m)
    if x.hash == y.hash:
        if _same(x, y):
            return m, False
    else:
        for k in range(len(x.up) - 1, -1, -1):
            if k < len(x.up) and x.up[k].hash != y.up[k].hash:
                x, y = x.up[k], y.up[k]
        if x.letter != y.letter and _same(x.up[0], y.up[0]):
            return x.depth - 1, False
    p, q = a.ancestor(m).letters(), b.ancestor(m).letters()  # hashes misled: compare the letters
    return next((i for i, (s, t) in enumerate(zip(p, q)) if s != t), m), True


def compare(a: Edits, la: str, b: Edits, lb: str) -> int:
    """Order of the audits ``a + la`` and ``b + lb`` (letters may be empty): -1, 0 or 1."""
    if a is b:
        return (la > lb) - (la < lb)
    n, _ = first_difference(a, b)
    p = la if a.depth == n else a.ancestor(n + 1).letter
    q = lb if b.depth == n else b.ancestor(n + 1).letter
    if p != q:
        return -1 if p < q else 1
    left, right = a.depth + len(la), b.depth + len(lb)
    if n + 1 < min(left, right):  # only with a letter each left to compare
        p, q = a.letters() + la, b.letters() + lb
        return (p > q) - (p < q)
    return (left > right) - (left < right)


class AuditProgram:
    """Feeds rows one by one; ``finish`` returns the cost and the audit."""

    def __init__(self, mod: int = _MOD, rebase_rows: int = REBASE_ROWS):
        self.mod, self.rebase_rows, self.rows, self.done = mod, rebase_rows, 0, []
        self.best: list[tuple[int, Edits] | None] = [(0, Edits(None)), None, None, None]

    def _pick(self, options: list[tuple[int, Edits, str]]) -> tuple[int, Edits] | None:
        found = None
        for option in options:
            if found is None or option[0] < found[0] or (option[0] == found[0] and compare(option[1], option[2], found[1], found[2]) < 0):
                found = option
        if found is None:
            return None
        return found[0], Edits(found[1], found[2], self.mod) if found[2] else found[1]

    def _with_inserts(self) -> list[tuple[int, Edits] | None]:
        now = list(self.best)

        def options(state: int, sources: tuple[int, ...]) -> list:
            own = [(*now[state], "")] if now[state] else []
            return own + [(now[s][0] + INSERT_COST, now[s][1], "I") for s in sources if now[s]]
        now[USER] = self._pick(options(USER, (EMPTY, SYSTEM, ASSISTANT)))
        now[ASSISTANT] = self._pick(options(ASSISTANT, (USER,)))
        return now

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        before = self._with_inserts()
        options: list[list] = [[(b[0] + DELETE_COST, b[1], "D")] if b else [] for b in before]
        if not must_go:
            extra = TRUNCATED_COST if truncated else 0
            keep, rerole = KEEP_COST + extra, REROLE_COST + extra
            for state in (EMPTY, SYSTEM, ASSISTANT):
                if before[state]:
                    cost, node = before[state]
                    options[USER].append((cost + keep, node, "K") if initial == "u" else (cost + rerole, node, "R"))
            if before[USER]:
                cost, node = before[USER]
                options[ASSISTANT].append((cost + keep, node, "K") if initial == "a" else (cost + rerole, node, "R"))
            if initial == "s" and before[EMPTY]:
                options[SYSTEM].append((before[EMPTY][0] + keep, before[EMPTY][1], "K"))
        self.best = [self._pick(o) for o in options]
        self._drop_hopeless()
        self.rows += 1
        if self.rows % self.rebase_rows == 0:
            self._rebase()

    def _drop_hopeless(self) -> None:
        """States that cost strictly more than going on from the state after an assistant could.

        Whatever follows nothing or a system turn may follow an assistant, but for a system turn, which costs ``DELETE_COST`` to delete.
        """
        user, assistant = self.best[USER], self.best[ASSISTANT]
        costs = ([user[0] + INSERT_COST] if user else []) + ([assistant[0]] if assistant else [])
        for state, extra in ((EMPTY, DELETE_COST), (SYSTEM, 0)):
            if costs and self.best[state] and self.best[state][0] > min(costs) + extra:
                self.best[state] = None

    def _rebase(self) -> None:
        live = [b[1] for b in self.best if b]
        shared = live[0]
        for node in live[1:]:
            m = min(shared.depth, node.depth)
            shared, node = shared.ancestor(m), node.ancestor(m)
            for k in range(len(shared.up) - 1, -1, -1):
                if k < len(shared.up) and shared.up[k] is not node.up[k]:
                    shared, node = shared.up[k], node.up[k]
            if shared is not node:
                shared = shared.up[0]
        self.done.append(shared.letters())
        made = {id(shared): Edits(None)}
        for node in live:
            path = []
            while id(node) not in made:
                path.append(node)
                node = node.up[0]
            copy = made[id(node)]
            for old in reversed(path):
                made[id(old)] = copy = Edits(copy, old.letter, self.mod)
        self.best = [(b[0], made[id(b[1])]) if b else None for b in self.best]

    def finish(self) -> tuple[int, str]:
        end = self._with_inserts()
        cost, node = self._pick([(*end[s], "") for s in (EMPTY, ASSISTANT) if end[s]])
        return cost, "".join([*self.done, node.letters()])


class RepairedText:
    """SHA-256 of the repaired ``role:text`` lines, from the audit and the rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.lines = audit, 0, EMPTY, hashlib.sha256(), 0

    def _line(self, role: str, text: str, state: int) -> None:
        self.sha.update(((("\n" if self.lines else "") + role + ":") + text).encode())
        self.lines, self.state = self.lines + 1, state

    def _expected(self, text: str) -> None:
        if self.state == USER:
            self._line("assistant", text, ASSISTANT)
        else:
            self._line("user", text, USER)

    def _inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self._expected("")

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self._line(role, text, {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]])
        elif letter == "R":
            self._expected(text)

    def hexdigest(self) -> str:
        self._inserts()
        return self.sha.hexdigest()


class Conversation:
    """The figures of one conversation, row by row; holds texts only when asked to."""

    def __init__(self, keep_rows: bool):
        self.rows: list | None = [] if keep_rows else None
        self.seen: set = set()
        self.program = AuditProgram()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def row(self, turn: int | None, role: str, text: str, repeated: bool | None) -> None:
        """``repeated`` says whether the row was seen before; ``None``: find out here."""
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if repeated is None:
            name = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            repeated = name in self.seen
            self.seen.add(name)
        body = text.rstrip(SPACE)
        blank = not body
        duplicate = repeated and not blank
        truncated = not blank and not duplicate and body[-1] not in ENDS
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.program.row(initial, blank or duplicate, truncated)
        if self.rows is not None:
            self.rows.append((role, text))

    def result(self) -> tuple:
        cost, audit = self.program.finish()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        digest = None
        if self.rows is not None:
            repaired = RepairedText(audit)
            for role, text in self.rows:
                repaired.row(role, text)
            digest = repaired.hexdigest()
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest


_FIGURES = [(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", T.StringType()), ("repaired_sha256", T.StringType())]


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` after the contract's damage; a dropped row stays as one with no copies."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = (F.when(F.col("__kind").isin(0, 1), F.lit("")).when(F.col("__kind") == 2, F.regexp_replace(part("text"), "[.!?]", ""))
            .otherwise(part("text")))
    return (rows.select("conv_id", "turn", "role", "text").withColumn("__kind", kind)
            .select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("__kind") == 4, F.lit("user")).otherwise(part("role")).alias("role"),
                    text.alias("text"), F.when(F.col("__kind") == 0, 0).when(F.col("__kind") == 3, 2).otherwise(1).alias("copies")))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.asc_nulls_first("turn"), "role", "text")


def _same_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(is the row the first of its conversation, values)`` of every row."""
    started, current = False, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for values in zip(*columns):
            fresh = not started or values[0] != current
            started, current = True, values[0]
            yield fresh, values


def _audits(keep_rows: bool, id_type: pa.DataType | None = None):
    """Task code: one row of figures for each conversation of the sorted rows."""
    def run(batches):
        ids, found, kind = [], [], None

        def flush():
            columns = list(zip(*found)) if found else [()] * len(_FIGURES)
            arrays = [pa.array(ids, kind)] + [pa.array(c, pa.int64() if isinstance(t, T.LongType) else pa.string()) for c, (_, t) in zip(columns, _FIGURES)]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *[n for n, _ in _FIGURES]])

        def typed():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        open_one, size = None, 0
        for fresh, (conv, turn, role, text, copies, repeated) in _same_conversation(typed()):
            if fresh:
                if open_one is not None:
                    found.append(open_one.result())
                    size += len(found[-1][-2])
                    if len(ids) >= 4096 or size > 1 << 22:
                        yield flush()
                        ids, found, size = [], [], 0
                ids.append(conv)
                open_one = Conversation(keep_rows)
            for copy in range(copies):
                open_one.row(turn, role, text, None if repeated is None else repeated or copy > 0)
        if open_one is not None:
            found.append(open_one.result())
            yield flush()
    return run


def _digests(batches):
    """Task code: behind each conversation's audit come its rows; yields its digest."""
    ids, digests, kind, repaired = [], [], None, None

    def typed():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field(0).type
            yield batch
    for fresh, (conv, _, role, text, copies, audit) in _same_conversation(typed()):
        if fresh:
            if repaired is not None:
                digests.append(repaired.hexdigest())
            ids.append(conv)
            repaired = RepairedText(audit)
            continue
        for _ in range(copies):
            repaired.row(role, text)
    if repaired is not None:
        digests.append(repaired.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(digests, pa.string())], names=["conv_id", "sha"])


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS) -> DataFrame:
    """Figures, audit and digest of every conversation of ``conv_id, turn, role, text, copies`` rows (``copies`` as made by :func:`damaged`)."""
    id_field = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    schema = T.StructType([id_field, *[T.StructField(n, t) for n, t in _FIGURES]])
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("c"))
    long = written(sizes.where((F.col("n") > long_rows) | (F.col("c") > long_chars)).select(F.col("conv_id").alias("__long")), "long-conversations")
    n_long = long.count()
    unknown = F.lit(None).cast("boolean").alias("repeated")
    if not n_long:
        return map_batches(_in_order(rows).select("*", unknown), _audits(True), schema)
    names = F.broadcast(long) if n_long <= BROADCAST_NAMES else long
    same = F.col("conv_id").eqNullSafe(F.col("__long"))
    short = map_batches(_in_order(rows.join(names, same, "left_anti")).select("*", unknown), _audits(True), schema)
    big = written(rows.join(names, same, "left_semi"), "long-rows")
    earlier = Window.partitionBy("conv_id", "role", F.sha2("text", 256), F.col("copies") > 0).orderBy(F.asc_nulls_first("turn"))
    told = _in_order(big.withColumn("repeated", F.row_number().over(earlier) > 1))
    audits = written(map_batches(told, _audits(False), schema), "long-audits")
    heads = audits.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copies"), "audit",
                          F.lit(0).alias("__row"))
    behind = heads.unionByName(big.select("*", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("__row")))
    hashed = map_batches(_in_order(behind, "__row").drop("__row"), _digests, T.StructType([id_field, T.StructField("sha", T.StringType())]))
    hashed = hashed.withColumnRenamed("conv_id", "__id")
    done = audits.join(hashed, F.col("conv_id").eqNullSafe(F.col("__id"))).select("conv_id", *[n for n, _ in _FIGURES[:-1]], F.col("sha").alias("repaired_sha256"))
    return short.unionByName(done)
