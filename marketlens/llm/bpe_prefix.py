"""Byte-level BPE by prefix dynamic programming.

For a byte string, every prefix has one BPE encoding, so it has one *last token*.
``last[i]`` stores the id of the last token of the encoding of the first ``i``
bytes.  The encoding of a string is read off backwards: take ``last[n]``, step
back by its length, and so on.

``last[i]`` is found from shorter prefixes: a vocabulary token ``t`` that ends at
``i`` is the last token exactly when ``(last[i - len(t)], t)`` is a pair that
BPE leaves standing next to each other.  Exactly one candidate passes.  A pair
of tokens stands if undoing merges of the later-ranked side never exposes a merge
that the ranks would have done earlier across the border.

The table makes two things exact: an *append* extends it byte by byte without
touching what is there, and after an *edit* the table is kept up to the edit; behind it, bytes
are encoded anew only until the new table runs in step with the old one again for
as many bytes as the longest token has.

Text is cut by the tokenizer's pattern first; merges never cross a cut.

Edge cases: null and empty texts have no tokens; ids are those of the whole
text; extra columns of the input are carried along unless they clash with an output name, which wins;
rows that repeat give repeated rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from marketlens.llm.common import map_batches, passes

#: Distinct cuts whose ids a task remembers; when full the memory starts empty again (results do not change).
CACHE_CUTS = 500_000
#: Tested pairs of tokens a task remembers, likewise.
CACHE_PAIRS = 1_000_000
#: Last bytes by which candidate tokens are found.
END_BYTES = 3


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a ``.tiktoken`` file."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class PrefixBpe:
    """Encoder over a rank table; ``last_tokens`` is the dynamic program."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int] | None] = {}
        self._stands: dict[tuple[int, int], bool] = {}
        # lengths of the tokens with given last bytes, longest first: a prefix tries only tokens that can end there
        lengths: dict[bytes, set[int]] = {}
        for t in ranks:  # tokens shorter than END_BYTES are found by all their bytes
            lengths.setdefault(t[-END_BYTES:], set()).add(len(t))
        self.lengths = {b: sorted(s, reverse=True) for b, s in lengths.items()}

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte or a token no merge reaches."""
        if token not in self.halves:
            word = self.token[token]
            parts = self._merge_below(word, token)
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[token]

    def _merge_below(self, word: bytes, limit: int) -> list[int]:
        """Plain merging of one vocabulary entry with ranks below ``limit`` (set-up of the pair test only)."""
        parts = [word[i: i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
            if rank >= limit:
                break
            parts[i: i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def reachable(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        return len(self.token[token]) == 1 or self._split(token) is not None

    def stands(self, left: int, right: int) -> bool:
        """Whether BPE keeps ``left`` and ``right`` apart when they are neighbours."""
        known = self._stands.get((left, right))
        if known is None:
            if len(self._stands) >= CACHE_PAIRS:
                self._stands.clear()
            known = self._stands[left, right] = self.reachable(right) and self._test(left, right)
        return known

    def _test(self, a: int, b: int) -> bool:
        limit = 1 << 62
        while True:
            merged = self.ranks.get(self.token[a] + self.token[b])
            if merged is not None and merged < limit:
                return False
            # undo the later of the two merges; the border moves into its half
            if a > b:
                limit = a
                half = self._split(a)
                if half is None:
                    limit = b + 1
                    half = self._split(b)
                    if half is None:
                        return True
                    b = half[0]
                else:
                    a = half[1]
            else:
                limit = b + 1
                half = self._split(b)
                if half is None:
                    limit = a
                    half = self._split(a)
                    if half is None:
                        return True
                    a = half[1]
                else:
                    b = half[0]

    def extend(self, data: bytes, last: list[int], end: int | None = None) -> list[int]:
        """Fill ``last`` (entry ``i``: last token of the first ``i`` bytes, entry 0 unused) up to ``end`` bytes."""
        end = len(data) if end is None else end
        if not last:
            last.append(-1)
        ranks, lengths, pairs = self.ranks.get, self.lengths.get, self._stands.get
        for i in range(len(last), end + 1):
            found = -1
            # the lists go from three last bytes to one, so from longer to shorter tokens
            for k in range(END_BYTES if i >= END_BYTES else i, 0, -1):
                for n in lengths(data[i - k: i], ()):
                    if n > i:
                        continue
                    t = ranks(data[i - n: i])
                    if t is None:
                        continue
                    if i == n:
                        stands = self.reachable(t)
                    else:
                        stands = pairs((last[i - n], t))
                        if stands is None:
                            stands = self.stands(last[i - n], t)
                    if stands:
                        found = t
                        break
                if found >= 0:
                    break
            last.append(found)
        return last

    def read_back(self, last: list[int], end: int | None = None) -> list[int]:
        """Token ids of the first ``end`` bytes."""
        i, ids = (len(last) - 1 if end is None else end), []
        while i > 0:
            ids.append(last[i])
            i -= len(self.token[last[i]])
        return ids[::-1]

    def encode(self, data: bytes) -> list[int]:
        return next(self.encode_sorted([data]))

    def encode_sorted(self, pieces: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of each piece; pieces in byte order share the table of the bytes that they begin with."""
        before, last = b"", [-1]
        for data in pieces:
            whole = self.ranks.get(data)
            if whole is not None:  # a cut that is a token stays whole, as the ranks' own library has it
                yield [whole]
                continue
            same, most = 0, min(len(before), len(data))
            while same < most and before[same] == data[same]:
                same += 1
            del last[same + 1:]
            yield self.read_back(self.extend(data, last))
            before = data

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """Exact table of ``data + more``; nothing already stored changes."""
        data = data + more
        return data, self.extend(data, last)

    def replace(self, data: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int], int]:
        """Exact table after ``data[start:stop]`` becomes ``new``; also the number of bytes encoded anew.

        Entries behind the edit depend only on the entries and bytes of the last
        ``longest`` places, so once that many agree with the old table, the rest
        of the old table holds.
        """
        changed = data[:start] + new + data[stop:]
        shift, table, same, i = len(new) - (stop - start), last[: start + 1] or [-1], 0, start
        while i < len(changed):
            i += 1
            self.extend(changed, table, i)
            old = i - shift
            inside = i > start + len(new) and 0 < old < len(last)
            same = same + 1 if inside and last[old] == table[i] else 0
            if same >= self.longest:
                return changed, table + last[old + 1:], i - start
        return changed, table, i - start

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class TextCodec:
    """Texts to ids and back with a bounded memory of cuts."""

    def __init__(self, ranks: str | dict[bytes, int], pattern: str, cache_cuts: int = CACHE_CUTS):
        self.bpe, self.cut = PrefixBpe(load_ranks(ranks) if isinstance(ranks, str) else ranks), regex.compile(pattern)
        self.cache_cuts, self.memory = cache_cuts, {}

    def entries(self, texts: list[str]) -> Iterator[list[tuple[str, int, bytes]]]:
        """For each text, its cuts' entries: the ids as text, their number, and the bytes made from the ids."""
        cuts = [self.cut.findall(t) for t in texts]
        needed = set().union(*cuts)
        new = needed.difference(self.memory)
        if len(self.memory) + len(new) > self.cache_cuts:
            self.memory.clear()
            new = needed
        ordered = sorted(p.encode("utf-8") for p in new)
        for data, ids in zip(ordered, self.bpe.encode_sorted(ordered), strict=True):
            self.memory[data.decode("utf-8")] = (" ".join(map(str, ids)), len(ids), self.bpe.decode(ids))
        for c in cuts:
            yield [self.memory[p] for p in c]

    def ids(self, text: str) -> list[int]:
        return [int(i) for joined, _, _ in next(self.entries([text])) for i in joined.split()]


_CODECS: dict[tuple, TextCodec] = {}


def shared_codec(spark: SparkSession, ranks_path: str, pattern: str) -> Callable[[], TextCodec]:
    """Reads the rank table on the driver and broadcasts it; tasks get one codec for each worker process."""
    ranks = load_ranks(ranks_path)
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest(), pattern
    sent = spark.sparkContext.broadcast(ranks)

    def codec() -> TextCodec:
        if name not in _CODECS:
            _CODECS[name] = TextCodec(sent.value, pattern)
        return _CODECS[name]
    return codec


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = True, with_digests: bool = False) -> DataFrame:
    """Token ids of every whole text.

    Returns ``id_col, n_tokens`` and, as asked, ``ids`` (array of int) and the
    digests ``ids_sha256`` (of the decimal ids joined by one space) and
    ``decoded_sha256`` (of the bytes decoded from the ids).
    """
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    if with_digests:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    codec = shared_codec(docs.sparkSession, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec()
        for batch in batches:
            n_tokens, ids, ids_sha, decoded_sha = [], [], [], []
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())])
            for a, b in passes(offsets):
                for found in code.entries([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]):
                    n_tokens.append(sum([e[1] for e in found]))
                    joined = " ".join([e[0] for e in found])
                    if with_ids:
                        ids.append(np.array(joined.split(), dtype=np.int32))
                    if with_digests:
                        ids_sha.append(hashlib.sha256(joined.encode("ascii")).hexdigest())
                        decoded_sha.append(hashlib.sha256(b"".join([e[2] for e in found])).hexdigest())
            out = [batch.column(0), pa.array(n_tokens, pa.int64())]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
            if with_digests:
                out += [pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return map_batches(docs.select(id_col, text_col), run, T.StructType(fields))


def decode_texts(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Texts from the ``ids`` column: ``id_col, text``; a null list of ids gives an empty text.

    Ids that do not end on a whole character give the replacement character there.
    """
    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])

    codec = shared_codec(encoded.sparkSession, ranks_path, pattern)

    def run(batches):
        bpe = codec().bpe
        for batch in batches:
            texts = [bpe.decode(x.as_py() or []).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return map_batches(encoded.select(id_col, "ids"), run, schema)
