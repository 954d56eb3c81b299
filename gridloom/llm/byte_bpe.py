"""Byte-level BPE encoding and decoding by a vocabulary of merge ranks.

Merging one pre-token: every adjacent pair whose joined bytes are in the vocabulary waits in the bucket of its rank, as
the position where the pair starts in a linked list of token boundaries. A two-level bitmap marks the buckets that are
not empty, so that two find-first-set steps give the lowest rank; its leftmost position is merged next. Entries are not
removed when a neighbour's merge changes their pair: they are skipped when they come up. A pre-token of n bytes takes
about n log n steps, so one of a million letters is no different from many short ones.

Many pre-tokens are merged in one run: they lie side by side in one list whose pairs never cross their edges, and a
bucket's positions are taken in turn, so that the queue's steps are shared by all of them.

Ids of distinct pre-tokens, and of stretches between spaces, are remembered by each task up to MEMORY bytes."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.workers import prepare, tidy

#: Bytes, about, of a generation of a task's memory of pre-tokens, and of stretches; there are two generations of each.
MEMORY = 16 << 20
#: The same where workers have other steps before and after, whose memory an executor holds too.
LEAN = 4 << 20
#: Longer ones are not remembered; bytes an entry takes besides its key's and value's own.
LONG, _ENTRY = 256, 180
#: Texts, and their characters, that are encoded together.
_TEXTS, _CHARS = 256, 1 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The lines of a rank file: a token in base64 and its rank."""
    ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line.strip())}
    if lacking := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary lacks the single bytes {lacking[:5]}")
    return ranks


class RankQueue:
    """Positions by rank, lowest rank first. A caller may append to a bucket that it finds filled."""

    def __init__(self, n_ranks: int):
        self.shift = max(1, (max(n_ranks - 1, 1).bit_length() + 1) // 2)
        self.low = (1 << self.shift) - 1
        self.words = [0] * ((n_ranks >> self.shift) + 1)
        self.top = 0
        self.buckets: list[list[int] | None] = [None] * n_ranks

    def push(self, rank: int, position: int) -> None:
        if bucket := self.buckets[rank]:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word = rank >> self.shift
        self.words[word] |= 1 << (rank & self.low)
        self.top |= 1 << word

    def take(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions, ascending, or (-1, [])."""
        if not self.top:
            return -1, []
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        first = bits & -bits
        rank = (word << self.shift) | (first.bit_length() - 1)
        positions, self.buckets[rank] = self.buckets[rank], None
        self.words[word] = bits ^ first
        if bits == first:
            self.top &= self.top - 1
        positions.sort()
        return rank, positions


def merge(pieces: list[bytes], ranks: dict[bytes, int], queue: RankQueue) -> list[array]:
    """Ids of each pre-token (none is empty); the queue is empty before and after."""
    text = b"".join(pieces)
    n, edge, at = len(text), bytearray(len(text) + 1), 0
    for piece in pieces:
        edge[at] = 1
        at += len(piece)
    edge[n] = 1
    held = list if n < 1 << 17 else lambda x: array("q", x)
    after, before, waiting = held(range(1, n + 2)), held(range(-1, n)), held([-1]) * (n + 1)
    get, push, buckets = ranks.get, queue.push, queue.buckets
    for p in range(n - 1):
        if not edge[p + 1] and (r := get(text[p : p + 2])) is not None:
            waiting[p] = r
            if bucket := buckets[r]:
                bucket.append(p)
            else:
                push(r, p)
    while (taken := queue.take())[0] >= 0:
        r, positions = taken
        again = False
        for i, p in enumerate(positions):
            if waiting[p] != r:
                continue
            gone = after[p]
            end = after[gone]
            after[p] = end
            before[end] = p
            waiting[gone] = waiting[p] = -1
            if not edge[end] and (s := get(text[p : after[end]])) is not None:
                waiting[p] = s
                if bucket := buckets[s]:
                    bucket.append(p)
                else:
                    push(s, p)
                again = s <= r
            if not edge[p]:
                q = before[p]
                waiting[q] = -1
                if (s := get(text[q:end])) is not None:
                    waiting[q] = s
                    if bucket := buckets[s]:
                        bucket.append(q)
                    else:
                        push(s, q)
                    again |= s <= r
            if again:  # what came in goes first; the rest waits on
                for q in positions[i + 1 :]:
                    push(r, q)
                break
    out, p = [], 0
    while p < n:
        ids = array("I")
        while True:
            end = after[p]
            ids.append(ranks[text[p:end]])
            p = end
            if edge[p]:
                break
        out.append(ids)
    return out


class Memory:
    """What was made for the keys asked for lately: a full generation becomes the older one, from which a key that is
    asked for again comes back."""

    def __init__(self, most: int | None = None) -> None:
        self.now: dict[str, bytes | int] = {}
        self.older: dict[str, bytes | int] = {}
        self.size, self.most = 0, MEMORY if most is None else most

    def lacking(self, keys: set[str]) -> list[str]:
        """Those of the keys that are not in `now`, after what is known of them came there."""
        if self.size > self.most:
            self.older, self.now, self.size = self.now, {}, 0
        new, older = [], self.older
        for k in keys.difference(self.now):
            if (v := older.get(k)) is None:
                new.append(k)
            else:
                self.add(k, v)
        return new

    @staticmethod
    def _bytes(key: str, value: bytes | int) -> int:
        return len(key) + _ENTRY + (len(value) if isinstance(value, bytes) else 0)

    def add(self, key: str, value: bytes | int) -> None:
        self.now[key] = value
        self.size += self._bytes(key, value)

    def forget(self, keys: list[str]) -> None:
        """Drops those of the keys that are too long to keep."""
        for k in keys:
            if len(k) > LONG:
                self.size -= self._bytes(k, self.now.pop(k))


class ByteBPE:
    """Encodes texts to packed little-endian unsigned 32-bit ids, and back to bytes.

    spaced: for patterns whose matches have a space at their start only, but for runs of white space: a text is then
    split at its spaces, and each stretch with its space is encoded once. Texts with other runs of spaces are matched
    whole."""

    #: White space, then a space that more white space or the end follows: tokens there may hold several spaces.
    SPACES = re.compile(r"\s (?:\s|\Z)")

    def __init__(self, ranks: dict[bytes, int], pattern: str, spaced: bool = False, memory: int | None = None):
        self.ranks, self.spaced, self.memory = ranks, spaced, memory
        self.tokens = {r: t for t, r in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.clear()

    def clear(self) -> None:
        """A task's memory is not kept for the next, which would mostly find other pre-tokens in it."""
        self.pieces, self.stretches = Memory(self.memory), Memory(self.memory)

    def _merged(self, pieces: list[str]) -> None:
        """Remembers the ids of pre-tokens, some 8 KB of them a run."""
        run, size = [], 0
        for k, piece in enumerate(pieces):
            run.append(piece.encode())
            size += len(run[-1])
            if size > 1 << 13 or k == len(pieces) - 1:
                for name, ids in zip(pieces[k + 1 - len(run) : k + 1], merge(run, self.ranks, self.queue), strict=True):
                    self.pieces.add(name, ids.tobytes())
                run, size = [], 0

    def encode_all(self, texts: list[str]) -> list[bytes]:
        find, plans, stretches, heads = self.pattern.findall, [], set(), set()
        for t in texts:
            if self.spaced and not self.SPACES.search(t):
                first, *rest = t.split(" ")
                stretches.update(rest)
                head = find(first)
            else:
                head, rest = find(t), ()
            heads.update(head)
            plans.append((head, rest))
        new = self.stretches.lacking(stretches)
        split = [find(" " + x) for x in new]
        heads.update(chain.from_iterable(split))
        made = self.pieces.lacking(heads)
        self._merged(made)
        pieces = self.pieces.now.__getitem__
        for x, parts in zip(new, split, strict=True):
            self.stretches.add(x, b"".join(map(pieces, parts)))
        known = self.stretches.now.__getitem__
        out = [b"".join(map(pieces, head)) + b"".join(map(known, rest)) for head, rest in plans]
        self.pieces.forget(made)
        self.stretches.forget(new)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        table = array("I")
        table.frombytes(ids)
        return b"".join(map(self.tokens.__getitem__, table))


_coders: dict[tuple, ByteBPE] = {}


def _coder(data: bytes, pattern: str, spaced: bool, lean: bool = False) -> ByteBPE:
    key = (hashlib.sha256(data).digest(), pattern, spaced, lean)
    if key not in _coders:
        _coders.clear()
        _coders[key] = ByteBPE(read_ranks(data), pattern, spaced, LEAN if lean else None)
    return _coders[key]


def text_groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of some rows at a time; a null is an empty text."""
    texts, size, first = [], 0, 0
    for i, t in enumerate(column):
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size > _CHARS or len(texts) == _TEXTS or i == len(column) - 1:
            yield first, texts
            texts, size, first = [], 0, i + 1


def encode(docs: DataFrame, ranks: bytes, pattern: str, spaced: bool = False, decoded: bool = False, lean: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens, ids (packed little-endian unsigned 32-bit ids), and if wanted
    what decode() makes of them (bytes).

    ranks is the content of a rank file, pattern the expression whose matches are encoded separately (text that it does
    not match is dropped, as a pattern for this use matches all). spaced: see ByteBPE. lean: with less memory, of which
    nothing stays in a worker when a task ends, but more time. No special tokens are known.
    Null and empty texts give no ids. A text or pre-token of any length is encoded whole. Row order, repeated rows and
    null doc_ids are kept; other columns are ignored."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(ranks)
    names = ["doc_id", "n_tokens", "ids", *(["decoded"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern, spaced, lean)
        for b in batches:
            for first, texts in text_groups(b.column("text")):
                ids = coder.encode_all(texts)
                cols = [b.column("doc_id").slice(first, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    cols.append(pa.array(list(map(coder.decode, ids)), pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names)
        coder.clear()
        if lean:
            _coders.clear()

    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, ranks: bytes, pattern: str = r"\p{L}+") -> DataFrame:
    """Per row of encoded (doc_id, ids, ...): its columns and decoded (bytes). Null ids give null; an id that the
    vocabulary lacks raises KeyError."""
    spark: SparkSession = encoded.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(ranks)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern, False)
        for whole in batches:
            for lo in range(0, whole.num_rows, _TEXTS):
                b = whole.slice(lo, _TEXTS)
                out = [None if x is None else coder.decode(x) for x in b.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(tidy(run), schema)


def roundtrip_digests(docs: DataFrame, ranks: bytes, pattern: str, spaced: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the ids and of their decoding."""
    done = encode(docs, ranks, pattern, spaced, decoded=True)
    return done.selectExpr("doc_id", "n_tokens", "sha2(ids, 256) as ids_sha256", "sha2(decoded, 256) as decoded_sha256")
