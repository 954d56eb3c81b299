"""Benchmark decontamination by a generalised suffix automaton of the test items.

All items' normalised words are read into one automaton, whose states are the classes of word sequences that occur in
the items. A document's words are streamed through it: the state and the longest matching length say which windows of
items end at each word. A window is `window` consecutive words of an item, or all words of a shorter one.

Words that no item has, and neighbours that are not neighbours in any item, end every match; so only runs of words
without them, at least as long as the shortest window, are streamed. The runs are found by hashes on whole batches; the
automaton compares the words themselves.

Items are handled in blocks of at most BLOCK words, one pass over the documents each, so that an automaton's memory is
bounded whatever the benchmark's size."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm import words as W
from gridloom.llm.scratch import Scratch
from gridloom.llm.workers import tidy

#: Words of items in one automaton (about 100 MB of Python objects at most).
BLOCK = 200_000
_SPAN = T.ArrayType(T.StructType([T.StructField(x, T.IntegerType()) for x in ("first", "last", "begin", "end")]))
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", _SPAN)]


def item_words(text: str | None) -> list[bytes]:
    if not text:
        return []
    (g,) = W.groups(pa.array([text]), W.ALNUM)
    raw = g.buf.tobytes()
    return [raw[a:b] for a, b in zip(g.starts.tolist(), g.ends.tolist(), strict=True)]


class SuffixAutomaton:
    """States of all substrings of several word sequences; marks say which windows end in a state, by length."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        self.marks: dict[int, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        sequences = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, seq in sequences:
            last = 0
            for word in seq:
                last = self._extend(last, word)
        self.shortest = min((min(window, len(seq)) for _, seq in sequences), default=0)
        pairs = set()
        for name, seq in sequences:
            size, state, length = min(window, len(seq)), 0, 0
            pairs.update(zip(seq, seq[1:]))
            for word in seq:
                state, length = self.advance(state, length, word)
                if length >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    self.marks[at][size].add(name)
        self.marks = {k: dict(v) for k, v in self.marks.items()}
        # nearest state above that has marks
        self.marked = [-1] * len(self.step)
        for s in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            up = self.link[s]
            self.marked[s] = up if up in self.marks else self.marked[up]
        names = list(self.vocabulary)
        hashes = np.array([W.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] for w in names], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int64)
        self.pairs = np.sort(np.array([a * len(names) + b for a, b in pairs], dtype=np.int64))

    def _extend(self, last: int, word: int) -> int:
        step, link, length = self.step, self.link, self.length
        if (q := step[last].get(word)) is not None:
            return q if length[q] == length[last] + 1 else self._copy(last, word, q)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p >= 0:
            q = step[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._copy(p, word, q)
        return new

    def _copy(self, p: int, word: int, q: int) -> int:
        """The shorter sequences of state q become a state of their own."""
        new = len(self.step)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = new
            p = self.link[p]
        return new

    def advance(self, state: int, length: int, word: int) -> tuple[int, int]:
        """Longest suffix of what was read, with this word, that occurs in the items: its state and length."""
        while state and word not in self.step[state]:
            state = self.link[state]
            length = self.length[state]
        nxt = self.step[state].get(word)
        return (0, 0) if nxt is None else (nxt, length + 1)

    def windows(self, state: int, length: int) -> Iterator[tuple[int, set[str]]]:
        """Sizes and items of the windows that end where a match of this length ends."""
        at = state if state in self.marks else self.marked[state]
        while at > 0:
            for size, names in self.marks[at].items():
                if size <= length:
                    yield size, names
            at = self.marked[at]

    def runs(self, g: W.Group) -> list[tuple[int, int]]:
        """Runs of words of one row in which a window can be, as word positions of the group, in order."""
        if not self.shortest or not len(g.starts):
            return []
        found: list[tuple[int, int]] = []
        h = g.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        pair = known[:-1] & known[1:] & (g.row[:-1] == g.row[1:])
        where = np.flatnonzero(pair)
        if len(self.pairs):
            code = self.ids[at[where]] * len(self.hashes) + self.ids[at[where + 1]]
            k = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            where = where[self.pairs[k] == code]
        else:
            where = where[:0]
        if self.shortest == 1:
            single = np.setdiff1d(np.flatnonzero(known), np.union1d(where, where + 1))
            found += [(i, i + 1) for i in single.tolist()]
        if len(where):
            cut = np.flatnonzero(np.diff(where) > 1)
            begin, end = where[np.concatenate([[0], cut + 1])], where[np.concatenate([cut, [len(where) - 1]])] + 2
            long = end - begin >= self.shortest
            found += zip(begin[long].tolist(), end[long].tolist(), strict=True)
        return sorted(found)

    def scan(self, g: W.Group) -> tuple[dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        """For each row of a group with windows: spans of hit words (positions in the group), and items."""
        spans, items = defaultdict(list), defaultdict(set)
        raw = g.buf
        for a, b in self.runs(g):
            row, state, length = int(g.row[a]), 0, 0
            for i in range(a, b):
                word = self.vocabulary.get(raw[g.starts[i] : g.ends[i]].tobytes())
                if word is None:  # another word with the same hash
                    state = length = 0
                    continue
                state, length = self.advance(state, length, word)
                for size, names in self.windows(state, length):
                    items[row] |= names
                    low = i + 1 - size
                    mine = spans[row]
                    while mine and mine[-1][0] >= low:
                        mine.pop()
                    if mine and mine[-1][1] >= low:
                        low = mine.pop()[0]
                    mine.append((low, i + 1))
        return spans, items


def _union(old: list[dict], new: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted([*old, *new], key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["last"]:
            if s["last"] > out[-1]["last"]:
                out[-1] = out[-1] | {"last": s["last"], "end": s["end"]}
        else:
            out.append(s)
    return out


def _scanner(shared, names: list[str], column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([(x, pa.int32()) for x in ("first", "last", "begin", "end")]))]
        for b in batches:
            old_items, old_spans = b.column("items").to_pylist(), b.column("spans").to_pylist()
            n_words, all_items, all_spans = [], [], []
            for g in W.groups(b.column(column), W.ALNUM):
                bounds = g.bounds()
                spans, items = automaton.scan(g)
                n_words += np.diff(bounds).tolist()
                for r in range(g.rows):
                    i = g.first + r
                    if r not in spans:
                        all_items.append(old_items[i])
                        all_spans.append(old_spans[i])
                        continue
                    word, byte = int(bounds[r]), int(g.at[r])
                    mine = [
                        {"first": a - word, "last": z - word, "begin": int(g.starts[a]) - byte, "end": int(g.ends[z - 1]) - byte} for a, z in spans[r]
                    ]
                    all_spans.append(_union(old_spans[i], mine))
                    all_items.append(sorted({*old_items[i], *items[r]}))
            new = [pa.array(x, k) for x, k in zip((n_words, all_items, all_spans), kinds, strict=True)]
            cols = {n: b.column(n) for n in b.schema.names} | dict(zip(("n_words", "items", "spans"), new, strict=True))
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    return run


def item_blocks(benchmark: DataFrame, window: int, most: int | None = None) -> Iterator[SuffixAutomaton]:
    most = most or BLOCK
    block, size = [], 0
    rows = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    for r in rows.distinct().toLocalIterator():
        words = item_words(r.t)
        if size and size + len(words) > most:
            yield SuffixAutomaton(block, window)
            block, size = [], 0
        block.append((r.i, words))
        size += len(words)
    yield SuffixAutomaton(block, window)


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = 10, column: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs with n_words, items (sorted ids of the items with windows in the text) and spans (of hit words:
    word positions first, last, and byte places begin, end in the text; last and end are exclusive, and spans that touch
    are one).

    Words are runs of letters a-z, digits and characters beyond ASCII, after lower-casing A-Z. benchmark has item_id and
    text; items with a null of either, or without words, take no part; rows of one item_id count as one item. A null or
    empty text has no words; texts of any length are scanned whole. Columns of docs named n_words, items or spans are
    replaced; others, and repeated rows, are kept. Empty tables give no spans."""
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark, "decontaminate")
    fields = [f for f in docs.schema if f.name not in ("n_words", "items", "spans")]
    schema = T.StructType([*fields, *_FOUND])
    out = docs.select(
        *(F.col(f"`{f.name}`") for f in fields), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<string>").alias("items"), F.array().cast(_SPAN).alias("spans"),
    )
    for k, automaton in enumerate(item_blocks(benchmark, window)):
        out = scratch.keep(out) if k else out
        out = out.mapInArrow(tidy(_scanner(spark.sparkContext.broadcast(automaton), schema.names, column)), schema)
    return out


def window_digests(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted ids, comma-joined) and contaminated (n_hit > 0)."""
    found = find_windows(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), benchmark, window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def _cutter(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, spans in enumerate(b.column("spans").to_pylist()):
                if spans:
                    raw, out, at = texts[i].encode(), [], 0
                    for s in spans:
                        out.append(raw[at : s["begin"]])
                        at = s["end"]
                    texts[i] = b"".join([*out, raw[at:]]).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in names], names)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_cover: float = 0.5, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs, with the spans that windows cover cut from their texts; rows of which they cover more than
    most_cover of the words go. Cutting can bring words together that make a window again: it is repeated until the
    texts have none. Rows without a window are returned as they are; columns are those of docs."""
    scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
    own = {c: f"__own_{c}" for c in docs.columns if c in ("n_words", "items", "spans")}
    back = {v: k for k, v in own.items()}
    docs = docs.withColumnsRenamed(own)
    todo, clean = docs, None
    while True:
        found = scratch.keep(find_windows(todo, benchmark, window, scratch=scratch))
        fine = found.where(F.size("spans") == 0).select(*docs.columns)
        clean = fine if clean is None else clean.unionByName(fine)
        hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["last"] - s["first"])
        bad = found.where((F.size("spans") > 0) & (hit <= F.lit(most_cover) * F.col("n_words"))).select(*docs.columns, "spans")
        if bad.isEmpty():
            return clean.withColumnsRenamed(back)
        schema = T.StructType([f for f in bad.schema if f.name != "spans"])
        todo = scratch.keep(bad.mapInArrow(tidy(_cutter(docs.columns)), schema))


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
