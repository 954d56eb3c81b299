"""Near-duplicate lines by an exact set-similarity join.

A line is the set of its distinct words (lower-cased A-Z, between white space), as 64-bit hashes. Words are ordered by
rarity. Two sets of n and m words with a Jaccard similarity of t or more share a word among the n - ceil(t n) + 1 rarest
of the one and likewise of the other (prefix filter); their sizes differ by a factor of t at most (length filter); and the
words from the first shared one on must suffice (positional filter). What these filters, and a bitmap that cannot reject
a match, leave is verified on whole sets. See lists.py for the lists of words in which lines meet.

A line is removed if an earlier line matches it, be that one kept or not; earlier is by (doc_id, line number). So the
result does not depend on the order of work, and a line needs one match only: it is first compared with its earliest
partners of each list, and only lines that match none of them, and have further ones, with all others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import lists as L
from gridloom.llm import words as W
from gridloom.llm.scratch import Scratch, small
from gridloom.llm.workers import tidy

_LINES = 1 << 17
#: Lines whose first copy a task remembers.
SEEN = 100_000
#: Entries in lists that a line has, about.
ENTRIES = 10
_PLACE = ["doc_id", "line"]


class Lines:
    """The lines with words of some rows: for each its row, number (from 0, blank lines counted), first word and size
    in `tokens`, which holds each line's distinct word hashes, by their code (the rarest first) and then their low bits."""

    def __init__(self, g: W.Group, h: np.ndarray, line: np.ndarray, number: np.ndarray, codes: np.ndarray | None):
        new = np.concatenate([[True], line[1:] != line[:-1]])
        index = np.cumsum(new) - 1
        self.row, self.number = g.row[np.flatnonzero(new)], number[new]
        by = (index.astype(np.uint64) << np.uint64(46)) | (h & np.uint64((1 << 38) - 1))
        if codes is not None:
            code = codes[L.bucket(h)]
            by |= code.astype(np.uint64) << np.uint64(38)
        order = np.argsort(by)
        h, line_of = h[order], index[order]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (line_of[1:] != line_of[:-1])])
        self.tokens, self.line = h[fresh], line_of[fresh]
        self.codes = None if codes is None else code[order][fresh]
        self.begin = np.flatnonzero(np.concatenate([[True], self.line[1:] != self.line[:-1]]))
        self.size = np.diff(np.append(self.begin, len(self.line)))

    def keys(self) -> np.ndarray:
        total = np.add.reduceat(W.mix(self.tokens ^ np.uint64(0x5851F42D4C957F2D)), self.begin)
        return W.mix(total + self.size.astype(np.uint64)).view(np.int64)


def lines_of(g: W.Group, h: np.ndarray, codes: np.ndarray | None = None) -> Iterator[Lines]:
    """The lines of a group of rows with word hashes h, some at a time."""
    if not len(g.starts):
        return
    breaks = np.flatnonzero(g.buf == 10)
    count = np.searchsorted(breaks, g.starts)
    number = count - np.searchsorted(breaks, g.at)[g.row]
    line = count + g.row  # ascends with each line and row
    cuts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))[::_LINES]
    for a, b in zip(cuts, [*cuts[1:], len(h)], strict=True):
        part = W.Group(g.first, g.rows, g.buf, g.row[a:b], g.starts[a:b], g.ends[a:b], g.at)
        yield Lines(part, h[a:b], line[a:b], number[a:b], codes)


_KEYED = "doc_id long, th long, line long, key long, part int, counts binary"


def _line_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line with words, and the task's counts of words."""
    names = [f.split()[0] for f in _KEYED.split(", ")]
    counter = L.Counter()
    for b in batches:
        ids, hashes = b.column("doc_id").to_numpy(), b.column("th").to_numpy()
        for g in W.groups(b.column("text"), W.SPACED):
            h = g.hashes()
            if len(h):
                counter.add(h)
            for x in lines_of(g, h):
                at, n = g.first + x.row, len(x.row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), pa.array(hashes[at]), pa.array(x.number, pa.int64()), pa.array(x.keys()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names
                )
    for part, counts in counter.slices():
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([part], pa.int32()), pa.array([counts], pa.binary())], names)


def _entries(codes, bound: L.Bound, buckets: int):
    """The lists that the lines enter. An exact copy that the task met is listed once more only if it comes earlier."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        table, seen = codes.value, {}
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for g in W.groups(b.column("text"), W.SPACED):
                for x in lines_of(g, g.hashes(), table):
                    keys, docs = x.keys(), ids[g.first + x.row]
                    wanted = ~bound.alone(x.size)
                    if len(seen) > SEEN:
                        seen.clear()
                    at = np.flatnonzero(wanted)
                    for i, k, d, n in zip(at.tolist(), keys[at].tolist(), docs[at].tolist(), x.number[at].tolist(), strict=True):
                        if (old := seen.get(k)) is None or (d, n) < old:
                            seen[k] = (d, n)
                        else:
                            wanted[i] = False
                    value, owner, rest = L.entries(x.tokens, x.codes, x.begin, x.size, bound, (x.size, wanted))
                    low, high = L.bitmaps(x.tokens, x.begin)
                    yield value, keys[owner], L.packed(x.size[owner], rest), low[owner], high[owner], docs[owner], x.number[owner]

    return lambda batches: L.dealt(listed(batches), buckets)


def _wanted_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word sets of the lines whose numbers are wanted; other lines are not looked at."""
    for b in batches:
        cut: list[bytes] = []
        for text, numbers in zip(b.column("text").to_pylist(), b.column("lines").to_pylist(), strict=True):
            lines = text.split("\n")
            cut += [lines[k] for k in numbers if k < len(lines)]
        for lo in range(0, len(cut), 4096):
            for g in W.groups(pa.array(cut[lo : lo + 4096], pa.string()), W.SPACED):
                # a row is a line here
                for x in lines_of(g, g.hashes()):
                    ends = np.append(x.begin, len(x.tokens)).astype(np.int32)
                    tokens = x.tokens[np.lexsort((x.tokens, x.line))].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x.keys()), pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens))], ["key", "tokens"])


class _Matcher:
    def __init__(self, docs: DataFrame, percent: int, scratch: Scratch):
        self.keep, self.scratch, self.percent, self.bound = scratch.keep, scratch, percent, L.Bound(percent)
        docs = docs.where("doc_id is not null and text is not null").selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
        self.docs = docs.withColumn("th", F.xxhash64("text"))
        keyed = self.keep(self.docs.mapInArrow(tidy(_line_keys), _KEYED))
        self.lines = keyed.where("part is null").select("doc_id", "th", "line", "key")
        self.counts = keyed.where("part is not null")

    def met(self) -> DataFrame:
        codes = self.docs.sparkSession.sparkContext.broadcast(L.rarity(self.counts))
        # buckets of a bounded size, and so many that tasks get about the same
        tasks = int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(32 * tasks, self.lines.count() * ENTRIES // L.IN_BUCKET)
        rows = self.docs.select("doc_id", "text").mapInArrow(tidy(_entries(codes, self.bound, buckets)), L.BLOCKS)
        rows = rows.repartition("bucket").sortWithinPartitions("bucket")
        return self.keep(rows.mapInArrow(tidy(L.meetings_dealt(self.bound, _PLACE)), L.schema(_PLACE)))

    def matched(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (key, doc_id, line, pkey, pdoc_id, pline) that are similar: key, and the earliest partner's place."""
        pairs = self.keep(pairs.groupBy("key", "pkey").agg(F.min(F.struct(*_PLACE)).alias("at"), F.min(F.struct("pdoc_id", "pline")).alias("pat")))
        ends = pairs.select("key", "at.doc_id", "at.line").unionByName(pairs.select(F.col("pkey").alias("key"), F.col("pat.pdoc_id").alias("doc_id"), F.col("pat.pline").alias("line")))
        ends = self.keep(ends.groupBy("key").agg(F.min(F.struct(*_PLACE)).alias("at")).select("key", "at.*"))
        wanted = self.keep(ends.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines")))
        # the arrays hold as many numbers as ends has rows
        texts = self.docs.join(small(wanted, ends.count()), "doc_id").select("text", "lines")
        sets = texts.mapInArrow(tidy(_wanted_sets), "key long, tokens array<bigint>").join(small(ends.select("key")), "key", "left_semi").dropDuplicates(["key"])
        sets = self.keep(sets)
        side = lambda c: sets.select(F.col("key").alias(c), F.col("tokens").alias(f"{c}s"))
        both = pairs.select("key", "pkey", "pat").join(side("key"), "key").join(side("pkey"), "pkey")
        shared = F.size(F.array_intersect("keys", "pkeys"))
        alike = both.where(shared * 100 >= (F.size("keys") + F.size("pkeys") - shared) * self.percent)
        out = self.keep(alike.groupBy("key").agg(F.min("pat").alias("pat")).select("key", "pat.*"))
        self.scratch.drop(pairs, ends, wanted, sets)
        return out

    def later(self) -> DataFrame:
        """Keys of lines that other lines match, and the place of the earliest of these that was found. If any is earlier
        than the key's first copy, then so is the one given."""
        met = self.met()
        pairs = met.where("value is null")
        done = self.matched(pairs)
        open_ = met.where("value is not null")
        settled = (open_.key == done.key) & (F.struct(done.pdoc_id, done.pline) < F.struct(open_.doc_id, open_.line))
        left = self.keep(open_.where("more").join(small(done), settled, "left_anti").select(*L.ENTRY, *_PLACE))
        if not left.count():
            return done
        y = left.select("value", *(F.col(c).alias(f"y{c}") for c in [*L.ENTRY[1:], *_PLACE]))
        x = open_.select("value", *(F.col(c).alias(f"x{c}") for c in [*L.ENTRY[1:], *_PLACE]))
        earlier = F.struct("xdoc_id", "xline") < F.struct("ydoc_id", "yline")
        more = y.join(x, "value").where((F.col("xkey") != F.col("ykey")) & earlier & self.bound.fits_sql("x", "y"))
        more = more.select(F.col("ykey").alias("key"), F.col("ydoc_id").alias("doc_id"), F.col("yline").alias("line"), *(F.col(f"x{c}").alias(f"p{c}") for c in ("key", *_PLACE)))
        more = more.join(pairs.select("key", "pkey").distinct(), ["key", "pkey"], "left_anti")
        out = self.keep(done.unionByName(self.matched(more)).groupBy("key").agg(F.min(F.struct("pdoc_id", "pline")).alias("pat")).select("key", "pat.*"))
        self.scratch.drop(met, left, done)
        return out


def removed_lines(docs: DataFrame, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """Rows (doc_id, th, removed: array of line numbers from 0, ascending) for the documents of docs (doc_id, text) that
    lose lines; th is xxhash64(text). Lines are split at line feeds. Blank lines are never removed. Null texts and null
    doc_ids take no part. Rows that share a doc_id lose their own lines only; of equal lines at one number of such rows
    that of the least th counts as the earliest, and equal rows keep or lose a line together. Texts and lines of any
    length are read whole, in groups of about half a megabyte or one text."""
    scratch = scratch or Scratch(docs.sparkSession, "line_dedup")
    matcher = _Matcher(docs, percent, scratch)
    later = matcher.later()
    at = F.struct("doc_id", "line", "th")
    firsts = matcher.lines.groupBy("key").agg(F.min(at).alias("first"), F.count("*").alias("c")).join(small(later), "key", "left")
    matches = F.col("pdoc_id").isNotNull() & (F.struct("pdoc_id", "pline") < F.struct("first.doc_id", "first.line"))
    firsts = firsts.select("key", "first", "c", matches.alias("gone"))
    # lines of which there is one, and which match none, need no join
    some = scratch.keep(firsts.where("c > 1 or gone").drop("c"))
    gone = matcher.lines.join(small(some), "key").where(F.col("gone") | (at != F.col("first"))).select("doc_id", "th", "line")
    return scratch.keep(gone.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line")).alias("removed"), F.count("*").alias("n")))


def _without(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                texts, n, kept = part.column("text").to_pylist(), [], []
                for i, gone in enumerate(part.column("__removed").to_pylist()):
                    total = 0 if texts[i] is None else texts[i].count("\n") + 1
                    n.append(total)
                    if gone:
                        drop = set(gone)
                        texts[i] = "\n".join([x for k, x in enumerate(texts[i].split("\n")) if k not in drop])
                        total -= len(drop)
                    kept.append(total)
                new = {"text": pa.array(texts, pa.string()), "n_lines": pa.array(n, pa.int64()), "n_kept": pa.array(kept, pa.int64())}
                yield pa.RecordBatch.from_arrays([new[c] if c in new else part.column(c) for c in names], names)

    return run


def dedup_lines(docs: DataFrame, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs with later near-duplicate lines cut from text (see removed_lines), and n_lines and n_kept, the
    numbers of lines before and after; a null text has none and stays. Columns of docs named so are replaced, others
    are kept. A text that loses all its lines becomes empty. Columns named __doc, __th or __removed are refused."""
    if taken := {"__doc", "__th", "__removed"} & set(docs.columns):
        raise ValueError(f"docs has columns of reserved names: {sorted(taken)}")
    scratch = scratch or Scratch(docs.sparkSession, "line_dedup")
    gone = removed_lines(docs, percent, scratch)
    rest = [c for c in docs.columns if c not in ("n_lines", "n_kept")]
    cut = gone.select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th"), F.col("removed").alias("__removed"))
    cut = small(cut, gone.agg(F.sum("n")).first()[0] or 0)
    mine = (F.col("doc_id").cast("long") == F.col("__doc")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__th"))
    joined = docs.select(*(F.col(f"`{c}`") for c in rest)).join(cut, mine, "left").drop("__doc", "__th")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != "__removed"] + ["n_lines long", "n_kept long"])
    return joined.mapInArrow(tidy(_without([*rest, "n_lines", "n_kept"])), schema)
