"""Near-duplicate documents by bottom-k sketches of one hash function.

Steps, each a distributed job:

1. *Sketch*: every text becomes the set of its distinct word shingles, as 64-bit hashes; the SKETCH smallest are
   retained. Equal sets share a 64-bit key, and only one sketch of a key takes part in what follows. Sketches are not
   stored, as they take more room than the texts; the steps that need them build them again.
2. *Inverted lists*: values are dealt to PARTS parts by their bits. Of two sets of the wanted similarity at least one
   part is as similar: if each shared less than its due, so would the whole. So parts are listed as sets of their own,
   by their rarest values (see lists.py for their order and for what rejects pairs), and are so small that the bits of
   a list member tell parts that are not similar. Sets under SMALL are one part. Sets beyond SKETCH, and those that can
   match them, are listed by their LISTED smallest values, of which links share at least c.
3. *Links*: a set takes a few partners from each of its lists, so a group of copies costs its size and not its square.
   Sets that may have more are, after a first verification, compared with the members of their lists in other
   components, so that no link between components is lost. In crowds, as of near copies of one text, most such sets are
   too far from all others, and comparing each with each would take the square of the crowd. So a crowd is listed once
   more, by the values in which its sets differ from one of them, its pivot: a set that is not linked with the pivot
   shares about half of these with any set that it is linked with, and they are rare, where those of the text are not.
4. *Verify*: every value of a set flips one of PARITY bits; sets whose bits differ in more places than a link allows
   values to differ are rejected, which is proven. What is left is brought together in blocks of sets, each set once a
   block. Union-sketch estimates reject; sets within SKETCH are exact already, larger ones are built again from whole
   texts and compared in full.
5. *Components* over the links.

Links of sets within SKETCH are all found. A link of larger sets exactly at the threshold is missed with a probability
under 1e-6, as c, and what step 4 asks of union sketches, are SIGMAS standard deviations below the expected numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import lists as L
from gridloom.llm import words as W
from gridloom.llm.components import components
from gridloom.llm.scratch import Scratch, small
from gridloom.llm.workers import tidy

SKETCH = 1024
SIGMAS = 5.2
#: Sets from SMALL on are listed in PARTS parts (a power of 2); beyond SKETCH, with their LISTED smallest values.
SMALL, PARTS, LISTED = 192, 8, 512
PARITY = 2048
#: Values of sets that are compared in one block.
BLOCK = 1 << 17
#: Members from which a crowd is compared by differences from its pivot, and how many of them a copy of the pivot serves.
CROWD, LANE = 32, 1024
#: Keys that a task remembers, so as not to list a copy again.
SEEN = 100_000
#: Values of sketches that leave a task at once.
_BATCH = 1 << 18


def shingles(group: W.Group, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the width-word shingles of a group's rows, with the bounds of rows; shorter texts are one shingle."""
    h, bounds = group.hashes(), group.bounds()
    count = np.diff(bounds)
    n = len(h)
    acc = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        m = max(n - k, 0)
        acc[:m] = W.mix(acc[:m] * np.uint64(0xFF51AFD7ED558CCD) + h[n - m :])
    whole = (count > 0) & (count < width)
    take = np.where(whole, 1, np.maximum(count - width + 1, 0))
    for r in np.flatnonzero(whole):
        x = np.full(1, count[r], dtype=np.uint64)
        for w in range(bounds[r], bounds[r + 1]):
            x = W.mix(x * np.uint64(0xC4CEB9FE1A85EC53) + h[w : w + 1])
        acc[bounds[r]] = x[0]
    return acc, bounds[:-1], take


def row_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a batch, its distinct shingle hashes, ascending."""
    for g in W.groups(batch.column("text"), W.SPACED):
        acc, begin, take = shingles(g, width)
        for r in range(g.rows):
            yield g.first + r, np.unique(acc[begin[r] : begin[r] + take[r]].view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))


def set_key(values: np.ndarray) -> int:
    u = values.view(np.uint64)
    with np.errstate(over="ignore"):
        total = np.add.reduce(W.mix(u ^ np.uint64(0x5851F42D4C957F2D))) if len(u) else np.uint64(0)
        return int(W.mix(np.array([total + np.uint64(len(u))], dtype=np.uint64)).view(np.int64)[0])


def _far(percent: int, retained: int) -> int:
    """How many of the `retained` smallest values of their union two linked sets share, at least."""
    t = percent / 100
    return max(1, math.floor(retained * t - SIGMAS * math.sqrt(retained * t * (1 - t))))


def _loose(percent: int) -> int:
    """The similarity, in percent, that the LISTED smallest values of two linked sets have at least."""
    k = min(LISTED, SKETCH)
    far = _far(percent, k)
    return max(1, min(percent, 100 * far // (2 * k - far)))


def parity(values: np.ndarray) -> bytes:
    places = (values.view(np.uint64) % np.uint64(PARITY)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=PARITY) & 1).astype(np.uint8)).tobytes()


def _near(bound: L.Bound, names: list[str]):
    """The pairs (x, y, xn, yn, xp, yp, ...) whose parities a link allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1) for c in ("xp", "yp")]
            differ = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)
            total = b.column("xn").to_numpy() + b.column("yn").to_numpy()
            both = -(-total * bound.percent // (100 + bound.percent))
            yield b.select(names).filter(pa.array(differ <= total - 2 * both))

    return run


_SET = "row long, doc_id long, n long, key long, parity binary, part int, counts binary"


def _sketcher(width: int):
    """A row for each text, and the task's counts of sketched values."""
    names = [f.split()[0] for f in _SET.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # numbers of rows, which stay as they are once the table is written
        number = TaskContext.get().partitionId() << 40
        counter, seen = L.Counter(), set()
        for b in batches:
            ids, rows = b.column("doc_id"), []
            for r, s in row_sets(b, width):
                rows.append((len(s), key := set_key(s), parity(s)))
                if len(s) and ids[r].is_valid and _unseen(key, seen):
                    counter.add(s[:SKETCH])
            own = pa.array(np.arange(number, number + len(rows)))
            number += len(rows)
            sizes, keys, bits = zip(*rows, strict=True) if rows else ((), (), ())
            cols = [own, ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], names)
        for part, counts in counter.slices():
            cols = [*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([part], pa.int32()), pa.array([counts], pa.binary())], names)

    return run


def _unseen(key: int, seen: set) -> bool:
    """Whether the task has not met a key lately; the memory of keys is bounded."""
    if key in seen:
        return False
    if len(seen) > SEEN:
        seen.clear()
    seen.add(key)
    return True


class _Level:
    """How sets whose larger one has a size of this level meet: by parts of their first `most` values."""

    def __init__(self, salt: int, parts: int, most: int, bound: L.Bound, mark: int):
        self.salt, self.parts, self.most, self.bound, self.mark = np.uint64(salt), np.uint64(parts), most, bound, mark


def _levels(bound: L.Bound) -> list[_Level]:
    return [
        _Level(0, 1, SKETCH, bound, 0),
        _Level(0x9E3779B97F4A7C15, PARTS, SKETCH, bound, 0),
        _Level(0xD6E8FEB86659FD93, PARTS, min(LISTED, SKETCH), L.Bound(bound.loose), L.LOOSE),
    ]


def _level(n: np.ndarray) -> np.ndarray:
    return np.where(n > SKETCH, 2, np.where(n < SMALL, 0, 1))


def _listed(level: _Level, tokens: np.ndarray, row: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries of a level, as columns of L.ENTRY with rows instead of keys. tokens: of the rows."""
    part = row * int(level.parts) + ((tokens.view(np.uint64) >> np.uint64(36)) & (level.parts - np.uint64(1))).astype(np.int64)
    code = table[L.bucket(tokens)]
    order = np.lexsort((tokens, code, part))
    tokens, row, part, code = tokens[order], row[order], part[order], code[order]
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    n = np.diff(np.append(begin, len(part)))
    low, high = L.bitmaps(tokens, begin)
    # parts so small that only equal ones are similar meet by all their values at once
    alone = level.bound.alone(n)
    value, of, rest = L.entries(tokens, code, begin, n, level.bound, (n, ~alone))
    equal = np.flatnonzero(alone)
    total = np.add.reduceat(W.mix(tokens.view(np.uint64)), begin)
    value = np.concatenate([W.mix(value ^ level.salt), W.mix((total + n.astype(np.uint64)) ^ ~level.salt)[equal]])
    of, rest = np.concatenate([of, equal]), np.concatenate([rest, n[equal]])
    return value.view(np.int64), row[begin][of], L.packed(n[of], rest | level.mark), low[of], high[of]


def _entries(codes, bound: L.Bound, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, levels = codes.value, set(), _levels(bound)

        def listed(sets: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            keys, whole = np.array([x[0] for x in sets], dtype=np.int64), np.array([x[1] for x in sets], dtype=np.int64)
            # a pair is of its larger set's level, so a set is listed up to that of its largest match
            own, largest = _level(whole), _level(whole * 100 // bound.percent)
            for k, level in enumerate(levels):
                mine = np.flatnonzero((own <= k) & (k <= largest))
                if not len(mine):
                    continue
                parts = [sets[i][2][: level.most] for i in mine]
                row = np.repeat(mine, [len(x) for x in parts])
                value, of, *rest = _listed(level, np.concatenate(parts), row, table)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (value, keys[of], *rest)], L.ENTRY)

        for b in batches:
            held, size = [], 0
            for _, s in row_sets(b, width):
                # a set so small that only equal ones are similar needs no list
                if len(s) and not bound.alone(len(s)) and _unseen(key := set_key(s), seen):
                    held.append((key, len(s), s[:SKETCH].copy()))
                    size += len(held[-1][2])
                if size > _BATCH:
                    yield from listed(held)
                    held, size = [], 0
            if held:
                yield from listed(held)

    return run


def _judge_sketches(percent: int):
    """Verdict 1: a link, as both sketches are whole sets. 0: open. -1: no link, or too low an estimate."""
    far = _far(percent, SKETCH)

    def judge(n: int, x: np.ndarray, m: int, y: np.ndarray) -> int:
        both = np.concatenate([x, y])
        both.sort()
        twice = both[:-1][both[1:] == both[:-1]]
        union = len(both) - len(twice)
        if n <= len(x) and m <= len(y):
            return 1 if 100 * len(twice) >= percent * union else -1
        if union > SKETCH:
            twice = twice[twice <= np.unique(both)[SKETCH - 1]]
        return 0 if len(twice) >= far else -1

    return judge


def _judge_sets(percent: int):
    def judge(n: int, x: np.ndarray, m: int, y: np.ndarray) -> int:
        both = np.concatenate([x, y])
        both.sort()
        k = int((both[1:] == both[:-1]).sum())
        return 1 if 100 * k >= percent * (len(both) - k) else -1

    return judge


def _comparer(judge):
    def run(pairs: pa.Table, members: pa.Table) -> pa.Table:
        pairs, members = pairs.combine_chunks(), members.combine_chunks()
        sets = {}
        for chunk in members.to_batches():
            col, values = chunk.column("values").offsets.to_numpy(), chunk.column("values").values.to_numpy()
            for i, (k, n) in enumerate(zip(chunk.column("key").to_pylist(), chunk.column("n").to_pylist(), strict=True)):
                sets[k] = n, values[col[i] : col[i + 1]]
        xs, ys = pairs.column("x").to_pylist(), pairs.column("y").to_pylist()
        said = np.array([judge(*sets[x], *sets[y]) for x, y in zip(xs, ys, strict=True)], dtype=np.int32)
        keep = np.flatnonzero(said >= 0)
        return pa.table({"x": pa.array([xs[i] for i in keep], pa.int64()), "y": pa.array([ys[i] for i in keep], pa.int64()), "verdict": pa.array(said[keep], pa.int32())})

    return run


def _built_sets(width: int, most: int):
    """The sets of texts, or their `most` smallest values, where they are those of the row's key (a doc_id can have
    several texts). n is the size of the full set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want, keys, sizes, sets, held = b.column("key").to_pylist(), [], [], [], 0
            for r, s in row_sets(b, width):
                if set_key(s) == want[r]:
                    keys.append(want[r])
                    sizes.append(len(s))
                    sets.append(s[:most].copy())
                    held += len(sets[-1])
                if keys and (held > _BATCH or r == b.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), _lists(sets)], ["key", "n", "values"])
                    keys, sizes, sets, held = [], [], [], 0

    return run


class _Linker:
    def __init__(self, docs: DataFrame, width: int, percent: int, scratch: Scratch):
        self.spark, self.scratch, self.width, self.bounds = docs.sparkSession, scratch, width, L.Bound(percent, _loose(percent))
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        kept = scratch.keep(self.docs.mapInArrow(tidy(_sketcher(width)), _SET))
        self.sets = kept.where("part is null").drop("part", "counts")
        self.counts = kept.where("part is not null").select("part", "counts")
        self.classes = scratch.keep(
            self.sets.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.min("n").alias("n"))
        )

    def met(self) -> DataFrame:
        codes = self.spark.sparkContext.broadcast(L.rarity(self.counts))
        texts = self.docs.where("doc_id is not null").select("text")
        rows = texts.mapInArrow(tidy(_entries(codes, self.bounds, self.width)), ", ".join(f"{c} long" for c in L.ENTRY))
        rows = rows.repartition("value").sortWithinPartitions("value")
        return self.scratch.keep(rows.mapInArrow(tidy(L.meetings(self.bounds, [])), L.schema([])))

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, y, ...) that their parities allow, kept."""
        bits = self.of_classes("key", "n", "parity")
        side = lambda c: bits.select(F.col("key").alias(c), F.col("n").alias(f"{c}n"), F.col("parity").alias(f"{c}p"))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
        return self.scratch.keep(pairs.join(side("x"), "x").join(side("y"), "y").mapInArrow(tidy(_near(self.bounds, pairs.columns)), schema))

    def of_classes(self, *columns: str) -> DataFrame:
        """Columns of one row of sets for each key."""
        return self.sets.join(small(self.classes.select("row")), "row", "left_semi").select(*columns)

    def compared(self, pairs: DataFrame, sets: DataFrame, most: int, judge) -> DataFrame:
        """Rows (x, y, verdict) of the pairs that the judge leaves. sets: key, n, values. Pairs that hang together go to
        the same blocks, of about BLOCK values each; a set goes to a block once for all its pairs there."""
        keep = self.scratch.keep
        # a set's group is the least set that it is paired with, so most of a group of copies has one
        both = pairs.select(F.col("x").alias("node"), F.col("y").alias("other")).unionByName(pairs.select(F.col("y").alias("node"), F.col("x").alias("other")))
        parts = keep(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")))
        sized = parts.join(self.classes, F.col("node") == F.col("key")).select("node", "label", F.least("n", F.lit(most)).alias("n"))
        weigh = sized.groupBy("label").agg(F.sum("n").alias("w"))
        total = weigh.agg(F.sum("w")).first()[0] or 0
        place = keep(
            parts.join(weigh, "label").select(
                "node", F.pmod(F.xxhash64("label"), F.lit(total // BLOCK + 1)).alias("g"), F.pmod(F.xxhash64("node"), F.floor(F.col("w") / BLOCK) + 1).alias("b")
            )
        )
        side = lambda c: small(place).select(F.col("node").alias(c), *([F.col("g")] if c == "x" else []), F.col("b").alias(f"{c}b"))
        dealt = pairs.join(side("x"), "x").join(side("y"), "y").select("g", F.least("xb", "yb").alias("lo"), F.greatest("xb", "yb").alias("hi"), "x", "y")
        dealt = keep(dealt)
        ends = keep(dealt.select("g", "lo", "hi", F.col("x").alias("key")).unionByName(dealt.select("g", "lo", "hi", F.col("y").alias("key"))).distinct())
        members = sets.join(small(ends), "key").select(F.col("g").alias("mg"), F.col("lo").alias("mlo"), F.col("hi").alias("mhi"), "key", "n", "values")
        out = keep(dealt.groupBy("g", "lo", "hi").cogroup(members.groupBy("mg", "mlo", "mhi")).applyInArrow(_comparer(judge), "x long, y long, verdict int"))
        self.scratch.drop(parts, place, dealt, ends)
        return out

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (x, y) of set keys that are links."""
        keep = self.scratch.keep
        pairs = keep(pairs)
        reps = keep(self.classes.join(small(self.ends(pairs)), "key").select("key", F.col("rep").alias("doc_id")))
        judged = self.compared(pairs, self.built(reps, SKETCH), SKETCH, _judge_sketches(self.bounds.percent))
        open_ = keep(judged.where("verdict = 0").select("x", "y"))
        some = keep(reps.join(small(self.ends(open_)), "key").select("key", "doc_id"))
        links = self.compared(open_, self.built(some, 1 << 40), 1 << 40, _judge_sets(self.bounds.percent))
        out = keep(judged.where("verdict = 1").select("x", "y").unionByName(links.select("x", "y")))
        self.scratch.drop(pairs, reps, judged, open_, some, links)
        return out

    def built(self, reps: DataFrame, most: int) -> DataFrame:
        """Rows (key, n, values) of the sets of the rows (key, doc_id), each once."""
        texts = self.docs.where("doc_id is not null").join(small(reps), "doc_id").select("key", "text")
        sets = texts.mapInArrow(tidy(_built_sets(self.width, most)), "key long, n long, values array<bigint>")
        return sets.dropDuplicates(["key"]) if self.repeated_ids() else sets

    def ends(self, pairs: DataFrame) -> DataFrame:
        return self.scratch.keep(pairs.select(F.col("x").alias("key")).unionByName(pairs.select(F.col("y").alias("key"))).distinct())

    def repeated_ids(self) -> int:
        """How many doc_ids have several rows with words."""
        if not hasattr(self, "_repeated"):
            several = self.sets.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("u"), F.max("key").alias("v"), F.count("*").alias("c"))
            self.several = self.scratch.keep(several.where("c > 1").select("u", "v", "doc_id"))
            self._repeated = self.several.count()
        return self._repeated

    def same_id(self) -> DataFrame:
        """Edges between different texts that share a doc_id."""
        if not self.repeated_ids():
            return self.several.select("u", "v")
        ids = self.several.where("u != v").select("doc_id", "u")
        return self.sets.where("n > 0").join(ids, "doc_id").select("u", F.col("key").alias("v"))

    def crowds(self, mixed: DataFrame) -> DataFrame:
        """Rows (key, part, home, pivot, lanes) of the members of crowds. A list's main component is that of most of its
        members, and a set's home that of most of its lists. Sets of one home are a crowd. Its pivot is the set of the
        home that is in most lists, as it has the fewest values of its own."""
        keep = self.scratch.keep
        most = lambda c: F.max(F.struct("count", c)).getField(c)
        main = mixed.groupBy("value", "part").count().groupBy("value").agg(most("part").alias("home"))
        homes = mixed.join(main, "value").groupBy("key", "part", "home").count()
        homes = keep(homes.groupBy("key", "part").agg(most("home").alias("home"), F.sum("count").alias("count")))
        own = F.col("part") == F.col("home")
        pivot = F.coalesce(F.max(F.when(own, F.struct("count", "key"))).getField("key"), "home")
        sizes = homes.groupBy("home").agg(F.count("*").alias("c"), F.max(~own).alias("open"), pivot.alias("pivot"))
        sizes = keep(sizes.where(F.col("open") & (F.col("c") >= CROWD)).select("home", "pivot", (F.floor(F.col("c") / LANE) + 1).alias("lanes")))
        out = keep(homes.drop("count").join(small(sizes), "home").select("key", "part", "home", "pivot", "lanes"))
        self.scratch.drop(homes, sizes)
        return out

    def differences(self, crowds: DataFrame) -> DataFrame:
        """Rows (key, home, part, inside, n, d, least, values): the d values that are in a member or in its pivot, but not
        in both. Members that have little of the pivot are left out. inside: of the pivot's component, or linked with the
        pivot. least: how many of these a member shares at least with any that is linked with it and not inside.

        With allowed(x, y) for the most values in which linked sets differ, linked x and y share at least
        (dx + dy - allowed(x, y)) / 2 of theirs; y is not linked with the pivot p, so dy > allowed(y, p)."""
        keep = self.scratch.keep
        keys = crowds.select("key").unionByName(crowds.select(F.col("pivot").alias("key"))).distinct()
        reps = keep(self.classes.join(small(keep(keys)), "key").select("key", F.col("rep").alias("doc_id")))
        sets = keep(self.built(reps, 1 << 40))
        pivots = crowds.select("home", "pivot", "lanes").distinct().join(sets, F.col("pivot") == F.col("key"))
        pivots = keep(pivots.select("home", F.col("n").alias("pn"), F.col("values").alias("pv"), F.explode(F.sequence(F.lit(0), F.col("lanes").cast("int") - 1)).alias("lane")))
        own = sets.join(small(crowds), "key").withColumn("lane", F.pmod(F.xxhash64("key"), "lanes").cast("int"))
        own = own.join(small(pivots, pivots.agg(F.sum("pn")).first()[0] or 0), ["home", "lane"])
        own = own.withColumn("values", F.concat(F.array_except("values", "pv"), F.array_except("pv", "values"))).withColumn("d", F.size("values"))
        own = own.where("2 * d <= n + pn")
        inside = (F.col("part") == F.col("home")) | (F.col("d") <= self.bounds.allowed_sql(F.col("n") + F.col("pn")))
        percent = self.bounds.percent
        least = F.ceil((F.col("d") + (F.col("pn") - F.col("n")) * (100 - percent) / (100 + percent) - 1.001) / 2)
        out = keep(own.select("key", "home", "part", inside.alias("inside"), "n", "d", F.greatest(least, F.lit(1)).alias("least"), "values"))
        self.scratch.drop(reps, sets, pivots)
        return out

    def crowded(self, differ: DataFrame) -> DataFrame:
        """The pairs (x, y) of a crowd that may be links, but for those inside."""
        rows = differ.select("key", "home", F.when(F.col("inside"), F.col("home")).otherwise(F.col("part")).alias("part"), "inside", "n", "d", "least", F.explode("values").alias("value"))
        # what one member alone has is the rarest and meets nothing
        shared = rows.groupBy("home", "value").count().where("count > 1")
        # how many of a member's values are not before this one, rare before common
        left = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("count"), F.desc("value")))
        listed = self.scratch.keep(rows.join(shared, ["home", "value"]).withColumn("left", left).drop("count"))
        side = lambda p: listed.select("home", "value", *(F.col(c).alias(f"{p}{c}") for c in ["key", "part", "inside", "n", "d", "least", "left"]))
        met = side("x").where("xleft >= xleast").join(side("y").where("not yinside"), ["home", "value"])
        once = F.col("xinside") | ((F.col("yleft") >= F.col("yleast")) & (F.col("xkey") < F.col("ykey")))
        enough = F.least("xleft", "yleft") * 2 >= F.col("xd") + F.col("yd") - self.bounds.allowed_sql(F.col("xn") + F.col("yn"))
        met = met.where((F.col("xpart") != F.col("ypart")) & once & enough)
        out = self.scratch.keep(met.select(F.least("xkey", "ykey").alias("x"), F.greatest("xkey", "ykey").alias("y")).distinct())
        self.scratch.drop(listed)
        return out

    def links(self) -> DataFrame:
        """Edges (u, v) between set keys that have the components of all links."""
        keep = self.scratch.keep
        met = self.met()
        # of its partners a set first gets the one that it meets in most lists
        tried = self.near(met.where("value is null").groupBy(F.col("pkey").alias("x"), F.col("key").alias("y")).agg(F.count("*").alias("c")))
        offers = keep(tried.groupBy("y").agg(F.max_by("x", "c").alias("x")).select("x", "y"))
        edges = keep(self.verified(offers).select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(self.same_id()))
        first = keep(components(edges, self.scratch).distinct())
        part = lambda c: small(first).select(F.col("node").alias(c), F.col("label").alias(f"{c}part"))
        apart = F.coalesce("xpart", "x") != F.coalesce("ypart", "y")
        others = tried.select("x", "y").join(part("x"), "x", "left").join(part("y"), "y", "left").where(apart).select("x", "y").join(offers, ["x", "y"], "left_anti")
        open_ = met.where("value is not null")
        named = keep(open_.join(small(first), open_.key == first.node, "left").select(*L.ENTRY, "more", F.coalesce("label", "key").alias("part")))
        mixed = named.groupBy("value").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a != b").select("value")
        mixed = keep(named.join(mixed, "value"))
        crowds = self.crowds(mixed)
        differ = self.differences(crowds)
        inside = differ.where((F.col("part") != F.col("home")) & F.col("inside")).select(F.col("home").alias("u"), F.col("key").alias("v"))
        crowded = self.crowded(differ)
        mixed_ = mixed.join(small(differ.select("key", "home")), "key", "left")
        side = lambda p: mixed_.select("value", *(F.col(c).alias(f"{p}{c}") for c in [*L.ENTRY[1:], "part", "more", "home"]))
        # partners of a member are those with smaller keys
        pairs = side("x").join(side("y").where("ymore"), "value").where((F.col("xpart") != F.col("ypart")) & (F.col("xkey") < F.col("ykey")) & self.bounds.fits_sql("x", "y"))
        pairs = pairs.where(F.coalesce(F.col("xhome") != F.col("yhome"), F.lit(True))).select(F.col("xkey").alias("x"), F.col("ykey").alias("y"))
        pairs = pairs.distinct().unionByName(crowded).join(offers, ["x", "y"], "left_anti")
        more = self.near(others.unionByName(pairs).distinct())
        out = keep(edges.unionByName(inside).unionByName(self.verified(more).select(F.col("x").alias("u"), F.col("y").alias("v"))))
        self.scratch.drop(met, tried, offers, edges, first, named, mixed, crowds, differ, crowded, more)
        return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself
    included) and kept (doc_id = component_id). Two texts are linked if their sets of width-word shingles (lower-cased
    A-Z, words between white space, a shorter text as one shingle) have 100 * intersection >= percent * union.

    A null, empty or blank text has an empty set and is linked with nothing. Equal sets are linked. Rows that share a
    doc_id are one document: they get one component. A null doc_id takes no part and returns a null component_id, kept.
    Texts of any length are read whole, about half a megabyte or one text at a time. Other columns of docs are ignored. An
    empty table gives an empty one."""
    spark: SparkSession = docs.sparkSession
    scratch = scratch or Scratch(spark, "near_dedup")
    linker = _Linker(docs, width, percent, scratch)
    parts = components(linker.links(), scratch).distinct()
    classes = linker.classes.join(parts, F.col("key") == F.col("node"), "left").withColumn("label", F.coalesce("label", "key"))
    firsts = scratch.keep(classes.groupBy("label").agg(F.min("rep").alias("component_id")))
    named = scratch.keep(classes.join(firsts, "label").select("key", "component_id"))
    ids = linker.sets.select("doc_id", F.col("n").alias("n_shingles"), "key")
    out = ids.join(named, "key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).alias("component_id"),
    )
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
