"""Inverted lists of sets: which lists a set enters, and a pass over sorted lists that gives candidate pairs.

*Order.* Values are ordered by a table of COUNTERS hashed counters over the whole corpus, rare before common. Its size
is fixed, and collisions in it only change speed, as any common order is right.

*Entries.* Sets that must share c of their values meet among the (n - c + 1) first of each (prefix filter). The list of
a value that is counted more than HOT times is replaced by lists of two, and if need be three, values: of the first two
that sets share, both lie among the (n - c + 2) first of each, and so on. That is decided by the value alone, so it is
the same for all sets, and only makes lists finer.

*Pass.* Members of a list are compared in the order in which they are preferred as partners, within classes of sizes
that can meet. Lengths, the positions of the value, and a bitmap reject pairs, all by proven bounds: each value of a set
flips one of 128 bits, so bitmaps differ in no more bits than sets differ in values. A member takes up to QUOTA partners
in a list, so that a group of n copies costs n and not its square. A list in which a member reached that number is given
out as open: the caller compares its members further where the partners so far did not settle the matter. So is a list
of more than CHUNK members, which is compared in pieces; no more than that is held.

*Deals.* Rows of longs are dear to sort and convert one by one. So dealt() packs those of a task, some at a time, into
blocks by hashed buckets of values, and meetings_dealt() sorts a bucket at a time where its blocks come together."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import words as W

COUNTERS = 1 << 22
HOT = 1 << 14
QUOTA = 4
CHUNK = 1 << 17
_SLICE = 1 << 16
#: Entries that a task packs at once, and that a bucket has, about.
DEAL, IN_BUCKET = 1 << 17, 1 << 16
#: Marks, in the low half of a size, a member that needs only `loose` (see Bound).
LOOSE = 1 << 31
_REST = LOOSE - 1

U64 = np.uint64


def bucket(values: np.ndarray) -> np.ndarray:
    return ((values.view(np.uint64) >> U64(7)) & U64(COUNTERS - 1)).astype(np.int64)


def _code(counts: np.ndarray) -> np.ndarray:
    return np.minimum(255, 6 * np.log2(1.0 + counts)).astype(np.uint8)


class Counter:
    """Hashed counts of a task's values. Slices leave it as compressed logarithms."""

    def __init__(self) -> None:
        self.total, self.held, self.size = np.zeros(COUNTERS, dtype=np.int64), [], 0

    def add(self, values: np.ndarray) -> None:
        self.held.append(bucket(values).astype(np.int32))
        self.size += len(values)
        if self.size > 1 << 20:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.total += np.bincount(np.concatenate(self.held), minlength=COUNTERS)
        self.held, self.size = [], 0

    def slices(self) -> Iterator[tuple[int, bytes]]:
        self._flush()
        step = min(_SLICE, COUNTERS)
        for k in range(0, COUNTERS, step):
            if (part := self.total[k : k + step]).any():
                yield k // step, zlib.compress(_code(part).tobytes(), 1)


def _sum_slices(last: bool):
    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(min(_SLICE, COUNTERS))
        for packed in table.column("counts"):
            total += np.exp2(np.frombuffer(zlib.decompress(packed.as_py()), dtype=np.uint8) / 6.0) - 1
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(_code(total).tobytes(), 1)], pa.binary())})

    return run


def rarity(slices: DataFrame) -> np.ndarray:
    """Rows (part, counts) of all tasks to the logarithmic counts of all values, on the driver: one byte for each of
    COUNTERS, whatever the input. Slices are summed in two steps, so that no task reads those of all tasks."""
    schema = "part int, counts binary"
    lanes = slices.select("part", "counts").withColumn("lane", F.pmod(F.xxhash64("counts"), F.lit(256)))
    summed = lanes.groupBy("part", "lane").applyInArrow(_sum_slices(False), schema).groupBy("part").applyInArrow(_sum_slices(True), schema)
    out = np.zeros(COUNTERS, dtype=np.uint8)
    step = min(_SLICE, COUNTERS)
    for row in summed.toLocalIterator():
        out[row.part * step : (row.part + 1) * step] = np.frombuffer(zlib.decompress(bytes(row.counts)), dtype=np.uint8)
    return out


class Bound:
    """What two sets of at least `percent` / 100 Jaccard similarity must fulfil. With loose: members that are marked so
    match from that percentage on, and meet only others that are."""

    def __init__(self, percent: int, loose: int | None = None):
        self.percent, self.loose = percent, percent if loose is None else loose
        self.hot, self.quota, self.chunk = HOT, QUOTA, CHUNK
        least = -(-percent // (100 - percent)) if percent < 100 else 1
        #: Values that a list can be keyed by, as any two sets that match share that many.
        self.depth = min(3, max(1, -(-percent * least // 100)))
        self.classes = [1]
        while self.classes[-1] < 1 << 40:
            self.classes.append(100 * self.classes[-1] // percent + 1)
        self.classes = np.array(self.classes)

    def alone(self, n: np.ndarray) -> np.ndarray:
        """Sets so small that only equal ones are similar enough."""
        return n * 100 < self.percent * (n + 1)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n + self.percent * n // -100 + 1

    def size_class(self, n: np.ndarray) -> np.ndarray:
        """Similar sets are in one class or in two that follow each other."""
        return np.searchsorted(self.classes, n, side="right") - 1

    def fits(self, m: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of the pairs of members x and y can match, as their numbers in x."""
        na, nb = m["n"][x], m["n"][y]
        percent = np.where(m["loose"][x], self.loose, self.percent)
        at = np.flatnonzero(np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent)
        x, y, total, percent = x[at], y[at], na[at] + nb[at], percent[at]
        need = -(-total * percent // (100 + percent))
        good = np.flatnonzero(np.minimum(m["rest"][x], m["rest"][y]) >= need)
        at, x, y = at[good], x[good], y[good]
        differ = sum(np.bitwise_count((m[c][x] ^ m[c][y]).view(np.uint64)).astype(np.int64) for c in ("b0", "b1"))
        return at[differ <= total[good] - 2 * need[good]]

    def allowed_sql(self, total: Column) -> Column:
        """The most values that are in one of two sets only, for sets that match and have `total` values together."""
        return total - F.ceil(total * self.percent / (self.percent + 100)) * 2

    def fits_sql(self, a: str, b: str) -> Column:
        """fits() for columns {a}size, {a}b0, {a}b1 and those of b."""
        n = lambda p: F.shiftright(f"{p}size", 32)
        rest = lambda p: F.col(f"{p}size").bitwiseAND(F.lit(_REST))
        na, nb = n(a), n(b)
        percent = F.when(F.col(f"{a}size").bitwiseAND(F.lit(LOOSE)) != 0, self.loose).otherwise(self.percent)
        need = F.ceil((na + nb) * percent / (percent + 100))
        differ = F.bit_count(F.col(f"{a}b0").bitwiseXOR(F.col(f"{b}b0"))) + F.bit_count(F.col(f"{a}b1").bitwiseXOR(F.col(f"{b}b1")))
        return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (F.least(rest(a), rest(b)) >= need) & (differ <= na + nb - need * 2)


def bitmaps(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sets that begin at `begin`, 128 bits each, of which every value flips one."""
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = (values.view(np.uint64) >> U64(29)) & U64(127)
    bit = U64(1) << (place & U64(63))
    low = place < 64
    return tuple(np.bitwise_xor.reduceat(np.where(side, bit, U64(0)), begin).view(np.int64) for side in (low, ~low))


def entries(tokens: np.ndarray, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, bound: Bound, take: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of lists, the sets that enter them, and the most values that a set can share with others of the list.
    tokens: of all sets, each set's rarest first, with their codes; begin, size: of the sets (retained values, if not
    all), whose whole sizes are in bound.prefix's argument `take`: (whole sizes, which sets are wanted)."""
    whole, wanted = take
    prefix = np.where(wanted, bound.prefix(whole), 0)
    count = np.minimum(prefix, size)
    owner = np.repeat(np.arange(len(begin)), count)
    pos = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    value = tokens[begin[owner] + pos].view(np.uint64)
    limit = int(_code(np.array([float(bound.hot)]))[0])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for depth in range(1, bound.depth + 1):
        hot = (codes[begin[owner] + pos] > limit) if depth < bound.depth else np.zeros(len(owner), dtype=bool)
        cold = ~hot
        out.append((value[cold], owner[cold], size[owner[cold]] - pos[cold] + depth - 1))
        owner, pos, value = owner[hot], pos[hot], value[hot]
        # each with every later one of the longer prefix
        more = np.maximum(np.minimum(prefix[owner] + depth, size[owner]) - pos - 1, 0)
        first = np.cumsum(more) - more
        step = np.arange(int(more.sum())) - np.repeat(first, more)
        owner, pos, value = np.repeat(owner, more), np.repeat(pos, more) + 1 + step, np.repeat(value, more)
        value = W.mix(value * U64(0xC4CEB9FE1A85EC53) + tokens[begin[owner] + pos].view(np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def packed(whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (whole.astype(np.int64) << 32) | rest.astype(np.int64)


ENTRY = ["value", "key", "size", "b0", "b1"]


def schema(places: list[str]) -> str:
    """Of meetings(): rows with a null value are pairs of a member and a partner p; the others are members of open
    lists, of which those that `more` marks may have partners that no pair names."""
    return ", ".join(f"{c} long" for c in [*ENTRY, *places, "pkey", *(f"p{c}" for c in places)]) + ", more boolean"


BLOCKS = "bucket int, entries binary"


def dealt(parts: Iterator[tuple[np.ndarray, ...]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Columns of entries, the value first, as BLOCKS: of each bucket of values the columns one after the other."""

    def packed_blocks(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        cols = np.stack([np.concatenate(c).view(np.int64) for c in zip(*held, strict=True)])
        which = (W.mix(cols[0].view(np.uint64)) % U64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        order = np.argsort(which, kind="stable")
        which, cols = which[order], cols[:, order]
        begin = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
        blocks = [cols[:, a:b].tobytes() for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(which)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(which[begin].astype(np.int32)), pa.array(blocks, pa.binary())], ["bucket", "entries"])

    held, size = [], 0
    for part in parts:
        if len(part[0]):
            held.append(part)
            size += len(part[0])
        if size >= DEAL:
            yield packed_blocks(held)
            held, size = [], 0
    if held:
        yield packed_blocks(held)


def meetings(bound: Bound, places: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows ENTRY + places, sorted by value. Earlier members, by places and then key, are partners
    of later ones."""
    return _meetings(bound, places)[0]


def meetings_dealt(bound: Bound, places: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """meetings() over BLOCKS of the same rows, those of a bucket together."""
    return _meetings(bound, places)[1]


def _meetings(bound: Bound, places: list[str]):
    names = [*ENTRY, *places]
    by = [*places, "key"]

    def give(m: dict[str, np.ndarray], rows: np.ndarray, partners: np.ndarray | None, more: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(rows), pa.int64())
        cols = [none if c == "value" and partners is not None else pa.array(m[c][rows]) for c in names]
        cols += [none if partners is None else pa.array(m[c][partners]) for c in ("key", *places)]
        cols.append(pa.nulls(len(rows), pa.bool_()) if more is None else pa.array(more[rows]))
        return pa.RecordBatch.from_arrays(cols, [*names, "pkey", *(f"p{c}" for c in places), "more"])

    def compared(m: dict[str, np.ndarray], split: int | list[int] | None) -> Iterator[pa.RecordBatch]:
        """Whole lists, but those of the value or values `split`."""
        v = m["value"]
        same = np.zeros(len(v) + 1, dtype=bool)
        same[1:-1] = v[1:] == v[:-1]
        inner = same[:-1] | same[1:]
        if split is not None:
            inner |= np.isin(v, split)
        m = {c: x[inner] for c, x in m.items()}
        v, count = m["value"], int(inner.sum())
        if not count:
            return
        m["n"], m["rest"], m["loose"] = m["size"] >> 32, m["size"] & _REST, (m["size"] & LOOSE) != 0
        new = np.concatenate([[True], v[1:] != v[:-1]])
        which = np.cumsum(new) - 1
        rank = np.empty(count, dtype=np.int64)
        rank[np.lexsort([m[c] for c in reversed(by)])] = np.arange(count)
        kind = np.where(m["loose"], 0, bound.size_class(m["n"]))
        # each member is in the list of its class, and a visitor in that of the next
        base = np.tile(np.arange(count), 2)
        group = np.concatenate([which * 256 + kind, which * 256 + kind + 1])
        visits = np.repeat([False, True], count)
        order = np.lexsort([rank[base], group])
        base, group, visits = base[order], group[order], visits[order]
        head = np.concatenate([[True], group[1:] != group[:-1]])
        begin = np.flatnonzero(head)[np.cumsum(head) - 1]
        got = np.zeros(count, dtype=np.int32)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        y, r = np.flatnonzero(~head), 0
        while len(y):
            x = begin[y] + r
            own = ~(visits[x] & visits[y])
            at = y[own]
            bx, by_ = base[x[own]], base[at]
            copy = m["key"][bx] == m["key"][by_]
            if copy.any():  # a later copy of a set adds nothing
                got[by_[copy]] = 1 << 30
                bx, by_ = bx[~copy], by_[~copy]
            good = bound.fits(m, bx, by_)
            if len(good):
                found.append((bx[good], by_[good]))
                np.add.at(got, by_[good], 1)
            r += 1
            y = y[(begin[y] + r < y) & (got[base[y]] < bound.quota)]
        if found:
            px, py = (np.concatenate(c) for c in zip(*found, strict=True))
            _, once = np.unique(W.mix(m["key"][px].view(np.uint64)) * U64(3) + m["key"][py].view(np.uint64), return_index=True)
            yield give(m, py[once], px[once], None)
        more = (got >= bound.quota) & (got < 1 << 30)
        if split is not None:
            more |= np.isin(v, split) & (got < 1 << 30)
        if more.any():
            open_ = np.zeros(int(which[-1]) + 1, dtype=bool)
            open_[which[more]] = True
            yield give(m, np.flatnonzero(open_[which] & (got < 1 << 30)), None, more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, split = 0, None

        def arrays(rows: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
            return {c: np.concatenate([b.column(c).to_numpy() for b in rows]) for c in names}

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size < bound.chunk:
                continue
            m = arrays(held)
            cut = int(np.searchsorted(m["value"], m["value"][-1]))
            if cut == 0:  # one list fills all that is held
                split = int(m["value"][-1])
                cut = size
            yield from compared({c: x[:cut] for c, x in m.items()}, split)
            rest = {c: x[cut:] for c, x in m.items()}
            size -= cut
            held = [pa.RecordBatch.from_arrays([pa.array(rest[c]) for c in names], names)] if size else []
        if held:
            yield from compared(arrays(held), split)

    def sorted_(held: list[np.ndarray]) -> np.ndarray:
        cols = np.concatenate(held, axis=1)
        return cols[:, np.argsort(cols[0])]

    def run_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, now, split, most = 0, None, [], 2 * bound.chunk

        def done() -> Iterator[pa.RecordBatch]:
            """What is held, in pieces of whole lists, each a chunk and a list long at most."""
            cols = sorted_(held)
            new = np.flatnonzero(cols[0, 1:] != cols[0, :-1]) + 1
            a = 0
            while a < cols.shape[1]:
                k = np.searchsorted(new, a + bound.chunk)
                b = int(new[k]) if k < len(new) else cols.shape[1]
                yield from compared(dict(zip(names, cols[:, a:b], strict=True)), split or None)
                a = b

        for b in batches:
            for bucket, block in zip(b.column("bucket").to_pylist(), b.column("entries"), strict=True):
                if bucket != now:
                    now = bucket
                    # small buckets are compared together
                    if held and (split or size >= bound.chunk):
                        yield from done()
                        held, size, split, most = [], 0, [], 2 * bound.chunk
                held.append(np.frombuffer(block.as_buffer(), dtype=np.int64).reshape(len(names), -1))
                size += held[-1].shape[1]
                if size < most:
                    continue
                # lists so long that they are not held whole are compared by what there is of them
                cols = sorted_(held)
                value, count = np.unique(cols[0], return_counts=True)
                split = sorted({*split, *value[count > bound.chunk // 2].tolist()})
                long = np.isin(cols[0], split)
                if long.any():
                    yield from compared(dict(zip(names, cols[:, long], strict=True)), split)
                held = [cols[:, ~long]]
                size = held[0].shape[1]
                most = size + bound.chunk
        if held:
            yield from done()

    return run, run_dealt
