"""Index arithmetic and placement of indices on ranks, as column expressions.

An index is a list of integer columns, one a dimension; ranges are their extents. All functions stay inside generated
code; none needs a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Dims = Sequence[Column]


def _long(x: Column | int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("long")


def add(a: Dims, b: Dims) -> list[Column]:
    return [x + y for x, y in zip(a, b, strict=True)]


def subtract(a: Dims, b: Dims) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def equal(a: Dims, b: Dims) -> Column:
    return reduce(lambda u, v: u & v, (x == y for x, y in zip(a, b, strict=True)))


def less(a: Dims, b: Dims) -> Column:
    """Order of indices: the last dimension decides first."""
    out = F.lit(False)
    for x, y in zip(a, b, strict=True):
        out = (x < y) | ((x == y) & out)
    return out


def order_keys(dims: Dims) -> list[Column]:
    """Sort keys of that order."""
    return list(reversed(dims))


def size(ranges: Dims) -> Column:
    return reduce(lambda u, v: u * v, map(_long, ranges))


def linear_last_fastest(dims: Dims, ranges: Dims) -> Column:
    """Linear index in which the last dimension has stride 1 (what the model's first linearisation computes)."""
    out = _long(dims[0])
    for d, r in zip(dims[1:], ranges[1:], strict=True):
        out = out * _long(r) + _long(d)
    return out


def linear_first_fastest(dims: Dims, ranges: Dims) -> Column:
    """Linear index in which the first dimension has stride 1."""
    return linear_last_fastest(list(reversed(dims)), list(reversed(ranges)))


def inside(dims: Dims, ranges: Dims) -> Column:
    return reduce(lambda u, v: u & v, ((d >= 0) & (d < r) for d, r in zip(dims, ranges, strict=True)))


def checked(value: Column, dims: Dims, ranges: Dims) -> Column:
    """The value; an index outside its ranges fails the query."""
    return F.when(inside(dims, ranges), value).otherwise(F.raise_error(F.lit("index out of range")).cast("long"))


def block_map(i: Column, n: Column | int, p: int) -> Column:
    """Rank of element i of n in contiguous blocks on p ranks, of which the first n % p are one element longer. An i
    beyond n wraps round."""
    i, n = _long(i), _long(n)
    f, r = F.floor(n / p), n % p
    h = r * (f + 1)
    small = r + F.floor((i - h) / F.when(f > 0, f))
    return F.when(i < h, F.floor(i / (f + 1))).when((i < n) & (f > 0), small).otherwise(i % p).cast("long")


def block_map_nd(dims: Dims, ranges: Dims, p: int) -> Column:
    return block_map(linear_last_fastest(dims, ranges), size(ranges), p)


def round_robin(dims: Dims, ranges: Dims, p: int) -> Column:
    return F.pmod(linear_last_fastest(dims, ranges), F.lit(p).cast("long"))


def xor_map(dims: Dims, p: int) -> Column:
    """Placement of indices without bounds."""
    return F.pmod(reduce(lambda u, v: u.bitwiseXOR(v), map(_long, dims)), F.lit(p).cast("long"))


def seed_map(seed: Column, p: int) -> Column:
    """A rank drawn from a seed; equal seeds give equal ranks."""
    return F.pmod(F.xxhash64(seed), F.lit(p).cast("long"))


def place(df: DataFrame, mapper: Callable[[DataFrame], Column] | Column, name: str = "owner") -> DataFrame:
    """Adds the owner that a user's mapper gives."""
    return df.withColumn(name, mapper if isinstance(mapper, Column) else mapper(df))


def unique_bits(dims: Dims) -> Column:
    """Dimensions packed in fields of 64 / ndim bits, the first one lowest."""
    width = 64 // len(dims)
    mask = (1 << width) - 1 if width < 64 else -1
    fields = (F.shiftleft(_long(d).bitwiseAND(F.lit(mask)), k * width) for k, d in enumerate(dims))
    return reduce(lambda u, v: u.bitwiseOR(v), fields)


def from_unique_bits(bits: Column, ndim: int) -> list[Column]:
    return [get_bits(bits, k * (64 // ndim), 64 // ndim) for k in range(ndim)]


def get_bits(value: Column, start: int, length: int) -> Column:
    mask = (1 << length) - 1 if length < 64 else -1
    return F.shiftrightunsigned(_long(value), start).bitwiseAND(F.lit(mask).cast("long"))


def set_bits(value: Column, start: int, length: int, field: Column) -> Column:
    mask = (1 << length) - 1
    signed = (mask << start) - (1 << 64) if mask << start >= 1 << 63 else mask << start
    cleared = _long(value).bitwiseAND(F.bitwise_not(F.lit(signed).cast("long")))
    return cleared.bitwiseOR(F.shiftleft(_long(field).bitwiseAND(F.lit(mask).cast("long")), start))


# Fixed values of the identifier layout: control codes in the two lowest bits, then 16 bits of home rank.
OBJGROUP, BARE_HANDLER, COLLECTION_FIXED, COLLECTION_MIGRATABLE = 0, 1, 2, 3
CONTROL_BITS, RANK_BITS = 2, 16


def encode_element(seq: Column, home: Column, control: Column | int) -> Column:
    high = F.shiftleft(_long(seq), CONTROL_BITS + RANK_BITS)
    return high.bitwiseOR(F.shiftleft(_long(home), CONTROL_BITS)).bitwiseOR(_long(control))


def decode_element(ident: Column) -> dict[str, Column]:
    control = get_bits(ident, 0, CONTROL_BITS)
    return {
        "control": control,
        "is_objgroup": control == OBJGROUP,
        "migratable": control == COLLECTION_MIGRATABLE,
        "home": get_bits(ident, CONTROL_BITS, RANK_BITS),
        "seq": F.shiftrightunsigned(_long(ident), CONTROL_BITS + RANK_BITS),
    }


# Fixed values of the epoch layout, from the high end: rooted flag, category of 2 bits, rank of 16 bits, then the sequence.
EPOCH_CATEGORY_BITS, EPOCH_SEQUENCE_BITS = 2, 45


def decode_epoch(epoch: Column) -> dict[str, Column]:
    top = EPOCH_SEQUENCE_BITS + RANK_BITS
    return {
        "rooted": get_bits(epoch, 63, 1) == 1,
        "category": get_bits(epoch, top, EPOCH_CATEGORY_BITS),
        "node": get_bits(epoch, EPOCH_SEQUENCE_BITS, RANK_BITS),
        "sequence": get_bits(epoch, 0, EPOCH_SEQUENCE_BITS),
    }


def range_members(lo: int, hi: int, stride: int = 1) -> range:
    """Ranks of a strided range [lo, hi)."""
    return range(lo, hi, stride)


def range_contains(rank: Column, lo: int, hi: int, stride: int = 1) -> Column:
    """The range's own test, which counts strides from 0 and not from lo."""
    return (rank >= lo) & (rank < hi) & (rank % stride == 0)


def range_size(lo: int, hi: int, stride: int = 1) -> int:
    return (hi - lo) // stride


def range_split(lo: int, hi: int) -> tuple[tuple[int, int], tuple[int, int]]:
    mid = lo + (hi - lo) // 2
    return (lo, mid), (mid, hi)


def range_part(rank: Column, lo: int, hi: int, parts: int) -> Column:
    """Which of `parts` equal parts a rank is in; the remainder belongs to the last."""
    each = (hi - lo) // parts
    return F.least(F.floor((rank - lo) / each), F.lit(parts - 1)).cast("long")


def ranged_counter(start: Column, steps: Column, lo: int, hi: int) -> Column:
    """A counter that wraps round in [lo, hi]."""
    return lo + F.pmod(start - lo + steps, F.lit(hi - lo + 1))
