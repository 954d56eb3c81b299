"""Names, units and per-element storage, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(template: str, rank: Column, time: Column | None = None) -> Column:
    """A template with %p for the rank and %t for the time."""
    out = F.replace(F.lit(template), F.lit("%p"), rank.cast("string"))
    return out if time is None else F.replace(out, F.lit("%t"), time.cast("string"))


#: Multipliers of 10**3 and their letters, largest first.
MULTIPLIERS = ((1e12, "T"), (1e9, "G"), (1e6, "M"), (1e3, "K"), (1.0, ""), (1e-3, "m"), (1e-6, "u"), (1e-9, "n"))


def scaled(value: Column, digits: int = 2) -> tuple[Column, Column]:
    """A value over the largest multiplier that leaves it at 1 or more, and the multiplier's letter; 0 has none."""
    number, letter = F.round(value, digits), F.lit("")
    for by, name in reversed(MULTIPLIERS):
        fits = F.abs(value) >= by
        number, letter = F.when(fits, F.round(value / by, digits)).otherwise(number), F.when(fits, name).otherwise(letter)
    return number, letter


def auto_threshold(imbalance: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(1 - imbalance, F.lit(low)), F.lit(high))


def insert_value(storage: Column, key: str, value: Column) -> Column:
    """A storage map with a value; an existing key keeps its own."""
    return F.when(F.map_contains_key(storage, key), storage).otherwise(F.map_concat(storage, F.create_map(F.lit(key), value)))


def get_value(storage: Column, key: str) -> Column:
    """The value of a key; a missing key fails the query."""
    missing = F.raise_error(F.lit(f"no value {key}")).cast("string")
    return F.when(F.map_contains_key(storage, key), F.try_element_at(storage, F.lit(key)).cast("string")).otherwise(missing)


def has_value(storage: Column, key: str) -> Column:
    return F.map_contains_key(storage, key)


def remove_value(storage: Column, key: str) -> Column:
    return F.map_filter(storage, lambda k, _: k != key)
