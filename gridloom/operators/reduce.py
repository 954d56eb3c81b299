"""Typed reductions: one operator over scalars, tuples, vectors and fixed arrays, globally, by group or by stamp.

All are Spark aggregates, so partial results are combined before anything is shuffled. Vectors are reduced position by
position."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: The built-in operators.
OPERATORS: dict[str, Callable[[Column], Column]] = {
    "plus": F.sum, "max": F.max, "min": F.min, "and": F.bool_and, "or": F.bool_or,
    "bit_and": F.bit_and, "bit_or": F.bit_or, "bit_xor": F.bit_xor,
}
VECTOR_OPERATORS = ("plus", "max", "min", "and", "or")
ARRAY_OPERATORS = ("plus", "max", "min", "and")


def reduce_scalar(df: DataFrame, op: str, value: str, by: Iterable[str] = (), name: str | None = None) -> DataFrame:
    """One value, or one for each group; by covers groups, scopes and stamps alike."""
    return df.groupBy(*by).agg(OPERATORS[op](F.col(value)).alias(name or value))


def reduce_none(df: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """A reduction without a value: who took part."""
    return df.groupBy(*by).agg(F.count("*").alias("contributions"))


def reduce_tuple(df: DataFrame, op: str, values: Iterable[str], by: Iterable[str] = ()) -> DataFrame:
    """The operator on each field."""
    return df.groupBy(*by).agg(*(OPERATORS[op](F.col(v)).alias(v) for v in values))


def reduce_vector(df: DataFrame, op: str, value: str, by: Iterable[str], fixed: bool = False) -> DataFrame:
    """Rows (by..., value): the operator at each position of array columns; all of a group must have one size, or the
    query fails. Plus on booleans is `or`, as a sum stored in a boolean is."""
    if op not in (ARRAY_OPERATORS if fixed else VECTOR_OPERATORS):
        raise ValueError(f"{op} is not an operator on {'arrays' if fixed else 'vectors'}")
    if op == "plus" and df.schema[value].dataType.elementType.typeName() == "boolean":
        op = "or"
    by = list(by)
    flat = df.select(*by, F.size(value).alias("__n"), F.posexplode(value).alias("__pos", "__x"))
    each = flat.groupBy(*by, "__pos").agg(OPERATORS[op](F.col("__x")).alias("__x"), F.min("__n").alias("__lo"), F.max("__n").alias("__hi"))
    return each.groupBy(*by).agg(F.max("__hi").alias("__hi"), F.min("__lo").alias("__lo"), F.array_sort(F.collect_list(F.struct("__pos", "__x"))).alias("__v")).select(
        *by, F.when(F.col("__hi") == F.col("__lo"), F.transform("__v", lambda s: s["__x"])).otherwise(F.raise_error(F.lit("vectors of a reduction must have one size"))).alias(value)
    )


def reduce_user(df: DataFrame, value: str, combine: Callable[[pd.Series], float], by: Iterable[str], schema: str) -> DataFrame:
    """A user's operator as a grouped pandas aggregate; combine gets all values of a group. Groups of numbers, booleans or
    strings go to Python many in a batch, as an exchange for each takes longer than what is done with it."""
    by = list(by)
    if not by or not isinstance(df.schema[value].dataType, (T.NumericType, T.BooleanType, T.StringType)):
        agg = F.pandas_udf(combine, schema)
        return df.groupBy(*by).agg(agg(F.col(value)).alias(value))
    # in structs, as collect_list leaves nulls out
    groups = df.groupBy(*by).agg(F.collect_list(F.struct(F.col(value).alias("x"))).alias(value))
    out = T.StructType([*groups.schema.fields[:-1], T.StructField(value, T._parse_datatype_string(schema))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_type(out.fields[-1].dataType)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            values, ends = lists.values.field("x"), lists.offsets.to_pylist()
            # the type of a group's series is up to its own nulls
            whole = None if values.null_count else values.to_pandas().to_numpy()
            part = lambda a, b: values.slice(a, b - a).to_pandas() if whole is None else pd.Series(whole[a:b])
            found = pd.Series([combine(part(a, b)) for a, b in pairwise(ends)], dtype=object)
            column = pa.Array.from_pandas(found, mask=found.isnull().to_numpy(), type=kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=out.names)

    return groups.mapInArrow(each, out)


def reduce_pairwise(df: DataFrame, value: str, start: Column, step: Callable[[Column, Column], Column], by: Iterable[str], order: str) -> DataFrame:
    """A user's pairwise operator as a fold in a fixed order, for groups that fit a row."""
    by = list(by)
    chain = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(*by).agg(F.aggregate(chain, start, lambda a, s: step(a, s[value])).alias(value))


def all_reduce(df: DataFrame, op: str, value: str, name: str) -> DataFrame:
    """Every row with the reduction of all. The result is one row, so the join is with a single broadcast row."""
    return df.crossJoin(F.broadcast(df.agg(OPERATORS[op](F.col(value)).alias(name))))


def group_all_reduce(df: DataFrame, op: str, value: str, by: list[str], name: str) -> DataFrame:
    return df.withColumn(name, OPERATORS[op](F.col(value)).over(Window.partitionBy(*by)))


def reduce_if(df: DataFrame, op: str, value: str, member: Column, by: Iterable[str] = ()) -> DataFrame:
    """A reduction over the elements for which the predicate holds."""
    return reduce_scalar(df.where(member), op, value, by)


def reduce_with_callback(df: DataFrame, op: str, value: str, callback: Callable[[object], None]) -> None:
    """Runs the reduction and hands its value to the callback."""
    callback(df.agg(OPERATORS[op](F.col(value))).first()[0])
