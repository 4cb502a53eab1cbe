"""Computed columns: `:func args` expressions over a table's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import QueryError
from ..plans.parser import duration

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _string(df: DataFrame, text: str) -> Column:
    return F.lit(text)


def _get_or_else(df: DataFrame, column: str, default: str) -> Column:
    return F.coalesce(F.col(column), F.lit(default).cast(df.schema[column].dataType))


def _round(df: DataFrame, column: str, n: str) -> Column:
    """Integers go towards zero to a multiple, doubles down."""
    if isinstance(df.schema[column].dataType, _INTEGRAL):
        return (F.expr(f"`{column}` div {int(n)}L") * int(n)).cast(df.schema[column].dataType)
    return F.floor(F.col(column) / float(n)).cast("double") * float(n)


def _prefix(df: DataFrame, column: str, n: str) -> Column:
    return F.substring(column, 1, int(n))


def _hash(df: DataFrame, column: str, n: str) -> Column:
    """Integers by their value, others by a hash: 0 to n - 1."""
    if isinstance(df.schema[column].dataType, _INTEGRAL):
        return F.abs(F.col(column) % int(n)).cast("int")
    return F.pmod(F.xxhash64(column), F.lit(int(n))).cast("int")


def _timeslice(df: DataFrame, column: str, length: str) -> Column:
    ms = duration(length)[0]
    at = F.unix_millis(column) if isinstance(df.schema[column].dataType, T.TimestampType) else F.col(column)
    return (F.floor(at / ms) * ms).cast("long")


def _month(df: DataFrame, column: str) -> Column:
    at = F.col(column) if isinstance(df.schema[column].dataType, T.TimestampType) else F.timestamp_millis(column)
    return F.month(at)


COMPUTED = {"string": _string, "getOrElse": _get_or_else, "round": _round, "stringPrefix": _prefix, "hash": _hash, "timeslice": _timeslice, "monthOfYear": _month}


def computed(df: DataFrame, expression: str) -> Column:
    """`:timeslice ts 1d`, `:round price 10`, ...; a plain name is the column itself."""
    if not expression.startswith(":"):
        return F.col(expression)
    name, *args = expression[1:].split()
    if name not in COMPUTED:
        raise QueryError(f"no computed column :{name}")
    try:
        return COMPUTED[name](df, *args)
    except TypeError as e:
        raise QueryError(f":{name} has other arguments") from e
