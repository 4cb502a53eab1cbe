"""Pointwise functions and operators, in IEEE double semantics where Spark's ANSI mode would raise or give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import INF, NAN, QueryError, double


def divide(a: Column, b: Column) -> Column:
    zero = F.when(F.isnan(a) | (a == 0), double(NAN)).otherwise(F.when(a > 0, double(INF)).otherwise(double(-INF)))
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def modulo(a: Column, b: Column) -> Column:
    return F.when(b == 0, double(NAN)).otherwise(a % F.when(b != 0, b))


ARITHMETIC = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": divide,
    "%": modulo,
    "^": lambda a, b: F.pow(a, b),
}
_COMPARE = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def compare(op: str, a: Column, b: Column) -> Column:
    """NaN on either side compares false; only != then holds."""
    nan = F.isnan(a) | F.isnan(b)
    return F.when(nan, F.lit(op == "!=")).otherwise(_COMPARE[op](a, b))


def compared(op: str, a: Column, b: Column) -> Column:
    """The bool form: 1 or 0, NaN where an operand is."""
    return F.when(F.isnan(a) | F.isnan(b), double(NAN)).otherwise(_COMPARE[op](a, b).cast("double"))


def _guarded(f):
    """A function whose domain is the positive numbers."""
    return lambda v: F.when(v > 0, f(F.when(v > 0, v))).when(v == 0, double(-INF)).otherwise(double(NAN))


def _whole(f):
    return lambda v: F.when(F.isnan(v) | (F.abs(v) >= 2.0**53), v).otherwise(f(F.when(~F.isnan(v) & (F.abs(v) < 2.0**53), v)).cast("double"))


def round_to(v: Column, to: Column) -> Column:
    """The nearest multiple, halves upwards."""
    inverse = divide(double(1.0), to)
    return divide(_whole(F.floor)(v * inverse + 0.5), inverse)


def _date(part):
    def of(v: Column) -> Column:
        usable = ~F.isnan(v) & (F.abs(v) < 1e11)
        at = F.timestamp_seconds(F.when(usable, F.floor(F.when(usable, v))))
        return F.when(usable, part(at).cast("double")).otherwise(v)

    return of


DATES = {
    "year": _date(F.year),
    "month": _date(F.month),
    "day_of_month": _date(F.dayofmonth),
    "day_of_week": _date(lambda t: F.dayofweek(t) - 1),
    "hour": _date(F.hour),
    "minute": _date(F.minute),
    "days_in_month": _date(lambda t: F.day(F.last_day(t))),
}
UNARY = {
    "abs": F.abs,
    "ceil": _whole(F.ceil),
    "floor": _whole(F.floor),
    "exp": F.exp,
    "sqrt": F.sqrt,
    "ln": _guarded(F.log),
    "log10": _guarded(F.log10),
    "log2": _guarded(F.log2),
    "sgn": F.signum,
    **DATES,
}


def clamp_min(v: Column, s: Column) -> Column:
    return F.when(F.isnan(v), v).otherwise(F.greatest(v, s))


def clamp_max(v: Column, s: Column) -> Column:
    return F.when(F.isnan(v), v).otherwise(F.least(v, s))


BINARY = {"clamp_min": clamp_min, "clamp_max": clamp_max, "round": round_to, "or_vector": lambda v, s: F.nanvl(F.coalesce(v, s), s)}


def fold(op: str, a: float, b: float) -> float:
    """Arithmetic and bool comparisons of two numbers."""
    import math

    if op in _COMPARE:
        if a != a or b != b:
            return NAN
        return float({"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])
    try:
        match op:
            case "+":
                return a + b
            case "-":
                return a - b
            case "*":
                return a * b
            case "/":
                return a / b if b else NAN if a == 0 or a != a else math.copysign(INF, a)
            case "%":
                return math.fmod(a, b) if b else NAN
            case "^":
                got = a**b
                return NAN if isinstance(got, complex) else got
    except OverflowError:
        return INF
    except (ValueError, ZeroDivisionError):
        return INF if op == "^" else NAN
    raise QueryError(f"no operator {op}")
