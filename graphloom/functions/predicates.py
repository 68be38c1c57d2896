"""Two-valued predicates and ordering rules of the graph's queries, as Spark columns.

A comparison with a missing operand is false, so its negation is true. Numbers compare exactly, a bigint with a double
too; values of different kinds are unequal; `<` and the like raise unless both are numbers or both strings. Kinds are those
of the columns' types. Where the DataFrame is given as `on`, they are known when the predicate is built, so plain
comparisons reach the scan; without it Spark looks at the types itself and compares by way of text.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, FractionalType, IntegralType, NullType, StringType

INT, REAL, TEXT = "int", "real", "text"
NAMES = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
FLIPPED = {"==": "==", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _two_valued(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _present(a: Column, b: Column, result: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), result)


def equal_number(whole: Column, real: Column) -> Column:
    """Exact equality of a bigint and a double, which a plain comparison would round to double first."""
    back = F.when((real >= -9.2e18) & (real <= 9.2e18), real.cast("bigint"))
    return _two_valued((whole.cast("double") == real) & (back == whole))


def _whole_to_real(name: str, whole: Column, real: Column) -> Column:
    """A comparison of a bigint with a double by their exact values; NaN is above all."""
    same = equal_number(whole, real)
    if name == "==":
        return same
    if name == "!=":
        return ~same
    inside = (real > -9.2e18) & (real < 9.2e18)
    below = F.when(inside, whole < F.ceil(F.when(inside, real)).cast("bigint")).otherwise(real > 0)
    above = F.when(inside, whole > F.floor(F.when(inside, real)).cast("bigint")).otherwise(~(real > 0))
    strict = below if name[0] == "<" else above
    return strict | same if name.endswith("=") else strict


def _kind(of: DataType) -> str | None:
    if isinstance(of, IntegralType):
        return INT
    if isinstance(of, FractionalType):
        return REAL
    return TEXT if isinstance(of, StringType) else None if isinstance(of, NullType) else of.simpleString()


def _refused(name: str, a: str, b: str) -> Column:
    return F.raise_error(F.lit(f"{a} {name} {b} has no order")).cast("boolean")


def _known(name: str, a: Column, b: Column, on: DataFrame) -> Column:
    types = [f.dataType for f in on.select(a.alias("a"), b.alias("b")).schema]
    kinds = [_kind(t) for t in types]
    if None in kinds:
        return F.lit(False)
    if set(kinds) == {INT, REAL}:
        return _whole_to_real(name, a, b) if kinds[0] == INT else _whole_to_real(FLIPPED[name], b, a)
    if kinds[0] != kinds[1]:
        return F.lit(name == "!=") if name in ("==", "!=") else _refused(name, *kinds)
    if name not in ("==", "!=") and kinds[0] not in (INT, REAL, TEXT):
        return _refused(name, *kinds)
    return NAMES[name](a, b)


def _unknown(name: str, a: Column, b: Column) -> Column:
    """The comparison for columns of unknown type: typeof() is a constant, so Spark keeps one branch."""
    whole, real = ("tinyint", "smallint", "int", "bigint"), ("float", "double")
    types = F.typeof(a), F.typeof(b)
    is_whole, is_real = [t.isin(*whole) for t in types], [t.isin(*real) | t.startswith("decimal") for t in types]
    text = a.cast("string"), b.cast("string")
    wholes, reals = [t.try_cast("bigint") for t in text], [t.try_cast("double") for t in text]
    compare = NAMES[name]
    chosen = (
        F.when(is_whole[0] & is_whole[1], compare(wholes[0], wholes[1]))
        .when(is_real[0] & is_real[1], compare(reals[0], reals[1]))
        .when(is_whole[0] & is_real[1], _whole_to_real(name, wholes[0], reals[1]))
        .when(is_real[0] & is_whole[1], _whole_to_real(FLIPPED[name], wholes[1], reals[0]))
    )
    ordered = name not in ("==", "!=")
    same = (types[0] == types[1]) & (types[0] == "string" if ordered else F.lit(True))
    error = F.raise_error(F.concat(types[0], F.lit(f" {name} "), types[1], F.lit(" has no order"))).cast("boolean")
    return chosen.when(same, compare(text[0], text[1])).otherwise(error if ordered else F.lit(name == "!="))


def _comparison(name: str) -> Callable[..., Column]:
    def compare(a: Column, b: Column, on: DataFrame | None = None) -> Column:
        return _two_valued(_present(a, b, _unknown(name, a, b))) if on is None else _plain(name, a, b, on)

    return compare


def _plain(name: str, a: Column, b: Column, on: DataFrame) -> Column:
    result = _known(name, a, b, on)
    types = {_kind(f.dataType) for f in on.select(a.alias("a"), b.alias("b")).schema}
    # Null and false is false, so this is two-valued; as a plain conjunction it is pushed to the scan.
    return result & a.isNotNull() & b.isNotNull() if len(types) == 1 else _two_valued(_present(a, b, result))


#: a = b, a <> b, a < b and so on; false where a side is missing. Arguments: a, b, on.
equal = _comparison("==")
unequal = _comparison("!=")
less = _comparison("<")
less_equal = _comparison("<=")
greater = _comparison(">")
greater_equal = _comparison(">=")


def starts_with(a: Column, prefix: str) -> Column:
    """Prefix test; false for a missing value. Spark pushes it to the Parquet scan."""
    return a.startswith(prefix) & a.isNotNull()


def between_chain(low: Column, value: Column, high: Column, on: DataFrame | None = None) -> Column:
    """low < value < high as the two neighbouring comparisons."""
    return less(low, value, on) & less(value, high, on)


def matches(properties: dict[str, Column], wanted: dict[str, object]) -> Column:
    """All wanted properties are present and equal."""
    result = F.lit(True)
    for name, value in wanted.items():
        result = result & equal(properties[name], F.lit(value))
    return result


def visible_at(df_from: Column, df_to: Column, at: Column) -> Column:
    """Bitemporal visibility on one axis: both ends inclusive, a missing end does not restrict."""
    return (df_from.isNull() | (df_from <= at)) & (df_to.isNull() | (df_to >= at))
