"""Bound expressions as native columns.

Comparisons of doubles need a guard, since Spark holds NaN equal to itself and above all
numbers. As a value the guard is a CASE; as a conjunct of a filter it is an AND beside the
comparison, which leaves the comparison free to reach the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import InternalError
from quillon.functions.casts import cast_column, fail
from quillon.plans.binder import Bound
from quillon.plans.types import COMPARISON, LType

_LEAST = -(1 << 63)
_COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def name(column: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def value(e: Bound) -> Column:
    """``e`` in any position."""
    if e.op == "column":
        return name(e.value)
    if e.op == "literal":
        return F.lit(e.value) if e.type is None else F.lit(e.value).cast(e.type.spark)
    if len(e.args) == 2:
        return _chain(e)
    args = [value(a) for a in e.args]
    if e.op == "cast":
        return cast_column(args[0], e.args[0].type, e.type)
    if e.op == "is null":
        return args[0].isNull()
    if e.op == "is not null":
        return args[0].isNotNull()
    if e.op == "negate":
        return -args[0]
    if e.op == "NOT":
        return ~args[0]
    raise InternalError(f"no lowering for {e.op}")


#: Operators of a chain that are nested in each other; longer chains go on from the value of what is before.
_NESTED = 100


def _chain(e: Bound) -> Column:
    """A binary operator, from the innermost left operand on: chains are deep on their left."""
    if e.op in ("AND", "OR"):
        return _joined(e.op, [value(x) for x in _spine(e, e.op)])
    chain = []
    while len(e.args) == 2 and e.op not in ("AND", "OR"):
        chain.append(e)
        e = e.args[0]
    out = value(e)

    def applied(first: Column, some: list[Bound]) -> Column:
        for x in some:
            first = (_comparison if x.op in COMPARISON else _arithmetic)(x, first, value(x.args[1]))
        return first

    chain.reverse()
    if len(chain) <= _NESTED:
        return applied(out, chain)
    for i in range(0, len(chain), _NESTED):
        some = chain[i : i + _NESTED]
        out = F.transform(F.array(out), lambda x: applied(x, some))[0]  # noqa: B023
    return out


def _joined(op: str, columns: list[Column]) -> Column:
    """Columns joined by AND or OR, from left to right, as a tree of little depth."""
    if len(columns) == 1:
        return columns[0]
    half = len(columns) // 2
    a, b = _joined(op, columns[:half]), _joined(op, columns[half:])
    return a & b if op == "AND" else a | b


def _arithmetic(e: Bound, a: Column, b: Column) -> Column:
    if e.op == "+":
        return a + b
    if e.op == "-":
        return a - b
    if e.op == "*":
        return a * b
    whole = e.type is LType.INT64
    if e.op == "/":
        return F.call_function("div", a, b) if whole else a / b
    if e.op == "%":
        divisor = e.args[1]
        if whole and not (divisor.op == "literal" and divisor.value != -1):
            return F.when((a == _LEAST) & (b == -1), fail("OVERFLOW", "integer remainder").cast("bigint")).otherwise(a % b)
        return a % b
    raise InternalError(f"no lowering for {e.op}")


def _may_be_nan(e: Bound) -> bool:
    """Whether an operand of a double comparison can be NaN: literals and integers cannot."""
    if e.type is not LType.FLOAT64 or e.op == "literal":
        return False
    return not (e.op == "cast" and e.args[0].type is LType.INT64)


def _comparison(e: Bound, a: Column, b: Column) -> Column:
    left, right = map(_may_be_nan, e.args)
    plain = _COMPARE[e.op](a, b)
    if e.op in (">", ">=") and left:
        return F.when(F.isnan(a) & b.isNotNull(), False).otherwise(plain)
    if e.op in ("<", "<=") and right:
        return F.when(F.isnan(b) & a.isNotNull(), False).otherwise(plain)
    if e.op in ("=", "<>") and left and right:
        return F.when(F.isnan(a) & F.isnan(b), e.op == "<>").otherwise(plain)
    return plain


def condition(e: Bound) -> Column:
    """``e`` as a filter, where NULL and FALSE both drop the row.

    Beside it stands what it implies in terms that can reach the scan, where that differs.
    """
    exact, scan = _holds(e, True), _implied(e, True)
    return exact if scan is None or not _guarded(e) else scan & exact


#: Comparisons that hold where others do not, but for NaN.
_OPPOSITE = {"=": "<>", "<>": "=", "<": ">=", "<=": ">", ">": "<=", ">=": "<"}


def _spine(e: Bound, op: str) -> list[Bound]:
    """The operands of a chain of one operator, first to last."""
    out = []
    while e.op == op:
        out.append(e.args[1])
        e = e.args[0]
    return [e, *reversed(out)]


def _holds(e: Bound, wanted: bool) -> Column:
    """Whether ``e`` is TRUE, or if not ``wanted`` FALSE; it may be NULL or FALSE where ``e`` is neither."""
    if e.op == "NOT":
        return _holds(e.args[0], not wanted)
    if e.op in ("AND", "OR"):
        both = (e.op == "AND") == wanted
        return _joined("AND" if both else "OR", [_holds(x, wanted) for x in _spine(e, e.op)])
    if e.op not in COMPARISON:
        return value(e) if wanted else ~value(e)
    a, b = map(value, e.args)
    left, right = map(_may_be_nan, e.args)
    if wanted:
        if e.op == "<>":
            return _comparison(e, a, b)
        guarded = ((a, left and e.op in (">", ">=") or left and right and e.op == "="), (b, right and e.op in ("<", "<=")))
        return reduce(lambda c, x: c & ~F.isnan(x), (x for x, nan in guarded if nan), _COMPARE[e.op](a, b))
    out = _COMPARE[_OPPOSITE[e.op]](a, b)
    if e.op == "<>":
        return out & ~F.isnan(a) if left and right else out
    if e.op == "=":
        return out | F.isnan(a) & F.isnan(b) if left and right else out
    # Comparisons with NaN are FALSE, while Spark holds NaN above all numbers.
    nans = [F.isnan(x) & y.isNotNull() for x, y, nan in ((a, b, left and e.op in (">", ">=")), (b, a, right and e.op in ("<", "<="))) if nan]
    return reduce(lambda c, x: c | x, nans, out)


def _guarded(e: Bound) -> bool:
    """Whether a comparison under OR or NOT has a guard, which keeps it from the scan."""
    if e.op == "AND":
        return any(map(_guarded, _spine(e, "AND")))
    return e.op in ("OR", "NOT")


def _implied(e: Bound, wanted: bool) -> Column | None:
    """Comparisons without guards that hold wherever ``_holds`` does, or None."""
    if e.op == "NOT":
        return _implied(e.args[0], not wanted)
    if e.op in ("AND", "OR"):
        every = [_implied(x, wanted) for x in _spine(e, e.op)]
        some = [x for x in every if x is not None]
        if (e.op == "AND") == wanted:
            return _joined("AND", some) if some else None
        return _joined("OR", some) if len(some) == len(every) else None
    if e.op in ("is null", "is not null") and e.args[0].op == "column":
        return value(e) if wanted else ~value(e)
    if e.op not in COMPARISON:
        return None
    left, right = map(_may_be_nan, e.args)
    a, b = map(value, e.args)
    if wanted:
        return None if e.op == "<>" and left and right else _COMPARE[e.op](a, b)
    if left and right or left and e.op in (">", ">=") or right and e.op in ("<", "<="):
        return None
    return _COMPARE[_OPPOSITE[e.op]](a, b)
