"""What expressions yield, row by row, and which errors they raise."""

import itertools
import math

import pytest

from quillon.errors import DivisionByZeroError, NumericOverflowError, SqlTypeError
from quillon.operators.frame import Frame
from quillon.session import Session

LEAST = -(1 << 63)


@pytest.fixture(scope="module")
def session(spark):
    return Session(spark)


def frame(session, rows, schema):
    return Frame.of(session.spark.createDataFrame(rows, schema))


def one(session, *exprs):
    """Values of expressions without columns."""
    items = ", ".join(f"{e} AS c{i}" for i, e in enumerate(exprs))
    return list(frame(session, [(1,)], "a long").sql(f"SELECT {items} FROM t").collect()[0])


def test_truth_tables(session):
    cells = {True: "TRUE", False: "FALSE", None: "CAST(NULL AS bool)"}
    pairs = list(itertools.product(cells, cells))
    both = lambda a, b: False if a is False or b is False else None if a is None or b is None else True
    either = lambda a, b: True if a is True or b is True else None if a is None or b is None else False
    assert one(session, *[f"{cells[a]} AND {cells[b]}" for a, b in pairs]) == [both(a, b) for a, b in pairs]
    assert one(session, *[f"{cells[a]} OR {cells[b]}" for a, b in pairs]) == [either(a, b) for a, b in pairs]
    assert one(session, *[f"NOT {c}" for c in cells.values()]) == [False, True, None]


def test_nan_comparisons(session):
    values = [1.0, float("nan"), float("inf"), None]
    rows = list(itertools.product(values, values))
    f = frame(session, rows, "a double, b double")
    ops = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    got = f.sql("SELECT a, b, " + ", ".join(f"a {op} b AS c{i}" for i, op in enumerate(ops)) + " FROM t").collect()
    assert len(got) == 16
    for r in got:
        for i, op in enumerate(ops.values()):
            assert r[2 + i] == (None if r.a is None or r.b is None else op(r.a, r.b)), r
    for name, op in ops.items():
        kept = f.sql(f"SELECT a FROM t WHERE a {name} b").df.count()
        assert kept == sum(a is not None and b is not None and op(a, b) for a, b in rows), name


def test_arithmetic(session):
    assert one(session, "7 / 2", "-7 / 2", "-7 % 2", "7 % -2", "7.0 / 2", "1 - 2 - 3", "2.5 % 2", "- -3", "1 / 2 * 2") == [3, -3, -1, 1, 3.5, -4, 0.5, 3, 0]
    assert math.isinf(one(session, "CAST('1e308' AS float) * 10")[0])
    assert one(session, "NULL IS NULL", "1 IS NOT NULL", "CAST(NULL AS int) + 1", "FALSE < TRUE", "'a' < 'b'", "'Z' < 'a'") == [True, True, None, True, True, True]


@pytest.mark.parametrize(
    "expr,error",
    [("a / (a - a)", DivisionByZeroError), ("a % (a - a)", DivisionByZeroError), ("1.0 / (a - a)", DivisionByZeroError), ("1.0 % (a - a)", DivisionByZeroError), ("9223372036854775807 + a", NumericOverflowError),
     ("-(m)", NumericOverflowError), ("m / -a", NumericOverflowError), ("m % -a", NumericOverflowError), ("m * 2", NumericOverflowError), ("CAST(a > 0 AS int)", SqlTypeError), ("CAST(1.5 * a AS bool)", SqlTypeError),
     ("CAST('x' AS int)", SqlTypeError), ("CAST(' 1' AS int)", SqlTypeError), ("CAST('1.0d' AS float)", SqlTypeError), ("CAST('t' AS bool)", SqlTypeError), ("CAST('nan' AS float) * a = 1.0 AND CAST(CAST('nan' AS float) * a AS int) = 1", None)],
)
def test_run_time_errors(session, expr, error):
    f = frame(session, [(1, LEAST)], "a long, m long").sql(f"SELECT {expr} AS x FROM t")
    if error is None:
        assert f.collect()[0].x is False
        return
    with pytest.raises(error):
        f.collect()


def test_guards_keep_errors_away(session):
    f = frame(session, [(0,), (5,)], "a long")
    assert [r.a for r in f.sql("SELECT a FROM t WHERE a <> 0 AND 10 / a > 1").collect()] == [5]
    assert [r.x for r in f.sql("SELECT a = 0 OR 10 / a > 1 AS x FROM t").collect()] == [True, True]
    assert f.sql("SELECT 1 / 0 AS x FROM t LIMIT 0").collect() == []
    assert [r.x for r in f.sql("SELECT CAST(CAST(NULL AS bool) AS int) AS x FROM t").collect()] == [None, None]


def test_casts(session):
    assert one(session, "CAST('+5' AS int)", "CAST('-inf' AS double)", "CAST('.5' AS float)", "CAST('5.' AS float)", "CAST('TrUe' AS bool)", "CAST(TRUE AS text)", "CAST(0 AS bool)", "CAST(-2.9 AS int)", "CAST(3 AS float)") == [5, float("-inf"), 0.5, 5.0, True, "true", False, -2, 3.0]
    assert math.isnan(one(session, "CAST('-nan' AS float)")[0])
    shown = ["1.0", "0.5", "1e-7", "1.5e300", "-1.25e10", "123456789.125", "1e7", "-0.001", "1e22"]
    assert one(session, *[f"CAST({x} AS text)" for x in shown], "CAST(CAST('inf' AS float) AS text)", "CAST(CAST('nan' AS float) AS text)") == ["1", "0.5", "0.0000001", "15" + "0" * 299, "-12500000000", "123456789.125", "10000000", "-0.001", "1" + "0" * 22, "inf", "NaN"]


def test_sorting(session):
    nan, inf = float("nan"), float("inf")
    f = frame(session, [(1, nan), (2, None), (3, -inf), (4, inf), (5, 0.0), (6, -0.0), (7, nan)], "i long, x double")
    assert [r.i for r in f.sql("SELECT i FROM t ORDER BY x").collect()] == [2, 3, 5, 6, 4, 1, 7]
    assert [r.i for r in f.sql("SELECT i FROM t ORDER BY x DESC").collect()] == [1, 7, 4, 5, 6, 3, 2]
    assert [r.i for r in f.sql("SELECT i FROM t ORDER BY x LIMIT 2").collect()] == [2, 3]
    assert [r.i for r in f.sql("SELECT i FROM t LIMIT 3").collect()] == [1, 2, 3]


def test_laws(session):
    f = frame(session, [(i * 37 % 101, i % 7) for i in range(200)], "a long, b long")
    every = f.sql("SELECT * FROM t ORDER BY b, a DESC").collect()
    assert sorted(map(tuple, every)) == sorted(map(tuple, f.df.collect()))
    assert [(r.b, -r.a) for r in every] == sorted((r.b, -r.a) for r in every)
    once = f.sql("SELECT * FROM t WHERE a > 50")
    assert sorted(once.sql("SELECT * FROM t WHERE a > 50").collect()) == sorted(once.collect())
    for n in (0, 1, 199, 200, 5000):
        assert f.sql(f"SELECT a FROM t LIMIT {n}").df.count() == min(n, 200)


@pytest.mark.parametrize("text", ["NOT (a > b)", "NOT (a <= b)", "NOT (a = b) OR a < 1.0", "NOT (a >= b AND NOT (b <> a))", "NOT (a <> b OR a < 2.0)", "a > 1.0 OR NOT (NOT (b = a))", "NOT (a IS NULL OR b >= 1.0)", "NOT NOT (1.0 < b) AND (a = a OR b > 2.0)", "a IS NULL OR i > 3", "NOT (i > 3) OR NOT (i = k AND a < 2.0)", "NOT (i <> k)"])
def test_filters_hold_where_their_condition_is_true(session, text):
    values = [1.0, 2.5, float("nan"), float("inf"), None]
    rows = [(a, b, i, (i or 0) % 3) for a, b in itertools.product(values, values) for i in (1, 5, None)]
    f = frame(session, rows, "a double, b double, i long, k long")
    said = [r.x for r in f.sql(f"SELECT {text} AS x FROM t").collect()]
    assert f.sql(f"SELECT a FROM t WHERE {text}").df.count() == said.count(True)


def test_long_chains(session):
    f = frame(session, [(1, True)], "a long, b boolean")
    assert f.sql("SELECT " + "+".join(["a"] * 3000) + " - a * 2 AS x FROM t").collect()[0].x == 2998
    with pytest.raises(NumericOverflowError):
        f.sql("SELECT " + "+".join(["9223372036854775807 / 200 + a"] * 250) + " AS x FROM t").collect()
    assert f.sql("SELECT a FROM t WHERE " + " AND ".join(["(a = 1 OR b)"] * 1000)).df.count() == 1


def test_doubles_print_in_the_fewest_digits(session):
    import random
    from decimal import Decimal

    rng = random.Random(12)
    values = [8.41e21, 2e23, 1e23, 9007199254740993.0, 0.1 + 0.2, 1 / 3, 5e-324, 1.7976931348623157e308, -0.0, 0.0, 2.0**-44, 123456789012345.6, 4.35, 2.2250738585072014e-308]
    values += [rng.random() * 10 ** rng.randrange(-20, 20) for _ in range(300)] + [float(f"{rng.randrange(1, 10**6)}e{rng.randrange(-25, 25)}") for _ in range(300)]
    got = [r.s for r in frame(session, [(x,) for x in values], "x double").sql("SELECT CAST(x AS text) AS s FROM t").collect()]
    assert got == [format(Decimal(repr(x)), "f").removesuffix(".0") for x in values]
