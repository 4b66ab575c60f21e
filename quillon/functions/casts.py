"""Explicit casts with the engine's own rules for texts and for pairs that have none.

Every cast keeps NULL in a branch of its own, so that an illegal pair over nulls only, or
over no rows, succeeds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.plans.types import LType

#: Texts that are numbers: no blanks, no type suffixes. \z, as $ would allow a final newline.
INT_TEXT = r"^[+-]?[0-9]+\z"
FLOAT_TEXT = r"^[+-]?((?i)inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)\z"
_NAN_TEXT, _INF_TEXT = r"^[+-]?(?i)nan\z", r"^[+-]?(?i)inf(inity)?\z"


def fail(kind: str, message: Column | str) -> Column:
    """A column that raises, with a message the translator knows by its prefix."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.raise_error(F.concat(F.lit(f"{kind}:"), text))


def text_to_int(s: Column, otherwise: Column) -> Column:
    """The integer a text is, else ``otherwise``."""
    return F.when(s.rlike(INT_TEXT) & s.try_cast("bigint").isNotNull(), s.try_cast("bigint")).otherwise(otherwise)


def text_to_float(s: Column, otherwise: Column) -> Column:
    """The double a text is, else ``otherwise``; signed infinities and NaN have texts of their own."""
    infinite = F.when(s.startswith("-"), float("-inf")).otherwise(float("inf"))
    return F.when(s.rlike(_NAN_TEXT), float("nan")).when(s.rlike(_INF_TEXT), infinite).when(s.rlike(FLOAT_TEXT), s.try_cast("double")).otherwise(otherwise)


def text_to_bool(s: Column, otherwise: Column) -> Column:
    """The truth value a text is, in any ASCII case, else ``otherwise``."""
    return F.when(s.rlike(r"^(?i)true\z"), True).when(s.rlike(r"^(?i)false\z"), False).otherwise(otherwise)


def float_to_text(x: Column) -> Column:
    """A double in the fewest plain decimal digits that give it back: no exponent, no fraction where it is whole."""
    text = x.cast("string")
    # Java may print one digit or more too many; then fewer give the double back.
    long = F.length(F.regexp_replace(text, r"E.*|[-.]|^0\.0*", "")) > 15
    short = lambda n: F.upper(F.format_string(f"%.{n - 1}e", x))
    shown = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"E\+?(-?)0*([0-9])", "E$1$2"), r"(\.[0-9]*?)0+E", "$1E"), r"\.E", ".0E")
    for n in (3, 2, 1):
        text = F.when((F.abs(x) < 1e-320) & (x != 0) & (short(n).cast("double") == x), shown(short(n))).otherwise(text)
    fewest = F.when(short(15).cast("double") == x, shown(short(15))).when(short(16).cast("double") == x, shown(short(16))).otherwise(shown(short(17)))
    text = F.when(long & (F.abs(x) < float("inf")), fewest).otherwise(text)
    special = F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    # Most doubles have few digits and no exponent, and Java prints them in the fewest.
    easy = ~F.contains(x.cast("string"), F.lit("E")) & (F.length(x.cast("string")) <= 16)
    # The text is long as an expression and used often: a lambda's variable stands for it.
    spelled = F.transform(F.array(text), _plain_digits)[0]
    return special.when(easy, F.regexp_replace(x.cast("string"), r"\.0$", "")).otherwise(spelled)


def _plain_digits(text: Column) -> Column:
    """A number as Java prints it, without an exponent and without a fraction that is zero."""
    mantissa, exponent = F.split(text, "E")[0], F.split(text, "E")[1].cast("int")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(mantissa, r"^-|\.|(?<=\.)0$", "")
    after = F.length(digits) - 1
    large = F.when(exponent >= after, F.concat(sign, digits, F.repeat(F.lit("0"), exponent - after))).otherwise(F.concat(sign, F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, after)))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    return F.when(~F.contains(text, F.lit("E")), F.regexp_replace(text, r"\.0$", "")).when(exponent >= 0, large).otherwise(small)


def cast_column(c: Column, source: LType | None, to: LType) -> Column:
    """``c`` of logical type ``source`` (None: a bare NULL) as ``to``."""
    kind = to.spark.simpleString()
    if source is None:
        return F.lit(None).cast(kind)
    if source is to:
        return c
    wrong = lambda t: F.when(c.isNull(), F.lit(None).cast(kind)).otherwise(t)
    if source is LType.UTF8:
        parse = {LType.INT64: text_to_int, LType.FLOAT64: text_to_float, LType.BOOLEAN: text_to_bool}[to]
        return wrong(parse(c, fail("TYPE", F.concat(F.lit("cannot cast '"), c, F.lit(f"' to {to}")))))
    if (source, to) in ((LType.BOOLEAN, LType.INT64), (LType.BOOLEAN, LType.FLOAT64), (LType.FLOAT64, LType.BOOLEAN)):
        return wrong(fail("TYPE", f"cannot cast {source} to {to}").cast(kind))
    if (source, to) == (LType.FLOAT64, LType.UTF8):
        return float_to_text(c)
    return c.cast(kind)
