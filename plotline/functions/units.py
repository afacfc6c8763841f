"""Unit-bearing text → numbers, and tolerant typed casts.

Everything here returns a ``Column`` built from native Spark expressions, so it
stays inside whole-stage codegen (no Python UDF on the hot path).  Anything
unparseable becomes null instead of raising (Spark runs with ANSI mode on).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col

# --- fixed values: price units and their factor to millions ----------------
# total price: "tỷ" x1000, "triệu" x1, "nghìn" x0.001 (the last rounded to 3 decimals)
PRICE_UNITS = {"tỷ": 1000.0, "triệu": 1.0, "nghìn": 0.001}
# price per square metre: same factors with a "/m²" suffix
PRICE_PER_M2_UNITS = {"tỷ/m²": 1000.0, "triệu/m²": 1.0, "nghìn/m²": 0.001}
# units whose product is rounded to 3 decimals
ROUNDED_UNITS = ("nghìn", "nghìn/m²")
# suffix lengths: area " m²" is 3 characters, length " m" is 2
AREA_SUFFIX_CHARS = 3
LENGTH_SUFFIX_CHARS = 2
# ---------------------------------------------------------------------------


def try_double(c) -> Column:
    """String (or number) → double, null when it does not parse."""
    return as_col(c).try_cast("double")


def try_float(c) -> Column:
    return as_col(c).try_cast("float")


def try_int(c) -> Column:
    """Text like ``'2021'`` or ``'2021.0'`` → int; null when unparseable.

    Goes through double because ``try_cast('2021.0' as int)`` is null, and
    floors explicitly so the result does not depend on cast rounding rules.
    """
    return F.floor(try_double(c)).try_cast("int")


def scaled_by_unit(c, units: dict[str, float], rounded=ROUNDED_UNITS, digits: int = 3) -> Column:
    """``'<number> <unit> ...'`` → number × factor(unit); null for unknown units.

    The first space-separated token is the number, the second the unit; a
    one-token text, an unknown unit or a non-numeric number give null.
    """
    col = as_col(c)
    num = try_double(F.split_part(col, F.lit(" "), F.lit(1)))
    unit = F.split_part(col, F.lit(" "), F.lit(2))
    out = None
    for name, factor in units.items():
        value = num * F.lit(factor)
        if name in rounded:
            value = F.round(value, digits)
        out = F.when(unit == name, value) if out is None else out.when(unit == name, value)
    return out


def price_to_millions(c, units: dict[str, float] = PRICE_UNITS) -> Column:
    """total price text → millions."""
    return scaled_by_unit(c, units)


def price_per_m2_to_millions(c, units: dict[str, float] = PRICE_PER_M2_UNITS) -> Column:
    """price-per-m² text → millions per m²."""
    return scaled_by_unit(c, units)


def drop_suffix(c, n_chars: int) -> Column:
    """Remove the last ``n_chars`` characters; text not longer than that → ``''``."""
    col = as_col(c)
    return F.left(col, F.length(col) - F.lit(n_chars))


def area_number(c) -> Column:
    """``'52 m²'`` → ``'52'`` (still text; cast in the typed-cast stage)."""
    return drop_suffix(c, AREA_SUFFIX_CHARS)


def length_number(c) -> Column:
    """``'4.5 m'`` → ``'4.5'``."""
    return drop_suffix(c, LENGTH_SUFFIX_CHARS)
