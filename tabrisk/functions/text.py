"""String and formatting expressions (native Column expressions, no UDFs)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Remove leading and trailing whitespace (not only spaces, unlike ``trim``)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def str_or_nan(c: Column | str) -> Column:
    """String form with missing as the category ``'nan'``."""
    return F.coalesce(_c(c).cast("string"), F.lit("nan"))


def map_lookup(c: Column | str, mapping: Mapping[int, str]) -> Column:
    """Code -> label with fallback to the value's own string form.

    The code is the value truncated toward zero (``try_cast``: a bad string
    falls back instead of failing the job).
    """
    c = _c(c)
    if not mapping:
        return c.cast("string")
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(int(k)), F.lit(v))])
    code = F.try_element_at(m, c.try_cast("double").try_cast("int"))
    return F.coalesce(code, c.cast("string"))


def _printf(c: Column, digits: int) -> Column:
    """``%.<digits>f`` of a double as C prints it.

    Java's formatter rounds the shortest decimal form half up; C rounds the exact
    binary value.  They differ only next to a tie of the shortest form: there the
    distance between the double and the tie decides, and it is computed exactly
    (``x * 10**d`` split into its rounded product and the product's error).
    """
    unit = float(10 ** digits)
    low = F.floor(F.abs(c) * unit).cast("double")     # candidate, perhaps one off by rounding of the product
    # error of the product by splitting both factors into halves (Dekker)
    x, y = F.abs(c), F.lit(unit)
    big = x * F.lit(134217729.0)
    xh = big - (big - x)
    xl = x - xh
    p = x * y
    err = (xh * y - p) + xl * y                      # 10**d has few bits, so y needs no splitting
    tie = p - low - F.lit(0.5)
    up = (tie > 0) | ((tie == 0) & ((err > 0) | ((err == 0) & (low % 2 == 1))))
    rounded = F.when(up, low + 1).otherwise(low) / unit
    text = F.format_string(f"%.{digits}f", rounded)
    negative = (c < 0) | (c.cast("string") == "-0.0")
    shown = F.when(F.abs(c) < 1e11, F.when(negative, F.concat(F.lit("-"), text)).otherwise(text)).otherwise(
        F.format_string(f"%.{digits}f", c))
    return F.when(c.isNotNull(), shown)


def fixed1(c: Column | str) -> Column:
    """One decimal as C's ``printf("%.1f")`` prints it: the exact binary value is
    rounded, a tie to the even digit."""
    return _printf(_c(c).cast("double"), 1)


def format_by_rule(c: Column | str, rule: tuple[str, str]) -> Column:
    """Apply a display rule: ``("fixed1", unit)`` or ``("int", unit)``."""
    kind, unit = rule
    c = _c(c)
    if kind == "fixed1":
        body = fixed1(c)
    elif kind == "int":
        body = c.cast("double").cast("bigint").cast("string")
    else:
        raise ValueError(f"unknown format rule {kind!r}")
    return F.concat(body, F.lit(unit))


def format_value(feature: Column | str, value: Column | str,
                 value_labels: Mapping[str, Mapping[int, str]],
                 rules: Mapping[str, tuple[str, str]]) -> Column:
    """Dictionary label, else unit format, else plain string, chosen by feature name."""
    feature, value = _c(feature), _c(value)
    expr = None
    for name, mapping in value_labels.items():
        branch = map_lookup(value, mapping)
        expr = F.when(feature == name, branch) if expr is None else expr.when(feature == name, branch)
    for name, rule in rules.items():
        if name in value_labels:
            continue
        branch = format_by_rule(value, rule)
        expr = F.when(feature == name, branch) if expr is None else expr.when(feature == name, branch)
    plain = value.cast("string")
    return plain if expr is None else expr.otherwise(plain)


def signed4(c: Column | str) -> Column:
    """``%+.4f`` form of an attribution, rounded as in :func:`fixed1`."""
    c = _c(c).cast("double")
    negative = (c < 0) | (c.cast("string") == "-0.0")
    return F.concat(F.when(negative, "-").otherwise("+"), F.regexp_replace(_printf(c, 4), "^-", ""))
