"""Column expressions shared by the operators. All but the rounded text stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_EXACT_DOUBLE = 9007199254740991  # 2**53 - 1


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def present(c: Column | str) -> Column:
    """True when the value is neither null nor blank text."""
    c = col(c)
    return c.isNotNull() & (F.trim(c.cast("string")) != "")


def all_present(columns: list[str]) -> Column:
    return both([present(c) for c in columns])


def blank_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(present(c), c)


def is_address(c: Column | str) -> Column:
    """``0x`` followed by forty further characters, the shape check used on transfers."""
    text = F.lower(F.trim(col(c)))
    return F.coalesce(text.startswith("0x") & (F.length(text) == 42), F.lit(False))


def normalize_address(c: Column | str) -> Column:
    text = F.lower(F.trim(col(c)))
    return F.when(is_address(c), text).otherwise(
        F.raise_error(F.concat(F.lit("invalid address: "), F.coalesce(text, F.lit("null"))))
    )


def is_hex(c: Column | str, n_bytes: int | None = None) -> Column:
    body = "[0-9a-f]{%d}" % (2 * n_bytes) if n_bytes is not None else "([0-9a-f]{2})*"
    return F.coalesce(F.lower(col(c)).rlike(f"^0x{body}$"), F.lit(False))


def hex_to_long(c: Column | str) -> Column:
    """``0x``-prefixed quantity to bigint; null when it is malformed or beyond 63 bits."""
    text = F.lower(F.trim(col(c)))
    digits = F.ltrim(F.substring(text, 3, 80), F.lit("0"))
    fits = (F.length(digits) <= 15) | ((F.length(digits) == 16) & (F.substring(digits, 1, 1) < "8"))
    padded = F.when(digits == "", F.lit("0")).otherwise(digits)
    return F.when(fits & text.rlike("^0x[0-9a-f]+$"), F.conv(padded, 16, 10).cast("bigint"))


def exact_integer(c: Column | str, kind: str) -> Column:
    """Exact integer as ``decimal(38,0)``, or null where the value is fractional or lossy.

    ``kind`` names the source type: ``text``, ``integer``, ``decimal``, ``double`` or
    ``boolean`` (never an integer). Text of more than 38 digits is an integer that the type
    can't hold, so it fails; :func:`exact_integer_text` takes any length.
    """
    c = col(c)
    if kind == "text":
        whole = exact_integer_text(c, "text")
        wide = F.raise_error(F.concat(F.lit("integer text beyond 38 digits: "), whole)).cast("decimal(38,0)")
        return F.when(F.length(F.ltrim(whole, F.lit("-"))) > 38, wide).otherwise(whole.cast("decimal(38,0)"))
    if kind == "integer":
        return c.cast("decimal(38,0)")
    if kind == "decimal":
        return F.when(c == F.floor(c), c.cast("decimal(38,0)"))
    if kind == "double":
        safe = ~F.isnan(c) & (F.abs(c) <= F.lit(float(MAX_EXACT_DOUBLE))) & (c == F.floor(c))
        return F.when(safe, c.try_cast("decimal(38,0)"))
    return F.lit(None).cast("decimal(38,0)")


def exact_integer_text(c: Column | str, kind: str = "text") -> Column:
    """Exact integer of any length as plain decimal text, or null where it is fractional or lossy."""
    c = col(c)
    if kind != "text":
        return exact_integer(c, kind).cast("string")
    trimmed = F.trim(c)
    digits = F.regexp_replace(trimmed, r"^[+-]?0*(?=[0-9])", "")
    sign = F.when(trimmed.startswith("-") & (digits != "0"), F.lit("-")).otherwise(F.lit(""))
    return F.when(trimmed.rlike(r"^[+-]?[0-9]+$"), F.concat(sign, digits))


def integer_kind(dtype: str) -> str:
    """``kind`` of :func:`exact_integer` for a simple type name."""
    if dtype == "string":
        return "text"
    if dtype in ("double", "float"):
        return "double"
    if dtype.startswith("decimal"):
        return "decimal"
    return "boolean" if dtype == "boolean" else "integer"


def is_exact_integer_text(c: Column | str) -> Column:
    """Exact-integer test on text of any length, as uint256 amounts exceed decimals."""
    return F.coalesce(F.trim(col(c)).rlike(r"^[+-]?\d+$"), F.lit(False))


def is_nonnegative_integer_text(c: Column | str, positive: bool = False) -> Column:
    pattern = r"^0*[1-9]\d*$" if positive else r"^\d+$"
    return F.coalesce(col(c).rlike(pattern), F.lit(False))


def strict_bool(c: Column | str) -> Column:
    text = F.lower(F.trim(col(c).cast("string")))
    return (
        F.when(text.isin("true", "1"), F.lit(True))
        .when(text.isin("false", "0"), F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("invalid boolean: "), F.coalesce(text, F.lit("null")))))
    )


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    """``top / bottom`` as double, with ``empty`` where the denominator is zero or null."""
    return F.when(bottom != 0, top.cast("double") / bottom.cast("double")).otherwise(F.lit(empty))


def significant(c: Column | str, digits: int) -> Column:
    """Round a double to ``digits`` significant digits; non-finite values pass through."""
    c = col(c).cast("double")
    finite = ~F.isnan(c) & ~c.isin(float("inf"), float("-inf"))
    return F.when(finite, F.format_string(f"%.{digits - 1}e", c).cast("double")).otherwise(c)


def significant_text(c: Column | str, digits: int = 15) -> Column:
    """Plain decimal text with at most ``digits`` significant digits, of any magnitude; null if not finite.

    The text is built from mantissa and exponent, so nothing is cut and nothing overflows.
    """
    from tallyweave.functions.stats import scientific

    value = col(c).cast("double")
    written = scientific(value, F.lit(digits))
    sign = F.when(written.startswith("-") & (value != 0), F.lit("-")).otherwise(F.lit(""))
    figures = F.replace(F.ltrim(F.substring_index(written, "e", 1), F.lit("-")), F.lit("."), F.lit(""))
    power = F.substring_index(written, "e", -1).cast("int")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), figures)
    split = F.concat(F.substr(figures, F.lit(1), power + 1), F.lit("."), F.substr(figures, power + 2))
    large = F.concat(figures, F.repeat(F.lit("0"), power - (digits - 1)))
    plain = F.when(power < 0, small).when(power < digits - 1, split).otherwise(large)
    short = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    finite = ~F.isnan(value) & ~value.isin(float("inf"), float("-inf"))
    return F.when(finite, F.when(value == 0, F.lit("0")).otherwise(F.concat(sign, short)))


def role_text(c: Column) -> Column:
    """Sorted set of strings joined by a bar, the stored form of role and action sets."""
    return F.array_join(F.array_sort(F.collect_set(c)), "|")


def flags(cases: dict[str, Column]) -> Column:
    """Names of the conditions that hold, as an array.

    Built from conditional one-element arrays, which generated code evaluates; a filter over
    an array of nullable names would be interpreted row by row.
    """
    none = F.array().cast("array<string>")
    return F.concat(none, *[F.when(condition, F.array(F.lit(name))).otherwise(none) for name, condition in cases.items()])


def distinct_present(cells: list[Column]) -> Column:
    """Distinct non-null members of a row's cells."""
    return F.array_except(F.array(*cells), F.array(F.nullif(cells[0], cells[0])))
