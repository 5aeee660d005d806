"""Exact arithmetic on 256-bit unsigned integers kept as text.

Values are cut into base-10**6 limbs. A limb sum stays inside a bigint for 9 * 10**12 rows, the
sums combine map-side like any other sum, and the carry is resolved once per output group.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB_DIGITS = 6
LIMB_BASE = 10**LIMB_DIGITS
LIMBS = 13  # 78 decimal digits hold 2**256 - 1


def _resolve(limbs: list[Column] | Column) -> Column:
    """Carry from the lowest limb up and render without leading zeros."""
    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit("").alias("text"))

    def step(acc: Column, limb: Column) -> Column:
        total = limb + acc["carry"]
        base = F.lit(LIMB_BASE).cast("bigint")
        return F.struct(
            F.call_function("div", total, base).alias("carry"),
            F.concat(F.lpad((total % base).cast("string"), LIMB_DIGITS, "0"), acc["text"]).alias("text"),
        )

    folded = F.aggregate(limbs if isinstance(limbs, Column) else F.array(*limbs), start, step)
    text = F.concat(folded["carry"].cast("string"), folded["text"])
    return F.regexp_replace(text, "^0+(?=.)", "")


def _decimal_limbs(text: Column) -> list[Column]:
    width = LIMB_DIGITS * LIMBS
    digits = F.regexp_replace(F.trim(text), r"^\+?0*", "")
    padded = F.lpad(digits, width, "0")
    limbs = [
        F.substring(padded, width - LIMB_DIGITS * (i + 1) + 1, LIMB_DIGITS).cast("bigint")
        for i in range(LIMBS)
    ]
    # the highest limb alone is checked, so the others share one padded text
    wide = F.raise_error(F.concat(F.lit("amount beyond 256 bits: "), digits)).cast("bigint")
    return [*limbs[:-1], F.when(F.length(digits) > width, wide).otherwise(limbs[-1])]


def sum_parts(amount: Column | str, prefix: str) -> list[Column]:
    """Aggregates for an exact sum of decimal text; null and blank values count as absent."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    clean = F.when(F.trim(amount) != "", amount)
    return [
        F.coalesce(F.sum(limb), F.lit(0)).cast("bigint").alias(f"{prefix}_{i}")
        for i, limb in enumerate(_decimal_limbs(clean))
    ]


def part_names(prefix: str) -> list[str]:
    return [f"{prefix}_{i}" for i in range(LIMBS)]


def render_sum(prefix: str) -> Column:
    """Decimal text of the sum whose parts were aggregated under ``prefix``."""
    return _resolve([F.col(name) for name in part_names(prefix)])


def sum_uint256(df: DataFrame, by: list[str], amount: str, name: str = "total") -> DataFrame:
    parts = df.groupBy(*by).agg(*sum_parts(amount, "_limb"))
    return parts.withColumn(name, render_sum("_limb")).drop(*part_names("_limb"))


def merge_parts(prefix: str) -> list[Column]:
    """Second-level aggregates that add up parts already summed at a finer grain."""
    return [F.sum(name).cast("bigint").alias(name) for name in part_names(prefix)]


def parts_double(prefix: str) -> Column:
    """The sum as a double, for shares and ratios."""
    total = F.lit(0.0)
    for i, name in enumerate(part_names(prefix)):
        total = total + F.col(name).cast("double") * F.lit(float(LIMB_BASE**i))
    return total


def hex_word_to_decimal(word: Column | str) -> Column:
    """A 64-digit hexadecimal word as decimal text.

    Words below 2**60 and 2**124 are converted with bigint and decimal arithmetic inside the
    generated code. A larger word is eight 32-bit pieces; each piece times its power of two is
    linear in decimal limbs, so it takes a small constant matrix and one carry pass. That branch
    is made of lambdas, which are evaluated for wide words alone and keep the generated method small.
    """
    word = F.col(word) if isinstance(word, str) else word
    low, high = F.substring(word, 49, 16), F.substring(word, 33, 16)
    small = F.substring(word, 1, 49) == "0" * 49
    medium = F.substring(word, 1, 33) == "0" * 33
    shifted = F.conv(high, 16, 10).cast("decimal(17,0)") * F.lit(Decimal(2**64)).cast("decimal(20,0)")
    wide = shifted.cast("decimal(38,0)") + F.conv(low, 16, 10).cast("decimal(20,0)")
    starts = F.array(*[F.lit(57 - 8 * i) for i in range(8)])
    pieces = F.transform(starts, lambda s: F.conv(F.substr(word, s, F.lit(8)), 16, 10).cast("bigint"))
    factors = [[(2 ** (32 * i) // LIMB_BASE**j) % LIMB_BASE for i in range(8)] for j in range(LIMBS)]
    matrix = F.array(*[F.array(*[F.lit(f).cast("bigint") for f in row]) for row in factors])
    products = lambda row, p: F.aggregate(F.zip_with(row, p, lambda a, b: a * b), F.lit(0).cast("bigint"), lambda a, b: a + b)
    limbs = F.transform(F.array(pieces), lambda p: F.transform(matrix, lambda row: products(row, p))).getItem(0)
    exact = F.when(medium, wide.cast("decimal(38,0)").cast("string")).otherwise(_resolve(limbs))
    return F.when(small, F.conv(low, 16, 10)).otherwise(exact)

