"""Quality rules with adaptive thresholds per language and source, as DataFrame operations.

Every measure of a document is an integer. A sketch is the count of documents per logarithmic
bucket of the measure: buckets are exact below 128 and 1/64 wide above, so quantiles have a
relative error below 1.6 %, sketches merge by adding counts, and they have a fixed maximum size.
Sketches are built per language and source, merged per language and over everything, and give
each group its own fences; groups with too few documents use the next wider sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import join_groups
from tallyweave.session import cut

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: A group's own sketch is used from so many documents on.
MIN_GROUP = 200
#: Fences lie so many interquartile ranges outside the quartiles.
SPREADS = 3
#: Measure: (smallest interquartile range that is believed, whether small values are judged too).
MEASURES = {
    "symbol_ppm": (15_000, False),
    "dup_line_ppm": (150_000, False),
    "repeat_ppm": (100_000, False),
    "word_length": (400, True),  # thousandths of a code point
}


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` holds lambdas."""
    return F.transform(F.array(value), use).getItem(0)


def _repeat_words(spoken: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words which the text has twice or more."""

    def marked(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _bind(
            pairs,
            lambda p: F.sort_array(
                F.transform(
                    F.filter(p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"])),
                    lambda x: x["i"],
                )
            ),
        )
        gaps = _bind(twice, lambda t: F.transform(t, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(t, k + 1) - i, F.lit(WINDOW)))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def doubled(hashes: Column, width: int) -> Column:
        """Hashes of twice as many words, from those of ``width`` words."""
        return _bind(
            hashes,
            lambda h: F.zip_with(
                F.slice(h, F.lit(1), F.size(h) - width), F.slice(h, F.lit(width + 1), F.size(h) - width), lambda a, b: F.xxhash64(a, b)
            ),
        )

    hashes = F.transform(spoken, lambda w: F.xxhash64(w))
    for width in (1, 2, 4):
        hashes = doubled(hashes, width)
    return F.when(F.size(spoken) < WINDOW, 0).otherwise(
        _bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(marked(h)))
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``n_lines``.

    Whole texts; a null text has none of anything. Lines count if they hold a word.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    spoken = F.filter(F.split(whole, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    counted = _bind(spoken, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _repeat_words(w).cast("bigint").alias("n_repeat_words")))
    lines = _bind(
        F.filter(F.split(whole, "\n"), lambda x: F.translate(x, BLANKS, "") != ""),
        lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), F.size(F.array_distinct(x)).cast("bigint").alias("distinct")),
    )
    packed = docs.withColumns(
        {
            "_w": counted,
            "_l": lines,
            "word_chars": F.length(F.translate(whole, BLANKS, "")).cast("bigint"),
            "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("bigint"),
        }
    )
    return packed.withColumns(
        {
            "n_words": F.col("_w.n_words"),
            "n_repeat_words": F.col("_w.n_repeat_words"),
            "n_lines": F.col("_l.n_lines"),
            "n_dup_lines": F.col("_l.n_lines") - F.col("_l.distinct"),
        }
    ).drop("_w", "_l")


def _scaled(part: str, whole: str, unit: int) -> Column:
    return F.call_function("div", F.col(part) * unit, F.greatest(F.col(whole), F.lit(1))).cast("bigint")


def bucket(value: Column) -> Column:
    """Lower end of the value's bucket: seven significant bits."""
    drop = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketch(measured: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Counts per group, measure and bucket: one shuffle of pre-aggregated counts."""
    return measured.groupBy(*by, *[bucket(F.col(m)).alias(f"_{m}") for m in measures]).agg(F.count(F.lit(1)).alias("_n")).select(
        *by, "_n", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"_{m}").alias("bucket")) for m in measures])).alias("_x")
    ).groupBy(*by, F.col("_x.measure").alias("measure"), F.col("_x.bucket").alias("bucket")).agg(F.sum("_n").alias("n"))


def fences(sketches: DataFrame, by: list[str], spreads: int = SPREADS) -> DataFrame:
    """Per group: ``n`` and for each measure the fences ``<measure>_lo`` and ``<measure>_hi``."""
    group = Window.partitionBy(*by, "measure")
    ranked = sketches.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("all", F.sum("n").over(group))

    def quartile(k: int) -> Column:
        return F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("bucket")))

    quartiles = ranked.groupBy(*by, "measure").agg(F.max("all").alias("n"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    out = [F.max("n").alias("n")]
    for name, (least, low) in MEASURES.items():
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(least)) * spreads
        this = F.col("measure") == name
        out.append(F.max(F.when(this, F.col("q3") + spread)).alias(f"{name}_hi"))
        if low:
            out.append(F.max(F.when(this, F.col("q1") - spread)).alias(f"{name}_lo"))
    return quartiles.groupBy(*by).agg(*out)


def quality_rules(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_group: int = MIN_GROUP, spreads: int = SPREADS
) -> DataFrame:
    """``docs`` without its text, with the measures, ``base_failed``, ``kept`` and ``level``.

    ``base_failed``: fewer than 20 words, or more than 30 % of the words in repeated windows.
    Other documents are kept while every measure lies within the fences of their group
    (``level`` 0: language and source, 1: language, 2: everything). Null languages and sources
    are groups of their own. Fences come from documents that pass the base rules. Columns of
    ``docs`` named like a measure are replaced; others pass through; repeated rows count as often
    as they occur; an empty table gives no rows.
    """
    keep = [c for c in docs.columns if c != text and c not in OUTPUTS]
    measured = measure(docs.drop(*[c for c in docs.columns if c in OUTPUTS and c not in (text, lang, source)]), text)
    measured = measured.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))
    measured = measured.withColumns(
        {
            "symbol_ppm": _scaled("n_symbols", "word_chars", 1_000_000),
            "dup_line_ppm": _scaled("n_dup_lines", "n_lines", 1_000_000),
            "repeat_ppm": _scaled("n_repeat_words", "n_words", 1_000_000),
            "word_length": _scaled("word_chars", "n_words", 1_000),
        }
    ).drop(text)
    measured = cut(measured)
    names = list(MEASURES)
    fine = cut(sketch(measured.filter(~F.col("base_failed")), [lang, source], names))
    broad = fine.groupBy(lang, "measure", "bucket").agg(F.sum("n").alias("n"))
    whole = broad.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    limits = [f"{m}_{side}" for m, (_, low) in MEASURES.items() for side in (("lo", "hi") if low else ("hi",))]

    def named(table: DataFrame, level: int) -> DataFrame:
        return table.withColumnsRenamed({"n": f"n{level}"} | {c: f"{c}{level}" for c in limits})

    one = named(fences(fine, [lang, source], spreads), 0)
    two = named(fences(broad, [lang], spreads), 1).withColumnRenamed(lang, "_lang")
    three = named(fences(whole.withColumn("_all", F.lit(0)), ["_all"], spreads), 2).drop("_all")
    # every group of documents, also those that hold rejected documents alone
    groups = measured.groupBy(lang, source).agg(F.count(F.lit(1)).alias("_size"))
    a, b = groups.alias("a"), one.alias("b")
    table = a.join(b, F.col(f"a.{lang}").eqNullSafe(F.col(f"b.{lang}")) & F.col(f"a.{source}").eqNullSafe(F.col(f"b.{source}")), "left").select(
        f"a.{lang}", f"a.{source}", "_size", "n0", *[f"{c}0" for c in limits]
    )
    table = table.join(two, F.col(lang).eqNullSafe(F.col("_lang")), "left").withColumn("_one", F.lit(0))
    table = table.join(F.broadcast(three.withColumn("_one", F.lit(0))), "_one", "left")  # one row
    level = F.when(F.col("n0") >= min_group, 0).when(F.col("n1") >= min_group, 1).otherwise(2)
    table = table.withColumn("level", level).select(
        lang, source, "_size", "level",
        *[F.when(F.col("level") == 0, F.col(f"{c}0")).when(F.col("level") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(c) for c in limits],
    )
    judged = join_groups(measured, cut(table), [lang, source], "_size")
    within = F.lit(True)
    for name, (_, low) in MEASURES.items():
        within &= F.col(name) <= F.coalesce(f"{name}_hi", name)
        if low:
            within &= F.col(name) >= F.coalesce(f"{name}_lo", name)
    return judged.withColumn("kept", ~F.col("base_failed") & within).select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "level", *names, *limits
    )


OUTPUTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "kept", "level",
    *MEASURES, *[f"{m}_{side}" for m in MEASURES for side in ("lo", "hi")], "_w", "_l", "_size",
]
