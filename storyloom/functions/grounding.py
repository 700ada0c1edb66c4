"""Checkable facts of a sentence and whether a source text supports them, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom import constants as K
from storyloom.functions import lit_strings

_EDGES = "[" + "".join("\\" + c for c in K.FACT_EDGE_CHARS) + "]+"


def comparable(text: Column) -> Column:
    """Lower case, plain dashes and blanks, thousands joined, other punctuation blanked, a blank at each end."""
    s = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), K.DASHES, "-")
    s = F.regexp_replace(s, r"(?U)(\d)" + K.SPACES + r"(\d{3})(?!\d)", "$1$2")
    # as a look-ahead this runs several times faster than the negated class of the same characters
    return F.concat(F.lit(" "), F.regexp_replace(s, "(?s)(?:(?![a-z0-9а-яё.,+#_-]).)+", " "), F.lit(" "))


def squashed(c: Column) -> Column:
    return F.translate(c, " ._-", "")


def _numbers(low: Column) -> Column:
    found = F.regexp_extract_all(low, F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("."))))


def _names(low: Column) -> Column:
    found = F.regexp_extract_all(low, F.lit("([a-z][a-z0-9+#._-]*)"), F.lit(1))
    cut = F.transform(found, lambda w: F.regexp_replace(w, f"^{_EDGES}|{_EDGES}$", ""))
    return F.array_distinct(F.filter(cut, lambda w: (F.length(w) >= 3) & ~w.isin(*K.GENERIC_NAMES)))


def facts(text: Column) -> Column:
    """Latin names and numbers of a sentence. Cyrillic words are not checked: a retelling rewords them."""
    low = comparable(text)
    return F.array_union(_names(low), _numbers(low))


SOURCE_COLUMNS = ["_src", "_flat", "_known"]


def with_source_facts(df: DataFrame, source: str) -> DataFrame:
    """`df` plus what a source text supports: its comparable form, the form without separators, and its numbers, digits
    or spelled out. Done once per source, however many fragments are checked against it."""
    spelled = {w: digit for digit, forms in K.NUMBER_WORDS.items() for w in forms.split()}
    to_digit = F.create_map(*[F.lit(x) for pair in spelled.items() for x in pair])
    words = F.regexp_extract_all("_src", F.lit("([a-zа-яё]+)"), F.lit(1))
    spoken = F.transform(F.array_intersect(words, lit_strings(spelled)), lambda w: F.element_at(to_digit, w))
    src = F.col("_src")
    return (
        df.withColumn("_src", comparable(F.col(source)))
        .withColumns({"_flat": squashed(src), "_known": F.array_union(_numbers(src), spoken)})
    )


def with_missing(df: DataFrame, fragment: str, out: str) -> DataFrame:
    """`df` (with source facts) plus `out`: facts of column `fragment` that the source lacks, sorted. Numbers must match
    exactly; names may be part of a longer word or differ in separators."""
    src, flat, frag = F.col("_src"), F.col("_flat"), F.col("_frag")
    # two uses of the flat form keep the optimizer from moving its computation into the loop over names
    in_flat = lambda n: (F.length(flat) > 0) & F.contains(flat, squashed(n))
    bad_names = F.filter(_names(frag), lambda n: ~F.contains(src, n) & ~in_flat(n))
    missing = F.array_union(bad_names, F.array_except(_numbers(frag), F.col("_known")))
    return df.withColumn("_frag", comparable(F.col(fragment))).withColumn(out, F.sort_array(missing)).drop("_frag")


def with_ungrounded(df: DataFrame, fragment: str, source: str, out: str) -> DataFrame:
    """`df` plus `out`: facts of `fragment` that `source` lacks."""
    return with_missing(with_source_facts(df, source), fragment, out).drop(*SOURCE_COLUMNS)


def with_reject_reason(df: DataFrame, fragment: str, out: str) -> DataFrame:
    """`df` (with source facts) plus `out`: why a fragment must not be published; NULL when it may."""
    foreign = F.regexp_like(fragment, F.lit(K.FOREIGN_SCRIPTS))
    why = F.when(foreign, K.FOREIGN_SCRIPT_REASON).when(F.size("_bad") > 0, F.array_join("_bad", ", "))
    return with_missing(df, fragment, "_bad").withColumn(out, why).drop("_bad")


def card_of(answer: Column) -> Column:
    """struct(line, points) from model JSON; points may come as a list or as one text with line breaks."""
    from storyloom.functions import blank_to_null
    from storyloom.functions.text import json_block

    raw = json_block(answer)
    line = blank_to_null(F.regexp_replace(F.trim(F.get_json_object(raw, "$.line")), '^"+|"+$', ""))
    listed = F.from_json(F.get_json_object(raw, "$.points"), "array<string>")
    text = F.get_json_object(raw, "$.points")
    points = F.when(F.startswith(F.ltrim(text), F.lit("[")), listed).otherwise(F.split(text, "\n"))
    points = F.transform(
        F.coalesce(points, F.array().cast("array<string>")),
        lambda p: F.trim(F.regexp_replace(F.trim(p), r"^[•\-—*]+", "")),
    )
    return F.struct(line.alias("line"), F.slice(F.filter(points, lambda p: p != ""), 1, 3).alias("points"))
