"""Scalar column expressions. Missing values are null throughout, never NaN."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """True division; a zero denominator gives null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def matches_any(label: Column, tags: Iterable[str]) -> Column:
    """True where the text contains one of the tags; null text stays null."""
    return label.rlike("|".join(tags))


def row_key(columns: Iterable[str]) -> Column:
    """64-bit hash of several columns. Nulls are marked, so (a, null) and (null, a) differ."""
    parts: list[Column] = []
    for name in columns:
        value = F.col(name)
        parts += [value.isNull(), value]
    return F.xxhash64(*parts)


def row_digest(columns: Iterable[str]) -> Column:
    """128-bit hash of several columns as hexadecimal text: the MD5 of the length and text of each value, with a mark for null."""
    texts = [quoted(name).cast("string") for name in columns]
    return F.md5(F.concat(*[
        F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")) for text in texts
    ]))


def cast_columns(df: DataFrame, columns: Iterable[str], to: str = "int", on_error: str = "raise") -> DataFrame:
    """Cast several columns; ``on_error='null'`` turns unreadable text into null."""
    if on_error not in ("raise", "null"):
        raise ValueError("on_error is 'raise' or 'null'")

    def convert(name: str) -> Column:
        return F.col(name).cast(to) if on_error == "raise" else F.col(name).try_cast(to)

    return df.withColumns({name: convert(name) for name in columns})


def columns_first(df: DataFrame, front: list[str]) -> DataFrame:
    """Move the named columns to the front."""
    named = set(front)
    return df.select(*[quoted(c) for c in front], *[quoted(c) for c in df.columns if c not in named])


def quoted(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col(f"`{name}`")


def row_sum(columns: Iterable[Column]) -> Column:
    """Sum across columns of one row, null counted as zero."""
    return reduce(add, [F.coalesce(c, F.lit(0)) for c in columns], F.lit(0))


def as_flag(value: Column) -> Column:
    """Boolean to 0/1; null gives 0."""
    return F.coalesce(value.cast("int"), F.lit(0))


def strip_panel_suffix(panel: Column) -> Column:
    """Drop one trailing letter a-e."""
    return F.regexp_replace(panel, "[abcde]$", "")


def panel_number(panel: Column) -> Column:
    """Panel id without the letters a, b, c, d, e and p, as a number."""
    return F.regexp_replace(panel, "[abcdep]", "").cast("int")


def error_balance(recall: Column, precision: Column) -> Column:
    """1/recall - 1/precision: the signed share of calls gained or lost."""
    return ratio(F.lit(1.0), recall) - ratio(F.lit(1.0), precision)


def not_equal_or_null(value: Column, text: str) -> Column:
    """Null-safe ``!=``: null counts as different."""
    return ~value.eqNullSafe(F.lit(text))


def decode_number(text: Column, missing: str = ".", default: float | None = None) -> Column:
    """Text to number with a sentinel for missing; missing becomes ``default``."""
    value = F.when(text != missing, text).cast("double")
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def clip_at_zero(value: Column) -> Column:
    """Negative to zero; null stays null."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def map_values(value: Column, mapping: Mapping) -> Column:
    """Dictionary lookup; unmatched gives null."""
    pairs = [F.lit(item) for entry in mapping.items() for item in entry]
    return F.try_element_at(F.create_map(*pairs), value)


def map_fractions(value: Column, mapping: Mapping[float, float]) -> Column:
    """Dictionary lookup with fractional keys, compared after rounding to 1e-6."""
    millionths = {int(round(key * 1e6)): float(out) for key, out in mapping.items()}
    return map_values(F.round(value * F.lit(1e6)).cast("int"), millionths)


def membership_flags(text: Column, labels: Mapping[str, str]) -> dict[str, Column]:
    """One boolean per vocabulary item: does the cell contain it (case-sensitive)?"""
    return {name: F.contains(text, F.lit(item)) for item, name in labels.items()}
