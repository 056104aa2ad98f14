"""Column expressions for ids, keys and scores, with explicit null rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: library, then three building-block numbers
COMPOUND_ID = r"^([A-Za-z]+\d+(?:_\d+)?)-(\d+)-(\d+)-(\d+)$"
MIN_ID_LENGTH = 10


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df itself, or an error that lists what is missing, before any job runs."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def finite(c: Column) -> Column:
    """NaN and infinities become null; so they are left out of ranks, sums and comparisons."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), None).otherwise(d)


def is_valid_id(c: Column) -> Column:
    """A text holding a C or c with more than ten characters; never null."""
    text = F.coalesce(c, F.lit(""))
    return text.rlike("[Cc]") & (F.length(text) > MIN_ID_LENGTH)


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def compound_part(c: Column, part: int) -> Column:
    """Part 1 (library) to 4 of a compound id; null for all parts if the id doesn't parse."""
    return F.nullif(F.regexp_extract(c, COMPOUND_ID, part), F.lit(""))


def with_compound_parts(df: DataFrame, column: str = "compound") -> DataFrame:
    return df.withColumns({n: compound_part(F.col(column), k) for k, n in enumerate(("library", "bb1", "bb2", "bb3"), 1)})


def block_group(library: Column, *blocks: Column) -> Column:
    """One key for a tuple of building blocks; null if any part is."""
    key = library
    for b in blocks:
        key = F.concat(key, F.lit("-"), b)
    return key


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))
