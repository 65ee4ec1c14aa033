"""Column expressions for cleaning and feature derivation.

All are built from Spark's own functions, so they stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed value: the characters that count as white space when trimming text.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
MISSING = "missing"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def literal_map(mapping: Mapping[str, str]) -> Column:
    """A small constant lookup. Large lookups belong in ``operators.joins.lookup_join``."""
    if not mapping:
        return F.lit(None).cast("map<string,string>")
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Exact, case-sensitive lookup; null when the key is unknown."""
    if not mapping:
        return F.lit(None).cast("string")
    return F.try_element_at(literal_map(mapping), _col(c))


def sentinel_replace(c: Column | str, sentinel: str, value: str = MISSING) -> Column:
    c = _col(c)
    return F.when(c == sentinel, F.lit(value)).otherwise(c)


def optional_column(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """The column, or a typed null when the frame lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def normalize_map(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """Trimmed name mapped to its canonical form; unmapped names pass, blanks become null."""
    name = blank_to_null(c)
    return F.coalesce(lookup(name, mapping), name)


def replace_map(c: Column | str, mapping: Mapping[str, str]) -> Column:
    """The variant without trimming or blanking."""
    return F.coalesce(lookup(c, mapping), _col(c))


def bucket_lookup(c: Column | str, names: Mapping[str, str], buckets: Mapping[str, str]) -> Column:
    """Normalise, then map to a bucket; null when there is none."""
    return lookup(normalize_map(c, names), buckets)


def token_buckets(c: Column | str, mapping: Mapping[str, str], sep: str = ",") -> Column:
    """Comma list to the sorted set of its tokens' buckets; null or blank gives an empty array."""
    found = F.transform(F.split(_col(c), sep), lambda t: lookup(strip(t), mapping))
    empty = F.array().cast("array<string>")
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(found))), empty)


def collapse_buckets(a: Column | str) -> Column:
    a = _col(a)
    return (F.when(F.size(a) == 1, F.element_at(a, 1))
            .when(F.size(a) > 1, F.lit("multi"))
            .otherwise(F.lit("none")))


def bucket_match(bucket: Column | str, buckets: Column | str) -> Column:
    return F.coalesce(F.array_contains(_col(buckets), _col(bucket)), F.lit(False)).cast("int")


def code_group(c: Column | str, codes: Sequence[str]) -> Column:
    """Blank or null: ``none``; a known code (any case): the code; else ``other``."""
    v = F.lower(blank_to_null(c))
    known = sorted({x.lower() for x in codes})
    return F.when(v.isNull(), "none").when(v.isin(known), v).otherwise("other")


def code_group_exact(c: Column | str, codes: Sequence[str]) -> Column:
    """The variant without trimming or case folding."""
    c = _col(c)
    return F.when(c.isNull(), "none").when(c.isin(sorted(codes)), c).otherwise("other")


def integer_flag(df: DataFrame, name: str) -> Column:
    """A flag read as an integer: numbers truncate, text must look like an integer."""
    if name not in df.columns:
        return F.lit(None).cast("bigint")
    c, dtype = F.col(name), df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return F.when(strip(c).rlike(r"^[+-]?[0-9]+$"), strip(c).try_cast("bigint"))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c.try_cast("bigint"))
    return c.try_cast("bigint")


def fallback_category(df: DataFrame, text: str, flag: str) -> Column:
    """Text when given (trimmed, lower), else the flag: 1 male, other integers female."""
    f = integer_flag(df, flag)
    return F.coalesce(
        F.lower(blank_to_null(optional_column(df, text).cast("string"))),
        F.when(f == 1, "male").when(f.isNotNull(), "female"),
        F.lit(MISSING),
    )


def slugify(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "")


def to_number(c: Column | str) -> Column:
    """Text or number to double; null when it is not a number. NaN counts as null."""
    text = strip(_col(c).cast("string"))
    # a Java type suffix ("1d", "2f") is not part of a number in data
    plain = F.when(~text.rlike("[0-9.][dDfF]$"), text)
    x = plain.try_cast("double")
    return F.when(~F.isnan(x), x)


def number(df: DataFrame, name: str) -> Column:
    """``to_number`` that skips the text detour for columns that are numeric already."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        c = F.col(name).cast("double")
        return F.when(~F.isnan(c), c)
    if isinstance(dtype, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(dtype, T.BooleanType):
        return F.col(name).cast("int").cast("double")
    return to_number(name)


def number_filled(df: DataFrame, name: str) -> Column:
    return F.coalesce(number(df, name), F.lit(0.0))


def category_filled(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(MISSING))


def round_even(c: Column | str, digits: int) -> Column:
    """Scale, round half to even, scale back: the usual rounding of numeric libraries."""
    scale = float(10 ** digits)
    return F.rint(_col(c) * scale) / scale


def share_label(code: Column | str, share: Column | str) -> Column:
    """``code:12.5%``."""
    return F.concat(_col(code), F.lit(":"), round_even(_col(share) * 100, 1).cast("string"), F.lit("%"))


def plain_number(c: Column | str, digits: int = 2) -> Column:
    """A rounded number as text with at least one decimal and no exponent."""
    fixed = _col(c).cast(f"decimal(38,{digits})").cast("string")
    return F.coalesce(F.regexp_replace(fixed, r"(\.\d+?)0+$", "$1"), F.lit("nan"))


def correlation_band(r: Column | str) -> Column:
    a = F.abs(_col(r))
    return F.when(a < 0.3, "low").when(a < 0.7, "moderate").when(a.isNotNull(), "high")
