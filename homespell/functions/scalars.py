"""Column functions for reading untidy deed fields."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_NAMESPACE = "homespell-parcel-v1"
WHITESPACE = " \t\n\r\f\u000b"

# Vocabularies of the county flag fields.
QUALIFIED_TRUE = ("Q", "QUALIFIED", "Y", "YES", "TRUE", "1", "A", "ARMS LENGTH")
QUALIFIED_FALSE = ("U", "UNQUALIFIED", "N", "NO", "FALSE", "0")
IMPROVED_TRUE = ("I", "IMPROVED", "Y", "YES", "TRUE", "1")
IMPROVED_FALSE = ("V", "VACANT", "N", "NO", "FALSE", "0")
BOOLEAN_TRUE = ("Y", "YES", "TRUE", "1", "T")
BOOLEAN_FALSE = ("N", "NO", "FALSE", "0", "F")
FLAG_TRUE = ("1", "true", "t", "yes", "y", "qualified", "improved")
FLAG_FALSE = ("0", "false", "f", "no", "n", "unqualified", "vacant")

# Legal-name roots of the studied operators, first match wins.
OPERATOR_TOKENS = (
    "OPENDOOR", "OPEN DOOR", "OFFERPAD", "OFFER PAD", "ZILLOW HOME", "REDFIN",
)
OPERATOR_RULES = (
    (r"^OPENDOOR(\s|$)", "opendoor"),
    (r"^OPEN DOOR PROPERTY TRUST(\s|$)", "opendoor"),
    (r"^OFFER ?PAD(\s|LLC|INC|SOLUTIONS|SPV|$)", "offerpad"),
    (r"^ZILLOW HOMES?(\s|$)", "zillow_offers"),
    (r"^REDFIN\s*NOW(\s|$)", "redfinnow"),
)


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    return F.trim(as_column(value).cast("string"), F.lit(WHITESPACE))


def normalized_name(name: str) -> str:
    return re.sub(r"[^A-Z0-9]+", "", name.upper())


def alias_column(columns: Iterable[str], aliases: Sequence[str]) -> str | None:
    """First alias that exists among ``columns``, ignoring case and punctuation.

    Presence decides, not content: a present but empty column hides later aliases.
    """
    present = {normalized_name(name): name for name in columns}
    return next((present[normalized_name(a)] for a in aliases if normalized_name(a) in present), None)


def alias_columns(df: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Project each wanted field from its first present alias, or null when none is present."""
    found = {field: alias_column(df.columns, aliases) for field, aliases in wanted.items()}
    return df.select(
        *[
            (F.col(f"`{name}`") if name else F.lit(None).cast("string")).alias(field)
            for field, name in found.items()
        ]
    )


def hash_parcel(market: Column | str, parcel: Column | str, namespace: str = HASH_NAMESPACE) -> Column:
    """Twenty hex digits that replace a raw parcel id."""
    key = F.upper(F.concat(as_column(market), F.lit(":"), F.upper(strip(parcel))))
    return F.substring(F.sha2(F.concat(F.lit(f"{namespace}:"), strip(key)), 256), 1, 20)


def classify_operator(name: Column | str, rules: Sequence[tuple[str, str]] = OPERATOR_RULES,
                      tokens: Sequence[str] = OPERATOR_TOKENS) -> Column:
    """Label of the named operator, by anchored patterns; anything else is null."""
    raw = F.upper(as_column(name))

    def label_of(cleaned: Column) -> Column:
        label = F.lit(None).cast("string")
        for pattern, operator in reversed(rules):
            label = F.when(cleaned.rlike(pattern), F.lit(operator)).otherwise(label)
        return label

    # A lambda variable, so that the name is cleaned once and not by each rule.
    cleaned = F.trim(F.regexp_replace(raw, "[^A-Z0-9]+", " "))
    return F.when(
        raw.rlike("|".join(tokens)), F.get(F.transform(F.array(cleaned), label_of), F.lit(0))
    )


def parse_number(value: Column | str) -> Column:
    number = F.regexp_replace(as_column(value).cast("string"), r"[$,\s]", "").try_cast("double")
    return F.when(~F.isnan(number), number)


def parse_date(value: Column | str) -> Column:
    """Calendar date from epoch milliseconds, ``yyyyMMdd`` or ISO text; anything else is null."""
    text = strip(value)
    number = text.try_cast("double")
    compact = F.concat_ws(
        "-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)
    )
    return (
        F.when(number > 1e10, F.to_date(F.timestamp_millis(number.cast("bigint"))))
        .when(
            number.between(19_000_000, 21_001_231) & text.rlike(r"^\d{8}$"),
            compact.try_cast("date"),
        )
        .otherwise(F.to_date(F.try_to_timestamp(text)))
    )


def _vocabulary(value: Column, true_words: Sequence[str], false_words: Sequence[str]) -> Column:
    return F.when(value.isin(*true_words), F.lit(True)).when(value.isin(*false_words), F.lit(False))


def parse_qualified(value: Column | str) -> Column:
    return _vocabulary(F.upper(strip(value)), QUALIFIED_TRUE, QUALIFIED_FALSE)


def qualified_from_description(value: Column | str) -> Column:
    text = F.upper(strip(value))
    return F.when(text != "", text.startswith("SALE QUALIFIED"))


def parse_improved(value: Column | str) -> Column:
    return _vocabulary(F.upper(strip(value)), IMPROVED_TRUE, IMPROVED_FALSE)


def parse_boolean(value: Column | str) -> Column:
    return _vocabulary(F.upper(strip(value)), BOOLEAN_TRUE, BOOLEAN_FALSE)


def safe_text(value: Column | str) -> Column:
    return F.nullif(strip(value), F.lit(""))


def nullable_flag(value: Column | str) -> Column:
    """Boolean reading that keeps unknown words as null."""
    return _vocabulary(F.lower(strip(value)), FLAG_TRUE, FLAG_FALSE)


def strict_flag(df: DataFrame, name: str) -> Column:
    """Boolean reading of a column in which missing or unknown means false."""
    column = F.col(name)
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return F.coalesce(column, F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(column != 0, F.lit(False))
    return F.coalesce(F.lower(strip(column)).isin(*FLAG_TRUE), F.lit(False))


def calendar_quarter(date: Column | str) -> Column:
    """Orderable quarter number, four per year."""
    return F.year(date) * 4 + F.quarter(date) - 1


def elapsed_years(start: Column | str, end: Column | str) -> Column:
    return F.datediff(end, start) / 365.25


def positive_log(value: Column | str) -> Column:
    return F.when(as_column(value) > 0, F.ln(value))


def property_age(event_year: Column, effective_year: Column, built_year: Column) -> Column:
    usable = F.when(effective_year.between(F.lit(1800), event_year), effective_year)
    return event_year - F.coalesce(usable, built_year)


def round_release(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column; a value that is not finite becomes null."""
    infinity = F.lit(float("inf"))
    rounded = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.DoubleType | T.FloatType):
            value = F.col(field.name)
            finite = ~F.isnan(value) & (F.abs(value) < infinity)
            rounded[field.name] = F.when(finite, F.round(value, digits))
    return df.withColumns(rounded) if rounded else df


def serialize_dates(df: DataFrame) -> DataFrame:
    """Every date column as ISO text."""
    dates = {
        field.name: F.date_format(field.name, "yyyy-MM-dd")
        for field in df.schema.fields
        if isinstance(field.dataType, T.DateType)
    }
    return df.withColumns(dates) if dates else df


def as_utc(value: Column | str, zone: Column | str | None = None) -> Column:
    """UTC instant of a date or local timestamp; without a zone the value already is UTC."""
    instant = as_column(value).cast("timestamp")
    if zone is None:
        return instant
    return F.coalesce(F.to_utc_timestamp(instant, as_column(zone)), instant)
