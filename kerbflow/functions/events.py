"""Functions on raw event fields: time, labels, vehicles, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbflow.functions import vocabulary as V
from kerbflow.functions.basics import clean_key, ladder, lookup, not_missing, quoted

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def with_local_time(df: DataFrame, column: str, offset_minutes: int = 330, name: str = "local_ts") -> DataFrame:
    """Add the local wall-clock time of a UTC time column; null where it cannot be parsed.

    Strings may carry an offset and whole or fractional seconds; without one they mean UTC.
    The result does not depend on the session time zone.
    """
    kind = df.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, T.TimestampNTZType):
        utc = value
    else:
        if isinstance(kind, T.StringType):
            text = F.trim(value)
            zoned = text.rlike(r":\d{2}(\.\d+)?\s*(Z|[+-]\d{2}(:?\d{2})?)$")
            value = F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))))
        utc = F.timestamp_add("MICROSECOND", F.unix_micros(value), F.expr(_EPOCH))
    shift = F.expr(f"INTERVAL '{offset_minutes}' MINUTE")
    return df.withColumn(name, utc + shift)


def hour_label(hour: Column, buckets: list[tuple[int, int, str]]) -> Column:
    """Label of the bucket that holds ``hour``; null outside all of them."""
    return ladder([((hour >= low) & (hour < high), label) for low, high, label in buckets])


def is_peak(hour: Column) -> Column:
    return F.when(hour.isin(V.PEAK_HOURS), 1).otherwise(0)


def pincode(location: Column) -> Column:
    marked = F.nullif(F.regexp_extract(location, r"(?i)Pin[- ]?(\d{5,6})", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(location, r"(\d{6})", 1), F.lit(""))
    return F.coalesce(marked, bare)


def label_list(column: str, is_array: bool = False) -> Column:
    """Upper-case labels of one event, from an array, a JSON list or a loose comma list."""
    missing = ", ".join(quoted(word) for word in ["", "[]", *V.MISSING_WORDS])
    loose = f"split(regexp_replace(trim({column}), '^[\\\\[]+|[\\\\]]+$', ''), ',')"
    items = column if is_array else (
        f"CASE WHEN upper(trim({column})) NOT IN ({missing})"
        f" THEN coalesce(from_json(trim({column}), 'array<string>'), {loose}) END")
    bare = "upper(trim(BOTH '\\'' FROM trim(BOTH '\"' FROM trim(item))))"
    return F.expr(f"coalesce(filter(transform({items}, item -> {bare}), item -> item <> ''), array())")


def first_label(value: Column) -> Column:
    """First label as written; ``UNKNOWN`` when there is none."""
    parts = F.split(F.regexp_replace(value, r'[\[\]"]', ""), ",")
    kept = F.filter(F.transform(parts, lambda part: F.trim(part)), lambda part: part != "")
    return F.coalesce(F.get(kept, F.lit(0)), F.lit("UNKNOWN"))


def any_of(labels: str, wanted: list[str]) -> Column:
    """1 when at least one wanted label is present, else 0."""
    words = ", ".join(quoted(word) for word in wanted)
    return F.expr(f"CAST(coalesce(arrays_overlap({labels}, array({words})), false) AS INT)")


def trusted_vehicle(updated: Column, original: Column) -> Column:
    return F.when(updated.isNotNull() & (clean_key(updated) != "NULL"), updated).otherwise(original)


def obstruction(vehicle: Column) -> Column:
    return lookup(clean_key(vehicle), V.VEHICLE_OBSTRUCTION, V.DEFAULT_OBSTRUCTION)


def proxy_weight(vehicle: Column) -> Column:
    """Documented vehicle weight of the risk proxy, 0.7 to 1.5."""
    return lookup(clean_key(vehicle), V.PROXY_WEIGHT, V.DEFAULT_PROXY_WEIGHT)


def severity(vehicle: Column) -> Column:
    return lookup(clean_key(vehicle), V.VEHICLE_SEVERITY, V.DEFAULT_SEVERITY)


def trust(status: Column) -> Column:
    return lookup(F.lower(F.trim(status)), V.STATUS_TRUST, V.DEFAULT_TRUST)


def named_junction(name: Column) -> Column:
    """1 for a real junction name, 0 for null and placeholder words."""
    return F.coalesce(not_missing(name, V.NO_JUNCTION_WORDS), F.lit(False)).cast("int")


def station_name(value: Column) -> Column:
    """Trimmed station; null for blanks and placeholder words."""
    text = F.trim(value)
    return F.when((text != "") & ~F.upper(text).isin(V.MISSING_WORDS), text)
