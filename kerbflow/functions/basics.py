"""Small shared column helpers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def dbl(value: float) -> Column:
    return F.lit(float(value))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def lookup(key: Column, table: Mapping[str, float], default: float) -> Column:
    """Value of a small fixed table, with a default for unknown or null keys."""
    pairs = ", ".join(f"{quoted(name)}, {value!r}D" for name, value in table.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({pairs})"), key), dbl(default))


def ladder(cases: Iterable[tuple[Column, object]], otherwise: object = None) -> Column:
    """First matching case wins."""
    result = None
    for test, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        result = F.when(test, value) if result is None else result.when(test, value)
    if otherwise is None:
        return result
    return result.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def bounded(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Clamp; null stays null (greatest and least alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(dbl(low), F.least(dbl(high), value)))


def ratio(numerator: Column, denominator: Column, empty: float | None = 0.0) -> Column:
    """Division that gives ``empty`` for a zero or null denominator."""
    safe = F.when(denominator != 0, numerator.cast("double") / denominator.cast("double"))
    return safe if empty is None else F.coalesce(safe, dbl(empty))


def clean_key(value: Column) -> Column:
    return F.upper(F.trim(value))


def not_missing(value: Column, words: list[str]) -> Column:
    return value.isNotNull() & ~clean_key(value).isin(words)


def hex_number(text: Column, start: int, digits: int = 8) -> Column:
    """Unsigned value of a slice of a hex string."""
    return F.conv(F.substring(text, start, digits), 16, 10).cast("bigint")


def digest_mod(text: str, modulus: int) -> Column:
    """SHA-256 of a SQL text expression read as one 256-bit number, modulo a small number.

    The one-element transform binds the digest, so it is computed once for its eight parts.
    """
    terms = [
        f"pmod(CAST(conv(substr(h, {1 + 8 * part}, 8), 16, 10) AS BIGINT), {modulus}) * {pow(2 ** 32, 7 - part, modulus)}"
        for part in range(8)
    ]
    return F.expr(f"transform(array(sha2({text}, 256)), h -> CAST(pmod({' + '.join(terms)}, {modulus}) AS INT))[0]")


def split_of(zone_id: str, seed: int, train_pct: int = 70) -> Column:
    """Stable train/test label of an id column."""
    bucket = digest_mod(f"concat('{seed}:', {zone_id})", 100)
    return F.when(bucket < train_pct, F.lit("train")).otherwise(F.lit("test"))


def valid_ratio(value: Column) -> Column:
    """Finite and strictly positive; false for null."""
    return F.coalesce(
        value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < float("inf")), F.lit(False)
    )


def degradation(value: Column) -> Column:
    return bounded((value - 1.0) / 2.0)


def moving_label(score: Column) -> Column:
    """Impact band; an upper bound belongs to the lower band."""
    return ladder([(score <= 25, "MINIMAL"), (score <= 50, "MODERATE"), (score <= 75, "SEVERE")], "CRITICAL")


def half_up(value: Column, digits: int, shift: float = 0.5) -> Column:
    """Round half up by plain arithmetic, so that every engine gives the same double."""
    scale = dbl(10.0 ** digits)
    return F.floor(value * scale + dbl(shift)).cast("double") / scale
