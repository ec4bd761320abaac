"""Memory and size strings, epoch times and the text forms of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit suffix -> bytes
UNIT_BYTES = {"k": 1024, "m": 1024**2, "g": 1024**3, "t": 1024**4}
# Size-string suffix -> bytes
SIZE_UNIT_BYTES = {"TB": 1024**4, "GB": 1024**3, "MB": 1024**2, "KB": 1024, "B": 1}


def _number_and_unit(text: Column) -> tuple[Column, Column]:
    clean = F.lower(F.trim(text))
    number = F.regexp_extract(clean, r"^([0-9]*\.?[0-9]+)\s*[kmgt]?$", 1).try_cast("double")
    return number, F.regexp_extract(clean, r"([kmgt])$", 1)


def memory_bytes(text: Column) -> Column:
    """'4g' -> bytes; a bare number is bytes."""
    number, unit = _number_and_unit(text)
    factor = F.lit(1)
    for suffix, size in UNIT_BYTES.items():
        factor = F.when(unit == suffix, F.lit(size)).otherwise(factor)
    return (number * factor).cast("long")


def memory_mb(text: Column, bare_unit: str = "mb", empty_mb: int | None = None) -> Column:
    """'4g' -> whole MB. ``bare_unit`` says what a number without a suffix means ('mb' or 'bytes')."""
    number, unit = _number_and_unit(text)
    bare = F.lit(1.0) if bare_unit == "mb" else F.lit(1.0 / 1024**2)
    factor = bare
    for suffix, size in UNIT_BYTES.items():
        factor = F.when(unit == suffix, F.lit(size / 1024**2)).otherwise(factor)
    parsed = (number * factor).cast("long")
    if empty_mb is None:
        return parsed
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit(empty_mb).cast("long")).otherwise(parsed)


def size_bytes(text: Column) -> Column:
    """'10GB' -> bytes, null when malformed or without a unit."""
    clean = F.upper(F.trim(text))
    number = F.regexp_extract(clean, r"^([0-9.]+)\s*(TB|GB|MB|KB|B)$", 1).try_cast("double")
    unit = F.regexp_extract(clean, r"(TB|GB|MB|KB|B)$", 1)
    factor = F.lit(None).cast("long")
    for suffix, size in SIZE_UNIT_BYTES.items():
        factor = F.when(unit == suffix, F.lit(size)).otherwise(factor)
    return (number * factor).cast("long")


def epoch_or_iso(epoch_ms: Column, iso: Column) -> Column:
    """Epoch milliseconds if present, else an ISO text that may end in GMT."""
    return F.coalesce(F.timestamp_millis(epoch_ms), F.try_to_timestamp(F.replace(iso, F.lit("GMT"), F.lit("+00:00"))))


def minutes_seconds(ms: Column) -> Column:
    return F.format_string("%dm %ds", F.floor(ms / 60000), F.floor(F.pmod(ms, F.lit(60000)) / 1000))


def gigabytes_text(b: Column) -> Column:
    return F.format_string("%.2f GB", b.cast("double") / F.lit(float(1024**3)))
