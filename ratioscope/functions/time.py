"""Time as whole microseconds since 1970, UTC.  Zone-less stamps are UTC already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_us(ts: Column) -> Column:
    """Microseconds of a timestamp, with or without zone (session zone: UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def epoch_s(ts: Column) -> Column:
    return epoch_us(ts) / F.lit(1e6)


def from_us(us: Column) -> Column:
    """Zone-less timestamp of microseconds."""
    return F.timestamp_micros(us).cast("timestamp_ntz")


def to_utc(ts: Column, zone: str = "UTC") -> Column:
    """Zone-less local time of an IANA zone as zone-less UTC."""
    return ts.cast("timestamp_ntz") if zone == "UTC" else F.to_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")


def with_epoch(df: DataFrame, ts: str, us: str = "us") -> DataFrame:
    return df.withColumn(us, epoch_us(F.col(ts)))


#: strftime codes as Spark datetime patterns.
PATTERNS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "j": "DDD", "y": "yy", "b": "MMM", "B": "MMMM", "p": "a", "I": "hh", "z": "xx", "%": "%"}


def spark_pattern(strftime: str) -> str:
    """Spark's datetime pattern for a strftime one; other letters are quoted."""
    out, i = "", 0
    while i < len(strftime):
        c = strftime[i]
        if c == "%":
            i += 1
            if i >= len(strftime) or strftime[i] not in PATTERNS:
                raise ValueError(f"strftime code in {strftime!r} has no Spark pattern")
            out += PATTERNS[strftime[i]]
        else:
            out += f"'{c}'" if c.isalpha() else c
        i += 1
    return out


def parse_time(text: Column, fmt: str | None, zone: str = "UTC") -> Column:
    """Zone-less UTC time of a text: 'unix' seconds, 'iso8601', a strftime pattern, or None to let Spark guess.  Bad text is null."""
    if fmt == "unix":
        return from_us(F.round(text.try_cast("double") * 1e6).cast("long"))
    if fmt in (None, "iso8601"):
        zoned = text.rlike(r"(Z|[+-]\d\d:?\d\d)\s*$")
        return F.when(zoned, text.try_cast("timestamp").cast("timestamp_ntz")).otherwise(to_utc(text.try_cast("timestamp_ntz"), zone))
    return to_utc(F.try_to_timestamp(text, F.lit(spark_pattern(fmt))).cast("timestamp_ntz"), zone)
