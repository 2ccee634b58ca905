"""Nanosecond time and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000
EAST_OFFSET_HOURS = 4
# Fixed value: the DNS namespace of RFC 4122.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def eastern(ns: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Clock text at the fixed offset UTC-4 (no daylight saving)."""
    secs = (ns - F.pmod(ns, F.lit(NS))) / F.lit(NS)
    shifted = F.timestamp_seconds(secs.cast("long") - F.lit(EAST_OFFSET_HOURS * 3600))
    return F.date_format(shifted, pattern)


def eastern_or_missing(ns: Column) -> Column:
    return F.when(ns.isNull(), "NO TIMESTAMP").otherwise(F.concat(eastern(ns), F.lit(" ET")))


def from_eastern(text: Column) -> Column:
    """UTC-4 clock text to epoch nanoseconds."""
    return (F.unix_timestamp(F.to_timestamp(text)) + F.lit(EAST_OFFSET_HOURS * 3600)) * F.lit(NS)


def decimal_seconds_to_ns(text: Column) -> Column:
    return (text.try_cast("decimal(20,9)") * F.lit(NS)).cast("long")


def uuid5(key: Column, namespace_hex: str = DNS_NAMESPACE) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(key, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )
