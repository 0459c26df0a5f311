"""Timeframes: parsing, formatting, multiples, the finest of a set; lead-in and bars needed before a start."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds per unit; fixed values.
UNITS = {"w": 604800, "d": 86400, "h": 3600, "m": 60}


def seconds(text: Column) -> Column:
    """``15m`` -> 900: digits and one of m, h, d, w, any case, trimmed; other text raises."""
    t = F.lower(F.trim(text))
    unit = F.regexp_extract(t, r"^(\d+)([mhdw])$", 2)
    scale = F.coalesce(*[F.when(unit == u, F.lit(s)) for u, s in UNITS.items()])
    value = F.regexp_extract(t, r"^(\d+)([mhdw])$", 1).cast("long") * scale
    return F.when(text.isNull(), F.lit(None).cast("long")).when(scale.isNull(), F.raise_error(F.concat(F.lit("not a timeframe: "), text)).cast("long")).otherwise(value)


def label(secs: Column) -> Column:
    """The largest unit that divides, else ``Ns``."""
    out = F.concat(secs.cast("string"), F.lit("s"))
    for u, s in reversed(UNITS.items()):
        out = F.when(secs % s == 0, F.concat((secs / s).cast("long").cast("string"), F.lit(u))).otherwise(out)
    return out


def is_multiple(secs: Column, base: Column) -> Column:
    return secs % base == 0


def finest(timeframes: Iterable[int]) -> int:
    """The base timeframe of a set; an empty set is an error, as is one that is no multiple of the base."""
    tfs = sorted(set(timeframes))
    if not tfs:
        raise ValueError("no timeframe")
    if bad := [t for t in tfs if t % tfs[0]]:
        raise ValueError(f"not multiples of {tfs[0]} s: {bad}")
    return tfs[0]


def lead_in_seconds(max_lookback: Column, tf: Column, base: Column, open_sec: Column, close_sec: Column) -> Column:
    """Seconds before a start from which bars are read: 1.5 times the span of the bars needed, and weekends and nights for sessions."""
    needed = F.floor(max_lookback * F.floor(tf / base) * 1.2) + 5
    share = F.greatest((close_sec - open_sec) / F.lit(86400.0), F.lit(0.05))
    span = F.when(close_sec.isNull(), (needed * base).cast("double")).otherwise(needed * base / share * 7 / 5)
    return span * 1.5
