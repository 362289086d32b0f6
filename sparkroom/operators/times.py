"""Capture times: shifts, zones, and dates as FITS headers write them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = r"^([+-]?)(?:(\d+)\s+)?(\d+)(?::(\d+))?(?::(\d+))?$"


def shift_seconds(text: Column) -> Column:
    """Signed seconds of [+|-][D ]HH[:MM[:SS]], parts of any size; 0 for an empty
    text, null for anything else."""
    t = F.trim(text)
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(t, _SHIFT, i), F.lit("")).try_cast("long"), F.lit(0).cast("long"))
    total = part(2) * 86400 + part(3) * 3600 + part(4) * 60 + part(5)
    signed = F.when(F.startswith(t, F.lit("-")), -total).otherwise(total)
    return F.when(t == "", F.lit(0).cast("long")).when(F.rlike(t, F.lit(_SHIFT)), signed)


def shift(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def zone_minutes(offset: Column) -> Column:
    """Minutes of an offset such as +05:30; a time itself is not moved by it."""
    m = r"^([+-])(\d{2}):(\d{2})$"
    n = F.regexp_extract(offset, m, 2).try_cast("int") * 60 + F.regexp_extract(offset, m, 3).try_cast("int")
    return F.when(F.rlike(offset, F.lit(m)), F.when(F.startswith(offset, F.lit("-")), -n).otherwise(n))


def fits_datetime(text: Column) -> Column:
    """The first form that fits: with parts of a second, without, or a day."""
    forms = (
        (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+$", "yyyy-MM-dd'T'HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
        (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
        (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    )
    t = F.trim(text)
    out = [F.when(F.rlike(t, F.lit(like)), F.try_to_timestamp(t, F.lit(form)).cast("timestamp_ntz")) for like, form in forms]
    return F.coalesce(*out)


def apply_ops(ts: Column, zone: Column, ops: Sequence[dict]) -> tuple[Column, Column]:
    """Time and zone after a list of operations: shifts add up, the last zone wins.
    A shift is given in ``seconds``, or as text in ``value`` or ``offset``, where
    text that is no shift adds nothing; a zone in ``timezone`` or ``value``."""

    def seconds_of(o: dict) -> Column:
        if "seconds" in o:
            return F.lit(o["seconds"]).cast("long")
        return F.coalesce(shift_seconds(F.lit(o.get("offset") or o.get("value") or "")), F.lit(0).cast("long"))

    seconds = [seconds_of(o) for o in ops if o["type"] == "shift-time"]
    zones = [z for o in ops if o["type"] == "shift-timezone" and (z := (o.get("timezone") or o.get("value") or "").strip())]
    moved = shift(ts, reduce(lambda a, b: a + b, seconds)) if seconds else ts
    return moved, F.lit(zones[-1]) if zones else zone
