"""Build durations from start and end texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT = [
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d'T'H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
]
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?([+-]\d{2}:?\d{2})?)?$"
_OFFSET = r"[T ].*[+-]\d{2}:?\d{2}$"


def _seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def duration_strict(start: Column, end: Column) -> Column:
    """Both ends in the same whole-second format after dropping ``Z``; anything else is 0."""
    s, e = (F.replace(c, F.lit("Z"), F.lit("")) for c in (start, end))
    options = [
        F.when(F.rlike(s, F.lit(shape)) & F.rlike(e, F.lit(shape)),
               _seconds(F.try_to_timestamp(s, F.lit(fmt)), F.try_to_timestamp(e, F.lit(fmt))))
        for shape, fmt in _STRICT
    ]
    return F.coalesce(*options, F.lit(0.0))


def parse_iso(text: Column) -> Column:
    """ISO time with optional fraction and offset; NULL when it is not one."""
    t = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    return F.when(F.rlike(t, F.lit(_ISO)), F.try_to_timestamp(F.replace(t, F.lit(","), F.lit("."))))


def duration_iso(start: Column, end: Column) -> Column:
    """Seconds with fraction; 0 when an end is no ISO time or only one of them has an offset."""
    s, e = (F.replace(c, F.lit("Z"), F.lit("+00:00")) for c in (start, end))
    same_kind = F.rlike(s, F.lit(_OFFSET)) == F.rlike(e, F.lit(_OFFSET))
    return F.coalesce(F.when(same_kind, _seconds(parse_iso(start), parse_iso(end))), F.lit(0.0))


def duration_run(started: Column, created: Column, updated: Column) -> Column:
    """Whole seconds of a run with fallbacks for both ends, never negative."""
    first = F.coalesce(_present(started), _present(created))
    last = F.coalesce(_present(updated), _present(started))
    seconds = F.floor(_seconds(parse_iso(first), parse_iso(last)))
    return F.coalesce(F.greatest(F.lit(0).cast("bigint"), seconds), F.lit(0).cast("bigint"))


def duration_pipeline(duration: Column, created: Column, updated: Column) -> Column:
    """A non-zero reported duration, else whole seconds between the two times."""
    return F.coalesce(F.nullif(duration, F.lit(0.0)),
                      F.floor(_seconds(parse_iso(created), parse_iso(updated))).cast("double"))


def _present(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
