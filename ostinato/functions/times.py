"""Times of recordings: milliseconds and their texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two(c: Column) -> Column:
    s = c.cast("string")
    return F.when(F.length(s) < 2, F.lpad(s, 2, "0")).otherwise(s)


def whole(c: Column) -> Column:
    """Rounded to seconds, halves to even."""
    return (F.bround(c / 1000.0, 0) * 1000).cast("long")


def minutes(ms: Column) -> Column:
    """MM:SS; minutes may pass 59."""
    s = F.floor(ms / 1000)
    return F.concat(_two(F.floor(s / 60)), F.lit(":"), _two(s % 60))


def clock(ms: Column) -> Column:
    """MM:SS, or HH:MM:SS from one hour on."""
    s = F.floor(ms / 1000)
    tail = F.concat(_two(F.floor(s / 60) % 60), F.lit(":"), _two(s % 60))
    return F.when(s >= 3600, F.concat(_two(F.floor(s / 3600)), F.lit(":"), tail)).otherwise(tail)


def cue_time(ms: Column) -> Column:
    """MM:SS:FF with 75 frames a second, cut, in double arithmetic."""
    s = ms / 1000.0
    frame = F.floor((s - F.floor(s)) * 75)
    return F.concat(_two(F.floor(s / 60)), F.lit(":"), _two(F.floor(s) % 60), F.lit(":"), _two(frame))


def from_minutes(text: Column) -> Column:
    """Milliseconds of MM:SS, null if it isn't one."""
    good = F.trim(text).rlike(r"^\d{1,3}:[0-5]\d$")
    part = lambda i: F.regexp_extract(F.trim(text), r"^(\d{1,3}):([0-5]\d)$", i).try_cast("long")
    return F.when(good, (part(1) * 60 + part(2)) * 1000)


def from_cue_time(text: Column) -> Column:
    """Milliseconds of MM:SS:FF, 0 if it hasn't three parts."""
    p = F.split(text, ":")
    n = lambda i: F.try_element_at(p, F.lit(i)).try_cast("double")
    return F.when(F.size(p) == 3, F.coalesce(((n(1) * 60 + n(2) + n(3) / F.lit(75.0)) * 1000).cast("long"), F.lit(0))).otherwise(F.lit(0).cast("long"))


def fade(t: Column, start: float, length: float, fade_in: float, fade_out: float) -> Column:
    """Opacity 0 to 1 of something shown from start for length seconds."""
    x = t - start
    return F.when((x < 0) | (x > length), 0.0).when(x < fade_in, x / fade_in).when(x > length - fade_out, (length - x) / fade_out).otherwise(1.0)


def seek(position: Column, step: float, presses: Column, duration: Column, forward: bool = True) -> Column:
    """Where repeated presses lead: the step times as many, five at most, within the recording."""
    moved = F.least(presses, F.lit(5)) * step
    return F.greatest(F.lit(0.0), F.least(duration, position + (moved if forward else -moved)))


def loop_window(start: Column, length: Column, shift: Column, duration: Column) -> Column:
    """struct(start, end) of a loop that is shifted and kept within the recording at its length."""
    begin = F.greatest(F.lit(0.0), F.least(start + shift, duration - length))
    return F.struct(begin.alias("start"), F.least(begin + length, duration).alias("end"))
