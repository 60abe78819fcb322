"""Column functions over times, rates and levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stamp(ms: Column, comma: bool = False) -> Column:
    """Milliseconds as HH:MM:SS.mmm (or with a comma); below zero counts as zero."""
    t = F.greatest(ms, F.lit(0))
    return F.format_string("%02d:%02d:%02d" + ("," if comma else ".") + "%03d", F.floor(t / 3_600_000), F.floor(t / 60_000) % 60, F.floor(t / 1000) % 60, t % 1000)


def hms(ms: Column) -> Column:
    """Milliseconds as H:MM:SS.ss, or M:SS.ss below an hour."""
    c = F.floor(F.greatest(ms, F.lit(0)) / 10)
    hours = F.floor(c / 360_000)
    return F.when(hours > 0, F.format_string("%d:%02d:%02d.%02d", hours, F.floor(c / 6000) % 60, F.floor(c / 100) % 60, c % 100)).otherwise(F.format_string("%d:%02d.%02d", F.floor(c / 6000), F.floor(c / 100) % 60, c % 100))


def parse_clock(text: Column) -> Column:
    """Seconds of ``1:02:03.4``, ``1:23.4`` or ``83``; null for anything else."""
    part = lambda i: F.coalesce(F.regexp_extract(F.trim(text), r"^(?:(?:(\d+):)?(\d+):)?(\d+(?:\.\d+)?)$", i).try_cast("double"), F.lit(0.0))
    return F.when(F.trim(text).rlike(r"^(\d+:){0,2}\d+(\.\d+)?$"), part(1) * 3600 + part(2) * 60 + part(3))


def frame_rate(text: Column, default: float = 60.0) -> Column:
    """A rational rate such as 30000/1001; the default unless it lies between 1 and 120."""
    rate = F.try_divide(F.get(F.split(text, "/"), F.lit(0)).try_cast("double"), F.coalesce(F.get(F.split(text, "/"), F.lit(1)).try_cast("double"), F.lit(1.0)))
    return F.when(rate.between(1, 120), rate).otherwise(default)


def snap(ms: Column, fps: float) -> Column:
    """The nearest time on the frame grid, in seconds; halves go to the even frame."""
    return F.bround(ms * fps / 1000) / fps


def tempo_chain(factor: Column) -> Column:
    """Equal factors between 0.5 and 2 whose product is ``factor``."""
    steps = F.greatest(F.ceil(F.abs(F.log2(factor)) - 1e-12), F.lit(1)).cast("int")
    return F.array_repeat(F.pow(factor, 1 / steps), steps)


def semitones(hz: Column) -> Column:
    return 12 * F.log2(F.greatest(hz, F.lit(1e-6)) / 100)


def decibels(x: Column) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(1e-9)))


def fill_gain(bed: Column, target: Column, span_ms: Column) -> Column:
    """Gain of a filling bed: 6 dB of freedom for short spans, 1.5 dB from two seconds on."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (span_ms / 1000 - 0.5) / 1.5))
    high = F.pow(F.lit(10.0), (6 - 4.5 * t) / 20)
    return F.when(bed <= 0, 0.0).when(target <= 0, 1.0).otherwise(F.least(F.greatest(target / F.greatest(bed, F.lit(1e-300)), 1 / high), high))


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    """Non-finite and null values count as the lower bound."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.least(F.greatest(F.coalesce(F.nanvl(x, low), low), low), high)


def between_terms(spans: Column, fps: float) -> Column:
    """A selector over sorted spans (a, b in ms): one between() per span, moved a quarter and half a frame early."""
    term = lambda s: F.format_string("between(t,%.5f,%.5f)", s["a"] / 1000 - 0.25 / fps, s["b"] / 1000 - 0.5 / fps)
    return F.array_join(F.transform(spans, term), "+")


def least_duration_ms(words: Column, wpm: int = 260) -> Column:
    return words * 60_000 / wpm


def fingerprint(required: list[Column], optional: list[tuple[Column, str]]) -> Column:
    """A hash of positional inputs; optional ones count only where they differ from their default."""
    extra = [F.when(c.isNotNull() & (c.cast("string") != default), F.concat(F.lit(f"{i}:"), c.cast("string"))) for i, (c, default) in enumerate(optional)]
    return F.sha2(F.to_json(F.array_compact(F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in required], *extra))), 256)
