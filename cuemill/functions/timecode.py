"""Media time as text, milliseconds and seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CLOCK = r"^\s*(\d+):(\d{2}):(\d{2})[,.](\d{1,3})\s*$"
_LOOSE = r"^\s*(\d+):(\d+):(\d+)[,.](\d+)\s*$"
_SIGNED = r"^\s*([+-]?)(\d+):(\d{2}):(\d{2})[,.](\d{1,6})\s*$"


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).cast("long")


def _fraction_ms(text: Column, pattern: str, group: int) -> Column:
    digits = F.substring(F.regexp_extract(text, pattern, group), 1, 3)
    return F.rpad(digits, 3, "0").cast("long")


def _total(text: Column, pattern: str, first: int = 1) -> Column:
    return (
        _part(text, pattern, first) * 3_600_000
        + _part(text, pattern, first + 1) * 60_000
        + _part(text, pattern, first + 2) * 1_000
        + _fraction_ms(text, pattern, first + 3)
    )


def parse_ms(text: Column) -> Column:
    """`H:MM:SS,f` or `H:MM:SS.f` to milliseconds; null unless minutes and seconds are below 60."""
    good = text.rlike(_CLOCK) & (_part(text, _CLOCK, 2) < 60) & (_part(text, _CLOCK, 3) < 60)
    return F.when(good, _total(text, _CLOCK))


def parse_ms_or_zero(text: Column) -> Column:
    """Lenient reading: any digit counts, the fraction cut to three digits; 0 if unreadable."""
    return F.when(text.rlike(_LOOSE), _total(text, _LOOSE)).otherwise(F.lit(0).cast("long"))


def parse_signed_ms(text: Column) -> Column:
    """Optional sign and one to six fraction digits; null if unreadable."""
    value = _total(text, _SIGNED, 2)
    good = text.rlike(_SIGNED) & (_part(text, _SIGNED, 3) < 60) & (_part(text, _SIGNED, 4) < 60)
    return F.when(good, F.when(F.regexp_extract(text, _SIGNED, 1) == "-", -value).otherwise(value))


def format_ms(ms: Column) -> Column:
    """Milliseconds to `HH:MM:SS,mmm`, negative clamped to zero."""
    ms = F.greatest(ms, F.lit(0).cast("long"))
    hours, rest = F.floor(ms / 3_600_000), ms % 3_600_000
    return F.format_string(
        "%02d:%02d:%02d,%03d", hours, F.floor(rest / 60_000), F.floor(rest % 60_000 / 1_000), rest % 1_000
    )
