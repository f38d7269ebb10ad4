"""Scalar column functions (P3-P18). All are built-in expressions: no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wearcast import schema as S


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column) -> Column:
    """Division that gives NULL on a zero divisor instead of failing under ANSI mode."""
    return F.try_divide(col(num), col(den))


def power_efficiency(power: str | Column = "power_consumption", torque: str | Column = "torque") -> Column:
    """Power / (torque + 1)."""
    return safe_div(col(power), col(torque) + F.lit(1.0))


def temp_vib_interaction(temp: str | Column = "temperature", vib: str | Column = "vibration") -> Column:
    """Temperature * vibration."""
    return col(temp) * col(vib)


def status_label(flag: str | Column, positive: str = "Failure", negative: str = "Normal") -> Column:
    """P5: 1 -> positive label, anything else -> negative label."""
    return F.when(col(flag) == 1, F.lit(positive)).otherwise(F.lit(negative))


def live_status_label(flag: str | Column) -> Column:
    return status_label(flag, "FAILURE", "NORMAL")


def risk_level(p: str | Column, edges=None, labels=None) -> Column:
    """Left-open bins (e0, e1] -> l0, (e1, e2] -> l1, ...; outside (including e0 itself) -> NULL."""
    edges = edges or S.RISK_EDGES
    labels = labels or S.RISK_LABELS
    p = col(p)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (p > F.lit(lo)) & (p <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def above(p: str | Column, threshold: float = S.HIGH_RISK_THRESHOLD) -> Column:
    """Strict ``p > threshold``."""
    return col(p) > F.lit(threshold)


def is_alert(prediction: str | Column) -> Column:
    """prediction == 1."""
    return col(prediction) == 1


def clamp(x: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL (greatest/least alone would skip it)."""
    x = col(x)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(out)


def percent_text(p: str | Column, digits: int = 1) -> Column:
    """``f"{p:.1%}"``. The number is rounded half-even first so ties format like Python."""
    return F.format_string(f"%.{digits}f%%", F.bround(col(p) * 100.0, digits))


def round_to(x: str | Column, digits: int = 2) -> Column:
    """``round(x * 10^d) / 10^d`` - the same arithmetic as SQL engines that round the scaled double."""
    scale = float(10 ** digits)
    return F.round(col(x) * F.lit(scale)) / F.lit(scale)


def elapsed_seconds(t: str | Column, start: str | Column) -> Column:
    """Seconds from ``start`` to ``t``."""
    return (F.unix_micros(col(t).cast("timestamp")) - F.unix_micros(col(start).cast("timestamp"))) / F.lit(1e6)


def iso_time(t: str | Column) -> Column:
    """ISO-8601 text like ``datetime.isoformat``: microseconds, omitted when they are zero."""
    whole = F.unix_micros(col(t).cast("timestamp")) % 1000000 == 0
    return F.when(whole, F.date_format(col(t), "yyyy-MM-dd'T'HH:mm:ss")) \
            .otherwise(F.date_format(col(t), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def clock_time(t: str | Column) -> Column:
    """``%H:%M:%S``."""
    return F.date_format(col(t), "HH:mm:ss")
