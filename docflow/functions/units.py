"""Units and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWIPS_PER_PT, EMU_PER_PT, PT_PER_INCH, CSS_DPI = 20.0, 12700.0, 72.0, 96.0
#: Most pixels and longest side of a canvas.
CANVAS_AREA, CANVAS_SIDE = 16_777_216, 4096


def half_up(x: Column) -> Column:
    """Nearest whole number, halves upwards also below zero."""
    return F.floor(x + 0.5)


def twips(x: Column) -> Column:
    return x / TWIPS_PER_PT


def emu(x: Column) -> Column:
    return x / EMU_PER_PT


def snapped(x: Column, ratio: float) -> Column:
    """x rounded to whole device pixels."""
    return half_up(x * ratio) / ratio


def effective_ratio(width: Column, height: Column, ratio: Column) -> Column:
    """The device ratio that keeps a canvas within its area and side."""
    by_area = F.sqrt(F.lit(float(CANVAS_AREA)) / (width * height))
    by_side = F.lit(float(CANVAS_SIDE)) / F.greatest(width, height)
    return F.when((width > 0) & (height > 0), F.least(ratio, by_area, by_side)).otherwise(ratio)


def rotation(document: Column, user: Column) -> Column:
    """The combined turn in degrees; what is no quarter turn counts as 0."""
    total = F.pmod(document + user, F.lit(360))
    return F.when(total.isin(0, 90, 180, 270), total).otherwise(0)


def turned_size(width: Column, height: Column, turn: Column) -> tuple[Column, Column]:
    side = turn.isin(90, 270)
    return F.when(side, height).otherwise(width), F.when(side, width).otherwise(height)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high) if not isinstance(high, Column) else high), F.lit(low) if not isinstance(low, Column) else low)
