"""Column expressions on colours: keys, histogram cells, fixed palette, distances. All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb_key(r: Column, g: Column, b: Column) -> Column:
    return (r * 65536 + g * 256 + b).cast("long")


def channels(key: Column) -> tuple[Column, Column, Column]:
    return F.floor(key / 65536) % 256, F.floor(key / 256) % 256, key % 256


def cell(r: Column, g: Column, b: Column, bits: int) -> Column:
    """Histogram cell: the top bits of each channel."""
    cut, size = 1 << (8 - bits), 1 << bits
    return ((F.floor(r / cut) * size + F.floor(g / cut)) * size + F.floor(b / cut)).cast("long")


def half_up_mean(total: Column, count: Column) -> Column:
    return F.floor((total + F.floor(count / 2)) / count).cast("long")


def rgb332(r: Column, g: Column, b: Column, a: Column, threshold: int, reserve: bool) -> Column:
    """Index into the fixed 3-3-2 palette; with a reserved transparent index 255, opaque white moves to 254."""
    idx = (F.floor(r / 32) * 32 + F.floor(g / 32) * 4 + F.floor(b / 64)).cast("long")
    if not reserve:
        return idx
    return F.when(a < threshold, 255).otherwise(F.least(idx, F.lit(254))).cast("long")


def distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0)).cast("long")


def palette332() -> list[int]:
    """The fixed 3-3-2 palette: every level spread over 0..255."""
    level = lambda v, top: (v * 255 + top // 2) // top
    return [level(i >> 5, 7) << 16 | level(i >> 2 & 7, 7) << 8 | level(i & 3, 3) for i in range(256)]
