"""Exact and fixed palettes, nearest colours, transparent slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.color import channels, distance, rgb_key

OPAQUE = 128


def exact_palette(px: DataFrame, keys: list[str], threshold: int = OPAQUE, order: str = "at") -> DataFrame:
    """Distinct opaque colours numbered by first appearance. px: keys, rgb, a and an order column; one row per colour."""
    first = px.filter(F.col("a") >= threshold).groupBy(*keys, "rgb").agg(F.min(order).alias("first_at"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("first_at"))
    return first.select(*keys, (number - 1).cast("long").alias("idx"), "rgb")


def exact_overflow(px: DataFrame, keys: list[str], threshold: int = OPAQUE) -> DataFrame:
    """Per group: colours, whether a transparent slot is needed, and whether both fit 256 entries."""
    c = px.groupBy(*keys).agg(F.count_distinct(F.when(F.col("a") >= threshold, F.col("rgb"))).alias("n_colors"), F.max(F.when(F.col("a") < threshold, 1).otherwise(0)).cast("long").alias("needs_slot"))
    return c.withColumn("overflows", F.col("n_colors") + F.col("needs_slot") > 256)


def nearest(colors: DataFrame, palette: DataFrame, keys: list[str] = ()) -> DataFrame:
    """For distinct colours (keys, rgb) the palette entry (keys, idx, rgb) at the least squared distance, ties to the lowest index.

    A palette has 256 entries at most, and colours are distinct before they meet it, so the join is bounded by the
    number of colours; the smallest distance and index are packed into one number and found by partial aggregation.
    """
    p = palette.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("idx").alias("__idx"), F.col("rgb").alias("__rgb"))
    p = p if keys else F.broadcast(p)  # one palette is small; palettes of many clips are joined by key
    on = [F.col(k) == F.col(f"__{k}") for k in keys] or F.lit(True)
    d = distance(channels(F.col("rgb")), channels(F.col("__rgb"))) * 256 + F.col("__idx")
    return colors.join(p, on).groupBy(*keys, "rgb").agg((F.min(d) % 256).alias("idx"), F.floor(F.min(d) / 256).alias("dist"))


def map_to_palette(px: DataFrame, palette: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Opaque pixels get the first equal entry's index, else the nearest one's: pixels are reduced to distinct colours before they are matched."""
    mapped = nearest(px.filter(F.col("a") >= OPAQUE).select(*keys, "rgb").distinct(), palette.select(*keys, "idx", "rgb"), keys)
    keyed = px.withColumn("__key", F.when(F.col("a") >= OPAQUE, F.col("rgb")))
    return keyed.join(mapped.select(*keys, F.col("rgb").alias("__key"), "idx"), [*keys, "__key"], "left").drop("__key")


def opaque(px: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: pixels, whether all are fully opaque, and whether any is partly transparent."""
    return px.groupBy(*keys).agg(F.count(F.lit(1)).alias("pixels"), (F.min("a") == 255).alias("opaque"), F.bool_or(~F.col("a").isin(0, 255)).alias("partial"))


def transparent_slot(palette: DataFrame, used: DataFrame) -> DataFrame:
    """The transparent index: appended while there is room, else the lowest unused entry, else an error."""
    n = palette.agg(F.count(F.lit(1)).alias("n"))
    free = palette.sparkSession.range(256).select(F.col("id").alias("idx")).join(used.select("idx").distinct(), "idx", "left_anti").agg(F.min("idx").alias("free"))
    slot = F.when(F.col("n") < 256, F.col("n")).otherwise(F.coalesce("free", F.raise_error(F.lit("no palette entry is free")).cast("long")))
    return n.join(F.broadcast(free)).select("n", slot.alias("slot"))


def require_exact(px: DataFrame, threshold_free: bool = True) -> DataFrame:
    """px as it is; alpha other than 0 and 255 is an error when it is read."""
    if not threshold_free:
        return px
    return px.withColumn("a", F.when(F.col("a").isin(0, 255), F.col("a")).otherwise(F.raise_error(F.lit("exact mode needs alpha 0 or 255")).cast("long")))


def choose_mode(px: DataFrame, mode: str = "exact") -> str:
    """exact, or what a mode falls back to when there are too many colours: fast -> rgb332, quality -> quantized."""
    if mode not in ("exact", "fast", "quality"):
        raise ValueError("mode is exact, fast or quality")
    r = exact_overflow(px.withColumn("rgb", rgb_key(F.col("r"), F.col("g"), F.col("b"))), []).first()
    if r is None or not r["overflows"]:
        return "exact"
    if mode == "exact":
        raise ValueError("more than 256 colours")
    return {"fast": "rgb332", "quality": "quantized"}[mode]
