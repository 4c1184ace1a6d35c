"""Colour histograms and the palettes that follow from them. Pixels shrink to cells in one partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.color import cell, channels, distance, half_up_mean, rgb_key

from framelake.sources.storage import stored

from .palette import OPAQUE, nearest


def histogram(px: DataFrame, bits: int = 4, keys: list[str] = (), threshold: int = OPAQUE, weight: str | None = None) -> DataFrame:
    """Per cell of opaque pixels: n and the sums of r, g, b. weight: a column with how many pixels a row stands for."""
    c = cell(F.col("r"), F.col("g"), F.col("b"), bits)
    n = F.lit(1) if weight is None else F.col(weight)
    return px.filter(F.col("a") >= threshold).groupBy(*keys, c.alias("cell")).agg(F.sum(n).cast("long").alias("n"), *(F.sum(F.col(x) * n).cast("long").alias(f"s{x}") for x in "rgb"))


def temporal_histogram(px: DataFrame, bits: int = 4, keys: list[str] = ()) -> DataFrame:
    """The same sums from pixels pre-counted by position and colour, for clips that hardly move."""
    held = px.groupBy("clip_id", "pos", "r", "g", "b", "a").agg(F.count(F.lit(1)).alias("held"))
    return histogram(held, bits, keys, weight="held")


def means(hist: DataFrame) -> DataFrame:
    """Cells with rounded mean colour: n, rgb."""
    mean = [half_up_mean(F.col(s), F.col("n")) for s in ("sr", "sg", "sb")]
    keep = [c for c in hist.columns if c not in ("sr", "sg", "sb")]
    return hist.select(*keep, rgb_key(*mean).alias("rgb"))


def direct_cells(hist: DataFrame, keys: list[str] = ()) -> DataFrame:
    """One entry per occupied cell, in cell order."""
    return means(hist).select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("cell")) - 1).cast("long").alias("idx"), "cell", "rgb")


def single_merge(hist: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The rarest cell (ties: the highest) and the nearest other cell that takes it."""
    m = means(hist)
    rare = m.groupBy(*keys).agg(F.min(F.struct("n", F.negative("cell").alias("down"), "rgb")).alias("r")).select(*(F.col(k).alias(f"r_{k}") for k in keys), F.negative("r.down").alias("cell"), F.col("r.n").alias("n"), F.col("r.rgb").alias("rgb"))
    others = m.select(*keys, F.col("cell").alias("merged_into"), F.col("rgb").alias("into_rgb"))
    d = distance(channels(F.col("rgb")), channels(F.col("into_rgb")))
    same = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
    pairs = others.join(rare if keys else F.broadcast(rare), [*same, F.col("merged_into") != F.col("cell")])
    best = pairs.groupBy(*keys, "cell", "n").agg(F.min(F.struct(d.alias("dist"), "merged_into")).alias("b"))
    return best.select(*keys, "cell", "n", "b.merged_into", "b.dist")


def seeds(hist: DataFrame, k: int, keys: list[str] = ()) -> DataFrame:
    """The k most frequent cells as palette, by count down and cell up; without keys one top-k, no full sort."""
    order = [F.desc("n"), F.col("cell")]
    m = means(hist) if keys else means(hist).orderBy(*order).limit(k)
    numbered = m.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long").alias("idx"), "cell", "rgb")
    return numbered.filter(F.col("idx") < k)


def assign(hist: DataFrame, palette: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Cells with the index of the nearest entry: cell, n, sums, idx."""
    m = means(hist)
    near = nearest(m.select(*keys, "rgb").distinct(), palette.select(*keys, "idx", "rgb"), keys)
    return hist.join(m.select(*keys, "cell", "rgb"), [*keys, "cell"]).join(near, [*keys, "rgb"]).select(*keys, "cell", "n", "sr", "sg", "sb", "idx", "dist")


def refined(assigned: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Palette of weighted means of the cells assigned to each entry."""
    g = assigned.groupBy(*keys, "idx").agg(*(F.sum(c).alias(c) for c in ("n", "sr", "sg", "sb")))
    return g.select(*keys, "idx", "n", rgb_key(*(half_up_mean(F.col(s), F.col("n")) for s in ("sr", "sg", "sb"))).alias("rgb"))


def dominant(hist: DataFrame, k: int, keys: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Seeds, one step of means, and the final assignment of cells: (palette, cells with idx). The histogram is written once: each step reads it."""
    hist = stored(hist, "histogram")
    palette = stored(refined(assign(hist, seeds(hist, k, keys), keys), keys), "palette")
    return palette, assign(hist, palette, keys)
