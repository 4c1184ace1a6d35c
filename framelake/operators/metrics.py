"""Measurement: error, agreement, ranks, means, frontier, resize, similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.sources.storage import stored


def psnr(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs: keys, r g b a (source), r2 g2 b2 (decoded; null where transparent counts as black). Over source-opaque pixels; equal is null."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    err = sum(((F.col(c) - z(f"{c}2")) * (F.col(c) - z(f"{c}2")) for c in "rgb"), F.lit(0))
    g = pairs.filter(F.col("a") == 255).groupBy(*keys).agg(F.sum(err).alias("squares"), (F.count(F.lit(1)) * 3).alias("n"))
    return g.select(*keys, "squares", "n", F.when(F.col("squares") > 0, F.round(20 * F.log10(255 / F.sqrt(F.col("squares") / F.col("n"))), 6)).alias("psnr_db"))


def alpha_agreement(pairs: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """Share of pixels whose decoded opaqueness (a2 > 0) is what the source's alpha says, in percent."""
    agree = F.avg(F.when((F.col("a") >= threshold) == (F.col("a2") > 0), 1.0).otherwise(0.0)) * 100
    return pairs.groupBy(*keys).agg(F.round(agree, 6).alias("agreement_pct"))


def delays_exact(pairs: DataFrame) -> DataFrame:
    """pairs: clip_id, delay, delay2."""
    return pairs.groupBy("clip_id").agg(F.bool_and(F.col("delay") == F.col("delay2")).alias("exact"))


def percentile_rank(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Nearest rank: sorted[ceil(n q) - 1]."""
    return df.groupBy(*keys).agg(F.expr(f"percentile_disc({q}) within group (order by {value})").cast("double").alias("p"))


def _at(df: DataFrame, keys: list[str], value: str, position) -> DataFrame:
    """The value at a 0-based position of the sorted group, by running counts over distinct values: no group is collected."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    up = F.sum("c").over(Window.partitionBy(*keys).orderBy(value))
    n = F.sum("c").over(Window.partitionBy(*keys))
    at = counts.withColumns({"up": up, "n": n}).withColumn("at", position(F.col("n")))
    return at.filter((F.col("at") < F.col("up")) & (F.col("at") >= F.col("up") - F.col("c"))).select(*keys, F.col(value).cast("double").alias("p"))


def percentile_nearest(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """sorted[round((n - 1) q)], halves up."""
    return _at(df, keys, value, lambda n: F.floor((n - 1) * q + 0.5))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """sorted[floor(n / 2)]."""
    return _at(df, keys, value, lambda n: F.floor(n / 2))


def geometric_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.filter(F.col(value) > 0).groupBy(*keys).agg(F.round(F.exp(F.avg(F.ln(value))), 6).alias("geomean"))


def pareto_frontier(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows that no other row beats: none is at most equal in both and less in one.

    A row stands if its b is below every b at smaller a, and least among its own a. Rows are dealt to ranges of a; a range
    needs only the least b of the ranges before it, so no task sees more than its range even if all rows stand.
    """
    spark = df.sparkSession
    least = df.groupBy(F.col(a).alias("__a")).agg(F.min(b).alias("__b")).filter("__a is not null and __b is not null")
    ranges = stored(least.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "__a").withColumn("__range", F.spark_partition_id()), "ranges")
    low = ranges.groupBy("__range").agg(F.min("__b").alias("low"))
    # as many rows as there are ranges
    below = low.select(F.col("__range").alias("__r"), F.min("low").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__low"))
    inside = F.min("__b").over(Window.partitionBy("__range").orderBy("__a").rowsBetween(Window.unboundedPreceding, -1))
    before = F.least(F.col("__before"), F.col("__low"))
    stands = ranges.withColumn("__before", inside).join(F.broadcast(below), F.col("__range") == F.col("__r")).filter(before.isNull() | (F.col("__b") < before)).select("__a", "__b")
    return df.join(stands, (F.col(a) == F.col("__a")) & (F.col(b) == F.col("__b")), "left_semi")


def ratio_summary(df: DataFrame, fixture: str, implementation: str, value: str, ours: str) -> DataFrame:
    """Per other implementation the ratios of its value to ours over fixtures: least, most, geometric mean."""
    mine = df.filter(F.col(implementation) == ours).select(fixture, F.col(value).alias("__own"))
    r = df.filter(F.col(implementation) != ours).join(mine, fixture).withColumn("ratio", F.col(value) / F.col("__own"))
    g = lambda f: F.round(f, 6)
    return r.groupBy(implementation).agg(g(F.min("ratio")).alias("least"), g(F.max("ratio")).alias("most"), g(F.exp(F.avg(F.ln("ratio")))).alias("geomean"))


def resize_nearest(px: DataFrame, src: tuple[int, int], dst: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour resize: every target coordinate names its source; joined on two small axis tables."""
    spark = px.sparkSession
    axis = lambda n, m, a, b: F.broadcast(spark.range(m).select(F.col("id").alias(a), F.least(F.lit(n - 1), F.floor(F.col("id") * n / m)).cast("long").alias(b)))
    xs, ys = axis(src[0], dst[0], "nx", "x"), axis(src[1], dst[1], "ny", "y")
    out = px.join(xs, "x").join(ys, "y").drop("x", "y")
    return out.withColumnsRenamed({"nx": "x", "ny": "y"})


def equivalent(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of a that b lacks and the other way round, counting repeats."""
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("missing")).join(b.exceptAll(a).agg(F.count(F.lit(1)).alias("surplus")))


def within_tolerance(measured: DataFrame, psnr_loss: float, ssim_loss: float) -> DataFrame:
    """measured: a row per fixture with identical, psnr_before, psnr_after, ssim_before, ssim_after (null psnr: no error at all).

    Adds passes: the pixels are identical, or neither measure fell by more than its tolerance. What can't be measured fails.
    """
    lost = lambda c: F.coalesce(F.col(f"{c}_before"), F.lit(float("inf"))) - F.coalesce(F.col(f"{c}_after"), F.lit(float("inf")))
    fell = F.when(F.col("psnr_after").isNull(), F.lit(0.0)).otherwise(lost("psnr"))
    fine = (fell <= psnr_loss) & (F.col("ssim_before") - F.col("ssim_after") <= ssim_loss)
    return measured.withColumn("passes", F.coalesce(F.col("identical"), F.lit(False)) | F.coalesce(fine, F.lit(False)))


def ssim(pairs: DataFrame, keys: list[str], window: int = 8) -> DataFrame:
    """Mean structural similarity of grey images (v, v2) over all window x window blocks at step 1; keys give one image each."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        w, h = int(rows["x"].max()) + 1, int(rows["y"].max()) + 1
        a, b = np.zeros((h, w)), np.zeros((h, w))
        a[rows["y"], rows["x"]], b[rows["y"], rows["x"]] = rows["v"], rows["v2"]
        k = min(window, w, h)
        va, vb = (np.lib.stride_tricks.sliding_window_view(m, (k, k)).reshape(-1, k * k) for m in (a, b))
        ma, mb = va.mean(1), vb.mean(1)
        sa, sb, sab = va.var(1), vb.var(1), ((va - ma[:, None]) * (vb - mb[:, None])).mean(1)
        s = (2 * ma * mb + c1) * (2 * sab + c2) / ((ma**2 + mb**2 + c1) * (sa + sb + c2))
        return pd.DataFrame([{**{k: rows[k].iloc[0] for k in keys}, "ssim": round(float(s.mean()), 9)}])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema if f.name in keys)
    return pairs.groupBy(*keys).applyInPandas(of, f"{schema}, ssim double")
