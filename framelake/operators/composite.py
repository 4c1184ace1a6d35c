"""Playback: compositing under disposal rules as one window, de-interlacing, de-duplication, deltas, budgets.

Every operator partitions by clip and pixel position, or by clip and frame, so clips, positions and frames all spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.gif import PASSES

from .palette import OPAQUE


def in_rect() -> Column:
    return (F.col("x") >= F.col("fx")) & (F.col("x") < F.col("fx") + F.col("fw")) & (F.col("y") >= F.col("fy")) & (F.col("y") < F.col("fy") + F.col("fh"))


def shown(px: DataFrame, frames: DataFrame, threshold: int = OPAQUE) -> DataFrame:
    """What each frame draws (own) and leaves behind (keep). Opaque colours count from 2**24, so 0 is a cleared pixel."""
    p = px.join(frames, ["clip_id", "frame_no"])
    own = F.when(in_rect() & (F.col("a") >= threshold), F.col("rgb") + 16777216)
    keep = F.when(F.col("disposal") == 3, F.lit(None)).when((F.col("disposal") == 2) & in_rect(), F.lit(0)).otherwise(own)
    return p.withColumns({"own": own, "keep": keep})


def composite(px: DataFrame, frames: DataFrame) -> DataFrame:
    """The canvas at every frame: own pixels over the last ones that survived. Needs a row per clip, frame and position."""
    before = Window.partitionBy("clip_id", "pos").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    under = F.last("keep", ignorenulls=True).over(before)
    return shown(px, frames).select("clip_id", "frame_no", "pos", "x", "y", F.coalesce("own", under, F.lit(0)).cast("long").alias("color"))


def requested(px: DataFrame, frames: DataFrame, wanted: list[int]) -> DataFrame:
    """Composited frames in ascending order: frames after the last wanted one are never read, earlier ones still count."""
    last = max(wanted)
    return composite(px.filter(F.col("frame_no") <= last), frames).filter(F.col("frame_no").isin(sorted(set(wanted))))


def deinterlaced(px: DataFrame, height: Column | int) -> DataFrame:
    """Rows in stored order y become rows in picture order, by the closed form of the four passes."""
    h = F.lit(height) if isinstance(height, int) else height
    count = [F.floor((h - start + step - 1) / step) for start, step in PASSES]
    y, out, begin = F.col("y"), None, F.lit(0)
    for (start, step), n in zip(PASSES, count, strict=True):
        here = (y >= begin) & (y < begin + n)
        row = (y - begin) * step + start
        out = F.when(here, row) if out is None else out.when(here, row)
        begin = begin + n
    return px.withColumn("y", out.cast("long"))


def digests(canvas: DataFrame) -> DataFrame:
    """One digest per composited frame: sums of position-bound hashes need no ordered collection of pixels, and a repeated row counts."""
    low = lambda seed: F.sum(F.xxhash64(F.lit(seed), "pos", "color").bitwiseAND(F.lit(0xFFFFFFFF)))
    return canvas.groupBy("clip_id", "frame_no").agg(low(1).alias("d1"), low(2).alias("d2"), F.count(F.lit(1)).alias("pixels"))


def dedupe(canvas: DataFrame, mode: str = "adjacent") -> DataFrame:
    """Per frame the earliest frame whose pixels it can share: the one before if equal (adjacent), or any earlier (all).

    Digests only suggest; a frame shares after a comparison of its pixels with the suggested frame's.
    """
    d = digests(canvas)
    w = Window.partitionBy("clip_id").orderBy("frame_no")
    if mode == "all":
        like = d.withColumn("like", F.min("frame_no").over(Window.partitionBy("clip_id", "d1", "d2", "pixels")))
    else:
        same = (F.lag("d1").over(w) == F.col("d1")) & (F.lag("d2").over(w) == F.col("d2")) & (F.lag("pixels").over(w) == F.col("pixels"))
        like = d.withColumn("like", F.when(F.coalesce(same, F.lit(False)), F.lag("frame_no").over(w)).otherwise(F.col("frame_no")))
    pairs = like.filter(F.col("like") < F.col("frame_no")).select("clip_id", "frame_no", "like", "pixels")
    mine = canvas.join(pairs, ["clip_id", "frame_no"]).select("clip_id", "frame_no", "like", "pixels", "pos", "color")
    theirs = canvas.select("clip_id", F.col("frame_no").alias("like"), "pos", "color").distinct()
    equal = mine.join(theirs, ["clip_id", "like", "pos", "color"]).groupBy("clip_id", "frame_no").agg((F.count(F.lit(1)) == F.max("pixels")).alias("equal"))
    held = like.join(equal, ["clip_id", "frame_no"], "left").withColumn("equal", F.coalesce("equal", F.lit(False)))
    if mode == "all":
        return held.select("clip_id", "frame_no", F.when(F.col("equal"), F.col("like")).otherwise(F.col("frame_no")).alias("shares"))
    marked = held.withColumn("start", F.when(~F.col("equal"), F.col("frame_no")))
    return marked.select("clip_id", "frame_no", F.last("start", ignorenulls=True).over(w).alias("shares"))


def deltas(canvas: DataFrame) -> DataFrame:
    """Changed rectangle and number of changed pixels against the frame before; frame 0 changes everywhere."""
    before = F.lag("color").over(Window.partitionBy("clip_id", "pos").orderBy("frame_no"))
    p = canvas.withColumn("changed", ~F.col("color").eqNullSafe(before))
    pick = lambda f, c: f(F.when(F.col("changed"), F.col(c)))
    r = p.groupBy("clip_id", "frame_no").agg(pick(F.min, "x").alias("x0"), pick(F.min, "y").alias("y0"), pick(F.max, "x").alias("x1"), pick(F.max, "y").alias("y1"), F.count_if("changed").alias("changed"))
    return r.select("clip_id", "frame_no", "x0", "y0", (F.col("x1") - F.col("x0") + 1).alias("w"), (F.col("y1") - F.col("y0") + 1).alias("h"), "changed")


def byte_budget(canvas: DataFrame, limit: int, strict: bool = False) -> DataFrame:
    """Running bytes of stored frames (shared ones are free); beyond the limit an error or, not strict, a flag."""
    size = canvas.groupBy("clip_id", "frame_no").agg((F.count(F.lit(1)) * 4).alias("bytes"))
    own = dedupe(canvas).join(size, ["clip_id", "frame_no"]).withColumn("bytes", F.when(F.col("shares") == F.col("frame_no"), F.col("bytes")).otherwise(0))
    total = F.sum("bytes").over(Window.partitionBy("clip_id").orderBy("frame_no"))
    out = own.select("clip_id", "frame_no", "bytes", total.alias("total")).withColumn("over", F.col("total") > limit)
    if strict:
        out = out.withColumn("over", F.when(F.col("over"), F.raise_error(F.lit("prepared frames exceed the byte budget")).cast("boolean")).otherwise(False))
    return out


def opaque_spans(px: DataFrame, threshold: int = OPAQUE) -> DataFrame:
    """Runs of opaque pixels per row (gaps and islands), summed per frame, and the form that stores them: spans or positions."""
    row = Window.partitionBy("clip_id", "frame_no", "y").orderBy("x")
    seen = px.filter(F.col("a") >= threshold)
    spans = seen.withColumn("island", F.col("x") - F.row_number().over(row)).groupBy("clip_id", "frame_no", "y", "island").agg(F.count(F.lit(1)).alias("n"))
    f = spans.groupBy("clip_id", "frame_no").agg(F.count(F.lit(1)).alias("spans"), F.sum("n").alias("pixels"))
    return f.withColumn("form", F.when(F.col("pixels") >= 4 * F.col("spans"), "spans").otherwise("positions"))
