"""Frame orders and the verdict on them, as relations over the frame table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reversed_order(frames: DataFrame) -> DataFrame:
    """clip_id, position, frame_no: last frame first."""
    n = F.max("frame_no").over(Window.partitionBy("clip_id"))
    return frames.select("clip_id", (n - F.col("frame_no")).alias("position"), "frame_no")


def boomerang_order(frames: DataFrame) -> DataFrame:
    """Forward then backward, both ends twice."""
    n = F.max("frame_no").over(Window.partitionBy("clip_id"))
    f = frames.withColumn("n", n)
    return f.select("clip_id", F.col("frame_no").alias("position"), "frame_no").union(f.select("clip_id", 2 * F.col("n") + 1 - F.col("frame_no"), "frame_no"))


def reorder(frames: DataFrame, order: list[int]) -> DataFrame:
    """An arbitrary order with repeats: clip_id, position, frame_no."""
    wanted = frames.sparkSession.createDataFrame(list(enumerate(order)), "position long, frame_no long")
    return frames.join(F.broadcast(wanted), "frame_no").select("clip_id", "position", "frame_no")


def reorder_verdict(frames: DataFrame, width: int, height: int) -> DataFrame:
    """Whether a clip's frames may be put in another order: whole canvases and known disposals, and all frames opaque or all restoring."""
    covers = F.bool_and((F.col("fx") == 0) & (F.col("fy") == 0) & (F.col("fw") == width) & (F.col("fh") == height))
    known = F.bool_and(F.col("disposal") <= 3)
    opaque, restores = F.bool_and(F.col("transparent").isNull()), F.bool_and(F.col("disposal").isin(2, 3))
    return frames.groupBy("clip_id").agg(covers.alias("covers"), known.alias("known"), opaque.alias("opaque"), restores.alias("restores"), (covers & known & (opaque | restores)).alias("allowed"))
