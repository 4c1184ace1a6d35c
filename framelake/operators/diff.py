"""Frame differencing: changed and cleared rectangles by lag, frame plans per clip."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import layout
from framelake.sources.storage import bounded_batches

_BEFORE = ("clip_id", "pos")


def _with_last(canvas: DataFrame) -> DataFrame:
    return canvas.withColumn("last", F.lag("color").over(Window.partitionBy(*_BEFORE).orderBy("frame_no")))


def _box(condition) -> list:
    pick = lambda f, c: f(F.when(condition, F.col(c)))
    return [pick(F.min, "x").alias("x0"), pick(F.min, "y").alias("y0"), pick(F.max, "x").alias("x1"), pick(F.max, "y").alias("y1")]


def changed_rect(canvas: DataFrame) -> DataFrame:
    """Bounding box of pixels that differ from the frame before; null where nothing differs. Frame 0 is left out."""
    p = _with_last(canvas).filter(F.col("frame_no") > 0)
    return p.groupBy("clip_id", "frame_no").agg(*_box(~F.col("color").eqNullSafe(F.col("last"))))


def clears_rect(canvas: DataFrame) -> DataFrame:
    """Bounding box of pixels that were opaque and are transparent (0) now, and whether there are any."""
    clears = (F.coalesce("last", F.lit(0)) > 0) & (F.col("color") == 0)
    return _with_last(canvas).groupBy("clip_id", "frame_no").agg(*_box(clears), F.coalesce(F.bool_or(clears), F.lit(False)).alias("clears"))


def changed_after_clear(canvas: DataFrame, cleared: tuple[int, int, int, int]) -> DataFrame:
    """Changed box when a rectangle (x0, y0, x1, y1, inclusive) was cleared in between: inside it all opaque pixels count."""
    x0, y0, x1, y1 = cleared
    inside = F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    p = _with_last(canvas).filter(F.col("frame_no") > 0)
    return p.groupBy("clip_id", "frame_no").agg(*_box(F.when(inside, F.col("color") > 0).otherwise(~F.col("color").eqNullSafe(F.col("last")))))


def fill_unchanged(canvas: DataFrame) -> DataFrame:
    """Pixels that need no drawing become null (the transparent index); compositing shows the same canvas."""
    return _with_last(canvas).withColumn("idx_color", F.when(~F.col("color").eqNullSafe(F.col("last")), F.col("color"))).drop("last")


def delta_frames(canvas: DataFrame, width: int, height: int) -> DataFrame:
    """Rectangles of a delta-coded clip: frame 0 whole, later ones their change, an unchanged one a single pixel."""
    r = changed_rect(canvas)
    whole = canvas.select("clip_id").distinct().select("clip_id", F.lit(0).cast("long").alias("frame_no"), *(F.lit(v).cast("long").alias(n) for n, v in (("x", 0), ("y", 0), ("w", width), ("h", height))))
    z = lambda c, d: F.coalesce(c, F.lit(d)).cast("long")
    later = r.select("clip_id", "frame_no", z(F.col("x0"), 0).alias("x"), z(F.col("y0"), 0).alias("y"), z(F.col("x1") - F.col("x0") + 1, 1).alias("w"), z(F.col("y1") - F.col("y0") + 1, 1).alias("h"))
    return whole.unionByName(later)


def frame_plan(canvas: DataFrame, width: int, height: int) -> DataFrame:
    """Rectangles and disposal of a compact clip whose pixels (color, 0 is transparent) may be cleared: x, y, w, h, disposal.

    The plan of a frame changes the one before (see ``layout.compact``), so a clip's frames are walked in order, three at a
    time; pixels that canvas lacks are transparent.
    """
    bounded_batches(canvas.sparkSession)
    place = (F.col("pos") * (1 << 32) + F.col("color")).cast("long")
    packed = canvas.groupBy("clip_id", "frame_no").agg(F.collect_set(place).alias("p"))
    schema = pa.schema([(c, pa.int64()) for c in ("clip_id", "frame_no", "x", "y", "w", "h", "disposal")])

    def frame(p: list[int]) -> np.ndarray:
        v, out = np.array(p, np.int64), np.zeros(width * height, np.int64)
        out[v >> 32] = v & 0xFFFFFFFF
        return out.reshape(height, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        for clip, group in itertools.groupby(rows, key=lambda r: r[0]):
            for p in layout.compact(((n, frame(px)) for _, n, px in group), 0):
                left, top, right, bottom = p.box
                yield pa.RecordBatch.from_pylist([{"clip_id": clip, "frame_no": p.number, "x": left, "y": top, "w": right - left + 1, "h": bottom - top + 1, "disposal": p.disposal}], schema=schema)

    ordered = packed.repartition("clip_id").sortWithinPartitions("clip_id", "frame_no")
    return ordered.mapInArrow(run, "clip_id long, frame_no long, x long, y long, w long, h long, disposal long")
