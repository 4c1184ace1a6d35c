"""Operators against slow paths and hand-written cases."""

import random

import numpy as np
import pytest
from framelake.operators import composite, container, diff, histogram, order, palette, quantize
from framelake.plans import registry
from framelake.sources import pixels
from framelake.streaming import incremental
from pyspark.sql import functions as F

from conftest import SMALL

RED, GREEN, BLUE = 0xFF0000, 0x00FF00, 0x0000FF
PX = "clip_id long, frame_no long, pos long, x long, y long, rgb long, a long"
FR = "clip_id long, frame_no long, disposal long, fx long, fy long, fw long, fh long"


def canvas_by_hand(px, frames, n):
    """A brute-force canvas: draw, show, dispose."""
    out, canvas = {}, [0] * n
    for f in sorted(frames, key=lambda f: f[1]):
        _, no, disposal, fx, fy, fw, fh = f
        before = canvas[:]
        inside = lambda x, y: fx <= x < fx + fw and fy <= y < fy + fh  # noqa: B023, E731
        for _, _, pos, x, y, rgb, a in (p for p in px if p[1] == no):
            if inside(x, y) and a >= 128:
                canvas[pos] = rgb + 2**24
        for pos in range(n):
            out[no, pos] = canvas[pos]
        if disposal == 3:
            canvas = before
        elif disposal == 2:
            for _, _, pos, x, y, _, _ in (p for p in px if p[1] == no):
                if inside(x, y):
                    canvas[pos] = 0
    return out


def test_composite_equals_a_canvas(spark):
    rnd = random.Random(5)
    for _ in range(4):
        w, h, n = 3, 3, 6
        frames = [(1, k, rnd.choice([0, 1, 2, 3, 4, 7]), rnd.randrange(2), rnd.randrange(2), rnd.randrange(1, 3), rnd.randrange(1, 3)) for k in range(n)]
        px = [(1, k, y * w + x, x, y, rnd.choice([RED, GREEN, BLUE]), rnd.choice([0, 255])) for k in range(n) for y in range(h) for x in range(w)]
        got = composite.composite(spark.createDataFrame(px, PX), spark.createDataFrame(frames, FR)).collect()
        assert {(r["frame_no"], r["pos"]): r["color"] for r in got} == canvas_by_hand(px, frames, w * h)


def test_histogram_variants_agree(spark):
    px = pixels.placed(pixels.table(spark, SMALL, "events"))
    assert sorted(histogram.histogram(px).collect()) == sorted(histogram.temporal_histogram(px).collect())


@pytest.mark.parametrize("make, bits", [(quantize.median_cut, 5), (quantize.median_cut_nearest, 5), (quantize.variance_cut, 4), (quantize.flat_grid, 4)])
def test_palettes_beat_the_fixed_one(spark, make, bits):
    """256 adaptive colours have a smaller error than the fixed 3-3-2 palette's 256."""
    px = registry._bag(spark, SMALL).withColumn("clip_id", F.lit(1).cast("long"))
    hist = histogram.histogram(px, bits, ["clip_id"])
    m = make(hist, 256).toPandas().merge(hist.toPandas(), on=["clip_id", "cell"])
    assert len(m) == hist.count() and m["rgb"].nunique() <= 256
    mean = np.stack([m[c] / m["n"] for c in ("sr", "sg", "sb")], 1)
    split = lambda v: np.stack([v // 65536, v // 256 % 256, v % 256], 1)
    error = lambda colors: (((mean - colors) ** 2).sum(1) * m["n"]).sum()
    r, g, b = mean.T.astype(int)
    fixed = np.stack([((r >> 5) * 255 + 3) // 7, ((g >> 5) * 255 + 3) // 7, ((b >> 6) * 255 + 1) // 3], 1)
    assert error(split(m["rgb"].to_numpy())) < error(fixed)


def test_colours_that_fit_stay_exact():
    cells = np.array([3, 700, 4000])
    n, sums = np.array([5, 1, 2]), np.array([[5, 10, 15], [200, 90, 70], [40, 60, 80]])
    boxes = quantize.median_cut_boxes(cells, n, sums, 8, 5, last_wins=False)
    assert sorted(map(tuple, boxes)) == [(0,), (1,), (2,)]


def test_modes_and_slots(spark):
    rows = [(k % 256, k // 256, 0, 255) for k in range(300)]
    px = spark.createDataFrame(rows, "r long, g long, b long, a long")
    assert palette.choose_mode(px, "fast") == "rgb332" and palette.choose_mode(px, "quality") == "quantized" and palette.choose_mode(px.limit(9)) == "exact"
    with pytest.raises(ValueError):
        palette.choose_mode(px, "exact")
    with pytest.raises(ValueError):
        palette.choose_mode(px, "other")
    full = spark.range(256).select(F.col("id").alias("idx"))
    with pytest.raises(Exception, match="free"):
        palette.transparent_slot(full, full).collect()


def test_plans_composite_like_the_frames(spark):
    """Drawing the planned rectangles and disposing as planned shows the same canvas."""
    px = pixels.placed(pixels.table(spark, SMALL, "events")).filter("y < 1")
    canvas = composite.composite(px, pixels.frame_table(px))
    plan = diff.frame_plan(canvas, 16, 1)
    shown = canvas.withColumns({"rgb": F.col("color") - 16777216, "a": F.when(F.col("color") > 0, 255).otherwise(0)})
    frames = plan.select("clip_id", "frame_no", "disposal", F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("w").alias("fw"), F.col("h").alias("fh"))
    again = composite.composite(shown.select("clip_id", "frame_no", "pos", "x", "y", "rgb", "a"), frames)
    assert again.exceptAll(canvas.select(again.columns)).count() == 0


def test_files_and_orders(spark, tmp_path):
    clips, height = registry._clips(spark, SMALL)
    container.write_gifs(clips, str(tmp_path))
    back = container.read_gifs(spark, f"{tmp_path}/*.gif").select(F.regexp_extract("path", r"(\d+)\.gif", 1).cast("long").alias("clip_id"), "content")
    assert container.frames(back).count() == 32
    bad = spark.createDataFrame([(1, b"GIF89a")], "clip_id long, content binary")
    assert bad.select(container.scan("content", on_error="null").alias("c")).first()["c"] is None
    with pytest.raises(Exception, match="truncated"):
        bad.select(container.scan("content")).collect()
    with pytest.raises(ValueError):
        container.scan("content", "loose")
    f = spark.createDataFrame([(1, 0), (1, 1)], "clip_id long, frame_no long")
    assert [r["frame_no"] for r in order.reorder(f, [1, 1, 0]).orderBy("position").collect()] == [1, 1, 0]


def test_rgba_ingest(spark):
    two = spark.createDataFrame([(1, bytes(range(16)))], "clip_id long, rgba binary")
    rows = pixels.unpack_rgba(two, 2, 1).orderBy("frame_no", "pos").collect()
    assert [(r["frame_no"], r["pos"], r["r"], r["a"]) for r in rows] == [(0, 0, 0, 3), (0, 1, 4, 7), (1, 0, 8, 11), (1, 1, 12, 15)]
    with pytest.raises(Exception, match="whole number"):
        pixels.unpack_rgba(two, 3, 1).collect()


def test_stream_equals_batch(spark, tmp_path):
    events = pixels.table(spark, SMALL, "events")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = incremental.running_histogram(stream).writeStream.format("memory").queryName("hist").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("hist").collect()) == sorted(histogram.histogram(pixels.placed(events), 4, ["clip_id"]).collect())
