"""RGBA frames to files and back: layout, palettes by strategy, playback, ingest and options."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from framelake.functions import gif, layout
from framelake.operators import composite, container, encode, metrics, playback
from framelake.sources import pixels as S
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException
from pyspark.sql import functions as F

BLACK, RED, GREEN, BLUE = 0x000000, 0xFF0000, 0x00FF00, 0x0000FF
PALETTE = [BLACK, RED, GREEN, BLUE]


def color(canvas):
    return [None if p[3] == 0 else int(p[0]) << 16 | int(p[1]) << 8 | int(p[2]) for p in canvas.reshape(-1, 4)]


def shown(data):
    return [color(c) for _, _, c in playback.canvases(data)]


RESTORE_BACKGROUND = gif.write(2, 2, PALETTE, [
    {"indices": bytes([1, 1, 1, 1]), "disposal": 0}, {"indices": bytes([2, 0, 2, 0]), "transparent": 0, "disposal": 2},
    {"indices": bytes([3, 3]), "x": 1, "width": 1, "height": 2}])
RESTORE_PREVIOUS = gif.write(2, 2, PALETTE, [
    {"indices": bytes([1, 1, 1, 1]), "disposal": 1}, {"indices": bytes([2, 2]), "width": 1, "height": 2, "disposal": 3},
    {"indices": bytes([3, 3]), "x": 1, "width": 1, "height": 2}])


def test_playback_restores_background_and_previous():
    assert shown(RESTORE_BACKGROUND) == [[RED] * 4, [GREEN, RED, GREEN, RED], [None, BLUE, None, BLUE]]
    assert shown(RESTORE_PREVIOUS) == [[RED] * 4, [GREEN, RED, GREEN, RED], [RED, BLUE, RED, BLUE]]


def test_rasters_ignore_disposal(spark):
    rows = playback.rasters(spark.createDataFrame([(1, RESTORE_BACKGROUND), (2, None)], "clip_id long, content binary"), "bgra").orderBy("frame_no").collect()
    canvases = [np.frombuffer(r["raster"], np.uint8).reshape(2, 2, 4)[..., [2, 1, 0, 3]] for r in rows]
    assert [color(c) for c in canvases] == [[RED] * 4, [GREEN, None, GREEN, None], [None, BLUE, None, BLUE]]


def test_rasters_keep_the_order_that_is_wanted(spark):
    clips = spark.createDataFrame([(1, RESTORE_PREVIOUS)], "clip_id long, content binary")
    assert [r["frame_no"] for r in playback.rasters(clips, wanted=[2, 0, 2]).orderBy("position").collect()] == [2, 0]
    with pytest.raises(PythonException):
        playback.rasters(clips, wanted=[3]).collect()


def test_metadata_manifest_and_tolerance(spark):
    clips = spark.createDataFrame([(1, RESTORE_PREVIOUS), (2, None)], "clip_id long, content binary")
    m = json.loads(clips.select(container.metadata("content").alias("m")).first()["m"])
    assert (m["version"], m["width"], m["height"], m["frame_count"], m["global_palette_size"]) == ("89a", 2, 2, 3, 4) and m["frames"][1]["disposal"] == 3
    assert container.manifest(clips).first()["bytes"] == len(RESTORE_PREVIOUS)
    assert {r["versions"] for r in container.stable([clips.limit(1), clips.limit(1)]).collect()} == {1}
    rows = [(1, True, None, 1.0, None, 0.0), (2, False, 40.0, 39.9, 0.99, 0.99), (3, False, 40.0, 30.0, 0.99, 0.99), (4, False, 40.0, 41.0, 0.99, 0.9), (5, False, None, 40.0, 0.9, 0.9), (6, False, 40.0, None, 0.9, 0.9), (7, None, 40.0, 40.0, None, 0.9)]
    got = metrics.within_tolerance(spark.createDataFrame(rows, "id int, identical boolean, psnr_before double, psnr_after double, ssim_before double, ssim_after double"), 0.5, 0.01)
    assert {r["id"]: r["passes"] for r in got.collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: False}


def test_prepared_frames_share_change_and_are_chosen():
    twice = gif.write(2, 2, PALETTE, [{"indices": bytes([1, 0, 0, 1])}, {"indices": bytes([1, 0, 0, 1])}, {"indices": bytes([1, 2, 0, 1])}, {"indices": bytes([1, 0, 0, 1])}])
    share = lambda **kw: [p["shares"] for p in playback.prepared(twice, **kw)]
    assert share() == [0, 1, 2, 3] and share(dedupe="adjacent") == [0, 0, 2, 3] and share(dedupe="all") == [0, 0, 2, 0]
    d = list(playback.prepared(twice, deltas=True, wanted=[3, 2, 2, 0]))
    assert [p["frame_no"] for p in d] == [0, 2, 3] and d[0]["changed"] is None
    assert [(p["left"], p["top"], p["right"], p["bottom"]) for p in d[1:]] == [(1, 0, 1, 0)] * 2 and d[1]["changed"] == bytes([0, 255, 0, 255])
    for wanted in ([4], [-1], [1.0], [True]):
        with pytest.raises(ValueError):
            list(playback.prepared(twice, wanted=wanted))
    with pytest.raises(gif.GifError):
        list(playback.prepared(twice, budget=40))
    assert len(list(playback.prepared(twice, budget=40, strict=False))) == 2 and len(list(playback.prepared(twice, dedupe="all", budget=32))) == 4
    with pytest.raises(ValueError):
        list(playback.prepared(twice, order="argb"))


def test_player_draws_what_playback_shows():
    rnd = random.Random(1)
    frames = [{"indices": bytes(rnd.randrange(4) for _ in range(4)), "disposal": rnd.randrange(4), "transparent": 0} for _ in range(6)]
    wide = gif.write(40, 3, PALETTE, [{"indices": bytes(120)}, *({"indices": f["indices"], "x": rnd.randrange(30), "y": 1, "width": 2, "height": 2, "disposal": 1} for f in frames)])
    for data in (RESTORE_BACKGROUND, RESTORE_PREVIOUS, gif.write(2, 2, PALETTE, frames), wide):
        expected, player = shown(data), playback.Player(data)
        for k in [*range(len(expected)), 0, 0, len(expected) - 1, *rnd.choices(range(len(expected)), k=20)]:
            assert color(player.draw(k)) == expected[k]
        player.reset()
        assert player.at == -1 and not player.canvas.any()
        assert [color(player.next()) for _ in expected] == expected and color(player.next()) == expected[-1]
    with pytest.raises(gif.GifError):
        player.draw(99)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 7), st.integers(1, 6), st.integers(1, 6), st.integers(0, 10**6), st.sampled_from([None, 0, 3]), st.booleans())
def test_compact_layout_shows_the_same_frames(w, h, n, seed, transparent, still):
    rnd = np.random.default_rng(seed)
    frames = [rnd.integers(0, 4, (h, w)).astype(np.uint8)]
    for _ in range(n - 1):
        f = frames[-1].copy()
        for _ in range(rnd.integers(0, 4) if still else w * h):
            f[rnd.integers(h), rnd.integers(w)] = rnd.integers(0, 4)
        frames.append(f)
    placed = list(layout.compact(iter(enumerate(frames)), transparent))
    fill = 4 if transparent is None else transparent
    for use_fill in (False, True):
        parts = []
        for p in placed:
            left, top, right, bottom = p.box
            filled = p.filled(fill)
            parts.append({"indices": filled if use_fill and filled is not None else p.own(), "x": left, "y": top, "width": right - left + 1, "height": bottom - top + 1, "disposal": p.disposal, "transparent": fill if p.shown is not None else transparent})
        data = gif.write(w, h, [10, 20, 30, 40, 50], parts)
        expected = [[None if i == transparent else 10 * (int(i) + 1) for i in f.ravel()] for f in frames]
        assert shown(data) == expected
        # a player that keeps the canvas draws the first frame over the last one
        assert shown(gif.write(w, h, [10, 20, 30, 40, 50], [*parts, parts[0]]))[-1] == expected[0]


def test_unchanged_frames_are_one_pixel():
    f = np.ones((5, 5), np.uint8)
    assert [(p.box, p.disposal) for p in layout.compact(iter([(0, f), (1, f)]), 0)] == [((0, 0, 4, 4), 1), ((0, 0, 0, 0), 1)]
    assert [p.box for p in layout.plain_deltas(iter([(0, f), (5, f)]))] == [(0, 0, 4, 4), (0, 0, 0, 0)]


def frames_of(spark, clips, width, height, delay=7):
    rows = [(c, k, width, height, delay + k, f.astype(np.uint8).tobytes(), "x") for c, fs in clips.items() for k, f in enumerate(fs)]
    return spark.createDataFrame(rows, "clip_id long, frame_no long, width int, height int, delay int, rgba binary, palette string")


def solid(rnd, n, colors=None, alpha=255):
    rgb = rnd.integers(0, 256, (n, 3)) if colors is None else np.array([[v >> 16, v >> 8 & 255, v & 255] for v in colors])[rnd.integers(0, len(colors), n)]
    return np.concatenate([rgb, np.full((n, 1), alpha)], 1)


def test_every_clip_takes_its_own_strategy(spark):
    """Clips of one table, each with the colours that lead to one strategy; what a player shows is near the source."""
    rnd = np.random.default_rng(5)
    cells = [(r << 4 | 3) << 16 | (g << 4 | 5) << 8 | (b << 4 | 7) for r in range(16) for g in range(16) for b in range(16)]
    near = lambda base, n: [c + int(rnd.integers(0, 8)) for c in rnd.choice(base, n)]
    full = lambda colors, n=4096: np.concatenate([solid(np.random.default_rng(0), 1, [c]) for c in colors] + [solid(rnd, n - len(colors), colors)])
    some = lambda n: rnd.choice(cells, n, replace=False).tolist()
    grid = np.array([[r * 17, g * 17, b * 17, 255] for r in range(16) for g in range(16) for b in range(16)])
    direct = some(200)
    clips = {
        1: [full(some(100))], 2: [full(direct + [c + 1 for c in direct])], 3: [full(some(257))], 4: [grid], 5: [full(some(600))], 6: [solid(rnd, 4096)],
        7: [np.concatenate([solid(rnd, 50, alpha=0), full(some(255), 4046)])], 8: [np.concatenate([solid(rnd, 50, alpha=10), full(some(256), 4046)])], 9: [solid(rnd, 4096, alpha=0)],
    }
    f = frames_of(spark, clips, 64, 64)
    f4 = f.withColumn("delay", F.lit(None).cast("int")).select("clip_id", "frame_no", "width", "height", F.coalesce("delay", F.lit(0)).alias("delay"), "rgba")
    plans = {r["clip_id"]: r for r in encode.plans(f4).collect()}
    assert {k: p["strategy"] for k, p in plans.items()} == {1: "exact", 2: "direct", 3: "merge", 4: "grid", 5: "dominant", 6: "wu", 7: "exact", 8: "merge", 9: "exact"}
    assert [len(plans[k]["palette"]) // 4 for k in (2, 3, 7, 8, 9)] == [256, 256, 256, 256, 1] and plans[7]["transparent"] == plans[8]["transparent"] == 255
    for kw in ({}, {"palette": "local"}, {"compact": False}):
        for r in encode.encode_rgba(f, **kw).collect():
            (frame,), source = shown(bytes(r["content"])), clips[r["clip_id"]][0]
            assert [c is None for c in frame] == (source[:, 3] < 128).tolist()
            wrong = [abs((c >> s & 255) - int(p[k])) for c, p in zip(frame, source) if c is not None for k, s in enumerate((16, 8, 0))]
            assert np.mean(wrong or [0]) < {1: 1e-9, 7: 1e-9, 9: 1e-9, 2: 1, 3: 1, 8: 1}.get(r["clip_id"], 25)
    assert {r["strategy"] for r in encode.plans(f4, "fast").filter("clip_id in (2, 3, 4, 5, 6, 8)").collect()} == {"rgb332"}


def test_large_clips_choose_their_histogram(spark):
    """Beyond a million pixels smooth clips get 5 bits a channel, noisy ones 4."""
    y, x = np.mgrid[0:1024, 0:1024]
    ramp = np.stack([x // 4, y // 4, (x + y) // 8, np.full_like(x, 255)], 2).reshape(-1, 4)
    clips = {1: [ramp], 2: [solid(np.random.default_rng(1), 1 << 20)]}
    got = {r["clip_id"]: r for r in encode.plans(frames_of(spark, clips, 1024, 1024)).collect()}
    assert (got[1]["strategy"], got[1]["bits"]) in {("mediancut", 5), ("dominant", 5)} and (got[2]["strategy"], got[2]["bits"]) == ("wu", 4)


def test_delays_loops_deltas_and_supplied_palettes(spark):
    rnd = np.random.default_rng(2)
    base = solid(rnd, 64, [RED, GREEN, BLUE])
    moved = base.copy()
    moved[9] = [255, 255, 0, 255]
    clips = {1: [base, moved, moved], 2: [base, base, base]}
    f = frames_of(spark, clips, 8, 8)
    source = {c: [color(x.astype(np.uint8)) for x in fs] for c, fs in clips.items()}
    for kw in ({"deltas": True}, {"mode": "exact"}, {"mode": "fast", "deltas": True}, {"encoder": "dictionary"}):
        for r in encode.encode_rgba(f, loop=3, **kw).collect():
            g = gif.parse(bytes(r["content"]))
            assert g["loop_count"] == 3 and [x["delay"] for x in g["frames"]] == [7, 8, 9] and shown(bytes(r["content"])) == source[r["clip_id"]]
    boxes = [[(x["x"], x["y"], x["width"], x["height"]) for x in gif.parse(bytes(r["content"]))["frames"]] for r in encode.encode_rgba(f, deltas=True).orderBy("clip_id").collect()]
    assert boxes == [[(0, 0, 8, 8), (1, 1, 1, 1), (0, 0, 1, 1)], [(0, 0, 8, 8), (0, 0, 1, 1), (0, 0, 1, 1)]]
    given_ = spark.createDataFrame([(c, k, v) for c in (1, 2) for k, v in enumerate([BLUE, 0xFE0000, GREEN, RED, RED])], "clip_id long, idx long, rgb long")
    out = {r["clip_id"]: shown(bytes(r["content"])) for r in encode.encode_rgba(f, supplied=given_).collect()}
    assert out[2] == source[2] and out[1][1][9] in (GREEN, RED) and out[1][0] == source[1][0]
    assert encode.encode_rgba(f.filter("clip_id = 2"), mode="exact", supplied=given_.filter("clip_id = 2")).count() == 1
    for bad in ({"mode": "exact", "supplied": given_}, {"mode": "exact", "threshold": 255}):
        soft = f if "supplied" in bad else frames_of(spark, {1: [solid(rnd, 64, [RED], 200)]}, 8, 8)
        with pytest.raises(PythonException):
            encode.encode_rgba(soft, **bad).collect()
    with pytest.raises(PythonException):
        encode.encode_rgba(frames_of(spark, {1: [solid(rnd, 400)]}, 20, 20), "exact").collect()


def test_transparent_slot_of_a_supplied_palette(spark):
    rnd = np.random.default_rng(3)
    f = frames_of(spark, {1: [np.concatenate([solid(rnd, 60, [RED]), solid(rnd, 4, alpha=0)])]}, 8, 8)
    table = lambda colors: spark.createDataFrame([(1, k, int(v)) for k, v in enumerate(colors)], "clip_id long, idx long, rgb long")
    for colors, slot in (([RED, BLUE], 2), ([RED, *range(1, 256)], 1), ([1, RED, *range(2, 256)], 0)):
        (r,) = encode.encode_rgba(f, supplied=table(colors)).collect()
        g = gif.parse(bytes(r["content"]))
        assert g["frames"][0]["transparent"] == slot and shown(bytes(r["content"])) == [[RED] * 60 + [None] * 4]
    all_used = np.concatenate([np.array([[v >> 16, v >> 8 & 255, v & 255, 255] for v in range(256)]), solid(rnd, 33, alpha=0)])
    with pytest.raises(PythonException):
        encode.encode_rgba(frames_of(spark, {1: [all_used]}, 17, 17), supplied=table(range(256))).collect()


@pytest.mark.parametrize("kw", [{"mode": "best"}, {"palette": "frame"}, {"encoder": "zip"}, {"loop": -1}, {"loop": 65536}, {"loop": 1.5}, {"loop": 2**32}, {"loop": "1"}, {"threshold": 127.5}, {"threshold": 256}, {"threshold": True},
                                {"palette": "local", "deltas": True}, {"palette": "local", "supplied": True}, {"encoder": "dictionary", "mode": "fast"}, {"encoder": "dictionary", "deltas": True}, {"encoder": "dictionary", "palette": "local"}])
def test_options_are_refused(kw):
    with pytest.raises(ValueError):
        encode.check_options(**kw)


@pytest.mark.parametrize("width, height, delay, size", [(0, 1, 0, 0), (65536, 1, 0, 262144), (2.5, 2, 0, 20), (2, "2", 0, 16), (float("nan"), 1, 0, 4), (2**32 + 2, 1, 0, 8), (1, 1, -1, 4), (1, 1, 65536, 4), (1, 1, 1.5, 4), (1, 1, 0, 3), (1, 1, 0, 8)])
def test_frames_are_refused(width, height, delay, size):
    with pytest.raises(ValueError):
        encode.check_frame(width, height, delay, size)


def test_index_frames_of_many_sizes_and_palettes(spark):
    rows = [(1, 0, bytes([0, 1, 1, 0]), 2, 2, [RED, BLUE]), (1, 1, bytes([1, 1, 1, 0]), 2, 2, [GREEN, BLACK]), (2, 0, bytes([1, 0, 1]), 3, 1, [BLUE, RED])]
    packed = spark.createDataFrame(rows, "clip_id long, frame_no long, indices binary, canvas_width int, canvas_height int, local_palette array<int>")
    out = {r["clip_id"]: shown(bytes(r["content"])) for r in container.encode_clips(packed).collect()}
    assert out == {1: [[RED, BLUE, BLUE, RED], [BLACK, BLACK, BLACK, GREEN]], 2: [[RED, BLUE, RED]]}
    palettes = spark.createDataFrame([(c, k, v) for c in (1, 2) for k, v in enumerate([RED, BLUE])], "clip_id long, idx long, rgb long")
    out = {r["clip_id"]: shown(bytes(r["content"])) for r in container.encode_clips(packed.drop("local_palette"), palettes).collect()}
    assert out[1][1] == [BLUE, BLUE, BLUE, RED] and out[2] == [[BLUE, RED, BLUE]]
    for bad in ({"width": 2}, {"width": 0, "height": 1}, {"loop": -1}, {"encoder": "x"}):
        with pytest.raises(ValueError):
            container.encode_clips(packed, **bad)


def test_encode_no_rows(spark):
    assert encode.encode_rgba(frames_of(spark, {1: [np.zeros((4, 4))]}, 2, 2).limit(0)).count() == 0


def test_ingest(spark):
    clip = lambda data, w=2, h=1: spark.createDataFrame([(1, w, h, data)], "clip_id long, width int, height int, rgba binary")
    two = S.rgba_frames(clip(bytes(range(16)))).orderBy("frame_no").collect()
    assert [(r["frame_no"], bytes(r["rgba"])) for r in two] == [(0, bytes(range(8))), (1, bytes(range(8, 16)))]
    assert S.rgba_frames(clip(bytes(16)), 2).count() == 2
    for bad, count in ((bytes(15), None), (b"", None), (bytes(16), 3)):
        with pytest.raises(Exception, match="length does not match"):
            S.rgba_frames(clip(bad), count).collect()
    lists = spark.createDataFrame([(1, 0, 2, 1, bytes(11))], "clip_id long, frame_no long, width int, height int, rgba binary")
    assert len(S.rgba_frame_list(lists).first()["rgba"]) == 8
    with pytest.raises(Exception, match="too short"):
        S.rgba_frame_list(lists.withColumn("height", F.lit(2))).collect()
    index = spark.createDataFrame([(1, 2, 1, bytes([0, 3, 1, 2]))], "clip_id long, width int, height int, indices binary")
    assert [bytes(r["indices"]) for r in S.index_frames(index, 4).orderBy("frame_no").collect()] == [bytes([0, 3]), bytes([1, 2])]
    with pytest.raises(Exception, match="beyond the palette"):
        S.index_frames(index, 2).collect()
    px = spark.createDataFrame([(1, 0, 0, 1, 2, 3, 255), (1, 0, 3, 9, 8, 7, 6)], "clip_id long, frame_no long, pos long, r long, g long, b long, a long")
    assert bytes(S.pack_rgba(px, 2, 2).first()["rgba"]) == bytes([1, 2, 3, 255, 0, 0, 0, 0, 0, 0, 0, 0, 9, 8, 7, 6])


def test_dedupe_compares_pixels(spark):
    rows = [(1, f, p, (0, 5)[f != 1] * p, p, 0) for f in range(4) for p in range(6)]
    canvas = spark.createDataFrame([(c, f, p, v) for c, f, p, v, _, _ in rows], "clip_id long, frame_no long, pos long, color long")
    assert sorted(tuple(r) for r in composite.dedupe(canvas, "adjacent").collect()) == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 3, 2)]
    assert sorted(tuple(r) for r in composite.dedupe(canvas, "all").collect()) == [(1, 0, 0), (1, 1, 1), (1, 2, 0), (1, 3, 0)]
    more = canvas.union(canvas.filter("frame_no = 3"))  # repeated rows don't cancel out
    assert pd.DataFrame(composite.dedupe(more, "all").collect())[2].tolist().count(0) >= 2
