"""Many short clips: their work is dealt over tasks, plans beyond a size are not broadcast, batches hold many records."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from framelake.functions import gif
from framelake.operators import encode, playback
from framelake.plans import registry
from framelake.sources import pixels as S
from framelake.sources.storage import column_batches, record_batches
from pyspark.sql import functions as F


def clips(spark, n):
    """n clips of two 4 x 4 frames: the even ones hold 2 colours, the odd ones transparent pixels too."""
    rows = []
    for c in range(n):
        for k in range(2):
            px = np.array([[c % 256, k, 7, 255], [c % 251, 9, k, 0 if c % 2 else 255]] * 8, np.uint8)
            rows.append((c, k, 4, 4, k, bytearray(px.tobytes())))
    return spark.createDataFrame(rows, "clip_id long, frame_no long, width int, height int, delay int, rgba binary")


def tasks(df):
    return df.select(F.spark_partition_id().alias("task")).distinct().count()


@pytest.mark.parametrize("mode", ["exact", "fast", "quality"])
def test_short_clips_are_dealt_over_tasks(spark, mode):
    f = clips(spark, 300)
    assert tasks(encode.plans(f, mode)) > 1
    assert tasks(playback.playback(encode.encode_rgba(f, mode))) > 1


@pytest.mark.parametrize("kw", [{}, {"palette": "local"}, {"mode": "fast"}, {"mode": "exact", "compact": True}])
def test_plans_beyond_the_limit_reach_frames_by_a_shuffle(spark, monkeypatch, kw):
    f = clips(spark, 40)
    files = lambda: {r["clip_id"]: bytes(r["content"]) for r in encode.encode_rgba(f, **kw).collect()}
    few = files()
    monkeypatch.setattr(encode, "PLAN_LIMIT", 0)
    plan = encode.plans(f, kw.get("mode", "quality"), kw.get("palette", "global"))
    joined = encode.indexed(f, plan)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in joined and "strategy=broadcast" not in joined
    assert files() == few and len(few) == 40
    shown = [c.copy() for _, _, c in playback.canvases(few[1])]
    assert (shown[1].reshape(-1, 4)[0] == [1, 1, 7, 255]).all() and not shown[1].reshape(-1, 4)[1].any() and len(gif.parse(few[1])["frames"]) == 2


def test_a_supplied_palette_per_clip_is_dealt_too(spark, monkeypatch):
    f = clips(spark, 300)
    palettes = f.select("clip_id").distinct().select("clip_id", F.explode(F.array(F.struct(F.lit(0).alias("idx"), F.lit(7).alias("rgb")), F.struct(F.lit(1).alias("idx"), F.lit(0xFF0900).alias("rgb")))).alias("p")).select("clip_id", "p.*")
    assert tasks(encode.supplied_plans(f, palettes)) > 1
    few = {r["clip_id"]: bytes(r["content"]) for r in encode.encode_rgba(f, supplied=palettes).collect()}
    monkeypatch.setattr(encode, "PLAN_LIMIT", 0)
    assert {r["clip_id"]: bytes(r["content"]) for r in encode.encode_rgba(f, supplied=palettes).collect()} == few and len(few) == 300


def test_batches_hold_many_records_and_stay_bounded():
    schema = pa.schema([("k", pa.int64()), ("data", pa.binary())])
    short = list(record_batches(({"k": k, "data": b"ab"} for k in range(2500)), schema))
    assert [b.num_rows for b in short] == [1024, 1024, 452] and [v for b in short for v in b.column("k").to_pylist()] == list(range(2500))
    assert [b.num_rows for b in record_batches(({"k": k, "data": bytes(3 << 20)} for k in range(5)), schema)] == [2, 2, 1]
    assert list(record_batches(iter(()), schema)) == []
    ints = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    pieces = [np.arange(n) for n in (0, 1 << 15, 1 << 15, 3, 1 << 17, 2)]
    out = list(column_batches(((p, -p) for p in pieces), ints))
    assert [b.num_rows for b in out] == [1 << 16, 3 + (1 << 17), 2] and np.array_equal(np.concatenate([b.column("b").to_numpy() for b in out]), -np.concatenate(pieces))


def test_odd_vectors_give_the_frames_of_the_sql(spark, same, tmp_path):
    rnd = np.random.default_rng(4)
    rows = [(k, rnd.uniform(-1, 1, 64).round(1).tolist()) for k in range(29)]
    rows[3][1][5:8] = [math.nan, math.inf, -math.inf]
    rows[9][1][60] = None
    rows[17] = 17, [*rows[17][1], 0.5, -0.5, 0.9]
    rows += [(29, None), (30, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    table.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("encode_rgba_fast", "encode_rgba_quality"):
        twin = registry.ORACLES[name].replace("FROM embeddings", "FROM (SELECT * FROM embeddings WHERE len(embedding) > 0)")
        same(registry.QUERIES[name](spark, str(tmp_path)), con, twin)
    frames = {(r["clip_id"], r["frame_no"]): bytes(r["rgba"]) for r in S.vector_frames(table.unionByName(table.limit(5))).collect()}
    assert len(frames) == 29 and {len(v) for v in frames.values()} == {256}
    (short,) = S.vector_frames(spark.createDataFrame([(0, [0.0] * 62)], "vec_id long, embedding array<float>")).collect()
    gone = [p for p in range(64) if short["rgba"][4 * p + 3] == 0]
    assert gone == sorted({(p - t) % 64 for p in (62, 63) for t in (0, 21, 42)})
