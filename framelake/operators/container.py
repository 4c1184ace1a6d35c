"""GIF files as relations and back: scans, frame decode, clip encode, edits. One Arrow function per file, frame or clip."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import gif, lzw

FRAME = "struct<frame_no:int,x:int,y:int,width:int,height:int,delay:int,disposal:int,transparent:int,interlaced:boolean,local:boolean,palette_offset:int,palette_size:int,data_offset:int,data_length:int,min_code_size:int,start:int,end:int>"
CLIP = f"struct<version:string,width:int,height:int,loop_count:int,global_offset:int,global_size:int,frames:array<{FRAME}>>"
_FIELDS = [p.split(":")[0] for p in FRAME[7:-1].split(",")]


def read_gifs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _clip(data: bytes, mode: str, strict_errors: bool) -> dict | None:
    try:
        g = gif.parse(bytes(data), mode)
    except gif.GifError:
        if strict_errors:
            raise
        return None
    frames = [{n: k if n == "frame_no" else f.get(n) for n in _FIELDS} for k, f in enumerate(g["frames"])]
    return {n: g[n] for n in ("version", "width", "height", "loop_count", "global_offset", "global_size")} | {"frames": frames}


def scan(content: Column | str, mode: str = "strict", on_error: str = "raise") -> Column:
    """The clip's structure; on_error null gives null for a file that the reader refuses (a validity test)."""
    if mode not in ("strict", "lenient", "layout") or on_error not in ("raise", "null"):
        raise ValueError("mode is strict, lenient or layout; on_error is raise or null")
    return F.udf(lambda d: None if d is None else _clip(d, mode, on_error == "raise"), CLIP, useArrow=True)(content)


def metadata(content: Column | str) -> Column:
    """A file's structure as JSON: screen, global palette, loop count, number of frames, and every frame's fields. Absent values are left out."""
    c = scan(content, "lenient")
    return F.when(c.isNotNull(), F.to_json(F.struct(c["version"].alias("version"), c["width"].alias("width"), c["height"].alias("height"), c["global_offset"].alias("global_palette_offset"),
        c["global_size"].alias("global_palette_size"), c["loop_count"].alias("loop_count"), F.size(c["frames"]).alias("frame_count"), c["frames"].alias("frames"))))


def manifest(clips: DataFrame) -> DataFrame:
    """clip_id, bytes and SHA-256 of each file."""
    return clips.select("clip_id", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def stable(runs: list[DataFrame]) -> DataFrame:
    """Per clip the number of different files over several runs; one where the output is stable."""
    both = manifest(runs[0])
    for r in runs[1:]:
        both = both.union(manifest(r))
    return both.groupBy("clip_id").agg(F.count_distinct("bytes", "sha256").alias("versions"))


def frames(clips: DataFrame, mode: str = "strict") -> DataFrame:
    """clips: clip_id, content. One row per frame with the clip's fields and the bytes that the frame needs."""
    c = clips.withColumn("clip", scan("content", mode))
    f = c.select("clip_id", "content", F.col("clip.width").alias("canvas_width"), F.col("clip.height").alias("canvas_height"), F.explode("clip.frames").alias("f"))
    part = lambda at, n: F.when(at.isNotNull(), F.substring(F.col("content"), at + 1, n))
    table = part(F.col("f.palette_offset"), F.col("f.palette_size") * 3)
    return f.select("clip_id", "canvas_width", "canvas_height", "f.*", table.alias("palette"), part(F.col("f.data_offset"), F.col("f.data_length")).alias("data"))


def decoded(frames_: DataFrame, strict: bool = False) -> DataFrame:
    """Frames with their indices, one byte a pixel in picture order. Each frame decodes alone."""

    def run(data: pd.Series, m: pd.Series, w: pd.Series, h: pd.Series, lace: pd.Series) -> pd.Series:
        out = []
        for d, k, x, y, i in zip(data, m, w, h, lace, strict=True):
            px = lzw.decode(lzw.join_blocks(bytes(d))[0], int(k), int(x) * int(y), strict)
            out.append(gif.deinterlace(px, int(x), int(y)) if i else px)
        return pd.Series(out)

    return frames_.withColumn("indices", F.pandas_udf(run, "binary")("data", "min_code_size", "width", "height", "interlaced"))


def pixels(decoded_: DataFrame) -> DataFrame:
    """Decoded frames as canvas pixels: clip_id, frame_no, x, y, idx, rgb; the transparent index is left out."""
    p = decoded_.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)))
    byte = lambda c, at: F.conv(F.hex(F.substring(c, at, F.lit(1))), 16, 10).cast("long")
    p = p.withColumn("idx", byte(F.col("indices"), F.col("i") + 1)).filter(~F.col("idx").eqNullSafe(F.col("transparent").cast("long")))
    rgb = F.conv(F.hex(F.substring(F.col("palette"), (F.col("idx") * 3 + 1).cast("int"), F.lit(3))), 16, 10).cast("long")
    return p.select("clip_id", F.col("frame_no").cast("long"), (F.col("x") + F.col("i") % F.col("width")).cast("long").alias("x"), (F.col("y") + F.floor(F.col("i") / F.col("width"))).cast("long").alias("y"), "idx", rgb.alias("rgb"))


def pack_frames(indexed: DataFrame) -> DataFrame:
    """clip_id, frame_no, pos, idx -> one row per frame with its bytes in position order."""
    g = indexed.groupBy("clip_id", "frame_no").agg(F.array_sort(F.collect_list(F.struct("pos", "idx"))).alias("p"))
    hexed = F.array_join(F.transform("p", lambda s: F.lpad(F.hex(s["idx"]), 2, "0")), "")
    return g.select("clip_id", "frame_no", F.unhex(hexed).alias("indices"))


def encode_clips(packed: DataFrame, palettes: DataFrame | None = None, width: int | None = None, height: int | None = None, loop: int | None = 0, encoder: str = "runs") -> DataFrame:
    """One GIF per clip from index frames.

    packed: clip_id, frame_no, indices, and optionally delay, disposal, transparent, a rectangle, and local_palette (colours of
    this frame alone). palettes: clip_id, idx, rgb; None where every frame has its own. The canvas is width x height for all
    clips, or each clip's canvas_width x canvas_height.
    """
    if encoder not in gif.ENCODERS:
        raise ValueError(f"encoder is one of {', '.join(gif.ENCODERS)}")
    if (width is None) != (height is None) or not all(v is None or 1 <= v <= 65535 for v in (width, height)):
        raise ValueError("width and height are 1 to 65535")
    if loop is not None and not 0 <= loop <= 65535:
        raise ValueError("loop is None or 0 to 65535")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame_no")
        names = [n for n in ("delay", "disposal", "transparent", "x", "y", "width", "height") if n in rows]
        frames_ = [{"indices": bytes(r["indices"]), **{n: int(r[n]) for n in names if not pd.isna(r[n])}} for _, r in rows.iterrows()]
        if "local_palette" in rows:
            for f, own in zip(frames_, rows["local_palette"], strict=True):
                if own is not None:
                    f["palette"] = [int(v) for v in own]
        whole = rows["palette"].iloc[0] if "palette" in rows else None
        size = (width, height) if width is not None else tuple(int(rows[c].iloc[0]) for c in ("canvas_width", "canvas_height"))
        data = gif.write(*size, None if whole is None else [int(v) for v in whole], frames_, loop, encoder)
        return pd.DataFrame({"clip_id": [rows["clip_id"].iloc[0]], "content": [data]})

    if palettes is not None:
        table = palettes.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "rgb"))), lambda s: s["rgb"]).alias("palette"))
        packed = packed.join(table, "clip_id")
    return packed.groupBy("clip_id").applyInPandas(run, "clip_id long, content binary")


def _edit(f: Callable[[bytes], bytes]):
    return F.udf(lambda d: None if d is None else f(bytes(d)), "binary", useArrow=True)


def retimed(content: Column | str, delays) -> Column:
    """delays: one number for all frames or a list."""
    return _edit(lambda d: gif.retime(d, delays))(content)


def looped(content: Column | str, loop: int) -> Column:
    return _edit(lambda d: gif.set_loop(d, loop))(content)


def reordered(content: Column | str, order: list[int]) -> Column:
    return _edit(lambda d: gif.reorder(d, order))(content)


reversed_frames = lambda c: _edit(gif.reverse)(c)
boomerang = lambda c: _edit(gif.boomerang)(c)
remuxed = lambda c: _edit(gif.remux)(c)
reencoded = lambda c: _edit(gif.reencode)(c)


def recoded(packed: DataFrame, m: int, encoder: str) -> DataFrame:
    """Frames with their stream by one encoder, its length, and the indices that come back from it."""

    def there(x: pd.Series) -> pd.Series:
        return x.map(lambda d: gif.ENCODERS[encoder](bytes(d), m))

    def back(s: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([lzw.decode(bytes(d), m, int(k), strict=True) for d, k in zip(s, n, strict=True)])

    out = packed.withColumn("stream", F.pandas_udf(there, "binary")("indices"))
    return out.withColumn("back", F.pandas_udf(back, "binary")("stream", F.octet_length("indices")))


def literal_size(n: Column, m: int) -> Column:
    """Length of a frame's literal image data in closed form."""
    codes = n + F.greatest(F.lit(1), F.ceil(n / ((1 << m) - 2))) + 1
    data = F.ceil(codes * (m + 1) / 8)
    return (data + F.ceil(data / 255) + 2).cast("long")


def write_gifs(clips: DataFrame, folder: str) -> None:
    """Sink: each clip as <clip_id>.gif in a folder, written by the tasks that hold the clips.

    A folder with a scheme that pyarrow knows (file, hdfs, s3, gs) or a plain path that all executors share. A file is
    written under a temporary name and then moved, so a task that is run again leaves whole files only.
    """

    def write(batches):
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        store.create_dir(root, recursive=True)
        for batch in batches:
            for clip, content in zip(batch.column("clip_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                part = f"{root}/.{clip}-{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, f"{root}/{clip}.gif")
            yield batch.select(["clip_id"])

    clips.filter("content is not null").select("clip_id", "content").mapInArrow(write, "clip_id long").write.format("noop").mode("overwrite").save()
