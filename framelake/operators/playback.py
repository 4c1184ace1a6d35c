"""Playback: from GIF bytes to the canvas at every frame, with sharing, deltas and a player.

A clip's frames are drawn in order on one canvas, so a task walks each clip once and holds one or two canvases; frames go
out as they are drawn. Canvases are packed rgba or bgra bytes, a row per frame; ``canvas_pixels`` spreads them.

Defined cases: a file that the strict reader refuses, a requested frame that a clip does not have, or a byte budget that is
exceeded is an error; repeated requests count once, frames come in ascending order; a null file gives no frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.functions import gif, layout
from framelake.sources.storage import bounded_batches, column_batches, record_batches

ORDERS = ("rgba", "bgra")


def palette_words(palette: bytes, order: str = "rgba", transparent: int | None = None, pad: bool = True) -> np.ndarray:
    """Colours as rows of four bytes, alpha 255; padded to 256 entries of 0 and with the transparent one cleared if ``pad``."""
    rgb = np.frombuffer(palette, np.uint8).reshape(-1, 3)
    out = np.zeros((256 if pad else len(rgb), 4), np.uint8)
    out[: len(rgb), :3] = rgb if order == "rgba" else rgb[:, ::-1]
    out[: len(rgb), 3] = 255
    if pad and transparent is not None:
        out[transparent] = 0
    return out


def blit(canvas: np.ndarray, data: bytes, frame: dict, order: str = "rgba") -> None:
    """Draw a frame's visible pixels at its place. Disposal is the caller's business."""
    words = palette_words(data[frame["palette_offset"] : frame["palette_offset"] + 3 * frame["palette_size"]], order)
    idx = np.frombuffer(gif.frame_indices(data, frame, strict=True), np.uint8).reshape(frame["height"], frame["width"])
    part = canvas[frame["y"] : frame["y"] + frame["height"], frame["x"] : frame["x"] + frame["width"]]
    seen = np.ones(idx.shape, bool) if frame["transparent"] is None else idx != frame["transparent"]
    part[seen] = words[idx][seen]


def canvases(data: bytes, order: str = "rgba") -> Iterator[tuple[int, dict, np.ndarray]]:
    """Frame number, frame and canvas (reused: copy what you keep), drawn and disposed in order."""
    g = gif.parse(data)
    canvas = np.zeros((g["height"], g["width"], 4), np.uint8)
    for k, f in enumerate(g["frames"]):
        before = canvas.copy() if f["disposal"] == 3 else None
        blit(canvas, data, f, order)
        yield k, f, canvas
        if before is not None:
            canvas[:] = before
        elif f["disposal"] == 2:
            canvas[f["y"] : f["y"] + f["height"], f["x"] : f["x"] + f["width"]] = 0


def _checked(order: str, wanted: list[int] | None, dedupe: str) -> list[int] | None:
    if order not in ORDERS:
        raise ValueError("order is rgba or bgra")
    if dedupe not in ("none", "adjacent", "all"):
        raise ValueError("dedupe is none, adjacent or all")
    if wanted is None:
        return None
    if any(isinstance(k, bool) or not isinstance(k, int) or k < 0 for k in wanted):
        raise ValueError("frame numbers are integers from 0")
    return sorted(set(wanted))


def prepared(data: bytes, order: str = "rgba", wanted: list[int] | None = None, dedupe: str = "none", deltas: bool = False, budget: int | None = None, strict: bool = True) -> Iterator[dict]:
    """A clip's wanted frames: canvas, the earlier frame whose equal pixels it shares, and the change since the last wanted one.

    Equal digests only suggest equal pixels; they are compared. Shared canvases are None and cost no bytes.
    """
    wanted = _checked(order, wanted, dedupe)
    count = len(gif.parse(data)["frames"])
    if wanted and wanted[-1] >= count:
        raise gif.GifError(f"frame {wanted[-1]} of {count}")
    chosen = set(range(count) if wanted is None else wanted)
    kept: dict[int, list[tuple[int, np.ndarray]]] = {}
    last, shares_last, spent = None, None, 0
    for k, f, canvas in canvases(data, order):
        if k not in chosen:
            if k > max(chosen, default=-1):
                return
            continue
        shares = k
        if dedupe == "adjacent" and last is not None and (last == canvas).all():
            shares = shares_last
        elif dedupe == "all":
            bucket = kept.setdefault(hash(canvas.tobytes()), [])
            shares = next((n for n, c in bucket if (c == canvas).all()), k)
        changed = layout.bounds((canvas != last).any(2)) if deltas and last is not None else None
        piece = None if changed is None else layout.part(canvas, changed).tobytes()
        own = None if shares != k else canvas.tobytes()
        spent += len(own or b"") + len(piece or b"")
        if budget is not None and spent > budget:
            if strict:
                raise gif.GifError("prepared frames exceed the byte budget")
            return
        if dedupe != "none" or deltas:
            last, shares_last = canvas.copy(), shares
            if dedupe == "all" and shares == k:
                bucket.append((k, last))
        box = dict(zip(("left", "top", "right", "bottom"), changed or (None,) * 4, strict=True))
        yield {"frame_no": k, "width": canvas.shape[1], "height": canvas.shape[0], "delay": f["delay"], "shares": shares, "canvas": own, **box, "changed": piece}


_FRAMES = pa.schema([("clip_id", pa.int64()), ("frame_no", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("delay", pa.int32()), ("shares", pa.int64()), ("canvas", pa.binary()),
                     ("left", pa.int32()), ("top", pa.int32()), ("right", pa.int32()), ("bottom", pa.int32()), ("changed", pa.binary())])
_DDL = "clip_id long, frame_no long, width int, height int, delay int, shares long, canvas binary, `left` int, top int, `right` int, bottom int, changed binary"


def playback(clips: DataFrame, order: str = "rgba", wanted: list[int] | None = None, dedupe: str = "none", deltas: bool = False, budget: int | None = None, strict: bool = True) -> DataFrame:
    """clips: clip_id, content. One row per (wanted) frame; see ``prepared``."""
    _checked(order, wanted, dedupe)
    bounded_batches(clips.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for clip, data in zip(batch.column("clip_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for row in prepared(data, order, wanted, dedupe, deltas, budget, strict) if data is not None else ():
                    yield {"clip_id": clip, **row}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return record_batches(rows(batches), _FRAMES)

    return clips.select("clip_id", "content").mapInArrow(run, _DDL)


def rasters(clips: DataFrame, order: str = "rgba", wanted: list[int] | None = None) -> DataFrame:
    """Frames alone on an empty canvas, no disposal applied: clip_id, position, frame_no, width, height, raster.

    Positions follow the order in which frames are wanted, the first of repeated ones.
    """
    _checked(order, wanted, "none")
    bounded_batches(clips.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for clip, data in zip(batch.column("clip_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                g = gif.parse(data)
                for at, k in enumerate(range(len(g["frames"])) if wanted is None else dict.fromkeys(wanted)):
                    if k >= len(g["frames"]):
                        raise gif.GifError(f"frame {k} of {len(g['frames'])}")
                    canvas = np.zeros((g["height"], g["width"], 4), np.uint8)
                    blit(canvas, data, g["frames"][k], order)
                    yield pa.RecordBatch.from_pydict({"clip_id": [clip], "position": [at], "frame_no": [k], "width": pa.array([g["width"]], pa.int32()), "height": pa.array([g["height"]], pa.int32()), "raster": [canvas.tobytes()]})

    return clips.filter("content is not null").select("clip_id", "content").mapInArrow(run, "clip_id long, position long, frame_no long, width int, height int, raster binary")


def canvas_pixels(frames: DataFrame, column: str = "canvas") -> DataFrame:
    """clip_id, frame_no, pos, rgb of the visible pixels of packed rgba canvases."""

    schema = pa.schema([(name, pa.int64()) for name in ("clip_id", "frame_no", "pos", "rgb")])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for clip, frame, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                x = np.frombuffer(data, np.uint8).reshape(-1, 4).astype(np.int64)
                pos = np.flatnonzero(x[:, 3])
                yield np.full(len(pos), clip), np.full(len(pos), frame), pos, x[pos, 0] << 16 | x[pos, 1] << 8 | x[pos, 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return column_batches(pieces(batches), schema)

    return frames.filter(F.col(column).isNotNull()).select("clip_id", "frame_no", column).mapInArrow(run, "clip_id long, frame_no long, pos long, rgb long")


class Player:
    """Frames of one clip drawn on one canvas; a small change after the frame before is drawn as such."""

    def __init__(self, data: bytes, order: str = "rgba"):
        self.frames = {p["frame_no"]: p for p in prepared(data, order, dedupe="adjacent", deltas=True)}
        first = self.frames[min(self.frames)]
        self.canvas = np.zeros((first["height"], first["width"], 4), np.uint8)
        self.at = -1

    def draw(self, k: int) -> np.ndarray:
        if k not in self.frames:
            raise gif.GifError(f"no frame {k}")
        f = self.frames[k]
        follows = k == self.at + 1 and self.at >= 0
        if follows and f["shares"] != k:
            pass  # the frame before shows the same
        elif follows and f["changed"] is not None and 8 * len(f["changed"]) <= self.canvas.nbytes:
            box = f["left"], f["top"], f["right"], f["bottom"]
            part = layout.part(self.canvas, box)
            part[:] = np.frombuffer(f["changed"], np.uint8).reshape(part.shape)
        elif self.at != k:
            self.canvas[:] = np.frombuffer(self.frames[f["shares"]]["canvas"], np.uint8).reshape(self.canvas.shape)
        self.at = k
        return self.canvas

    def next(self) -> np.ndarray:
        return self.draw(self.at + 1) if self.at + 1 in self.frames else self.canvas

    def reset(self) -> None:
        self.at = -1
        self.canvas[:] = 0
