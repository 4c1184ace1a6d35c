"""RGBA frames to GIF files, many clips at once: count colours, choose a palette, map pixels, lay out, compress, assemble.

``frames`` has a row per frame: clip_id, frame_no, width, height, rgba (whole canvases) and optionally delay. A frame shrinks
to its distinct colours in its own task; colours are added up per clip (or per frame, for local palettes), and what the
palette needs of them is bounded: 256 colours, or the cells of a 4- or 5-bit histogram. Mapping and compression run per
frame. Palettes, layout and assembly are dealt by number of tasks, as their rows are short and their work isn't; plans reach
their frames by broadcast up to a fixed size, by a shuffle beyond. ``frames`` is read twice (three times in quality mode), so
store it first if it is costly to make. Only layout follows a clip's frames in order; it holds three of them at a time. Assembly gathers compressed frames.

Modes: exact takes at most 256 colours and alpha 0 or 255; fast falls back to the fixed 3-3-2 palette; quality falls back to
a palette of its own. What a clip falls back to depends on that clip alone.

Defined cases: frames of a clip that lack the length of their canvas are an error; frames are put in order of frame_no,
gaps don't matter; a missing delay is 0; clips without frames don't exist; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from numbers import Integral

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import gif, layout
from framelake.functions.color import palette332
from framelake.sources.storage import bounded_batches, column_batches, record_batches, spread, stored

from . import quantize

#: Limits of the choice of a quality palette.
DOMINANT_CELLS, LOW_RES_PIXELS, SMOOTH_SAMPLES, SMOOTH_DELTA = 2048, 1_000_000, 8192, 16
#: Bytes of plans that may be broadcast; those of a plan without cells, and of one of a 4- or 5-bit histogram, at most.
PLAN_LIMIT, PLAN_BYTES, CELL_PLAN_BYTES = 8 << 20, 3 << 10, {4: 24 << 10, 5: 168 << 10}
#: How a cell strategy makes its palette.
PLANS = {"direct": quantize.direct_plan, "merge": quantize.merge_plan, "grid": quantize.flat_grid_plan, "dominant": quantize.dominant_plan, "wu": quantize.variance_cut_plan, "mediancut": quantize.median_cut_nearest_plan}


def _within(value, low: int, high: int) -> bool:
    return isinstance(value, Integral) and not isinstance(value, bool) and low <= value <= high


def check_options(mode: str = "quality", palette: str = "global", encoder: str = "runs", loop: int | None = None, threshold: int = 128, deltas: bool = False, supplied: bool = False) -> None:
    """Refuse what the encoder would otherwise have to guess at; nothing is rounded, wrapped or converted."""
    if mode not in ("exact", "fast", "quality"):
        raise ValueError("mode is exact, fast or quality")
    if palette not in ("global", "local"):
        raise ValueError("palette is global or local")
    if encoder not in gif.ENCODERS:
        raise ValueError(f"encoder is one of {', '.join(gif.ENCODERS)}")
    if loop is not None and not _within(loop, 0, 65535):
        raise ValueError("loop count is None or 0 to 65535")
    if not _within(threshold, 0, 255):
        raise ValueError("alpha threshold is 0 to 255")
    if palette == "local" and (supplied or deltas):
        raise ValueError("local palettes take neither a supplied palette nor deltas")
    if encoder == "dictionary" and (mode != "quality" or palette != "global" or supplied or deltas):
        raise ValueError("the smallest stream needs quality mode with one palette of its own and no deltas")


def check_frame(width, height, delay, size: int) -> None:
    if not (_within(width, 1, 65535) and _within(height, 1, 65535)):
        raise ValueError("width and height are 1 to 65535")
    if not _within(delay, 0, 65535):
        raise ValueError("a delay is 0 to 65535")
    if size != 4 * width * height:
        raise ValueError("a frame has width * height * 4 bytes")


def _rgb(rgba: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(rgba, np.uint8).reshape(-1, 4).astype(np.int64)
    return x[:, 0] << 16 | x[:, 1] << 8 | x[:, 2], x[:, 3]


def _cell(rgb: np.ndarray, bits: int) -> np.ndarray:
    part = [rgb >> shift & 255 for shift in (16, 8, 0)]
    return part[0] >> (8 - bits) << 2 * bits | part[1] >> (8 - bits) << bits | part[2] >> (8 - bits)


#: Colour numbers that stand for transparent pixels and for pixels of partial alpha (counted besides).
CLEAR, PARTIAL = -1, -2


def colors(frames: DataFrame, threshold: int = 128) -> DataFrame:
    """clip_id, frame_no, rgb, n, at (first place in the clip): a frame's distinct opaque colours, CLEAR and PARTIAL."""
    schema = pa.schema([("clip_id", pa.int64()), ("frame_no", pa.int64()), ("rgb", pa.int64()), ("n", pa.int64()), ("at", pa.int64())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for row in batch.to_pylist():
                check_frame(row["width"], row["height"], row["delay"], len(row["rgba"]))
                rgb, alpha = _rgb(row["rgba"])
                u, first, n = np.unique(np.where(alpha >= threshold, rgb, CLEAR), return_index=True, return_counts=True)
                soft = int(((alpha > 0) & (alpha < 255)).sum())
                if soft:
                    u, first, n = (np.append(a, b) for a, b in ((u, PARTIAL), (first, 0), (n, soft)))
                yield np.full(len(u), row["clip_id"], np.int64), np.full(len(u), row["frame_no"], np.int64), u, n, first + row["frame_no"] * len(rgb)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return column_batches(pieces(batches), schema)

    return frames.select("clip_id", "frame_no", "width", "height", "delay", "rgba").mapInArrow(run, "clip_id long, frame_no long, rgb long, n long, at long")


def _cells(counted: DataFrame, keys: list[str], bits: int) -> DataFrame:
    r, g, b = (F.shiftright("rgb", shift).bitwiseAND(F.lit(255).cast("long")) for shift in (16, 8, 0))
    cut = 8 - bits
    cell = F.shiftright(r, cut) * (1 << 2 * bits) + F.shiftright(g, cut) * (1 << bits) + F.shiftright(b, cut)
    w = lambda c, name: F.sum(c * F.col("n")).alias(name)
    return counted.filter("rgb >= 0").groupBy(*keys, cell.alias("k")).agg(F.sum("n").alias("n"), w(r, "sr"), w(g, "sg"), w(b, "sb"), F.lit(0).cast("long").alias("at"))


def _smooth(frames: DataFrame, large: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """Keys of large inputs whose sampled neighbouring pixels differ little: a mean below SMOOTH_DELTA a channel."""
    schema = pa.schema([("clip_id", pa.int64()), ("frame_no", pa.int64()), ("pair", pa.int64()), ("side", pa.int64()), ("rgb", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rgb, alpha = _rgb(row["rgba"])
                step = row["pixels"] // SMOOTH_SAMPLES
                place = np.arange(len(rgb)) + (row["frame_no"] * len(rgb) if row["across"] else 0)
                ok = (place % step < 2) & (place // step * step + step < row["pixels"]) & (alpha >= threshold)
                n = int(ok.sum())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in (np.full(n, row["clip_id"]), np.full(n, row["frame_no"]), place[ok] // step, place[ok] % step, rgb[ok])], schema=schema)

    across = F.lit("frame_no" not in keys)
    seen = frames.join(large, keys).select("clip_id", "frame_no", "rgba", "pixels", across.alias("across")).mapInArrow(run, "clip_id long, frame_no long, pair long, side long, rgb long")
    both = seen.groupBy(*keys, "pair").agg(F.count(F.lit(1)).alias("n"), F.max("rgb").alias("a"), F.min("rgb").alias("b")).filter("n = 2")
    first = both.withColumn("order", F.row_number().over(Window.partitionBy(*keys).orderBy("pair"))).filter(F.col("order") <= SMOOTH_SAMPLES)
    part = lambda c, shift: F.shiftright(c, shift).bitwiseAND(F.lit(255).cast("long"))
    delta = sum((F.abs(part("a", s) - part("b", s)) for s in (16, 8, 0)), F.lit(0))
    return first.groupBy(*keys).agg((F.sum(delta) < F.count(F.lit(1)) * 3 * SMOOTH_DELTA).alias("smooth"))


def strategies(frames: DataFrame, counted: DataFrame, keys: list[str], mode: str, threshold: int) -> DataFrame:
    """Per key: strategy, bits of its histogram, and whether it holds transparent and partly transparent pixels."""
    s = counted.groupBy(*keys).agg(F.count_if(F.col("rgb") >= 0).alias("n_colors"), F.max(F.col("rgb") == CLEAR).alias("clear"), F.max(F.col("rgb") == PARTIAL).alias("partial"), F.sum(F.when(F.col("rgb") >= CLEAR, F.col("n"))).alias("pixels"))
    limit = 256 - F.col("clear").cast("int")
    exact = F.coalesce("n_colors", F.lit(0)) <= limit
    if mode != "quality":  # what clips fall back to has no cells
        return s.select(*keys, F.when(exact, "exact").otherwise({"exact": "refused", "fast": "rgb332"}[mode]).alias("strategy"), F.lit(4).alias("bits"), "clear", "partial")
    four, five = _cells(counted, keys, 4), _cells(counted, keys, 5)
    one = F.lit(1).cast("long")
    bit = lambda shift: F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), F.shiftright("k", shift).bitwiseAND(F.lit(15).cast("long")).cast("int"))))
    grid = (F.min("n") == F.max("n")) & (bit(8) * bit(4) * bit(0) == F.count(one))
    shape = four.groupBy(*keys).agg(F.count(one).alias("cells4"), grid.alias("grid")).join(five.groupBy(*keys).agg(F.count(one).alias("cells5")), keys)
    s = s.join(shape, keys, "left")
    s = s.join(_smooth(frames, s.filter(F.col("pixels") > LOW_RES_PIXELS).select(*keys, "pixels"), keys, threshold), keys, "left")
    fine = (F.col("pixels") > LOW_RES_PIXELS) & F.coalesce("smooth", F.lit(False))
    cells = F.when(fine, F.col("cells5")).otherwise(F.col("cells4"))
    low = F.col("pixels") <= LOW_RES_PIXELS
    quality = F.when(low & (cells <= limit), "direct").when(low & (cells == limit + 1), "merge").when(low & F.col("grid"), "grid").when(cells <= DOMINANT_CELLS, "dominant").when(fine, "mediancut").otherwise("wu")
    return s.select(*keys, F.when(exact, "exact").otherwise(quality).alias("strategy"), F.when(fine, 5).otherwise(4).alias("bits"), "clear", "partial")


_PLAN = "strategy string, bits int, transparent int, palette binary, k binary, idx binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _reached(plans_: DataFrame, size: int) -> DataFrame:
    """Plans with how a join is to take them, by their size at most: that of their table on disk says nothing, it compresses well."""
    return plans_.hint("broadcast" if size <= PLAN_LIMIT else "merge")


def _as_plan(strategy: str, bits: int, clear: bool, partial: bool, rows: dict[str, np.ndarray], mode: str) -> dict:
    """rows: k (ascending), n, sr, sg, sb, at. palette: 32-bit colours; k and idx: sorted colours or cells and their entries."""
    if strategy == "refused":
        raise ValueError("exact mode takes at most 256 colours, a transparent one included")
    if mode == "exact" and partial:
        raise ValueError("exact mode takes alpha 0 and 255 only")
    limit = 256 - clear
    if strategy == "rgb332":
        palette, k, idx = np.array(palette332()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if clear:
            palette[255] = 0
        slot = 255 if clear else None
    else:
        if strategy == "exact":
            palette = rows["k"][np.argsort(rows["at"])]
            idx = np.argsort(palette, kind="stable")
            k = palette[idx]
        else:
            k = rows["k"]
            idx, palette = PLANS[strategy](k, rows["n"], np.stack([rows[c] for c in ("sr", "sg", "sb")], 1), limit)
            if strategy == "direct" and len(palette) + clear > 128:
                palette = np.concatenate([palette, np.full(limit - len(palette), palette[-1])])
        slot = len(palette) if clear else None
        if clear or not len(palette):
            palette = np.append(palette, 0)
    return {"strategy": strategy, "bits": bits, "transparent": slot, "palette": palette.astype("<i4").tobytes(), "k": k.astype("<i4").tobytes(), "idx": idx.astype(np.uint8).tobytes()}


def plans(frames: DataFrame, mode: str = "quality", palette: str = "global", threshold: int = 128) -> DataFrame:
    """Per clip, or per clip and frame: the palette, its transparent slot, and how colours or cells map to entries."""
    bounded_batches(frames.sparkSession)
    keys = ["clip_id"] if palette == "global" else ["clip_id", "frame_no"]
    each = colors(frames, threshold)
    counted = stored(each if len(keys) == 2 else each.groupBy("clip_id", "rgb").agg(F.sum("n").alias("n"), F.min("at").alias("at")), "colors")
    chosen = stored(strategies(frames, counted, keys, mode, threshold), "strategies")
    zero = F.lit(0).cast("long")
    exact = counted.filter("rgb >= 0").join(chosen.filter("strategy = 'exact'").select(*keys), keys).select(*keys, F.col("rgb").alias("k"), "n", zero.alias("sr"), zero.alias("sg"), zero.alias("sb"), "at")
    rows = exact
    for bits in (4, 5) if mode == "quality" else ():
        some = chosen.filter(F.col("strategy").isin(list(PLANS)) & (F.col("bits") == bits)).select(*keys)
        rows = rows.unionByName(_cells(counted, keys, bits).join(some, keys))
    ddl = ", ".join(f"{k} long" for k in keys) + ", " + _PLAN
    names = ("k", "n", "sr", "sg", "sb", "at")
    cells = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*names))).alias("cells"))
    none = {c: np.zeros(0, np.int64) for c in names}

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            cells = batch.column("cells")
            for at, one in enumerate(batch.select([*keys, "strategy", "bits", "clear", "partial"]).to_pylist()):
                own = cells[at].values
                yield {**one, **_as_plan(one["strategy"], one["bits"], one["clear"], one["partial"], none if own is None else {c: v.to_numpy() for c, v in zip(names, own.flatten(), strict=True)}, mode)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return record_batches(made(batches), _schema(ddl))

    each = F.when(F.col("strategy").isin(list(PLANS)), F.when(F.col("bits") == 4, CELL_PLAN_BYTES[4]).otherwise(CELL_PLAN_BYTES[5])).otherwise(PLAN_BYTES)
    size = chosen.agg(F.sum(each.cast("long"))).first()[0] or 0
    return _reached(spread(chosen, *keys).join(cells, keys, "left").mapInArrow(run, ddl), size)


def supplied_plans(frames: DataFrame, palettes: DataFrame, mode: str = "quality", threshold: int = 128) -> DataFrame:
    """Plans for palettes that the caller gives (clip_id, idx from 0, rgb). A transparent slot is appended, or the lowest unused entry."""
    table = palettes.groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "rgb"))), lambda s: s["rgb"].cast("int")).alias("palette"))
    schema = pa.schema([("clip_id", pa.int64()), ("used", pa.int64())])

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not 1 <= len(row["palette"]) <= 256:
                    raise ValueError("a palette has 1 to 256 colours")
                rgb, alpha = _rgb(row["rgba"])
                if mode == "exact" and ((alpha > 0) & (alpha < 255)).any():
                    raise ValueError("exact mode takes alpha 0 and 255 only")
                palette, shown = np.array(row["palette"]), np.unique(rgb[alpha >= threshold])
                if mode == "exact" and not np.isin(shown, palette).all():
                    raise ValueError("exact mode takes the palette's own colours only")
                u = np.unique(quantize.nearest_entry(shown, palette)).tolist() + ([CLEAR] if (alpha < threshold).any() else [])
                yield pa.RecordBatch.from_pydict({"clip_id": [row["clip_id"]] * len(u), "used": u}, schema=schema)

    seen = frames.join(table, "clip_id").select("clip_id", "rgba", "palette").mapInArrow(used, "clip_id long, used long").groupBy("clip_id").agg(F.collect_set("used").alias("used"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in g.iterrows():
            palette, have = np.array(row["palette"]), set(row["used"])
            slot = None
            if CLEAR in have:
                free = [len(palette)] if len(palette) < 256 else [k for k in range(256) if k not in have]
                if not free:
                    raise ValueError("no palette entry is free for transparent pixels")
                slot = free[0]
                palette = np.append(palette, 0) if slot == len(palette) else palette
            out.append({"clip_id": row["clip_id"], "strategy": "supplied", "bits": 0, "transparent": slot, "palette": palette.astype("<i4").tobytes(), "k": np.array([len(row["palette"])], "<i4").tobytes(), "idx": b""})
        return pd.DataFrame(out, columns=["clip_id", *[c.split()[0] for c in _PLAN.split(", ")]]).astype({"transparent": "Int64"})

    made = spread(seen, "clip_id").join(table, "clip_id").mapInPandas(lambda parts: map(run, parts), "clip_id long, " + _PLAN)
    return _reached(made, PLAN_BYTES * palettes.select("clip_id").distinct().count())


def map_frame(rgba: bytes, plan: dict, threshold: int) -> np.ndarray:
    """Palette indices of one frame."""
    rgb, alpha = _rgb(rgba)
    clear = alpha < threshold
    if plan["strategy"] == "rgb332":
        out = rgb >> 16 & 0xE0 | rgb >> 11 & 0x1C | rgb >> 6 & 3
        if plan["transparent"] is not None:
            out = np.minimum(out, 254)
    elif plan["strategy"] == "supplied":
        size = int(np.frombuffer(plan["k"], "<i4")[0])
        distinct, at = np.unique(rgb, return_inverse=True)
        out = quantize.nearest_entry(distinct, np.frombuffer(plan["palette"], "<i4")[:size].astype(np.int64))[at]
    else:
        k, idx = np.frombuffer(plan["k"], "<i4"), np.frombuffer(plan["idx"], np.uint8)
        wanted = rgb if plan["strategy"] == "exact" else _cell(rgb, plan["bits"])
        out = idx[np.minimum(np.searchsorted(k, wanted), len(k) - 1)] if len(k) else np.zeros(len(rgb), np.uint8)
    return np.where(clear, plan["transparent"] or 0, out).astype(np.uint8)


_INDEXED = "clip_id long, frame_no long, width int, height int, delay int, strategy string, transparent int, palette binary, indices binary"


def indexed(frames: DataFrame, plans_: DataFrame, threshold: int = 128) -> DataFrame:
    """Every frame by its clip's (or its own) plan."""
    keys = ["clip_id", "frame_no"] if "frame_no" in plans_.columns else ["clip_id"]
    names = ["clip_id", "frame_no", "width", "height", "delay", "strategy", "transparent", "palette"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(names)
            made = [map_frame(r["rgba"], r, threshold).tobytes() for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(made, pa.binary())], names=[*names, "indices"])

    typed = frames.select("clip_id", "frame_no", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.col("delay").cast("int").alias("delay"), "rgba")
    return typed.join(plans_, keys).mapInArrow(run, _INDEXED)


_LAID = "clip_id long, frame_no long, width int, height int, delay int, x int, y int, w int, h int, disposal int, transparent int, palette binary, indices binary, filled binary"


def lay_out(indexed_: DataFrame, kind: str) -> DataFrame:
    """kind: independent (whole frames), local (the same, each with its palette), deltas, or compact."""
    clips = spread(indexed_, "clip_id").sortWithinPartitions("clip_id", "frame_no") if kind in ("deltas", "compact") else indexed_

    def placed(rows: Iterator[dict], first: dict) -> Iterator[layout.Placed]:
        canvas = ((r["frame_no"], np.frombuffer(r["indices"], np.uint8).reshape(r["height"], r["width"])) for r in rows)
        if kind == "compact":
            return layout.compact(canvas, first["transparent"])
        if kind == "deltas":
            return layout.plain_deltas(canvas)
        return layout.independent(canvas, 2 if kind == "local" or first["transparent"] is not None else 0)

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for _, group in itertools.groupby(rows, key=lambda r: r["clip_id"] if kind in ("deltas", "compact") else (r["clip_id"], r["frame_no"])):
            first = next(group)
            delays: dict[int, int] = {}
            colors_ = len(first["palette"]) // 4
            spare = first["transparent"]
            if spare is None and colors_ < gif.padded_colors(colors_):
                spare = colors_  # an unused slot marks unchanged pixels without a larger table

            def noted(rows, delays=delays):
                for r in rows:
                    delays[r["frame_no"]] = r["delay"]
                    yield r

            for p in placed(noted(itertools.chain([first], group)), first):
                left, top, right, bottom = p.box
                drawn = p.shown is not None
                yield {"clip_id": first["clip_id"], "frame_no": p.number, "width": first["width"], "height": first["height"], "delay": delays.pop(p.number), "x": left, "y": top, "w": right - left + 1, "h": bottom - top + 1,
                       "disposal": p.disposal, "transparent": spare if drawn else first["transparent"], "palette": first["palette"], "indices": p.own(), "filled": p.filled(spare)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return record_batches(laid(batches), _schema(_LAID))

    return clips.mapInArrow(run, _LAID)


def assemble(laid: DataFrame, encoder: str = "runs", loop: int | None = None, local: bool = False) -> DataFrame:
    """clip_id, content. Frames are compressed where they lie; a clip's task joins the compressed ones."""

    def image(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples(index=False):
            palette = np.frombuffer(r.palette, "<i4").tolist()
            control = gif.control_block(int(r.delay), int(r.disposal), None if pd.isna(r.transparent) else int(r.transparent))
            out.append(control + gif.image(int(r.x), int(r.y), int(r.w), int(r.h), bytes(r.indices), len(palette), encoder, palette if local else None, None if r.filled is None else bytes(r.filled)))
        return pd.DataFrame({"clip_id": rows["clip_id"], "frame_no": rows["frame_no"], "width": rows["width"], "height": rows["height"], "palette": rows["palette"], "image": out})

    coded = spread(laid, "clip_id", "frame_no").mapInPandas(lambda parts: map(image, parts), "clip_id long, frame_no long, width int, height int, palette binary, image binary")
    clips = spread(coded, "clip_id").groupBy("clip_id").agg(F.min("width").alias("width"), F.min("height").alias("height"), F.min("palette").alias("palette"), F.array_sort(F.collect_list(F.struct("frame_no", "image"))).alias("images"))

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        content = []
        for r in rows.itertuples(index=False):
            head = gif.header(int(r.width), int(r.height), None if local else np.frombuffer(r.palette, "<i4").tolist(), loop)
            content.append(head + b"".join(bytes(f["image"]) for f in r.images) + b"\x3b")
        return pd.DataFrame({"clip_id": rows["clip_id"], "content": content})

    return clips.mapInPandas(lambda parts: map(joined, parts), "clip_id long, content binary")


def encode_rgba(frames: DataFrame, mode: str = "quality", palette: str = "global", supplied: DataFrame | None = None, deltas: bool = False, threshold: int = 128, loop: int | None = None, encoder: str = "runs", compact: bool | None = None) -> DataFrame:
    """One GIF per clip: clip_id, content. compact (changed rectangles, cleared areas) is what quality mode does unless deltas,
    local or supplied palettes say otherwise; the other modes write whole frames."""
    check_options(mode, palette, encoder, loop, threshold, deltas, supplied is not None)
    bounded_batches(frames.sparkSession)
    f = frames if "delay" in frames.columns else frames.withColumn("delay", F.lit(0))
    f = f.select("clip_id", "frame_no", "width", "height", F.coalesce("delay", F.lit(0)).alias("delay"), "rgba")
    plan = plans(f, mode, palette, threshold) if supplied is None else supplied_plans(f, supplied, mode, threshold)
    if compact is None:
        compact = mode == "quality" and palette == "global" and supplied is None and not deltas
    kind = "local" if palette == "local" else "deltas" if deltas else "compact" if compact else "independent"
    return assemble(lay_out(indexed(f, plan, threshold), kind), "literal" if kind in ("local", "deltas") else encoder, loop, palette == "local")
