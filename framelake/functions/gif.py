"""The GIF container: three readers, writers and byte-level edits. Plain Python on one file at a time."""

from __future__ import annotations

from . import lzw


class GifError(ValueError):
    """A file that the reader in use refuses."""


def u16(data: bytes, at: int) -> int:
    if at + 2 > len(data):
        raise GifError("truncated file")
    return data[at] | data[at + 1] << 8


def padded_colors(n: int) -> int:
    """Size of the table that holds n colours: a power of two, 2 at least."""
    if not 1 <= n <= 256:
        raise GifError("a palette has 1 to 256 colours")
    return max(2, 1 << (n - 1).bit_length())


def _skip(data: bytes, at: int) -> int:
    while True:
        if at >= len(data):
            raise GifError("unterminated sub-blocks")
        n = data[at]
        at += 1 + n
        if n == 0:
            return at


def parse(data: bytes, mode: str = "strict") -> dict:
    """Screen, global table, loop count, and per frame its rectangle, control values, palette and byte ranges.

    strict: trailer required and last, one frame at least, no empty canvas or frame, code size 2..8, a palette for every
    frame, known extensions only, loops from NETSCAPE2.0. lenient: none of these; ANIMEXTS1.0 loops count too. layout:
    for editing - the trailer is required, what follows it is ignored, plain text uses up the pending control.
    """
    strict, layout = mode == "strict", mode == "layout"
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("not a GIF")
    if len(data) < 13:
        raise GifError("truncated header")
    out = {"version": data[3:6].decode(), "width": u16(data, 6), "height": u16(data, 8), "loop_count": None, "global_offset": None, "global_size": 0, "loop_at": [], "frames": [], "ended": False, "odd": 0}
    if strict and not (out["width"] and out["height"]):
        raise GifError("empty canvas")
    at = 13
    if data[10] & 0x80:
        out["global_offset"], out["global_size"] = 13, 2 << (data[10] & 7)
        at += 3 * out["global_size"]
        if at > len(data):
            raise GifError("truncated palette")
    out["after_global"] = at
    blank = {"delay": 0, "disposal": 0, "transparent": None, "control_at": None}
    control = dict(blank)
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            out["ended"], out["trailer_at"] = True, at
            if strict and at + 1 != len(data):
                raise GifError("bytes after the trailer")
            break
        if kind == 0x21:
            if at + 1 >= len(data):
                raise GifError("truncated extension")
            label = data[at + 1]
            if label == 0xF9:
                if at + 8 > len(data) or data[at + 2] != 4 or data[at + 7] != 0:
                    raise GifError("bad graphic control")
                if control["control_at"] is not None:
                    out["odd"] += 1
                packed = data[at + 3]
                control = {"delay": u16(data, at + 4), "disposal": packed >> 2 & 7, "transparent": data[at + 6] if packed & 1 else None, "control_at": at}
                at += 8
            elif label == 0xFF:
                end = _skip(data, at + 2)
                name = data[at + 3 : at + 14]
                names = (b"NETSCAPE2.0",) if strict else (b"NETSCAPE2.0", b"ANIMEXTS1.0")
                if data[at + 2] == 11 and name in names:
                    size = data[at + 14]
                    if data[at + 15 : at + 16] == b"\1" and (size >= 3 if strict else size == 3):
                        out["loop_count"] = u16(data, at + 16)
                        out["loop_at"].append(at + 16)
                at = end
            elif label in (0xFE, 0x01) or not strict:
                if label == 0x01:
                    out["odd"] += 1
                    if layout:
                        control = dict(blank)
                at = _skip(data, at + 2)
            else:
                raise GifError("unknown extension")
        elif kind == 0x2C:
            if at + 10 > len(data):
                raise GifError("truncated image descriptor")
            f = {"x": u16(data, at + 1), "y": u16(data, at + 3), "width": u16(data, at + 5), "height": u16(data, at + 7), **control, "image_at": at}
            packed, start = data[at + 9], at
            f["interlaced"], f["local"] = bool(packed & 0x40), bool(packed & 0x80)
            if not layout and (f["x"] + f["width"] > out["width"] or f["y"] + f["height"] > out["height"]):
                raise GifError("frame outside the screen")
            if strict and not (f["width"] and f["height"]):
                raise GifError("empty frame")
            at += 10
            if f["local"]:
                f["palette_offset"], f["palette_size"] = at, 2 << (packed & 7)
                at += 3 * f["palette_size"]
            else:
                f["palette_offset"], f["palette_size"] = out["global_offset"], out["global_size"]
            if strict and f["palette_offset"] is None:
                raise GifError("no palette")
            if at >= len(data):
                raise GifError("truncated image")
            f["min_code_size"] = data[at]
            if strict and not 2 <= f["min_code_size"] <= 8:
                raise GifError("bad code size")
            f["data_offset"] = at + 1
            at = _skip(data, at + 1)
            f["data_length"], f["end"] = at - f["data_offset"], at
            f["start"] = f["control_at"] if f["control_at"] is not None else start
            out["frames"].append(f)
            control = dict(blank)
        else:
            raise GifError("unknown block")
    if (strict or layout) and not out["ended"]:
        raise GifError("no trailer")
    if strict and not out["frames"]:
        raise GifError("no frames")
    return out


#: Row order of interlaced images: (first row, step) of the four passes.
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


def deinterlace(indices: bytes, width: int, height: int) -> bytes:
    rows = [y for start, step in PASSES for y in range(start, height, step)]
    out = bytearray(len(indices))
    for k, y in enumerate(rows):
        out[y * width : (y + 1) * width] = indices[k * width : (k + 1) * width]
    return bytes(out)


def frame_indices(data: bytes, frame: dict, strict: bool = False) -> bytes:
    codes, _ = lzw.join_blocks(data, frame["data_offset"])
    out = lzw.decode(codes, frame["min_code_size"], frame["width"] * frame["height"], strict)
    return deinterlace(out, frame["width"], frame["height"]) if frame["interlaced"] else out


def table_bytes(palette: list[int]) -> bytes:
    n = padded_colors(len(palette))
    return b"".join(v.to_bytes(3, "big") for v in palette) + bytes(3 * (n - len(palette)))


def header(width: int, height: int, palette: list[int] | None, loop: int | None) -> bytes:
    bits = (padded_colors(len(palette)) - 1).bit_length() - 1 if palette else 0
    out = b"GIF89a" + width.to_bytes(2, "little") + height.to_bytes(2, "little") + bytes([(0x80 | 0x70 | bits) if palette else 0x70, 0, 0])
    return out + (table_bytes(palette) if palette else b"") + (loop_block(loop) if loop is not None else b"")


def loop_block(loop: int) -> bytes:
    return b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + loop.to_bytes(2, "little") + b"\0"


def control_block(delay: int, disposal: int = 0, transparent: int | None = None) -> bytes:
    return bytes([0x21, 0xF9, 4, disposal << 2 | (transparent is not None)]) + delay.to_bytes(2, "little") + bytes([transparent or 0, 0])


ENCODERS = {"literal": lzw.encode_literal, "runs": lzw.encode_runs, "dictionary": lzw.encode_dictionary}


def compressed(indices: bytes, m: int, encoder: str, filled: bytes | None = None) -> tuple[int, bytes]:
    """Code size and stream of one image; filled: the same image with pixels that need no drawing marked."""
    if encoder == "literal":
        return m, lzw.encode_literal(indices, m)
    if encoder == "runs":
        return lzw.fastest(indices if filled is None else filled, m)
    return lzw.smallest(indices, m, filled)


def code_size(colors: int) -> int:
    return max(2, (padded_colors(colors) - 1).bit_length())


def image(x: int, y: int, width: int, height: int, indices: bytes, colors: int, encoder: str = "runs", local: list[int] | None = None, filled: bytes | None = None) -> bytes:
    """One image; encoder is literal, runs or dictionary (the shortest stream)."""
    m, codes = compressed(indices, code_size(colors), encoder, filled)
    packed = 0x80 | ((padded_colors(len(local)) - 1).bit_length() - 1) if local else 0
    head = b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (x, y, width, height)) + bytes([packed])
    return head + (table_bytes(local) if local else b"") + bytes([m]) + lzw.sub_blocks(codes)


def write(width: int, height: int, palette: list[int] | None, frames: list[dict], loop: int | None = None, encoder: str = "runs") -> bytes:
    """A GIF from indexed frames: dicts with indices, delay and optionally x, y, width, height, disposal, transparent, palette."""
    out = [header(width, height, palette, loop)]
    for f in frames:
        w, h = f.get("width", width), f.get("height", height)
        colors = f.get("palette") or palette
        if len(f["indices"]) != w * h:
            raise GifError("a frame has width * height indices")
        if max(f["indices"], default=0) >= padded_colors(len(colors)):
            raise GifError("index beyond the palette")
        out.append(control_block(f.get("delay", 0), f.get("disposal", 0), f.get("transparent")))
        out.append(image(f.get("x", 0), f.get("y", 0), w, h, f["indices"], len(colors), encoder, f.get("palette")))
    return b"".join(out) + b"\x3b"


class Writer:
    """A file frame by frame. ``file`` may be asked for at any time; frames can be added after it."""

    def __init__(self, width: int, height: int, palette: list[int] | None = None, loop: int | None = None, encoder: str = "runs"):
        if not (1 <= width <= 65535 and 1 <= height <= 65535):
            raise GifError("width and height are 1 to 65535")
        self.width, self.height, self.palette, self.encoder = width, height, palette, encoder
        self.parts = [header(width, height, palette, loop)]
        #: What the canvas shows by indices of the global palette; None where a frame was disposed or had its own palette.
        self.canvas: bytearray | None = None

    def add(self, indices: bytes, x: int = 0, y: int = 0, width: int | None = None, height: int | None = None, delay: int = 0, disposal: int = 0, transparent: int | None = None, palette: list[int] | None = None) -> None:
        width, height = width or self.width, height or self.height
        colors = palette or self.palette
        if not colors:
            raise GifError("a frame needs a palette")
        if x < 0 or y < 0 or x + width > self.width or y + height > self.height:
            raise GifError("frame outside the screen")
        if len(indices) != width * height or max(indices, default=0) >= padded_colors(len(colors)):
            raise GifError("a frame has width * height indices of its palette")
        if not (0 <= delay <= 65535 and 0 <= disposal <= 7) or (transparent is not None and not 0 <= transparent < padded_colors(len(colors))):
            raise GifError("delay, disposal or transparent index out of range")
        self.parts += [control_block(delay, disposal, transparent), image(x, y, width, height, indices, len(colors), self.encoder, palette)]
        if palette or disposal in (2, 3):
            self.canvas = None
            return
        self.canvas = self.canvas or bytearray(self.width * self.height)
        for row in range(height):
            at = (y + row) * self.width + x
            line = indices[row * width : (row + 1) * width]
            self.canvas[at : at + width] = line if transparent is None else bytes(o if v == transparent else v for v, o in zip(line, self.canvas[at : at + width], strict=True))

    def add_delta(self, indices: bytes, delay: int = 0, transparent: int | None = None) -> None:
        """A whole frame, written as its changed rectangle where the canvas is known, as one pixel where nothing changed."""
        if len(indices) != self.width * self.height:
            raise GifError("a delta is told by a whole frame")
        if self.canvas is None:
            return self.add(indices, delay=delay, transparent=transparent)
        changed = [k for k, (a, b) in enumerate(zip(indices, self.canvas, strict=True)) if a != b] or [0]
        rows, columns = [k // self.width for k in changed], [k % self.width for k in changed]
        x, y, width, height = min(columns), min(rows), max(columns) - min(columns) + 1, max(rows) - min(rows) + 1
        part = b"".join(indices[(y + r) * self.width + x :][:width] for r in range(height))
        self.add(part, x, y, width, height, delay, 0, transparent)

    def file(self) -> bytes:
        return b"".join(self.parts) + b"\x3b"


# ---- edits ----


def _spliced(data: bytes, patches: dict[int, bytes], inserts: list[tuple[int, bytes]]) -> bytes:
    """Patches overwrite in place, inserts go before their offset in the order given."""
    out, at = [], 0
    events = sorted([(k, 1, n, v) for n, (k, v) in enumerate(patches.items())] + [(k, 0, n, v) for n, (k, v) in enumerate(inserts)], key=lambda e: e[:3])
    for k, patch, _, v in events:
        out += [data[at:k], v]
        at = k + len(v) * patch
    return b"".join(out) + data[at:]


def retime(data: bytes, delays: list[int] | int) -> bytes:
    """New delays; a frame without a control block gets one, and only then an 87a file becomes 89a."""
    g = parse(data, "layout")
    each = [delays] * len(g["frames"]) if isinstance(delays, int) else list(delays)
    if len(each) != len(g["frames"]):
        raise GifError("one delay per frame")
    if any(not 0 <= d <= 65535 for d in each):
        raise GifError("a delay is 0 to 65535")
    patches, inserts = {}, []
    for f, d in zip(g["frames"], each, strict=True):
        if f["control_at"] is None:
            inserts.append((f["image_at"], control_block(d)))
        else:
            patches[f["control_at"] + 4] = d.to_bytes(2, "little")
    if inserts and g["version"] == "87a":
        patches[3] = b"89a"
    return _spliced(data, patches, inserts)


def set_loop(data: bytes, loop: int) -> bytes:
    """Every loop extension patched, or one inserted after the global table."""
    if isinstance(loop, bool) or not isinstance(loop, int) or not 0 <= loop <= 65535:
        raise GifError("a loop count is 0 to 65535")
    g = parse(data, "layout")
    if g["loop_at"]:
        return _spliced(data, {k: loop.to_bytes(2, "little") for k in g["loop_at"]}, [])
    return _spliced(data, {3: b"89a"} if g["version"] == "87a" else {}, [(g["after_global"], loop_block(loop))])


#: What each frame must be for an edit of the order: the reason for refusing the first that is not, and its test on (file, frame, the one before).
_MOVABLE = (
    ("frame without a control block", lambda g, f, last: f["control_at"] is not None),
    ("extension between a control block and its image", lambda g, f, last: f["control_at"] + 8 == f["image_at"]),
    ("frame does not cover the canvas", lambda g, f, last: (f["x"], f["y"], f["width"], f["height"]) == (0, 0, g["width"], g["height"])),
    ("unknown disposal", lambda g, f, last: f["disposal"] <= 3),
    ("data between frames", lambda g, f, last: last is None or last["end"] == f["control_at"]),
)


def reorder_refusal(data: bytes) -> str | None:
    """Why frames can't be put in another order, or None. A frame may move if it looks the same after any other one."""
    g = parse(data, "layout")
    frames = g["frames"]
    if not frames:
        return "no frames"
    if g["odd"]:
        return "plain text or stray control"
    for last, f in zip([None, *frames], frames):
        for why, holds in _MOVABLE:
            if not holds(g, f, last):
                return why
    if g["trailer_at"] != frames[-1]["end"]:
        return "data after the last frame"
    if any(f["transparent"] is not None for f in frames) and not all(f["disposal"] in (2, 3) for f in frames):
        return "transparent frame over one that stays on the canvas"
    return None


def reorder(data: bytes, order: list[int]) -> bytes:
    """Frames copied as bytes in the order given; repeats allowed."""
    why = reorder_refusal(data)
    if why:
        raise GifError(why)
    frames = parse(data, "layout")["frames"]
    if not order or any(not 0 <= k < len(frames) for k in order):
        raise GifError("order holds frame numbers")
    return data[: frames[0]["start"]] + b"".join(data[frames[k]["start"] : frames[k]["end"]] for k in order) + data[frames[-1]["end"] :]


def reverse(data: bytes) -> bytes:
    return reorder(data, list(range(len(parse(data, "layout")["frames"])))[::-1])


def boomerang(data: bytes) -> bytes:
    order = list(range(len(parse(data, "layout")["frames"])))
    return reorder(data, order + order[::-1])


def _rewritten(data: bytes, body) -> bytes:
    g = parse(data, "lenient")
    palette = data[g["global_offset"] : g["after_global"]] if g["global_size"] else b""
    out = [b"GIF89a" + data[6:13] + palette]
    if g["loop_count"] is not None:
        out.append(loop_block(g["loop_count"]))
    for f in g["frames"]:
        out.append(control_block(f["delay"], f["disposal"], f["transparent"]))
        out.append(body(f))
    return b"".join(out) + b"\x3b"


def remux(data: bytes) -> bytes:
    """The container written anew around the same compressed images; other extensions go."""
    return _rewritten(data, lambda f: data[f["image_at"] : f["end"]])


def reencode(data: bytes) -> bytes:
    """Every image decoded and written as a literal stream, not interlaced."""

    def body(f: dict) -> bytes:
        head = bytearray(data[f["image_at"] : f["data_offset"]])
        head[9] &= ~0x40
        m = head[-1] = max(2, f["min_code_size"])
        return bytes(head) + lzw.sub_blocks(lzw.encode_literal(frame_indices(data, f, strict=True), m))

    return _rewritten(data, body)
