"""Index streams to LZW codes and back. Plain Python and numpy; called from Arrow functions, one frame at a time."""

from __future__ import annotations

import numpy as np


class LzwError(ValueError):
    """A code stream that a strict decoder refuses."""


def sub_blocks(data: bytes) -> bytes:
    """Length-prefixed blocks of at most 255 bytes and a terminator."""
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def join_blocks(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The concatenated blocks from position at on, and the position after the terminator."""
    parts = []
    while True:
        if at >= len(data):
            raise LzwError("unterminated sub-blocks")
        n = data[at]
        if n == 0:
            return b"".join(parts), at + 1
        if at + 1 + n > len(data):
            raise LzwError("sub-block past the end")
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _pack(codes: np.ndarray, width: int) -> bytes:
    bits = (codes.astype(np.uint16)[:, None] >> np.arange(width, dtype=np.uint16)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def encode_literal(indices: bytes, m: int) -> bytes:
    """One code of m + 1 bits per pixel, a clear before the table would widen the codes."""
    x, room = np.frombuffer(indices, np.uint8).astype(np.uint16), (1 << m) - 2
    clear = 1 << m
    groups = max(1, -(-len(x) // room))
    out = np.full(len(x) + groups + 1, clear, np.uint16)
    at = np.arange(len(x))
    out[at + at // room + 1] = x
    out[-1] = clear + 1
    return _pack(out, m + 1)


def literal_size(n: int, m: int) -> int:
    """Bytes of encode_literal(n pixels) in sub-blocks with the code size byte."""
    codes = n + max(1, -(-n // ((1 << m) - 2))) + 1
    data = -(-codes * (m + 1) // 8)
    return block_size(data)


def _run_codes(indices: bytes, m: int) -> list[int]:
    clear, limit = 1 << m, (1 << (m + 1)) - 1
    out, nxt, fresh = [clear], clear + 2, True

    def emit(code: int) -> None:
        nonlocal nxt, fresh
        out.append(code)
        nxt, fresh = nxt + (not fresh), False
        if nxt >= limit:
            out.append(clear)
            nxt, fresh = clear + 2, True

    x = np.frombuffer(indices, np.uint8)
    cuts = np.flatnonzero(np.diff(x)) + 1
    for start, end in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(x)]]), strict=True) if len(x) else ():
        value, left = int(x[start]), int(end - start)
        while left:
            if left < 4:
                emit(value)
                left -= 1
                continue
            emit(value)
            left -= 1
            first, size = nxt, 2
            while left and not fresh:
                if left >= size:
                    emit(first + size - 2)
                    left -= size
                    size += 1
                elif left >= 2:
                    emit(first + left - 2)
                    left = 0
                else:
                    break
    out.append(clear + 1)
    return out


def encode_runs(indices: bytes, m: int) -> bytes:
    """Codes of one width; a run of four or more uses the strings that the decoder builds from the run itself."""
    return _pack(np.array(_run_codes(indices, m)), m + 1)


def block_size(data: int) -> int:
    """Bytes of an image's data: code size, sub-blocks, terminator."""
    return 1 + data + -(-data // 255) + 1


def _equal_neighbours(indices: bytes) -> int:
    x = np.frombuffer(indices, np.uint8)
    return int((x[1:] == x[:-1]).sum())


def fastest(indices: bytes, m: int) -> tuple[int, bytes]:
    """Code size and run-aware stream. Wider codes have room for longer runs: they are taken where three in four pixels
    repeat, counted out where half do, and never beyond the literal stream of the palette's own size."""
    wide, equal = 7 if m < 7 else 8, _equal_neighbours(indices)
    own = None
    if m < 8 and len(indices) > 1 and 2 * equal >= len(indices):
        broad = encode_runs(indices, wide)
        if 4 * equal < 3 * len(indices):
            own = _run_codes(indices, m)
            narrow_bits, wide_bits = len(own) * (m + 1), len(_run_codes(indices, wide)) * (wide + 1)
            if wide_bits >= narrow_bits:
                return m, _pack(np.array(own), m + 1)
        if block_size(len(broad)) <= literal_size(len(indices), m):
            return wide, broad
    return m, encode_runs(indices, m) if own is None else _pack(np.array(own), m + 1)


def smallest(indices: bytes, m: int, filled: bytes | None = None) -> tuple[int, bytes]:
    """The shortest of the dictionary stream, the run-aware one, and the run-aware one of the pixels with unchanged ones filled in."""
    best = m, encode_dictionary(indices, m)
    # a run takes one code at least, so a dictionary stream below that bound can't be beaten
    if block_size(len(best[1])) > -(-(len(indices) - _equal_neighbours(indices)) * (m + 1) // 8) + 2:
        best = min(best, fastest(indices, m), key=lambda c: len(c[1]))
    return best if filled is None else min(best, fastest(filled, m), key=lambda c: len(c[1]))


def encode_dictionary(indices: bytes, m: int) -> bytes:
    """Greedy LZW with up to 4096 strings, cleared when full."""
    clear = 1 << m
    acc, filled, out, width = 0, 0, bytearray(), m + 1

    def put(code: int) -> None:
        nonlocal acc, filled
        acc |= code << filled
        filled += width
        while filled >= 8:
            out.append(acc & 255)
            acc >>= 8
            filled -= 8

    put(clear)
    table: dict[tuple[int, int], int] = {}
    nxt, prefix = clear + 2, -1
    for v in indices:
        if prefix < 0:
            prefix = v
            continue
        code = table.get((prefix, v))
        if code is not None:
            prefix = code
            continue
        put(prefix)
        if nxt < 4096:
            table[prefix, v] = nxt
            if nxt == 1 << width and width < 12:
                width += 1
            nxt += 1
        else:
            put(clear)
            table.clear()
            nxt, width = clear + 2, m + 1
        prefix = v
    if prefix >= 0:
        put(prefix)
        if nxt == 1 << width and width < 12:
            width += 1
    put(clear + 1)
    if filled:
        out.append(acc & 255)
    return bytes(out)


def decode(data: bytes, m: int, pixels: int, strict: bool = False, whole: bool = False) -> bytes:
    """Indices of a frame. Tolerant: a code beyond the table repeats the last string, surplus is dropped, a short stream is
    filled with 0. Strict: a bad code or surplus raises LzwError; a short stream is still filled with 0, unless ``whole``."""
    out = _decoded(data, m, pixels, strict)
    if whole and len(out) < pixels:
        raise LzwError("fewer pixels than the frame holds")
    return out + bytes(max(0, pixels - len(out)))


def _decoded(data: bytes, m: int, pixels: int, strict: bool) -> bytes:
    clear, eoi = 1 << m, (1 << m) + 1
    out = bytearray()
    table: list[bytes] = []
    width, last = m + 1, b""
    base = [bytes([k & 255]) for k in range(clear)] + [b"", b""]
    table = base.copy()
    acc = filled = 0
    for byte in data:
        acc |= byte << filled
        filled += 8
        while filled >= width:
            code = acc & ((1 << width) - 1)
            acc >>= width
            filled -= width
            if code == clear:
                table, width, last = base.copy(), m + 1, b""
                continue
            if code == eoi:
                return _fit(out, pixels, strict)
            if code < len(table):
                text = table[code]
            elif not last:
                if strict:
                    raise LzwError("first code is not a literal")
                return _fit(out, pixels, strict)
            else:
                if strict and code > len(table):
                    raise LzwError("code beyond the table")
                text = last + last[:1]
            if last and len(table) < 4096:
                table.append(last + text[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            out += text
            last = text
            if not strict and len(out) >= pixels:
                return bytes(out[:pixels])
    return _fit(out, pixels, strict)


def _fit(out: bytearray, pixels: int, strict: bool) -> bytes:
    if strict and len(out) > pixels:
        raise LzwError("more pixels than the frame holds")
    return bytes(out[:pixels])
