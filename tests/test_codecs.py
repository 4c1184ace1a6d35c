"""LZW and container: round trips, readers' rules, edits that leave compressed bytes alone."""

import pytest
from framelake.functions import gif, lzw
from hypothesis import given, settings
from hypothesis import strategies as st

PALETTE = [0x000000, 0xFF0000, 0x00FF00, 0x0000FF]
streams = st.integers(2, 8).flatmap(lambda m: st.tuples(st.just(m), st.lists(st.tuples(st.integers(0, (1 << m) - 1), st.integers(1, 300)), max_size=40)))


@settings(max_examples=150, deadline=None)
@given(streams)
def test_every_encoder_round_trips(case):
    m, runs = case
    x = b"".join(bytes([v]) * n for v, n in runs)
    for encode in gif.ENCODERS.values():
        assert lzw.decode(encode(x, m), m, len(x), strict=True) == x
    assert 1 + len(lzw.sub_blocks(lzw.encode_literal(x, m))) == lzw.literal_size(len(x), m)


def test_many_entries_widen_and_clear():
    x = bytes((i * i * 7 + i // 3) % 251 for i in range(60000))
    assert lzw.decode(lzw.encode_dictionary(x, 8), 8, len(x), strict=True) == x


def test_tolerant_and_strict_decoding_differ():
    broken = lzw._pack(__import__("numpy").array([4, 1, 7, 5]), 3)
    assert lzw.decode(broken, 2, 3) == bytes([1, 1, 1])
    with pytest.raises(lzw.LzwError):
        lzw.decode(broken, 2, 3, strict=True)
    assert lzw.decode(lzw.encode_literal(b"\1\2", 2), 2, 5) == b"\1\2\0\0\0"
    with pytest.raises(lzw.LzwError):
        lzw.decode(lzw.encode_literal(b"\1\2\3", 2), 2, 2, strict=True)


def pair(transparent=None, disposal=0, width=2):
    a, b = bytes([0, 1, 1, 0][: 2 * width]), bytes([1, 0, 0, 1][: 2 * width])
    f = {"width": width, "height": 2, "transparent": transparent, "disposal": disposal}
    return gif.write(2, 2, [0x000000, 0xFFFFFF], [{"indices": a, "delay": 4, **f}, {"indices": b, "delay": 9, **f}], loop=None)


def test_edits():
    g = pair()
    frames = gif.parse(g)["frames"]
    data = [g[f["image_at"] : f["end"]] for f in frames]
    again = gif.retime(g, [5, 6])
    assert [f["delay"] for f in gif.parse(again)["frames"]] == [5, 6] and len(again) == len(g)
    looped = gif.set_loop(g, 3)
    assert gif.parse(looped)["loop_count"] == 3 and gif.parse(gif.set_loop(looped, 0))["loop_count"] == 0 and len(gif.set_loop(looped, 0)) == len(looped)
    for edit, order in ((gif.reverse, [1, 0]), (gif.boomerang, [0, 1, 1, 0])):
        out = edit(g)
        assert [out[f["image_at"] : f["end"]] for f in gif.parse(out)["frames"]] == [data[k] for k in order]
    for rewrite in (gif.remux, gif.reencode):
        out = rewrite(looped)
        assert gif.parse(out)["loop_count"] == 3
        assert [gif.frame_indices(out, f, True) for f in gif.parse(out)["frames"]] == [gif.frame_indices(g, f) for f in frames]


def test_retime_inserts_controls_and_promotes_the_version():
    g = bytearray(pair())
    for f in reversed(gif.parse(bytes(g))["frames"]):
        del g[f["control_at"] : f["image_at"]]
    g[3:6] = b"87a"
    out = gif.retime(bytes(g), 8)
    assert out[:6] == b"GIF89a" and [f["delay"] for f in gif.parse(out)["frames"]] == [8, 8]


def spliced(g, at, piece):
    return g[:at] + piece + g[at:]


def without_control(g, k):
    f = gif.parse(g)["frames"][k]
    return g[: f["control_at"]] + g[f["image_at"] :]


COMMENT = b"\x21\xfe\x02hi\0"
FRAMES = gif.parse(pair())["frames"]


@pytest.mark.parametrize("data, why", [
    (pair(transparent=0), "transparent"),
    (pair(transparent=0, disposal=1), "transparent"),
    (gif.write(2, 2, PALETTE, [{"indices": bytes(4), "disposal": 1}, {"indices": bytes(4), "disposal": 2, "transparent": 0}]), "transparent"),
    (pair(width=1), "cover"),
    (pair(disposal=5), "disposal"),
    (without_control(pair(), 1), "control block"),
    (without_control(pair(), 0), "control block"),
    (spliced(pair(), FRAMES[1]["image_at"], COMMENT), "between a control block and its image"),
    (spliced(pair(), FRAMES[1]["control_at"], COMMENT), "between frames"),
    (spliced(pair(), len(pair()) - 1, COMMENT), "after the last frame"),
    (spliced(pair(), FRAMES[0]["control_at"], gif.control_block(3)), "stray control"),
    (spliced(pair(), FRAMES[1]["control_at"], b"\x21\x01\x0c" + bytes(12) + b"\x01a\0"), "plain text"),
    (gif.header(2, 2, PALETTE, None) + b";", "no frames"),
])
def test_reorder_refusals(data, why):
    assert why in gif.reorder_refusal(data)
    with pytest.raises(gif.GifError):
        gif.reverse(data)


def test_metadata_before_the_first_frame_stays_where_it_is():
    g = spliced(pair(), FRAMES[0]["control_at"], COMMENT)
    assert gif.reverse(g)[: FRAMES[0]["control_at"] + len(COMMENT)].endswith(COMMENT)
    opaque = gif.write(2, 2, PALETTE, [{"indices": bytes(4), "disposal": k} for k in range(4)])
    assert gif.reorder_refusal(opaque) is None


@pytest.mark.parametrize("loop", [-1, 65536, 1.5, True, "3", None])
def test_loop_counts_out_of_range(loop):
    with pytest.raises(gif.GifError):
        gif.set_loop(pair(), loop)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 60)), min_size=1, max_size=30), st.integers(2, 7))
def test_chosen_code_sizes_come_back_and_never_beat_themselves(runs, m):
    x = b"".join(bytes([v]) * n for v, n in runs)
    for size, codes in (lzw.fastest(x, m), lzw.smallest(x, m), lzw.smallest(x, m, x[::-1])):
        assert lzw.decode(codes, size, len(x), strict=True) in (x, x[::-1]) and size in (m, 7, 8)
    literal = lzw.literal_size(len(x), m)
    assert lzw.block_size(len(lzw.fastest(x, m)[1])) <= literal
    assert len(lzw.smallest(x, m)[1]) <= min(len(lzw.fastest(x, m)[1]), len(lzw.encode_dictionary(x, m)))
    assert lzw.fastest(bytes(400), 2)[0] == 7 and lzw.fastest(bytes(range(4)) * 50, 2)[0] == 2


def test_transparent_frames_that_restore_may_be_reordered():
    assert gif.reorder_refusal(pair(transparent=0, disposal=2)) is None


def test_readers_disagree_where_they_should():
    g = pair()
    for bad in (b"GIF88a" + g[6:], g[:9], g[:-6]):
        with pytest.raises(gif.GifError):
            gif.parse(bad)
    tail = g + b"xx"
    with pytest.raises(gif.GifError):
        gif.parse(tail)
    assert len(gif.parse(tail, "lenient")["frames"]) == len(gif.parse(tail, "layout")["frames"]) == 2
    with pytest.raises(gif.GifError):
        gif.parse(g[:-1])
    assert len(gif.parse(g[:-1], "lenient")["frames"]) == 2
    empty = gif.header(2, 2, PALETTE, None) + b";"
    with pytest.raises(gif.GifError):
        gif.parse(empty)
    assert gif.parse(empty, "lenient")["frames"] == []
    anim = g[:19] + b"\x21\xff\x0bANIMEXTS1.0\x03\x01\x07\0\0" + g[19:]
    assert gif.parse(anim)["loop_count"] is None and gif.parse(anim, "lenient")["loop_count"] == 7
    odd = g[:19] + b"\x21\x99\x01a\0" + g[19:]
    with pytest.raises(gif.GifError):
        gif.parse(odd)
    assert len(gif.parse(odd, "lenient")["frames"]) == 2


def test_interlace():
    w, h = 3, 11
    rows = [bytes([y]) * w for y in range(h)]
    stored = b"".join(rows[y] for start, step in gif.PASSES for y in range(start, h, step))
    assert gif.deinterlace(stored, w, h) == b"".join(rows)


def test_writer_checks():
    with pytest.raises(gif.GifError):
        gif.write(2, 2, PALETTE, [{"indices": b"\0\0\0"}])
    with pytest.raises(gif.GifError):
        gif.write(1, 1, PALETTE, [{"indices": b"\4"}])
    assert gif.padded_colors(1) == 2 and gif.padded_colors(5) == 8


def test_short_streams_can_be_an_error():
    codes = lzw.encode_literal(bytes([1, 2, 3]), 2)
    assert lzw.decode(codes, 2, 5, strict=True) == bytes([1, 2, 3, 0, 0])
    with pytest.raises(lzw.LzwError):
        lzw.decode(codes, 2, 5, strict=True, whole=True)
    assert lzw.decode(codes, 2, 3, strict=True, whole=True) == bytes([1, 2, 3])


def test_writer_adds_frames_and_deltas_and_goes_on_after_the_end():
    w = gif.Writer(3, 2, PALETTE, loop=2)
    one = bytes([1, 1, 1, 2, 2, 2])
    w.add_delta(one, delay=4)
    w.add_delta(one)
    first = w.file()
    w.add_delta(bytes([1, 1, 3, 2, 2, 0]))
    w.add(bytes([2]), 1, 1, 1, 1, disposal=2)
    w.add_delta(one)
    boxes = lambda d: [(f["x"], f["y"], f["width"], f["height"]) for f in gif.parse(d)["frames"]]
    assert boxes(first) == [(0, 0, 3, 2), (0, 0, 1, 1)] and boxes(w.file()) == [(0, 0, 3, 2), (0, 0, 1, 1), (2, 0, 1, 2), (1, 1, 1, 1), (0, 0, 3, 2)]
    assert gif.parse(first)["loop_count"] == 2 and w.file().startswith(first[:-1])
    for bad in ({"indices": one, "x": 1}, {"indices": one[:5]}, {"indices": bytes([9] * 6)}, {"indices": one, "delay": -1}, {"indices": one, "transparent": 4}):
        with pytest.raises(gif.GifError):
            w.add(**bad)
    with pytest.raises(gif.GifError):
        gif.Writer(2, 2).add(bytes(4))
    with pytest.raises(gif.GifError):
        gif.Writer(0, 2, PALETTE)
    local = gif.Writer(2, 1)
    local.add(bytes([0, 1]), palette=[5, 6])
    assert gif.parse(local.file())["frames"][0]["local"] and local.canvas is None
