"""Layout of animation frames on one canvas: rectangles, disposal and pixels that need no drawing. numpy on index frames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

Box = tuple[int, int, int, int]


def bounds(mask: np.ndarray) -> Box | None:
    """Left, top, right, bottom (inclusive) of the set cells, or None."""
    rows = np.flatnonzero(mask.any(1))
    if not len(rows):
        return None
    columns = np.flatnonzero(mask.any(0))
    return int(columns[0]), int(rows[0]), int(columns[-1]), int(rows[-1])


def union(a: Box, b: Box) -> Box:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def area(box: Box) -> int:
    return (box[2] - box[0] + 1) * (box[3] - box[1] + 1)


def part(frame: np.ndarray, box: Box) -> np.ndarray:
    return frame[box[1] : box[3] + 1, box[0] : box[2] + 1]


@dataclass
class Placed:
    """A frame with its place; ``shown`` is the canvas that its decoder draws on, None for a whole frame."""

    number: int
    frame: np.ndarray
    box: Box
    disposal: int = 0
    shown: np.ndarray | None = None
    cleared: Box | None = None

    def own(self) -> bytes:
        return part(self.frame, self.box).tobytes()

    def filled(self, fill: int | None) -> bytes | None:
        """The rectangle with pixels that the canvas already shows marked as ``fill``; None where that can't pay.

        A marked pixel breaks a run that goes on over it, so pixels that continue the run before them keep their value.
        """
        if fill is None or self.shown is None or 4 * area(self.box) > 3 * self.frame.size:
            return None
        draw = self.frame != self.shown
        if self.cleared is not None:
            part(draw, self.cleared)[:] = True  # over a cleared canvas every pixel keeps its value
        own, draw = part(self.frame, self.box).ravel(), part(draw, self.box).ravel()
        run = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])
        drawn = np.maximum.accumulate(np.where(draw, np.arange(len(own)), -1))
        keeps = (drawn >= 0) & (run[drawn] == run)
        return np.where(keeps, own, np.uint8(fill)).astype(np.uint8).tobytes()


def independent(frames: Iterator[tuple[int, np.ndarray]], disposal: int) -> Iterator[Placed]:
    for number, frame in frames:
        yield Placed(number, frame, (0, 0, frame.shape[1] - 1, frame.shape[0] - 1), disposal)


def plain_deltas(frames: Iterator[tuple[int, np.ndarray]]) -> Iterator[Placed]:
    """Later frames shrink to their changed rectangle, unchanged ones to a pixel; nothing is disposed."""
    last = None
    for number, frame in frames:
        whole = (0, 0, frame.shape[1] - 1, frame.shape[0] - 1)
        yield Placed(number, frame, whole if last is None else bounds(frame != last) or (0, 0, 0, 0))
        last = frame


def compact(frames: Iterator[tuple[int, np.ndarray]], transparent: int | None) -> Iterator[Placed]:
    """Changed rectangles for clips whose pixels may turn transparent.

    Pixels that turn transparent are cleared by disposing the frame before to background, its rectangle grown to cover
    them; the frame then draws what it shows there again. The last frame clears what the first one does not show, for
    players that keep the canvas between rounds. Holds the first frame and two neighbours at a time.
    """
    first, held = None, None
    for number, frame in frames:
        whole = (0, 0, frame.shape[1] - 1, frame.shape[0] - 1)
        if held is None:
            first, held = frame, Placed(number, frame, whole)
            continue
        changed, cleared = frame != held.frame, None
        gone = None if transparent is None else bounds((frame == transparent) & (held.frame != transparent))
        if gone is None:
            held.disposal = 1
        else:
            held.disposal = 2
            cleared = held.box = union(held.box, whole if 4 * area(held.box) >= 3 * frame.size else gone)
            part(changed, cleared)[:] = part(frame, cleared) != transparent
        yield held
        held = Placed(number, frame, bounds(changed) or (0, 0, 0, 0), 1, held.frame, cleared)
    if held is None:
        return
    if held.shown is None:
        held.disposal = 2 if transparent is not None and (held.frame == transparent).any() else 0
    elif transparent is not None:
        gone = bounds((first == transparent) & (held.frame != transparent))
        if gone is not None:
            held.disposal, held.box = 2, union(held.box, gone)
    yield held
