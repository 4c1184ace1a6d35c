"""Adaptive palettes from aggregated histograms: median cut (two rules), variance-minimising cut, flat grid.

Pixels have shrunk to at most 32,768 cells a clip before any of these run, so a clip's group is bounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "clip_id long, cell long, idx long, rgb long"


def _mean(n: np.ndarray, sums: np.ndarray, half: bool = True) -> int:
    total = int(n.sum())
    r, g, b = ((int(s) + (total // 2 if half else 0)) // total for s in sums.sum(0))
    return r << 16 | g << 8 | b


def nearest_entry(colors: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Index of the entry at the least squared distance, the lowest on ties."""
    split = lambda v: np.stack([v >> 16, v >> 8 & 255, v & 255], 1)
    near, q = np.zeros(len(colors), np.int64), split(palette)
    for at in range(0, len(colors), 4096):
        part = split(colors[at : at + 4096])
        near[at : at + 4096] = ((part[:, None, :] - q[None, :, :]) ** 2).sum(2).argmin(1)
    return near


def _center(cells: np.ndarray, bits: int) -> np.ndarray:
    """The colour in the middle of the 4-bit cell that holds a cell."""
    mask = (1 << bits) - 1
    part = [(cells >> (2 - k) * bits & mask) << (8 - bits) for k in range(3)]
    r, g, b = ((p & 0xF0) | 8 for p in part)
    return r << 16 | g << 8 | b


def median_cut_boxes(cells: np.ndarray, n: np.ndarray, sums: np.ndarray, k: int, bits: int, last_wins: bool) -> list[np.ndarray]:
    """Boxes of cell numbers. The box with the largest weight times squared range is split at the weighted median of its widest axis."""
    mask = (1 << bits) - 1
    axes = np.stack([cells >> 2 * bits & mask, cells >> bits & mask, cells & mask], 1)
    boxes = [np.arange(len(cells))]

    def score(b: np.ndarray) -> int:
        return int(n[b].sum()) * int(np.ptp(axes[b], axis=0).max()) ** 2 if len(b) > 1 else 0

    scores = [score(boxes[0])]
    while len(boxes) < k and max(scores) > 0:
        top = max(scores)
        at = len(scores) - 1 - scores[::-1].index(top) if last_wins else scores.index(top)
        box = boxes.pop(at)
        scores.pop(at)
        axis = int(np.ptp(axes[box], axis=0).argmax())
        box = box[np.argsort(axes[box, axis], kind="stable")]
        half = np.cumsum(n[box])
        cut = min(max(int(np.searchsorted(half, half[-1] / 2)) + 1, 1), len(box) - 1)
        boxes[at:at] = [box[:cut], box[cut:]]
        scores[at:at] = [score(box[:cut]), score(box[cut:])]
    return boxes


def _by_clip(hist: DataFrame, plan, k: int) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cell")
        cells, n = rows["cell"].to_numpy(), rows["n"].to_numpy()
        idx, palette = plan(cells, n, rows[["sr", "sg", "sb"]].to_numpy(), k)
        return pd.DataFrame({"clip_id": rows["clip_id"].iloc[0], "cell": cells, "idx": idx, "rgb": palette[idx]})

    return hist.groupBy("clip_id").applyInPandas(run, SCHEMA)


# A plan takes one group's cells in ascending order with their counts and channel sums, and the number of entries. It gives
# each cell's index and the palette.


def _cell_means(n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    mean = (sums + (n // 2)[:, None]) // n[:, None]
    return mean[:, 0] << 16 | mean[:, 1] << 8 | mean[:, 2]


def direct_plan(cells: np.ndarray, n: np.ndarray, sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """An entry per cell."""
    return np.arange(len(cells)), _cell_means(n, sums)


def merge_plan(cells: np.ndarray, n: np.ndarray, sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """An entry per cell but the rarest (ties: the highest), which goes to the nearest."""
    rgb = _cell_means(n, sums)
    gone = np.lexsort((-cells, n))[0]
    rest = np.delete(np.arange(len(cells)), gone)
    idx = np.zeros(len(cells), np.int64)
    idx[rest] = np.arange(len(rest))
    idx[gone] = nearest_entry(rgb[[gone]], rgb[rest])[0]
    return idx, rgb[rest]


def dominant_plan(cells: np.ndarray, n: np.ndarray, sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k most frequent cells (ties: the lowest) as seeds, one step of weighted means, and the final assignment."""
    rgb = _cell_means(n, sums)
    seeds = rgb[np.lexsort((cells, -n))[:k]]
    at = nearest_entry(rgb, seeds)
    total = np.bincount(at, n, len(seeds)).astype(np.int64)
    parts = np.stack([np.bincount(at, sums[:, c], len(seeds)).astype(np.int64) for c in range(3)], 1)
    palette = _cell_means(np.maximum(total, 1), parts)
    return nearest_entry(rgb, palette), palette


def median_cut_plan(cells: np.ndarray, n: np.ndarray, sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """5-bit cells; every cell belongs to its own box."""
    boxes = median_cut_boxes(cells, n, sums, k, 5, last_wins=False)
    idx = np.zeros(len(cells), np.int64)
    for i, b in enumerate(boxes):
        idx[b] = i
    return idx, np.array([_mean(n[b], sums[b]) for b in boxes])


def median_cut_nearest_plan(cells: np.ndarray, n: np.ndarray, sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """5-bit cells; they take the entry nearest to the middle of their 4-bit cell."""
    boxes = median_cut_boxes(cells, n, sums, k, 5, last_wins=True)
    palette = np.array([_mean(n[b], sums[b]) for b in boxes])
    return nearest_entry(_center(cells, 5), palette), palette


def median_cut(hist: DataFrame, k: int = 256) -> DataFrame:
    """hist: clip_id and a 5-bit histogram."""
    return _by_clip(hist, median_cut_plan, k)


def median_cut_nearest(hist: DataFrame, k: int = 256) -> DataFrame:
    """hist: clip_id and a 5-bit histogram."""
    return _by_clip(hist, median_cut_nearest_plan, k)


def variance_cut_boxes(cells: np.ndarray, n: np.ndarray, sums: np.ndarray, k: int) -> list[tuple]:
    """Boxes (lo, hi per axis, lo exclusive) over 16**3 cells, cut where the between-part variance is largest; single precision."""
    m = np.zeros((4, 17, 17, 17), np.float64)
    sq = np.zeros((17, 17, 17), np.float32)
    r, g, b = (cells >> 8 & 15) + 1, (cells >> 4 & 15) + 1, (cells & 15) + 1
    m[0, r, g, b] = n
    for c in range(3):
        m[c + 1, r, g, b] = sums[:, c]
    mean = sums / n[:, None]
    sq[r, g, b] = (n * (mean**2).sum(1)).astype(np.float32)
    for axis in (1, 2, 3):
        m = m.cumsum(axis)
    for axis in (0, 1, 2):
        sq = sq.cumsum(axis, dtype=np.float32)

    def volume(t, box):
        (r0, r1), (g0, g1), (b0, b1) = box
        return t[..., r1, g1, b1] - t[..., r1, g1, b0] - t[..., r1, g0, b1] - t[..., r0, g1, b1] + t[..., r1, g0, b0] + t[..., r0, g1, b0] + t[..., r0, g0, b1] - t[..., r0, g0, b0]

    def variance(box) -> np.float32:
        v = volume(m, box)
        if v[0] <= 0 or all(hi - lo == 1 for lo, hi in box):
            return np.float32(0)
        return np.float32(volume(sq, box) - np.float32((v[1:] ** 2).sum() / v[0]))

    def cut(box):
        whole, best = volume(m, box), None
        for axis in range(3):
            lo, hi = box[axis]
            for at in range(lo + 1, hi):
                part = volume(m, [*box[:axis], (lo, at), *box[axis + 1 :]])
                rest = whole - part
                if part[0] > 0 and rest[0] > 0:
                    gain = np.float32((part[1:] ** 2).sum() / part[0]) + np.float32((rest[1:] ** 2).sum() / rest[0])
                    if best is None or gain > best[0]:
                        best = (gain, axis, at)
        return best

    boxes = [[(0, 16), (0, 16), (0, 16)]]
    scores = [variance(boxes[0])]
    while len(boxes) < k:
        at = int(np.argmax(scores))
        if scores[at] <= 0:
            break
        found = cut(boxes[at])
        if found is None:
            scores[at] = np.float32(0)
            continue
        _, axis, place = found
        lo, hi = boxes[at][axis]
        right = [*boxes[at][:axis], (place, hi), *boxes[at][axis + 1 :]]
        boxes[at] = [*boxes[at][:axis], (lo, place), *boxes[at][axis + 1 :]]
        boxes.append(right)
        scores[at], more = variance(boxes[at]), variance(right)
        scores.append(more)
    return boxes


def variance_cut_plan(cells: np.ndarray, n: np.ndarray, sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """4-bit cells; truncated box means sorted by colour; cells take the entry nearest to their middle."""
    axes = np.stack([cells >> 8 & 15, cells >> 4 & 15, cells & 15], 1)
    colors = []
    for box in variance_cut_boxes(cells, n, sums, k):
        inside = np.all([(axes[:, c] >= lo) & (axes[:, c] < hi) for c, (lo, hi) in enumerate(box)], 0)
        if inside.any():
            colors.append(_mean(n[inside], sums[inside], half=False))
    palette = np.array(sorted(set(colors)))
    return nearest_entry(_center(cells, 4), palette), palette


def flat_grid_plan(cells: np.ndarray, n: np.ndarray, sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """4-bit cells; levels per channel grow by the largest drop in variance while their product fits k."""
    axes = np.stack([cells >> 8 & 15, cells >> 4 & 15, cells & 15], 1)

    def loss(axis: int, levels: int) -> float:
        group = axes[:, axis] * levels // 16
        v = sums[:, axis] / n
        total = np.bincount(group, n, levels)
        first, second = np.bincount(group, n * v, levels), np.bincount(group, n * v * v, levels)
        return float((second - np.divide(first**2, total, out=np.zeros(levels), where=total > 0)).sum())

    levels = [1, 1, 1]
    while True:
        gains = [(loss(c, levels[c]) - loss(c, levels[c] + 1) if levels[c] < 16 and np.prod(levels) // levels[c] * (levels[c] + 1) <= k else -1.0) for c in range(3)]
        if max(gains) < 0:
            break
        levels[int(np.argmax(gains))] += 1
    key = np.zeros(len(cells), np.int64)
    for c in range(3):
        key = key * levels[c] + axes[:, c] * levels[c] // 16
    used, idx = np.unique(key, return_inverse=True)
    return idx, np.array([_mean(n[idx == i], sums[idx == i]) for i in range(len(used))])


def variance_cut(hist: DataFrame, k: int = 256) -> DataFrame:
    """hist: clip_id and a 4-bit histogram."""
    return _by_clip(hist, variance_cut_plan, k)


def flat_grid(hist: DataFrame, k: int = 256) -> DataFrame:
    """hist: clip_id and a 4-bit histogram."""
    return _by_clip(hist, flat_grid_plan, k)
