"""Pixel statistics in numpy, and one fused Arrow function that computes them all for a frame.

Frames are planes of bytes: luma (h x w) and rgb (h x w x 3). Everything is
vectorised; the only loops are over labels, blocks or angles, never over pixels.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[int, int, int, int]  # x0, y0, x1, y1, the last two exclusive


def full(img: np.ndarray) -> Box:
    return 0, 0, img.shape[1], img.shape[0]


def lower(img: np.ndarray, top: float = 0.5) -> Box:
    return 0, int(img.shape[0] * top), img.shape[1], img.shape[0]


def crop(img: np.ndarray, box: Box, stride: int = 1) -> np.ndarray:
    return img[box[1] : box[3] : stride, box[0] : box[2] : stride]


def histogram(img: np.ndarray, box: Box | None = None, stride: int = 1) -> np.ndarray:
    return np.bincount(crop(img, box or full(img), stride).ravel(), minlength=256)


def hist_percentile(hist: np.ndarray, p: float) -> int:
    """The first value at which the running count reaches trunc(n p)."""
    total = int(hist.sum())
    return int(np.searchsorted(np.cumsum(hist), int(total * p), "left")) if total else 0


def luma_stats(img: np.ndarray, box: Box | None = None, stride: int = 1) -> dict[str, float]:
    """mean, std, shares of values <= 16 and >= 240, p50, p95; zeros without pixels."""
    hist = histogram(img, box, stride)
    n = int(hist.sum())
    if not n:
        return dict.fromkeys(("mean", "std", "clip_low", "clip_high", "p50", "p95"), 0.0)
    v = np.arange(256)
    mean = float((v * hist).sum()) / n
    var = float((v * v * hist).sum()) / n - mean * mean
    return {"mean": mean, "std": max(var, 0.0) ** 0.5, "clip_low": float(hist[:17].sum()) / n, "clip_high": float(hist[240:].sum()) / n, "p50": hist_percentile(hist, 0.5), "p95": hist_percentile(hist, 0.95)}


def _inner(img: np.ndarray, box: Box, stride: int = 1) -> tuple[slice, slice]:
    """The pixels of box that have neighbours on all sides."""
    h, w = img.shape
    return slice(max(1, box[1]), min(h - 1, box[3]), stride), slice(max(1, box[0]), min(w - 1, box[2]), stride)


def _shift(img: np.ndarray, ys: slice, xs: slice, dy: int, dx: int) -> np.ndarray:
    return img[ys.start + dy : max(ys.stop, ys.start) + dy : ys.step, xs.start + dx : max(xs.stop, xs.start) + dx : xs.step].astype(np.int32)


def laplacian_variance(img: np.ndarray, box: Box | None = None) -> float:
    ys, xs = _inner(img, box or full(img))
    at = lambda dy, dx: _shift(img, ys, xs, dy, dx)
    lap = at(0, -1) + at(0, 1) + at(-1, 0) + at(1, 0) - 4 * at(0, 0)
    return float(lap.var()) if lap.size >= 2 else 0.0


def sharpness_grid(img: np.ndarray, cols: int = 8, rows: int = 6) -> list[float]:
    """laplacian_variance of each block, row by row; the Laplacian is taken once, and blocks of one size at once."""
    bh, bw = img.shape[0] // rows, img.shape[1] // cols
    wide = img.astype(np.int32)
    lap = wide[1:-1, :-2] + wide[1:-1, 2:] + wide[:-2, 1:-1] + wide[2:, 1:-1] - 4 * wide[1:-1, 1:-1]
    # lap begins at pixel (1, 1)
    spans = lambda n, size, most: [(max(1, i * size) - 1, max(0, min(most - 1, (i + 1) * size) - 1)) for i in range(n)]
    of_size: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    for r, (y0, y1) in enumerate(spans(rows, bh, img.shape[0])):
        for c, (x0, x1) in enumerate(spans(cols, bw, img.shape[1])):
            block = lap[y0:y1, x0:x1]
            of_size.setdefault(block.shape, []).append((r * cols + c, block))
    out = [0.0] * (rows * cols)
    for (h, w), blocks in of_size.items():
        if h * w >= 2:
            for (i, _), v in zip(blocks, np.stack([x for _, x in blocks]).reshape(len(blocks), -1).var(1), strict=True):
                out[i] = float(v)
    return out


def sobel(img: np.ndarray, box: Box | None = None, bins: int = 18, stride: int = 1) -> dict:
    """edge_energy, hist (shares of magnitude by gradient angle, 0 to 180 degrees), horizontal and vertical shares."""
    ys, xs = _inner(img, box or full(img), stride)
    at = lambda dy, dx: _shift(img, ys, xs, dy, dx)
    gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    mag = np.hypot(gx, gy)
    strong = mag > 32
    angle = np.degrees(np.arctan2(gy[strong], gx[strong])) % 180.0
    hist = np.bincount(np.clip((angle / 180.0 * bins).astype(int), 0, bins - 1), mag[strong], bins)
    total = max(1.0, float(np.abs(gx).sum() + np.abs(gy).sum()))
    energy = float(mag.mean()) / 255.0 if mag.size else 0.0
    return {"edge_energy": min(energy, 1.0), "hist": hist / hist.sum() if hist.sum() > 0 else hist, "horizontal": float(np.abs(gx).sum()) / total, "vertical": float(np.abs(gy).sum()) / total}


def hough(img: np.ndarray, box: Box, mask: np.ndarray | None = None, least: int = 48, stride: int = 2, theta: tuple[int, int, int] = (40, 140, 5)) -> tuple[int, float]:
    """(number of lines, at most 12; confidence) by votes of strong edge pixels, angles of normals in theta."""
    ys, xs = _inner(img, box, stride)
    at = lambda dy, dx: _shift(img, ys, xs, dy, dx)
    gx, gy = at(0, 1) - at(0, -1), at(1, 0) - at(-1, 0)
    vote = gx * gx + gy * gy >= least * least
    if mask is not None and vote.size:
        vote &= mask[ys.start - box[1] : ys.stop - box[1] : stride, xs.start - box[0] : xs.stop - box[0] : stride]
    y, x = np.nonzero(vote)
    if not len(y):
        return 0, 0.0
    x, y = x * stride + xs.start - box[0], y * stride + ys.start - box[1]
    angles = np.radians(np.arange(theta[0], theta[1] + 1, theta[2]))
    diag = int(np.hypot(box[2] - box[0], box[3] - box[1])) + 1
    rho = np.trunc(np.outer(np.cos(angles), x) + np.outer(np.sin(angles), y)).astype(int) + diag
    votes = np.bincount((rho + np.arange(len(angles))[:, None] * (2 * diag + 1)).ravel())
    top = int(votes.max())
    lines = int((votes >= max(8, int(top * 0.6))).sum())
    return min(lines, 12), min(1.0, top / ((box[3] - box[1]) / stride))


def marking_mask(luma: np.ndarray, rgb: np.ndarray, box: Box) -> dict:
    """mask of white or yellow pixels, their coverage and mean luma, and the mean luma of the rest."""
    stats = luma_stats(luma, box, 2)
    white = max(150, stats["p50"] + 25)
    p = crop(rgb, box).astype(np.int32)
    y = crop(luma, box).astype(np.float64)
    r, g, b = p[..., 0], p[..., 1], p[..., 2]
    v, low = p.max(-1), p.min(-1)
    saturation = np.where(v > 0, (v - low) / np.maximum(v, 1), 0.0)
    mask = (v >= white) & (saturation <= 0.30)
    mask |= (r > 110) & (g > 100) & (b < g - 25) & (b < r - 25) & (v >= white - 30)
    marks = int(mask.sum())
    return {"mask": mask, "coverage": marks / mask.size if mask.size else 0.0, "mark_luma": float(y[mask].mean()) if marks else 0.0, "road_luma": float(y[~mask].mean()) if marks < mask.size else stats["mean"]}


def dark_channel(rgb: np.ndarray, patch: int = 16) -> float:
    """Mean over patches of the darkest channel of every other pixel, over 255; edge patches count."""
    h, w = rgb.shape[:2]
    if not h or not w:
        return 0.0
    low = rgb.min(-1)
    pad = np.full((-(-h // patch) * patch, -(-w // patch) * patch), 255, np.uint8)
    pad[:h, :w] = low
    blocks = pad.reshape(pad.shape[0] // patch, patch, pad.shape[1] // patch, patch)[:, ::2, :, ::2]
    return float(blocks.min((1, 3)).mean()) / 255.0


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """(labels from 1, 0 outside; their number) of 8-connected regions, by letting the least label spread."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        pad = np.pad(np.where(mask, label, mask.size + 1), 1, constant_values=mask.size + 1)
        least = np.min([pad[1 + dy : 1 + dy + mask.shape[0], 1 + dx : 1 + dx + mask.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], 0)
        new = np.where(mask, least, 0)
        jump = np.concatenate(([0], new.ravel()))  # follow each label to its own pixel's label
        new = np.where(mask, jump[new], 0)
        if np.array_equal(new, label):
            break
        label = new
    names = np.unique(label[mask])
    return np.where(mask, np.searchsorted(names, label) + 1, 0), len(names)


def bright_blobs(img: np.ndarray, threshold: int = 245, ds: int = 2, least: int = 16) -> list[dict]:
    """Regions of bright pixels on the downsampled grid, in full-size pixels."""
    h, w = img.shape
    grid = img[: h // ds * ds : ds, : w // ds * ds : ds]
    labels, n = components(grid >= threshold)
    out = []
    for i in range(1, n + 1):
        y, x = np.nonzero(labels == i)
        if len(y) >= least:
            out.append({"size": len(y) * ds * ds, "cx": float(x.mean()) * ds, "cy": float(y.mean()) * ds, "x0": int(x.min()) * ds, "y0": int(y.min()) * ds, "x1": int(x.max()) * ds, "y1": int(y.max()) * ds})
    return out


def motion_regions(before: np.ndarray, now: np.ndarray, least_diff: int = 28, ds: int = 4, least: int = 20) -> int:
    if before.shape != now.shape:
        return 0
    return moved(small(before, ds), small(now, ds), least_diff, least)


def small(img: np.ndarray, ds: int = 4) -> np.ndarray:
    """The pixels that motion_regions compares."""
    h, w = img.shape
    return img[: h // ds * ds : ds, : w // ds * ds : ds]


def moved(before: np.ndarray, now: np.ndarray, least_diff: int = 28, least: int = 20) -> int:
    """Regions of at least so many pixels of small() that differ."""
    mask = np.abs(before.astype(np.int16) - now.astype(np.int16)) >= least_diff
    if int(mask.sum()) < least:
        return 0
    labels, n = components(mask)
    return int((np.bincount(labels.ravel(), minlength=n + 1)[1:] >= least).sum())


def row_banding(img: np.ndarray, box: Box | None = None) -> float:
    rows = crop(img, box or full(img)).astype(np.float64)
    if rows.shape[0] < 8 or not rows.shape[1]:
        return 0.0
    m = rows.mean(1)
    fast, slow = float(np.abs(m[:-2] - 2 * m[1:-1] + m[2:]).sum()), float(np.abs(m[1:-1] - m[:-2]).sum())
    return 0.0 if slow < 1e-3 else min(fast / (slow + fast), 1.0)


def flat_noise(img: np.ndarray, box: Box | None = None, block: int = 16) -> float:
    """Mean residual against a 3x3 mean in blocks without edges, over 18, at most 1."""
    x0, y0, x1, y1 = box or full(img)
    found = []
    for by in range(y0, y1 - block, block):
        for bx in range(x0, x1 - block, block):
            if sobel(img, (bx, by, bx + block, by + block), 4, 2)["edge_energy"] >= 0.06:
                continue
            p = img[by : by + block, bx : bx + block].astype(np.float64)
            mean = sum(p[1 + dy : block - 1 + dy, 1 + dx : block - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) / 9.0
            found.append(float(np.sqrt(((p[1:-1, 1:-1] - mean) ** 2).mean())))
    return min(sum(found) / len(found) / 18.0, 1.0) if found else 0.0


def yuv_to_rgb(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """BT.601 in integers, the planes of one size."""
    c, d, e = (p.astype(np.int32) - o for p, o in ((y, 16), (u, 128), (v, 128)))
    c = np.maximum(c, 0) * 298
    out = np.stack((c + 409 * e + 128, c - 100 * d - 208 * e + 128, c + 516 * d + 128), -1) >> 8
    return np.clip(out, 0, 255).astype(np.uint8)


def downscale(img: np.ndarray, long_edge: int = 480, rotate: int = 0, least: int = 16) -> np.ndarray:
    """Nearest neighbour, turned by a multiple of 90 degrees clockwise; never enlarged."""
    turned = np.rot90(img, -rotate // 90)
    h, w = turned.shape[:2]
    scale = long_edge / max(h, w)
    if scale >= 1:
        return turned.copy()
    nh, nw = max(least, int(h * scale)), max(least, int(w * scale))
    y, x = np.minimum((np.arange(nh) / scale).astype(int), h - 1), np.minimum((np.arange(nw) / scale).astype(int), w - 1)
    return turned[y][:, x]


def tensor(rgb: np.ndarray, box: Box, height: int, width: int, quantized: bool) -> np.ndarray:
    """The box resized to a model's input, as bytes or floats from 0 to 1."""
    part = crop(rgb, box)
    y, x = np.arange(height) * part.shape[0] // height, np.arange(width) * part.shape[1] // width
    out = part[y][:, x]
    return out if quantized else out.astype(np.float32) / 255.0


def pixelate(rgb: np.ndarray, box: Box, block: int = 12) -> np.ndarray:
    """rgb with the box, cut to the image, replaced by block means."""
    h, w = rgb.shape[:2]
    x0, y0, x1, y1 = max(0, box[0]), max(0, box[1]), min(w, box[2]), min(h, box[3])
    out = rgb.copy()
    for y in range(y0, y1, block):
        for x in range(x0, x1, block):
            part = out[y : min(y + block, y1), x : min(x + block, x1)]
            part[...] = part.reshape(-1, part.shape[-1]).astype(np.int64).mean(0).astype(np.uint8)
    return out


STATS = (
    "mean double, std double, clip_low double, clip_high double, p50 double, p95 double, banding double, coverage double, line_count int, hough_conf double, mark_luma double, road_luma double, "
    "grid array<double>, bright_frac double, largest_frac double, blob_count int, dark_channel double, vert_share double, edge_energy double, noise double, whole_edges double, whole_mean double, bottom_center double, top double, regions int"
)


def frame_stats(luma: np.ndarray, rgb: np.ndarray, before: np.ndarray | None = None) -> dict:
    """All statistics that the heads take from one frame, shared work done once."""
    h, w = luma.shape
    road = lower(luma)
    marks = marking_mask(luma, rgb, road)
    lines, conf = hough(luma, road, marks["mask"])
    blobs = bright_blobs(luma)
    area = max(1, h * w)
    sky = sobel(luma, (0, 0, w, h // 3))
    bottom = luma_stats(luma, (int(w * 0.30), int(h * 0.6), int(w * 0.70), h), 2)["mean"]
    s = luma_stats(luma, stride=2)
    return s | {
        "banding": row_banding(luma), "coverage": marks["coverage"], "line_count": lines, "hough_conf": conf, "mark_luma": marks["mark_luma"], "road_luma": marks["road_luma"],
        "grid": sharpness_grid(luma), "bright_frac": sum(b["size"] for b in blobs) / area, "largest_frac": max((b["size"] for b in blobs), default=0) / area, "blob_count": len(blobs),
        "dark_channel": dark_channel(rgb), "vert_share": float(sky["hist"][7:12].sum()), "edge_energy": sky["edge_energy"], "noise": flat_noise(luma),
        "whole_edges": sobel(luma, None, 4, 2)["edge_energy"], "whole_mean": luma_stats(luma, stride=4)["mean"],
        "bottom_center": bottom, "top": luma_stats(luma, (0, 0, w, int(h * 0.30)), 2)["mean"], "regions": None if before is None else motion_regions(before, luma),
    }


#: Pixels of luma that frames_stats() has in hand at once, one frame at least.
PIXELS = 400_000


def _means(crops: np.ndarray) -> np.ndarray:
    """The mean of each frame's pixels, summed as integers."""
    return crops.sum((1, 2), dtype=np.int64) / crops[0].size


def _gradients(img: np.ndarray, box: Box, stride: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """What sobel() takes of one image, of many (n x h x w)."""
    ys, xs = _inner(img[0], box, stride)
    at = lambda dy, dx: img[:, ys.start + dy : ys.stop + dy : stride, xs.start + dx : xs.stop + dx : stride]
    gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    return gx, gy


def _energies(gx: np.ndarray, gy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(magnitudes, edge_energy of each frame)."""
    mag = np.hypot(gx, gy)
    return mag, np.minimum(mag.reshape(len(mag), -1).mean(1) / 255.0, 1.0)


def frames_stats(luma: np.ndarray, rgb: np.ndarray) -> dict[str, np.ndarray]:
    """frame_stats() of many frames of one size (n x h x w, n x h x w x 3) at once, without regions: a column for each statistic.

    Frames are at least 24 pixels wide and high. Sums go in the order of frame_stats(), so thresholds decide alike.
    """
    n, h, w = luma.shape
    each = np.arange(n)
    wide = luma.astype(np.int32)
    count = lambda where, size, weights=None: np.bincount(where.ravel(), weights, n * size).reshape(n, size)
    hist_of = lambda crops: count(crops + 256 * each[:, None, None], 256)
    below = lambda hist, p: (np.cumsum(hist, 1) < int(hist[0].sum() * p)).sum(1)  # noqa: E731  hist_percentile

    hist = hist_of(luma[:, ::2, ::2])
    pixels, v = int(hist[0].sum()), np.arange(256)
    mean = (v * hist).sum(1) / pixels
    out = {"mean": mean, "std": np.sqrt(np.maximum((v * v * hist).sum(1) / pixels - mean * mean, 0.0)), "clip_low": hist[:, :17].sum(1) / pixels, "clip_high": hist[:, 240:].sum(1) / pixels}
    out |= {"p50": below(hist, 0.5).astype(float), "p95": below(hist, 0.95).astype(float)}

    rows = luma.astype(np.float64).mean(2)
    fast, slow = np.abs(rows[:, :-2] - 2 * rows[:, 1:-1] + rows[:, 2:]).sum(1), np.abs(rows[:, 1:-1] - rows[:, :-2]).sum(1)
    out["banding"] = np.where(slow < 1e-3, 0.0, np.minimum(fast / np.maximum(slow + fast, 1e-3), 1.0))

    # marking_mask() of the lower half
    box = lower(luma[0])
    road = luma[:, box[1] :]
    p = rgb[:, box[1] :].astype(np.int32)
    r, g, b = p[..., 0], p[..., 1], p[..., 2]
    most, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    white = np.maximum(150, below(hist_of(road[:, ::2, ::2]), 0.5) + 25)[:, None, None]
    mask = (most >= white) & (np.where(most > 0, (most - low) / np.maximum(most, 1), 0.0) <= 0.30)
    mask |= (r > 110) & (g > 100) & (b < g - 25) & (b < r - 25) & (most >= white - 30)
    size, marks = road[0].size, mask.sum((1, 2))
    marked = (road * mask).sum((1, 2), dtype=np.int64)
    out |= {"coverage": marks / size, "mark_luma": marked / np.maximum(marks, 1), "road_luma": np.where(marks < size, (road.sum((1, 2), dtype=np.int64) - marked) / np.maximum(size - marks, 1), _means(road[:, ::2, ::2]))}

    # hough() of the lower half
    ys, xs = _inner(luma[0], box, 2)
    at = lambda dy, dx: wide[:, ys.start + dy : ys.stop + dy : 2, xs.start + dx : xs.stop + dx : 2]
    gx, gy = at(0, 1) - at(0, -1), at(1, 0) - at(-1, 0)
    f, y, x = np.nonzero((gx * gx + gy * gy >= 48 * 48) & mask[:, ys.start - box[1] : ys.stop - box[1] : 2, xs.start : xs.stop : 2])
    x, y = x * 2 + xs.start, y * 2 + ys.start - box[1]
    angles = np.radians(np.arange(40, 141, 5))
    diag = int(np.hypot(w, h - box[1])) + 1
    rho = np.trunc(np.outer(np.cos(angles), x) + np.outer(np.sin(angles), y)).astype(int) + diag
    votes = count(rho + (f * len(angles) + np.arange(len(angles))[:, None]) * (2 * diag + 1), len(angles) * (2 * diag + 1))
    top = votes.max(1)
    out |= {"line_count": np.minimum((votes >= np.maximum(8, (top * 0.6).astype(int))[:, None]).sum(1), 12), "hough_conf": np.minimum(1.0, top / ((h - box[1]) / 2))}

    # sharpness_grid()
    lap = wide[:, 1:-1, :-2] + wide[:, 1:-1, 2:] + wide[:, :-2, 1:-1] + wide[:, 2:, 1:-1] - 4 * wide[:, 1:-1, 1:-1]
    spans = lambda k, size, most: [(max(1, i * size) - 1, max(0, min(most - 1, (i + 1) * size) - 1)) for i in range(k)]
    blocks = [lap[:, y0:y1, x0:x1] for y0, y1 in spans(6, h // 6, h) for x0, x1 in spans(8, w // 8, w)]
    out["grid"] = np.stack([x.reshape(n, -1).var(1) for x in blocks], 1)

    # bright_blobs(): frames one above the other, a dark row between them
    grid = luma[:, : h // 2 * 2 : 2, : w // 2 * 2 : 2] >= 245
    some = np.nonzero(grid.sum((1, 2)) >= 16)[0]
    sizes, of = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(some):
        tall = np.pad(grid[some], ((0, 0), (0, 1), (0, 0))).reshape(-1, grid.shape[2])
        labels, k = components(tall)
        sizes = np.bincount(labels.ravel(), minlength=k + 1)[1:]
        place = np.nonzero(labels)
        of = np.empty(k, np.int64)
        of[labels[place] - 1] = some[place[0] // (grid.shape[1] + 1)]
        sizes, of = sizes[sizes >= 16] * 4, of[sizes >= 16]
    largest = np.zeros(n, np.int64)
    np.maximum.at(largest, of, sizes)
    out |= {"bright_frac": np.bincount(of, sizes, n) / (h * w), "largest_frac": largest / (h * w), "blob_count": np.bincount(of, minlength=n)}

    # dark_channel()
    pad = np.full((n, -(-h // 16) * 16, -(-w // 16) * 16), 255, np.uint8)
    pad[:, :h, :w] = np.minimum(np.minimum(rgb[..., 0], rgb[..., 1]), rgb[..., 2])
    darkest = pad.reshape(n, pad.shape[1] // 16, 16, pad.shape[2] // 16, 16)[:, :, ::2, :, ::2].min((2, 4))
    out["dark_channel"] = _means(darkest) / 255.0

    # sobel() of the sky
    gx, gy = _gradients(wide, (0, 0, w, h // 3))
    mag, out["edge_energy"] = _energies(gx, gy)
    strong = mag > 32
    bins = np.clip((np.degrees(np.arctan2(gy[strong], gx[strong])) % 180.0 / 180.0 * 18).astype(int), 0, 17)
    by_angle = count(np.nonzero(strong)[0] * 18 + bins, 18, mag[strong])
    total = by_angle.sum(1)
    out["vert_share"] = (by_angle / np.where(total > 0, total, 1.0)[:, None])[:, 7:12].sum(1)

    # flat_noise()
    noise, found = np.zeros(n), np.zeros(n, np.int64)
    for by in range(0, h - 16, 16):
        for bx in range(0, w - 16, 16):
            flat = _energies(*_gradients(wide, (bx, by, bx + 16, by + 16), 2))[1] < 0.06
            p = wide[flat, by : by + 16, bx : bx + 16].astype(np.float64)
            around = sum(p[:, 1 + dy : 15 + dy, 1 + dx : 15 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) / 9.0
            noise[flat] += np.sqrt(((p[:, 1:-1, 1:-1] - around) ** 2).reshape(len(p), 14 * 14).mean(1))
            found += flat
    out["noise"] = np.minimum(noise / np.maximum(found, 1) / 18.0, 1.0)

    out["whole_edges"] = _energies(*_gradients(wide, full(luma[0]), 2))[1]
    out["whole_mean"] = _means(luma[:, ::4, ::4])
    out["bottom_center"] = _means(luma[:, int(h * 0.6) :: 2, int(w * 0.30) : int(w * 0.70) : 2])
    out["top"] = _means(luma[:, : int(h * 0.30) : 2, ::2])
    return out


def _many(width: pd.Series, height: pd.Series, luma: pd.Series, rgb: pd.Series) -> pd.DataFrame:
    """STATS of frames, as _stats() gives them without a frame before, those of one size together."""
    names = [c.split()[0] for c in STATS.split(", ")]
    alike: dict[tuple[int, int], list[int]] = {}
    alone = []
    for i, (w, h, y, c) in enumerate(zip(width, height, luma, rgb, strict=True)):
        whole = y is not None and c is not None and not pd.isna(w) and not pd.isna(h) and w >= 24 and h >= 24 and len(y) == w * h and len(c) == 3 * w * h
        (alike.setdefault((int(h), int(w)), []) if whole else alone).append(i)
    out: dict[str, np.ndarray] = {c: np.full(len(width), None, object) for c in names}

    def put(at: list[int], found: dict) -> None:
        for c, column in found.items():
            if c == "grid":
                column, rows = np.empty(len(at), object), column
                column[:] = list(rows)
            out[c][at] = column

    for (h, w), of in alike.items():
        step = max(1, PIXELS // (h * w))
        for at in (of[i : i + step] for i in range(0, len(of), step)):
            put(at, frames_stats(*(np.frombuffer(b"".join(d[i] for i in at), np.uint8).reshape(len(at), h, w, *more) for d, more in ((luma, ()), (rgb, (3,))))))
    if alone:
        # a null among the sizes makes floats of them all
        w, h = ([None if pd.isna(d[i]) else int(d[i]) for i in alone] for d in (width, height))
        rest = next(_stats(iter([(w, h, luma[alone], rgb[alone], [None] * len(alone))])))
        put(alone, {c: list(rest[c]) if c != "grid" else rest[c] for c in names})
    kinds = {c.split()[0]: c.split()[1] for c in STATS.split(", ")}
    return pd.DataFrame({c: pd.Series(x, dtype={"double": "Float64", "int": "Int32"}.get(kinds[c], object)) for c, x in out.items()}, columns=names)


def _stats(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in STATS.split(", ")]
    for width, height, luma, rgb, before in batches:
        rows = []
        for w, h, y, c, b in zip(width, height, luma, rgb, before, strict=True):
            try:
                img = np.frombuffer(y, np.uint8).reshape(h, w)
                prev = np.frombuffer(b, np.uint8) if b is not None else None
                prev = None if prev is None else (prev.reshape(h, w) if prev.size == img.size else np.zeros((0, 0), np.uint8))
                rows.append(frame_stats(img, np.frombuffer(c, np.uint8).reshape(h, w, 3), prev))
            except (ValueError, TypeError):  # a broken frame is a failed row, not a failed job
                rows.append(dict.fromkeys(names))
        yield pd.DataFrame(rows, columns=names)


def stats_column(width: Column, height: Column, luma: Column, rgb: Column, before: Column) -> Column:
    """The statistics struct of a frame; all null where its planes don't fit its size."""
    return F.pandas_udf(_stats, STATS)(width, height, luma, rgb, before)


def _shrunk(luma: bytes | None, w: float, h: float) -> bytes | None:
    """small() of a frame after its height and width, which are 0 where the plane doesn't fit; null without a plane."""
    if luma is None:
        return None
    if pd.isna(w) or pd.isna(h) or len(luma) != int(w) * int(h):
        return struct.pack(">II", 0, 0)
    return struct.pack(">II", int(h), int(w)) + small(np.frombuffer(luma, np.uint8).reshape(int(h), int(w))).tobytes()


def seen_column(width: Column, height: Column, luma: Column, rgb: Column) -> Column:
    """struct(STATS without regions, small): all that is wanted of a frame, so that its images go nowhere; see regions_column()."""

    @F.pandas_udf(f"{STATS}, small binary")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for w, h, y, c in batches:
            stats = _many(w, h, y, c)
            stats["small"] = pd.Series([_shrunk(*x) for x in zip(y, w, h, strict=True)], dtype=object)
            yield stats

    return run(width, height, luma, rgb)


def regions_column(before: Column, now: Column) -> Column:
    """motion_regions of two frames from small of seen_column: null without the frame before, 0 where the sizes differ."""

    @F.pandas_udf("int")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        pixels = lambda d: np.frombuffer(d, np.uint8, offset=8)

        def regions(x: bytes | None, y: bytes | None) -> int | None:
            if x is None or y is None:
                return None
            h, w = struct.unpack_from(">II", y)
            return 0 if x[:8] != y[:8] else moved(pixels(x).reshape(h // 4, w // 4), pixels(y).reshape(h // 4, w // 4)) if h // 4 and w // 4 else 0

        return pd.Series([regions(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return run(before, now)
