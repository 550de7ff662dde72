"""Figures of a page: candidate regions from one numpy kernel, gates and numbers from Catalyst.

The kernel returns each region's box and metrics; whether a region is a figure
and which number it gets are predicates and a ranking over these columns.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.errors import FigureError

# The gates' thresholds.
MIN_SIDE, MOST_SHARE = 100, 0.95
MIN_STD, MIN_MEAN, MAX_MEAN, MIN_FILL, MAX_LAPLACIAN = 25, 20, 235, 0.4, 500


def big_enough(w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """Sides of at least 100 pixels and at most 0.95 of the page's, bounds included."""
    return (w >= MIN_SIDE) & (h >= MIN_SIDE) & (w <= MOST_SHARE * page_w) & (h <= MOST_SHARE * page_h)


def looks_like_figure(std: Column, mean: Column, area: Column, w: Column, h: Column, lapvar: Column) -> Column:
    """Contrast, brightness, filling and smoothness of a picture, all strict."""
    return (std > MIN_STD) & (mean > MIN_MEAN) & (mean < MAX_MEAN) & (area / (w * h) > MIN_FILL) & (lapvar < MAX_LAPLACIAN)


def accepted(regions: DataFrame) -> DataFrame:
    return regions.where(
        big_enough(F.col("w"), F.col("h"), F.col("page_w"), F.col("page_h"))
        & looks_like_figure(F.col("std"), F.col("mean"), F.col("area"), F.col("w"), F.col("h"), F.col("lapvar"))
    )


def numbered(figures: DataFrame, page: list[str]) -> DataFrame:
    """``idx`` from 1 on each page, largest area first, then from top and left."""
    order = W.partitionBy(*page).orderBy(F.desc("area"), "y", "x")
    return figures.withColumn("idx", F.row_number().over(order))


def figure_name(page_number: Column, idx: Column) -> Column:
    return F.concat(F.lit("image_"), (page_number + 1).cast("string"), F.lit("_"), idx.cast("string"), F.lit(".png"))


def as_struct(name: Column, png: Column, image_mode: str) -> Column:
    """A figure by name ("url"), or with its data as well (any other mode)."""
    data = F.lit(None).cast("string") if image_mode == "url" else F.base64(png)
    return F.struct(name.alias("image_url"), data.alias("base64_encoded"))


def append_figures(markdown: Column, figures: Column) -> Column:
    """A blank line and an image link for each figure, by its file's name; the text as it is without any."""
    target = lambda f: F.coalesce(F.concat(F.lit("data:image/png;base64,"), f["base64_encoded"]), f["image_url"])
    name = lambda f: F.element_at(F.split(f["image_url"], "/"), -1)
    links = F.transform(figures, lambda f: F.concat(F.lit("\n\n!["), name(f), F.lit("]("), target(f), F.lit(")")))
    return F.concat(markdown, F.coalesce(F.array_join(links, ""), F.lit("")))


def ranked_pngs(regions: Column) -> Column:
    """The pictures of the regions of one page that are figures, largest first."""
    kept = F.filter(
        regions,
        lambda r: big_enough(r["w"], r["h"], r["page_w"], r["page_h"])
        & looks_like_figure(r["std"], r["mean"], r["area"], r["w"], r["h"], r["lapvar"]),
    )
    ranked = F.array_sort(F.transform(kept, lambda r: F.struct((-r["area"]).alias("a"), r["y"].alias("y"), r["x"].alias("x"), r["png"].alias("png"))))
    return F.transform(ranked, lambda r: r["png"])


def page_figures(regions: Column, page_number: Column, image_mode: str) -> Column:
    """The figures of one page from its array of candidate regions: gated, ranked and named inside the row."""
    return F.transform(ranked_pngs(regions), lambda png, i: as_struct(figure_name(page_number, i + 1), png, image_mode))


def png_of(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of H x W x 3 (blue, green, red) pixels."""
    h, w = pixels.shape[:2]
    raw = b"".join(b"\0" + np.ascontiguousarray(row[:, ::-1]).tobytes() for row in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def three_channels(pixels: np.ndarray) -> np.ndarray:
    if pixels.ndim != 3 or pixels.shape[2] not in (3, 4):
        raise FigureError(f"a raster of shape {pixels.shape} has neither 3 nor 4 channels")
    return pixels[:, :, :3]


def grey(pixels: np.ndarray) -> np.ndarray:
    return np.rint(pixels @ np.array([0.114, 0.587, 0.299])).astype(np.float64)


def _filtered(image: np.ndarray, kernel: np.ndarray, mode: str) -> np.ndarray:
    """A separable filter with the same kernel along both axes."""
    r = len(kernel) // 2
    for axis in (0, 1):
        width = [(r, r) if a == axis else (0, 0) for a in (0, 1)]
        padded = np.pad(image, width, mode=mode)
        n = image.shape[axis]
        image = sum(k * padded.take(range(i, i + n), axis=axis) for i, k in enumerate(kernel))
    return image


def _gaussian(size: int) -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - (size - 1) / 2
    k = np.exp(-(x * x) / (2 * sigma * sigma))
    return k / k.sum()


def binarised(pixels: np.ndarray) -> np.ndarray:
    """Ink by an adaptive threshold (Gaussian window of 11, constant 2) after a 5 x 5 blur, closed by 3 x 3."""
    smooth = np.rint(_filtered(grey(pixels), _gaussian(5), "reflect"))
    local = np.rint(_filtered(smooth, _gaussian(11), "edge"))
    ink = smooth <= local - 2
    grown = _spread(ink, False)
    return ~_spread(~grown, False)


def _spread(mask: np.ndarray, outside: bool) -> np.ndarray:
    padded = np.pad(mask, 1, constant_values=outside)
    h, w = mask.shape
    out = np.zeros_like(mask)
    for dy in range(3):
        for dx in range(3):
            out |= padded[dy : dy + h, dx : dx + w]
    return out


_AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def outer_borders(mask: np.ndarray) -> list[np.ndarray]:
    """The outer border, as (y, x) in turn, of each 8-connected region that lies in no other."""
    labels, n = _labelled(mask)
    outside = _reached(~mask)
    borders, seen = [], set()
    ys, xs = np.nonzero(mask)
    for y, x in zip(ys.tolist(), xs.tolist()):
        label = int(labels[y, x])
        if label in seen:
            continue
        seen.add(label)  # the first pixel in reading order is on the region's outer border
        if outside[y, x]:  # pixels are padded by one: [y, x] is the pixel above and left of it
            borders.append(_trace(labels == label, y, x) if n else np.zeros((0, 2), int))
    return borders


def _labelled(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels of 8-connected regions, by runs of rows and union-find."""
    parent: list[int] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    runs: list[list[tuple[int, int, int]]] = []
    for row in mask:
        edges = np.flatnonzero(np.diff(np.r_[0, row.astype(np.int8), 0]))
        now = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            parent.append(len(parent))
            now.append((a, b, len(parent) - 1))
        if runs:
            above, i = runs[-1], 0
            for a, b, k in now:
                while i < len(above) and above[i][1] < a:
                    i += 1
                j = i
                while j < len(above) and above[j][0] <= b:
                    p, q = root(above[j][2]), root(k)
                    parent[max(p, q)] = min(p, q)
                    j += 1
        runs.append(now)
    labels = np.full(mask.shape, -1, np.int64)
    for y, row in enumerate(runs):
        for a, b, k in row:
            labels[y, a:b] = root(k)
    return labels, len(parent)


def _reached(free: np.ndarray) -> np.ndarray:
    """Which pixels the page's surroundings reach through free ones, 4-connected, on the grid padded by one."""
    padded = np.pad(free, 1, constant_values=True)
    reached = np.zeros_like(padded)
    reached[0] = reached[-1] = True
    reached[:, 0] = reached[:, -1] = True
    while True:
        before = reached.sum()
        for flip in (1, -1):
            for axis in (0, 1):
                r = np.flip(reached, axis) if flip < 0 else reached
                f = np.flip(padded, axis) if flip < 0 else padded
                r = r if axis == 0 else r.T
                f = f if axis == 0 else f.T
                for i in range(1, len(r)):
                    r[i] |= r[i - 1] & f[i]
        if reached.sum() == before:
            break
    above = np.zeros_like(free)
    h, w = free.shape
    for dy, dx in ((0, 1), (1, 0), (1, 2), (2, 1)):
        above |= reached[dy : dy + h, dx : dx + w]
    return above


def _trace(region: np.ndarray, y: int, x: int) -> np.ndarray:
    h, w = region.shape
    inside = lambda a, b: 0 <= a < h and 0 <= b < w and region[a, b]
    points, at, back = [(y, x)], (y, x), 4
    first = None
    for _ in range(4 * region.size + 8):
        for k in range(1, 9):
            d = (back + k) % 8
            step = (at[0] + _AROUND[d][0], at[1] + _AROUND[d][1])
            if inside(*step):
                break
        else:
            return np.array(points)
        if first is None:
            first = (at, d)
        elif (at, d) == first:
            break
        at, back = step, (d + 4) % 8
        points.append(at)
    return np.array(points[:-1])


def polygon_area(points: np.ndarray) -> float:
    y, x = points[:, 0].astype(float), points[:, 1].astype(float)
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def regions(pixels: np.ndarray, with_png: bool = True) -> list[dict]:
    """Box, metrics and crop of each candidate region that passes the size gate, largest area first."""
    pixels = three_channels(pixels)
    page_h, page_w = pixels.shape[:2]
    out = []
    for border in outer_borders(binarised(pixels)):
        (y, x), (y2, x2) = border.min(0), border.max(0) + 1
        h, w = int(y2 - y), int(x2 - x)
        if not (w >= MIN_SIDE and h >= MIN_SIDE and w <= MOST_SHARE * page_w and h <= MOST_SHARE * page_h):
            continue  # the same gate as big_enough, here so that metrics and crops of specks aren't made
        crop = pixels[y:y2, x:x2]
        g = grey(crop)
        p = np.pad(g, 1, mode="reflect")
        laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
        out.append(
            {
                "x": int(x), "y": int(y), "w": w, "h": h, "page_w": page_w, "page_h": page_h, "area": polygon_area(border),
                "mean": float(g.mean()), "std": float(g.std()), "lapvar": float(laplacian.var()), "png": png_of(crop) if with_png else None,
            }
        )
    return sorted(out, key=lambda r: (-r["area"], r["y"], r["x"]))
