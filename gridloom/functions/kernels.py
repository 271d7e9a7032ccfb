"""Raster kernels on numpy arrays: grey images are H x W uint8, colour images H x W x 3 in BGR order."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np


def to_grey(image: np.ndarray) -> np.ndarray:
    """Grey of a colour image; a grey image is returned as it is."""
    if image.ndim == 2:
        return image
    b, g, r = (image[..., k].astype(np.int64) for k in range(3))
    return ((b * 1868 + g * 9617 + r * 4899 + (1 << 13)) >> 14).astype(np.uint8)


def to_colour(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 3 else np.repeat(image[..., None], 3, 2)


def fixed_inverse(grey: np.ndarray, level: int = 250) -> np.ndarray:
    return np.where(grey > level, 0, 255).astype(np.uint8)


def is_blank(image: np.ndarray, level: int = 250, fraction: float = 0.01) -> bool:
    """Fewer than the fraction of the pixels are at or below the level."""
    grey = to_grey(image)
    return int((grey <= level).sum()) < grey.size * fraction


def otsu_level(grey: np.ndarray) -> int:
    """The threshold of the largest between-class variance, the lowest of equals."""
    n = np.bincount(grey.ravel(), minlength=256).astype(np.int64)
    w, s = np.cumsum(n), np.cumsum(n * np.arange(256))
    apart = (s[-1] * w - w[-1] * s).astype(float)
    rest = (w * (w[-1] - w)).astype(float)
    return int(np.argmax(np.where(rest > 0, apart**2 / np.maximum(rest, 1), -1)))


def otsu(grey: np.ndarray) -> np.ndarray:
    if grey.size == 0 or grey.min() == grey.max():
        return np.where(grey > 0, 255, 0).astype(np.uint8)
    return np.where(grey > otsu_level(grey), 255, 0).astype(np.uint8)


def gaussian(size: int) -> np.ndarray:
    """Weights of an odd window with the width that goes with its size."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    w = np.exp(-(x**2) / (2 * sigma**2))
    return w / w.sum()


def adaptive(grey: np.ndarray, size: int, c: float = 2.0) -> np.ndarray:
    """255 where a pixel is above the Gaussian mean of its window less c; the edge is repeated outside."""
    w, h = gaussian(size), size // 2
    wide = np.pad(grey.astype(float), h, mode="edge")
    rows = sum(w[k] * wide[:, k : k + grey.shape[1]] for k in range(size))
    mean = np.floor(sum(w[k] * rows[k : k + grey.shape[0]] for k in range(size)) + 0.5)
    return np.where(grey > mean - c, 255, 0).astype(np.uint8)


#: Rows that non-local means work on at once.
STRIP = 256


def denoise(grey: np.ndarray, h: float = 3.0, template: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means: every shift within the search window is weighed by the mean squared difference of
    the templates around both pixels; box sums make the template's size free."""
    t, s = template // 2, search // 2
    edge = t + s
    wide = np.pad(grey, edge, mode="reflect" if min(grey.shape) > edge else "edge")
    # Strips, with what their templates and searches reach, so that a page of any size takes little memory.
    strips = [_denoised(wide[y : y + STRIP + 2 * edge], h, template, search) for y in range(0, grey.shape[0], STRIP)]
    return np.concatenate(strips) if strips else grey


def _denoised(wide: np.ndarray, h: float, template: int, search: int) -> np.ndarray:
    t, s = template // 2, search // 2
    height, width = (n - 2 * (t + s) for n in wide.shape)
    wide = wide.astype(np.float64)
    centre = wide[s : s + height + 2 * t, s : s + width + 2 * t]
    total, weights = np.zeros((height, width)), np.zeros((height, width))
    for dy in range(search):
        for dx in range(search):
            moved = wide[dy : dy + height + 2 * t, dx : dx + width + 2 * t]
            sums = np.pad(((centre - moved) ** 2).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
            apart = sums[template:, template:] - sums[:-template, template:] - sums[template:, :-template] + sums[:-template, :-template]
            w = np.exp(-apart / (template * template * h * h))
            w[w < 0.001] = 0
            total += w * moved[t : t + height, t : t + width]
            weights += w
    return np.clip(np.floor(total / weights + 0.5), 0, 255).astype(np.uint8)


def equalise(grey: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited histogram equalisation by tiles, blended between the tiles' centres."""
    height, width = grey.shape
    wide = np.pad(grey, ((0, -height % tiles), (0, -width % tiles)), mode="reflect" if min(height, width) > tiles else "edge")
    th, tw = wide.shape[0] // tiles, wide.shape[1] // tiles
    area = th * tw
    limit = max(int(clip * area / 256), 1)
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(wide[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + over // 256
            rest = over % 256
            if rest:
                n[:: max(256 // rest, 1)][:rest] += 1
            maps[i, j] = np.clip(np.floor(np.cumsum(n) * 255 / area + 0.5), 0, 255)
    y, x = np.arange(height) / th - 0.5, np.arange(width) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    ya, yb = np.clip(y0, 0, tiles - 1)[:, None], np.clip(y0 + 1, 0, tiles - 1)[:, None]
    xa, xb = np.clip(x0, 0, tiles - 1)[None, :], np.clip(x0 + 1, 0, tiles - 1)[None, :]
    top = maps[ya, xa, grey] * (1 - fx) + maps[ya, xb, grey] * fx
    low = maps[yb, xa, grey] * (1 - fx) + maps[yb, xb, grey] * fx
    return np.clip(np.floor(top * (1 - fy) + low * fy + 0.5), 0, 255).astype(np.uint8)


def sharpen(grey: np.ndarray) -> np.ndarray:
    """Nine times a pixel less its neighbours, mirrored at the border without the edge, clipped."""
    wide = np.pad(grey.astype(np.int64), 1, mode="reflect" if min(grey.shape) > 1 else "edge")
    around = sum(wide[y : y + grey.shape[0], x : x + grey.shape[1]] for y in range(3) for x in range(3))
    return np.clip(10 * grey.astype(np.int64) - around, 0, 255).astype(np.uint8)


def dilate_two(grey: np.ndarray) -> np.ndarray:
    """Largest of a pixel and its neighbours left, above and between."""
    wide = np.pad(grey, ((1, 0), (1, 0)))
    return np.maximum.reduce([wide[1:, 1:], wide[:-1, 1:], wide[1:, :-1], wide[:-1, :-1]])


def _slide(grey: np.ndarray, back: int, ahead: int, least: bool, axis: int) -> np.ndarray:
    """Extreme of a window of each line, by doubling; outside counts for nothing."""
    fill = 255 if least else 0
    pad = [(0, 0), (0, 0)]
    pad[axis] = (back, ahead)
    wide = np.moveaxis(np.pad(grey, pad, constant_values=fill), axis, 0)
    pick, size, n = (np.minimum if least else np.maximum), back + ahead + 1, 1
    while 2 * n <= size:
        wide, n = pick(wide[:-n], wide[n:]), 2 * n
    rest = size - n
    wide = pick(wide[: len(wide) - rest], wide[rest:])
    return np.moveaxis(wide, 0, axis)


def opened(grey: np.ndarray, length: int = 40, iterations: int = 2, along: str = "row") -> np.ndarray:
    """Opening with a line: `iterations` erosions, then as many dilations."""
    axis = 1 if along == "row" else 0
    back, ahead = length // 2 * iterations, (length - 1 - length // 2) * iterations
    return _slide(_slide(grey, back, ahead, True, axis), back, ahead, False, axis)


def either(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(np.maximum(a, b) > 0, 255, 0).astype(np.uint8)


def canny(grey: np.ndarray, low: int, high: int) -> np.ndarray:
    """Edges: gradient by 3 x 3 Sobel in the sum norm, thinned across the edge, and kept from `low` on
    where connected with a pixel above `high`."""
    w = np.pad(grey.astype(np.int64), 1, mode="edge")
    dx = (w[:-2, 2:] + 2 * w[1:-1, 2:] + w[2:, 2:]) - (w[:-2, :-2] + 2 * w[1:-1, :-2] + w[2:, :-2])
    dy = (w[2:, :-2] + 2 * w[2:, 1:-1] + w[2:, 2:]) - (w[:-2, :-2] + 2 * w[:-2, 1:-1] + w[:-2, 2:])
    size = np.abs(dx) + np.abs(dy)
    m = np.pad(size, 1)

    def at(y: int, x: int) -> np.ndarray:
        return m[1 + y : 1 + y + size.shape[0], 1 + x : 1 + x + size.shape[1]]

    ax, ay = np.abs(dx), np.abs(dy)
    flat, steep = ay < 0.4142135623730950 * ax, ay > 2.414213562373095 * ax
    same = (dx >= 0) == (dy >= 0)
    ridge = np.where(
        flat,
        (size > at(0, -1)) & (size >= at(0, 1)),
        np.where(
            steep,
            (size > at(-1, 0)) & (size >= at(1, 0)),
            np.where(same, (size > at(-1, -1)) & (size > at(1, 1)), (size > at(-1, 1)) & (size > at(1, -1))),
        ),
    )
    weak = np.pad(ridge & (size > low), 1)
    out = np.zeros_like(weak)
    stack = list(zip(*np.nonzero(np.pad(ridge & (size > high), 1))))
    for p in stack:
        out[p] = True
    while stack:
        y, x = stack.pop()
        for yy, xx in zip(*np.nonzero(weak[y - 1 : y + 2, x - 1 : x + 2] & ~out[y - 1 : y + 2, x - 1 : x + 2])):
            p = (y - 1 + yy, x - 1 + xx)
            out[p] = True
            stack.append(p)
    return np.where(out[1:-1, 1:-1], 255, 0).astype(np.uint8)


# Neighbours of a pixel in clockwise order, from the right.
_AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def contours(image: np.ndarray, external: bool = False) -> Iterator[np.ndarray]:
    """Borders of the non-zero regions by border following, as arrays of points (x, y): outer borders and
    borders of holes, or only the outer borders that lie in no other."""
    f = np.pad((image != 0).astype(np.int32), 1)
    starts = np.argwhere((f[:, 1:-1] != 0) & ((f[:, :-2] == 0) | (f[:, 2:] == 0))) + (0, 1)
    parent, hole = {1: 0}, {1: True}
    number, last, line = 1, 1, -1
    for i, j in starts.tolist():
        if i != line:
            line, last = i, 1
        outer = f[i, j] == 1 and f[i, j - 1] == 0
        inner = not outer and f[i, j] >= 1 and f[i, j + 1] == 0
        if outer or inner:
            if inner and f[i, j] > 1:
                last = int(f[i, j])
            number += 1
            hole[number] = not outer
            # A border of the same kind as the last one met is its sibling, else its child.
            parent[number] = parent[last] if hole[last] == hole[number] else last
            points = _follow(f, i, j, 4 if outer else 0, number)
            if not external or (outer and parent[number] == 1):
                yield points
        if f[i, j] != 1:
            last = abs(int(f[i, j]))


def _follow(f: np.ndarray, i: int, j: int, first: int, number: int) -> np.ndarray:
    """Follow one border from (i, j), whose neighbour in direction `first` is outside; marks it."""
    for k in range(8):
        d = (first + k) % 8
        if f[i + _AROUND[d][0], j + _AROUND[d][1]]:
            break
    else:
        f[i, j] = -number
        return np.array([[j - 1, i - 1]])
    end = (i + _AROUND[d][0], j + _AROUND[d][1])
    y, x, back, points = i, j, d, []
    while True:
        right_is_zero = False
        d = back
        for _ in range(8):
            d = (d - 1) % 8
            ny, nx = y + _AROUND[d][0], x + _AROUND[d][1]
            if f[ny, nx]:
                break
            if d == 0:
                right_is_zero = True
        if right_is_zero:
            f[y, x] = -number
        elif f[y, x] == 1:
            f[y, x] = number
        points.append((x - 1, y - 1))
        if (ny, nx) == (i, j) and (y, x) == end:
            return np.array(points)
        y, x, back = ny, nx, (d + 4) % 8


def area(points: np.ndarray) -> float:
    """Area that a closed polygon encloses."""
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    return float(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2)


def bounds(points: np.ndarray) -> tuple[int, int, int, int]:
    """x, y, width, height of the box around points."""
    (x1, y1), (x2, y2) = points.min(0).tolist(), points.max(0).tolist()
    return x1, y1, x2 - x1 + 1, y2 - y1 + 1


def rectangle(image: np.ndarray, x1: int, y1: int, x2: int, y2: int, colour: tuple[int, int, int], thickness: int) -> None:
    """Draw the outline of a box, corners included, centred on its edges."""
    out, inn = thickness // 2, (thickness - 1) // 2
    height, width = image.shape[:2]

    def fill(a: int, b: int, c: int, d: int) -> None:
        image[max(b, 0) : max(min(d, height), 0), max(a, 0) : max(min(c, width), 0)] = colour

    for y in (y1, y2):
        fill(x1 - out, y - out, x2 + inn + 1, y + inn + 1)
    for x in (x1, x2):
        fill(x - out, y1 - out, x + inn + 1, y2 + inn + 1)


def png(image: np.ndarray) -> bytes:
    """A grey or BGR image as a PNG file."""
    rows = image if image.ndim == 2 else image[..., ::-1]
    height, width = rows.shape[:2]
    raw = b"".join(b"\0" + np.ascontiguousarray(r).tobytes() for r in rows)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
