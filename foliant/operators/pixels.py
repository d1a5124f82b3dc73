"""Pixel kernels over page rasters, one image per row, in numpy by mapInPandas.

An image row is id, width, height, pixels (bytes, row-major, grey or RGB). Kernels work on float arrays [height, width]."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def grey(rgb: np.ndarray) -> np.ndarray:
    return rgb if rgb.ndim == 2 else rgb @ np.array([0.299, 0.587, 0.114])


def raster(pixels: bytes, width: int, height: int) -> np.ndarray:
    a = np.frombuffer(pixels, np.uint8).astype(float)
    return a.reshape(height, width) if a.size == width * height else a.reshape(height, width, -1)[..., :3]


def resized(a: np.ndarray, longest: int = 1600) -> np.ndarray:
    """Bilinear, the longest edge at most `longest`."""
    h, w = a.shape[:2]
    s = min(1.0, longest / max(h, w, 1))
    if s == 1.0:
        return a
    y, x = (np.clip((np.arange(max(1, round(n * s))) + 0.5) / s - 0.5, 0, n - 1) for n in (h, w))
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), (y - y0)[:, None], x - x0
    if a.ndim == 3:
        fy, fx = fy[..., None], fx[:, None]
    top, low = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx, a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def _windows(a: np.ndarray, r: int, mode: str = "edge", **k) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, r, mode, **k), (2 * r + 1, 2 * r + 1))


def blurred(a: np.ndarray, radius: int) -> np.ndarray:
    """Gaussian of sigma radius / 2, separable."""
    if radius < 1:
        return a
    t = np.arange(-radius, radius + 1)
    k = np.exp(-(t**2) / (2 * (radius / 2) ** 2))
    k /= k.sum()
    rows = np.lib.stride_tricks.sliding_window_view(np.pad(a, ((0, 0), (radius, radius)), "edge"), 2 * radius + 1, 1) @ k
    return np.lib.stride_tricks.sliding_window_view(np.pad(rows, ((radius, radius), (0, 0)), "edge"), 2 * radius + 1, 0) @ k


def bilateral(a: np.ndarray, radius: int, sigma_color: float, sigma_space: float) -> np.ndarray:
    w = _windows(a, radius)
    t = np.arange(-radius, radius + 1)
    space = np.exp(-(t[:, None] ** 2 + t**2) / (2 * sigma_space**2))
    k = space * np.exp(-((w - a[..., None, None]) ** 2) / (2 * sigma_color**2))
    return (k * w).sum((2, 3)) / k.sum((2, 3))


def sobel(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)
    w = _windows(a, 1)
    return (w * k).sum((2, 3)), (w * k.T).sum((2, 3))


def edges(a: np.ndarray, low: float, high: float) -> np.ndarray:
    """Canny: gradient maxima above high, and those above low that connect to them."""
    gx, gy = sobel(a)
    m = np.hypot(gx, gy)
    d = (np.rint(np.arctan2(gy, gx) / (np.pi / 4)) % 4).astype(int)
    p = np.pad(m, 1)
    h, w = m.shape
    keep = np.zeros_like(m, bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        ahead, behind = p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], p[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        keep |= (d == k) & (m >= ahead) & (m >= behind)
    weak, strong = keep & (m >= low), keep & (m >= high)
    while True:
        grown = dilated(strong, 1) & weak
        if (grown == strong).all():
            return strong
        strong = grown


def dilated(mask: np.ndarray, radius: int) -> np.ndarray:
    return _windows(mask, radius, "constant").any((2, 3))


def eroded(mask: np.ndarray, radius: int) -> np.ndarray:
    return _windows(mask, radius, "constant", constant_values=True).all((2, 3))


def distances(mask: np.ndarray) -> np.ndarray:
    """Chessboard distance of every set pixel to the nearest unset one."""
    d, m, n = np.zeros(mask.shape, int), mask.copy(), 0
    while m.any():
        n += 1
        d[m] = n
        m = eroded(np.pad(m, 1), 1)[1:-1, 1:-1]
    return d


def labelled(mask: np.ndarray) -> np.ndarray:
    """4-connected components: 0 outside, else 1 + the smallest pixel index, made dense."""
    big = mask.size
    at = np.where(mask, np.arange(big).reshape(mask.shape), big)
    while True:
        p = np.pad(at, 1, constant_values=big)
        low = np.minimum.reduce([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
        low = np.where(mask, low, big)
        flat = low.reshape(-1)
        jump = np.append(flat, big)[flat].reshape(mask.shape)  # follow the label once, as roots name themselves
        new = np.where(mask, np.minimum(low, jump), big)
        if (new == at).all():
            break
        at = new
    return np.where(mask, np.unique(at, return_inverse=True)[1].reshape(mask.shape) + 1, 0)


def lab(rgb: np.ndarray) -> np.ndarray:
    """sRGB (0-255) to CIE L*a*b* under D65."""
    c = rgb / 255
    c = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    xyz = c @ np.array([[0.4124564, 0.2126729, 0.0193339], [0.3575761, 0.7151522, 0.1191920], [0.1804375, 0.0721750, 0.9503041]]) / np.array([0.95047, 1.0, 1.08883])
    f = np.where(xyz > 216 / 24389, np.cbrt(xyz), (24389 / 27 * xyz + 16) / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def correlation(sample: np.ndarray, template: np.ndarray, mask: np.ndarray | None = None) -> float:
    """Masked zero-mean normalised correlation; share of equal pixels where one side is flat."""
    m = np.ones(sample.shape, bool) if mask is None else mask
    a, b = sample[m] - sample[m].mean(), template[m] - template[m].mean()
    size = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / size) if size > 0 else float((sample[m] == template[m]).mean())


def features_of(a: np.ndarray) -> dict[str, float]:
    """Luminance, balance, colourfulness, edge density and background share of a page."""
    g = grey(a)
    color = (a.max(-1) - a.min(-1)) / np.maximum(a.max(-1), 1) if a.ndim == 3 else np.zeros(g.shape)
    levels = np.bincount(np.minimum(g // 16, 15).astype(int).reshape(-1), minlength=16)
    return {"aspect_ratio": g.shape[1] / g.shape[0], "mean_luminance": float(g.mean()), "dark_light_balance": float((g < 85).mean() - (g > 170).mean()), "colorfulness": float(color.mean()), "edge_density": float((np.hypot(*sobel(g)) > 100).mean()), "background": float(levels.max() / g.size)}


FEATURES = "id long, aspect_ratio double, mean_luminance double, dark_light_balance double, colorfulness double, edge_density double, background double"
SEGMENTS = "id long, label int, x int, y int, w int, h int, area long"


def page_features(images: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [{"id": i} | features_of(raster(p, w, h)) for i, w, h, p in zip(b.id, b.width, b.height, b.pixels)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])

    return images.select("id", "width", "height", "pixels").mapInPandas(run, FEATURES)


def segments(images: DataFrame, dark: float = 128.0, longest: int = 1600) -> DataFrame:
    """Connected dark regions of each page with their boxes."""

    def run(batches):
        for b in batches:
            rows = []
            for i, w, h, p in zip(b.id, b.width, b.height, b.pixels):
                marks = labelled(grey(resized(raster(p, w, h), longest)) < dark)
                for k in range(1, marks.max() + 1):
                    y, x = np.nonzero(marks == k)
                    rows.append((i, k, x.min(), y.min(), np.ptp(x) + 1, np.ptp(y) + 1, len(x)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    return images.select("id", "width", "height", "pixels").mapInPandas(run, SEGMENTS)
