"""Image measurements with numpy, for Arrow batches of the image source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("brightness", "contrast", "color_warmth", "edge_density", "sharpness", "high_freq_ratio", "spectral_peak_ratio", "spectral_peak_count", "patch_score", "patch_row", "patch_col", "patch_uniformity", "block_max_z", "block_flagged")


def grey(rgb: np.ndarray) -> np.ndarray:
    return rgb.astype(np.float64) if rgb.ndim == 2 else rgb[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def resize(g: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    y = np.clip((np.arange(h) + 0.5) * g.shape[0] / h - 0.5, 0, g.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * g.shape[1] / w - 0.5, 0, g.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, g.shape[0] - 1), np.minimum(x0 + 1, g.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = g[np.ix_(y0, x0)] * (1 - fx) + g[np.ix_(y0, x1)] * fx
    low = g[np.ix_(y1, x0)] * (1 - fx) + g[np.ix_(y1, x1)] * fx
    return top * (1 - fy) + low * fy


def spectrum(g: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.fftshift(np.fft.fft2(g - g.mean())))


def _radius(shape: tuple[int, int]) -> tuple[np.ndarray, float]:
    cy, cx = shape[0] / 2, shape[1] / 2
    y, x = np.ogrid[: shape[0], : shape[1]]
    return np.hypot(y - cy, x - cx), float(np.hypot(cy, cx))


def high_frequency_ratio(g: np.ndarray, cutoff: float = 0.25) -> float:
    e = spectrum(g) ** 2
    r, half = _radius(e.shape)
    total = e.sum()
    return float(np.clip(e[r > cutoff * half].sum() / total, 0, 1)) if total > 0 else 0.0


def radial_profile(g: np.ndarray, rings: int = 16) -> np.ndarray:
    e = spectrum(g) ** 2
    r, half = _radius(e.shape)
    out = np.bincount(np.minimum((r / half * rings).astype(int), rings - 1).ravel(), e.ravel(), rings)
    return out / out.sum() if out.sum() > 0 else out


def spectral_peaks(g: np.ndarray) -> tuple[float, float]:
    """(peak over median, bins over 20 medians), the block around zero frequency left out."""
    s = spectrum(g)
    cy, cx, k = s.shape[0] // 2, s.shape[1] // 2, max(2, min(s.shape) // 32)
    s[cy - k : cy + k + 1, cx - k : cx + k + 1] = 0
    med = float(np.median(s[s > 0])) if (s > 0).any() else 0.0
    return (float(s.max() / med), float((s > 20 * med).sum())) if med > 0 else (0.0, 0.0)


def box_mean(g: np.ndarray, size: int) -> np.ndarray:
    """Mean over the window around each pixel, edges reflected, by a summed-area table."""
    a = size // 2
    p = np.pad(g, ((a, size - 1 - a),) * 2, mode="symmetric")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / size**2


def patch_score(g: np.ndarray, size: int = 16) -> tuple[float, int, int, float]:
    """Largest uniformity times deviation of a window: (score, row, column, uniformity)."""
    size = min(size, *g.shape)
    if size < 2:
        return 0.0, 0, 0, 0.0
    m, sq, sd = box_mean(g, size), box_mean(g * g, size), g.std() + 1e-6
    uniform = np.clip(1 - np.sqrt(np.maximum(sq - m * m, 0)) / sd, 0, 1)
    score = uniform * np.abs(m - g.mean()) / sd
    r, c = np.unravel_index(int(score.argmax()), score.shape)
    return float(score[r, c]), int(r), int(c), float(uniform[r, c])


def blocks(g: np.ndarray, size: int = 16) -> np.ndarray:
    h, w = g.shape[0] // size, g.shape[1] // size
    return g[: h * size, : w * size].reshape(h, size, w, size).swapaxes(1, 2).reshape(-1, size, size)


def robust_z(x: np.ndarray) -> np.ndarray:
    d = x - np.median(x)
    mad, mean = np.median(np.abs(d)), np.abs(d).mean()
    return 0.6745 * d / mad if mad >= 1e-12 else d / (1.253314 * mean) if mean >= 1e-12 else np.zeros_like(d)


def anomalous_blocks(g: np.ndarray, size: int = 16, limit: float = 4.0) -> tuple[float, int]:
    """(largest |z|, number of blocks at or over the limit) of block variances and gradients."""
    if min(g.shape) < 2 * size:
        return 0.0, 0
    v = blocks(g, size).reshape(-1, size * size).var(1)
    if len(v) < 4:
        return 0.0, 0
    gy, gx = np.gradient(g)
    z = np.maximum(np.abs(robust_z(v)), np.abs(robust_z(blocks(np.hypot(gx, gy), size).reshape(len(v), -1).mean(1))))
    return float(z.max()), int((z >= limit).sum())


def phash(g: np.ndarray) -> int:
    """64-bit perceptual hash: 8x8 low DCT coefficients of a 32x32 image against their median, first row and column left out of it."""
    n = 32
    k = np.arange(n)
    dct = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (dct @ resize(g, n, n) @ dct.T)[:8, :8]
    bits = (low > np.median(low[1:, 1:])).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def ssim(a: np.ndarray, b: np.ndarray, side: int = 128, taps: int = 11, sigma: float = 1.5) -> float:
    """Mean structural similarity of two grey images at side x side, Gaussian window."""
    a, b = resize(a, side, side), resize(b, side, side)
    w = np.exp(-((np.arange(taps) - taps // 2) ** 2) / (2 * sigma**2))
    w /= w.sum()

    def blur(x: np.ndarray) -> np.ndarray:
        p = np.pad(x, taps // 2, mode="symmetric")
        p = sum(w[i] * p[i : i + side] for i in range(taps))
        return sum(w[i] * p[:, i : i + side] for i in range(taps))

    ma, mb = blur(a), blur(b)
    va, vb, c = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float((((2 * ma * mb + c1) * (2 * c + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


def corner(row: float, col: float, height: int, width: int) -> str:
    v = "top" if row < 0.4 * height else "bottom" if row > 0.6 * height else ""
    h = "left" if col < 0.4 * width else "right" if col > 0.6 * width else ""
    return f"{v}-{h}" if v and h else "center" if not v and not h else (v or h)


def measure(rgb: np.ndarray) -> tuple:
    g = grey(rgb)
    gy, gx = np.gradient(g) if min(g.shape) > 1 else (np.zeros_like(g),) * 2
    p = np.pad(g, 1, mode="edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    warm = float(np.clip(rgb[..., 0].mean() / (rgb[..., 2].mean() + 1e-6), 0, 10)) if rgb.ndim == 3 and rgb.shape[2] >= 3 else 1.0
    ratio, count = spectral_peaks(g)
    score, r, c, u = patch_score(g)
    z, n = anomalous_blocks(g)
    return float(g.mean()), float(g.std()), warm, float((np.hypot(gx, gy) > 25).mean()), float(lap.var()), high_frequency_ratio(g), ratio, count, score, float(r), float(c), u, z, float(n)


def _pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return x[..., 0] if channels == 1 else x[..., 2::-1]  # the image source keeps blue, green, red


#: Side of the grey tile that an image is compared by.
SIDE = 128


def embed_pixels(rgb: np.ndarray, side: int = 16) -> np.ndarray:
    """A vector of an image without a model: its grey pixels at side x side, centred and of length 1, and its mean colours."""
    g = resize(grey(rgb), side, side).ravel()
    g = g - g.mean()
    colour = rgb.reshape(-1, rgb.shape[2])[:, :3].mean(0) / 255 if rgb.ndim == 3 else np.full(3, rgb.mean() / 255)
    return np.concatenate((g / max(np.linalg.norm(g), 1e-9), colour))


def image_rows(images: DataFrame, embed: Callable[[np.ndarray], np.ndarray] = embed_pixels) -> DataFrame:
    """image_features with `tile`, the grey image of SIDE x SIDE in bytes, and `embedding`, what embed gives for its pixels (height, width,
    red green blue): a model's features, say. Each image is decoded once."""
    src = images.filter("image.height > 0").select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                x = _pixels(r.height, r.width, r.nChannels, r.data)
                tile = np.clip(np.rint(resize(grey(x), SIDE, SIDE)), 0, 255).astype(np.uint8).tobytes()
                out.append((r.path, r.width, r.height, phash(grey(x)), *measure(x), tile, np.asarray(embed(x), float).tolist()))
            yield pd.DataFrame(out, columns=["path", "width", "height", "phash", *FIELDS, "tile", "embedding"])

    return src.mapInPandas(scan, "path string, width int, height int, phash bigint, " + ", ".join(f"{f} double" for f in FIELDS) + ", tile binary, embedding array<double>")


def tile_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Structural similarity of tiles of image_rows."""
    read = lambda t: np.frombuffer(t, np.uint8).reshape(SIDE, SIDE).astype(float)
    return pd.Series([ssim(read(x), read(y), SIDE) for x, y in zip(a, b)], dtype=float)


def image_features(images: DataFrame) -> DataFrame:
    """One row for each readable image of the image source: path, width, height, phash and all measurements."""
    src = images.filter("image.height > 0").select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                x = _pixels(r.height, r.width, r.nChannels, r.data)
                out.append((r.path, r.width, r.height, phash(grey(x)), *measure(x)))
            yield pd.DataFrame(out, columns=["path", "width", "height", "phash", *FIELDS])

    return src.mapInPandas(scan, "path string, width int, height int, phash bigint, " + ", ".join(f"{f} double" for f in FIELDS))
