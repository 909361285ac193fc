"""Colour measures of small BGR crops, in numpy, with column wrappers over raw pixel bytes.

Hue runs from 0 to 180, saturation and value from 0 to 255.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shares of a crop's height and width that bound the torso, and of a box's.
TORSO = (0.15, 0.55, 0.20, 0.80)
BOX_TORSO = (0.15, 0.45, 0.20, 0.80)
#: How near to the border's hue, and how saturated, background pixels are.
HUE_TOLERANCE, SATURATION_FLOOR, NEUTRAL, MIN_FOREGROUND, MIN_CHROMA_PIXELS = 12.0, 0.25, 128, 30, 10
#: Input size and channel statistics (red, green, blue) of the embedding networks.
NETWORK_SIZE, CHANNEL_MEAN, CHANNEL_STD = (256, 128), (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def window(height: int, width: int, shares: tuple[float, float, float, float] = TORSO) -> tuple[slice, slice]:
    top, bottom, left, right = shares
    return slice(int(top * height), int(bottom * height)), slice(int(left * width), int(right * width))


def to_hsv(bgr: np.ndarray) -> np.ndarray:
    """Hue, saturation and value of an array whose last axis is blue, green, red."""
    x = bgr.astype(float) / 255
    blue, green, red = np.moveaxis(x, -1, 0)
    high, span = x.max(-1), np.ptp(x, axis=-1)
    safe = np.where(span > 1e-8, span, 1)
    sectors = [np.mod((green - blue) / safe, 6), (blue - red) / safe + 2, (red - green) / safe + 4]
    hue = np.select([span <= 1e-8, high == red, high == green], [0.0, *sectors[:2]], sectors[2])
    saturation = np.where(high > 1e-8, span / np.maximum(high, 1e-8), 0)
    return np.stack([hue * 30, saturation * 255, high * 255], -1)


def torso(crop: np.ndarray, least: int = 4) -> np.ndarray:
    """The torso of a crop, or the whole crop where it is too small for one."""
    height, width = crop.shape[:2]
    part = crop[window(height, width)] if min(height, width) >= least else crop
    return part if part.size else crop


def torso_hsv(crop: np.ndarray) -> np.ndarray:
    return to_hsv(torso(crop)).reshape(-1, 3).mean(0)


def border_hue(hsv: np.ndarray) -> float:
    """Median hue along the four edges."""
    edges = [hsv[0], hsv[-1], hsv[:, 0], hsv[:, -1]]
    return float(np.median(np.concatenate([e[:, 0] for e in edges])))


def like_background(hsv: np.ndarray, hue: float, tolerance: float = HUE_TOLERANCE, floor: float = SATURATION_FLOOR) -> np.ndarray:
    off = np.abs(hsv[..., 0] - hue)
    return (np.minimum(off, 180 - off) < tolerance) & (hsv[..., 1] / 255 > floor)


def kit_chroma(crop: np.ndarray) -> np.ndarray:
    """Mean of saturation times hue direction over the torso without background: vivid kits are long."""
    hsv = to_hsv(torso(crop, 6)).reshape(-1, 3)
    keep = ~like_background(hsv, border_hue(to_hsv(crop)))
    if keep.sum() < MIN_CHROMA_PIXELS:
        keep[:] = True
    angle, strength = np.deg2rad(2 * hsv[keep, 0]), hsv[keep, 1] / 255
    return np.array([(strength * np.cos(angle)).mean(), (strength * np.sin(angle)).mean()])


def without_background(crop: np.ndarray, neutral: int = NEUTRAL, least: int = MIN_FOREGROUND) -> np.ndarray:
    """The torso with background pixels made neutral, unless hardly anything would be left."""
    height, width = crop.shape[:2]
    if min(height, width) < 6:
        return crop
    at = window(height, width)
    hsv, part = to_hsv(crop), crop[at].copy()
    background = like_background(hsv[at], border_hue(hsv))
    if (~background).sum() >= least:
        part[background] = neutral
    return part


def box_color(frame: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Mean blue, green and red of the torso inside a box; zeros for a box without area."""
    left, top, right, bottom = (int(round(v)) for v in box)
    part = frame[max(0, top) : max(0, bottom), max(0, left) : max(0, right)]
    if not part.size:
        return np.zeros(3)
    inner = part[window(part.shape[0], part.shape[1], BOX_TORSO)]
    return (inner if inner.size else part).reshape(-1, 3).mean(0)


def network_input(crop: np.ndarray) -> np.ndarray:
    """Channels, height, width as the embedding networks expect them (bilinear, pixel centres)."""
    (rows, columns), (height, width) = NETWORK_SIZE, crop.shape[:2]

    def taps(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, size - 1), at - low

    y0, y1, fy = taps(rows, height)
    x0, x1, fx = taps(columns, width)
    c = crop.astype(np.float32)
    across = c[:, x0] * (1 - fx)[:, None] + c[:, x1] * fx[:, None]
    down = across[y0] * (1 - fy)[:, None, None] + across[y1] * fy[:, None, None]
    scaled = (down[..., ::-1] / 255 - np.array(CHANNEL_MEAN)) / np.array(CHANNEL_STD)
    return scaled.transpose(2, 0, 1).astype(np.float32)


def _crop(pixels: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(height, width, 3)


def _column(measure):
    def run(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([
            None if p is None or not h or not w else np.asarray(measure(_crop(p, int(h), int(w))), float).tolist()
            for p, h, w in zip(pixels, height, width, strict=True)
        ])

    return run


def torso_hsv_column(pixels: Column | str, height: Column | str, width: Column | str) -> Column:
    """array<double> of hue, saturation, value; null without pixels."""
    return F.pandas_udf(_column(torso_hsv), "array<double>")(pixels, height, width)


def kit_chroma_column(pixels: Column | str, height: Column | str, width: Column | str) -> Column:
    return F.pandas_udf(_column(kit_chroma), "array<double>")(pixels, height, width)


def without_background_column(pixels: Column | str, height: Column | str, width: Column | str) -> Column:
    """struct<pixels, height, width> of the torso with a neutral background; null without pixels."""

    def run(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
        out = []
        for p, h, w in zip(pixels, height, width, strict=True):
            part = None if p is None or not h or not w else without_background(_crop(p, int(h), int(w)))
            out.append((None, None, None) if part is None else (part.tobytes(), *part.shape[:2]))
        made = pd.DataFrame(out, columns=["pixels", "height", "width"])
        return made.astype({"height": "Int32", "width": "Int32"})

    found = F.pandas_udf(run, "pixels binary, height int, width int")(pixels, height, width)
    return F.when(F.col(pixels).isNotNull() if isinstance(pixels, str) else pixels.isNotNull(), found)


def box_color_column(pixels: Column | str, height: Column | str, width: Column | str, box: Column | str) -> Column:
    """array<double> of the mean blue, green and red of the torso inside ``box`` (x1, y1, x2, y2) of a frame."""

    def run(pixels: pd.Series, height: pd.Series, width: pd.Series, box: pd.Series) -> pd.Series:
        return pd.Series([
            None if p is None or b is None or not h or not w else box_color(_crop(p, int(h), int(w)), tuple(b)).tolist()
            for p, h, w, b in zip(pixels, height, width, box, strict=True)
        ])

    return F.pandas_udf(run, "array<double>")(pixels, height, width, box)


def network_input_column(pixels: Column | str, height: Column | str, width: Column | str) -> Column:
    """array<float>: channels, rows and columns as the embedding networks expect them, flattened; null without pixels."""
    return F.pandas_udf(_column(lambda crop: network_input(crop).ravel()), "array<float>")(pixels, height, width)


def element_medians(vector: Column | str, size: int) -> Column:
    """Aggregate: the median of each element, for one vector per track."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.array(*[F.median(v[i]) for i in range(size)])
