"""Image kernels on uint8 arrays (height, width, 3), for Arrow-batched UDFs.

Resizing is antialiased bilinear in fixed point, horizontal pass first, as the
common imaging libraries do it. Exact parity with them is not verified here, as
none is installed.
"""

from __future__ import annotations

import numpy as np

#: Histogram bins of hue, saturation and value; model input
#: normalisation; edges of preview, thumbnail, resized image and crop.
BINS = (16, 8, 8)
MEAN = np.array((0.485, 0.456, 0.406), dtype=np.float32)
DEVIATION = np.array((0.229, 0.224, 0.225), dtype=np.float32)
PREVIEW, THUMB, SHORT, CROP = 256, 64, 256, 224
_BITS = 22


def _kernel(size: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    scale = size / target
    reach = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    low = np.maximum((centre - reach + 0.5).astype(np.int64), 0)
    high = np.minimum((centre + reach + 0.5).astype(np.int64), size)
    at = low[:, None] + np.arange(int((high - low).max()))[None, :]
    weight = np.maximum(1.0 - np.abs((at - centre[:, None] + 0.5) / reach), 0.0) * (at < high[:, None])
    weight /= weight.sum(1, keepdims=True)
    return np.minimum(at, size - 1), np.floor(weight * (1 << _BITS) + 0.5).astype(np.int64)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image at another size; gray images have no channel axis."""

    def rows(a: np.ndarray, target: int) -> np.ndarray:
        if a.shape[0] == target:
            return a
        at, weight = _kernel(a.shape[0], target)
        out = np.empty((target, *a.shape[1:]), dtype=np.uint8)
        for i in range(target):
            total = np.tensordot(weight[i], a[at[i]].astype(np.int64), axes=1) + (1 << _BITS - 1)
            out[i] = np.clip(total >> _BITS, 0, 255)
        return out

    across = rows(np.swapaxes(image, 0, 1), width)
    return rows(np.ascontiguousarray(np.swapaxes(across, 0, 1)), height)


def require_rgb(image: np.ndarray) -> None:
    """Raise unless the image is nonempty RGB."""
    if image.ndim != 3 or image.shape[2] != 3 or min(image.shape[:2]) < 1 or image.dtype != np.uint8:
        raise ValueError("feature extraction needs a nonempty RGB image")


def gray(image: np.ndarray) -> np.ndarray:
    """Luma in fixed point."""
    r, g, b = (image[..., c].astype(np.int64) for c in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def hsv(image: np.ndarray) -> np.ndarray:
    """Hue, saturation and value, each in a byte."""
    rgb = image.astype(np.float64)
    top, low = rgb.max(-1), rgb.min(-1)
    span = top - low
    safe = np.where(span > 0, span, 1)
    single = lambda x: x.astype(np.float32).astype(np.float64)  # noqa: E731  steps are stored in single precision
    r, g, b = (single((top - rgb[..., c]) / safe) for c in range(3))
    hue = np.where(rgb[..., 0] == top, b - g, np.where(rgb[..., 1] == top, 2 + r - b, 4 + g - r))
    hue = np.where(span > 0, single(np.mod(single(hue) / 6 + 1, 1)), 0)
    saturation = np.where(span > 0, single(span / np.where(top > 0, top, 1)), 0)
    return np.stack([(hue * 255).astype(np.uint8), (saturation * 255).astype(np.uint8), top.astype(np.uint8)], -1)


def preview(image: np.ndarray, edge: int, upscale: bool = False) -> np.ndarray:
    """The image with its longer edge at most (or, upscaling, exactly) ``edge``."""
    height, width = image.shape[:2]
    scale = edge / max(height, width)
    scale = scale if upscale else min(1.0, scale)
    return resize(image, max(1, round(width * scale)), max(1, round(height * scale)))


def unit(vector: np.ndarray) -> np.ndarray:
    """The vector over its length as float32."""
    v = np.asarray(vector, dtype=np.float64)
    norm = np.linalg.norm(v) if v.ndim == 1 and v.size and np.isfinite(v).all() else 0.0
    if not norm or not np.isfinite(norm):
        raise ValueError("features must be finite with a nonzero length")
    return (v / norm).astype(np.float32)


def histogram(image: np.ndarray) -> np.ndarray:
    """Shares of hue, saturation and value bins of a preview, in unit length."""
    require_rgb(image)
    pixels = hsv(preview(image, PREVIEW)).reshape(-1, 3)
    return unit(np.concatenate([np.bincount(pixels[:, c] // (256 // n), minlength=n) / len(pixels) for c, n in enumerate(BINS)]))


def dhash(image: np.ndarray) -> int:
    """64 comparisons of neighbours in a 9 x 8 gray image, first one highest."""
    require_rgb(image)
    small = resize(gray(image), 9, 8)
    return int("".join("01"[int(x)] for x in (small[:, :-1] > small[:, 1:]).ravel()), 2)


def thumbnail(image: np.ndarray) -> np.ndarray:
    """64 x 64 bytes, centred on white."""
    require_rgb(image)
    small = preview(image, THUMB, upscale=True)
    out = np.full((THUMB, THUMB, 3), 255, dtype=np.uint8)
    top, left = (THUMB - small.shape[0]) // 2, (THUMB - small.shape[1]) // 2
    out[top : top + small.shape[0], left : left + small.shape[1]] = small
    return out


def crop(image: np.ndarray) -> np.ndarray:
    """The 224 x 224 centre of the image with its shorter edge at 256."""
    require_rgb(image)
    height, width = image.shape[:2]
    size = (SHORT, SHORT * height // width) if width <= height else (SHORT * width // height, SHORT)
    left, top = (round((s - CROP) / 2.0) for s in size)
    return resize(image, *size)[top : top + CROP, left : left + CROP]


def model_input(cropped: np.ndarray) -> np.ndarray:
    """A crop as the model's float32 [1, 3, 224, 224]."""
    scaled = cropped.astype(np.float32) / np.float32(255.0)
    return np.ascontiguousarray(((scaled - MEAN) / DEVIATION).transpose(2, 0, 1)[None], dtype=np.float32)
