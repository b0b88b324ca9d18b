"""Images to arrays: decoding, resizing, scaling by channel, and frozen encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Mean and deviation of the colour channels.
MEAN = np.array([0.485, 0.456, 0.406])
DEVIATION = np.array([0.229, 0.224, 0.225])
SIDE = 224


def decode_ppm(raw: bytes) -> np.ndarray:
    """Height x width x 3 of a binary PPM; other formats need a decoder of their own."""
    head, at = [], 0
    while len(head) < 4 and at < len(raw):
        if raw[at : at + 1].isspace():
            at += 1
        elif raw[at : at + 1] == b"#":
            at = raw.find(b"\n", at) % (len(raw) + 1)
        else:
            end = at
            while end < len(raw) and not raw[end : end + 1].isspace():
                end += 1
            head.append(raw[at:end])
            at = end
    if len(head) < 4:
        raise ValueError("not a PPM")
    if head[0] != b"P6" or int(head[3]) != 255:
        raise ValueError("not a binary 8-bit PPM")
    width, height = int(head[1]), int(head[2])
    return np.frombuffer(raw, np.uint8, width * height * 3, at + 1).reshape(height, width, 3)


def resize(image: np.ndarray, height: int = SIDE, width: int = SIDE) -> np.ndarray:
    """Bilinear, whatever the aspect; samples lie at the middle of cells."""
    image = np.asarray(image, dtype=np.float64)

    def weights(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = weights(image.shape[0], height)
    x0, x1, fx = weights(image.shape[1], width)
    extra = (1,) * (image.ndim - 2)
    fy, fx = fy.reshape(-1, 1, *extra), fx.reshape(1, -1, *extra)
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def to_tensor(image: np.ndarray) -> np.ndarray:
    """3 x 224 x 224, scaled to 0..1 and by channel."""
    scaled = resize(image) / 255.0
    return ((scaled - MEAN) / DEVIATION).transpose(2, 0, 1).astype(np.float32)


def attention_overlay(weights: np.ndarray, side: int = 7, out: int = SIDE, epsilon: float = 1e-8) -> np.ndarray:
    """A flat map of cells as a picture of weights from 0 to 1: resized first, then scaled."""
    big = resize(np.asarray(weights).reshape(side, side), out, out)
    return (big - big.min()) / (big.max() - big.min() + epsilon)


def grid_encoder(dim: int = 2048, cells: int = 7, seed: int = 0) -> Callable[[np.ndarray], np.ndarray]:
    """A frozen stand-in for a pretrained network: mean colours of a grid through a fixed projection, as cells x ``dim``."""
    projection = np.random.default_rng(seed).normal(0, 1, (3, dim)) / np.sqrt(3)

    def run(tensor: np.ndarray) -> np.ndarray:
        step = tensor.shape[1] // cells
        pooled = tensor[:, : step * cells, : step * cells].reshape(3, cells, step, cells, step).mean(axis=(2, 4))
        return np.maximum(pooled.reshape(3, -1).T @ projection, 0)

    return run


def from_pixels(pixels: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Height x width x 3, red first, of bytes with blue first; grey and transparent images become colour ones."""
    raw = np.frombuffer(pixels, np.uint8).reshape(height, width, channels)
    return np.repeat(raw, 3, axis=2) if channels == 1 else raw[:, :, 2::-1]


def encode_images(
    images: DataFrame, make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]], spatial: bool = False,
    decode: Callable[[bytes], np.ndarray] = decode_ppm,
) -> DataFrame:
    """``(path, feature)`` of ``(path, content)`` or of decoded images; the encoder is made once per task, an unreadable image drops out.

    ``feature`` is one vector, the mean of the cells, or with ``spatial`` all cells.
    """
    decoded = "pixels" in images.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        for batch in batches:
            paths, features = [], []
            for path, *content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    cells = encoder(to_tensor(from_pixels(*content) if decoded else decode(*content)))
                except (ValueError, IndexError, TypeError):
                    continue
                paths.append(path)
                features.append((cells if spatial else cells.mean(axis=0)).astype(np.float32).tolist())
            kind = pa.list_(pa.list_(pa.float32())) if spatial else pa.list_(pa.float32())
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(features, kind)], ["path", "feature"])

    schema = "path string, feature array<array<float>>" if spatial else "path string, feature array<float>"
    wanted = ("pixels", "height", "width", "channels") if decoded else ("content",)
    return images.select("path", *wanted).mapInArrow(run, schema)
