"""The operations of ``gradients`` on bare arrays, for running a model without training it."""

from __future__ import annotations

import numpy as np


def value(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, dtype=np.float32)


def raw(x: np.ndarray) -> np.ndarray:
    return x


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


tanh = np.tanh


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def concat(*parts: np.ndarray) -> np.ndarray:
    return np.concatenate(parts, axis=-1)


def take(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return table[rows]


def part(x: np.ndarray, start: int, stop: int) -> np.ndarray:
    return x[..., start:stop]


def reshape(x: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    return x.reshape(shape)


def total(x: np.ndarray, axis: int) -> np.ndarray:
    return x.sum(axis=axis)


def layer_norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray, epsilon: float = 1e-5) -> np.ndarray:
    return (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + epsilon) * scale + shift
