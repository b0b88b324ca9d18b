"""Reverse-mode derivatives for the few operations the caption models use."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Value:
    """An array, and how its derivative flows back to what it was made of."""

    def __init__(self, data: np.ndarray, parents: tuple[Value, ...] = (), back: Callable[[np.ndarray], tuple] | None = None):
        self.data = np.asarray(data, dtype=np.float64)
        self.parents, self.back = parents, back
        self.grad: np.ndarray | None = None

    def __add__(self, other: Value) -> Value:
        return Value(self.data + other.data, (self, other), lambda g: (_fit(g, self.data.shape), _fit(g, other.data.shape)))

    def __mul__(self, other: Value) -> Value:
        return Value(
            self.data * other.data, (self, other),
            lambda g: (_fit(g * other.data, self.data.shape), _fit(g * self.data, other.data.shape)),
        )

    def __matmul__(self, other: Value) -> Value:
        def back(g: np.ndarray) -> tuple:
            a = self.data.reshape(-1, self.data.shape[-1])
            return g @ other.data.T, a.T @ g.reshape(-1, g.shape[-1])

        return Value(self.data @ other.data, (self, other), back)

    def backward(self) -> None:
        order, seen = [], set()
        stack = [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack.extend((p, False) for p in node.parents)
        self.grad = np.ones_like(self.data)
        for node in reversed(order):
            if node.back is None or node.grad is None:
                continue
            for parent, g in zip(node.parents, node.back(node.grad)):
                parent.grad = g if parent.grad is None else parent.grad + g


def _fit(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A derivative summed over the axes that were broadcast."""
    while g.ndim > len(shape):
        g = g.sum(axis=0)
    for axis, n in enumerate(shape):
        if n == 1 and g.shape[axis] != 1:
            g = g.sum(axis=axis, keepdims=True)
    return g


def value(x: np.ndarray) -> Value:
    return Value(x)


def raw(x: Value) -> np.ndarray:
    return x.data


def relu(x: Value) -> Value:
    return Value(np.maximum(x.data, 0), (x,), lambda g: (g * (x.data > 0),))


def tanh(x: Value) -> Value:
    y = np.tanh(x.data)
    return Value(y, (x,), lambda g: (g * (1 - y * y),))


def sigmoid(x: Value) -> Value:
    y = 1 / (1 + np.exp(-np.clip(x.data, -60, 60)))
    return Value(y, (x,), lambda g: (g * y * (1 - y),))


def softmax(x: Value) -> Value:
    e = np.exp(x.data - x.data.max(axis=-1, keepdims=True))
    y = e / e.sum(axis=-1, keepdims=True)
    return Value(y, (x,), lambda g: (y * (g - (g * y).sum(axis=-1, keepdims=True)),))


def concat(*parts: Value) -> Value:
    cuts = np.cumsum([p.data.shape[-1] for p in parts])[:-1]
    return Value(np.concatenate([p.data for p in parts], axis=-1), parts, lambda g: tuple(np.split(g, cuts, axis=-1)))


def take(table: Value, rows: np.ndarray) -> Value:
    def back(g: np.ndarray) -> tuple:
        out = np.zeros_like(table.data)
        np.add.at(out, rows, g)
        return (out,)

    return Value(table.data[rows], (table,), back)


def part(x: Value, start: int, stop: int) -> Value:
    def back(g: np.ndarray) -> tuple:
        out = np.zeros_like(x.data)
        out[..., start:stop] = g
        return (out,)

    return Value(x.data[..., start:stop], (x,), back)


def reshape(x: Value, shape: tuple[int, ...]) -> Value:
    return Value(x.data.reshape(shape), (x,), lambda g: (g.reshape(x.data.shape),))


def total(x: Value, axis: int) -> Value:
    return Value(x.data.sum(axis=axis), (x,), lambda g: (np.broadcast_to(np.expand_dims(g, axis), x.data.shape).copy(),))


def layer_norm(x: Value, scale: Value, shift: Value, epsilon: float = 1e-5) -> Value:
    mean = x.data.mean(axis=-1, keepdims=True)
    inv = 1 / np.sqrt(x.data.var(axis=-1, keepdims=True) + epsilon)
    unit = (x.data - mean) * inv

    def back(g: np.ndarray) -> tuple:
        d = g * scale.data
        dx = inv * (d - d.mean(axis=-1, keepdims=True) - unit * (d * unit).mean(axis=-1, keepdims=True))
        return dx, _fit(g * unit, scale.data.shape), _fit(g, shift.data.shape)

    return Value(unit * scale.data + shift.data, (x, scale, shift), back)


def cross_entropy(logits: Value, targets: np.ndarray, ignore: int) -> Value:
    """Mean over targets other than ``ignore``; 0 if there is none."""
    e = logits.data - logits.data.max(axis=-1, keepdims=True)
    on = targets != ignore
    n = max(1, int(on.sum()))
    rows = np.arange(len(targets))
    aimed = e[rows, targets]
    np.exp(e, out=e)
    sums = e.sum(axis=-1)

    def back(g: np.ndarray) -> tuple:
        each = g * on / n
        d = e * (each / sums)[:, None]
        d[rows, targets] -= each
        return (d,)

    return Value(((np.log(sums) - aimed) * on).sum() / n, (logits,), back)
