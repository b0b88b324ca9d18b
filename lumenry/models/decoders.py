"""Style-conditioned LSTM caption decoders: four ways to bring in the style, and one with spatial attention."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

import numpy as np

from lumenry.models import gradients, plain
from lumenry.models.gradients import Value
from lumenry.operators.vocabulary import EOS, MAX_LEN, PAD, SOS

# The order decides which of equally good models counts as best.
KINDS = ("Baseline", "Emotion@Start", "Emotion@Every", "CrossAttention")
SPATIAL = "SpatialAttention"


@dataclasses.dataclass(frozen=True)
class Sizes:
    vocab: int
    styles: int = 5
    word: int = 256
    style: int = 64
    hidden: int = 512
    visual: int = 2048


def init(kind: str, sizes: Sizes, seed: int = 0) -> dict[str, np.ndarray]:
    """Seeded weights of a decoder; the row of the padding word is zero."""
    rng = np.random.default_rng(seed)

    def dense(n: int, m: int) -> np.ndarray:
        return rng.uniform(-1, 1, (n, m)) / np.sqrt(n)

    s = sizes
    weights = {"word": rng.normal(0, 1, (s.vocab, s.word)), "out_w": dense(s.hidden, s.vocab), "out_b": np.zeros(s.vocab)}
    weights["word"][PAD] = 0
    step_in = s.word
    if kind != "Baseline":
        weights["style"] = rng.normal(0, 1, (s.styles, s.style))
    if kind in ("Baseline", "CrossAttention"):
        weights["init_w"] = dense(s.visual, s.hidden)
    else:
        weights["init_w"] = dense(s.visual + s.style, s.hidden)
    weights["init_b"] = np.zeros(s.hidden)
    if kind == "Emotion@Every":
        step_in += s.style
    if kind == "CrossAttention":
        weights |= {
            "value_w": dense(s.style, s.hidden), "value_b": np.zeros(s.hidden), "mix_w": dense(s.hidden, s.hidden), "mix_b": np.zeros(s.hidden),
            "norm_scale": np.ones(s.hidden), "norm_shift": np.zeros(s.hidden),
        }
    if kind == SPATIAL:
        step_in += s.visual + s.style
        weights |= {
            "cell_w": dense(s.visual + s.style, s.hidden), "cell_b": np.zeros(s.hidden), "ask_w": dense(s.hidden, s.visual),
            "ask_b": np.zeros(s.visual), "key_w": dense(s.visual, s.visual), "key_b": np.zeros(s.visual), "score_w": dense(s.visual, 1),
        }
    weights |= {"step_w": dense(step_in, 4 * s.hidden), "carry_w": dense(s.hidden, 4 * s.hidden), "step_b": np.zeros(4 * s.hidden)}
    return weights


def parameter_count(weights: dict[str, np.ndarray]) -> int:
    return sum(w.size for w in weights.values())


class _Run:
    """One pass over a batch: the state of the decoder and the step from a word to the next word's scores."""

    def __init__(self, ops, kind: str, weights: dict, visual: np.ndarray, style):
        self.ops, self.kind, self.w, self.style = ops, kind, weights, style
        w, self.visual, self.shape = weights, ops.value(visual), visual.shape
        flat = self.visual
        if kind == SPATIAL:
            flat = ops.total(self.visual, 1) * ops.value(np.array(1 / self.shape[1]))
            self.keys = self.visual @ w["key_w"] + w["key_b"]
        start = flat if kind in ("Baseline", "CrossAttention") else ops.concat(flat, style)
        first = start @ w["init_w"] + w["init_b"]
        self.h = ops.tanh(first) if kind == SPATIAL else ops.relu(first)
        self.c = ops.tanh(start @ w["cell_w"] + w["cell_b"]) if kind == SPATIAL else ops.value(np.zeros_like(ops.raw(self.h)))
        # With a single style to attend to the weights are 1, so what attention adds is one vector per style.
        self.added = (style @ w["value_w"] + w["value_b"]) @ w["mix_w"] + w["mix_b"] if kind == "CrossAttention" else None
        self.weights = None

    def step(self, tokens: np.ndarray):
        ops, w = self.ops, self.w
        x = ops.take(w["word"], tokens)
        if self.kind == "Emotion@Every":
            x = ops.concat(x, self.style)
        elif self.kind == SPATIAL:
            batch, cells, width = self.shape
            asked = ops.reshape(self.h @ w["ask_w"] + w["ask_b"], (batch, 1, width))
            scores = ops.reshape(ops.tanh(asked + self.keys) @ w["score_w"], (batch, cells))
            self.weights = ops.softmax(scores)
            context = ops.total(ops.reshape(self.weights, (batch, cells, 1)) * self.visual, 1)
            x = ops.concat(x, context, self.style)
        gates = x @ w["step_w"] + self.h @ w["carry_w"] + w["step_b"]
        n = ops.raw(self.h).shape[-1]
        keep, forget = ops.sigmoid(ops.part(gates, 0, n)), ops.sigmoid(ops.part(gates, n, 2 * n))
        new, show = ops.tanh(ops.part(gates, 2 * n, 3 * n)), ops.sigmoid(ops.part(gates, 3 * n, 4 * n))
        self.c = forget * self.c + keep * new
        self.h = show * ops.tanh(self.c)
        top = self.h
        if self.added is not None:
            top = ops.layer_norm(self.h + self.added, w["norm_scale"], w["norm_shift"])
        return top @ w["out_w"] + w["out_b"]


def loss(kind: str, weights: dict[str, Value], visual: np.ndarray, style_ids: np.ndarray, token_ids: np.ndarray) -> Value:
    """Mean cross-entropy of each next word, padding left out."""
    style = None if kind == "Baseline" else gradients.take(weights["style"], style_ids)
    run = _Run(gradients, kind, weights, visual, style)
    losses, counts = [], []
    for t in range(token_ids.shape[1] - 1):
        target = token_ids[:, t + 1]
        n = int((target != PAD).sum())
        if not n:
            break
        losses.append(gradients.cross_entropy(run.step(token_ids[:, t]), target, PAD))
        counts.append(n)
    out = Value(np.array(0.0))
    for one, n in zip(losses, counts):
        out = out + one * Value(np.array(n / sum(counts)))
    return out


def generate(
    kind: str, weights: dict[str, np.ndarray], visual: np.ndarray, style_ids: np.ndarray | None = None, max_len: int = MAX_LEN,
    style_vectors: np.ndarray | None = None, trace: Callable[[np.ndarray], None] | None = None,
) -> np.ndarray:
    """Greedy words from the start on, until every row has ended or ``max_len``; after its end a row is padded.

    ``style_vectors`` replace the styles' own; ``trace`` gets the attention of each step.
    """
    held = {k: plain.value(v) for k, v in weights.items()}
    style = None
    if style_vectors is not None:
        style = plain.value(style_vectors)
    elif kind != "Baseline":
        style = held["style"][style_ids]
    run = _Run(plain, kind, held, visual, style)
    n = len(visual)
    tokens, alive, out = np.full(n, SOS), np.ones(n, dtype=bool), []
    for _ in range(max_len):
        scores = run.step(tokens)
        if trace and run.weights is not None:
            trace(run.weights)
        tokens = scores.argmax(axis=-1)
        out.append(np.where(alive, tokens, PAD))
        alive &= tokens != EOS
        if not alive.any():
            break
    return np.stack(out, axis=1) if out else np.zeros((n, 0), dtype=int)
