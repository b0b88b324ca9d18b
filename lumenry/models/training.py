"""Training of the caption decoders over partitions of encoded rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenry.models import decoders
from lumenry.models.gradients import Value
from lumenry.models.inference import stack
from lumenry.operators.captions import plateau
from lumenry.operators.vocabulary import PAD, encode

Weights = dict[str, np.ndarray]
BATCH = 32
CHUNK = 65_536  # numbers of a weight vector that travel in one row


class Adam:
    """Adaptive rates; ``m``, ``v`` and ``t`` are what it has learnt, and go on from epoch to epoch."""

    def __init__(self, weights: Weights, lr: float, state: tuple[Weights, Weights, int] | None = None):
        self.lr = lr
        zeros = lambda: {k: np.zeros_like(v, dtype=np.float64) for k, v in weights.items()}
        self.m, self.v, self.t = (dict(state[0]), dict(state[1]), state[2]) if state else (zeros(), zeros(), 0)

    def step(self, weights: Weights, grads: Weights) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            weights[k] = weights[k] - self.lr * m / (np.sqrt(v) + 1e-8)


def gradients(kind: str, weights: Weights, visual: np.ndarray, styles: np.ndarray, ids: np.ndarray, clip: float = 5.0) -> tuple[float, Weights]:
    """Loss of a batch and its derivatives, their common length cut to ``clip``; the padding word has none."""
    held = {k: Value(v) for k, v in weights.items()}
    loss = decoders.loss(kind, held, visual, styles, ids)
    loss.backward()
    grads = {k: v.grad if v.grad is not None else np.zeros_like(v.data) for k, v in held.items()}
    grads["word"][PAD] = 0
    length = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
    if length > clip:
        grads = {k: g * (clip / (length + 1e-6)) for k, g in grads.items()}
    return float(loss.data), grads


def dataset(captions: DataFrame, features: DataFrame, vocabulary: DataFrame, key: str = "row_id", image: str = "image_id") -> DataFrame:
    """``(key, feature, emotion_id, token_ids)``: what the models train on.

    Captions are encoded (null ones drop out) and joined with the feature of
    their image; an image without a feature drops out, as does a null style.
    """
    ids = encode(captions, "emotion_caption", vocabulary, [key, image, "emotion_id"])
    return ids.where(F.col("emotion_id").isNotNull()).join(features.select(image, "feature"), image).select(key, "feature", "emotion_id", "token_ids")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            some = batch.slice(start, BATCH)
            visual, styles, ids = (some.column(c) for c in ("feature", "emotion_id", "token_ids"))
            yield stack(visual).astype(np.float64), styles.to_numpy(zero_copy_only=False).astype(int), stack(ids).astype(int)


def pack(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def unpack(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _sum_chunks(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(b, dtype=np.float64) for b in table.column("numbers").to_pylist()]
    return pa.table(
        {
            "chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "numbers": pa.array([np.sum(parts, axis=0).tobytes()], pa.binary()),
            "rows": pa.array([sum(table.column("rows").to_pylist())], pa.int64()), "loss": pa.array([sum(table.column("loss").to_pylist())], pa.float64()),
            "steps": pa.array([sum(table.column("steps").to_pylist())], pa.float64()), "task": pa.array([min(table.column("task").to_pylist())], pa.int32()),
        }
    )


_PIECES = "chunk int, numbers binary, rows bigint, loss double, steps double, task int"
ROUND = 32  # pieces of one chunk that are summed in one task


def train_epoch(
    rows: DataFrame, kind: str, weights: Weights, lr: float, state: tuple[Weights, Weights, int] | None = None, seed: int = 0
) -> tuple[Weights, float, tuple[Weights, Weights, int]]:
    """Weights, mean loss and the optimizer's state after one pass in an order drawn by ``seed``.

    Every partition trains from the same weights and state, and what they
    come to is averaged by rows: over the cluster, chunk by chunk, ``ROUND``
    tasks' pieces at a time, so the driver gets one set of each.
    """
    size = len(pack(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: v.copy() for k, v in weights.items()}
        adam, n, total = Adam(own, lr, state), 0, 0.0
        began = adam.t
        for visual, styles, ids in _batches(batches):
            loss, grads = gradients(kind, own, visual, styles, ids)
            adam.step(own, grads)
            n += len(ids)
            total += loss * len(ids)
        if n:
            flat = np.concatenate([pack(own), pack(adam.m), pack(adam.v)]) * n
            pieces = [flat[i : i + CHUNK] for i in range(0, len(flat), CHUNK)]
            m = len(pieces)
            yield pa.record_batch(
                [
                    pa.array(range(m), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary()), pa.array([n] * m, pa.int64()), pa.array([total] * m, pa.float64()),
                    pa.array([float((adam.t - began) * n)] * m), pa.array([TaskContext.get().partitionId()] * m, pa.int32()),
                ],
                ["chunk", "numbers", "rows", "loss", "steps", "task"],
            )

    shuffled = rows.select("feature", "emotion_id", "token_ids").sortWithinPartitions(F.xxhash64("token_ids", "emotion_id", F.lit(seed)))
    pieces = shuffled.mapInArrow(run, _PIECES)
    for width in (ROUND, ROUND * ROUND):
        pieces = pieces.groupBy("chunk", F.floor(F.col("task") / width)).applyInArrow(_sum_chunks, _PIECES)
    summed = sorted(pieces.groupBy("chunk").applyInArrow(_sum_chunks, _PIECES).collect(), key=lambda r: r["chunk"])
    if not summed:
        return weights, float("nan"), state or ({k: np.zeros_like(v) for k, v in weights.items()}, {k: np.zeros_like(v) for k, v in weights.items()}, 0)
    flat = np.concatenate([np.frombuffer(bytes(r["numbers"]), dtype=np.float64) / r["rows"] for r in summed])
    steps = round(summed[0]["steps"] / summed[0]["rows"]) + (state[2] if state else 0)
    new, m, v = (unpack(flat[i * size : (i + 1) * size], weights) for i in range(3))
    return new, summed[0]["loss"] / summed[0]["rows"], (m, v, steps)


def evaluate(rows: DataFrame, kind: str, weights: Weights, by: str = "rows") -> float:
    """Mean loss; batches weigh by their rows, or with ``by="words"`` by their words, which doesn't depend on the batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for visual, styles, ids in _batches(batches):
            loss = float(decoders.loss(kind, {k: Value(v) for k, v in weights.items()}, visual, styles, ids).data)
            n = len(ids) if by == "rows" else int((ids[:, 1:] != PAD).sum())
            yield pa.record_batch([pa.array([loss * n]), pa.array([n], pa.int64())], ["loss", "n"])

    found = rows.select("feature", "emotion_id", "token_ids").mapInArrow(run, "loss double, n bigint")
    total = found.agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
    return total["loss"] / total["n"] if total["n"] else float("nan")


def train(
    train_rows: DataFrame, val_rows: DataFrame | None, kind: str, weights: Weights, name: str, epochs: int = 15, lr: float = 3e-4, path: str | None = None, seed: int = 0
) -> tuple[Weights, DataFrame]:
    """The weights of the best epoch and the history ``(model, epoch, train_loss, val_loss)``.

    An epoch is best if its validation loss is strictly less than all before;
    its weights are saved at ``path``. The rate falls when the loss stalls.
    The optimizer's state goes on, and every epoch has an order of its own.
    Without ``val_rows`` the rate stays, and the last epoch's weights are kept.
    """
    best, best_loss, history, state = weights, float("inf"), [], None
    for epoch in range(1, epochs + 1):
        rate = plateau([h[3] for h in history], lr)[-1] if history and val_rows is not None else lr
        weights, train_loss, state = train_epoch(train_rows, kind, weights, rate, state, seed * 1000 + epoch)
        val_loss = None if val_rows is None else evaluate(val_rows, kind, weights)
        history.append((name, epoch, train_loss, val_loss))
        if val_loss is None or val_loss < best_loss:
            best, best_loss = weights, val_loss
            if path and (val_loss is not None or epoch == epochs):
                save(train_rows.sparkSession, best, path)
    return best, train_rows.sparkSession.createDataFrame(history, "model string, epoch int, train_loss double, val_loss double")


def save(spark: SparkSession, weights: Weights, path: str) -> None:
    """Writes weights as a table, so that ``path`` may lie on any storage that Spark reaches."""
    rows = [(k, list(v.shape), np.ascontiguousarray(v, dtype=np.float64).tobytes()) for k, v in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, numbers binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Weights:
    return {r["name"]: np.frombuffer(bytes(r["numbers"]), dtype=np.float64).reshape(r["shape"]).copy() for r in spark.read.parquet(path).collect()}
