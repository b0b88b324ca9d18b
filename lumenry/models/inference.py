"""Captions for many rows: one Python boundary, weights loaded once per task."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.models import decoders
from lumenry.operators.vocabulary import EOS

Weights = dict[str, np.ndarray]
BATCH = 32
Rewriter = Callable[[str, str], str]


def stack(column: pa.Array) -> np.ndarray:
    """Lists, or lists of lists, of equal lengths as one array."""
    shape, values = [len(column)], column
    while pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        inner = values.flatten()
        shape.append(len(inner) // max(1, len(values)))
        values = inner
    return values.to_numpy(zero_copy_only=False).astype(np.float32).reshape(shape)


def ids_column(ids: np.ndarray) -> pa.ListArray:
    """Rows of ids, all of one length, as lists."""
    n, width = ids.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(ids.astype(np.int32).reshape(-1)))


def generate_ids(rows: DataFrame, kind: str, weights: Weights, keys: list[str], feature: str = "feature", style: str = "emotion_id", max_len: int = 40) -> DataFrame:
    """``keys`` and ``token_ids`` decoded greedily from ``feature`` and ``style``.

    The result of a row doesn't depend on the rows it is batched with, but for
    scores equal in all digits of a float. The
    style-blind model is decoded once per distinct feature by the caller's
    choice of rows.
    """
    asked = rows.where(F.col(feature).isNotNull()).select(*keys, F.col(style).alias("_style"), F.col(feature).alias("_feature"))
    schema = asked.drop("_style", "_feature").withColumn("token_ids", F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pa.array([], pa.list_(pa.int32()))]
            for start in range(0, batch.num_rows, BATCH):
                some = batch.slice(start, BATCH)
                styles = some.column(some.num_columns - 2).to_numpy(zero_copy_only=False).astype(int)
                found.append(ids_column(decoders.generate(kind, weights, stack(some.column(some.num_columns - 1)), styles, max_len)))
            yield pa.record_batch([*batch.columns[:-2], pa.concat_arrays(found)], [*batch.schema.names[:-2], "token_ids"])

    return asked.mapInArrow(run, schema)


def interpolate_ids(rows: DataFrame, weights: Weights, key: str, style_a: int, style_b: int, steps: int = 7, feature: str = "feature") -> DataFrame:
    """``(key, step, alpha, token_ids)``: captions between two styles, by the model that takes the style at every step."""
    if weights["step_w"].shape[0] != weights["word"].shape[1] + weights["style"].shape[1]:
        raise ValueError("interpolation is for Emotion@Every only")
    a, b = weights["style"][style_a], weights["style"][style_b]
    alphas = np.linspace(0, 1, steps)
    asked = rows.select(F.col(key).cast("bigint").alias(key), feature)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            visual = stack(batch.column(1))
            ids = [pa.array([], pa.list_(pa.int32()))]
            for alpha in alphas if n else ():
                blended = np.tile((1 - alpha) * a + alpha * b, (n, 1))
                ids.append(ids_column(decoders.generate("Emotion@Every", weights, visual, style_vectors=blended)))
            yield pa.record_batch(
                [
                    pa.array(batch.column(0).to_pylist() * steps, pa.int64()), pa.array(np.repeat(np.arange(steps), n).astype(np.int32)),
                    pa.array([round(float(x), 2) for x in np.repeat(alphas, n)], pa.float64()), pa.concat_arrays(ids),
                ],
                [key, "step", "alpha", "token_ids"],
            )

    return asked.mapInArrow(run, f"{key} bigint, step int, alpha double, token_ids array<int>")


def attention_trace(rows: DataFrame, weights: Weights, key: str, cells: str = "cells", style: str = "emotion_id", max_words: int = 40) -> DataFrame:
    """``(key, emotion_id, pos, word_id, weights)``: each word with where the model looked, up to the end word."""
    asked = rows.select(F.col(key).cast("bigint").alias(key), F.col(style).cast("int").alias("emotion_id"), cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                some = batch.slice(start, BATCH)
                styles, seen = some.column(1).to_numpy(zero_copy_only=False), []
                ids = decoders.generate(decoders.SPATIAL, weights, stack(some.column(2)), styles.astype(int), max_words, trace=seen.append)
                maps = np.stack(seen, axis=1)  # row, place, cell
                ended = np.cumsum(ids == EOS, axis=1) - (ids == EOS) == 0  # up to the end word
                row, pos = np.nonzero(ended)
                cells_of = maps[row, pos].astype(np.float64)
                yield pa.record_batch(
                    [
                        some.column(0).take(pa.array(row)), some.column(1).take(pa.array(row)), pa.array(pos.astype(np.int32)), pa.array(ids[row, pos].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * cells_of.shape[1]), pa.array(cells_of.reshape(-1))),
                    ],
                    [key, "emotion_id", "pos", "word_id", "weights"],
                )

    return asked.mapInArrow(run, f"{key} bigint, emotion_id int, pos int, word_id int, weights array<double>")


STUB_PHRASES = {
    "joyful": "with a bright smile", "sad": "in quiet sorrow", "tense": "as danger nears", "romantic": "with tender hearts", "humorous": "to everyone's amusement"
}


def stub_rewriter(seed: int = 0) -> Rewriter:
    """A deterministic stand-in for a language model: the caption with a phrase of its style."""

    def run(caption: str, emotion: str) -> str:
        if not caption:
            raise ValueError("nothing to rewrite")
        pick = int(hashlib.md5(f"{seed}:{caption}".encode()).hexdigest()[0], 16) % 2
        base = caption.strip().rstrip(" .")
        return f"{base} {STUB_PHRASES[emotion]}." if pick else f"{STUB_PHRASES[emotion].capitalize()}, {base[0].lower()}{base[1:]}."

    return run


def rewrite(rows: DataFrame, make_rewriter: Callable[[], Rewriter], keys: list[str], caption: str = "caption", emotion: str = "emotion") -> DataFrame:
    """``keys``, ``ok``, ``text``, ``error``: a failed row tells why and doesn't stop the others.

    The backend is made once per task. Its results may differ between calls,
    so write them before using them twice.
    """
    asked = rows.select(*keys, F.col(caption).alias("_caption"), F.col(emotion).alias("_emotion"))
    schema = asked.drop("_caption", "_emotion").withColumns({"ok": F.lit(True), "text": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_rewriter()
        for batch in batches:
            texts, errors = [], []
            for said, style in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                try:
                    texts.append(model(said, style).strip())
                    errors.append(None)
                except Exception as e:  # a backend may fail in any way; the row keeps the reason
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            ok = pa.array([e is None for e in errors], pa.bool_())
            yield pa.record_batch(
                [*batch.columns[:-2], ok, pa.array(texts, pa.string()), pa.array(errors, pa.string())], [*batch.schema.names[:-2], "ok", "text", "error"]
            )

    return asked.mapInArrow(run, schema)
