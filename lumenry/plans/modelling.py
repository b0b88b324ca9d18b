"""Queries that run the caption models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lumenry.functions import arrays
from lumenry.functions.style import STYLES
from lumenry.functions.text import tokenize
from lumenry.models import decoders, images, inference, training
from lumenry.operators import bleu, vocabulary
from lumenry.operators import captions as ops
from lumenry.stage import stage

DIM = 64  # of the test data's vectors, which stand for image features


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _words(spark, folder):
    """The vocabulary: seeded models speak all of it."""
    return stage(vocabulary.fit(_table(spark, folder, "train"), "emotion_caption", "row_id"), "spoken")


def _sizes(words, width: int = DIM) -> decoders.Sizes:
    last = words.agg(F.max("id")).first()[0]
    return decoders.Sizes(vocab=(vocabulary.UNK if last is None else last) + 1, word=32, style=16, hidden=48, visual=width)


def _asked(spark, folder):
    features = _table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("feature"))
    return features.crossJoin(F.broadcast(_table(spark, folder, "styles")))


def _generate(kind: str):
    def query(spark, folder):
        words = _words(spark, folder)
        weights = decoders.init(kind, _sizes(words), seed=decoders.KINDS.index(kind))
        asked = _asked(spark, folder)
        if kind == "Baseline":  # the style plays no part: decode once per feature
            asked = asked.where("emotion_id = 0")
        ids = inference.generate_ids(asked, kind, weights, ["vec_id", "emotion_id"])
        said = vocabulary.decode(ids, "token_ids", words, ["vec_id", "emotion_id"], "drop")
        if kind == "Baseline":
            said = said.drop("emotion_id").crossJoin(F.broadcast(_table(spark, folder, "styles").select("emotion_id")))
        return said.join(F.broadcast(_table(spark, folder, "styles")), "emotion_id").select("vec_id", "emotion", "caption")

    return query


def interpolate_captions(spark, folder):
    words = _words(spark, folder)
    weights = decoders.init("Emotion@Every", _sizes(words), seed=2)
    rows = _table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("feature"))
    ids = inference.interpolate_ids(rows, weights, "vec_id", STYLES.index("joyful"), STYLES.index("sad"))
    return vocabulary.decode(ids, "token_ids", words, ["vec_id", "step", "alpha"], "drop")


def attention_trace(spark, folder):
    """The vectors as grids of 7 x 7 cells: where a seeded model looks for each word."""
    return _traced(spark, folder, _words(spark, folder))


def _cells():
    """A vector's 49 runs of eight numbers, as the cells of a 7 x 7 grid."""
    return F.transform(F.sequence(F.lit(0), F.lit(48)), lambda i: F.slice(F.col("embedding"), i + 1, F.lit(8)))


def _demo_styles(spark, folder):
    return F.broadcast(_table(spark, folder, "styles").where(F.col("emotion").isin("joyful", "sad", "tense")).select("emotion_id"))


def _traced(spark, folder, words, vectors=None):
    weights = decoders.init(decoders.SPATIAL, _sizes(words, 8), seed=4)
    vectors = _table(spark, folder, "embeddings") if vectors is None else vectors
    rows = vectors.select("vec_id", _cells().alias("cells")).crossJoin(_demo_styles(spark, folder))
    return inference.attention_trace(rows, weights, "vec_id")


def styled_rewrites(spark, folder):
    grid = ops.style_grid(ops.first_captions(_table(spark, folder, "raw_captions")), _table(spark, folder, "styles"))
    made = inference.rewrite(grid, inference.stub_rewriter, ["image_id", "emotion"])
    return made.where("ok").select("image_id", "emotion", F.col("text").alias("emotion_caption"))


MODELS = ((0, "Baseline"), (1, "Emotion@Start"), (2, "Emotion@Every"), (3, "CrossAttention"))


def _features(spark, folder, images):
    """``(image_id, vec_id, feature)``: each distinct image gets one of the vectors, by the places of these in order of their ids."""
    vectors = _table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("feature"))
    placed = ops.exact_rank(vectors.select("vec_id"), "vec_id", 0).select("vec_id", (F.col("rank") - 1).alias("_place"), "n")
    n = vectors.select("vec_id").distinct().count()
    keyed = images.select("image_id").where(F.col("image_id").isNotNull()).distinct()
    keyed = keyed.withColumn("_place", F.pmod(F.xxhash64("image_id"), F.lit(max(1, n))))
    return keyed.join(placed, "_place").join(vectors, "vec_id").select("image_id", "vec_id", "feature")


def _decoded(spark, folder, asked, models=MODELS):
    """Captions of all models for distinct ``(vec_id, emotion_id)``; the style-blind model is decoded once per vector."""
    words = _words(spark, folder)
    sizes = _sizes(words)
    parts = None
    for order, kind in models:
        rows = asked.select("vec_id", "emotion_id", "feature")
        if kind == "Baseline":
            rows = rows.withColumn("emotion_id", F.lit(0))
        rows = rows.dropDuplicates(["vec_id", "emotion_id"])
        ids = inference.generate_ids(rows, kind, decoders.init(kind, sizes, seed=order), ["vec_id", "emotion_id"])
        said = vocabulary.decode(ids, "token_ids", words, ["vec_id", "emotion_id"], "drop")
        if kind == "Baseline":
            styles = F.broadcast(_table(spark, folder, "styles").select("emotion_id"))
            said = said.drop("emotion_id").crossJoin(styles)
        said = said.withColumns({"model": F.lit(kind), "model_ord": F.lit(order)})
        parts = said if parts is None else parts.unionByName(said)
    return parts


def _scored(spark, folder):
    """Row counts of every model's captions against the test captions."""
    test = _table(spark, folder, "test").select("image_id", "emotion", "emotion_id", F.coalesce("emotion_caption", F.lit("nan")).alias("said"))
    rows = stage(test.join(_features(spark, folder, test), "image_id"), "asked")
    hyps = stage(_decoded(spark, folder, rows), "decoded")
    pairs = rows.select("vec_id", "emotion_id", "emotion", "said").join(hyps, ["vec_id", "emotion_id"])
    return bleu.row_counts(pairs.select("model", "model_ord", "emotion", tokenize(F.col("caption")).alias("hyp"), tokenize(F.col("said")).alias("ref")))


def model_bleu(spark, folder):
    """The ablation table: BLEU-1 to BLEU-4 of the four models."""
    return bleu.overall(_scored(spark, folder), "model", "model_ord")


def model_bleu_by_style(spark, folder):
    return bleu.by_style(_scored(spark, folder), "model")


def best_model_by_style(spark, folder):
    """BLEU-4 of each style by the best model."""
    counts = stage(_scored(spark, folder), "scored")
    best = bleu.best_model(bleu.overall(counts, "model", "model_ord")).select("model")
    return bleu.by_style(counts.join(F.broadcast(best), "model"), "model")


def final_summary(spark, folder):
    """The ablation table with the greatest BLEU-4 and which model has it."""
    table = stage(model_bleu(spark, folder), "ablation")
    best = bleu.best_model(table).select(F.col("model").alias("best_model"), F.col("bleu_4").alias("best_bleu_4"))
    return table.crossJoin(F.broadcast(best))


def _best(spark, folder) -> tuple[int, str]:
    """The model of the highest BLEU-4 on the test split."""
    row = bleu.best_model(model_bleu(spark, folder)).first()
    return MODELS[2] if row is None else (row["model_ord"], row["model"])


def _chosen(spark, folder, n, seed):
    test = _table(spark, folder, "test")
    return _features(spark, folder, ops.fixed_sample(test, "image_id", n, seed))


def _in_all_styles(spark, folder, images, models):
    asked = images.crossJoin(F.broadcast(_table(spark, folder, "styles")))
    return asked.drop("feature").join(_decoded(spark, folder, asked, models), ["vec_id", "emotion_id"])


def gallery(spark, folder):
    """Three test images in all styles by the best model."""
    return _in_all_styles(spark, folder, _chosen(spark, folder, 3, 7), [_best(spark, folder)]).select("model", "image_id", "emotion", "caption")


def model_survey(spark, folder):
    """Five test images in all styles by the best model, with the question."""
    said = _in_all_styles(spark, folder, _chosen(spark, folder, 5, 1), [_best(spark, folder)])
    return said.select("image_id", "emotion", "caption", F.format_string(ops.QUESTION, "emotion").alias("question"))


def demo_two_models(spark, folder):
    """The first test image in all styles by two models."""
    first = ops.nth_unique(_table(spark, folder, "test"), "image_id", "row_id", 0)
    said = _in_all_styles(spark, folder, _features(spark, folder, first), MODELS[2:4])
    return said.select("model", "emotion", F.format_string("[%s] %s", F.rpad("emotion", 10, " "), "caption").alias("line"))


def attention_maps(spark, folder):
    """The first eight words of each traced caption with where the model looked, as a 7 x 7 map from 0 to 1."""
    words = _words(spark, folder)
    traced = _traced(spark, folder, words).where("pos < 8")
    words = words.select(F.col("id").alias("word_id"), "word")
    named = traced.join(words, "word_id", "left")
    return named.select(
        "vec_id", "emotion_id", "pos", F.coalesce("word", F.lit("<UNK>")).alias("word"), arrays.grid(arrays.min_max(F.col("weights"))).alias("map")
    )


def _overlay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = [images.attention_overlay(np.array(w)).astype(np.float32).tolist() for w in batch.column("weights").to_pylist()]
        yield pa.record_batch([*batch.columns[:-1], pa.array(maps, pa.list_(pa.list_(pa.float32())))], [*batch.schema.names[:-1], "overlay"])


def attention_demo(spark, folder):
    """The sixth distinct test image: for three styles the first eight words, each with its map resized to the picture and then scaled."""
    words = _words(spark, folder)
    chosen = _features(spark, folder, ops.nth_unique(_table(spark, folder, "test"), "image_id", "row_id", 5))
    traced = _traced(spark, folder, words, chosen.select("vec_id", F.col("feature").alias("embedding"))).where("pos < 8")
    named = traced.join(words.select(F.col("id").alias("word_id"), "word"), "word_id", "left").join(chosen.select("image_id", "vec_id"), "vec_id")
    out = named.select("image_id", "emotion_id", "pos", F.coalesce("word", F.lit("<UNK>")).alias("word"), "weights")
    return out.mapInArrow(_overlay, "image_id string, emotion_id int, pos int, word string, overlay array<array<float>>")


def train_history(spark, folder):
    """One epoch of training on all of ``train``, judged on all of ``val``."""
    words = _words(spark, folder)
    parts = [_table(spark, folder, name) for name in ("train", "val")]
    features = _features(spark, folder, parts[0].unionByName(parts[1])).select("image_id", "feature")
    rows, held = (stage(training.dataset(part, features, words).repartition("row_id"), "dataset") for part in parts)
    return training.train(rows, held, "Emotion@Every", decoders.init("Emotion@Every", _sizes(words), seed=2), "Emotion@Every", epochs=1)[1]


def queries() -> dict:
    names = {"Baseline": "baseline", "Emotion@Start": "start", "Emotion@Every": "every", "CrossAttention": "xattn"}
    return {f"caption_generate_{short}": _generate(kind) for kind, short in names.items()} | {
        f.__name__: f for f in (
            interpolate_captions, attention_trace, styled_rewrites, model_bleu, model_bleu_by_style, gallery, model_survey, demo_two_models,
            attention_maps, attention_demo, best_model_by_style, final_summary, train_history,
        )
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the one query here that has no model in it."""
    from lumenry.plans.catalog import FIRST

    phrases = " ".join(f"WHEN '{style}' THEN '{text.replace(chr(39), chr(39) * 2)}'" for style, text in inference.STUB_PHRASES.items())
    return {
        "styled_rewrites": f"""
            WITH {FIRST},
            grid AS (SELECT image_id, emotion, CASE emotion {phrases} END AS phrase, strpos('13579bdf', left(md5('0:' || caption), 1)) > 0 AS behind,
                regexp_replace(regexp_replace(caption, '^\\s+|\\s+$', '', 'g'), '[ .]+$', '') AS base FROM firsts, styles WHERE caption <> '')
            SELECT image_id, emotion, trim(CASE WHEN behind THEN base || ' ' || phrase || '.'
                ELSE upper(left(phrase, 1)) || substr(phrase, 2) || ', ' || lower(left(base, 1)) || substr(base, 2) || '.' END) AS emotion_caption
            FROM grid WHERE behind OR base <> ''"""
    }
