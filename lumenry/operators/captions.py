"""Relational operators of the caption pipeline."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenry.sources.readers import image_path, missing_to_null, strip_index

# Texts of the rewriting prompt and of the survey.
INSTRUCTION = (
    "You are a creative writer. Rewrite the user's image caption to sound %s. "
    "Keep it to one short sentence and do not add new objects. No intro text."
)
QUESTION = "Does this caption feel %s? (1=Not at all, 5=Very much)"


def first_per_key(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The first row of each ``key`` by ``order``, nulls being one key; one partial aggregation, no sort."""
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), F.col(order)).alias("_row"), F.min(order).alias(order)).select(
        key, order, *(F.col("_row")[c].alias(c) for c in columns if c not in (key, order))
    )


def first_captions(captions: DataFrame) -> DataFrame:
    """The first caption of each image; an image whose first caption is missing drops out, whatever follows it."""
    clean = captions.select("row_id", strip_index(F.col("image_id")).alias("image_id"), missing_to_null(F.col("caption")).alias("caption"))
    return first_per_key(clean, "image_id", "row_id", ["caption"]).where(F.col("caption").isNotNull())


def with_existing_images(captions: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """Captions with ``img_path``, of images that are among ``files`` (a column ``path``)."""
    located = captions.withColumn("img_path", image_path(F.col("image_id"), folder))
    return located.join(files.select(F.col("path").alias("img_path")), "img_path", "left_semi")


def distinct_in_order(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the ``order`` of their first row."""
    return df.groupBy(key).agg(F.min(order).alias("first_row"))


def prompt_for(caption: Column, emotion: Column) -> Column:
    """The chat messages that ask for a rewrite."""
    said = F.format_string(INSTRUCTION, emotion)
    return F.array(
        F.struct(F.lit("system").alias("role"), said.alias("content")), F.struct(F.lit("user").alias("role"), caption.alias("content"))
    )


def render_prompt(messages: Column) -> Column:
    """Messages as one text, with the place where the answer begins."""
    each = F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n")))
    return F.concat(F.array_join(each, ""), F.lit("<|assistant|>\n"))


def style_grid(captions: DataFrame, styles: DataFrame) -> DataFrame:
    """Every caption in every style, with its prompt; ``styles`` are the few fixed rows of the style table."""
    return captions.crossJoin(F.broadcast(styles.select("emotion", "emotion_id"))).withColumn(
        "prompt", render_prompt(prompt_for(F.col("caption"), F.col("emotion")))
    )


def pending(grid: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("image_id", "emotion")) -> DataFrame:
    """Rows of ``grid`` not yet in ``done``; running it again after all are done gives none."""
    return grid.join(done.select(*keys).distinct(), list(keys), "left_anti")


def hash_order(key: Column, seed: int) -> Column:
    """A fixed random order of keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def exact_rank(keys: DataFrame, key: str, seed: int) -> DataFrame:
    """``(key, rank, n)``: place from 1 of each distinct key in hash order, and their number.

    Ranks are counted in 4,096 hash buckets and shifted by the buckets before,
    so no task sees all keys.
    """
    hashed = keys.select(key).distinct().withColumn("_h", hash_order(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, 3))
    ordered = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    buckets = hashed.groupBy("_b").agg(F.count("*").alias("_m")).select(
        "_b", F.coalesce(F.sum("_m").over(ordered), F.lit(0)).alias("_before"),
        F.sum("_m").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n"),
    )
    inside = F.row_number().over(W.partitionBy("_b").orderBy("_h", key))
    return hashed.withColumn("_r", inside).join(F.broadcast(buckets), "_b").select(key, (F.col("_r") + F.col("_before")).alias("rank"), "n")


def split_ids(rows: DataFrame, key: str, seed: int = 42, hold_out: float = 0.2) -> DataFrame:
    """``(key, split)``: ``ceil(hold_out n)`` keys are held out, half of them (rounded up) as test, the rest as val."""
    ranked = exact_rank(rows.where(F.col(key).isNotNull()), key, seed)
    held = F.ceil(F.col("n") * F.lit(hold_out))
    test = F.ceil(held / 2)
    return ranked.select(key, F.when(F.col("rank") <= test, "test").when(F.col("rank") <= held, "val").otherwise("train").alias("split"))


def take_split(rows: DataFrame, ids: DataFrame, key: str, split: str) -> DataFrame:
    """Rows whose key is in a split."""
    return rows.join(ids.where(F.col("split") == split).select(key), key, "left_semi")


def fixed_sample(keys: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` distinct keys (or all), the same ones each time."""
    return keys.select(key).where(F.col(key).isNotNull()).distinct().orderBy(hash_order(F.col(key), seed), key).limit(n)


def nth_unique(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The ``k``-th distinct key from 0, in order of first rows; a top-k, not a sort of all."""
    top = distinct_in_order(rows.where(F.col(key).isNotNull()), key, order).orderBy("first_row").limit(k + 1)
    return top.orderBy(F.desc("first_row")).limit(1).where(F.lit(True)).select(key, "first_row")


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def n_batches(n: Column, size: int = 32) -> Column:
    return F.ceil(n / size)


def running_best(history: DataFrame) -> DataFrame:
    """``best_before`` and ``improved`` of each epoch: an epoch improves if its loss is strictly less than all before."""
    before = W.partitionBy("model").orderBy("epoch").rowsBetween(W.unboundedPreceding, -1)
    return history.withColumn("best_before", F.min("val_loss").over(before)).withColumn(
        "improved", F.col("best_before").isNull() | (F.col("val_loss") < F.col("best_before"))
    )


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def plateau(losses: list[float], lr: float, patience: int = 3, factor: float = 0.5, threshold: float = 1e-4) -> list[float]:
    """The learning rate after each epoch: cut by ``factor`` once ``patience`` epochs in a row didn't lower the loss."""
    best, bad, out = math.inf, 0, []
    for loss in losses:
        if loss < best * (1 - threshold):
            best, bad = loss, 0
        else:
            bad += 1
        if bad > patience:
            lr, bad = lr * factor, 0
        out.append(lr)
    return out
