"""Records of evaluation splits that stand in the training split too, by a partitioned suffix array of both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.functions.text import photo_key
from lumenry.llm.bitmaps import Bitmap, bits_for, collect, has
from lumenry.llm.near_equal import COMBINATION_ACROSS, entries_across, near_equal_links
from lumenry.llm.words import mix, tokenised, word_marks, word_sets
from lumenry.stage import discard, stage

SPAN_WORDS = 5
TEXTS_A_BITMAP = 250_000  # of one task that makes bitmaps
TRAIN, EVAL = 1, 2

_SUFFIX = "head bigint, id bigint, pos int, side int"


class _Heads:
    """The spans of ``words`` words of a batch of texts: where each begins, and its mark."""

    def __init__(self, texts: pa.Array, words: int):
        listed = pc.split_pattern(texts, " ")
        flat = listed.flatten().dictionary_encode()
        marks, _ = word_marks(flat.dictionary.to_pylist(), False)
        codes = flat.indices.to_numpy(zero_copy_only=False)
        marks = marks[codes]
        count = np.diff(listed.offsets.to_numpy())
        starts = np.cumsum(count) - count
        spans = np.maximum(count - words + 1, 0)
        self.row = np.repeat(np.arange(len(count)), spans)
        self.pos = np.arange(len(self.row)) - np.repeat(np.cumsum(spans) - spans, spans)
        at = np.repeat(starts, spans) + self.pos
        self.head = np.zeros(len(at), dtype=np.uint64)
        for j in range(words):
            self.head = mix(self.head * np.uint64(3) + marks[at + j])


def _marks_by_side(words: int):
    def run(batch: pa.RecordBatch) -> list[np.ndarray]:
        heads = _Heads(batch.column("text"), words)
        side = batch.column("side").to_numpy(zero_copy_only=False)[heads.row]
        return [heads.head[side & TRAIN > 0], heads.head[side & EVAL > 0]]

    return run


def _suffixes(words: int, in_train: Bitmap, in_eval: Bitmap):
    """The suffixes of all texts from every word on whose first words the other side may have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = _Heads(batch.column("text"), words)
            side = batch.column("side").to_numpy(zero_copy_only=False).astype(np.int32)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            own = side[heads.row]
            keep = (own & EVAL > 0) & has(in_train, heads.head) | (own & TRAIN > 0) & has(in_eval, heads.head)
            row = heads.row[keep]
            yield pa.record_batch(
                [
                    pa.array(heads.head[keep].view(np.int64)), pa.array(ids[row]), pa.array(heads.pos[keep].astype(np.int32)), pa.array(own[keep]),
                ],
                ["head", "id", "pos", "side"],
            )

    return run


def shared_suffixes(texts: DataFrame, words: int = SPAN_WORDS) -> DataFrame:
    """``(id, pos, side)`` of the suffixes, from a word on, of both sides' texts that agree with one of the other side in ``words`` words.

    ``texts`` has ``id``, ``text`` (words joined by blanks, distinct) and
    ``side`` (1 in training, 2 in evaluation, 3 both). The suffix array of all
    texts is partitioned by the first words of the suffixes, so that neighbours
    with a common prefix of so many words meet wherever they come from; of each
    such node only the sides that are under it count, which is summed before
    anything moves. Suffixes whose first words the other side surely lacks, by
    bitmaps of bounded size, are left out.
    """
    texts = texts.select(F.col("id").cast("bigint").alias("id"), "text", "side")
    n = texts.count()
    in_train, in_eval = collect(texts.coalesce(1 + n // TEXTS_A_BITMAP), _marks_by_side(words), [bits_for(16 * n)] * 2)
    suffixes = stage(texts.mapInArrow(_suffixes(words, in_train, in_eval), _SUFFIX), "suffixes")
    nodes = suffixes.groupBy("head").agg(F.bit_or("side").alias("sides")).where(F.col("sides") == (TRAIN | EVAL))
    return suffixes.join(nodes.select("head"), "head", "left_semi").select("id", "pos", "side")


def _texts(as_sets: bool):
    """The last column as its words, or its set of words, joined by blanks; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.columns[-1]
            yield pa.record_batch([*batch.columns[:-1], word_sets(said) if as_sets else pc.binary_join(tokenised(said), " ")], batch.schema.names)

    return run


def _sides(train: DataFrame, held_out: list[DataFrame], as_sets: bool) -> DataFrame:
    """Rows of all splits with ``side``, the caption's words and the photo; staged, as they are read three times."""
    wanted = ["row_id", "image_id", "emotion_id", "emotion_caption"]
    rows = train.select(*wanted).withColumn("side", F.lit(TRAIN))
    for part in held_out:
        rows = rows.unionByName(part.select(*wanted).withColumn("side", F.lit(EVAL)))
    named = rows.select(F.col("row_id").cast("bigint"), "side", F.col("emotion_id").cast("bigint"), photo_key(F.col("image_id")).alias("photo"), F.col("emotion_caption").alias("text"))
    plain = named.mapInArrow(_texts(as_sets), "row_id bigint, side int, emotion_id bigint, photo string, text string")
    # Equal texts are told by a mark of 128 bits, so that the text needn't move again.
    return stage(plain.withColumns({"m1": F.xxhash64("text"), "m2": F.xxhash64("text", F.lit(7))}), "sides")


def _classes(rows: DataFrame) -> DataFrame:
    """Distinct texts with the least of their rows and the sides they are on."""
    found = rows.where("text <> ''").groupBy("m1", "m2").agg(
        F.min("row_id").alias("id"), F.bit_or("side").alias("side"), F.any_value("text").alias("text")
    )
    return stage(found, "classes")


def overlapping_rows(train: DataFrame, held_out: list[DataFrame], threshold: float = 0.7, min_words: int = 5) -> DataFrame:
    """``(train_row, eval_row, near_text, same_photo)`` of all rows of ``held_out`` that stand in ``train`` too.

    Two rows overlap if their captions are near-equal (shared / union of the
    distinct words at least ``threshold``, each with ``min_words`` of them or
    more), or if they show the same photo in the same style. Captions of equal
    words are one text, and its rows are paired at the end. Near-equal texts need not
    share a span (they may have another order, or an edit in every fifth word),
    so they aren't found by the suffix array but by the product of texts and
    combinations of rare words across the two sides, which is whole, however
    many texts share a phrase. Rows with null or short captions, photos or
    styles overlap by the other rule only. ``row_id`` is unique over all tables.
    """
    said = _sides(train, held_out, True)
    classes = _classes(said)
    rows = stage(said.drop("text"), "rows")
    discard(said)
    sets = classes.select("id", "text", "side")
    k = min(COMBINATION_ACROSS, min_words)
    entries = entries_across(sets, threshold, min_words, k)
    links = stage(near_equal_links(sets, threshold, min_words, k, entries), "near_texts")
    sides = classes.select("id", "side")
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    checked = (
        ways.join(sides.where(F.col("side").bitwiseAND(EVAL) > 0).select(F.col("id").alias("a")), "a")
        .join(sides.where(F.col("side").bitwiseAND(TRAIN) > 0).select(F.col("id").alias("b")), "b")
        .select(F.col("a").alias("e"), F.col("b").alias("r"))
    )
    same = classes.where((F.col("side") == (TRAIN | EVAL)) & (F.size(F.split("text", " ")) >= min_words))
    linked = stage(checked.unionByName(same.select(F.col("id").alias("e"), F.col("id").alias("r"))), "linked")
    wanted = linked.select(F.col("e").alias("id")).unionByName(linked.select(F.col("r").alias("id"))).distinct()
    members = rows.select("row_id", "side", "m1", "m2").join(classes.select("id", "m1", "m2").join(wanted, "id", "left_semi"), ["m1", "m2"])
    near = (
        linked.join(members.where(F.col("side") == EVAL).select(F.col("id").alias("e"), F.col("row_id").alias("eval_row")), "e")
        .join(members.where(F.col("side") == TRAIN).select(F.col("id").alias("r"), F.col("row_id").alias("train_row")), "r")
        .select("train_row", "eval_row", F.lit(1).alias("near"), F.lit(0).alias("shown"))
    )
    shown = rows.select("row_id", "side", "emotion_id", "photo").where("photo is not null and emotion_id is not null")
    photo = (
        shown.where(F.col("side") == TRAIN).select("photo", "emotion_id", F.col("row_id").alias("train_row"))
        .join(shown.where(F.col("side") == EVAL).select("photo", "emotion_id", F.col("row_id").alias("eval_row")), ["photo", "emotion_id"])
        .select("train_row", "eval_row", F.lit(0).alias("near"), F.lit(1).alias("shown"))
    )
    return (
        near.unionByName(photo).groupBy("train_row", "eval_row")
        .agg((F.max("near") == 1).alias("near_text"), (F.max("shown") == 1).alias("same_photo"))
    )


def overlap_report(train: DataFrame, held_out: dict[str, DataFrame]) -> DataFrame:
    """Per split and source: its rows, those that overlap with training, the pairs, and the words of its captions with
    those of them in spans that training has too; null sources count together."""
    found = overlapping_rows(train, list(held_out.values()))
    rows = None
    for name, part in held_out.items():
        one = part.select(F.lit(name).alias("split"), "source", F.col("row_id").alias("eval_row"))
        rows = one if rows is None else rows.unionByName(one)
    by_row = found.groupBy("eval_row").agg(F.count("*").alias("pairs"), F.max("near_text").alias("near"), F.max("same_photo").alias("photo"))
    spans = covered_words(train, list(held_out.values())).withColumnRenamed("row_id", "eval_row")
    return rows.join(by_row, "eval_row", "left").join(spans, "eval_row", "left").groupBy("split", "source").agg(
        F.count("*").alias("n_rows"),
        F.count("pairs").alias("n_overlapping"),
        F.count(F.when(F.col("near"), 1)).alias("n_near_text"),
        F.count(F.when(F.col("photo"), 1)).alias("n_same_photo"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"),
        F.coalesce(F.sum("n_words"), F.lit(0)).cast("bigint").alias("n_words"),
        F.coalesce(F.sum("covered"), F.lit(0)).cast("bigint").alias("n_covered"),
    )


def covered_words(train: DataFrame, held_out: list[DataFrame], words: int = SPAN_WORDS) -> DataFrame:
    """``(row_id, n_words, covered)`` of the rows of ``held_out``: how many of their words lie in a span of
    ``words`` words or more that training has too, by the suffixes of all texts."""
    rows = _sides(train, held_out, False)
    classes = _classes(rows)
    places = shared_suffixes(classes, words).where(F.col("side").bitwiseAND(EVAL) > 0)
    covered = (
        places.select("id", F.explode(F.sequence("pos", F.col("pos") + words - 1)).alias("at")).distinct()
        .groupBy("id").agg(F.count("*").alias("covered"))
    )
    members = rows.where(F.col("side") == EVAL).select("row_id", "m1", "m2").join(classes, ["m1", "m2"])
    return (
        members.join(covered, "id", "left")
        .select("row_id", F.size(F.split("text", " ")).alias("n_words"), F.coalesce("covered", F.lit(0)).alias("covered"))
    )
