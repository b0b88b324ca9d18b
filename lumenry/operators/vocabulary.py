"""Vocabulary: fitting, encoding to fixed-length ids, decoding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenry.functions.text import tokenize
from lumenry.stage import stage

# Reserved words and their ids.
RESERVED = ("<PAD>", "<SOS>", "<EOS>", "<UNK>")
PAD, SOS, EOS, UNK = range(4)
MAX_LEN = 40
HELD_WORDS = 1_000_000  # words of a vocabulary that tasks may hold


def word_positions(rows: DataFrame, text: str, order: str) -> DataFrame:
    """``(order, pos, word)`` of every word of the non-null texts."""
    said = rows.where(F.col(text).isNotNull()).select(order, tokenize(F.col(text)).alias("_w"))
    return said.select(order, F.posexplode("_w").alias("pos", "word"))


def word_frequency(rows: DataFrame, text: str) -> DataFrame:
    """``(word, freq)``; partial counts are made before the shuffle."""
    said = rows.where(F.col(text).isNotNull()).select(F.explode(tokenize(F.col(text))).alias("word"))
    return said.groupBy("word").agg(F.count("*").alias("freq"))


def fit(rows: DataFrame, text: str, order: str, min_freq: int = 2) -> DataFrame:
    """``(word, id, freq)``: words of ``min_freq`` occurrences or more, numbered from 4 in order of first occurrence.

    First occurrences are ordered by row, then place. Only the kept words, not
    the occurrences, are ordered: in ranges of about equal numbers of words
    over the cluster. Each word's number is its place in its range and the
    sizes of the ranges before.
    """
    # Row and place as one decimal: unlike a pair of them, its least is kept by a hash aggregation.
    place = F.col(order).cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("pos").cast("decimal(11,0)")
    firsts = (
        word_positions(rows, text, order).select("word", place.cast("decimal(38,0)").alias("at")).groupBy("word")
        .agg(F.count("*").alias("freq"), F.min("at").alias("first"))
        .where(F.col("freq") >= min_freq)
    )
    firsts = stage(firsts, "first_occurrences")  # read twice, by the sampling of the ranges too
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A row's generated id has its range in the upper bits and its place in the range, from 0, in the lower 33.
    ranged = stage(firsts.repartitionByRange(parts, "first").sortWithinPartitions("first").withColumn("_id", F.monotonically_increasing_id()), "ranges")
    placed = ranged.select("word", "freq", F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_r"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = placed.groupBy("_range").agg(F.count("*").alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    return placed.join(F.broadcast(ranges.drop("_m")), "_range").select("word", (F.col("_r") + F.col("_before") + 4).cast("int").alias("id"), "freq")


def with_reserved(vocabulary: DataFrame) -> DataFrame:
    """The vocabulary with its four reserved words."""
    fixed = vocabulary.sparkSession.createDataFrame([(w, i, None) for i, w in enumerate(RESERVED)], "word string, id int, freq long")
    return fixed.unionByName(vocabulary.select("word", "id", "freq"))


def _encode(words: list[str], ids: list[int], max_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, numbers = pa.array(words, pa.string()), np.array([*ids, UNK], dtype=np.int32)
        for batch in batches:
            tokens = batch.column(batch.num_columns - 1)
            flat = tokens.flatten()
            at = pc.index_in(flat, known).fill_null(len(words)).to_numpy(zero_copy_only=False)
            found = numbers[at]
            count = np.diff(tokens.offsets.to_numpy())
            n = len(count)
            out = np.zeros((n, max_len), dtype=np.int32)
            out[:, 0] = SOS
            row = np.repeat(np.arange(n), count)
            place = np.arange(len(found)) - np.repeat(np.cumsum(count) - count, count) + 1
            fits = place < max_len
            out[row[fits], place[fits]] = found[fits]
            ends = count + 1 < max_len
            out[np.flatnonzero(ends), count[ends] + 1] = EOS
            listed = pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), max_len).cast(pa.list_(pa.int32()))
            yield pa.record_batch([*batch.columns[:-1], listed], [*batch.schema.names[:-1], "token_ids"])

    return run


def encode(rows: DataFrame, text: str, vocabulary: DataFrame, keys: list[str], max_len: int = MAX_LEN, held_words: int = HELD_WORDS) -> DataFrame:
    """``keys`` and ``token_ids``: start, the words' ids, end, cut to ``max_len`` (the end may be lost) and padded.

    Null texts drop out. ``keys`` name each row once. A vocabulary of at most
    ``held_words`` words is held by the tasks, and rows stay where they are; a
    larger one is joined.
    """
    said = rows.where(F.col(text).isNotNull()).select(*keys, tokenize(F.col(text)).alias("_words"))
    words = vocabulary.where(F.col("id") > UNK).select("word", "id")
    table = words.limit(held_words + 1).collect()
    if len(table) <= held_words:
        schema = said.drop("_words").withColumn("token_ids", F.lit(None).cast("array<int>")).schema
        return said.mapInArrow(_encode([r["word"] for r in table], [r["id"] for r in table], max_len), schema)
    placed = said.select(*keys, F.posexplode_outer("_words").alias("_pos", "word")).where(f"_pos is null or _pos < {max_len}")
    joined = placed.join(words, "word", "left").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("id", F.lit(UNK)).alias("id"))))).alias("_ids")
    )
    ids = F.transform("_ids", lambda x: x["id"])
    return joined.select(*keys, fixed_length(ids, max_len).alias("token_ids"))


def fixed_length(ids: Column, max_len: int = MAX_LEN) -> Column:
    """Ids between start and end, cut or padded to ``max_len``."""
    one = lambda i: F.array(F.lit(i))
    whole = F.concat(one(SOS), ids.cast("array<int>"), one(EOS), F.array_repeat(F.lit(PAD), max_len))
    return F.slice(whole, 1, max_len)


def _decode(words: list[str], ids: list[int], unknown: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array([*ids, UNK], pa.int32())
        named = pa.array([*words, RESERVED[UNK], unknown], pa.string())  # the last stands for ids of no word
        for batch in batches:
            asked = batch.column(batch.num_columns - 1)
            flat = asked.flatten()
            numbers = flat.fill_null(PAD).to_numpy(zero_copy_only=False)
            count = np.diff(asked.offsets.to_numpy())
            count = np.where(asked.is_valid().to_numpy(zero_copy_only=False), count, 0)
            row = np.repeat(np.arange(len(count)), count)
            stop = np.cumsum(np.concatenate([[0], (numbers == EOS) | (numbers == PAD)]))
            starts = np.cumsum(count) - count
            # A word is said if no end or padding stands in its row up to it.
            said = (stop[1:] == stop[starts][row]) & (numbers != SOS)
            place = pc.index_in(flat, known).fill_null(len(words) + 1)
            text = named.take(place).filter(pa.array(said))
            row = row[said]
            if text.null_count:
                there = text.is_valid()
                text, row = text.filter(there), row[there.to_numpy(zero_copy_only=False)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(count)))]).astype(np.int32)), text)
            joined = pc.if_else(asked.is_valid(), pc.binary_join(lists, " "), pa.scalar(None, pa.string()))
            yield pa.record_batch([*batch.columns[:-1], joined], [*batch.schema.names[:-1], "caption"])

    return run


def decode(rows: DataFrame, ids: str, vocabulary: DataFrame, keys: list[str], on_unknown: str = "mark", held_words: int = HELD_WORDS) -> DataFrame:
    """``keys`` and ``caption``: the words up to the first end or padding, the start left out.

    An id that is no word's gives ``<UNK>`` with ``on_unknown="mark"`` and
    nothing with ``"drop"``; the id of the unknown word gives ``<UNK>`` always.
    """
    if on_unknown not in ("mark", "drop"):
        raise ValueError("on_unknown is 'mark' or 'drop'")
    unknown = "<UNK>" if on_unknown == "mark" else None
    asked = rows.select(*keys, F.col(ids).alias("_ids"))
    words = vocabulary.where(F.col("id") > UNK).select("word", "id")
    table = words.limit(held_words + 1).collect()
    if len(table) <= held_words:
        schema = asked.drop("_ids").withColumn("caption", F.lit(None).cast("string")).schema
        return asked.mapInArrow(_decode([r["word"] for r in table], [r["id"] for r in table], unknown), schema)
    ends = F.array_position(F.transform("_ids", lambda i: i.isin(EOS, PAD)), F.lit(True))
    kept = asked.withColumn("_kept", F.when(ends > 0, F.slice("_ids", F.lit(1), (ends - 1).cast("int"))).otherwise(F.col("_ids")))
    placed = kept.select(*keys, F.posexplode_outer("_kept").alias("_pos", "id")).join(words, "id", "left")
    word = F.when(F.col("id").isNull() | (F.col("id") == SOS), None).when(F.col("id") == UNK, "<UNK>").otherwise(F.coalesce("word", F.lit(unknown)))
    said = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(word.isNotNull(), F.struct("_pos", word.alias("w"))))).alias("_s"))
    return said.select(*keys, F.array_join(F.transform("_s", lambda x: x["w"]), " ").alias("caption"))


def inverted(vocabulary: Column) -> Column:
    """A map the other way round."""
    return F.map_from_entries(F.transform(F.map_entries(vocabulary), lambda e: F.struct(e["value"], e["key"])))
