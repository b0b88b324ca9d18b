"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenry.functions.text import word_count

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def source_name(source: Column) -> Column:
    return F.lower(F.trim(source))


def token_sizes(documents: DataFrame, key: str, text: str, vocabulary: str = TOKENIZER) -> DataFrame:
    """``(key, source, size)``: tokens of ``text`` under a public byte-level vocabulary; null text has 0.

    ``vocabulary`` is a file of base64 token and rank per line, read once per
    task. A special token's string in a text counts as ordinary text.
    """
    docs = documents.select(key, "source", text)
    schema = docs.select(key, "source").withColumn("size", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(coder.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], [key, "source", "size"])

    return docs.mapInArrow(run, schema)


def word_sizes(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, source, size)``: words of ``text``; null text has 0."""
    return documents.select(key, "source", F.greatest(F.coalesce(word_count(F.col(text)), F.lit(0)), F.lit(0)).cast("bigint").alias("size"))


def mixture_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: its size, the size wanted, and the copies expected of each of its documents.

    The total is the size of all documents of listed sources. Copies are
    ``wanted / size``, but never more than ``max_repeats``; ``short`` tells
    that this bound keeps a source from its share, as does having no documents.
    Sources are compared trimmed and in lower case; null sources are not listed.
    Repeated target rows of one source count once (the greatest share).
    """
    wanted = targets.groupBy(source_name(F.col("source")).alias("source")).agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    ).where("source is not null")
    sizes = sized.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("size").alias("own_size"), F.count("*").alias("n_docs"))
    whole = W.partitionBy(F.lit(0))  # as many rows as there are targets
    return (
        wanted.join(sizes, "source", "left")
        .withColumns({"own_size": F.coalesce("own_size", F.lit(0)), "n_docs": F.coalesce("n_docs", F.lit(0))})
        .withColumn("total_size", F.sum("own_size").over(whole))
        .withColumn("wanted_size", F.col("target_share") * F.col("total_size"))
        .withColumn("short", (F.col("wanted_size") > F.col("max_repeats") * F.col("own_size")) | (F.col("own_size") == 0))
        .withColumn(
            "copies",
            F.when(F.col("own_size") == 0, 0.0).otherwise(
                F.least(F.col("wanted_size") / F.col("own_size"), F.col("max_repeats").cast("double"))
            ),
        )
    )


def systematic_sample(sized: DataFrame, plan: DataFrame, key: str, seed: int = 42, bucket_rows: int = 50_000) -> DataFrame:
    """``(key, source, size, copies)`` of the documents taken, ``copies`` whole and at least 1.

    Within a source, in hash order, the expected copies are summed; a document
    is emitted once for each whole number that its piece of the sum crosses
    after adding the source's random offset. So a source gives its expected
    number of copies, off by less than one, and no document more than
    ``max_repeats``. The sum runs in two steps, over hash buckets and within
    them, so that a source of any size is no single task.
    """
    wanted = plan.where("copies > 0").select(F.col("source").alias("_source"), F.col("copies").alias("_each"), "max_repeats")
    docs = (
        sized.select(F.col(key), source_name(F.col("source")).alias("_source"), "size")
        .join(wanted, "_source")
        .withColumn("_hash", F.xxhash64(F.col(key), F.lit(seed)))
    )
    n = sized.count()
    buckets = max(16, -(-n // bucket_rows))
    docs = docs.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    before = W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        docs.groupBy("_source", "_bucket")
        .agg(F.count("*").alias("_m"))
        .withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
        .drop("_m")
    )
    inner = W.partitionBy("_source", "_bucket").orderBy("_hash", key)
    start = F.pmod(F.xxhash64("_source", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    ranked = docs.withColumn("_rank", F.row_number().over(inner)).join(offsets, ["_source", "_bucket"])
    place = F.col("_before") + F.col("_rank")
    copies = F.floor(place * F.col("_each") + start) - F.floor((place - 1) * F.col("_each") + start)
    return (
        ranked.withColumn("copies", F.least(copies, F.col("max_repeats")).cast("int"))
        .where("copies > 0")
        .select(key, F.col("_source").alias("source"), "size", "copies")
    )


def mixture_report(sized: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Per target source the size wanted, the size reached by the sample, and both as shares.

    ``failed`` tells of a source that the sample took as often as it may, or of
    which there was nothing to take, without reaching its share.
    """
    plan = mixture_plan(sized, targets)
    got = systematic_sample(sized, plan, key).groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("reached_size"), F.sum("copies").alias("n_copies")
    )
    whole = W.partitionBy(F.lit(0))
    return (
        plan.join(got, "source", "left")
        .withColumn("reached_size", F.coalesce("reached_size", F.lit(0)))
        .withColumn("n_copies", F.coalesce("n_copies", F.lit(0)))
        .withColumn("reached_share", F.col("reached_size") / F.greatest(F.sum("reached_size").over(whole), F.lit(1)))
        .withColumn("failed", (F.col("own_size") == 0) | (F.col("n_copies") == F.col("max_repeats") * F.col("n_docs")) & (F.col("reached_size") < F.col("wanted_size")))
    )
