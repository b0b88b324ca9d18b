"""Styled rows appended as captions arrive: an extension of the batch loop, with a checkpoint in place of a count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lumenry.models.inference import Rewriter, rewrite
from lumenry.operators.captions import pending, style_grid
from lumenry.stage import stage


def append_styles(
    arriving: DataFrame, styles: DataFrame, out: str, checkpoint: str, make_rewriter: Callable[[], Rewriter], available_now: bool = True
) -> StreamingQuery:
    """Rewrites every arriving ``(image_id, caption)`` in every style and adds the good rows to ``out``.

    A micro-batch skips what ``out`` already has, so one that is run again after
    a failure adds nothing twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        grid = style_grid(batch.select("image_id", "caption").dropDuplicates(["image_id"]), styles)
        grid = pending(grid, done(spark, out))
        made = stage(rewrite(grid, make_rewriter, ["image_id", "caption", "emotion", "emotion_id"]), "rewritten")
        good = made.where("ok").selectExpr("image_id", "caption as neutral_caption", "emotion", "emotion_id", "text as emotion_caption")
        if not good.isEmpty():
            good.write.mode("append").parquet(out)

    writer = arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def done(spark: SparkSession, out: str) -> DataFrame:
    """What ``out`` has so far; nothing if it isn't there yet, while an unreadable table is an error."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "image_id string, emotion string")
    return spark.read.parquet(out).select("image_id", "emotion")
