"""Declared schemas of the caption tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lumenry.functions.style import STYLES

CAPTION = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("caption", T.StringType())])
STYLED = T.StructType(
    [
        T.StructField("image_id", T.StringType()), T.StructField("img_path", T.StringType()),
        T.StructField("neutral_caption", T.StringType()), T.StructField("emotion", T.StringType()),
        T.StructField("emotion_id", T.IntegerType()), T.StructField("emotion_caption", T.StringType()),
    ]
)
HISTORY = T.StructType(
    [
        T.StructField("model", T.StringType()), T.StructField("epoch", T.IntegerType()),
        T.StructField("train_loss", T.DoubleType()), T.StructField("val_loss", T.DoubleType()),
    ]
)
SURVEY = T.StructType([T.StructField(c, T.StringType()) for c in ("image_id", "emotion", "caption", "question")])


def style_table(spark: SparkSession) -> DataFrame:
    """The five styles and their ids."""
    return spark.createDataFrame([(s, i) for i, s in enumerate(STYLES)], "emotion string, emotion_id int")
