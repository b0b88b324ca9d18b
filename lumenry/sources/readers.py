"""Readers: caption files in three layouts, splits, image files, listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenry import schemas

# Texts that common table readers take for a missing value.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)
_CSV = {"header": True, "multiLine": True, "escape": '"', "mode": "PERMISSIVE"}


def missing_to_null(value: Column) -> Column:
    """Null where the text only says that a value is missing (the whole text, case as given)."""
    return F.when(value.isin(*MISSING), F.lit(None)).otherwise(value)


def strip_index(image_id: Column) -> Column:
    """The name before the caption index: ``a.jpg#0`` gives ``a.jpg``."""
    return F.split_part(image_id, F.lit("#"), F.lit(1))


def _numbered(df: DataFrame) -> DataFrame:
    """``row_id`` in the order of the rows of one file."""
    return df.withColumn("row_id", F.monotonically_increasing_id())


def find_captions(spark: SparkSession, folder: str, name: str = "captions.txt") -> str:
    """Path of the caption file: ``name`` in ``folder``, else the first ``*.txt`` below by path."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder).select("path")
    )
    best = files.select(F.min(F.struct((~F.col("path").endswith(f"{folder.rstrip('/')}/{name}")).alias("other"), "path")).alias("m")).first()
    if best is None or best["m"] is None:
        raise FileNotFoundError(f"no caption file below {folder}")
    return best["m"]["path"]


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    """``(row_id, image_id, caption)`` of a caption file in any of three layouts.

    The header decides: ``image, caption``; ``image_id, caption``; or none,
    then tab-separated ``name#index`` and caption. Values may hold line breaks,
    so a CSV file is read by one task: write large ones as parquet first.
    """
    head = spark.read.text(path).limit(1).collect()
    names = [c.strip().strip('"') for c in head[0][0].split(",")] if head else []
    if "image_id" in names or "image" in names and "caption" in names:
        fields = T.StructType([T.StructField(c, T.StringType()) for c in names])
        read = spark.read.schema(fields).options(**_CSV).csv(path)
        key = "image" if "image" in names and "caption" in names else "image_id"
        found = read.select(F.col(key).alias("image_id"), "caption")
    else:
        read = spark.read.schema(schemas.CAPTION).csv(path, sep="\t", header=False, quote="")
        found = read.withColumn("image_id", strip_index(F.col("image_id")))
    found = found.select(*(missing_to_null(F.col(c)).alias(c) for c in ("image_id", "caption")))
    return _numbered(found).select("row_id", "image_id", "caption")


def read_styled(spark: SparkSession, path: str) -> DataFrame:
    """A styled table or split from CSV, with ``row_id``."""
    read = spark.read.schema(schemas.STYLED).options(**_CSV).csv(path)
    text = [F.col(c) if c == "emotion_id" else missing_to_null(F.col(c)).alias(c) for c in read.columns]
    return _numbered(read.select(*text))


def image_folder(spark: SparkSession, folder: str) -> str:
    """``folder/Images`` if there is such a folder, else ``folder``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/Images")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = files.exists(path) and files.getFileStatus(path).isDirectory()
    return f"{folder.rstrip('/')}/Images" if there else folder


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, name, bytes)`` of the files below a folder; contents aren't read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return read.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


def listing(spark: SparkSession, folder: str, unit: int = 1_000_000) -> DataFrame:
    """File names with sizes in units of ``unit`` bytes, one decimal, by name."""
    return list_files(spark, folder).select("name", F.round(F.col("bytes") / unit, 1).alias("size")).orderBy("name")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, content)`` of the image files below a folder."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return read.load(folder).select("path", "content")


def read_decoded_images(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, height, width, channels, pixels)`` of the JPEG, PNG, GIF and BMP files below a folder, decoded by the JVM; others drop out.

    ``pixels`` are bytes by row, blue before green before red.
    """
    read = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(folder)
    i = F.col("image")
    return read.select(i["origin"].alias("path"), i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("channels"), i["data"].alias("pixels"))


def image_path(image_id: Column, folder: str, stored: Column | None = None) -> Column:
    """Where an image lies: ``stored`` if that is absolute, else ``folder/image_id``."""
    joined = F.concat_ws("/", F.lit(folder.rstrip("/")), image_id)
    return joined if stored is None else F.when(stored.startswith("/"), stored).otherwise(joined)


def union_runs(runs: list[DataFrame]) -> DataFrame:
    """All rows of several runs, by column name."""
    return reduce(DataFrame.unionByName, runs)
