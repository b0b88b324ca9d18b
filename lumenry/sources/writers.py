"""Writers of tables and small records."""

from __future__ import annotations

from pyspark.sql import DataFrame

_CSV = {"header": True, "escape": '"', "quoteAll": True}


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrites ``path`` with CSV that keeps quotes, commas and line breaks in values."""
    df.write.mode("overwrite").options(**_CSV).csv(path)


def append_styled(df: DataFrame, path: str) -> None:
    """Adds generated rows to a styled table; an empty batch writes nothing."""
    if not df.isEmpty():
        df.write.mode("append").parquet(path)


def write_splits(splits: dict[str, DataFrame], folder: str) -> None:
    for name, df in splits.items():
        write_csv(df, f"{folder}/{name}")


def write_table(df: DataFrame, path: str) -> None:
    """Overwrites ``path`` with a vocabulary, history or other small table."""
    df.coalesce(1).write.mode("overwrite").parquet(path)
