"""Text functions as Column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(text: Column) -> Column:
    """Lower-case, keep ``[a-z0-9\\s']`` only; Unicode blanks count as blanks."""
    return F.regexp_replace(F.lower(text), r"(?U)[^a-z0-9\s']", "")


def tokenize(text: Column) -> Column:
    """Words of ``text``; null stays null, blank text gives an empty array."""
    return F.array_remove(F.split(clean_text(text), r"(?U)\s+"), "")


def word_count(text: Column) -> Column:
    return F.size(tokenize(text))


def word_set(text: Column) -> Column:
    """Distinct words in code-point order: the canonical form of a word set."""
    return F.array_sort(F.array_distinct(tokenize(text)))


def capitalise(text: Column) -> Column:
    """The first letter upper-case, all others lower-case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def preview(text: Column, length: int = 60) -> Column:
    """The first characters of a text, with dots behind."""
    return F.concat(F.substring(text, 1, length), F.lit("..."))


def photo_key(image_id: Column) -> Column:
    """``number_code`` of a photo name, or null if either part is missing.

    The ten-digit number and the ten-digit hexadecimal code count as whole
    runs only (``640x480`` or a longer run is neither), in that order;
    percent-escapes are separators.
    """
    plain = F.regexp_replace(F.lower(image_id), "%[0-9a-f]{2}", "_")
    strict = r"(?<![0-9a-z])([0-9]{10})[^0-9a-z]+([0-9a-f]{10})(?![0-9a-f])"
    joined = r"(?<![0-9a-z])([0-9]{10})([0-9a-f]{10})(?![0-9a-f])"
    far = r"(?<![0-9a-f])([0-9]{10})(?![0-9a-f]).*?(?<![0-9a-z])([0-9a-f]{10})(?![0-9a-f])"

    def take(pattern: str) -> Column:
        # A match begins with the number and ends with the code; it is looked for once.
        ends = F.transform(F.array(F.regexp_substr(plain, F.lit(pattern))), lambda m: F.concat(F.left(m, F.lit(10)), F.lit("_"), F.right(m, F.lit(10))))
        return F.element_at(ends, 1)

    return F.coalesce(take(strict), take(joined), take(far))
