"""The style dimension and the repair of style labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Style labels by emotion id.
STYLES = ("joyful", "sad", "tense", "romantic", "humorous")


def style_label(raw: Column, emotion_id: Column | None = None) -> Column:
    """The label meant by ``raw``; ``emotion_id`` decides first where it is given.

    Case, blanks and punctuation are ignored, three or more leading letters
    stand for the word, and up to two edits are forgiven. Null if none fits.
    """
    word = F.regexp_replace(F.lower(raw), "[^a-z]", "")

    def fits(style: str) -> Column:
        short = (F.length(word) >= 3) & F.lit(style).startswith(word)
        return short | (F.levenshtein(word, F.lit(style)) <= (1 if len(style) < 4 else 2))

    by_word = reduce(lambda c, s: c.when(word == s, s), STYLES[1:], F.when(word == STYLES[0], STYLES[0]))
    by_edit = reduce(lambda c, s: c.when(fits(s), s), STYLES[1:], F.when(fits(STYLES[0]), STYLES[0]))
    named = F.coalesce(by_word, by_edit)
    if emotion_id is None:
        return named
    by_id = reduce(lambda c, i: c.when(emotion_id == i, STYLES[i]), range(1, 5), F.when(emotion_id == 0, STYLES[0]))
    return F.coalesce(by_id, named)
