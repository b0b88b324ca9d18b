"""The tokeniser over Arrow columns, for operators that are in Python anyway."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PRIME = np.uint64(0x100000001B3)
LONG = 48  # bytes; longer words are no rows of a table of bytes
_DELETED = r"[^a-z0-9\s'\p{Z}\x{85}]"


def tokenised(texts: pa.Array) -> pa.ListArray:
    """Words of each text, as ``lumenry.functions.text.tokenize`` gives them; a null text has none."""
    plain = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), _DELETED, ""))
    split = pc.utf8_split_whitespace(plain)
    # A blank text is split into one empty word.
    count = np.where(pc.equal(plain, "").to_numpy(zero_copy_only=False), 0, np.diff(split.offsets.to_numpy()))
    flat = split.flatten()
    offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, flat.filter(pc.not_equal(flat, "")))


def word_sets(texts: pa.Array) -> pa.Array:
    """The distinct words of each text joined by single blanks, in an order that is the same for all texts; a null text has none."""
    words = tokenised(texts)
    flat = words.flatten().dictionary_encode()
    n = len(flat.dictionary)
    if not n:
        return pa.array([""] * len(texts), pa.string())
    by_mark = np.argsort(word_marks(flat.dictionary.to_pylist(), False)[0])
    place = np.empty(n, dtype=np.int64)
    place[by_mark] = np.arange(n)
    row = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    keys = row * n + place[flat.indices.to_numpy(zero_copy_only=False)]
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    counts = np.bincount(keys // n, minlength=len(texts))
    found = flat.dictionary.take(pa.array(by_mark[keys % n]))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), found), " ")


def word_marks(words: list[str], beginnings: bool = True) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """A mark of each word, and for each length the words longer than that with the marks of their beginnings."""
    raw = [w.encode() for w in words]
    long = [i for i, w in enumerate(raw) if len(w) > LONG]
    short = np.array([w if len(w) <= LONG else b"" for w in raw], dtype=np.bytes_)
    width = max(1, short.dtype.itemsize)
    table = short.view(np.uint8).reshape(len(raw), width) if len(raw) else np.zeros((0, 1), np.uint8)
    length = (table != 0).sum(axis=1)
    mark = np.full(len(raw), 0xCBF29CE484222325, dtype=np.uint64)
    begun = []
    for j in range(width):
        on = length > j
        mark = np.where(on, (mark ^ table[:, j].astype(np.uint64)) * _PRIME, mark)
        more = np.flatnonzero(length > j + 1) if beginnings else ()
        if len(more):
            begun.append((more, mark[more]))
    for i in long:
        h = 0xCBF29CE484222325
        for c in raw[i]:
            h = (h ^ c) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        mark[i] = h
    return mix(mark), [(at, mix(m)) for at, m in begun]


def long_beginnings(word: str) -> np.ndarray:
    """The marks of all beginnings of a word that ``word_marks`` gives none for, as it is too long; of any other none."""
    raw, found, h = word.encode(), [], 0xCBF29CE484222325
    for c in raw[:-1] if len(raw) > LONG else b"":
        h = (h ^ c) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        found.append(h)
    return mix(np.array(found, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)
