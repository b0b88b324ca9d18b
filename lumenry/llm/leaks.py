"""Held-out passages inside documents, by the q-gram lemma in diagonal bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.functions.text import tokenize
from lumenry.stage import stage

Q = 16
BAND = 8  # characters; bands overlap by half
BAND_WORDS = 3
EDITS = 1
BLOCK_BYTES = 4_000_000  # of item text that a task holds at a time
SLICE_BYTES = 400_000
COUNTER = 4_000_000  # pairs of texts and items that are counted in one array
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _grams(text: bytes) -> np.ndarray:
    """A 64-bit mark of every run of ``Q`` bytes."""
    raw = np.frombuffer(text, dtype=np.uint8)
    n = len(raw) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    half = np.zeros(n + Q // 2, dtype=np.uint64)  # of eight bytes each, one more than there are places for the second
    raw = np.append(raw, np.uint8(0))
    for i in range(Q // 2):
        half |= raw[i : i + n + Q // 2].astype(np.uint64) << np.uint64(8 * i)
    mark = half[:n] * _A ^ half[Q // 2 :] * _B
    return mark ^ mark >> np.uint64(31)


class _Index:
    """Q-grams of the items: sorted marks, and for each the items and places that have it."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, edits: int):
        self.ids = [i for i, _ in items]
        self.words = [t.split(" ") for _, t in items]
        self.starts = [_word_starts(t) for _, t in items]
        marks, owner, place, self.least = [], [], [], []
        for k, (_, text) in enumerate(items):
            g = _grams(text.encode())
            marks.append(g)
            owner.append(np.full(len(g), k, dtype=np.int64))
            place.append(np.arange(len(g), dtype=np.int64))
            lengths = np.array([len(w) + 1 for w in self.words[k]])
            sums = np.concatenate([[0], np.cumsum(lengths)])
            shortest = int((sums[min_words:] - sums[:-min_words]).min()) - 1
            # The lemma: so many q-grams of a passage are left after so many edits.
            self.least.append(max(1, shortest - Q + 1 - Q * edits))
        self.least = np.array(self.least, dtype=np.int64)
        mark = np.concatenate(marks) if marks else np.zeros(0, dtype=np.uint64)
        order = np.argsort(mark, kind="stable")
        self.owner = np.concatenate(owner)[order] if marks else np.zeros(0, dtype=np.int64)
        self.place = np.concatenate(place)[order] if marks else np.zeros(0, dtype=np.int64)
        self.mark, first = np.unique(mark[order], return_index=True)
        self.first = np.append(first, len(mark)).astype(np.int64)
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[(self.mark >> np.uint64(42)).astype(np.int64)] = True


def _word_starts(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return np.concatenate([[0], np.flatnonzero(raw == 32) + 1])


def _align(doc: list[str], item: list[str], shift: int) -> tuple[int, int]:
    """Banded local alignment of words: most matched words of a passage, and the longest run without an edit.

    ``shift`` is the item's word index less the document's; the band takes
    ``BAND_WORDS`` words to either side. A match counts 1, an edit -1.
    """
    width = 2 * BAND_WORDS + 1
    score, hits, run = [0] * (width + 2), [0] * (width + 2), [0] * (width + 2)
    most, longest = (0, 0), 0
    for i, word in enumerate(doc):
        new_score, new_hits, new_run = [0] * (width + 2), [0] * (width + 2), [0] * (width + 2)
        for b in range(width):
            j = i + shift + b - BAND_WORDS
            if not 0 <= j < len(item):
                continue
            k = b + 1
            if item[j] == word:
                new_run[k] = run[k] + 1
                longest = max(longest, new_run[k])
                best = (score[k] + 1, hits[k] + 1)
            else:
                best = max((score[k] - 1, hits[k]), (0, 0))
            best = max(best, (score[k + 1] - 1, hits[k + 1]), (new_score[k - 1] - 1, new_hits[k - 1]))
            if best[0] <= 0:
                best = (0, 0)
            new_score[k], new_hits[k] = best
            most = max(most, best)
        score, hits, run = new_score, new_hits, new_run
    return most[1], longest


def _search(items: list[tuple[int, str]], min_words: int, edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(items, min_words, edits)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start, size = 0, 0
            for at in range(len(texts) + 1):
                if at == len(texts) or size >= SLICE_BYTES:
                    yield _regions(index, ids[start:at], texts[start:at])
                    start, size = at, 0
                if at < len(texts):
                    size += len(texts[at])

    return run


def _often(pair: np.ndarray, most: int) -> np.ndarray:
    """How often each entry's pair occurs: by a counter of all possible pairs where that is small, else of those that occur."""
    if most <= COUNTER:
        return np.bincount(pair, minlength=most)[pair]
    _, back, times = np.unique(pair, return_inverse=True, return_counts=True)
    return times[back]


def _regions(index: _Index, ids: list[int], texts: list[str]) -> pa.RecordBatch:
    found: dict[tuple[int, int], tuple[int, int]] = {}
    joined = ("\n" * Q).join(texts).encode()
    starts = np.concatenate([[0], np.cumsum([len(t) + Q for t in texts])])
    marks = _grams(joined)
    n_items = len(index.ids)
    if len(marks) and n_items:
        at = np.flatnonzero(index.seen[(marks >> np.uint64(42)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(index.mark, marks[at]), len(index.mark) - 1)
        same = index.mark[spot] == marks[at]
        at, spot = at[same], spot[same]
        count = index.first[spot + 1] - index.first[spot]
        where = np.repeat(at, count)
        within = np.arange(len(where)) - np.repeat(np.cumsum(count) - count, count)
        entry = np.repeat(index.first[spot], count) + within
        item, place = index.owner[entry], index.place[entry]
        doc = np.searchsorted(starts, where, side="right") - 1
        pair = doc * n_items + item
        keep = _often(pair, len(texts) * n_items) >= index.least[item]
        where, item, place, doc, pair = where[keep], item[keep], place[keep], doc[keep], pair[keep]
        diagonal = where - starts[doc] - place + (1 << 30)
        for grid in (0, BAND // 2):
            band = (diagonal + grid) // BAND
            order = np.lexsort((where, band, pair))
            p, b, w, x = pair[order], band[order], where[order], place[order]
            new = np.concatenate([[True], (p[1:] != p[:-1]) | (b[1:] != b[:-1])]) if len(p) else np.zeros(0, dtype=bool)
            heads = np.flatnonzero(new)
            ends = np.append(heads[1:], len(p))
            # A passage is counted by its distinct places, so that a repeated phrase doesn't count twice.
            for h, e in zip(heads, ends):
                k, d = int(p[h] % n_items), int(p[h] // n_items)
                if e - h < index.least[k] or len(np.unique(w[h:e])) < index.least[k]:
                    continue
                begin, end = int(w[h] - starts[d]), int(w[e - 1] - starts[d]) + Q
                text = texts[d]
                left = max(0, text.rfind(" ", 0, max(0, begin - 40)) + 1)
                right = text.find(" ", min(len(text), end + 40))
                words = text[left : right if right >= 0 else len(text)].split(" ")
                item_word = int(np.searchsorted(index.starts[k], x[h], side="right")) - 1
                doc_word = text.count(" ", left, begin + 1 if begin < len(text) and text[begin] == " " else begin)
                matched, longest = _align(words, index.words[k], item_word - doc_word)
                old = found.get((ids[d], index.ids[k]), (0, 0))
                found[ids[d], index.ids[k]] = (max(old[0], matched), max(old[1], longest))
    rows = [(k, d, m, r) for (d, k), (m, r) in found.items()]
    return pa.record_batch(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32())],
        ["item", "doc", "matched_words", "longest_run"],
    )


def _plain(text: str):
    return F.array_join(tokenize(F.col(text)), " ")


def leaked_passages(
    items: DataFrame, documents: DataFrame, item_key: str, doc_key: str, text: str = "text", min_words: int = 12, edits: int = EDITS
) -> DataFrame:
    """``(item_key, doc_key, matched_words, longest_run)`` of documents with a passage of an item.

    Texts are compared as their words joined by blanks. In each document the
    q-grams shared with an item are counted in overlapping bands of diagonals;
    a band with as many as any passage of ``min_words`` words keeps after
    ``edits`` edits is a region, which banded alignment verifies: at least
    ``min_words`` matched words (``longest_run`` of them without an edit).
    Items of fewer words, and null or empty texts, are in no pair. Repeated
    keys count as one. The items' texts are held by each task in blocks of at most
    ``BLOCK_BYTES``; the documents are read once per block, and never shuffled
    but for the result.
    """
    plain = items.select(F.col(item_key).cast("bigint").alias("id"), _plain(text).alias("text")).where(
        F.col(text).isNotNull()
    ).where(F.size(F.split("text", " ")) >= min_words).distinct()
    size = plain.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    docs = documents.where(F.col(text).isNotNull()).select(F.col(doc_key).cast("bigint").alias("id"), _plain(text).alias("text"))
    if blocks > 1:
        docs = stage(docs, "plain_documents")  # read once per block
    found = None
    for k in range(blocks):
        block = plain.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k)
        held = [(r["id"], r["text"]) for r in block.orderBy("id", "text").collect()]
        part = docs.mapInArrow(_search(held, min_words, edits), "item bigint, doc bigint, matched_words int, longest_run int")
        found = part if found is None else found.unionByName(part)
    return (
        found.where(F.col("matched_words") >= min_words)
        .groupBy("item", "doc")
        .agg(F.max("matched_words").alias("matched_words"), F.max("longest_run").alias("longest_run"))
        .select(F.col("item").alias(item_key), F.col("doc").alias(doc_key), "matched_words", "longest_run")
    )
