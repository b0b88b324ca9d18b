"""Near-equal texts by a blocked sparse product of texts and word combinations."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenry.llm.bitmaps import Bitmap, bits_for, collect, has
from lumenry.llm.components import components
from lumenry.llm.words import mix, word_marks, word_sets
from lumenry.stage import shuffles_freed, stage

COMMON_WORDS = 4096  # words whose order is by count; all others come before them, in hash order
COMBINATION = 3
COMBINATION_ACROSS = 4  # as only entries that both sides have move, more words cost little and say more
COMBINED = ((24, 4), (64, 3), (256, 2))  # words of the larger text of a pair up to which at most so many are combined; beyond, single words are
BLOCK_ROWS = 1024
SMALL_PRODUCT = 400  # pairs of two blocks that are compared at once
CELLS = 1 << 20  # entries made at a time
SLICE_ENTRIES, MOST_SLICES = 4_000_000, 4  # staged entries are joined slice after slice, so that only one's shuffle is on disk
TEXTS_A_BITMAP = 1_000_000  # of one task that makes a bitmap
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _ceil(x: Fraction) -> int:
    return math.ceil(x)


def _bounds(n: int, t: Fraction, k: int) -> tuple[int, int]:
    """Words of the rarest-first order that a set of ``n`` gives as the smaller and as the larger of a pair."""
    small = min(n, n - _ceil(2 * t * n / (1 + t)) + k)
    large = min(n, n - _ceil(t * n) + k)
    return small, large


def _order(n: int, k: int) -> int:
    """Words combined in pairs whose larger set has ``n``: fewer for long texts, as the combinations grow with that power."""
    return min(k, next((order for most, order in COMBINED if n <= most), 1))


def _orders(n: int, t: Fraction, k: int) -> list[int]:
    """Of all pairs in which a set of ``n`` words can be, the words combined; the first are those of pairs where it is the larger."""
    return list(range(_order(n, k), _order(math.floor(n / t), k) - 1, -1))


class _Incidence:
    """Rows of the incidence matrix: text by combination of a few of its rarest words, as the larger or the smaller of a pair."""

    def __init__(self, ranks: dict[str, int], t: Fraction, k: int):
        self.ranks, self.t, self.k = ranks, t, k
        self.shapes: dict[int, list[tuple[int, bool, np.ndarray, np.ndarray]]] = {}

    def shape(self, n: int) -> list[tuple[int, bool, np.ndarray, np.ndarray]]:
        """Of a text of ``n`` words, for each number of words combined: whether that is for pairs where it is the larger,
        the combinations, and which of them it gives as the smaller."""
        if n not in self.shapes:
            if len(self.shapes) > 256:
                self.shapes.clear()
            self.shapes[n] = []
            for order in _orders(n, self.t, self.k):
                small, large = _bounds(n, self.t, order)
                own = order == _order(n, self.k)
                combos = np.array(list(combinations(range(large if own else small), order)), dtype=np.int64).reshape(-1, order)
                self.shapes[n].append((order, own, combos, combos[:, -1] < small))
        return self.shapes[n]

    def rows(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, int, np.ndarray, bool, np.ndarray]]:
        """``(text, words, mark, large, small)`` of the combinations of a batch of texts, those of equal size together.

        ``sketch`` has then for each text a bit of 64 for every word.
        """
        listed = pc.split_pattern(texts, " ")
        flat = listed.flatten().dictionary_encode()
        vocabulary = flat.dictionary.to_pylist()
        rank = np.fromiter((self.ranks.get(w, 0) for w in vocabulary), np.uint64, len(vocabulary))
        # Rarest first; words of one rank by their marks.
        marks = word_marks(vocabulary, False)[0]
        codes = flat.indices.to_numpy(zero_copy_only=False)
        key = (rank << np.uint64(52) | marks >> np.uint64(12))[codes]
        count = np.diff(listed.offsets.to_numpy())
        starts = np.cumsum(count) - count
        self.sketch = np.bitwise_or.reduceat((np.uint64(1) << (marks & np.uint64(63)))[codes], starts) if len(codes) else np.zeros(0, np.uint64)
        for n in np.unique(count).tolist():
            same = np.flatnonzero(count == n)
            for order, own, combos, small in self.shape(n):
                step = max(1, CELLS // max(1, len(combos)))
                for i in range(0, len(same), step):
                    some = same[i : i + step]
                    words = key[starts[some][:, None] + np.arange(n)]
                    words.sort(axis=1)
                    mark = np.full((len(some), len(combos)), order, dtype=np.uint64)
                    for j in range(order):
                        mark = (mark ^ words[:, combos[:, j]]) * _MIX[j % 3]
                        mark ^= mark >> np.uint64(29)
                    yield np.repeat(some, len(combos)), n, mix(mark.reshape(-1)), own, np.tile(small, len(some))


class _Entries:
    """Entries of one batch of texts, put together so that few batches leave."""

    def __init__(self, ids: pa.Array):
        self.ids, self.held, self.size = ids, [], 0

    def add(self, text: np.ndarray, n: int, mark: np.ndarray, large: bool | np.ndarray, small: bool | np.ndarray, turn: int) -> None:
        m = len(mark)
        self.size += m
        self.held.append((text, np.full(m, n, np.int32), mark, np.broadcast_to(large, m), np.broadcast_to(small, m), np.full(m, turn, np.int32)))

    def take(self, sketch: np.ndarray) -> pa.RecordBatch:
        empty = [np.zeros(0, t) for t in (np.int64, np.int32, np.uint64, bool, bool, np.int32)]
        text, n, mark, large, small, turn = (np.concatenate(x) for x in zip(empty, *self.held))
        self.held, self.size = [], 0
        return pa.record_batch(
            [pa.array(mark.view(np.int64)), self.ids.take(pa.array(text)), pa.array(n), pa.array(large), pa.array(small), pa.array(turn), pa.array(sketch[text].view(np.int64))],
            ["sig", "id", "n", "large", "small", "turn", "sketch"],
        )


_ENTRIES = "sig bigint, id bigint, n int, large boolean, small boolean, turn int, sketch bigint"


def _matrix(ranks: dict[str, int], t: Fraction, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        incidence = _Incidence(ranks, t, k)
        for batch in batches:
            found = _Entries(batch.column(0))
            for text, n, mark, large, small in incidence.rows(batch.column(1)):
                found.add(text, n, mark, large, small, 0)
                if found.size > CELLS:
                    yield found.take(incidence.sketch)
            yield found.take(incidence.sketch)

    return run


def _matrix_of_side(ranks: dict[str, int], t: Fraction, k: int, side: int, others: list[Bitmap]):
    """Entries of one side that the other may have: of turn ``s``, the larger text is of side ``s`` and the smaller of the other.

    ``others`` are bitmaps of the other side's marks, as smaller and as larger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        incidence = _Incidence(ranks, t, k)
        as_small, as_large = others
        for batch in batches:
            found = _Entries(batch.column(0))
            for text, n, mark, large, small in incidence.rows(batch.column(1)):
                if large:
                    keep = np.flatnonzero(has(as_small, mark))
                    found.add(text[keep], n, mark[keep], True, False, side)
                keep = np.flatnonzero(small)
                keep = keep[has(as_large, mark[keep])]
                found.add(text[keep], n, mark[keep], False, True, 3 - side)
                if found.size > CELLS:
                    yield found.take(incidence.sketch)
            yield found.take(incidence.sketch)

    return run


def _marks(ranks: dict[str, int], t: Fraction, k: int):
    def run(batch: pa.RecordBatch) -> list[np.ndarray]:
        found: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
        for _, _, mark, large, small in _Incidence(ranks, t, k).rows(batch.column(1)):
            found[0].append(mark[small])
            if large:
                found[1].append(mark)
        return [np.concatenate(f) for f in found]

    return run


def _across(sets: DataFrame, ranks: dict[str, int], t: Fraction, k: int) -> tuple[DataFrame, DataFrame]:
    """The entries of both sides that the other has too, but for what bitmaps of bounded size can't tell apart.

    First the smaller side's marks are a bitmap, then the entries of the other
    that are in it are staged, and their marks choose among the smaller side's.
    """
    first, second = sets.where(F.col("side").bitwiseAND(1) > 0), sets.where(F.col("side").bitwiseAND(2) > 0)
    n, m = first.count(), second.count()
    few, many, side = (second, first, 1) if m <= n else (first, second, 2)
    bits = bits_for(min(n, m) * 64)
    held = collect(few.select("id", "text").coalesce(1 + min(n, m) // TEXTS_A_BITMAP), _marks(ranks, t, k), [bits, bits])
    one = stage(many.select("id", "text").mapInArrow(_matrix_of_side(ranks, t, k, side, held), _ENTRIES), "entries")
    size = one.count()
    pick = lambda b: [
        b.column(0).filter(b.column(c)).to_numpy(zero_copy_only=False).view(np.uint64) for c in (2, 1)
    ]
    held = collect(one.select("sig", "large", "small").coalesce(1 + size // (64 * TEXTS_A_BITMAP)), pick, [bits_for(size), bits_for(size)])
    two = stage(few.select("id", "text").mapInArrow(_matrix_of_side(ranks, t, k, 3 - side, held), _ENTRIES), "entries")
    return one, two


def near_equal_links(
    sets: DataFrame, threshold: float = 0.7, min_words: int = 5, k: int = COMBINATION, entries: DataFrame | None = None
) -> DataFrame:
    """``(a, b)``, a < b, of all pairs of word sets with shared / union >= ``threshold``.

    ``sets`` has ``id bigint`` (unique) and ``text string``, the distinct words
    joined by single spaces; texts of fewer than ``min_words`` words link to
    nothing. ``entries`` are those of the matrix where only pairs across two
    sides are wanted (``entries_across``). Words are ordered rarest first (counted over all sets; the
    ``COMMON_WORDS`` most frequent go to the driver, a fixed bound, any others
    count as rarer). Two sets that are near-equal share at least ``k`` of the
    first words of that order whose number follows from their sizes, so the
    product of the sparse matrix (set by combination of ``k`` such words) with
    its transpose has an entry for every near-equal pair. It is blocked by
    combination over the cluster; entries of pairs that a sketch of their words
    rules out are left out, the others summed, those under the bound that the
    two sizes give discarded, and the rest is compared word by word.
    """
    t = Fraction(threshold).limit_denominator(1000)
    sets = _long_enough(sets, min_words, k).select("id", "text")
    matrix = sets.mapInArrow(_matrix(_ranks(sets), t, k), _ENTRIES) if entries is None else entries
    large = matrix.where("large").select("sig", "turn", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    small = matrix.where("small").select("sig", "turn", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    # Shared words needed of two sets, and what they can share by their sketches: a bit that the other lacks is a word it lacks.
    need = F.ceil((F.col("n_a") + F.col("n_b")) * t.numerator / F.lit(float(t.numerator + t.denominator)) - 1e-9)
    lacks = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    in_both = lambda x, y: (
        x.join(y, ["sig", "turn"])
        .where((F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("b") < F.col("a"))))
        .where(F.col("n_b") * t.denominator >= F.col("n_a") * t.numerator)
        .where((F.col("n_a") - lacks("s_a", "s_b") >= need) & (F.col("n_b") - lacks("s_b", "s_a") >= need))
        .groupBy("a", "b", "n_a", "n_b")
        .agg(F.count("*").alias("entries"))
    )
    n_slices = 1 if entries is None else min(MOST_SLICES, 1 + entries.count() // SLICE_ENTRIES)
    if n_slices == 1:
        matched = in_both(large, small)
    else:
        own = lambda x, i: x.where(F.pmod("sig", F.lit(n_slices)) == i)
        parts = [stage(in_both(own(large, i), own(small, i)), "matched") for i in range(n_slices)]
        matched = reduce(DataFrame.unionByName, parts).groupBy("a", "b", "n_a", "n_b").agg(F.sum("entries").alias("entries"))
    # Words of either that lie behind those compared so far.
    used = F.lit(1)
    for most, order in reversed(COMBINED):
        used = F.when(F.col("n_a") <= most, min(order, k)).otherwise(used)
    rest = F.greatest(
        F.ceil(F.col("n_a") * t.numerator / F.lit(float(t.denominator)) - 1e-9) - used,
        F.ceil(2 * F.col("n_b") * t.numerator / F.lit(float(t.numerator + t.denominator)) - 1e-9) - used,
    )
    short = need - rest
    least = F.lit(1.0)
    for order in range(1, k + 1):
        least = F.when((used == order) & (short > order), _combinations(short, order)).otherwise(least)
    pairs = matched.where(F.col("entries") >= least).select("a", "b")
    words = sets.select("id", "text")
    checked = (
        pairs.join(words.select(F.col("id").alias("a"), F.split("text", " ").alias("x")), "a")
        .join(words.select(F.col("id").alias("b"), F.split("text", " ").alias("y")), "b")
        .withColumn("shared", F.size(F.array_intersect("x", "y")))
        .where(F.col("shared") * t.denominator >= (F.size("x") + F.size("y") - F.col("shared")) * t.numerator)
    )
    return checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _long_enough(sets: DataFrame, min_words: int, k: int) -> DataFrame:
    return sets.withColumn("id", F.col("id").cast("bigint")).where(F.size(F.split("text", " ")) >= max(min_words, k))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = pc.split_pattern(batch.column(0), " ").flatten().value_counts()
        yield pa.record_batch([counts.field(0), counts.field(1)], ["word", "n"])


def _ranks(sets: DataFrame) -> dict[str, int]:
    """The most frequent words, the most frequent with the greatest number; any others count as rarer."""
    with shuffles_freed(sets.sparkSession):
        counted = sets.select("text").mapInArrow(_word_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        top = counted.orderBy(F.desc("n"), "word").limit(COMMON_WORDS).collect()
    return {r["word"]: len(top) - i for i, r in enumerate(top)}


def entries_across(sets: DataFrame, threshold: float = 0.7, min_words: int = 5, k: int = COMBINATION) -> DataFrame:
    """The entries of ``near_equal_links``' matrix that both sides have, for sets with ``side`` (1, 2, or 3 for both).

    A text without an entry is near-equal to none of the other side. Entries
    are kept by bitmaps of bounded size, which may leave some that the other
    side lacks.
    """
    t = Fraction(threshold).limit_denominator(1000)
    sets = _long_enough(sets, min_words, k).select("id", "text", "side")
    one, two = _across(sets, _ranks(sets.select("text")), t, k)
    return one.unionByName(two)


def _combinations(n: Column, k: int) -> Column:
    out = F.lit(1.0)
    for j in range(k):
        out = out * (n - j) / (j + 1)
    return out


def _sketch(words: frozenset[str]) -> int:
    out = 0
    for w in words:
        out |= 1 << (zlib.crc32(w.encode()) & 63)
    return out


class _Block:
    """The distinct texts of a block with their rows, sizes and sketches."""

    def __init__(self, rows: list[dict], min_words: int):
        by_text: dict[str, list[int]] = {}
        for row in rows:
            by_text.setdefault(row["text"], []).append(row["id"])
        found = [(frozenset(text.split(" ")), sorted(ids)) for text, ids in by_text.items()]
        found = [x for x in found if len(x[0]) >= min_words]
        self.words, self.ids = [x[0] for x in found], [x[1] for x in found]

    def _facts(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([len(w) for w in self.words], dtype=np.int64), np.array([_sketch(w) for w in self.words], dtype=np.uint64)

    def _possible(self, other: _Block, t: Fraction) -> Iterator[tuple[int, int]]:
        """Places here and there whose texts may be near-equal: all of small blocks, else those that sizes and sketches leave."""
        if len(self.words) * len(other.words) <= SMALL_PRODUCT:
            yield from combinations(range(len(self.words)), 2) if other is self else product(range(len(self.words)), range(len(other.words)))
            return
        (n, a), (m, b) = ((x[:, None], y[:, None]) for x, y in (self._facts(), other._facts()))
        m, b = m.T, b.T
        shared = np.minimum(n - np.bitwise_count(a & ~b), m - np.bitwise_count(b & ~a))
        left = shared * (t.numerator + t.denominator) >= t.numerator * (n + m)
        yield from zip(*(x.tolist() for x in np.nonzero(np.triu(left, 1) if other is self else left)))

    def near(self, other: _Block, t: Fraction) -> Iterator[tuple[int, int]]:
        """Places of near-equal texts here and there; of a block with itself each pair once."""
        num, den = t.numerator, t.denominator
        for i, j in self._possible(other, t):
            x, y = self.words[i], other.words[j]
            if len(x) * den >= len(y) * num and len(y) * den >= len(x) * num:
                same = len(x & y)
                if same * den >= (len(x) + len(y) - same) * num:
                    yield i, j


def _compare(t: Fraction, min_words: int, all_pairs: bool):
    """Pairs within one block, or between two blocks whose first texts are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked: list[tuple[int, int]] = []
            for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = _Block(one, min_words)
                y = x if two is None else _Block(two, min_words)
                for ids in x.ids if two is None else ():
                    linked.extend(combinations(ids, 2) if all_pairs else ((ids[0], other) for other in ids[1:]))
                for i, j in x.near(y, t) if x.words and y.words else ():
                    linked.extend(product(x.ids[i], y.ids[j]) if all_pairs else [(x.ids[i][0], y.ids[j][0])])
            yield pa.record_batch([pa.array([min(p) for p in linked], pa.int64()), pa.array([max(p) for p in linked], pa.int64())], ["a", "b"])

    return run


def _as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns behind the first as sets of words."""
    for batch in batches:
        yield pa.record_batch([batch.column(0), *(word_sets(c) for c in batch.columns[1:])], batch.schema.names)


def near_equal_rows(
    rows: DataFrame, key: str, first: str, second: str, threshold: float = 0.7, min_words: int = 5, all_pairs: bool = True
) -> DataFrame:
    """``(a, b)``, a < b, of the keys of all rows near-equal in both ``first`` and ``second``.

    Equal rows are pairs too; with ``all_pairs`` false a row equal to others
    stands for them (the least key), and they are linked to it alone, which
    keeps every class connected. Rows with a null or short text are in no pair.
    Distinct ``first`` texts are linked by ``near_equal_links``; the rows of one
    text form a block, and blocks are compared where their texts are equal or
    linked. A text of more than ``BLOCK_ROWS`` rows is no block: its rows and
    those of the texts linked to it have their ``second`` texts linked by the
    same product, and the two kinds of links are joined.
    """
    t = Fraction(threshold).limit_denominator(1000)
    rows = rows.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    named = rows.select(F.col(key).cast("bigint").alias("id"), F.col(first).alias("first"), F.col(second).alias("second"))
    texts = named.mapInArrow(_as_sets, "id bigint, first string, second string")
    # Texts as written are counted before their words are looked for.
    written = named.groupBy("first").agg(F.count("*").alias("n")).select("n", "first").mapInArrow(_as_sets, "n bigint, first string")
    counts = written.groupBy(F.unhex(F.md5("first")).alias("mark")).agg(F.sum("n").alias("n"))
    heavy = stage(counts.where(F.col("n") > BLOCK_ROWS).select("mark"), "heavy")
    any_heavy = not heavy.isEmpty()
    marked = texts.withColumn("mark", F.unhex(F.md5("first")))
    light = marked.join(heavy, "mark", "left_anti") if any_heavy else marked
    blocks = stage(
        light.groupBy("mark")
        .agg(F.min("id").alias("id"), F.first("first").alias("text"), F.collect_list(F.struct("id", F.col("second").alias("text"))).alias("block"))
        .where(F.size(F.split("text", " ")) >= min_words)
        .drop("mark"),
        "blocks",
    )
    distinct = blocks.select("id", "text")
    if any_heavy:
        hot = stage(
            marked.join(heavy, "mark").groupBy("mark").agg(F.min("id").alias("id"), F.first("first").alias("text"))
            .where(F.size(F.split("text", " ")) >= min_words),
            "hot",
        )
        distinct = distinct.unionByName(hot.select("id", "text"))
    links = stage(near_equal_links(distinct, threshold, min_words), "links")
    own = blocks.select(F.col("block").alias("one"), F.lit(None).cast(blocks.schema["block"].dataType).alias("two"))
    across = (
        links.join(blocks.select(F.col("id").alias("a"), F.col("block").alias("one")), "a")
        .join(blocks.select(F.col("id").alias("b"), F.col("block").alias("two")), "b")
        .select("one", "two")
    )
    found = own.unionByName(across).mapInArrow(_compare(t, min_words, all_pairs), "a bigint, b bigint")
    if not any_heavy:
        return found
    return found.unionByName(_heavy_rows(marked, heavy, hot, blocks, links, threshold, min_words, all_pairs))


def _heavy_rows(marked, heavy, hot, blocks, links, threshold: float, min_words: int, all_pairs: bool) -> DataFrame:
    """Pairs of which at least one row has a heavy first text."""
    hot_ids = hot.select("id")
    beside = (
        links.join(hot_ids.withColumnRenamed("id", "a"), "a", "left_semi")
        .unionByName(links.join(hot_ids.withColumnRenamed("id", "b"), "b", "left_semi"))
        .distinct()
    )
    ends = beside.select(F.col("a").alias("id")).unionByName(beside.select(F.col("b").alias("id"))).distinct()
    cold = (
        blocks.join(ends, "id", "left_semi").select(F.col("id").alias("text_id"), F.explode("block").alias("row"))
        .select("text_id", F.col("row.id").alias("id"), F.col("row.text").alias("second"))
    )
    warm = marked.join(heavy, "mark").join(hot.select("mark", F.col("id").alias("text_id")), "mark").select("text_id", "id", "second")
    each = stage(warm.unionByName(cold).withColumn("other", F.unhex(F.md5("second"))), "heavy_rows")
    seconds = stage(
        each.groupBy("other").agg(F.min("id").alias("id"), F.first("second").alias("text"))
        .where(F.size(F.split("text", " ")) >= min_words),
        "seconds",
    )
    second_links = near_equal_links(seconds.select("id", "text"), threshold, min_words)
    same = seconds.select(F.col("id").alias("a"), F.col("id").alias("b"))
    second_links = second_links.unionByName(second_links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(same)
    first_links = beside.unionByName(beside.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(
        hot_ids.select(F.col("id").alias("a"), F.col("id").alias("b"))
    )
    classes = each.join(seconds.select("other", F.col("id").alias("second_id")), "other").select("text_id", "second_id", "id")
    heads = classes.groupBy("text_id", "second_id").agg(F.min("id").alias("head"))
    two = heads.select(F.col("text_id").alias("t2"), F.col("second_id").alias("s2"), F.col("head").alias("head_b"))
    joined = (
        heads.join(first_links.select(F.col("a").alias("text_id"), F.col("b").alias("t2")), "text_id")
        .join(second_links.select(F.col("a").alias("second_id"), F.col("b").alias("s2")), "second_id")
        .join(two, ["t2", "s2"])
        .where("head < head_b")
        .select("head", "head_b")
    )
    members = classes.join(heads, ["text_id", "second_id"]).join(hot_ids.withColumnRenamed("id", "hot"), F.col("text_id") == F.col("hot"), "left")
    members = members.select("head", "id", F.col("hot").isNotNull().alias("is_hot"))
    if not all_pairs:
        return joined.select(F.col("head").alias("a"), F.col("head_b").alias("b")).unionByName(
            members.where("is_hot and id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
        )
    across = (
        joined.join(members.select("head", F.col("id").alias("x")), "head")
        .join(members.select(F.col("head").alias("head_b"), F.col("id").alias("y")), "head_b")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    )
    within = (
        members.where("is_hot").select("head", F.col("id").alias("a"))
        .join(members.where("is_hot").select("head", F.col("id").alias("b")), "head")
        .where("a < b")
        .select("a", "b")
    )
    return across.unionByName(within)


def near_equal_groups(rows: DataFrame, key: str, first: str, second: str, threshold: float = 0.7) -> DataFrame:
    """``(key, group_id, n_links)`` of every row that is near-equal to another.

    ``group_id`` is the least key of the group; ``n_links`` counts the links of
    the row between different texts and to the one that stands for its copies.
    """
    links = stage(near_equal_rows(rows, key, first, second, threshold, all_pairs=False), "group_links")
    parts = components(links.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")))
    ends = links.select(F.col("a").alias(key)).unionByName(links.select(F.col("b").alias(key)))
    degree = ends.groupBy(key).agg(F.count("*").alias("n_links"))
    named = parts.select(F.col("node").cast("bigint").alias(key), "component")
    least = named.groupBy("component").agg(F.min(key).alias("group_id"))
    return named.join(least, "component").join(degree, key).select(key, "group_id", "n_links")
