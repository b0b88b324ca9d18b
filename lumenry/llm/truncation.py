"""Texts cut off by a field limit or in transfer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenry.llm.bitmaps import Bitmap, bits_for, collect, has
from lumenry.llm.languages import foreign_rows
from lumenry.llm.words import long_beginnings, mix, tokenised, word_marks
from lumenry.stage import discard, stage

SHINGLE = 5
BANDS, BAND_ROWS = 10, 2  # a beginning with an edit may agree with the copy's in little more than half of its shingles
SIMILARITY = 0.8
COPY_WORDS = SHINGLE + 2  # a text of fewer has less than two shingles besides its last word, which may be cut
PAD = 5  # words of context

# Contexts of a closing word, most telling first; of each the words before the last that must agree, 0 being the last itself.
CONTEXTS = ((5, 4, 2, 1), (3, 2, 1), (4, 3, 1), (3, 2), (2, 1), (0,))
LONGER = len(CONTEXTS)  # the key of words that go on where this one ends
WORD = LONGER - 1
TAIL = 1  # the context after which near-copies are aligned
# Words before the last under which closed texts are compared: those that close with this word, and those with one it begins.
CLOSINGS = ((2, 1), (1,))
KEYS = LONGER + 1 + 2 * len(CLOSINGS)
RATHER = 20  # times as often
PRIOR, PULL = 0.05, 10.0
TERMINAL = 0.025
NEVER_SHARE, NEVER_PRIOR = 0.0005, 0.75  # a word of which so small a share closes texts closes none
OFTEN = 0.1  # of the texts after these words close with the last: a shorter version, not a cut one

CLOSED, DOTS, OPEN, MARKED = 0, 1, 2, 3
UNIT, DOTS_UNIT = 4, 1  # a text that trails off in dots may be cut as well: it closes a context by a quarter, and makes no word known
GOES_ON, CLOSES = 1, 2
ROWS_A_BITMAP = 1_000_000  # of one task that makes bitmaps
PAIRS_AT_ONCE = 10_000_000  # of open texts and beginnings, whose words are on disk at a time
_MULT = np.random.default_rng(7).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)

_PLAIN = r"[^.…][.!?]$"
_DOTTED = r"(?:\.{3,}|…)[\"”’']?$"
_CUT = r"(?:�|\s\[|\\u[0-9a-fA-F]{0,3}|&#?[\pL\pN_]{1,6}|[,;:(/\[{<&+]|[\pL\pN_][-–])$"
_CLOSING = r"(?:(?:[.!?。！？]|[\pL\pN_]\s*\))[\"”’'\])»]*|[\"”»])$"


def _matches(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(bool)


def endings(texts: pa.Array) -> np.ndarray:
    """How each text ends: 0 closed, 1 trailing off in dots, 2 open, 3 with the traces of a cut; a null text is closed."""
    texts = pc.utf8_rtrim_whitespace(pc.fill_null(texts, "."))
    out = np.zeros(len(texts), dtype=np.int32)
    rest = np.flatnonzero(~_matches(texts, _PLAIN))  # not most texts
    texts = texts.take(pa.array(rest))
    bare = pc.replace_substring_regex(texts, _DOTTED, "")
    dots = ~pc.equal(bare, texts).to_numpy(zero_copy_only=False).astype(bool)
    out[rest] = np.where(_matches(bare, _CUT), MARKED, np.where(dots, DOTS, np.where(_matches(texts, _CLOSING), CLOSED, OPEN)))
    return out


class _Words:
    """The words of a batch as marks, each row with ``PAD`` blanks before it."""

    def __init__(self, column: pa.ListArray):
        self.flat = column.flatten().dictionary_encode()
        self.vocabulary = self.flat.dictionary.to_pylist()
        codes = self.flat.indices.to_numpy(zero_copy_only=False)
        marks, self.begun = word_marks(self.vocabulary)
        self.n = np.diff(column.offsets.to_numpy())
        self.first = np.concatenate([[0], np.cumsum(self.n + PAD)])[:-1] + PAD
        self.plain = np.cumsum(self.n) - self.n  # the place of each row's first word without the blanks
        total = int((self.n + PAD).sum())
        self.marks = np.full(total, 0x5851F42D4C957F2D, dtype=np.uint64)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.at = np.arange(len(codes)) + (self.row + 1) * PAD
        self.marks[self.at] = marks[codes]
        self.codes = codes
        self.english = ~foreign_rows(self.vocabulary, codes, self.row, len(self.n))
        self.counts = np.bincount(codes[self.english[self.row]], minlength=len(self.vocabulary))

    def context(self, k: int, at: np.ndarray) -> np.ndarray:
        key = np.full(len(at), 1000003 * (k + 1), dtype=np.uint64)
        for back in CONTEXTS[k]:
            key = (key ^ self.marks[at - back]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key

    def longer(self, marks: np.ndarray) -> np.ndarray:
        return mix(marks ^ np.uint64(0xD1B54A32D192ED03))

    def closing(self, c: int, at: np.ndarray, marks: np.ndarray, begun: bool) -> np.ndarray:
        """Keys of closing words, or of beginnings of them, after the words before ``at``."""
        key = np.full(len(at), 7000003 * (2 * c + begun + 1), dtype=np.uint64)
        for back in CLOSINGS[c]:
            key = mix(key ^ self.marks[at - back])
        return mix(key ^ marks)

    def closings(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """Of rows with words, the keys of their closing words and of all beginnings of these."""
        at = self.first[rows] + self.n[rows] - 1
        codes = self.codes[at - PAD * (rows + 1)]
        for c in range(len(CLOSINGS)):
            yield self.closing(c, at, self.marks[at], False)
        for word_at, mark in self.begun:
            place = np.full(len(self.vocabulary), -1)
            place[word_at] = np.arange(len(word_at))
            some = place[codes] >= 0
            for c in range(len(CLOSINGS)):
                yield self.closing(c, at[some], mark[place[codes[some]]], True)

    def begun_at(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words at these places (among all words), the marks of each and of all its beginnings, and which of the places they are of."""
        codes = self.codes[at]
        which, marks = [np.arange(len(at))], [self.marks[self.at[at]]]
        for word_at, mark in self.begun:
            place = np.full(len(self.vocabulary), -1)
            place[word_at] = np.arange(len(word_at))
            some = np.flatnonzero(place[codes] >= 0)
            which.append(some)
            marks.append(mark[place[codes[some]]])
        for code in np.unique(codes):
            if len(mark := long_beginnings(self.vocabulary[code])):
                some = np.flatnonzero(codes == code)
                which.append(np.repeat(some, len(mark)))
                marks.append(np.tile(mark, len(some)))
        return np.concatenate(which), np.concatenate(marks)

    def end(self, at: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Keys of last words, or of beginnings of them, after the words before ``at`` by which near-copies are aligned."""
        return mix(self.context(TAIL, at) ^ mix(marks + np.uint64(0x2545F4914F6CDD1D)))

    def upto(self, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        """A mark of each row's words up to and with the one at its place."""
        inside = np.arange(len(self.codes), dtype=np.uint64) - self.plain[self.row].astype(np.uint64)
        each = mix(self.marks[self.at] ^ (inside + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
        return mix(total[self.plain[rows] + places + 1] - total[self.plain[rows]] + places.astype(np.uint64))

    def beginnings(self, rows: np.ndarray, places: np.ndarray) -> pa.ListArray:
        """The rows' words up to and with the one at its place."""
        count = places + 1
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.plain[rows], count)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), self.flat.take(pa.array(at)).cast(pa.string()))

    def sketches(self, rows: np.ndarray, shingles: np.ndarray) -> np.ndarray:
        """For each row, a mark of every band of the min-hashes of its first so many shingles."""
        if not len(rows):
            return np.zeros((0, BANDS), dtype=np.uint64)
        starts = np.cumsum(shingles) - shingles
        at = np.arange(int(shingles.sum())) - np.repeat(starts, shingles) + np.repeat(self.first[rows], shingles)
        shingle = np.zeros(len(at), dtype=np.uint64)
        for j in range(SHINGLE):
            shingle = mix(shingle * np.uint64(3) + self.marks[at + j])
        out = np.zeros((len(rows), BANDS), dtype=np.uint64)
        for j, mult in enumerate(_MULT):
            low = np.minimum.reduceat(shingle * mult >> np.uint64(16), starts)
            out[:, j // BAND_ROWS] = (out[:, j // BAND_ROWS] ^ low) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j)
        return mix(out + shingles.astype(np.uint64)[:, None])


def _scale(shingles: np.ndarray) -> np.ndarray:
    """The greatest power of two that isn't more: the shingles a sketch is made of."""
    return 1 << np.floor(np.log2(np.maximum(shingles, 1))).astype(np.int64)


def _lists(values: np.ndarray, count: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(values.view(np.int64)))


_OPEN_SCHEMA = "row_id bigint, defect string, how int, at_prompt int, keys array<bigint>, copies array<bigint>, words array<string>"
_AS_PROMPT, _IN_PROMPT, _BEGINS_PROMPT = 1, 2, 4


def _told_by_prompts(w: _Words, prompts: pa.ListArray) -> np.ndarray:
    """What each row's prompt tells of its last word, as flags."""
    p = _Words(prompts)
    flags = np.zeros(len(w.n), dtype=np.int32)
    last = w.first + w.n - 1
    asked = p.n > 0
    rows = np.flatnonzero(asked)
    same = np.ones(len(rows), dtype=bool)
    for back in range(3):
        same &= w.marks[last[rows] - back] == p.marks[p.first[rows] + p.n[rows] - 1 - back]
    flags[rows[same]] |= _AS_PROMPT
    wanted = w.marks[last][p.row]
    said = np.bincount(p.row, weights=p.marks[p.at] == wanted, minlength=len(w.n)) > 0
    begins = np.zeros(len(w.n), dtype=bool)
    for word_at, mark in p.begun:
        beginning = np.zeros(len(p.vocabulary), dtype=np.uint64)
        beginning[word_at] = mark
        begins[p.row[beginning[p.codes] == wanted]] = True
    flags[said] |= _IN_PROMPT
    flags[begins & ~said] |= _BEGINS_PROMPT
    return flags


Defects = Callable[[pa.Array, pa.Array, pa.ListArray], np.ndarray]


def _open_ends(defects: Callable[[], Defects] | None):
    """Rows that may be cut: contexts of the last word, sketches, and what their prompt tells; and rows with another defect, if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = defects() if defects else None
        for batch in batches:
            how = endings(batch.column(1))
            if judge:
                all_words = tokenised(batch.column(1))
                named = judge(batch.column(1), batch.column(2), all_words)
                broken = np.flatnonzero(named != None)  # noqa: E711
                if len(broken):
                    m = len(broken)
                    none = pa.array(np.zeros(m + 1, np.int32))
                    yield pa.record_batch(
                        [
                            batch.column(0).take(pa.array(broken)), pa.array(named[broken], pa.string()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()),
                            pa.ListArray.from_arrays(none, pa.array([], pa.int64())), pa.ListArray.from_arrays(none, pa.array([], pa.int64())),
                            pa.ListArray.from_arrays(none, pa.array([], pa.string())),
                        ],
                        ["row_id", "defect", "how", "at_prompt", "keys", "copies", "words"],
                    )
                how[broken] = CLOSED
            doubtful = pa.array(np.flatnonzero(how != CLOSED))
            batch, how = batch.take(doubtful), how[how != CLOSED]
            words = all_words.take(doubtful) if judge else tokenised(batch.column(1))
            w = _Words(words)
            keep = np.flatnonzero((w.n > 0) & ((how == MARKED) | (w.n >= 3) & w.english))
            kept = pa.array(keep)
            batch, how, words = batch.take(kept), how[keep], words.take(kept)
            w = _Words(words)
            last = w.first + w.n - 1
            asked = [*(w.context(k, last) for k in range(LONGER)), w.longer(w.marks[last])]
            asked += [w.closing(c, last, w.marks[last], begun) for c in range(len(CLOSINGS)) for begun in (False, True)]
            keys = np.stack(asked, axis=1) if len(keep) else np.zeros((0, KEYS), np.uint64)
            long = np.flatnonzero((w.n >= COPY_WORDS) & (how != MARKED))
            ends = w.end(last[long], w.marks[last[long]])[:, None]
            copies = np.concatenate([mix(w.sketches(long, _scale(w.n[long] - SHINGLE)) ^ ends), ends], axis=1)
            count = np.zeros(len(keep), dtype=np.int64)
            count[long] = BANDS + 1
            yield pa.record_batch(
                [
                    batch.column(0), pa.nulls(len(keep), pa.string()), pa.array(how), pa.array(_told_by_prompts(w, tokenised(batch.column(2)))),
                    _lists(keys.reshape(-1), np.full(len(keep), KEYS)), _lists(copies.reshape(-1), count),
                    pc.if_else(pa.array(count > 0), words, pa.scalar([], pa.list_(pa.string()))),
                ],
                ["row_id", "defect", "how", "at_prompt", "keys", "copies", "words"],
            )

    return run


_FACTS = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("words", pa.list_(pa.string()))])
_COUNT, _COPY, _TEXT = 0, 1, 2


def _fact(kind: int, key: np.ndarray, x: np.ndarray, y: np.ndarray, words: pa.Array | None = None) -> pa.RecordBatch:
    m = len(key)
    return pa.record_batch(
        [
            pa.array(np.full(m, kind, np.int32)), pa.array(key.view(np.int64)), pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64)),
            pa.nulls(m, pa.list_(pa.string())) if words is None else words,
        ],
        schema=_FACTS,
    )


def _copies(w: _Words, how: np.ndarray, at: np.ndarray, marks_at_ends: Bitmap, copies_at_ends: Bitmap) -> Iterator[pa.RecordBatch]:
    """Beginnings of texts that may be near-copies of an open end: they lead to the same last words, the last or a beginning of it included, and a sketch agrees.

    ``at`` are the places (among all words) after whose context an open end
    stands. With the last word in the key, texts that only share a phrase make
    no pairs, which would grow with the square of the texts.
    """
    row = w.row[at]
    at = at[(at - w.plain[row] >= COPY_WORDS - 1) & ~((at - w.plain[row] == w.n[row] - 1) & (how[row] != CLOSED))]
    which, marks = w.begun_at(at)
    some = has(marks_at_ends, w.closing(0, w.at[at[which]], marks, False))
    at, marks = at[which[some]], marks[some]
    ends = w.end(w.at[at], marks)
    some = has(copies_at_ends, ends)
    at, ends = at[some], ends[some]
    if not len(at):
        return
    row = w.row[at]
    place = at - w.plain[row]
    last = place == w.n[row] - 1
    # The open end has so many shingles before its last word, give or take what makes it no near-copy.
    own = place - SHINGLE + 1
    scales = np.stack([_scale(np.ceil(own * SIMILARITY).astype(np.int64)), _scale(np.floor(own / SIMILARITY).astype(np.int64))], axis=1)
    pick = np.repeat(np.arange(len(row)), 2)
    scale = scales.reshape(-1)
    keep = (scale <= w.n[row[pick]] - SHINGLE + 1) & ~((np.arange(len(pick)) % 2 == 1) & (scales[pick, 0] == scale))
    pick, scale = pick[keep], scale[keep]
    each, back = np.unique(row[pick] << 32 | scale, return_inverse=True)
    bands = w.sketches(each >> 32, each & 0xFFFFFFFF)[back]
    keys = mix(bands ^ ends[pick][:, None])
    i, b = np.nonzero(has(copies_at_ends, keys.reshape(-1)).reshape(keys.shape))
    if not len(i):
        return
    mark = w.upto(row, place)
    yield _fact(_COPY, keys[i, b], mark[pick[i]].view(np.int64), np.zeros(len(i), np.int64))
    hit = np.unique(pick[i])
    _, first = np.unique(mark[hit] * np.uint64(2) + last[hit], return_index=True)
    hit = hit[first]
    yield _fact(_TEXT, mark[hit], np.where(last[hit], CLOSES, GOES_ON), np.zeros(len(hit)), w.beginnings(row[hit], place[hit]))


def _facts(marks_at_ends: Bitmap, copies_at_ends: Bitmap):
    """Over all texts: how often each context of an open end goes on and closes; beginnings that may be near-copies of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, totals, ends, held = [], [], [], 0

        def merge() -> None:
            nonlocal keys, totals, ends, held
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(back, weights=np.concatenate(totals), minlength=len(key))
            end = np.bincount(back, weights=np.concatenate(ends), minlength=len(key))
            keys, totals, ends, held = [key], [total], [end], len(key)

        for batch in batches:
            how, said = endings(batch.column(0)), tokenised(batch.column(0))
            w = _Words(said)
            last = np.zeros(len(w.marks), dtype=bool)
            last[(w.first + w.n - 1)[w.n > 0]] = True
            last = last[w.at]
            whole = (how == CLOSED) | (how == DOTS)
            counted = np.flatnonzero(~last | whole[w.row])
            at = w.at[counted]
            closes = np.where(last[counted], np.where(how[w.row[counted]] == CLOSED, UNIT, DOTS_UNIT), 0)
            for k in range(LONGER):
                some = (closes != DOTS_UNIT) & w.english[w.row[counted]] if k == WORD else slice(None)
                key = w.context(k, at[some])
                seen = has(marks_at_ends, key)
                if k == TAIL:
                    yield from _copies(w, how, counted[seen], marks_at_ends, copies_at_ends)
                key, end = key[seen], closes[some][seen]
                unique, back = np.unique(key, return_inverse=True)
                keys.append(unique)
                totals.append(UNIT * np.bincount(back, minlength=len(unique)).astype(float))
                ends.append(np.bincount(back, weights=end, minlength=len(unique)))
                held += len(unique)
            for word_at, mark in w.begun:
                key = w.longer(mark)
                seen = has(marks_at_ends, key)
                keys.append(key[seen])
                totals.append(UNIT * w.counts[word_at[seen]].astype(float))
                ends.append(np.zeros(int(seen.sum())))
                held += int(seen.sum())
            for key in w.closings(np.flatnonzero((how == CLOSED) & (w.n > 0))):
                unique, count = np.unique(key[has(marks_at_ends, key)], return_counts=True)
                keys.append(unique)
                totals.append(UNIT * count.astype(float))
                ends.append(np.zeros(len(unique)))
                held += len(unique)
            if held > 3_000_000:
                merge()
                if held > 2_000_000:
                    yield _fact(_COUNT, keys[0], totals[0], ends[0])
                    keys, totals, ends, held = [], [], [], 0
        if keys:
            merge()
            yield _fact(_COUNT, keys[0], totals[0], ends[0])

    return run


def _shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def aligned_end(cut: list[str], other: list[str], how: int) -> str | None:
    """How a text ends, by the beginning of a near-copy that leads to the same place.

    ``how`` tells whether the near-copy goes on after that beginning, closes
    with it, or both (of several). ``early``: the near-copy goes on, after the
    same word; ``inside``: its word is longer; ``same``: it closes there too.
    Null if the two are no near-copies or don't meet there.
    """
    a, b = _shingles(cut[:-1]), _shingles(other[:-1])
    if cut[-4:-1] != other[-4:-1] or len(a & b) < SIMILARITY * min(len(a), len(b)):
        return None
    if cut[-1] == other[-1]:
        return "same" if how & CLOSES else "early"
    return "inside" if other[-1].startswith(cut[-1]) else None


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [aligned_end(cut, other, how) for cut, other, how in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))]
        ends = pa.array(found, pa.string())
        some = ends.is_valid()
        yield pa.record_batch([batch.column(0).filter(some), ends.filter(some)], ["row_id", "aligned"])


def judged_rows(rows: DataFrame, key: str, text: str, prompt: str | None = None, defects: Callable[[], Defects] | None = None) -> DataFrame:
    """``(row_id, reason, defect)``: as ``truncated_rows``, and rows that have another defect by ``defects``, which aren't judged further.

    ``defects`` is made once per task; of a batch's texts, prompts and words it gives the name of each row's defect or None.
    """
    said = rows.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("said"), (F.col(prompt) if prompt else F.lit(None).cast("string")).alias("asked"))
    open_ends = stage((said if defects else said.where("said is not null")).mapInArrow(_open_ends(defects), _OPEN_SCHEMA), "open_ends")
    judged = open_ends.where((F.col("how") != MARKED) & F.col("defect").isNull())
    n = judged.count()
    marks = lambda b: [b.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1)]
    contexts, copies = collect(judged.select("keys", "copies").coalesce(1 + n // ROWS_A_BITMAP), marks, [bits_for(KEYS * n), bits_for((BANDS + 1) * n)])
    facts = stage(
        said.where("said is not null").select("said").mapInArrow(_facts(contexts, copies), "kind int, key bigint, x bigint, y bigint, words array<string>"), "facts"
    )
    counts = facts.where(F.col("kind") == _COUNT).groupBy("key").agg((F.sum("x") / UNIT).alias("total"), (F.sum("y") / UNIT).alias("ends"))
    # Staged by themselves, so that the shuffles of one are gone before the next.
    asked = stage(judged.select("row_id", F.posexplode("keys").alias("k", "key")).join(counts, "key").drop("key"), "asked")
    aligned = _aligned(judged, facts)
    discard(facts)
    ends = asked.select("row_id", "k", "total", "ends", F.lit(None).cast("int").alias("aligned")).unionByName(
        aligned.select("row_id", F.lit(-1).alias("k"), F.lit(0.0).alias("total"), F.lit(0.0).alias("ends"), "aligned")
    ).unionByName(
        judged.select("row_id", F.lit(-2).alias("k"), F.col("at_prompt").cast("double").alias("total"), F.lit(0.0).alias("ends"), F.lit(None).cast("int").alias("aligned"))
    )
    each = ends.groupBy("row_id").agg(
        *(F.max(F.when(F.col("k") == k, F.col("total"))).alias(f"t{k}") for k in range(KEYS)),
        *(F.max(F.when(F.col("k") == k, F.col("ends"))).alias(f"e{k}") for k in range(LONGER)),
        F.max(F.when(F.col("k") == -2, F.col("total"))).cast("int").alias("at_prompt"), F.max("aligned").alias("aligned"),
    )
    by_words = each.withColumn("terminality", _terminality()).select("row_id", _reason().alias("reason")).where("reason is not null")
    told = open_ends.where((F.col("how") == MARKED) | F.col("defect").isNotNull()).select("row_id", F.when(F.col("defect").isNull(), "mark").alias("reason"), "defect")
    return told.unionByName(by_words.withColumn("defect", F.lit(None).cast("string")))


def truncated_rows(rows: DataFrame, key: str, text: str, prompt: str | None = None) -> DataFrame:
    """``(key, reason)`` of the rows whose ``text`` is cut; ``reason`` is ``mark``, ``copy``, ``word`` or ``closing``.

    A text with closing punctuation is whole; one that ends in the traces of a
    cut (a broken character, escape or entity, an open bracket, a comma) is
    cut. Any other is compared with near-copies. A cut text is the beginning of
    its copy, so sketches are made of the first 1, 2, 4, 8, ... five-word
    shingles; beginnings with which an open end shares a min-hash band of
    such a sketch, and the three words before the last, are verified (0.8 or
    more of the shingles of the shorter are in the other) and aligned there: if
    one closes at the same word, the text is whole; if its word is longer, or
    it goes on while texts don't often close there, the text is cut.
    Unmatched texts are judged by their closing word: one is cut if it is no
    word of the collection but begins one (of ``prompt`` first), if it begins
    words far more frequent and closed texts don't close with it there but with
    what it begins, or if the words before it, or else itself, practically never stand at the close of a
    text in the whole collection. A text that ends as its prompt does is whole,
    and one in another language than English is judged by marks only. Null
    and empty texts, and open ones of fewer than three words, are not cut.

    The contexts and sketches of open ends are known to the workers as bitmaps
    that grow with them, so that only what can match one is counted and moved.
    """
    return judged_rows(rows, key, text, prompt).select(F.col("row_id").alias(key), "reason")


_ALIGNED = ("early", "inside", "same")  # the greater decides


def _marks(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)]


def _bitmap(marks: DataFrame) -> Bitmap:
    n = marks.count()
    return collect(marks.coalesce(1 + n // ROWS_A_BITMAP), _marks, [bits_for(n)])[0]


def _only(known: Bitmap):
    """Rows whose first column is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has(known, *_marks(batch))))

    return run


def _with_copies(given: Bitmap):
    """Open texts with a key that is given, and their keys that are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies = batch.column(1)
            flat = copies.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            hit = has(given, flat)
            count = np.bincount(np.repeat(np.arange(len(copies)), np.diff(copies.offsets.to_numpy())), weights=hit, minlength=len(copies)).astype(np.int64)
            rows = np.flatnonzero(count)
            some = pa.array(rows)
            yield pa.record_batch([batch.column(0).take(some), _lists(flat[hit], count[rows]), batch.column(2).take(some)], ["row_id", "keys", "words"])

    return run


def _aligned(judged: DataFrame, facts: DataFrame) -> DataFrame:
    """What near-copies tell of open texts: ``(row_id, aligned)``, the latter as its place in ``_ALIGNED``.

    Only open texts with a key that a beginning has too, and beginnings that are in a pair, are moved, by bitmaps of these.
    """
    given = facts.where(F.col("kind") == _COPY).select("key", F.col("x").alias("other"))
    near = stage(
        judged.where(F.size("copies") > 0).select("row_id", "copies", "words").mapInArrow(_with_copies(_bitmap(given.select("key"))), "row_id bigint, keys array<bigint>, words array<string>"),
        "near",
    )
    pairs = stage(near.select("row_id", F.explode("keys").alias("key")).join(given.distinct(), "key").select("row_id", "other").distinct(), "pairs")
    wanted = _bitmap(pairs.select("other"))
    texts = facts.where(F.col("kind") == _TEXT).select(F.col("key").alias("other"), "x", "words").mapInArrow(_only(wanted), "other bigint, x bigint, words array<string>")
    texts = texts.groupBy("other").agg(F.bit_or("x").cast("int").alias("how"), F.first("words").alias("said"))
    slices = 1 + pairs.count() // PAIRS_AT_ONCE
    aligned = None
    for k in range(slices):  # one after the other, so that one slice's shuffles are on disk at a time
        own = F.pmod(F.xxhash64("row_id"), F.lit(slices)) == k
        words = near.where(own).select("row_id", "words")
        found = pairs.where(own).join(texts, "other").join(words, "row_id").select("row_id", "words", "said", "how").mapInArrow(_compare, "row_id bigint, aligned string")
        part = stage(found.select("row_id", (F.array_position(F.lit(list(_ALIGNED)), F.col("aligned")) - 1).cast("int").alias("aligned")), "aligned")
        aligned = part if aligned is None else aligned.unionByName(part)
    discard(near)
    discard(pairs)
    return aligned


def _terminality() -> Column:
    """How likely a text closes after these words: from the closing word to its longest context, each drawn towards the one before."""
    t = F.lit(PRIOR)
    for k in reversed(range(LONGER)):
        n, e = F.coalesce(F.col(f"t{k}"), F.lit(0)), F.coalesce(F.col(f"e{k}"), F.lit(0))
        t = (e + PULL * t) / (n + PULL)
    return t


def _reason() -> Column:
    flags = F.col("at_prompt")
    count = lambda k: F.coalesce(F.col(f"t{k}"), F.lit(0))
    own, closes, longer = count(WORD), F.coalesce(f"e{WORD}", F.lit(0)), count(LONGER)
    # Whether closed texts show that the word stands at a close: after the same two words, else after the same one, else anywhere.
    stands = closes * RATHER > own
    for c in reversed(range(len(CLOSINGS))):
        same, begun = count(LONGER + 1 + 2 * c), count(LONGER + 2 + 2 * c)
        stands = F.when(same + begun > 0, same * RATHER > begun).otherwise(stands)
    begins = (flags.bitwiseAND(_IN_PROMPT) == 0) & (
        ((own == 0) & ((longer > 0) | (flags.bitwiseAND(_BEGINS_PROMPT) > 0)))
        | (~stands & ((longer >= RATHER * own) | (flags.bitwiseAND(_BEGINS_PROMPT) > 0)))
    )
    never = closes + NEVER_PRIOR < NEVER_SHARE * own
    goes_on = (F.col("aligned") == _ALIGNED.index("early")) & (F.col("terminality") < OFTEN)
    return (
        F.when(F.col("aligned") == _ALIGNED.index("same"), None)
        .when(flags.bitwiseAND(_AS_PROMPT) > 0, None)
        .when((F.col("aligned") == _ALIGNED.index("inside")) | goes_on, "copy")
        .when(begins, "word")
        .when(never | (F.col("terminality") < TERMINAL), "closing")
    )


def truncation_rates(rows: DataFrame, key: str, text: str, source: str, prompt: str | None = None) -> DataFrame:
    """Per source the number of rows, of cut rows, and their share; null sources are one group."""
    cut = truncated_rows(rows, key, text, prompt).select(key).distinct().withColumn("cut", F.lit(1))
    return (
        rows.select(key, source).join(cut, key, "left").groupBy(source)
        .agg(F.count("*").alias("n_rows"), F.count("cut").alias("n_cut"))
        .withColumn("share_cut", F.round(F.col("n_cut") / F.col("n_rows"), 6))
    )
