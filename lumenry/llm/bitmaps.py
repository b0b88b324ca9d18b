"""Sets of 64-bit marks as bitmaps of bounded size, made over the cluster."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenry.stage import discard, shared_file, shuffles_freed, stage

PIECE_BYTES = 4096  # of a bitmap that travel in one row
SLICE_BITS = 24  # of a large bitmap that are made at once
MARKS_HELD = 2_000_000
LEAST_BITS, MOST_BITS = 18, 34
HELD_BITS = 26  # a larger bitmap isn't sent to the tasks but lies in a file that they map
MARKS_AT_ONCE = 1 << 14
WORD_BITS = 6  # all bits of a mark are in one word of 64, so that it takes one look
PROBES = ((0x9E3779B97F4A7C15, 58), (0x9E3779B97F4A7C15, 52), (0xC2B2AE3D27D4EB4F, 58), (0xC2B2AE3D27D4EB4F, 52))  # of each mark, four bits


class Bitmap:
    """The words of a bitmap: held, or in a file that is mapped where it is read."""

    def __init__(self, words: np.ndarray | None = None, path: str = "", everywhere: bool = True):
        self.held, self.path, self.everywhere = words, path, everywhere

    def words(self) -> np.ndarray:
        if self.held is None:
            self.held = np.memmap(self.path if self.everywhere else SparkFiles.get(self.path), dtype=np.uint64, mode="r")
        return self.held

    def __getstate__(self) -> dict:
        return self.__dict__ | ({"held": None} if self.path else {})


def bits_for(n: int) -> int:
    """Size, as a power of two, of a bitmap for ``n`` marks: one in some hundreds of others looks like one, up to ``2 ** MOST_BITS`` bits."""
    return min(MOST_BITS, max(LEAST_BITS, (max(1, n) - 1).bit_length() + 4))


def _places(marks: np.ndarray, n: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The word of each mark among ``n``, by the bits behind the first ``skip``, and its bits there."""
    bits = np.zeros(len(marks), dtype=np.uint64)
    for times, shift in PROBES:
        bits |= np.uint64(1) << (marks * np.uint64(times) >> np.uint64(shift) & np.uint64(63))
    return (marks << np.uint64(skip) >> np.uint64(65 - n.bit_length())).astype(np.int64), bits


def has(bitmap: Bitmap, marks: np.ndarray) -> np.ndarray:
    """Whether all bits of each mark are set."""
    words, out = bitmap.words(), np.empty(len(marks), dtype=bool)
    for i in range(0, len(marks), MARKS_AT_ONCE):
        at, bits = _places(marks[i : i + MARKS_AT_ONCE], len(words))
        out[i : i + MARKS_AT_ONCE] = words[at] & bits == bits
    return out


def build(marks: np.ndarray, words: np.ndarray, skip: int = 0) -> None:
    """Sets the bits of marks; ``words`` are one of ``2 ** skip`` equal slices of a bitmap, in which all of them lie."""
    at, bits = _places(marks, len(words), skip)
    while len(at):  # of marks of one word the last is set
        words[at] |= bits
        left = words[at] & bits != bits
        at, bits = at[left], bits[left]


def _marks_by_slice(marks_of: Callable[[pa.RecordBatch], list[np.ndarray]], bits: list[int]):
    """The distinct marks of some millions, by the slice of the bitmap they lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in bits]

        def take(i: int) -> pa.RecordBatch:
            marks = np.unique(np.concatenate(held[i]))
            held[i] = []
            part = marks >> np.uint64(64 - max(0, bits[i] - SLICE_BITS)) if bits[i] > SLICE_BITS else np.zeros(len(marks), np.uint64)
            some, first = np.unique(part, return_index=True)
            ends = [*first[1:], len(marks)]
            return pa.record_batch(
                [pa.array(np.full(len(some), i, np.int32)), pa.array(some.astype(np.int32)), pa.array([marks[x:y].tobytes() for x, y in zip(first, ends)], pa.binary())],
                ["which", "slice", "bits"],
            )

        for batch in batches:
            for i, marks in enumerate(marks_of(batch)):
                held[i].append(marks)
                if sum(map(len, held[i])) > MARKS_HELD:
                    yield take(i)
        for i in range(len(bits)):
            if held[i]:
                yield take(i)

    return run


def _slice(bits: list[int]):
    """The words of one slice, of all its marks."""

    def run(table: pa.Table) -> pa.Table:
        which = table.column("which")[0].as_py()
        own = min(SLICE_BITS, bits[which])
        words = np.zeros(1 << (own - WORD_BITS), dtype=np.uint64)
        for marks in table.column("bits").to_pylist():
            build(np.frombuffer(marks, dtype=np.uint64), words, bits[which] - own)
        return pa.table({"which": table.column("which")[:1], "slice": table.column("slice")[:1], "bits": pa.array([words.tobytes()], pa.binary())})

    return run


def collect(rows: DataFrame, marks_of: Callable[[pa.RecordBatch], list[np.ndarray]], bits: list[int]) -> list[Bitmap]:
    """A bitmap (Bloom filter) of ``2 ** b`` bits for each b of ``bits``, of the marks that ``marks_of`` gives for each batch.

    Small bitmaps are made by every task; each piece's union is an
    aggregation, made in part before the shuffle and piece after piece behind
    it, and the driver gets them once. Of large ones the marks move, and every
    slice is made by itself; the driver writes slice after slice to a file,
    which the tasks map. So no memory grows with a large bitmap. Another mark of the same
    bits can't be told apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(1 << (b - WORD_BITS), dtype=np.uint64) for b in bits]
        for batch in batches:
            for own, marks in zip(seen, marks_of(batch)):
                build(marks, own)
        for i, own in enumerate(seen):
            pieces = own.reshape(-1, PIECE_BYTES // 8)
            some = np.flatnonzero(pieces.any(axis=1)).astype(np.int32)
            yield pa.record_batch(
                [pa.array(np.full(len(some), i, np.int32)), pa.array(some), pa.array([pieces[c].tobytes() for c in some], pa.binary())],
                ["which", "piece", "bits"],
            )

    spark = rows.sparkSession
    if max(bits) <= HELD_BITS:
        out = [np.zeros((1 << b) // 8, dtype=np.uint8) for b in bits]
        with shuffles_freed(spark):
            pieces = rows.mapInArrow(run, "which int, piece int, bits binary").groupBy("which", "piece").agg(F.bitmap_or_agg("bits").alias("bits"))
            for r in pieces.collect():
                out[r["which"]][r["piece"] * PIECE_BYTES :][:PIECE_BYTES] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        return [Bitmap(o.view(np.uint64)) for o in out]
    schema = "which int, slice int, bits binary"
    slices = stage(rows.mapInArrow(_marks_by_slice(marks_of, bits), schema).groupBy("which", "slice").applyInArrow(_slice(bits), schema), "slices")
    files = [shared_file(spark, "bitmap") for _ in bits]
    for f, b in zip(files, bits):
        with open(f.path, "wb") as to:
            to.truncate((1 << b) // 8)
    for r in slices.toLocalIterator():
        with open(files[r["which"]].path, "r+b") as to:
            to.seek(r["slice"] * len(r["bits"]))
            to.write(r["bits"])
    discard(slices)
    return [Bitmap(path=f.publish(spark), everywhere=f.everywhere) for f in files]
