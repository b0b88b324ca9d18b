"""Bitmaps of marks: held ones, and large ones in files."""

import random

import numpy as np
import pytest

from lumenry import stage
from lumenry.llm import bitmaps, near_equal, pairs, truncation


def marks(n, seed):
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)


def test_a_bitmap_grows_with_its_marks():
    for n in (1, 10_000, 150_000_000, 700_000_000):
        assert 1 << bitmaps.bits_for(n) >= 16 * n


@pytest.mark.parametrize("held", [26, 17])
def test_all_marks_are_there_and_few_others(spark, monkeypatch, held):
    monkeypatch.setattr(bitmaps, "HELD_BITS", held)
    monkeypatch.setattr(bitmaps, "SLICE_BITS", 16)
    monkeypatch.setattr(bitmaps, "MARKS_HELD", 5_000)
    one, two = marks(20_000, 1), marks(500, 2)
    rows = spark.createDataFrame([(m.item(), 0) for m in one.view(np.int64)] + [(m.item(), 1) for m in two.view(np.int64)], "mark bigint, side int").repartition(3)

    def by_side(batch):
        own, side = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)
        return [own[side == 0], own[side == 1]]

    found = bitmaps.collect(rows, by_side, [bitmaps.bits_for(len(one)), bitmaps.bits_for(len(two))])
    assert bitmaps.has(found[0], one).all() and bitmaps.has(found[1], two).all()
    others = marks(100_000, 3) + np.uint64(1)
    assert bitmaps.has(found[0], others).mean() < 0.02 and bitmaps.has(found[1], others).mean() < 0.02
    stage.clear_stages()


def test_bitmaps_in_files_change_no_result(spark, monkeypatch):
    rng = random.Random(3)
    nouns = ["dog", "harbour", "sailor", "bicycle", "mountain", "violin"]
    rows = []
    for i in range(300):
        text = f"a {rng.choice(nouns)} and a {rng.choice(nouns)} wait beside the {rng.choice(nouns)} near the {rng.choice(nouns)} today."
        rows.append((i, text[: rng.randint(20, len(text))] if i % 3 == 0 else text, "a prompt of a scene"))
    df = spark.createDataFrame(rows, "row_id bigint, said string, asked string")
    both = lambda: (
        sorted(tuple(r) for r in truncation.truncated_rows(df, "row_id", "said", "asked").collect()),
        sorted(tuple(r) for r in pairs.broken_pairs(df, "row_id", "asked", "said").collect()),
    )
    held = both()
    assert held[0]
    monkeypatch.setattr(bitmaps, "HELD_BITS", 17)
    assert both() == held
    stage.clear_stages()


def test_sliced_entries_give_the_same_links(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(40)]
    texts = [set(rng.sample(words, 9)) for _ in range(60)]
    texts += [t - {min(t)} | {rng.choice(words)} for t in texts]
    rows = [(i, " ".join(sorted(t)), 1 + (i >= 60)) for i, t in enumerate(texts)]
    sets = spark.createDataFrame(rows, "id bigint, text string, side int").dropDuplicates(["text"])
    wanted = {
        (a, b) for a, s, x in sets.collect() for b, t, y in sets.collect()
        if x < y and 10 * len({*s.split()} & {*t.split()}) >= 7 * len({*s.split()} | {*t.split()})
    }
    made = []
    monkeypatch.setattr(near_equal, "SLICE_ENTRIES", 50)
    monkeypatch.setattr(near_equal, "stage", lambda df, name: made.append(name) or stage.stage(df, name))
    entries = near_equal.entries_across(sets, k=4)
    found = {tuple(r) for r in near_equal.near_equal_links(sets, k=4, entries=entries).collect()}
    assert wanted and wanted <= found and made.count("matched") == near_equal.MOST_SLICES
    stage.clear_stages()
