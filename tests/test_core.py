"""The caption pipeline's operators against plain Python."""

import collections
import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenry import schemas
from lumenry.config import RunConfig
from lumenry.functions import arrays
from lumenry.functions.style import STYLES, style_label
from lumenry.functions.text import photo_key, tokenize
from lumenry.models import decoders, gradients, images, inference, training
from lumenry.operators import bleu, vocabulary
from lumenry.operators import captions as ops
from lumenry.plans import modelling
from lumenry.sources import readers, writers


def tok(text):
    return re.sub(r"[^a-z0-9\s']", "", text.lower().strip()).split()


def test_tokenize(spark):
    texts = ["T-shirt 2's!", "café", "", "  ", "?!", "a b c", "Hello,  World", None, "x\ny\tz"]
    got = [r.w for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tokenize(F.col("t")).alias("w")).orderBy("i").collect()]
    assert got == [None if t is None else tok(t) for t in texts]


def test_photo_key(spark):
    df = spark.createDataFrame([("a/1234567890_0123456789.jpg",), ("1234567890abcdef0123",), ("x",), (None,)], "n string")
    assert [r[0] for r in df.select(photo_key(F.col("n"))).collect()] == ["1234567890_0123456789", "1234567890_abcdef0123", None, None]


def test_style_label(spark):
    raw = ["joyful", " Sad.", "HUMOROUS", "tensee", "rom", "xx", "", None, "humoruos"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string").orderBy("i").select(style_label(F.col("t"))).collect()]
    assert got == ["joyful", "sad", "humorous", "tense", "romantic", None, None, None, "humorous"]


# Sources


def test_three_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text('image,caption\na.jpg,"He said ""hi"", then\nleft"\na.jpg,second\nb.jpg,NA\nc.jpg,\n')
    (tmp_path / "b.csv").write_text("image_id,caption\na.jpg,one\n")
    (tmp_path / "c.txt").write_text('a.jpg#0\tfirst "quoted"\na.jpg#1\tsecond\nb.jpg\tthird\n')
    a = [(r.image_id, r.caption) for r in readers.read_captions(spark, str(tmp_path / "a.csv")).orderBy("row_id").collect()]
    assert a == [("a.jpg", 'He said "hi", then\nleft'), ("a.jpg", "second"), ("b.jpg", None), ("c.jpg", None)]
    assert [r.caption for r in readers.read_captions(spark, str(tmp_path / "b.csv")).collect()] == ["one"]
    c = [(r.image_id, r.caption) for r in readers.read_captions(spark, str(tmp_path / "c.txt")).orderBy("row_id").collect()]
    assert c == [("a.jpg", 'first "quoted"'), ("a.jpg", "second"), ("b.jpg", "third")]
    assert readers.find_captions(spark, str(tmp_path)).endswith("c.txt")
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        readers.find_captions(spark, str(tmp_path / "none"))


def test_first_caption_wins_even_if_missing(spark):
    rows = [(1, "a", None), (2, "a", "good"), (3, "b#0", "x"), (4, "b#1", "y"), (5, None, "n1"), (6, None, "n2"), (7, "c", "NA"), (8, "d", "")]
    df = spark.createDataFrame(rows, "row_id long, image_id string, caption string")
    assert {(r.image_id, r.caption) for r in ops.first_captions(df).collect()} == {("b", "x"), (None, "n1")}


def test_files_and_csv_round_trip(spark, tmp_path):
    (tmp_path / "Images").mkdir()
    (tmp_path / "Images" / "a.jpg").write_bytes(b"12345")
    folder = readers.image_folder(spark, str(tmp_path))
    assert folder.endswith("/Images") and readers.image_folder(spark, folder) == folder
    files = readers.list_files(spark, folder).select(F.regexp_replace("path", "^file:", "").alias("path"))
    caps = spark.createDataFrame([("a.jpg", "x"), ("b.jpg", "y")], "image_id string, caption string")
    assert [r.image_id for r in ops.with_existing_images(caps, files, folder).collect()] == ["a.jpg"]
    assert [(r.name, r["size"]) for r in readers.listing(spark, folder, 10).collect()] == [("a.jpg", 0.5)]
    styled = spark.createDataFrame([("a", "p", 'n "q"\nz', "sad", 1, "e,f"), ("b", None, None, "joyful", 0, None)], schemas.STYLED)
    writers.write_csv(styled, str(tmp_path / "out"))
    back = readers.read_styled(spark, str(tmp_path / "out")).drop("row_id")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, styled.collect()))


def test_config_round_trip(spark, tmp_path):
    config = RunConfig("p", "i", 10)
    config.save(spark, str(tmp_path / "c.json"))
    assert RunConfig.load(spark, str(tmp_path / "c.json")) == config and config.emotion_to_id["humorous"] == 4 and config.n_emotions == 5


# Vocabulary


def brute_vocabulary(texts, least=2):
    counts = collections.Counter()
    for t in texts:
        counts.update(tok(t or ""))
    return {w: i + 4 for i, w in enumerate([w for w, n in counts.items() if n >= least])}


TEXTS = ["the dog runs", "a dog sits", None, "", "the cat's hat", "hat " * 60, "once", "the the dog ?"]


def test_vocabulary_follows_first_occurrence(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "row_id long, t string").repartition(3)
    got = {r.word: r.id for r in vocabulary.fit(df, "t", "row_id").collect()}
    assert got == brute_vocabulary(TEXTS)
    assert [r.word for r in vocabulary.with_reserved(vocabulary.fit(df, "t", "row_id")).orderBy("id").limit(4).collect()] == list(vocabulary.RESERVED)
    assert vocabulary.fit(df.limit(0), "t", "row_id").collect() == []


@pytest.mark.parametrize("held", [1_000_000, 0])
def test_encode_and_decode(spark, held):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "row_id long, t string")
    words = vocabulary.fit(df, "t", "row_id")
    known = brute_vocabulary(TEXTS)
    ids = vocabulary.encode(df, "t", words, ["row_id"], held_words=held)
    got = {r.row_id: r.token_ids for r in ids.collect()}
    assert set(got) == {i for i, t in enumerate(TEXTS) if t is not None}
    for i, row in got.items():
        wanted = ([1] + [known.get(w, 3) for w in tok(TEXTS[i])] + [2])[:40]
        assert row == wanted + [0] * (40 - len(wanted))
    asked = spark.createDataFrame([(1, [1, 4, 3, 5, 2, 6]), (2, [1, 4, 0, 5]), (3, [4, 9999, 5]), (4, []), (5, [1] + [4] * 39)], "k int, ids array<int>")
    back = {v: k for k, v in known.items()}
    for mode, odd in (("mark", f"{back[4]} <UNK> {back[5]}"), ("drop", f"{back[4]} {back[5]}")):
        said = {r.k: r.caption for r in vocabulary.decode(asked, "ids", words, ["k"], mode, held_words=held).collect()}
        assert said == {1: f"{back[4]} <UNK> {back[5]}", 2: back[4], 3: odd, 4: "", 5: " ".join([back[4]] * 39)}


# Splits, samples, resume


def test_splits_are_exact_and_whole(spark):
    df = spark.createDataFrame([(f"img{i % 103}", i) for i in range(500)] + [(None, 999)], "image_id string, row_id long")
    ids = {r.image_id: r.split for r in ops.split_ids(df, "image_id").collect()}
    sizes = collections.Counter(ids.values())
    assert sizes == {"test": 11, "val": 10, "train": 82} and len(ids) == 103
    assert {r.image_id for r in ops.take_split(df, ops.split_ids(df.repartition(5), "image_id"), "image_id", "val").collect()} == {k for k, v in ids.items() if v == "val"}


def test_sample_and_nth(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 4), (None, 0)], "k string, row_id long")
    assert len(ops.fixed_sample(df, "k", 2, 7).collect()) == 2 and len(ops.fixed_sample(df, "k", 9, 7).collect()) == 3
    assert [ops.nth_unique(df, "k", "row_id", i).first().k for i in range(3)] == ["b", "a", "c"]


def test_resume_is_idempotent(spark, tmp_path):
    caps = spark.createDataFrame([("a", "A dog."), ("b", ""), ("c", "A cat")], "image_id string, caption string")
    grid = ops.style_grid(caps, schemas.style_table(spark))
    assert grid.count() == 15 and "sound sad" in grid.where("emotion = 'sad'").first().prompt
    done = spark.createDataFrame([("a", "sad")], "image_id string, emotion string")
    made = inference.rewrite(ops.pending(grid, done), inference.stub_rewriter, ["image_id", "emotion"])
    assert made.where("ok").count() == 9 and {r.image_id for r in made.where("not ok").collect()} == {"b"}
    assert ops.pending(grid, grid.select("image_id", "emotion")).count() == 0


def test_streaming_append(spark, tmp_path):
    from lumenry.streaming.append import append_styles

    source = str(tmp_path / "in")
    out = str(tmp_path / "out")
    spark.createDataFrame([("a", "A dog."), ("b", "A cat.")], schemas.CAPTION).write.parquet(source)
    for check in ("c1", "c2"):
        arriving = spark.readStream.schema(schemas.CAPTION).parquet(source)
        append_styles(arriving, schemas.style_table(spark), out, str(tmp_path / check), inference.stub_rewriter).awaitTermination()
        assert spark.read.parquet(out).count() == 10


# BLEU


def brute_bleu(pairs, n):
    grams = lambda w, k: collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    hyp, ref = sum(len(h) for h, _ in pairs), sum(len(r) for _, r in pairs)
    match = [sum(sum((grams(h, k) & grams(r, k)).values()) for h, r in pairs) for k in range(1, 5)]
    total = [max(1, sum(max(0, len(h) - k + 1) for h, _ in pairs)) for k in range(1, 5)]
    if match[0] == 0:
        return 0.0
    zeros, s = 0, 0.0
    for k in range(4):
        m = match[k]
        if m == 0:
            zeros += 1
            m = 1 / (2**zeros * 5 / math.log(hyp))
        s += bleu.WEIGHTS[n][k] * math.log(m / total[k])
    return 100 * (1 if hyp > ref else math.exp(1 - ref / hyp)) * math.exp(s)


@pytest.mark.parametrize(
    "pairs",
    [
        [("a b c d e", "a b c d e")], [("a b", "a b c d")], [("x y z", "a b c")], [("a a a a", "a b a c")], [("", "a b"), ("a b c", "a b d e f")],
        [("the the cat sat on mat", "the cat sat on the mat"), ("dogs run", "dogs run fast")],
    ],
)
def test_bleu(spark, pairs):
    rows = [("m", "sad", h.split(), r.split()) for h, r in pairs]
    counts = bleu.row_counts(spark.createDataFrame(rows, "model string, emotion string, hyp array<string>, ref array<string>"))
    got = bleu.overall(counts, "model").first()
    plain = [(h.split(), r.split()) for h, r in pairs]
    for n in range(1, 5):
        assert got[f"bleu_{n}"] == pytest.approx(brute_bleu(plain, n), abs=0.0051)
    assert bleu.by_style(counts, "model").first().bleu_4 == got.bleu_4


def test_best_model_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("b", 1, 2.0), ("a", 0, 2.0), ("c", 2, 1.0)], "model string, model_ord int, bleu_4 double")
    assert bleu.best_model(df).first().model == "a"


# History


def test_history(spark):
    losses = [3.0, 2.0, 2.0, 1.5, 1.9]
    df = spark.createDataFrame([("m", i, x) for i, x in enumerate(losses)], "model string, epoch int, val_loss double")
    assert [r.improved for r in ops.running_best(df).orderBy("epoch").collect()] == [True, True, False, True, False]
    assert ops.plateau([1.0] * 6, 0.4) == [0.4, 0.4, 0.4, 0.4, 0.2, 0.2]


# Arrays


def test_arrays(spark):
    v, w = [3.0, -1.0, 2.0, 3.0], [1.0, 1.0, 0.0, 2.0]
    df = spark.createDataFrame([(v, w, [4.0, 4.0], [])], "v array<double>, w array<double>, same array<double>, none array<double>")
    a, b = np.array(v), np.array(w)
    got = df.select(
        arrays.dot(F.col("v"), F.col("w")), arrays.argmax(F.col("v")), arrays.min_max(F.col("v")), arrays.min_max(F.col("same")), arrays.softmax(F.col("v")),
        arrays.layer_norm(F.col("v")), arrays.interpolate(F.col("v"), F.col("w"), F.lit(0.25)), arrays.argmax(F.col("none")), arrays.relu(F.col("v")), arrays.steps(7),
        arrays.grid(F.col("v"), 2),
    ).first()
    e = np.exp(a - 3)
    assert got[0] == a @ b and got[1] == 0 and got[3] == [0, 0] and got[7] is None and got[8] == [3, 0, 2, 3] and got[10] == [[3, -1], [2, 3]]
    assert got[2] == pytest.approx((a + 1) / 4, abs=1e-6) and got[4] == pytest.approx(e / e.sum())
    assert got[5] == pytest.approx((a - a.mean()) / np.sqrt(a.var() + 1e-5)) and got[6] == pytest.approx(0.75 * a + 0.25 * b)
    assert got[9] == pytest.approx(np.linspace(0, 1, 7))
    labels = spark.range(1).select(F.explode(arrays.steps(7)).alias("t")).select(*arrays.percent_labels(F.bround("t", 2))).collect()
    assert [tuple(r) for r in labels] == [(100, 0), (83, 17), (67, 33), (50, 50), (32, 67), (17, 83), (0, 100)]


# Models

SMALL = decoders.Sizes(vocab=12, word=5, style=3, hidden=6, visual=4)


@pytest.mark.parametrize("kind", [*decoders.KINDS, decoders.SPATIAL])
def test_gradients_match_differences(kind):
    weights = decoders.init(kind, SMALL, seed=1)
    rng = np.random.default_rng(2)
    visual = rng.normal(0, 1, (3, 7, 4) if kind == decoders.SPATIAL else (3, 4))
    styles, ids = np.array([0, 2, 4]), np.array([[1, 5, 6, 2, 0], [1, 7, 2, 0, 0], [1, 4, 4, 4, 2]])

    def loss(w):
        return float(decoders.loss(kind, {k: gradients.Value(v) for k, v in w.items()}, visual, styles, ids).data)

    _, grads = training.gradients(kind, weights, visual, styles, ids, clip=1e9)
    for name, w in weights.items():
        at = tuple(rng.integers(0, n) for n in w.shape)
        if name == "word" and at[0] == 0:
            continue
        up, down = ({**weights, name: w.copy()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert grads[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6)


def test_parameter_counts():
    v = 100
    wanted = {"Baseline": 2_626_048, "Emotion@Start": 2_659_136, "Emotion@Every": 2_790_208}
    for kind, n in wanted.items():
        # One bias per gate here, where the usual library keeps two.
        assert decoders.parameter_count(decoders.init(kind, decoders.Sizes(v))) == n + 769 * v - 2048


@pytest.mark.parametrize("kind", decoders.KINDS)
def test_generation_does_not_depend_on_the_batch(spark, kind):
    weights = decoders.init(kind, SMALL, seed=3)
    rng = np.random.default_rng(4)
    visual, styles = rng.normal(0, 1, (9, 4)), rng.integers(0, 5, 9)
    alone = [decoders.generate(kind, weights, visual[i : i + 1], styles[i : i + 1])[0].tolist() for i in range(9)]
    rows = spark.createDataFrame([(i, visual[i].tolist(), int(styles[i])) for i in range(9)], "k int, feature array<double>, emotion_id int")
    got = {r.k: r.token_ids for r in inference.generate_ids(rows.repartition(2), kind, weights, ["k"]).collect()}
    cut = lambda ids: ids[: ids.index(2)] if 2 in ids else [i for i in ids if i]
    assert {k: cut(v) for k, v in got.items()} == {i: cut(x) for i, x in enumerate(alone)}
    if kind == "Baseline":
        assert (decoders.generate(kind, weights, visual, styles) == decoders.generate(kind, weights, visual, styles[::-1])).all()


def test_interpolation_ends_are_the_styles(spark):
    weights = decoders.init("Emotion@Every", SMALL, seed=5)
    rows = spark.createDataFrame([(1, [0.5, -1.0, 2.0, 0.1])], "k int, feature array<double>")
    got = inference.interpolate_ids(rows, weights, "k", 0, 1).orderBy("step").collect()
    visual = np.array([[0.5, -1.0, 2.0, 0.1]])
    for row, style in ((got[0], 0), (got[-1], 1)):
        assert row.token_ids == decoders.generate("Emotion@Every", weights, visual, np.array([style]))[0].tolist()
    assert [r.alpha for r in got] == [0.0, 0.17, 0.33, 0.5, 0.67, 0.83, 1.0]
    with pytest.raises(ValueError):
        inference.interpolate_ids(rows, decoders.init("Emotion@Start", SMALL), "k", 0, 1)


def test_attention_sums_to_one(spark):
    weights = decoders.init(decoders.SPATIAL, SMALL, seed=6)
    cells = np.random.default_rng(7).normal(0, 1, (49, 4)).tolist()
    rows = spark.createDataFrame([(1, cells, 2)], "k int, cells array<array<double>>, emotion_id int")
    got = inference.attention_trace(rows, weights, "k", max_words=8).orderBy("pos").collect()
    assert 1 <= len(got) <= 8 and all(len(r.weights) == 49 and sum(r.weights) == pytest.approx(1) for r in got)


def test_models_speak_the_whole_vocabulary(spark, tmp_path):
    said = " ".join(f"w{i}" for i in range(2500))
    spark.createDataFrame([(1, said), (2, said)], "row_id long, emotion_caption string").write.parquet(str(tmp_path / "train.parquet"))
    words = modelling._words(spark, str(tmp_path))
    assert words.count() == 2500 and modelling._sizes(words).vocab == 2504
    assert modelling._sizes(words.where("false")).vocab == 4


def test_registered_trace_goes_on_past_eight_words(spark, tmp_path):
    said = " ".join(f"w{i}" for i in range(300))
    spark.createDataFrame([(1, said), (2, said)], "row_id long, emotion_caption string").write.parquet(str(tmp_path / "train.parquet"))
    vectors = [(i, np.random.default_rng(i).normal(size=64).tolist()) for i in range(4)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([("joyful", 0)], "emotion string, emotion_id int").write.parquet(str(tmp_path / "styles.parquet"))
    assert modelling.attention_trace(spark, str(tmp_path)).agg(F.max("pos")).first()[0] > 7
    assert modelling.attention_maps(spark, str(tmp_path)).agg(F.max("pos")).first()[0] == 7


def test_training_learns(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(64):
        style = i % 5
        rows.append((rng.normal(0, 1, 4).tolist(), style, [1, 4 + style, 9, 2] + [0] * 4))
    df = spark.createDataFrame(rows, "feature array<double>, emotion_id int, token_ids array<int>").repartition(2)
    path = str(tmp_path / "best")
    best, history = training.train(df, df, "Emotion@Every", decoders.init("Emotion@Every", SMALL, seed=9), "m", epochs=8, lr=0.2, path=path)
    losses = [r.val_loss for r in history.orderBy("epoch").collect()]
    assert min(losses) < 0.6 * losses[0]
    assert training.evaluate(df, "Emotion@Every", training.load(spark, path)) == pytest.approx(min(losses))
    assert training.evaluate(df, "Emotion@Every", best, by="words") == pytest.approx(min(losses), rel=0.05)


@pytest.mark.parametrize("kind", [*decoders.KINDS, decoders.SPATIAL])
def test_decoding_scores_as_training_does(kind):
    weights = decoders.init(kind, SMALL, seed=4)
    rng = np.random.default_rng(5)
    visual = rng.normal(0, 1, (4, 7, 4) if kind == decoders.SPATIAL else (4, 4)).astype(np.float32)
    styles = np.array([0, 1, 2, 3])
    held = {k: gradients.Value(v) for k, v in weights.items()}
    style = None if kind == "Baseline" else gradients.take(held["style"], styles)
    run, tokens, wanted = decoders._Run(gradients, kind, held, visual, style), np.full(4, 1), []
    for _ in range(6):
        tokens = run.step(tokens).data.argmax(axis=-1)
        wanted.append(tokens)
    got = decoders.generate(kind, weights, visual, styles, 6)
    alive = np.cumsum(np.stack(wanted, 1)[:, : got.shape[1]] == 2, axis=1) - (np.stack(wanted, 1)[:, : got.shape[1]] == 2) == 0
    assert (got[alive] == np.stack(wanted, 1)[:, : got.shape[1]][alive]).all()


def test_adam_goes_on_over_epochs(spark):
    """Two epochs over one partition are what plain steps in the same order come to."""
    rng = np.random.default_rng(3)
    rows = [(rng.normal(0, 1, 4).tolist(), i % 5, [1, 4 + i % 5, 9, 2, 0, 0]) for i in range(40)]
    df = spark.createDataFrame(rows, "feature array<double>, emotion_id int, token_ids array<int>").coalesce(1)
    first = decoders.init("Emotion@Start", SMALL, seed=1)
    weights, state = first, None
    for seed in (5, 6):
        weights, _, state = training.train_epoch(df, "Emotion@Start", weights, 0.01, state, seed)
    own = {k: v.copy() for k, v in first.items()}
    adam = training.Adam(own, 0.01)
    for seed in (5, 6):
        ordered = df.sortWithinPartitions(F.xxhash64("token_ids", "emotion_id", F.lit(seed))).collect()
        for at in range(0, 40, training.BATCH):
            some = ordered[at : at + training.BATCH]
            visual, ids = np.array([r.feature for r in some], np.float32).astype(float), np.array([r.token_ids for r in some])
            adam.step(own, training.gradients("Emotion@Start", own, visual, np.array([r.emotion_id for r in some]), ids)[1])
    assert state[2] == adam.t == 4
    for k in own:
        assert weights[k] == pytest.approx(own[k]) and state[0][k] == pytest.approx(adam.m[k]) and state[1][k] == pytest.approx(adam.v[k])


def test_sums_of_many_tasks_are_made_in_rounds(spark, monkeypatch):
    rows = [([float(i), 1.0, 0.0, -1.0], i % 5, [1, 4, 5, 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "feature array<double>, emotion_id int, token_ids array<int>").repartition(50)
    weights = decoders.init("Baseline", SMALL, seed=2)
    monkeypatch.setattr(training, "ROUND", 3)
    a = training.train_epoch(df, "Baseline", weights, 0.01)
    monkeypatch.setattr(training, "ROUND", 1000)
    b = training.train_epoch(df, "Baseline", weights, 0.01)
    assert a[1] == pytest.approx(b[1]) and all(a[0][k] == pytest.approx(b[0][k]) for k in weights)


def test_the_attention_model_trains_without_validation(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(rng.normal(0, 1, (49, 4)).tolist(), i % 5, [1, 4 + i % 5, 9, 2]) for i in range(30)]
    df = spark.createDataFrame(rows, "feature array<array<double>>, emotion_id int, token_ids array<int>").repartition(2)
    best, history = training.train(df, None, decoders.SPATIAL, decoders.init(decoders.SPATIAL, SMALL, seed=9), "a", epochs=3, lr=0.1, path=str(tmp_path / "w"))
    found = history.orderBy("epoch").collect()
    assert [r.val_loss for r in found] == [None] * 3 and found[2].train_loss < found[0].train_loss
    again = training.load(spark, str(tmp_path / "w"))
    assert all((again[k] == best[k]).all() for k in best)
    trace = inference.attention_trace(df.select(F.monotonically_increasing_id().alias("k"), F.col("feature").alias("cells"), "emotion_id"), best, "k")
    assert trace.select("k").distinct().count() == 30


def test_dataset_joins_features_ids_and_styles(spark):
    caps = spark.createDataFrame(
        [(1, "a", 0, "the dog"), (2, "a", 1, None), (3, "b", 2, "the cat the"), (4, None, 1, "the dog"), (5, "a", None, "dog")],
        "row_id long, image_id string, emotion_id int, emotion_caption string",
    )
    features = spark.createDataFrame([("a", [1.0, 2.0])], "image_id string, feature array<double>")
    words = vocabulary.fit(caps, "emotion_caption", "row_id")
    found = training.dataset(caps, features, words).collect()
    assert [(r.row_id, r.feature, r.emotion_id, r.token_ids[:4]) for r in found] == [(1, [1.0, 2.0], 0, [1, 4, 5, 2])]


def test_results_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    said = [" ".join(f"w{rng.integers(0, 30)}" for _ in range(rng.integers(0, 9))) for _ in range(90)]
    df = spark.createDataFrame(list(enumerate(said)), "row_id long, t string")
    rows = spark.createDataFrame(
        [(rng.normal(0, 1, 4).tolist(), i % 5, [1, 4 + i % 3, 2, 0]) for i in range(70)], "feature array<double>, emotion_id int, token_ids array<int>"
    )
    weights = decoders.init("Emotion@Every", SMALL, seed=9)
    pairs = spark.createDataFrame([("m", "sad", a.split(), b.split()) for a, b in zip(said, said[1:])], "model string, emotion string, hyp array<string>, ref array<string>")
    seen = set()
    for parts in (1, 7):
        words = {(r.word, r.id, r.freq) for r in vocabulary.fit(df.repartition(parts), "t", "row_id").collect()}
        score = bleu.overall(bleu.row_counts(pairs.repartition(parts)), "model").first()
        seen.add((frozenset(words), tuple(score), round(training.evaluate(rows.repartition(parts), "Emotion@Every", weights, by="words"), 9)))
    assert len(seen) == 1


def test_jpeg_and_png_are_decoded_by_the_jvm(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    for name in ("jpg", "png"):
        picture = jvm.java.awt.image.BufferedImage(40, 30, 1)
        for x in range(40):
            for y in range(30):
                picture.setRGB(x, y, 200 * 65536 + 100 * 256 + 50)
        jvm.javax.imageio.ImageIO.write(picture, name, jvm.java.io.File(str(tmp_path / f"a.{name}")))
    (tmp_path / "bad.jpg").write_bytes(b"nothing")
    found = readers.read_decoded_images(spark, str(tmp_path)).collect()
    assert len(found) == 2
    for r in found:
        decoded = images.from_pixels(bytes(r.pixels), r.height, r.width, r.channels)
        assert decoded.shape == (30, 40, 3) and np.abs(decoded.astype(int) - [200, 100, 50]).max() <= 3
    features = images.encode_images(readers.read_decoded_images(spark, str(tmp_path)), lambda: images.grid_encoder(8)).collect()
    assert len(features) == 2 and features[0].feature == pytest.approx(features[1].feature, abs=0.1)


def test_ablation_table_is_written_with_its_models(spark, tmp_path):
    rows = [(m, i, "sad", ["a", "b", "c", "d", "e"][: 5 - i], ["a", "b", "c", "d", "e"]) for i, m in enumerate(decoders.KINDS)]
    counts = bleu.row_counts(spark.createDataFrame(rows, "model string, model_ord int, emotion string, hyp array<string>, ref array<string>"))
    table = bleu.overall(counts, "model", "model_ord")
    writers.write_csv(table.orderBy("model_ord"), str(tmp_path / "ablation"))
    back = spark.read.csv(str(tmp_path / "ablation"), header=True)
    assert back.columns == ["model", "model_ord", "bleu_1", "bleu_2", "bleu_3", "bleu_4"] and {r.model for r in back.collect()} == set(decoders.KINDS)
    assert bleu.best_model(table).first().model == "Baseline"
    writers.write_table(table, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 4


def test_stages_need_a_shared_folder_on_a_cluster(spark):
    from lumenry import stage

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        stage.checkpoint_dir(Session())
    kept = stage.stage(spark.range(5), "numbers")
    assert kept.count() == 5
    stage.clear_stages()
    assert not stage._written


def test_images(spark, tmp_path):
    flat = np.full((5, 9, 3), 128, np.uint8)
    raw = b"P6\n# made here\n9 5\n255\n" + flat.tobytes()
    assert (images.decode_ppm(raw) == flat).all()
    tensor = images.to_tensor(flat)
    assert tensor.shape == (3, 224, 224) and tensor[0, 0, 0] == pytest.approx((128 / 255 - 0.485) / 0.229, abs=1e-6)
    (tmp_path / "good.ppm").write_bytes(raw)
    (tmp_path / "bad.ppm").write_bytes(b"nothing")
    found = images.encode_images(readers.read_images(spark, str(tmp_path)), lambda: images.grid_encoder(8)).collect()
    assert len(found) == 1 and len(found[0].feature) == 8
    cells = images.encode_images(readers.read_images(spark, str(tmp_path)), lambda: images.grid_encoder(8), spatial=True).first().feature
    assert len(cells) == 49 and np.mean(cells, axis=0) == pytest.approx(found[0].feature, abs=1e-5)
    big = images.attention_overlay(np.arange(49.0))
    assert big.shape == (224, 224) and big.min() == 0 and big.max() == pytest.approx(1)
    assert (images.attention_overlay(np.ones(49)) == 0).all()


# Queries


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert STYLES[4] == "humorous"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["attention_context", "cell_means", "shifted_ids", "union_splits", "style_names", "sample_grid", "loss_curves", "style_distribution", "vocab_build", "decode_ids", "styled_rewrites"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for file in os.listdir(folder):
        db.execute(f"create view {file.removesuffix('.parquet')} as select * from '{folder}/{file}'")
    found = entry.queries()[name](spark, folder)
    wanted = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    plain = lambda rows: sorted(repr([round(x, 5) if isinstance(x, float) else x for x in r]) for r in rows)
    assert plain(found.select(*columns).collect()) == plain(wanted.fetchall())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_model_queries(spark):
    folder = "/root/testdata/sf0.001"
    summary = modelling.final_summary(spark, folder).collect()
    assert len(summary) == 4 and {r.best_bleu_4 for r in summary} == {max(r.bleu_4 for r in summary)}
    best = summary[0].best_model
    assert {r.model for r in modelling.gallery(spark, folder).collect()} == {best}
    assert modelling.model_survey(spark, folder).count() == 25
    assert {r.model for r in modelling.best_model_by_style(spark, folder).collect()} == {best}
    demo = modelling.attention_demo(spark, folder).collect()
    assert len({r.image_id for r in demo}) == 1 and {r.emotion_id for r in demo} == {0, 1, 2} and len(demo[0].overlay) == 224
    history = modelling.train_history(spark, folder).collect()
    assert len(history) == 1 and history[0].val_loss > 0
