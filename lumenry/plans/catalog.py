"""Queries of the caption pipeline and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenry.functions import arrays
from lumenry.functions.style import style_label
from lumenry.functions.text import capitalise, preview, tokenize
from lumenry.operators import bleu, vocabulary
from lumenry.operators import captions as ops
from lumenry.sources.readers import listing, missing_to_null, strip_index, union_runs
from lumenry.stage import stage

Query = Callable[[SparkSession, str], DataFrame]
STYLED = "flickr8k_emotional_captions"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def first_caption(spark, folder):
    return ops.first_captions(_table(spark, folder, "raw_captions")).select("image_id", "caption")


def caption_layout_strip(spark, folder):
    raw = _table(spark, folder, "raw_captions")
    return raw.select("row_id", strip_index(F.col("image_id")).alias("image_id"), missing_to_null(F.col("caption")).alias("caption"))


def image_path_exists(spark, folder):
    files = _table(spark, folder, STYLED).where(F.col("img_path").isNotNull()).select(F.col("img_path").alias("path"))
    located = ops.with_existing_images(ops.first_captions(_table(spark, folder, "raw_captions")), files, "Images")
    return located.select("image_id", "img_path")


def tokenize_docs(spark, folder):
    words = _table(spark, folder, "documents").select("doc_id", tokenize(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.array_join("w", " ").alias("tokens_joined"))


def word_freq(spark, folder):
    return vocabulary.word_frequency(_table(spark, folder, STYLED), "emotion_caption")


def _vocabulary(spark, folder):
    return vocabulary.fit(_table(spark, folder, STYLED), "emotion_caption", "row_id")


def vocab_build(spark, folder):
    return _vocabulary(spark, folder)


def encode_captions(spark, folder):
    words = stage(_vocabulary(spark, folder), "vocabulary")
    ids = vocabulary.encode(_table(spark, folder, "train"), "emotion_caption", words, ["row_id"])
    return ids.select("row_id", F.array_join(F.col("token_ids").cast("array<string>"), " ").alias("ids_joined"))


def decode_ids(spark, folder):
    words = stage(_vocabulary(spark, folder), "vocabulary")
    ids = vocabulary.encode(_table(spark, folder, "train"), "emotion_caption", words, ["row_id"])
    return vocabulary.decode(ids, "token_ids", words, ["row_id"], "drop")


def _split(name: str) -> Query:
    def query(spark, folder):
        rows = _table(spark, folder, STYLED).select("row_id", "image_id")
        return ops.take_split(rows, ops.split_ids(rows, "image_id"), "image_id", name).select("image_id", "row_id")

    return query


def split_counts(spark, folder):
    rows = _table(spark, folder, STYLED).select("row_id", "image_id")
    return ops.counts_by(rows.join(ops.split_ids(rows, "image_id"), "image_id"), "split")


def style_distribution(spark, folder):
    """Rows of each style, the most first."""
    return ops.counts_by(_table(spark, folder, "train"), "emotion").orderBy(F.desc("n"), "emotion")


def style_cross_product(spark, folder):
    return ops.style_grid(ops.first_captions(_table(spark, folder, "raw_captions")), _table(spark, folder, "styles")).select(
        "image_id", "emotion", "emotion_id", "prompt"
    )


def resume_pending(spark, folder):
    grid = ops.style_grid(ops.first_captions(_table(spark, folder, "raw_captions")), _table(spark, folder, "styles"))
    done = _table(spark, folder, STYLED).where(F.col("emotion_caption").isNotNull()).select("image_id", "emotion")
    return ops.pending(grid, done).select("image_id", "emotion")


def repaired_styles(spark, folder):
    return _table(spark, folder, STYLED).select("row_id", style_label(F.col("emotion"), F.col("emotion_id")).alias("style"))


def sample_fixed(spark, folder):
    return ops.fixed_sample(_table(spark, folder, "test"), "image_id", 5, 1)


def nth_unique(spark, folder):
    return ops.nth_unique(_table(spark, folder, "test"), "image_id", "row_id", 5)


def _pairs(spark, folder):
    """Two plain stand-ins for models: the neutral caption, and the wanted caption without its last words."""
    rows = _table(spark, folder, "test").select("emotion", "neutral_caption", "emotion_caption")
    ref = tokenize(F.coalesce("emotion_caption", F.lit("nan")))
    cut = F.slice(ref, F.lit(1), F.greatest(F.lit(0), F.size(ref) - 4))
    neutral = F.coalesce(tokenize(F.col("neutral_caption")), F.array().cast("array<string>"))
    models = F.array(
        F.struct(F.lit(0).alias("model_ord"), F.lit("neutral").alias("model"), neutral.alias("hyp")),
        F.struct(F.lit(1).alias("model_ord"), F.lit("shortened").alias("model"), cut.alias("hyp")),
    )
    return rows.select("emotion", ref.alias("ref"), F.explode(models).alias("m")).select("emotion", "ref", "m.*")


def _counts(spark, folder):
    return bleu.row_counts(_pairs(spark, folder))


def ngram_stats(spark, folder):
    sums = bleu.summed(_counts(spark, folder), "model")
    each = F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"m{n}").alias("matches"), F.col(f"t{n}").alias("total")) for n in range(1, 5)))
    return sums.select("model", F.explode(each).alias("x")).select("model", "x.*")


def bleu_overall(spark, folder):
    return bleu.overall(_counts(spark, folder), "model")


def bleu_by_style(spark, folder):
    return bleu.by_style(_counts(spark, folder), "model")


def ablation_best(spark, folder):
    return bleu.best_model(bleu.overall(_counts(spark, folder), "model", "model_ord")).select("model", "bleu_4")


def survey(spark, folder):
    test = _table(spark, folder, "test").where(F.col("image_id").isNotNull())
    firsts = ops.first_per_key(test, "image_id", "row_id", ["neutral_caption"])
    chosen = firsts.join(F.broadcast(ops.fixed_sample(test, "image_id", 5, 1)), "image_id", "left_semi")
    grid = chosen.crossJoin(F.broadcast(_table(spark, folder, "styles")))
    return grid.select(
        "image_id", "emotion", F.concat(F.lit("["), "emotion", F.lit("] "), F.col("neutral_caption")).alias("caption"),
        F.format_string(ops.QUESTION, "emotion").alias("question"),
    )


def _vector(spark, folder, vec_id, name):
    return _table(spark, folder, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias(name))


def interpolate_vectors(spark, folder):
    ends = _vector(spark, folder, 0, "a").crossJoin(_vector(spark, folder, 1, "b"))
    each = ends.select("a", "b", F.posexplode(arrays.steps(7)).alias("step", "t"))
    alpha = F.bround("t", 2)
    first, second = arrays.percent_labels(alpha)
    return each.select(
        "step", alpha.alias("alpha"),
        F.concat(first.cast("string"), F.lit("% joyful + "), second.cast("string"), F.lit("% sad")).alias("label"),
        F.round(arrays.vsum(arrays.interpolate(F.col("a"), F.col("b"), F.col("t"))), 6).alias("checksum"),
    )


def vector_facts(spark, folder):
    v = F.col("embedding")
    return _table(spark, folder, "embeddings").select(
        "vec_id", F.round(arrays.mean(v), 6).alias("feature_mean"), F.round(arrays.norm(v), 6).alias("norm"),
        F.round(arrays.vsum(arrays.min_max(v)), 4).alias("min_max_sum"), arrays.argmax(v).cast("long").alias("argmax"),
    )


def attention_context(spark, folder):
    """Each vector's last eight numbers attend to its own 49 runs of eight, its cells: the weights and the context they give."""
    v = F.col("embedding")
    cells = F.transform(F.sequence(F.lit(1), F.lit(49)), lambda i: F.slice(v, i, F.lit(8)))
    asked = _table(spark, folder, "embeddings").select("vec_id", cells.alias("cells"), F.slice(v, 57, 8).alias("query"))
    weighed = asked.withColumn("weights", arrays.softmax(F.transform("cells", lambda c: arrays.dot(c, F.col("query")))))
    return weighed.select(
        "vec_id", F.round(arrays.vsum(F.col("weights")), 6).alias("weights_sum"), F.round(F.array_max("weights"), 6).alias("weights_max"),
        F.round(arrays.vsum(arrays.weighted_cells(F.col("cells"), F.col("weights"))), 6).alias("context_sum"),
    )


def cell_means(spark, folder):
    """The mean of each vector's 49 cells."""
    cells = F.transform(F.sequence(F.lit(1), F.lit(49)), lambda i: F.slice(F.col("embedding"), i, F.lit(8)))
    means = _table(spark, folder, "embeddings").select("vec_id", arrays.cells_mean(cells).alias("m"))
    return means.select("vec_id", F.posexplode("m").alias("place", "mean")).select("vec_id", "place", F.round("mean", 6).alias("mean"))


def shifted_ids(spark, folder):
    """What a model is given of each caption of ``train``, and what it is to answer."""
    words = stage(_vocabulary(spark, folder), "vocabulary")
    ids = vocabulary.encode(_table(spark, folder, "train"), "emotion_caption", words, ["row_id"])
    given, wanted = arrays.shifted(F.col("token_ids"))
    joined = lambda c: F.array_join(c.cast("array<string>"), " ")
    return ids.select("row_id", joined(given).alias("given"), joined(wanted).alias("wanted"))


def union_splits(spark, folder):
    """All rows of the three splits under one another."""
    wanted = ("row_id", "image_id", "emotion_id")
    return union_runs([_table(spark, folder, name).select(*wanted) for name in ("train", "val", "test")])


def style_names(spark, folder):
    """The map of styles to ids, the other way round."""
    styles = _table(spark, folder, "styles").agg(F.map_from_entries(F.collect_list(F.struct("emotion", "emotion_id"))).alias("m"))
    return styles.select(F.explode(vocabulary.inverted(F.col("m"))).alias("emotion_id", "emotion")).select("emotion_id", capitalise(F.col("emotion")).alias("name"))


def sample_grid(spark, folder):
    """Five rows of ``train`` to look at: picture, style and how the caption begins."""
    train = _table(spark, folder, "train")
    chosen = ops.fixed_sample(train, "row_id", 5, 0)
    shown = train.join(F.broadcast(chosen), "row_id", "left_semi")
    return shown.select("row_id", "img_path", "emotion", preview(F.col("emotion_caption")).alias("title"))


def _history(spark, folder):
    events = _table(spark, folder, "events")
    by_day = events.groupBy("event_type", F.dayofmonth("ts").alias("epoch")).agg(
        F.round(F.avg("value"), 6).alias("val_loss"), F.count("*").alias("n_rows")
    )
    return by_day.select(F.col("event_type").alias("model"), "epoch", "val_loss", "n_rows")


def epoch_running_best(spark, folder):
    return ops.running_best(_history(spark, folder)).select("model", "epoch", "val_loss", "best_before", "improved")


def loss_curves(spark, folder):
    """Two losses of each model by epoch, one under the other, as they are plotted."""
    events = _table(spark, folder, "events")
    series = F.when(F.col("event_id") % 2 == 0, "train_loss").otherwise("val_loss")
    return events.groupBy(F.col("event_type").alias("model"), F.dayofmonth("ts").alias("epoch"), series.alias("series")).agg(F.round(F.avg("value"), 6).alias("loss"))


def weighted_loss(spark, folder):
    return _history(spark, folder).groupBy("model").agg(F.round(ops.weighted_mean("val_loss", "n_rows"), 6).alias("loss"))


def batch_counts(spark, folder):
    n = _table(spark, folder, "train").agg(F.count("*").alias("n_rows"))
    return n.select("n_rows", ops.n_batches(F.col("n_rows")).cast("long").alias("n_batches"))


def listing_sizes(spark, folder):
    return listing(spark, folder)


def queries() -> dict[str, Query]:
    from lumenry.plans import modelling

    named = (
        first_caption, caption_layout_strip, image_path_exists, tokenize_docs, word_freq, vocab_build, encode_captions, decode_ids,
        split_counts, style_distribution, style_cross_product, resume_pending, repaired_styles, sample_fixed, nth_unique, ngram_stats,
        bleu_overall, bleu_by_style, ablation_best, survey, interpolate_vectors, vector_facts, attention_context, epoch_running_best,
        weighted_loss, batch_counts, listing_sizes, cell_means, shifted_ids, union_splits, style_names, sample_grid, loss_curves,
    )
    return {f.__name__: f for f in named} | {f"split_{s}": _split(s) for s in ("train", "val", "test")} | modelling.queries()


WORDS = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9\s'']', '', 'g'), '\s+'), lambda x: x <> '')"
MISSING = "({0} IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'))"

FIRST = f"""
    clean AS (SELECT row_id, split_part(image_id, '#', 1) AS image_id,
        CASE WHEN {MISSING.format('caption')} THEN NULL ELSE caption END AS caption FROM raw_captions),
    firsts AS (SELECT image_id, row_id, caption FROM (
        SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY row_id) AS k FROM clean) WHERE k = 1 AND caption IS NOT NULL)"""
VOCABULARY = f"""
    said AS (SELECT row_id, {WORDS.format('emotion_caption')} AS w FROM {STYLED} WHERE emotion_caption IS NOT NULL),
    placed AS (SELECT row_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM said),
    counted AS (SELECT word, count(*) AS freq, min((row_id, pos)) AS first FROM placed GROUP BY word HAVING count(*) >= 2),
    vocabulary AS (SELECT word, CAST(row_number() OVER (ORDER BY first) + 3 AS INTEGER) AS id, freq FROM counted)"""
ENCODED = f"""
    {VOCABULARY},
    texts AS (SELECT row_id, {WORDS.format('emotion_caption')} AS w FROM train WHERE emotion_caption IS NOT NULL),
    parts AS (SELECT row_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM texts),
    numbered AS (SELECT p.row_id, list(coalesce(v.id, 3) ORDER BY pos) AS ids FROM parts p LEFT JOIN vocabulary v ON v.word = p.word GROUP BY p.row_id),
    encoded AS (SELECT t.row_id, list_concat(list_concat([1], coalesce(n.ids, [])), list_concat([2], list_transform(generate_series(1, 40), lambda x: 0)))[1:40] AS ids
        FROM texts t LEFT JOIN numbered n USING (row_id))"""
SPLITS = f"""
    names AS (SELECT DISTINCT image_id FROM {STYLED} WHERE image_id IS NOT NULL),
    ranked AS (SELECT image_id, row_number() OVER (ORDER BY md5('42:' || image_id), image_id) AS r, count(*) OVER () AS n FROM names),
    ids AS (SELECT image_id, CASE WHEN r <= ceil(ceil(n * 0.2) / 2) THEN 'test' WHEN r <= ceil(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM ranked)"""


CELLS = "list_transform(generate_series(1, 49), lambda i: embedding[i:i + 7])"


def _gram(n: int, col: str) -> str:
    return f"CASE WHEN len({col}) >= {n} THEN list_transform(generate_series(1, len({col}) - {n - 1}), lambda i: array_to_string({col}[i:i + {n - 1}], ' ')) ELSE [] END"


COUNTS = f"""
    refs AS (SELECT emotion, {WORDS.format("coalesce(emotion_caption, 'nan')")} AS ref, coalesce({WORDS.format('neutral_caption')}, []) AS neutral FROM test),
    pairs AS (SELECT emotion, ref, 0 AS model_ord, 'neutral' AS model, neutral AS hyp FROM refs
        UNION ALL SELECT emotion, ref, 1, 'shortened', ref[1:greatest(0, len(ref) - 4)] FROM refs),
    grams AS (SELECT *, {", ".join(f"{_gram(n, 'hyp')} AS h{n}, {_gram(n, 'ref')} AS r{n}" for n in range(1, 5))} FROM pairs),
    counts AS (SELECT model, model_ord, emotion, len(hyp) AS hl, len(ref) AS rl,
        {", ".join(f"coalesce(list_sum(list_transform(list_distinct(h{n}), lambda g: least(len(list_filter(h{n}, lambda x: x = g)), len(list_filter(r{n}, lambda y: y = g))))), 0) AS m{n}, len(h{n}) AS t{n}" for n in range(1, 5))}
        FROM grams)"""
SUMS = "CAST(sum(hl) AS DOUBLE) AS hl, CAST(sum(rl) AS DOUBLE) AS rl, " + ", ".join(f"CAST(sum(m{n}) AS BIGINT) AS m{n}, CAST(sum(t{n}) AS BIGINT) AS t{n}" for n in range(1, 5))


def _score(n: int) -> str:
    terms, zeros = [], "0"
    for order, weight in enumerate(bleu.WEIGHTS[n], 1):
        zeros += f" + CASE WHEN m{order} = 0 THEN 1 ELSE 0 END"
        if weight:
            terms.append(
                f"{weight} * ln(CASE WHEN m{order} = 0 THEN 1.0 / (pow(2.0, {zeros}) * 5.0 / ln(hl)) ELSE m{order} END / greatest(1, t{order}))"
            )
    return (
        f"round_even(CASE WHEN m1 = 0 THEN 0.0 ELSE 100 * (CASE WHEN hl > rl THEN 1.0 ELSE exp(1 - rl / hl) END) * exp({' + '.join(terms)}) END, 2)"
    )


HISTORY = """history AS (SELECT event_type AS model, CAST(day(ts) AS INTEGER) AS epoch, round(avg(value), 6) AS val_loss, count(*) AS n_rows
    FROM events GROUP BY event_type, day(ts))"""


def oracle_sql() -> dict[str, str]:
    from lumenry.plans import modelling

    style_text = "regexp_replace(lower(emotion), '[^a-z]', '', 'g')"
    styles = ("joyful", "sad", "tense", "romantic", "humorous")
    by_id = "CASE emotion_id " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(styles)) + " END"
    exact = f"CASE WHEN {style_text} IN ({', '.join(repr(s) for s in styles)}) THEN {style_text} END"
    fits = "CASE " + " ".join(
        f"WHEN (length({style_text}) >= 3 AND starts_with('{s}', {style_text})) OR levenshtein({style_text}, '{s}') <= {1 if len(s) < 4 else 2} THEN '{s}'"
        for s in styles
    ) + " END"
    instruction = ops.INSTRUCTION.replace("'", "''").split("%s")
    vec = "list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))"
    return modelling.oracle_sql() | {
        "first_caption": f"WITH {FIRST} SELECT image_id, caption FROM firsts",
        "caption_layout_strip": f"SELECT row_id, split_part(image_id, '#', 1) AS image_id, CASE WHEN {MISSING.format('caption')} THEN NULL ELSE caption END AS caption FROM raw_captions",
        "image_path_exists": f"WITH {FIRST} SELECT image_id, concat_ws('/', 'Images', image_id) AS img_path FROM firsts WHERE concat_ws('/', 'Images', image_id) IN (SELECT img_path FROM {STYLED} WHERE img_path IS NOT NULL)",
        "tokenize_docs": f"SELECT doc_id, len(w) AS n_tokens, array_to_string(w, ' ') AS tokens_joined FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)",
        "word_freq": f"SELECT word, count(*) AS freq FROM (SELECT unnest({WORDS.format('emotion_caption')}) AS word FROM {STYLED} WHERE emotion_caption IS NOT NULL) GROUP BY word",
        "vocab_build": f"WITH {VOCABULARY} SELECT word, id, freq FROM vocabulary",
        "encode_captions": f"WITH {ENCODED} SELECT row_id, array_to_string(ids, ' ') AS ids_joined FROM encoded",
        "decode_ids": f"""WITH {ENCODED},
            cut AS (SELECT row_id, CASE WHEN list_position(ids, 2) > 0 THEN ids[2:list_position(ids, 2) - 1] ELSE ids[2:] END AS ids FROM encoded),
            each AS (SELECT row_id, unnest(ids) AS id, unnest(generate_series(1, len(ids))) AS pos FROM cut),
            spoken AS (SELECT e.row_id, string_agg(coalesce(v.word, '<UNK>'), ' ' ORDER BY pos) AS caption FROM each e LEFT JOIN vocabulary v USING (id) GROUP BY e.row_id)
            SELECT row_id, coalesce(caption, '') AS caption FROM cut LEFT JOIN spoken USING (row_id)""",
        **{f"split_{s}": f"WITH {SPLITS} SELECT image_id, row_id FROM {STYLED} JOIN ids USING (image_id) WHERE split = '{s}'" for s in ("train", "val", "test")},
        "split_counts": f"WITH {SPLITS} SELECT split, count(*) AS n FROM {STYLED} JOIN ids USING (image_id) GROUP BY split",
        "style_distribution": "SELECT emotion, count(*) AS n FROM train GROUP BY emotion ORDER BY n DESC, emotion",
        "style_cross_product": f"WITH {FIRST} SELECT image_id, emotion, emotion_id, '<|system|>' || chr(10) || '{instruction[0]}' || emotion || '{instruction[1]}' || chr(10) || '<|user|>' || chr(10) || caption || chr(10) || '<|assistant|>' || chr(10) AS prompt FROM firsts, styles",
        "resume_pending": f"WITH {FIRST} SELECT image_id, emotion FROM firsts f, styles s WHERE NOT EXISTS (SELECT 1 FROM {STYLED} d WHERE d.image_id = f.image_id AND d.emotion = s.emotion AND d.emotion_caption IS NOT NULL)",
        "repaired_styles": f"SELECT row_id, coalesce({by_id}, {exact}, {fits}) AS style FROM {STYLED}",
        "sample_fixed": "SELECT image_id FROM (SELECT DISTINCT image_id FROM test WHERE image_id IS NOT NULL) ORDER BY md5('1:' || image_id), image_id LIMIT 5",
        "nth_unique": "SELECT image_id, first_row FROM (SELECT image_id, min(row_id) AS first_row FROM test WHERE image_id IS NOT NULL GROUP BY image_id) ORDER BY first_row LIMIT 1 OFFSET 5",
        "ngram_stats": f"WITH {COUNTS}, sums AS (SELECT model, {SUMS} FROM counts GROUP BY model) " + " UNION ALL ".join(f"SELECT model, {n} AS n, m{n} AS matches, t{n} AS total FROM sums" for n in range(1, 5)),
        "bleu_overall": f"WITH {COUNTS}, sums AS (SELECT model, {SUMS} FROM counts GROUP BY model) SELECT model, {', '.join(f'{_score(n)} AS bleu_{n}' for n in range(1, 5))} FROM sums",
        "bleu_by_style": f"WITH {COUNTS}, sums AS (SELECT model, emotion, {SUMS} FROM counts GROUP BY model, emotion) SELECT model, emotion, {_score(4)} AS bleu_4 FROM sums",
        "ablation_best": f"WITH {COUNTS}, sums AS (SELECT model, model_ord, {SUMS} FROM counts GROUP BY model, model_ord), scores AS (SELECT model, model_ord, {_score(4)} AS bleu_4 FROM sums) SELECT model, bleu_4 FROM scores ORDER BY bleu_4 DESC, model_ord LIMIT 1",
        "survey": """WITH firsts AS (SELECT image_id, neutral_caption FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY row_id) AS k FROM test WHERE image_id IS NOT NULL) WHERE k = 1),
            chosen AS (SELECT image_id FROM (SELECT DISTINCT image_id FROM test WHERE image_id IS NOT NULL) ORDER BY md5('1:' || image_id), image_id LIMIT 5)
            SELECT image_id, emotion, '[' || emotion || '] ' || neutral_caption AS caption,
                'Does this caption feel ' || emotion || '? (1=Not at all, 5=Very much)' AS question
            FROM firsts JOIN chosen USING (image_id), styles""",
        "interpolate_vectors": """WITH a AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), b AS (SELECT embedding AS w FROM embeddings WHERE vec_id = 1),
            t AS (SELECT unnest(generate_series(0, 6)) AS step), s AS (SELECT step, step / 6.0::DOUBLE AS x, round_even(step / 6.0::DOUBLE, 2) AS alpha FROM t)
            SELECT CAST(step AS INTEGER) AS step, alpha, CAST(trunc((1 - alpha) * 100) AS INTEGER) || '% joyful + ' || CAST(trunc(alpha * 100) AS INTEGER) || '% sad' AS label,
                round(list_sum(list_transform(generate_series(1, len(v)), lambda i: (1 - x) * CAST(v[i] AS DOUBLE) + x * CAST(w[i] AS DOUBLE))), 6) AS checksum FROM s, a, b""",
        "vector_facts": f"""SELECT vec_id, round({vec} / len(embedding), 6) AS feature_mean,
            round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm,
            round(list_sum(list_transform(embedding, lambda x: (CAST(x AS DOUBLE) - CAST(list_min(embedding) AS DOUBLE)) / (CAST(list_max(embedding) AS DOUBLE) - CAST(list_min(embedding) AS DOUBLE) + 1e-8))), 4) AS min_max_sum,
            CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS argmax FROM embeddings""",
        "attention_context": f"""WITH cells AS (SELECT vec_id, {CELLS} AS cells, embedding[57:64] AS q FROM embeddings),
            each AS (SELECT vec_id, q, unnest(cells) AS e FROM cells),
            scores AS (SELECT vec_id, e, exp(list_sum(list_transform(generate_series(1, 8), lambda i: CAST(e[i] AS DOUBLE) * CAST(q[i] AS DOUBLE)))) AS s FROM each),
            weights AS (SELECT vec_id, e, s / sum(s) OVER (PARTITION BY vec_id) AS w FROM scores)
            SELECT vec_id, round(sum(w), 6) AS weights_sum, round(max(w), 6) AS weights_max,
                round(sum(w * list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE)))), 6) AS context_sum FROM weights GROUP BY vec_id""",
        "cell_means": f"""WITH each AS (SELECT vec_id, unnest({CELLS}) AS e FROM embeddings),
            numbers AS (SELECT vec_id, unnest(e) AS x, unnest(generate_series(0, 7)) AS place FROM each)
            SELECT vec_id, CAST(place AS INTEGER) AS place, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM numbers GROUP BY vec_id, place""",
        "shifted_ids": f"WITH {ENCODED} SELECT row_id, array_to_string(ids[1:39], ' ') AS given, array_to_string(ids[2:40], ' ') AS wanted FROM encoded",
        "union_splits": " UNION ALL ".join(f"SELECT row_id, image_id, emotion_id FROM {t}" for t in ("train", "val", "test")),
        "style_names": "SELECT emotion_id, upper(left(emotion, 1)) || lower(substr(emotion, 2)) AS name FROM styles",
        "sample_grid": "SELECT row_id, img_path, emotion, left(emotion_caption, 60) || '...' AS title FROM train ORDER BY md5('0:' || row_id), row_id LIMIT 5",
        "loss_curves": """SELECT event_type AS model, CAST(day(ts) AS INTEGER) AS epoch, CASE WHEN event_id % 2 = 0 THEN 'train_loss' ELSE 'val_loss' END AS series,
            round(avg(value), 6) AS loss FROM events GROUP BY ALL""",
        "epoch_running_best": f"""WITH {HISTORY}, seen AS (SELECT *, min(val_loss) OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM history)
            SELECT model, epoch, val_loss, best_before, best_before IS NULL OR val_loss < best_before AS improved FROM seen""",
        "weighted_loss": f"WITH {HISTORY} SELECT model, round(sum(val_loss * n_rows) / sum(n_rows), 6) AS loss FROM history GROUP BY model",
        "batch_counts": "SELECT count(*) AS n_rows, CAST(ceil(count(*) / 32.0) AS BIGINT) AS n_batches FROM train",
    }
