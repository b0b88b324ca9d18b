"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenry.llm import components as comp
from lumenry.llm import leaks, mixture, near_equal, overlap, pairs, templates, terms, truncation
from lumenry.stage import stage

Query = Callable[[SparkSession, str], DataFrame]
CAPTIONS = "flickr8k_emotional_captions"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _cut(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated_rows(_table(spark, folder, CAPTIONS), "row_id", "emotion_caption", "neutral_caption")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cut(spark, folder).select("row_id").distinct()


def p1_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return _cut(spark, folder)


def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_rates(_table(spark, folder, CAPTIONS), "row_id", "emotion_caption", "source", "neutral_caption")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return comp.same_photo_names(_table(spark, folder, CAPTIONS))


def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    return comp.split_captions(_table(spark, folder, CAPTIONS))


def p2_balance(spark: SparkSession, folder: str) -> DataFrame:
    return comp.split_report(spark, _table(spark, folder, CAPTIONS))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = terms.marked_terms(_table(spark, folder, "train"), "emotion_caption")
    return found.where("mark is not null").select("term", "mark")


def p3_terms(spark: SparkSession, folder: str) -> DataFrame:
    return terms.marked_terms(_table(spark, folder, "train"), "emotion_caption")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = near_equal.near_equal_rows(_table(spark, folder, CAPTIONS), "row_id", "neutral_caption", "emotion_caption")
    return found.select(F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_equal.near_equal_groups(_table(spark, folder, CAPTIONS), "row_id", "neutral_caption", "emotion_caption")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.broken_pairs(_table(spark, folder, CAPTIONS), "row_id", "neutral_caption", "emotion_caption")


def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    captions = _table(spark, folder, CAPTIONS)
    found = p5_found(spark, folder)
    return captions.select("row_id", "source").join(found, "row_id", "left").groupBy("source", "defect").agg(F.count("*").alias("n_rows"))


def _splits(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    return _table(spark, folder, "train"), {name: _table(spark, folder, name) for name in ("test", "val")}


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    train, held_out = _splits(spark, folder)
    found = overlap.overlapping_rows(train, list(held_out.values()))
    return found.select(F.least("train_row", "eval_row").alias("row_id_a"), F.greatest("train_row", "eval_row").alias("row_id_b"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_report(*_splits(spark, folder))


def p6_coverage(spark: SparkSession, folder: str) -> DataFrame:
    train, held_out = _splits(spark, folder)
    return overlap.covered_words(train, list(held_out.values()))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaked_passages(_table(spark, folder, "eval_items"), _table(spark, folder, "documents"), "item_id", "doc_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).where("longest_run >= 12").select("item_id", "doc_id")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder)


def _words(spark: SparkSession, folder: str) -> DataFrame:
    return stage(mixture.word_sizes(_table(spark, folder, "documents"), "doc_id", "text"), "sizes")


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes by the tokenizer, which goes over the texts once."""
    return stage(mixture.token_sizes(_table(spark, folder, "documents"), "doc_id", "text"), "sizes")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    report = mixture.mixture_report(_words(spark, folder), _table(spark, folder, "mix_targets"), "doc_id")
    return report.where("failed").select("source")


def p8_plan(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture by words: what each source has and is to have, and how often a document of it is expected."""
    plan = mixture.mixture_plan(_words(spark, folder), _table(spark, folder, "mix_targets"))
    return plan.select("source", "target_share", "max_repeats", "own_size", "n_docs", F.round("wanted_size", 3).alias("wanted_size"), F.round("copies", 6).alias("copies"), "short")


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    sized = _tokens(spark, folder)
    return mixture.systematic_sample(sized, mixture.mixture_plan(sized, _table(spark, folder, "mix_targets")), "doc_id")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    report = mixture.mixture_report(_tokens(spark, folder), _table(spark, folder, "mix_targets"), "doc_id")
    return report.select(
        "source", "target_share", "max_repeats", "own_size", "wanted_size", "reached_size", "n_copies", F.round("reached_share", 6).alias("reached_share"), "short", "failed",
    )


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return templates.template_residue(_table(spark, folder, "documents"), "doc_id", "text").select("doc_id").distinct()


def p9_defects(spark: SparkSession, folder: str) -> DataFrame:
    return templates.template_residue(_table(spark, folder, "documents"), "doc_id", "text")


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found, "p1_reasons": p1_reasons, "p1_rates": p1_rates,
        "p2_found": p2_found, "p2_splits": p2_splits, "p2_balance": p2_balance,
        "p3_found": p3_found, "p3_terms": p3_terms,
        "p4_found": p4_found, "p4_groups": p4_groups,
        "p5_found": p5_found, "p5_rates": p5_rates,
        "p6_found": p6_found, "p6_report": p6_report, "p6_coverage": p6_coverage,
        "p7_found": p7_found, "p7_leaks": p7_leaks,
        "p8_found": p8_found, "p8_plan": p8_plan, "p8_mixture": p8_mixture, "p8_shares": p8_shares,
        "p9_found": p9_found, "p9_defects": p9_defects,
    }


WORDS = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9\s'']', '', 'g'), '\s+'), lambda x: x <> '')"


def _term_sql(columns: str, where: str) -> str:
    return f"""
        WITH rows AS (SELECT row_id, {WORDS.format('emotion_caption')} AS words FROM train WHERE emotion_caption IS NOT NULL),
        said AS (SELECT row_id, unnest(words) AS term FROM rows),
        counted AS (SELECT term, count(*) AS occurrences, count(DISTINCT row_id) AS records FROM said GROUP BY term),
        marked AS (SELECT term, occurrences, records,
            CASE WHEN occurrences < 2 THEN 'rare' WHEN records > 0.25 * (SELECT count(*) FROM rows) THEN 'common' END AS mark
            FROM counted)
        SELECT {columns} FROM marked {where}"""


NEAR = """17 * len(list_intersect({0}, {1})) >= 7 * (len({0}) + len({1}))"""

# Distinct pairs of texts of the captions table, each with its least row, and links between near-equal ones.
CLASSES = f"""
    texts AS (
        SELECT row_id, list_sort(list_distinct({WORDS.format('neutral_caption')})) AS n, list_sort(list_distinct({WORDS.format('emotion_caption')})) AS e
        FROM {CAPTIONS} WHERE neutral_caption IS NOT NULL AND emotion_caption IS NOT NULL),
    long AS (SELECT * FROM texts WHERE len(n) >= 5 AND len(e) >= 5),
    heads AS (SELECT n, e, min(row_id) AS head FROM long GROUP BY n, e),
    firsts AS (SELECT DISTINCT n FROM long),
    linked AS (SELECT a.n AS n_a, b.n AS n_b FROM firsts a, firsts b WHERE {NEAR.format('a.n', 'b.n')}),
    head_links AS (SELECT x.head AS a, y.head AS b FROM linked l JOIN heads x ON x.n = l.n_a JOIN heads y ON y.n = l.n_b AND x.head < y.head WHERE {NEAR.format('x.e', 'y.e')}),
    copies AS (SELECT h.head AS a, l.row_id AS b FROM long l JOIN heads h ON h.n = l.n AND h.e = l.e WHERE h.head <> l.row_id),
    links AS (SELECT * FROM head_links UNION ALL SELECT * FROM copies)"""

SPANS = f"""
    held AS (SELECT 'test' AS split, * FROM test UNION ALL SELECT 'val' AS split, * FROM val),
    runs AS (SELECT DISTINCT w[i:i + 4] AS run FROM (SELECT w, unnest(generate_series(1, len(w) - 4)) AS i
        FROM (SELECT {WORDS.format('emotion_caption')} AS w FROM train WHERE emotion_caption IS NOT NULL))),
    said AS (SELECT row_id, {WORDS.format('emotion_caption')} AS w FROM held WHERE emotion_caption IS NOT NULL),
    windows AS (SELECT row_id, i, w[i:i + 4] AS run FROM (SELECT row_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM said)),
    places AS (SELECT DISTINCT row_id, i + j AS place FROM windows JOIN runs USING (run), (SELECT unnest(generate_series(0, 4)) AS j)),
    coverage AS (SELECT s.row_id, len(s.w) AS n_words, (SELECT count(*) FROM places p WHERE p.row_id = s.row_id) AS covered FROM said s WHERE len(s.w) > 0)"""


def oracle_sql() -> dict[str, str]:
    overlaps = f"""
            a AS (SELECT DISTINCT list_sort(list_distinct({WORDS.format('emotion_caption')})) AS w FROM train WHERE emotion_caption IS NOT NULL),
            b AS (SELECT DISTINCT list_sort(list_distinct({WORDS.format('emotion_caption')})) AS w FROM held WHERE emotion_caption IS NOT NULL),
            near AS (SELECT a.w AS w_a, b.w AS w_b FROM a, b WHERE len(a.w) >= 5 AND len(b.w) >= 5 AND {NEAR.format('a.w', 'b.w')}),
            x AS (SELECT row_id, emotion_id, list_sort(list_distinct({WORDS.format('emotion_caption')})) AS w,
                regexp_extract(lower(image_id), '[0-9]{{10}}[^0-9a-z]+[0-9a-f]{{10}}') AS photo FROM train),
            y AS (SELECT row_id, emotion_id, list_sort(list_distinct({WORDS.format('emotion_caption')})) AS w,
                regexp_extract(lower(image_id), '[0-9]{{10}}[^0-9a-z]+[0-9a-f]{{10}}') AS photo FROM held),
            pairs AS (
                SELECT x.row_id AS train_row, y.row_id AS eval_row, 1 AS near, 0 AS shown FROM near JOIN x ON x.w = w_a JOIN y ON y.w = w_b
                UNION ALL SELECT x.row_id, y.row_id, 0, 1 FROM x JOIN y ON x.photo = y.photo AND x.emotion_id = y.emotion_id WHERE x.photo <> ''),
            found AS (SELECT train_row, eval_row, max(near) AS near, max(shown) AS shown FROM pairs GROUP BY ALL),
            by_row AS (SELECT eval_row, count(*) AS pairs, max(near) AS near, max(shown) AS shown FROM found GROUP BY eval_row)"""
    return {
        "p4_groups": f"""
            WITH RECURSIVE {CLASSES},
            ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
            reach(row_id, least_id) AS (SELECT DISTINCT a, a FROM ways UNION SELECT w.b, r.least_id FROM reach r JOIN ways w ON w.a = r.row_id WHERE r.least_id <= w.b)
            SELECT row_id, min(least_id) AS group_id, (SELECT count(*) FROM ways w WHERE w.a = r.row_id) AS n_links FROM reach r GROUP BY row_id""",
        "p6_coverage": f"WITH {SPANS} SELECT row_id, n_words, covered FROM coverage",
        "p6_report": f"""
            WITH {SPANS}, {overlaps}
            SELECT split, source, count(*) AS n_rows, count(pairs) AS n_overlapping, count(CASE WHEN near = 1 THEN 1 END) AS n_near_text,
                count(CASE WHEN shown = 1 THEN 1 END) AS n_same_photo, coalesce(CAST(sum(pairs) AS BIGINT), 0) AS n_pairs,
                coalesce(CAST(sum(n_words) AS BIGINT), 0) AS n_words, coalesce(CAST(sum(covered) AS BIGINT), 0) AS n_covered
            FROM held h LEFT JOIN by_row b ON b.eval_row = h.row_id LEFT JOIN coverage c ON c.row_id = h.row_id GROUP BY split, source""",
        "p8_plan": f"""
            WITH sized AS (SELECT lower(trim(source)) AS source, coalesce(len({WORDS.format('text')}), 0) AS n FROM documents),
            own AS (SELECT t.source, any_value(t.target_share) AS target_share, any_value(t.max_repeats) AS max_repeats,
                coalesce(CAST(sum(s.n) AS BIGINT), 0) AS own_size, count(s.source) AS n_docs
                FROM mix_targets t LEFT JOIN sized s ON s.source = t.source GROUP BY t.source),
            wanted AS (SELECT *, target_share * (SELECT sum(own_size) FROM own) AS w FROM own)
            SELECT source, target_share, max_repeats, own_size, n_docs, round(w, 3) AS wanted_size,
                round(CASE WHEN own_size = 0 THEN 0 ELSE least(w / own_size, max_repeats) END, 6) AS copies, w > max_repeats * own_size OR own_size = 0 AS short FROM wanted""",
        "p2_found": f"""
            WITH names AS (
                SELECT DISTINCT image_id, regexp_replace(lower(image_id), '%[0-9a-f][0-9a-f]', '_', 'g') AS s
                FROM {CAPTIONS} WHERE image_id IS NOT NULL),
            photos AS (
                SELECT image_id,
                    regexp_extract(s, '(?:^|[^0-9a-z])([0-9]{{10}})[^0-9a-z]*([0-9a-f]{{10}})(?:[^0-9a-f]|$)', 1) AS number,
                    regexp_extract(s, '(?:^|[^0-9a-z])([0-9]{{10}})[^0-9a-z]*([0-9a-f]{{10}})(?:[^0-9a-f]|$)', 2) AS code
                FROM names)
            SELECT a.image_id AS image_id_a, b.image_id AS image_id_b
            FROM photos a JOIN photos b ON a.number = b.number AND a.code = b.code AND a.image_id < b.image_id
            WHERE a.number <> '' AND a.code <> ''""",
        "p3_found": _term_sql("term, mark", "WHERE mark IS NOT NULL"),
        "p3_terms": _term_sql("*", ""),
        "p4_found": f"""
            WITH texts AS (
                SELECT row_id, list_sort(list_distinct({WORDS.format('neutral_caption')})) AS n,
                    list_sort(list_distinct({WORDS.format('emotion_caption')})) AS e
                FROM {CAPTIONS} WHERE neutral_caption IS NOT NULL AND emotion_caption IS NOT NULL),
            long AS (SELECT * FROM texts WHERE len(n) >= 5 AND len(e) >= 5),
            firsts AS (SELECT DISTINCT n FROM long),
            linked AS (SELECT a.n AS n_a, b.n AS n_b FROM firsts a, firsts b
                WHERE 17 * len(list_intersect(a.n, b.n)) >= 7 * (len(a.n) + len(b.n)))
            SELECT x.row_id AS row_id_a, y.row_id AS row_id_b
            FROM linked l JOIN long x ON x.n = l.n_a JOIN long y ON y.n = l.n_b AND x.row_id < y.row_id
            WHERE 17 * len(list_intersect(x.e, y.e)) >= 7 * (len(x.e) + len(y.e))""",
        "p6_found": f"""
            WITH held AS (SELECT * FROM test UNION ALL SELECT * FROM val),
            a AS (SELECT DISTINCT list_sort(list_distinct({WORDS.format('emotion_caption')})) AS w FROM train WHERE emotion_caption IS NOT NULL),
            b AS (SELECT DISTINCT list_sort(list_distinct({WORDS.format('emotion_caption')})) AS w FROM held WHERE emotion_caption IS NOT NULL),
            near AS (SELECT a.w AS w_a, b.w AS w_b FROM a, b WHERE len(a.w) >= 5 AND len(b.w) >= 5
                AND 17 * len(list_intersect(a.w, b.w)) >= 7 * (len(a.w) + len(b.w))),
            x AS (SELECT row_id, emotion_id, list_sort(list_distinct({WORDS.format('emotion_caption')})) AS w,
                regexp_extract(lower(image_id), '[0-9]{{10}}[^0-9a-z]+[0-9a-f]{{10}}') AS photo FROM train),
            y AS (SELECT row_id, emotion_id, list_sort(list_distinct({WORDS.format('emotion_caption')})) AS w,
                regexp_extract(lower(image_id), '[0-9]{{10}}[^0-9a-z]+[0-9a-f]{{10}}') AS photo FROM held)
            SELECT least(x.row_id, y.row_id) AS row_id_a, greatest(x.row_id, y.row_id) AS row_id_b
            FROM near JOIN x ON x.w = w_a JOIN y ON y.w = w_b
            UNION
            SELECT least(x.row_id, y.row_id), greatest(x.row_id, y.row_id)
            FROM x JOIN y ON x.photo = y.photo AND x.emotion_id = y.emotion_id WHERE x.photo <> ''""",
        "p7_found": f"""
            WITH items AS (SELECT item_id, {WORDS.format('text')} AS w FROM eval_items WHERE text IS NOT NULL),
            docs AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
            a AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS passage
                FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM items)),
            b AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS passage
                FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 11)) AS i FROM docs))
            SELECT DISTINCT item_id, doc_id FROM a JOIN b USING (passage)""",
        "p8_found": f"""
            WITH sized AS (SELECT lower(trim(source)) AS source, len({WORDS.format('text')}) AS n FROM documents),
            own AS (SELECT t.source, any_value(t.target_share) AS share, any_value(t.max_repeats) AS repeats, coalesce(sum(s.n), 0) AS n
                FROM mix_targets t LEFT JOIN sized s ON s.source = t.source GROUP BY t.source)
            SELECT source FROM own WHERE n = 0 OR share * (SELECT sum(n) FROM own) > repeats * n""",
    }
