"""Connected components by concurrent frontier search, and splits that keep components whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenry.functions.style import style_label
from lumenry.functions.text import photo_key
from lumenry.stage import stage


BUCKET_ROWS = 1_000_000  # rows of components that one bucket of the order holds


def _adjacency(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    return both.where("u is not null and v is not null and u <> v").distinct()


def components(edges: DataFrame, max_levels: int = 60) -> DataFrame:
    """Component of every node of an undirected graph: ``(node string, component string)``.

    ``edges`` has string columns ``a`` and ``b``; loops, nulls and repeated
    edges are ignored, no edges give an empty result. A node that is greatest
    by (degree, hash) among its neighbours is a seed. All seeds grow their
    frontier by one hop per round over the hash-partitioned adjacency list, a
    node taking the least seed that reaches it first. Edges between nodes of
    different seeds are the small graph of colliding seeds, which is solved
    the same way, until no seeds collide. Each level has at most half as many
    nodes as the one before. Nothing is collected; every round's table is
    written to the shared folder.
    """
    spark = edges.sparkSession
    levels: list[DataFrame] = []
    graph = edges
    for _ in range(max_levels):
        adjacent = stage(_adjacency(graph), "adjacent")
        if adjacent.isEmpty():
            break
        labels = _grow(adjacent)
        levels.append(labels)
        left = labels.select(F.col("node").alias("u"), F.col("seed").alias("a"))
        right = labels.select(F.col("node").alias("v"), F.col("seed").alias("b"))
        graph = (
            adjacent.where("u < v").join(left, "u").join(right, "v").where("a <> b").select("a", "b").distinct()
        )
    else:
        raise RuntimeError("components did not converge")
    if not levels:
        return spark.createDataFrame([], "node string, component string")
    found = levels[0].withColumnRenamed("seed", "component")
    for labels in levels[1:]:
        up = labels.select(F.col("node").alias("component"), F.col("seed").alias("top"))
        found = found.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return found


def _grow(adjacent: DataFrame) -> DataFrame:
    """One level: seeds, then rounds of one hop until every node has a seed."""
    rank = adjacent.groupBy("u").agg(F.count("*").alias("degree")).select(
        "u", F.struct("degree", F.xxhash64("u").alias("hash"), "u").alias("rank")
    )
    beside = adjacent.join(rank.select(F.col("u").alias("v"), F.col("rank").alias("other")), "v")
    top = beside.groupBy("u").agg(F.max("other").alias("other"))
    seeds = rank.join(top, "u").where("rank > other").select(F.col("u").alias("node"), F.col("u").alias("seed"))
    reached = frontier = stage(seeds, "seeds")
    rounds = [frontier]
    while True:
        step = (
            adjacent.join(frontier.withColumnRenamed("node", "u"), "u")
            .groupBy(F.col("v").alias("node"))
            .agg(F.min("seed").alias("seed"))
            .join(reached.select("node"), "node", "left_anti")
        )
        frontier = stage(step, "frontier")
        if frontier.isEmpty():
            break
        rounds.append(frontier)
        reached = rounds[0]
        for part in rounds[1:]:
            reached = reached.unionByName(part)
    return reached


def assign_splits(
    rows: DataFrame,
    component: str,
    stratum: str,
    shares: dict[str, float] | None = None,
    heavy_share: float = 0.01,
    buckets: int = 256,
) -> DataFrame:
    """``rows`` with a column ``split``: whole components, each stratum spread as evenly as that allows.

    Components are put in hash order within a class (the set of strata they
    hold, with their size), and the order is cut at the cumulated shares, so
    every class, and with it every stratum, keeps the shares. A component of
    more than ``heavy_share`` of all rows (at most ``1 / heavy_share`` of
    them) goes to the split that wants most rows, before the others. Null
    strata count as a stratum of their own; a null component is not allowed.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    sizes = stage(
        rows.groupBy(component)
        .agg(F.count("*").alias("_n"), F.array_sort(F.collect_set(F.coalesce(F.col(stratum), F.lit("")))).alias("_s"))
        .withColumn("_class", F.xxhash64(F.concat_ws("|", "_s"), F.least("_n", F.lit(64))))
        .withColumn("_hash", F.xxhash64(F.col(component), F.lit(42))),
        "component_sizes",
    )
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    heavy_rows = sizes.where(F.col("_n") > heavy_share * total).orderBy(F.desc("_n"), component).collect() if total else []
    want = {name: share * total for name, share in shares.items()}
    heavy = {}
    for row in heavy_rows:
        name = max(want, key=lambda k: want[k])
        heavy[row[component]] = name
        want[name] -= row["_n"]
    rest = {name: max(0.0, w) for name, w in want.items()}
    whole = sum(rest.values()) or 1.0
    light = sizes.where(F.col("_n") <= heavy_share * total) if total else sizes
    buckets = max(buckets, -(-total // BUCKET_ROWS))
    light = light.withColumn("_bucket", F.pmod(F.shiftrightunsigned("_hash", 40), F.lit(buckets)))
    before = W.partitionBy("_class").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        light.groupBy("_class", "_bucket")
        .agg(F.sum("_n").alias("_m"))
        .withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
        .withColumn("_all", F.sum("_m").over(W.partitionBy("_class")))
        .drop("_m")
    )
    inner = W.partitionBy("_class", "_bucket").orderBy("_hash", component).rowsBetween(W.unboundedPreceding, -1)
    # A class starts at a turn of its own, so that small classes don't all begin in the first split.
    turn = F.pmod(F.col("_class"), F.lit(1_000_003)) / 1_000_003.0
    placed = (
        light.withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
        .join(offsets, ["_class", "_bucket"])
        .withColumn("_at", ((F.col("_before") + F.col("_in") + F.col("_n") / 2.0) / F.col("_all") + turn) % 1.0)
    )
    cut, name_at = 0.0, None
    for name, share in rest.items():
        cut += share / whole
        name_at = F.when(F.col("_at") < cut, name) if name_at is None else name_at.when(F.col("_at") < cut, name)
    names = list(shares)
    splits = placed.select(component, name_at.otherwise(names[-1]).alias("split"))
    rows = rows.drop("split")
    if not heavy:
        return rows.join(splits, component)
    # Rows of the few heavy components stay where they are.
    named = F.create_map(*(F.lit(x) for pair in heavy.items() for x in pair))
    is_heavy = F.col(component).isin(*heavy)
    return rows.where(~is_heavy).join(splits, component).unionByName(rows.where(is_heavy).withColumn("split", named[F.col(component)]))


def _photo(image_id: Column) -> Column:
    return F.concat(F.lit("photo:"), photo_key(image_id))


def photo_edges(captions: DataFrame) -> DataFrame:
    """Edges between the written forms of photo names and the photos they name."""
    return (
        captions.select("image_id").where("image_id is not null").distinct()
        .select(F.concat(F.lit("name:"), "image_id").alias("a"), _photo(F.col("image_id")).alias("b"))
        .where("b is not null")
    )


def photo_components(captions: DataFrame) -> DataFrame:
    """``(image_id, component)`` for every name in ``captions`` that gives a photo."""
    return components(photo_edges(captions)).where(F.col("node").startswith("name:")).select(
        F.expr("substring(node, 6)").alias("image_id"), "component"
    )


def same_photo_names(captions: DataFrame) -> DataFrame:
    """p2_found: pairs of different stored names of one photo, smaller first."""
    named = photo_components(captions)
    other = named.select("component", F.col("image_id").alias("image_id_b"))
    return (
        named.withColumnRenamed("image_id", "image_id_a").join(other, "component")
        .where("image_id_a < image_id_b").select("image_id_a", "image_id_b").distinct()
    )


def split_captions(captions: DataFrame) -> DataFrame:
    """p2_splits: ``(row_id, split)`` for every row.

    Rows of one photo stay together. A name that gives no photo is a photo of
    its own; a row without a name stands alone.
    """
    named = photo_components(captions)
    rows = (
        captions.select("row_id", "image_id", style_label(F.col("emotion"), F.col("emotion_id")).alias("style"))
        .join(named, "image_id", "left")
        .withColumn(
            "component",
            F.coalesce("component", F.concat(F.lit("name:"), "image_id"), F.concat(F.lit("row:"), F.col("row_id").cast("string"))),
        )
        .select("row_id", "component", "style")
    )
    return assign_splits(rows, "component", "style").select("row_id", "split")


def split_report(spark: SparkSession, captions: DataFrame) -> DataFrame:
    """p2_balance: rows and their share by split and style, photos by split."""
    parts = split_captions(captions).join(
        captions.select("row_id", style_label(F.col("emotion"), F.col("emotion_id")).alias("style")), "row_id"
    )
    counted = parts.groupBy("split", "style").agg(F.count("*").alias("n_rows"))
    return counted.withColumn(
        "share", F.round(F.col("n_rows") / F.sum("n_rows").over(W.partitionBy("style")), 4)
    )
