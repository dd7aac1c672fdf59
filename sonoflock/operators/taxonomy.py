"""Taxonomy trees kept as JSON: flattening, search, lookup."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonoflock.operators import feeds
from sonoflock.plans.shared import materialise

#: Nodes that one task reads of one subtree in a round; the rest of it waits for the next.
BUDGET = 20_000
WALK = "taxonomy_id string, place array<int>, node string, waits boolean"


def walked(tree: object, place: list[int], budget: int) -> Iterator[tuple[list[int], str, bool]]:
    """(place, JSON, waits) of the nodes of a subtree, each without its children; from `budget`
    nodes on whole subtrees, which wait."""
    if not place:  # a whole tree
        nodes = tree.get("nodes") if isinstance(tree, dict) else None
        todo = [([k], x) for k, x in reversed(list(enumerate(nodes)))] if isinstance(nodes, list) else []
    else:
        todo = [(place, tree)]
    while todo:
        at, node = todo.pop()
        if budget <= 0:
            yield at, json.dumps(node), True
            continue
        budget -= 1
        children = node.get("children") if isinstance(node, dict) else None
        if isinstance(node, dict):
            yield at, json.dumps({k: v for k, v in node.items() if k != "children"}), False
        if isinstance(children, list):
            todo += [([*at, k], x) for k, x in reversed(list(enumerate(children)))]


def text(path: str):
    return F.nullif(F.expr(f"try_variant_get(node, '$.{path}', 'string')"), F.lit(""))


def flatten(trees: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The nodes of trees (taxonomy_id, tree: a VARIANT, or a string of JSON, which may be more
    than the thousand levels deep that a VARIANT may be), each with its place as an array of
    positions: in the order of places a parent stands before its children. Nodes with neither
    id nor name are left out. Trees may be of any depth and size: a task walks `budget` nodes of a
    subtree, and what is below waits for the next round."""
    whole = F.col("tree") if dict(trees.dtypes)["tree"] == "string" else F.to_json("tree")
    top = trees.select(F.col("taxonomy_id").cast("string").alias("taxonomy_id"), F.array().cast("array<int>").alias("place"), whole.alias("node")).where("node is not null")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                rows = walked(json.loads(r.node), [int(x) for x in r.place], budget)
                while part := list(islice(rows, 10_000)):
                    yield pd.DataFrame({"taxonomy_id": r.taxonomy_id, "place": [x[0] for x in part], "node": [x[1] for x in part], "waits": [x[2] for x in part]})

    # rounds: what a task has left of a large tree goes to many tasks in the next one
    found = []
    waiting = top
    while True:
        step = materialise(waiting.mapInPandas(walk, WALK), "taxonomy")
        found.append(step.where("not waits").drop("waits"))
        waiting = step.where("waits").drop("waits")
        if waiting.isEmpty():
            break
        waiting = waiting.repartition("taxonomy_id", "place")
    rows = reduce(DataFrame.unionByName, found).withColumn("node", F.parse_json("node"))
    out = rows.select(
        "taxonomy_id",
        "place",
        F.coalesce(text("id"), text("taxon_id")).alias("id"),
        F.coalesce(text("name"), text("canonical_name")).alias("name"),
        F.coalesce(text("rank"), text("metadata.rank")).alias("rank"),
        text("scientific_name").alias("scientific_name"),
    )
    return out.where("id is not null or name is not null")


def find(trees: DataFrame, node_id: str) -> DataFrame:
    """The first node of an id."""
    return flatten(trees).where(F.col("id") == node_id).orderBy("taxonomy_id", "place").limit(1)


def labels_page(trees: DataFrame, query: str = "", offset: int = 0, limit: int = 50) -> DataFrame:
    """Nodes whose name holds the query, with how many there are in all."""
    rows = materialise(flatten(trees).where(F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit(query.lower()))), "labels")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy("taxonomy_id", "place").offset(offset).limit(limit).crossJoin(F.broadcast(total)).drop("place")


def preview(trees: DataFrame, n: int) -> DataFrame:
    """How many labels each tree has, the first n, and whether there are more."""
    rows = materialise(flatten(trees).select("taxonomy_id", "place", F.coalesce("name", "id").alias("name")), "labels")
    counts = rows.groupBy("taxonomy_id").agg(F.count(F.lit(1)).alias("n_labels"))
    # n rows of each tree are brought together, not the tree
    rank = F.row_number().over(Window.partitionBy("taxonomy_id").orderBy("place"))
    first = rows.withColumn("_r", rank).where(F.col("_r") <= n).groupBy("taxonomy_id").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("all"))
    out = counts.join(first.select("taxonomy_id", F.col("all.name").alias("preview")), "taxonomy_id", "left")
    return out.select("taxonomy_id", "n_labels", F.coalesce("preview", F.array().cast("array<string>")).alias("preview"), (F.col("n_labels") > n).alias("has_more"))


def search(trees: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Top-level nodes only, whose name or scientific name holds the query, in the order of
    taxonomies (column position) and nodes; a node without an id has its taxonomy's."""
    top = trees.sparkSession.sql(
        "SELECT t.taxonomy_id, t.position, v.pos, v.value AS node FROM {trees} t, LATERAL variant_explode(variant_get(t.tree, '$.nodes', 'variant')) v "
        "WHERE t.status = 'active'",
        trees=trees,
    )
    rows = top.select("taxonomy_id", "position", "pos", F.coalesce(text("id"), text("taxon_id"), F.col("taxonomy_id")).alias("id"), text("name").alias("name"), text("scientific_name").alias("scientific_name"))
    hit = [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(query.lower())) for c in ("name", "scientific_name")]
    return rows.where(hit[0] | hit[1]).orderBy("position", "pos").limit(limit).drop("position", "pos")


def merged_hits(remote: DataFrame, custom: DataFrame) -> DataFrame:
    """SET6: hits of both kinds, with the columns of either."""
    return remote.unionByName(custom, allowMissingColumns=True)


def suggest(remote: DataFrame, trees: DataFrame, query: str, selected: str | None = None, limit: int = 10) -> DataFrame:
    """O19, SET6: the first hits of a service (its rank in `position`) and of custom taxonomies, by
    relevance. A comma list of taxonomies leaves out the service unless it names `gbif`, and custom
    taxonomies that it doesn't name; an empty list is none."""
    if not query or not 1 <= limit <= 50:
        raise ValueError("there must be a query, and limit be within 1 and 50")
    names = [x.strip() for x in (selected or "").split(",") if x.strip()]
    hits = remote.orderBy("position", "id").limit(limit).drop("position") if not names or "gbif" in names else remote.limit(0).drop("position")
    if names:
        trees = trees.where(F.col("taxonomy_id").isin(*[x for x in names if x.startswith("custom:")]))
    custom = search(trees, query, limit).withColumnRenamed("name", "canonical_name")
    return feeds.relevance(merged_hits(hits, custom), query).limit(limit)
