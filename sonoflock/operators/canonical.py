"""Confirmed labels as canonical annotations, and what takes them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoflock.functions import text as T
from sonoflock.operators import upsert

LEARNED = "active_learning"
WHOSE = ["snippet_id", "user_id"]
#: Namespaces whose ids need no table to be resolved.
SPEAKING = ("wiki", "envo", "ols", "local")


def with_team(rows: DataFrame, datasets: DataFrame, memberships: DataFrame) -> DataFrame:
    """The team that a custom taxon belongs to: the dataset's, else that of the user's first
    membership by id, else NULL."""
    own = datasets.select(F.col("id").alias("dataset_id"), F.col("team_id").alias("_own"))
    first = memberships.groupBy("user_id").agg(F.min_by("team_id", "id").alias("_first"))
    out = rows.join(own, "dataset_id", "left").join(first, "user_id", "left")
    return out.withColumn("team_id", F.coalesce("_own", "_first")).drop("_own", "_first")


def resolved(new: DataFrame, known: DataFrame, species: DataFrame, taxonomies: DataFrame, datasets: DataFrame, memberships: DataFrame) -> DataFrame:
    """Confirmed labels (id, dataset_id, snippet_id, user_id, label) with the taxon and the
    name of each. A label that is a taxon id counts if it can be resolved: gbif and custom ids by
    `known` (taxon_id, name), the speaking namespaces by themselves. Another label is a species of
    `species` (species, taxon_id, name), whatever its case, else a code: the team's taxonomy of that
    name (the first by id, those without a number last), else a new one, marked `made`. Ids of new ones follow from their names,
    so that a task that runs again makes the same ones; without a team a code's id belongs to the
    user and snippet alone, and there is no taxonomy. Rows without user or label have no taxon."""
    label = F.btrim(F.col("label"), F.lit(" \t\n\r\x0b\x0c"))
    rows = with_team(new.withColumn("label", label).where("user_id is not null and label != ''"), datasets, memberships)
    ids = known.groupBy(F.col("taxon_id").alias("label")).agg(F.first("name", ignorenulls=True).alias("_known"), F.lit(True).alias("_there"))
    names = species.groupBy(F.lower("species").alias("_low")).agg(F.min(F.struct("taxon_id", "name")).alias("_species"))
    codes = taxonomies.groupBy("team_id", F.col("name").alias("label")).agg(F.min(F.struct(F.col("id").isNull(), "id", "taxonomy_id")).alias("_code"))
    rows = rows.join(ids, "label", "left").withColumn("_low", F.lower("label")).join(names, "_low", "left").join(codes, ["team_id", "label"], "left")
    is_id, ns = T.valid_taxon(F.col("label")), T.taxon_namespace(F.col("label"))
    found = F.when(ns.isin("gbif", "custom"), F.coalesce("_there", F.lit(False))).otherwise(ns.isin(*SPEAKING))
    fresh = F.when(F.col("team_id").isNotNull(), T.named_id("team", "team_id", "label")).otherwise(T.named_id("own", "dataset_id", "snippet_id", "user_id", "label"))
    by_code = ~is_id & F.col("_species").isNull()
    taxon = F.when(is_id, F.when(found, F.col("label"))).otherwise(F.coalesce("_species.taxon_id", "_code.taxonomy_id", F.concat(F.lit("custom:"), fresh)))
    name = F.when(is_id, F.coalesce(F.when(ns.isin(*SPEAKING), T.taxon_key(F.col("label"))), "_known", "label")).otherwise(F.coalesce("_species.name", "label"))
    return rows.select(
        "id", "dataset_id", "snippet_id", "user_id", "label", "team_id", taxon.alias("taxon_id"), name.alias("resolved_name_snapshot"),
        (by_code & F.col("_code").isNull() & F.col("team_id").isNotNull()).alias("made"),
    ).where("taxon_id is not null")


def made_taxonomies(found: DataFrame) -> DataFrame:
    """A taxonomy of one node for each new code of a team; the first event that named it says
    who made it and for which dataset."""
    first = found.where("made").groupBy("team_id", F.col("label").alias("name"), F.col("taxon_id").alias("taxonomy_id"))
    rows = first.agg(F.min(F.struct("id", "dataset_id", "user_id")).alias("f"))
    origin = F.struct(F.lit("al_auto").alias("source"), F.col("f.dataset_id").alias("dataset_id"))
    node = F.struct(F.col("name").alias("id"), "name", F.lit("label_code").alias("rank"), origin.alias("metadata"), F.array().cast("array<string>").alias("children"))
    return rows.select(
        "taxonomy_id", "team_id", F.col("f.user_id").alias("created_by_user_id"), "name",
        F.concat(F.lit("Label code of dataset "), F.col("f.dataset_id").cast("string")).alias("description"),
        F.to_json(F.struct(F.array(node).alias("nodes"))).alias("tree"), F.lit("active").alias("status"), F.lit(False).alias("is_global"),
    )


def confirmed(annotations: DataFrame, taxonomies: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations and taxonomies after confirmations; `found` comes from resolved(), and as it
    is read several times, from a table. What a user's last confirmation of a snippet names, of those
    that name anything, replaces all that the user said of it; each taxon once."""
    last = found.groupBy(*WHOSE).agg(F.max("id").alias("_last"))
    said = found.join(last, WHOSE).where("id = _last").groupBy(*WHOSE, "dataset_id", "taxon_id").agg(F.min("resolved_name_snapshot").alias("resolved_name_snapshot"))
    origin = F.to_json(F.struct(F.lit(LEARNED).alias("source"), "dataset_id"))
    writes = said.select(*WHOSE, "taxon_id", "resolved_name_snapshot", origin.alias("metadata"))
    kept = upsert.delete(annotations, last.select(*WHOSE), WHOSE)
    return kept.unionByName(writes, allowMissingColumns=True), taxonomies.unionByName(made_taxonomies(found), allowMissingColumns=True)


def learned(metadata: Column) -> Column:
    """Whether an annotation came from confirmed labels; texts that aren't JSON say no."""
    return F.coalesce(F.get_json_object(metadata, "$.source") == LEARNED, F.lit(False))


def unlearned(annotations: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the annotations of some (snippet_id, user_id) that came from confirmed labels;
    what a user wrote stays, and no user means nobody's."""
    g = gone.where("user_id is not null").select(F.col("snippet_id").alias("_s"), F.col("user_id").alias("_u")).distinct().withColumn("_yes", F.lit(True))
    # a row for each key and the origin in the key: no annotation is compared with more than one
    said = annotations.withColumn("_learned", learned(F.col("metadata")))
    met = (said["snippet_id"] == g["_s"]) & (said["user_id"] == g["_u"]) & (said["_learned"] == g["_yes"])
    return said.join(g, met, "left_anti").drop("_learned")


def label_removed(labels: DataFrame, annotations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels and annotations without some (dataset_id, snippet_id, label, source). Labels of
    users go from both tables, whoever gave them; ground truth goes from the labels alone. Removals
    without label or of another source do nothing."""
    wanted = gone.withColumn("label", F.trim("label")).where("label != '' and source in ('user', 'ground_truth')")
    keys = ["dataset_id", "snippet_id", "label", "source"]
    of_users = wanted.where("source = 'user'").select("snippet_id", F.col("label").alias("resolved_name_snapshot"))
    return labels.join(wanted, keys, "left_anti"), annotations.join(of_users, ["snippet_id", "resolved_name_snapshot"], "left_anti").select(*annotations.columns)


def labelled_ids(labels: DataFrame, dataset_id: int, user_id: int | None = None, snippets: DataFrame | None = None, set_id: int | None = None) -> DataFrame:
    """The snippets of a dataset that have labels, each once; only those that a user labelled,
    and only those of a snippet set, if these are named."""
    rows = labels.where(F.col("dataset_id") == dataset_id)
    if user_id is not None:
        rows = rows.where((F.col("source") == "user") & (F.col("user_id") == user_id))
    if set_id is not None:
        members = snippets.where(F.col("snippet_set_id") == set_id).select(F.col("id").alias("snippet_id"))
        rows = rows.join(members, "snippet_id", "left_semi")
    return rows.select("snippet_id").distinct()


def in_matrix_order(matrix: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of a matrix (place, snippet_id, ...) whose snippet is a member, in its order."""
    return matrix.join(members.select("snippet_id"), "snippet_id", "left_semi").orderBy("place")
