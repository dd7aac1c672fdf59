"""Access, listings and state changes of the annotation platform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonoflock.functions import text as T
from sonoflock.operators import upsert

DEFAULTS = {"threshold": 0.3, "k": 15, "w_uncertainty": 0.5, "w_diversity": 0.25, "w_density": 0.25}
TERMINAL = ("COMPLETED", "FAILED")


def with_defaults(requests: DataFrame) -> DataFrame:
    """Parameters that aren't given have their defaults, one by one."""
    return requests.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in DEFAULTS.items()})


def resolved_sets(requests: DataFrame, datasets: DataFrame, sets: DataFrame) -> DataFrame:
    """The snippet set asked for, else the dataset's own, and whether it can be used."""
    wanted = requests.join(datasets.select(F.col("id").alias("dataset_id"), "default_snippet_set_id"), "dataset_id", "left")
    wanted = wanted.withColumn("set_id", F.coalesce("snippet_set_id", "default_snippet_set_id"))
    found = wanted.join(sets.select(F.col("id").alias("set_id"), "status"), "set_id", "left")
    return found.withColumn("ready", F.coalesce(F.col("status") == "ready", F.lit(False)))


def lineage(jobs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Jobs with the parent of the checkpoint that they belong to."""
    own = checkpoints.select(F.col("id").alias("model_checkpoint_id"), "parent_checkpoint_id")
    return jobs.join(own, "model_checkpoint_id")


def active_checkpoints(states: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The checkpoint that each model family of a dataset uses."""
    return states.join(checkpoints.select(F.col("id").alias("active_model_checkpoint_id"), "version", "status"), "active_model_checkpoint_id")


def team_members(memberships: DataFrame, users: DataFrame) -> DataFrame:
    """J17"""
    return memberships.join(users.select(F.col("id").alias("user_id"), "username", "is_active"), "user_id")


def may_read(conversations: DataFrame, memberships: DataFrame, user_id: int, is_admin: bool) -> DataFrame:
    """Conversations of a team for its members, others for who began them; all for admins."""
    mine = memberships.where(F.col("user_id") == user_id).select("team_id").distinct().withColumn("member", F.lit(True))
    allowed = F.when(F.col("team_id").isNotNull(), F.coalesce("member", F.lit(False))).otherwise(F.col("creator_id") == user_id)
    out = conversations.join(mine, "team_id", "left")
    return out.withColumn("may_read", F.lit(is_admin) | allowed).drop("member")


def available_taxonomies(taxonomies: DataFrame, teams: DataFrame, is_admin: bool, status: str | None = "active") -> DataFrame:
    """P18, SET2, SET8: those of the teams and the global ones, each once; newest first where they
    have a time."""
    rows = taxonomies if status is None else taxonomies.where(F.col("status") == status)
    if not is_admin:
        own = rows.join(teams.select("team_id").distinct(), "team_id", "left_semi")
        rows = own.unionByName(rows.where("is_global").select(*own.columns)).dropDuplicates(["taxonomy_id"])
    return rows.orderBy(F.desc("created_at"), F.desc("taxonomy_id")) if "created_at" in rows.columns else rows


def resolve_taxa(ids: DataFrame, known: DataFrame) -> DataFrame:
    """names of taxon ids by namespace: tables of gbif and custom taxa; others speak for
    themselves, as concepts."""
    t = F.col("taxon_id")
    ns = T.taxon_namespace(t)
    out = ids.withColumn("namespace", ns).join(known.select("taxon_id", F.col("name").alias("known_name"), F.col("rank").alias("known_rank")), "taxon_id", "left")
    echo = F.col("namespace").isin("wiki", "envo", "ols", "local")
    return out.select(
        "taxon_id",
        F.when(F.col("namespace").isin("gbif", "custom"), F.col("known_name")).when(echo, T.taxon_key(t)).alias("name"),
        F.when(F.col("namespace").isin("gbif", "custom"), F.col("known_rank")).when(echo, F.lit("concept")).alias("rank"),
    )


def open_suggestions(labels: DataFrame, threshold: float, limit: int) -> DataFrame:
    """Predictions that nobody has judged, the surest first, ties by id."""
    return labels.where((F.col("predicted_label") >= threshold) & F.col("user_label").isNull()).orderBy(F.desc("predicted_label"), "snippet_id").limit(limit)


def newest(rows: DataFrame, limit: int = 50, most: int = 200, dataset_id: int | None = None) -> DataFrame:
    """O15, O17"""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be within 1 and {most}")
    rows = rows if dataset_id is None else rows.where(F.col("dataset_id") == dataset_id)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def oldest(rows: DataFrame, dataset_id: int) -> DataFrame:
    """All snippet sets or jobs of a dataset, in the order they were made."""
    return rows.where(F.col("dataset_id") == dataset_id).orderBy("created_at", "id")


def judged(labels: DataFrame, judgements: DataFrame) -> DataFrame:
    """What users said of predictions, the last judgement of each; unknown ones don't count."""
    last = judgements.groupBy("snippet_id").agg(F.max_by("user_label", F.struct("created_at", "id")).alias("user_label"))
    return upsert.update(labels, ["snippet_id"], last.join(labels, "snippet_id", "left_semi"))


def mirrored(labels: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations as labels of their users, where they aren't there yet."""
    new = annotations.select("snippet_id", F.col("taxon_id").alias("label"), F.lit("user").alias("source"), "user_id")
    return upsert.insert_absent(labels, new, ["snippet_id", "label", "source", "user_id"])


def bootstrapped(log: DataFrame, labels: DataFrame, new: DataFrame, snippets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback from before there is a model, one row for each label of an event. It must name
    labels and a known snippet; it is logged as MODIFY without a checkpoint, whatever it came as. Of
    several events of one user for one snippet the last one's labels replace what the user said."""
    valid = new.where("label is not null and trim(label) != ''").join(snippets.select(F.col("id").alias("snippet_id")).distinct(), "snippet_id", "left_semi")
    valid = valid.withColumn("action", F.lit("MODIFY")).withColumn("model_checkpoint_id", F.lit(None).cast(log.schema["model_checkpoint_id"].dataType))
    out = log.unionByName(valid.select(*log.columns))
    last = valid.groupBy("snippet_id", "user_id").agg(F.max(F.struct("created_at", "id")).alias("_last"))
    said = valid.alias("v").join(last.alias("l"), (F.col("v.snippet_id") == F.col("l.snippet_id")) & F.col("v.user_id").eqNullSafe(F.col("l.user_id")) & (F.struct("v.created_at", "v.id") == F.col("l._last")))
    writes = said.select("v.snippet_id", F.trim("v.label").alias("label"), F.lit("user").alias("source"), "v.user_id").distinct()
    kept = upsert.delete(labels, writes.select("snippet_id", "user_id").distinct(), ["snippet_id", "user_id"])
    return out, kept.unionByName(writes)


def submitted(log: DataFrame, labels: DataFrame, new: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback on known predictions, and feedback without a checkpoint, as there is
    before any model, is logged; ACCEPT and MODIFY with labels replace the user's labels of the
    snippet, REJECT is only logged."""
    valid = new.join(predictions.select("model_checkpoint_id", "snippet_id").distinct(), ["model_checkpoint_id", "snippet_id"], "left_semi")
    valid = valid.select(*new.columns).unionByName(new.where("model_checkpoint_id is null"))
    out = log.unionByName(valid.select(*log.columns))
    writes = valid.where("action in ('ACCEPT', 'MODIFY') and label is not null")
    mine = writes.select("snippet_id", "user_id").distinct()
    kept = upsert.delete(labels, mine, ["snippet_id", "user_id"])
    return out, kept.unionByName(writes.select("snippet_id", "label", F.lit("user").alias("source"), "user_id"))


def canonical(labels: DataFrame, by_species: DataFrame, by_code: DataFrame) -> DataFrame:
    """Labels as taxon ids: ids as they are, else by species, else by the code's own
    custom taxon; labels that nothing resolves are left out."""
    out = labels.join(by_species.select(F.col("species").alias("label"), F.col("taxon_id").alias("s")), "label", "left")
    out = out.join(by_code.select(F.col("code").alias("label"), F.col("taxon_id").alias("c")), "label", "left")
    taxon = F.coalesce(F.when(T.valid_taxon(F.col("label")), F.col("label")), "s", "c")
    return out.select("snippet_id", "user_id", taxon.alias("taxon_id")).where("taxon_id is not null").distinct()


def frozen(conversation_labels: DataFrame, taxonomy_id: Column) -> DataFrame:
    """A label space as a custom taxonomy of top-level nodes in order."""
    node = F.struct(F.concat(F.lit("custom:"), F.substring(F.md5("label"), 1, 12)).alias("id"), F.col("label").alias("name"))
    rows = conversation_labels.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", node.alias("node")))).alias("x"))
    return rows.select(taxonomy_id.alias("taxonomy_id"), F.to_json(F.struct(F.col("x.node").alias("nodes"))).alias("tree"), F.lit("draft").alias("status"))


def registered(checkpoints: DataFrame, states: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trained checkpoints by dataset, family and version, and the families that now
    use them; of several versions of a family the latest."""
    keys = ["dataset_id", "family"]
    later = F.row_number().over(Window.partitionBy(*keys, "version").orderBy(F.desc("created_at"), F.desc("id")))
    new = new.withColumn("r", later).where("r = 1").drop("r")  # a version given twice in one batch
    latest = new.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("id")))).where("r = 1")
    active = latest.select(*keys, F.col("id").alias("active_model_checkpoint_id"))
    return upsert.upsert(checkpoints, new, [*keys, "version"]), upsert.upsert(states, active, keys)


def invitation_grants(invitations: DataFrame, datasets: DataFrame, user_id: int) -> tuple[DataFrame, DataFrame]:
    """Memberships in the teams of invited datasets, and grants of datasets without a team."""
    met = invitations.select("dataset_id").distinct().join(datasets.select(F.col("id").alias("dataset_id"), "team_id"), "dataset_id")
    teams = met.where("team_id is not null").select(F.lit(user_id).cast("long").alias("user_id"), "team_id").distinct()
    return teams, met.where("team_id is null").select(F.lit(user_id).cast("long").alias("user_id"), "dataset_id")


def redeemed(invitations: DataFrame, invited: DataFrame, uses: DataFrame, datasets: DataFrame, members: DataFrame, grants: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memberships, grants and invitations after users registered by invitations (uses:
    invitation_id, user_id). Teams of the invited datasets get them as owners unless they are
    members; datasets without a team are granted, with the invitation; each use counts."""
    met = uses.join(invited, "invitation_id").join(datasets.select(F.col("id").alias("dataset_id"), "team_id"), "dataset_id")
    owners = met.where("team_id is not null").select("user_id", "team_id", F.lit("owner").alias("role"))
    given = met.where("team_id is null").groupBy("user_id", "dataset_id").agg(F.min("invitation_id").alias("granted_by_invitation_id"))
    return (
        upsert.insert_absent(members, owners, ["user_id", "team_id"]),
        upsert.insert_absent(grants, given, ["user_id", "dataset_id"]),
        counted_uses(invitations, uses),
    )


def redeemed_team(invitations: DataFrame, uses: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memberships and invitations after users registered by invitations of teams, which say
    the role; a use by who is a member already doesn't count."""
    met = uses.join(invitations.select(F.col("id").alias("invitation_id"), "team_id", F.col("target_role").alias("role")), "invitation_id")
    first = met.groupBy("user_id", "team_id").agg(F.min(F.struct("invitation_id", "role")).alias("f"))
    fresh = first.join(members, ["user_id", "team_id"], "left_anti").select("user_id", "team_id", "f.role", "f.invitation_id")
    return members.unionByName(fresh.drop("invitation_id"), allowMissingColumns=True), counted_uses(invitations, fresh)


def counted_uses(invitations: DataFrame, uses: DataFrame) -> DataFrame:
    n = uses.groupBy(F.col("invitation_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    used = F.coalesce("used_count", F.lit(0)) + F.coalesce("_n", F.lit(0))
    return invitations.join(n, "id", "left").withColumn("used_count", used).select(*invitations.columns)


LIVE = ("PENDING", "RUNNING", "COMPLETED")


def enqueued(jobs: DataFrame, training: DataFrame, checkpoints: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Jobs, and training jobs with the inference of their checkpoint (inference_job_id). A
    training job that has one, or whose checkpoint names no snippet set, is left alone; the latest
    inference of the checkpoint serves unless it failed; else one is enqueued, once for each
    checkpoint and dataset. A new job's id is that of the first training job that needs it, above
    all ids there are: it is the same if a task runs again."""
    keys = ["model_checkpoint_id", "dataset_id"]
    ready = checkpoints.where("coalesce(resolved_snippet_set_id, 0) != 0").select(F.col("id").alias("model_checkpoint_id"))
    todo = training.where("inference_job_id is null").join(ready, "model_checkpoint_id", "left_semi").select(*keys, "id")
    todo = todo.groupBy(*keys).agg(F.min("id").alias("_first"))
    last = jobs.where("trigger = 'wssed_inference'").groupBy(*keys).agg(F.max_by(F.struct("id", "status"), F.struct("created_at", "id")).alias("_last"))
    top = F.broadcast(jobs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")))
    plan = todo.join(last, keys, "left").crossJoin(top)
    reused = F.when(F.col("_last.status").isin(*LIVE), F.col("_last.id"))
    plan = plan.select(*keys, reused.alias("_reused"), F.coalesce(reused, F.col("_top") + F.col("_first")).alias("_job"))
    made = plan.where("_reused is null").select(
        F.col("_job").alias("id"), *keys, F.lit("wssed_inference").alias("trigger"), F.lit(0).cast("long").alias("feedback_count"), F.lit("PENDING").alias("status"), now.alias("created_at")
    )
    linked = training.join(plan.select(*keys, "_job"), keys, "left").withColumn("inference_job_id", F.coalesce("inference_job_id", "_job"))
    return jobs.unionByName(made, allowMissingColumns=True), linked.select(*training.columns)


def changed(taxonomies: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Taxonomies with new names, descriptions or states where a change (id, ...) has any;
    archiving is the state `archived`. Changes of unknown taxonomies do nothing."""
    columns = [c for c in ("name", "description", "status") if c in changes.columns]
    out = upsert.fill_in(taxonomies, changes, "id", columns)
    touched = changes.select("id", F.lit(True).alias("_touched"))
    return out.join(touched, "id", "left").withColumn("updated_at", F.when(F.col("_touched"), now).otherwise(F.col("updated_at"))).select(*taxonomies.columns)


def team_access(asked: DataFrame, members: DataFrame) -> DataFrame:
    """For users and teams (user_id, is_admin, team_id) whether they may see and manage it: its
    members may see it, its owners manage it, admins both."""
    roles = members.groupBy("user_id", "team_id").agg(F.bool_or(F.col("role") == "owner").alias("_owner"))
    out = asked.join(roles, ["user_id", "team_id"], "left")
    return out.withColumns({
        "may_see": F.col("is_admin") | F.col("_owner").isNotNull(), "may_manage": F.col("is_admin") | F.coalesce("_owner", F.lit(False))
    }).drop("_owner")


def created_datasets(datasets: DataFrame, new: DataFrame, teams: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Datasets after some were asked for (id, is_admin, team_id, source_uri, ...), and each
    request with its error, NULL if there is none, the first of: only admins may leave out the team;
    the team must exist; so must the path; team and path must not be there already, no team being
    one as well. Of requests alike that are otherwise right the smallest id is served."""
    known = teams.select(F.col("id").alias("team_id"), F.lit(True).alias("_team")).distinct()
    there = paths.select(F.col("path").alias("source_uri"), F.lit(True).alias("_path")).distinct()
    out = new.join(known, "team_id", "left").join(there, "source_uri", "left")
    error = (
        F.when(~F.col("is_admin") & F.col("team_id").isNull(), "team_id_required")
        .when(F.col("team_id").isNotNull() & F.col("_team").isNull(), "team_not_found")
        .when(F.col("_path").isNull(), "invalid_source_uri")
    )
    out = out.withColumn("error", error).drop("_team", "_path")
    taken = datasets.select(F.col("team_id").alias("_t"), F.col("source_uri").alias("_u"), F.lit(True).alias("_taken")).distinct()
    first = out.where("error is null").groupBy(F.col("team_id").alias("_ft"), F.col("source_uri").alias("_fu")).agg(F.min("id").alias("_first"))
    out = out.join(taken, out["team_id"].eqNullSafe(taken["_t"]) & (out["source_uri"] == taken["_u"]), "left")
    out = out.join(first, out["team_id"].eqNullSafe(first["_ft"]) & (out["source_uri"] == first["_fu"]), "left")
    late = F.col("_taken").isNotNull() | (F.col("id") != F.col("_first"))
    out = out.withColumn("error", F.coalesce("error", F.when(late, "duplicate_dataset"))).select(*new.columns, "error")
    made = out.where("error is null").select(*[c for c in datasets.columns if c in out.columns])
    return datasets.unionByName(made, allowMissingColumns=True), out


def reused_coordinates(points: DataFrame, checkpoints: DataFrame, with_3d: bool) -> DataFrame:
    """Points after linear checkpoints (id, dataset_id, embedding_model_id) took over those of
    their dataset and embedding model, which have no checkpoint. Points that a checkpoint has are
    overwritten; without 3D, their third dimension stays as it was. Checkpoints whose dataset has no
    points get none."""
    keys = ["dataset_id", "model_checkpoint_id", "snippet_id"]
    numbers = [c for c in points.columns if c not in (*keys, "embedding_model_id")]
    taken = [c for c in numbers if with_3d or "_3d_" not in c]
    base = points.where("model_checkpoint_id is null").drop("model_checkpoint_id")
    wanted = checkpoints.select(F.col("id").alias("model_checkpoint_id"), "dataset_id", "embedding_model_id")
    new = base.join(wanted, ["dataset_id", "embedding_model_id"]).select(*keys, "embedding_model_id", *taken)
    if len(taken) < len(numbers):
        old = points.where("model_checkpoint_id is not null").select(*keys, *[c for c in numbers if c not in taken])
        new = new.join(old, keys, "left")
    return upsert.upsert(points, new, keys)


def columnar(points: DataFrame, slab: int = 10_000) -> DataFrame:
    """Points as arrays in the order of snippets, one row for each slab of ids, so that no row
    grows with the dataset; a third dimension that no point has is NULL, else NULL where a point
    lacks it."""
    numbers = [c for c in points.columns if c != "snippet_id"]
    some = F.broadcast(points.agg(*[(F.count(c) > 0).alias(f"_{c}") for c in numbers]))
    first = (F.floor(F.col("snippet_id") / slab) * slab).alias("first_id")
    rows = points.groupBy(first).agg(F.array_sort(F.collect_list(F.struct("snippet_id", *numbers))).alias("r")).crossJoin(some)
    arrays = [F.when(F.col(f"_{c}") | F.lit(not c.endswith("_z")), F.col(f"r.{c}")).alias(c) for c in numbers]
    return rows.select("first_id", F.col("r.snippet_id").alias("snippet_ids"), *arrays)


def merged_status(jobs: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote states, unknown ones as TRAINING; the time of the end for ended jobs."""
    state = F.when(F.col("remote_status").isin(*TERMINAL, "PENDING", "TRAINING"), F.col("remote_status")).otherwise("TRAINING")
    out = jobs.join(remote.select("id", "remote_status", F.col("seen_at")), "id", "left")
    new = F.when(F.col("remote_status").isNotNull(), state).otherwise(F.col("status"))
    ended = F.when(F.col("remote_status").isin(*TERMINAL), F.coalesce("completed_at", "seen_at")).otherwise(F.col("completed_at"))
    return out.select("id", new.alias("status"), ended.alias("completed_at"))


def projection_points(coordinates: DataFrame, predictions: DataFrame) -> DataFrame:
    """Points with their predictions, by checkpoint and snippet; a third coordinate is
    NULL where there is none."""
    third = F.get("vector", F.lit(2))
    return coordinates.join(predictions, ["model_checkpoint_id", "snippet_id"]).select(
        "snippet_id", F.get("vector", F.lit(0)).alias("x"), F.get("vector", F.lit(1)).alias("y"), third.alias("z"), "labels"
    )


def embedding_rows(rows: DataFrame, snippets: DataFrame, sets: DataFrame, set_id: int | None = None, dataset_id: int | None = None) -> DataFrame:
    """Embeddings of a snippet set, a dataset, both or all; a table is joined only if a filter
    needs it."""
    if set_id is None and dataset_id is None:
        return rows
    members = snippets if set_id is None else snippets.where(F.col("snippet_set_id") == set_id)
    if dataset_id is not None:
        of = sets.where(F.col("dataset_id") == dataset_id).select(F.col("id").alias("snippet_set_id"))
        members = members.join(of, "snippet_set_id", "left_semi")
    return rows.join(members.select(F.col("id").alias("snippet_id")), "snippet_id", "left_semi")


def disjoint_draws(rows: DataFrame, n_pool: int, n_labelled: int, seed: int = 42, key: str = "snippet_id") -> tuple[DataFrame, DataFrame]:
    """SET7: ids of a pool and of a labelled set for a benchmark, drawn by a seeded hash. The
    labelled ones come from outside the pool if there are enough, else from the pool."""
    by_hash = [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]
    ids = rows.select(key).distinct()
    pool = ids.orderBy(*by_hash).limit(n_pool)
    rest = ids.join(pool, key, "left_anti")
    outside = ids.count() - n_pool >= n_labelled
    other = [F.xxhash64(F.lit(seed + 1), F.col(key)), F.col(key)]
    return pool, (rest if outside else pool).orderBy(*other).limit(n_labelled)


def embeddings(snippets: DataFrame, recordings: DataFrame, vectors: DataFrame, set_id: int) -> DataFrame:
    """The vectors of a snippet set with their recordings; all must be of one length."""
    rows = snippets.where(F.col("snippet_set_id") == set_id).select(F.col("id").alias("snippet_id"), "recording_id")
    out = rows.join(vectors, "snippet_id").join(recordings.select(F.col("id").alias("recording_id"), "file_name"), "recording_id")
    shape = out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.size("vector")).alias("dims")).first()
    if not shape.n or shape.dims > 1:
        raise ValueError("no vectors, or vectors of different lengths")
    return out
