"""Queries of annotation state, access, listings and expressions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoflock.functions import labels as L
from sonoflock.functions import text as T
from sonoflock.functions import vectors as V
from sonoflock.functions.numbers import round_half_even
from sonoflock.operators import canonical, feeds, label_state, platform, segment, stats, taxonomy, training, upsert
from sonoflock.plans.bindings import read, vectors, view
from sonoflock.plans.queries import r6, trees
from sonoflock.plans.registry import query
from sonoflock.plans.shared import materialise

def now():
    return F.to_timestamp(F.lit("1996-06-01 00:00:00"))


# --- canonical annotations -----------------------------------------------------------------

CONFIRMING = ("confirmed", "datasets", "memberships", "team_taxonomies", "said")
NAMED_ID = "regexp_replace(md5({0}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
RESOLVED = f""", fm AS (SELECT user_id AS u, arg_min(team_id, id) AS first_team FROM memberships GROUP BY 1),
c AS (SELECT c.id, dataset_id, snippet_id, user_id, trim(label) AS label, coalesce(d.team_id, first_team) AS team_id
 FROM confirmed c LEFT JOIN datasets d ON d.id = dataset_id LEFT JOIN fm ON u = user_id WHERE user_id IS NOT NULL AND trim(label) <> ''),
m AS (SELECT c.*, s_name, t.taxonomy_id AS code, n_name, n_nationkey, contains(label, ':') AS is_id,
 concat('custom:', CASE WHEN c.team_id IS NULL THEN {NAMED_ID.format("concat_ws('/', 'own', dataset_id, snippet_id, user_id, label)")} ELSE {NAMED_ID.format("concat_ws('/', 'team', c.team_id, label)")} END) AS fresh
 FROM c LEFT JOIN supplier ON label = concat('gbif:', s_suppkey) LEFT JOIN team_taxonomies t ON t.team_id = c.team_id AND t.name = label LEFT JOIN nation ON n_nationkey < 8 AND lower(label) = concat('species ', n_nationkey)),
r AS (SELECT id, dataset_id, snippet_id, user_id, label, team_id, NOT is_id AND n_nationkey IS NULL AND code IS NULL AND team_id IS NOT NULL AS made,
 CASE WHEN is_id THEN CASE WHEN s_name IS NOT NULL OR label LIKE 'envo:%' THEN label END WHEN n_nationkey IS NOT NULL THEN concat('gbif:', 1000 + n_nationkey) ELSE coalesce(code, fresh) END AS taxon_id,
 CASE WHEN label LIKE 'envo:%' THEN split_part(label, ':', 2) ELSE coalesce(s_name, n_name, label) END AS resolved_name_snapshot FROM m),
f AS (SELECT * FROM r WHERE taxon_id IS NOT NULL)"""


def resolved(spark, sf):
    known = read(spark, sf, "supplier").select(F.concat(F.lit("gbif:"), "s_suppkey").alias("taxon_id"), F.col("s_name").alias("name"))
    n = F.col("n_nationkey").cast("long")
    species = read(spark, sf, "nation").where("n_nationkey < 8").select(
        F.concat(F.lit("species "), n.cast("string")).alias("species"), F.concat(F.lit("gbif:"), (n + 1000).cast("string")).alias("taxon_id"), F.col("n_name").alias("name")
    )
    views = [view(spark, sf, x) for x in ("team_taxonomies", "datasets", "memberships")]
    return canonical.resolved(view(spark, sf, "confirmed"), known, species, *views)


def said(spark, sf):
    """Annotations whose metadata say where they came from; some aren't JSON."""
    metadata = F.when(F.col("origin").isNotNull(), F.to_json(F.struct(F.col("origin").alias("source")))).when(F.col("user_id") == 5, "not json")
    return view(spark, sf, "said").withColumn("metadata", metadata).drop("origin")


@query(
    RESOLVED + """, w AS (SELECT snippet_id, user_id, max(id) AS last FROM f GROUP BY 1, 2)
SELECT snippet_id, user_id, taxon_id, resolved_name_snapshot, origin AS source FROM said s WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.snippet_id = s.snippet_id AND w.user_id = s.user_id)
UNION ALL SELECT f.snippet_id, f.user_id, taxon_id, min(resolved_name_snapshot), 'active_learning' FROM f JOIN w ON f.id = w.last AND f.snippet_id = w.snippet_id AND f.user_id = w.user_id GROUP BY 1, 2, 3""",
    *CONFIRMING,
)
def confirmed_annotations(spark, sf):
    """Annotations after the confirmations."""
    found = materialise(resolved(spark, sf), "confirmed")
    out = canonical.confirmed(said(spark, sf), view(spark, sf, "team_taxonomies"), found)[0]
    return out.select("snippet_id", "user_id", "taxon_id", "resolved_name_snapshot", F.get_json_object("metadata", "$.source").alias("source"))


@query(
    RESOLVED + """SELECT taxonomy_id, team_id, name, NULL::BIGINT AS created_by_user_id, NULL::VARCHAR AS dataset FROM team_taxonomies
UNION ALL SELECT taxon_id, team_id, label, arg_min(user_id, id), arg_min(dataset_id, id)::VARCHAR FROM f WHERE made GROUP BY 1, 2, 3""",
    *CONFIRMING,
)
def taxonomies_of_codes(spark, sf):
    """Taxonomies after the confirmations; codes that have one keep it."""
    found = materialise(resolved(spark, sf), "confirmed")
    out = canonical.confirmed(said(spark, sf), view(spark, sf, "team_taxonomies"), found)[1]
    return out.select("taxonomy_id", "team_id", "name", "created_by_user_id", F.get_json_object("tree", "$.nodes[0].metadata.dataset_id").alias("dataset"))


@query(
    "SELECT id, origin FROM said WHERE NOT (origin IS NOT DISTINCT FROM 'active_learning' AND (snippet_id, user_id) IN (SELECT c_custkey % 97, c_nationkey FROM customer))", "said"
)
def unlearned_annotations(spark, sf):
    """D20"""
    gone = read(spark, sf, "customer").select((F.col("c_custkey") % 97).alias("snippet_id"), F.col("c_nationkey").cast("long").alias("user_id"))
    return canonical.unlearned(said(spark, sf), gone).select("id", F.get_json_object("metadata", "$.source").alias("origin"))


@query(
    """, g AS (SELECT l_orderkey * 10 + l_linenumber AS snippet_id, l_orderkey % 50 AS dataset_id, concat('Species ', l_partkey % 40) AS label, CASE l_suppkey % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'ground_truth' ELSE 'model' END AS source
 FROM lineitem WHERE l_partkey % 3 = 0)
SELECT 'label' AS part, snippet_id, label, source FROM set_labels s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.snippet_id = s.snippet_id AND g.dataset_id = s.dataset_id AND g.label = s.label AND g.source = s.source)
UNION ALL SELECT 'annotation', snippet_id, resolved_name_snapshot, NULL FROM annotations a WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.source = 'user' AND g.snippet_id = a.snippet_id AND g.label = a.resolved_name_snapshot)""",
    "set_labels", "annotations",
)
def removed_labels(spark, sf):
    """Both tables after labels were taken back."""
    k = F.col("l_suppkey") % 3
    gone = read(spark, sf, "lineitem").where("l_partkey % 3 = 0").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("snippet_id"), (F.col("l_orderkey") % 50).alias("dataset_id"),
        F.concat(F.lit(" Species "), (F.col("l_partkey") % 40).cast("string")).alias("label"), F.when(k == 0, "user").when(k == 1, "ground_truth").otherwise("model").alias("source"),
    )
    labels, annotations = canonical.label_removed(view(spark, sf, "set_labels"), view(spark, sf, "annotations"), gone)
    return labels.select(F.lit("label").alias("part"), "snippet_id", "label", "source").unionByName(
        annotations.select(F.lit("annotation").alias("part"), "snippet_id", F.col("resolved_name_snapshot").alias("label"), F.lit(None).cast("string").alias("source"))
    )


@query(
    """, l AS (SELECT s.*, snippet_set_id FROM set_labels s LEFT JOIN snippets ON id = snippet_id WHERE dataset_id = 7)
SELECT DISTINCT 'dataset' AS scope, snippet_id FROM l UNION ALL SELECT DISTINCT 'user', snippet_id FROM l WHERE source = 'user' AND user_id = 3
UNION ALL SELECT DISTINCT 'set', snippet_id FROM l WHERE snippet_set_id = 1 UNION ALL SELECT DISTINCT 'user in set', snippet_id FROM l WHERE source = 'user' AND user_id = 3 AND snippet_set_id = 1""",
    "set_labels", "snippets",
)
def labelled_ids(spark, sf):
    """The snippets of each scope."""
    rows, snippets = view(spark, sf, "set_labels"), view(spark, sf, "snippets")
    scopes = {"dataset": {}, "user": {"user_id": 3}, "set": {"snippets": snippets, "set_id": 1}, "user in set": {"user_id": 3, "snippets": snippets, "set_id": 1}}
    out = None
    for name, scope in scopes.items():
        one = canonical.labelled_ids(rows, 7, **scope).select(F.lit(name).alias("scope"), "snippet_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT vec_id AS snippet_id, -vec_id AS place FROM embeddings WHERE vec_id IN (SELECT snippet_id FROM al_labels WHERE source = 'user') ORDER BY 2 LIMIT 30", "al_labels")
def labelled_matrix_rows(spark, sf):
    """The first thirty rows of a matrix, in its order, that a user labelled."""
    matrix = vectors(spark, sf).select("snippet_id", (-F.col("snippet_id")).alias("place"))
    return canonical.in_matrix_order(matrix, view(spark, sf, "al_labels").where("source = 'user'")).limit(30)


@query(
    """, last AS (SELECT snippet_id, id, row_number() OVER (PARTITION BY snippet_id ORDER BY id) AS r, label, trim(CASE WHEN id % 3 = 0 THEN concat(' ', label) ELSE label END) AS t FROM feedback WHERE label IS NOT NULL)
SELECT snippet_id, array_to_string(list(t ORDER BY id), ',') AS labels FROM (SELECT snippet_id, t, min(id) AS id FROM last GROUP BY 1, 2) GROUP BY 1""",
    "feedback",
)
def predicted_label_lists(spark, sf):
    """F8"""
    rows = view(spark, sf, "feedback").select("id", "snippet_id", F.array(F.concat(F.lit(" "), "label"), "label", F.lit("")).alias("predicted_labels"))
    return label_state.predicted_labels(rows).select("snippet_id", F.array_join("labels", ",").alias("labels"))


# --- changes -------------------------------------------------------------------------------


@query(
    """SELECT t.id, CASE WHEN p_partkey % 4 = 1 THEN p_name ELSE name END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'archived' ELSE status END AS status, p_partkey IS NOT NULL AS touched FROM team_taxonomies t LEFT JOIN part ON p_partkey = t.id * 2 + 1 AND t.id < 20""",
    "team_taxonomies",
)
def changed_taxonomies(spark, sf):
    """Some renamed, some archived."""
    rows = view(spark, sf, "team_taxonomies").withColumn("updated_at", F.lit(None).cast("timestamp"))
    k = F.col("p_partkey")
    changes = read(spark, sf, "part").where("p_partkey % 2 = 1 and p_partkey < 40").select(
        ((k - 1) / 2).cast("long").alias("id"), F.when(k % 4 == 1, F.col("p_name")).alias("name"), F.when(k % 3 == 0, "archived").alias("status")
    )
    return platform.changed(rows, changes, now()).select("id", "name", "status", F.col("updated_at").isNotNull().alias("touched"))


INVITED = """, uses AS (SELECT c_custkey % 20 AS invitation_id, 100 + c_custkey % 60 AS user_id FROM customer), invited AS (SELECT DISTINCT o_custkey % 20 AS invitation_id, o_custkey AS dataset_id FROM orders WHERE o_custkey <= 60),
met AS (SELECT DISTINCT user_id, d.id, team_id FROM uses JOIN invited USING (invitation_id) JOIN datasets d ON d.id = dataset_id)
"""


@query(
    INVITED + """SELECT 'member' AS part, user_id AS a, team_id AS b, role AS c FROM memberships UNION ALL SELECT DISTINCT 'member', user_id, team_id, 'owner' FROM met WHERE team_id IS NOT NULL
UNION ALL SELECT DISTINCT 'grant', user_id, id, NULL FROM met WHERE team_id IS NULL
UNION ALL SELECT 'used', p_partkey, p_size + (SELECT count(*) FROM uses WHERE invitation_id = p_partkey), NULL FROM part WHERE p_partkey <= 30""",
    "datasets", "memberships",
)
def redeemed_invitations(spark, sf):
    """Memberships, grants and counts of uses after registrations."""
    uses = read(spark, sf, "customer").select((F.col("c_custkey") % 20).alias("invitation_id"), (F.col("c_custkey") % 60 + 100).alias("user_id"))
    invited = read(spark, sf, "orders").where("o_custkey <= 60").select((F.col("o_custkey") % 20).alias("invitation_id"), F.col("o_custkey").alias("dataset_id")).distinct()
    invitations = read(spark, sf, "part").where("p_partkey <= 30").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("used_count"))
    datasets = view(spark, sf, "datasets").select("id", F.col("team_id").cast("long").alias("team_id"))
    grants = uses.limit(0).select("user_id", F.col("user_id").alias("dataset_id"), F.col("user_id").alias("granted_by_invitation_id"))
    members, granted, counted = platform.redeemed(invitations, invited, uses, datasets, view(spark, sf, "memberships").drop("id"), grants)
    none = F.lit(None).cast("string").alias("c")
    return (
        members.select(F.lit("member").alias("part"), F.col("user_id").alias("a"), F.col("team_id").alias("b"), F.col("role").alias("c"))
        .unionByName(granted.select(F.lit("grant").alias("part"), F.col("user_id").alias("a"), F.col("dataset_id").alias("b"), none))
        .unionByName(counted.select(F.lit("used").alias("part"), F.col("id").alias("a"), F.col("used_count").alias("b"), none))
    )


@query(
    """, met AS (SELECT DISTINCT c_custkey % 12 AS user_id, n_nationkey AS id, n_nationkey % 20 AS team_id FROM customer JOIN nation ON c_nationkey = n_nationkey),
fresh AS (SELECT user_id, team_id, min(id) AS id FROM met WHERE (user_id, team_id) NOT IN (SELECT user_id, team_id FROM memberships) GROUP BY 1, 2)
SELECT 'member' AS part, user_id AS a, team_id AS b, role AS c FROM memberships UNION ALL SELECT 'member', user_id, team_id, concat('role', id) FROM fresh
UNION ALL SELECT 'used', n_nationkey, (SELECT count(*) FROM fresh WHERE id = n_nationkey), NULL FROM nation""",
    "memberships",
)
def redeemed_team_invitations(spark, sf):
    """Members don't use up an invitation."""
    n = F.col("n_nationkey").cast("long")
    invitations = read(spark, sf, "nation").select(n.alias("id"), (n % 20).alias("team_id"), F.concat(F.lit("role"), n.cast("string")).alias("target_role"), F.lit(None).cast("long").alias("used_count"))
    uses = read(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("invitation_id"), (F.col("c_custkey") % 12).alias("user_id"))
    members, counted = platform.redeemed_team(invitations, uses, view(spark, sf, "memberships").drop("id"))
    return members.select(F.lit("member").alias("part"), F.col("user_id").alias("a"), F.col("team_id").alias("b"), F.col("role").alias("c")).unionByName(
        counted.select(F.lit("used").alias("part"), F.col("id").alias("a"), F.col("used_count").alias("b"), F.lit(None).cast("string").alias("c"))
    )


@query(
    """, todo AS (SELECT model_checkpoint_id, dataset_id, min(id) AS first FROM training_jobs WHERE inference_job_id IS NULL AND model_checkpoint_id % 5 NOT IN (0, 1) GROUP BY 1, 2),
old AS (SELECT model_checkpoint_id, dataset_id, arg_max(id, (created_at, id)) AS job, arg_max(status, (created_at, id)) AS status FROM inferences WHERE trigger = 'wssed_inference' GROUP BY 1, 2),
plan AS (SELECT t.*, CASE WHEN status IN ('PENDING', 'RUNNING', 'COMPLETED') THEN job END AS reused FROM todo t LEFT JOIN old USING (model_checkpoint_id, dataset_id)),
fin AS (SELECT *, coalesce(reused, first + (SELECT max(id) FROM inferences)) AS job FROM plan)
SELECT 'training' AS part, t.id, coalesce(inference_job_id, job) AS job, NULL AS status FROM training_jobs t LEFT JOIN fin USING (model_checkpoint_id, dataset_id)
UNION ALL SELECT 'job', id, model_checkpoint_id, status FROM inferences UNION ALL SELECT 'job', job, model_checkpoint_id, 'PENDING' FROM fin WHERE reused IS NULL""",
    "training_jobs", "inferences",
)
def enqueued_inference(spark, sf):
    """Training jobs with the inference of their checkpoint, and all jobs."""
    ids = view(spark, sf, "training_jobs").select(F.col("model_checkpoint_id").alias("id")).distinct()
    checkpoints = ids.withColumn("resolved_snippet_set_id", F.when(F.col("id") % 5 == 0, 0).when(F.col("id") % 5 > 1, F.col("id")))
    jobs, training = platform.enqueued(view(spark, sf, "inferences"), view(spark, sf, "training_jobs"), checkpoints, now())
    return training.select(F.lit("training").alias("part"), "id", F.col("inference_job_id").alias("job"), F.lit(None).cast("string").alias("status")).unionByName(
        jobs.select(F.lit("job").alias("part"), "id", F.col("model_checkpoint_id").alias("job"), "status")
    )


@query("SELECT event_id AS id, o_custkey AS snippet_id FROM events LEFT JOIN orders ON o_orderkey = event_id")
def backfilled_feedback(spark, sf):
    """A column that is new takes its values from the table that the key names."""
    rows = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("prediction_id"), F.lit(None).cast("long").alias("snippet_id"))
    named = read(spark, sf, "orders").select(F.col("o_orderkey").alias("prediction_id"), F.col("o_custkey").alias("snippet_id"))
    return upsert.update(rows, ["prediction_id"], named).select("id", "snippet_id")


@query("SELECT min(id) AS id, snippet_id, user_id, taxon_id FROM said GROUP BY 2, 3, 4", "said")
def annotations_without_repeats(spark, sf):
    """A delete by a join of the table with itself."""
    return upsert.without_repeats(view(spark, sf, "said"), ["snippet_id", "user_id", "taxon_id"]).select("id", "snippet_id", "user_id", "taxon_id")


@query(
    """WITH n AS (SELECT o_orderkey AS id, o_orderkey % 9 = 0 AS is_admin, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 30 END AS team_id, concat('d', o_custkey % 40) AS uri FROM orders),
e AS (SELECT n.*, CASE WHEN NOT is_admin AND team_id IS NULL THEN 'team_id_required' WHEN team_id >= 25 THEN 'team_not_found' WHEN uri NOT IN (SELECT concat('d', p_partkey) FROM part WHERE p_partkey < 35) THEN 'invalid_source_uri' END AS error FROM n)
SELECT id, coalesce(error, CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_nationkey IS NOT DISTINCT FROM team_id AND concat('d', n_nationkey) = uri) OR row_number() OVER (PARTITION BY team_id, uri, error IS NULL ORDER BY id) > 1 THEN 'duplicate_dataset' END) AS error FROM e"""
)
def dataset_requests(spark, sf):
    """What is wrong with each dataset asked for."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    new = read(spark, sf, "orders").select(k.alias("id"), (k % 9 == 0).alias("is_admin"), F.when(k % 4 != 0, c % 30).alias("team_id"), F.concat(F.lit("d"), (c % 40).cast("string")).alias("source_uri"))
    n = F.col("n_nationkey").cast("long")
    nations = read(spark, sf, "nation").select(n.alias("id"), n.alias("team_id"), F.concat(F.lit("d"), n.cast("string")).alias("source_uri"))
    paths = read(spark, sf, "part").where("p_partkey < 35").select(F.concat(F.lit("d"), "p_partkey").alias("path"))
    return platform.created_datasets(nations, new, nations.select("id"), paths)[1].select("id", "error")


@query(
    """SELECT concat('t', n_regionkey) AS taxonomy_id, array_to_string(list(concat('custom:', left(md5(n_name), 12)) ORDER BY n_nationkey DESC), ',') AS ids, array_to_string(list(n_name ORDER BY n_nationkey DESC), ',') AS names FROM nation GROUP BY 1"""
)
def frozen_trees(spark, sf):
    """Ids and names of a frozen label space, in its order."""
    labels = read(spark, sf, "nation").select(F.col("n_regionkey").alias("conv_id"), (-F.col("n_nationkey")).alias("place"), F.col("n_name").alias("label"))
    nodes = F.from_json("tree", "nodes array<struct<id string, name string>>")["nodes"]
    return platform.frozen(labels, F.concat(F.lit("t"), F.col("conv_id").cast("string"))).select("taxonomy_id", F.array_join(nodes["id"], ",").alias("ids"), F.array_join(nodes["name"], ",").alias("names"))


@query(
    """, n AS (SELECT dataset_id, id % 4 AS version, arg_max(id, (created_at, id)) AS id FROM inferences GROUP BY 1, 2)
SELECT dataset_id, version, id FROM n UNION ALL SELECT r_regionkey, 3, -r_regionkey FROM region WHERE r_regionkey NOT IN (SELECT dataset_id FROM n WHERE version = 3)""",
    "inferences",
)
def registered_versions(spark, sf):
    """Checkpoints by dataset, family and version; new ones take the place of old ones."""
    new = view(spark, sf, "inferences").select("id", "dataset_id", F.lit("f").alias("family"), (F.col("id") % 4).alias("version"), "created_at")
    r = F.col("r_regionkey").cast("long")
    old = read(spark, sf, "region").select((-r).alias("id"), r.alias("dataset_id"), F.lit("f").alias("family"), F.lit(3).cast("long").alias("version"), F.lit(None).cast(new.schema["created_at"].dataType).alias("created_at"))
    states = new.limit(0).select("dataset_id", "family", F.col("id").alias("active_model_checkpoint_id"))
    return platform.registered(old, states, new)[0].select("dataset_id", "version", "id")


@query(
    """SELECT p_partkey AS id, left(md5(array_to_string(list_sort([p_brand, p_type, p_name]), ',')), 12) AS scope, CASE WHEN p_size % 2 = 0 THEN concat(p_size // 2) ELSE concat(p_size // 2, '.5') END AS t FROM part"""
)
def scopes_and_times(spark, sf):
    """hashes of label scopes whatever their order, and times with and without a fraction."""
    labels = F.array("p_type", "p_name", "p_brand")
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.scope_hash(labels).alias("scope"), T.plain_number(F.col("p_size") / 2).alias("t"))


# --- access, listings, counts --------------------------------------------------------------


@query(
    """SELECT c_custkey % 12 AS user_id, c_nationkey AS team_id, bool_or(c_custkey % 12 = 4 OR m.role IS NOT NULL) AS may_see, bool_or(c_custkey % 12 = 4 OR coalesce(m.role, '') = 'owner') AS may_manage
FROM customer LEFT JOIN memberships m ON m.user_id = c_custkey % 12 AND m.team_id = c_nationkey GROUP BY 1, 2""",
    "memberships",
)
def team_access(spark, sf):
    """P16"""
    asked = read(spark, sf, "customer").select((F.col("c_custkey") % 12).alias("user_id"), F.col("c_nationkey").cast("long").alias("team_id")).distinct()
    return platform.team_access(asked.withColumn("is_admin", F.col("user_id") == 4), view(spark, sf, "memberships")).select("user_id", "team_id", "may_see", "may_manage")


@query(
    """, focal AS (SELECT id, team_id FROM datasets WHERE dataset_type = 'FOCAL_RECORDINGS'), g AS (SELECT o_custkey % 30 AS user_id, o_custkey AS dataset_id FROM orders),
mine AS (SELECT user_id, f.id FROM memberships m JOIN focal f ON f.team_id = m.team_id UNION SELECT user_id, dataset_id FROM g JOIN focal ON id = dataset_id),
n AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey = 33 THEN (SELECT count(*) FROM focal) ELSE (SELECT count(*) FROM mine WHERE mine.user_id = c_custkey) END AS n_focal FROM customer WHERE c_custkey < 50)
SELECT user_id, n_focal, n_focal > 0 OR user_id = 33 AS enabled FROM n""",
    "datasets", "memberships",
)
def focal_access(spark, sf):
    """A22"""
    users = read(spark, sf, "customer").where("c_custkey < 50").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") == 33).alias("is_admin"))
    grants = read(spark, sf, "orders").select((F.col("o_custkey") % 30).alias("user_id"), F.col("o_custkey").alias("dataset_id"))
    datasets = view(spark, sf, "datasets").withColumn("team_id", F.col("team_id").cast("long"))
    return stats.focal_access(users, datasets, view(spark, sf, "memberships"), grants)


@query(
    "SELECT 'recordings' AS name, count(*) AS n FROM recordings UNION ALL SELECT 'short', count(*) FROM recordings WHERE duration < 10 UNION ALL SELECT 'labels', count(*) FROM al_labels",
    "recordings", "al_labels",
)
def scalar_counts(spark, sf):
    """A4"""
    recordings = view(spark, sf, "recordings")
    return stats.scalar_counts(recordings=recordings, short=recordings.where("duration < 10"), labels=view(spark, sf, "al_labels"))


@query(
    """(SELECT 'newest' AS listing, id, status FROM jobs WHERE model_checkpoint_id = 7 ORDER BY created_at DESC, id DESC LIMIT 3) UNION ALL SELECT 'oldest', id, status FROM jobs WHERE model_checkpoint_id = 8""", "jobs"
)
def job_listings(spark, sf):
    """The newest jobs of one dataset, and all of another."""
    jobs = view(spark, sf, "jobs").withColumnRenamed("model_checkpoint_id", "dataset_id")
    return platform.newest(jobs, 3, dataset_id=7).select(F.lit("newest").alias("listing"), "id", "status").unionByName(platform.oldest(jobs, 8).select(F.lit("oldest").alias("listing"), "id", "status"))


SUGGESTED = """WITH hits AS ((SELECT concat('gbif:', p_partkey) AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'a') AND {0} ORDER BY p_partkey LIMIT 15)
UNION ALL (SELECT concat('n', n_nationkey), n_name FROM nation WHERE contains(lower(n_name), 'a') {1} ORDER BY n_regionkey, n_nationkey LIMIT 15))
SELECT '{2}' AS asked, * FROM (SELECT id, name FROM hits ORDER BY CASE WHEN starts_with(lower(name), 'a') THEN 0 ELSE 1 END, lower(name), id LIMIT 15)"""


@query(f"({SUGGESTED.format('true', '', 'all')}) UNION ALL ({SUGGESTED.format('false', 'AND n_regionkey IN (1, 3)', 'some')})")
def suggested_taxa(spark, sf):
    """O19, SET6: all sources, and two taxonomies without the service."""
    remote = read(spark, sf, "part").where("contains(lower(p_name), 'a')").select(
        F.concat(F.lit("gbif:"), "p_partkey").alias("id"), F.col("p_name").alias("canonical_name"), F.lit("").alias("scientific_name"), F.col("p_partkey").alias("position")
    )
    own = trees(spark, sf).withColumn("taxonomy_id", F.concat(F.lit("custom:"), "taxonomy_id"))
    own = own.withColumn("tree", F.parse_json(F.regexp_replace(F.to_json("tree"), "canonical_name", "name")))
    out = [taxonomy.suggest(remote, own, "A", asked, 15).select(F.lit(name).alias("asked"), "id", F.col("canonical_name").alias("name")) for name, asked in (("all", None), ("some", "custom:r1, custom:r3,"))]
    return out[0].unionByName(out[1])


@query(
    """SELECT p_partkey AS id, CASE WHEN p_size % 2 = 1 THEN p_size ELSE 5 END::DOUBLE AS window, p_retailprice AS step, CASE WHEN p_size % 3 = 1 THEN 0.25 ELSE 0.5 END::DOUBLE AS overlap FROM part"""
)
def snippet_set_parameters(spark, sf):
    """A window is asked for, a step of 0 counts as not asked for, and so does no overlap."""
    n = F.col("p_size")
    models = read(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), n.cast("double").alias("window_size"), F.col("p_retailprice").alias("step_size"), F.when(n % 3 == 1, 0.25).otherwise(0.5).alias("overlap"),
        (n % 2).alias("requires_fixed_window"), F.lit(0).alias("requires_fixed_step"), (n % 2).alias("requires_fixed_overlap"),
    )
    return segment.resolved_parameters(models, 5.0, 0.0, None)


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('gbif:', c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN concat(',gbif:', c_nationkey) ELSE '' END) END AS labels FROM customer"""
)
def quick_labels(spark, sf):
    """Quick labels that lack a field go."""
    k = F.col("c_custkey")
    one = F.struct(F.when(k % 3 != 0, F.concat(F.lit("gbif:"), k.cast("string"))).alias("taxon_id"), F.col("c_name").alias("display_name"))
    two = F.struct(F.concat(F.lit("gbif:"), F.col("c_nationkey").cast("string")).alias("taxon_id"), F.when((k % 5 != 0) & (k % 3 != 0), F.col("c_name")).alias("display_name"))
    return read(spark, sf, "customer").select(k.alias("id"), F.array_join(F.transform(L.whole_quick_labels(F.array(one, two)), lambda x: x["taxon_id"]), ",").alias("labels"))


@query(
    """, done AS (SELECT model_checkpoint_id % 4 AS c, max(created_at) AS cutoff FROM jobs WHERE status = 'COMPLETED' AND trigger IN ('manual', 'auto_feedback') AND model_checkpoint_id % 9 > 5 GROUP BY 1),
f AS (SELECT CASE WHEN id % 5 = 0 THEN NULL ELSE model_checkpoint_id END AS c, created_at FROM feedback)
SELECT f.c AS model_checkpoint_id, count(*) AS n_events FROM f LEFT JOIN done ON f.c = done.c WHERE cutoff IS NULL OR f.created_at > cutoff GROUP BY 1""",
    "feedback", "jobs",
)
def feedback_events(spark, sf):
    """Events of every action since the last retrain, those without a checkpoint included."""
    jobs = view(spark, sf, "jobs").where("model_checkpoint_id % 9 > 5").withColumn("model_checkpoint_id", F.col("model_checkpoint_id") % 4).withColumn("completed_at", F.col("created_at"))
    rows = view(spark, sf, "feedback").withColumn("model_checkpoint_id", F.when(F.col("id") % 5 != 0, F.col("model_checkpoint_id")))
    return label_state.events_since_retrain(rows, jobs)


@query(
    """, scored AS (SELECT vec_id AS snippet_id, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings ORDER BY rank LIMIT 200)
SELECT rank, snippet_id, label FROM scored JOIN al_labels USING (snippet_id)""",
    "al_labels",
)
def ranked_labels(spark, sf):
    """Labels in the order of a ranking of two hundred snippets."""
    best = vectors(spark, sf).orderBy(F.desc(F.element_at("vector", 1)), "snippet_id").limit(200).select("snippet_id", F.element_at("vector", 1).alias("score"))
    from pyspark.sql import Window

    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "snippet_id")))
    return feeds.in_order(ranked, view(spark, sf, "al_labels")).select(F.col("rank").cast("long").alias("rank"), "snippet_id", "label")


@query(
    """, e AS (SELECT l_orderkey * 10 + l_linenumber AS snippet_id FROM lineitem), s AS (SELECT DISTINCT id, snippet_set_id FROM snippets)
SELECT 'set' AS asked, count(*) AS n FROM e WHERE snippet_id IN (SELECT id FROM s WHERE snippet_set_id = 1) UNION ALL SELECT 'dataset', count(*) FROM e WHERE snippet_id IN (SELECT id FROM s WHERE snippet_set_id IN (0, 2))
UNION ALL SELECT 'both', count(*) FROM e WHERE snippet_id IN (SELECT id FROM s WHERE snippet_set_id = 2) UNION ALL SELECT 'all', count(*) FROM e""",
    "snippets",
)
def filtered_embeddings(spark, sf):
    """Tables are joined only for the filters that are given."""
    snippets = view(spark, sf, "snippets")
    rows = snippets.select(F.col("id").alias("snippet_id"))
    r = F.col("r_regionkey").cast("long")
    sets = read(spark, sf, "region").select(r.alias("id"), (r % 2).alias("dataset_id"))
    asked = {"set": {"set_id": 1}, "dataset": {"dataset_id": 0}, "both": {"set_id": 2, "dataset_id": 0}, "all": {}}
    return stats.scalar_counts(**{k: platform.embedding_rows(rows, snippets, sets, **v) for k, v in asked.items()}).withColumnRenamed("name", "asked")


@query(
    """, t AS (SELECT concat('f', l_orderkey % 500) AS key, CASE WHEN l_linenumber = 1 AND l_orderkey % 4 = 0 THEN [] ELSE [concat('sp', l_partkey % 6)] END AS labels, false AS path FROM lineitem WHERE l_orderkey % 3 = 0
UNION ALL SELECT concat('p', l_orderkey % 500), [concat('sp', l_partkey % 5)], true FROM lineitem WHERE l_orderkey % 3 <> 0),
k AS (SELECT key, list_sort(list_distinct(flatten(list(labels)))) AS labels FROM t GROUP BY 1)
SELECT vec_id AS snippet_id, array_to_string(coalesce(n.labels, p.labels), ',') AS labels FROM embeddings LEFT JOIN k n ON n.key = concat('f', vec_id) LEFT JOIN k p ON p.key = concat('p', vec_id) WHERE n.key IS NOT NULL OR p.key IS NOT NULL""",
    "jobs",
)
def aligned_rows(spark, sf):
    """Vectors with ground truth by file name, else by path; events without labels make negatives."""
    l, k = read(spark, sf, "lineitem"), F.col("l_orderkey")
    label = F.concat(F.lit("sp"), (F.col("l_partkey") % F.when(k % 3 == 0, 6).otherwise(5)).cast("string"))
    none = (k % 3 == 0) & (F.col("l_linenumber") == 1) & (k % 4 == 0)
    truth = l.select(F.concat(F.when(k % 3 == 0, "f").otherwise("p"), (k % 500).cast("string")).alias("key"), F.when(none, F.array().cast("array<string>")).otherwise(F.array(label)).alias("labels"))
    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("snippet_id"), F.concat(F.lit("f"), "vec_id").alias("file_name"), F.concat(F.lit("p"), "vec_id").alias("file_path"))
    return training.training_rows(rows, truth).select("snippet_id", F.array_join("labels", ",").alias("labels"))


# --- projections ---------------------------------------------------------------------------


def laid_out(spark, sf):
    """Points of three embedding models of a dataset, and some that a checkpoint has."""
    v = read(spark, sf, "embeddings")
    numbers = [F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate(("pca_2d_x", "pca_2d_y", "pca_3d_x", "pca_3d_y", "pca_3d_z"))]
    base = v.select((F.col("vec_id") % 2).alias("dataset_id"), F.lit(None).cast("long").alias("model_checkpoint_id"), F.lit(5).cast("long").alias("embedding_model_id"), F.col("vec_id").alias("snippet_id"), *numbers)
    old = [F.lit(0.5).alias(c) for c in ("pca_2d_x", "pca_2d_y", "pca_3d_x", "pca_3d_y", "pca_3d_z")]
    kept = v.where("vec_id % 3 = 0").select((F.col("vec_id") % 2).alias("dataset_id"), F.lit(70).cast("long").alias("model_checkpoint_id"), F.lit(4).cast("long").alias("embedding_model_id"), F.col("vec_id").alias("snippet_id"), *old)
    return base.unionByName(kept)


@query(
    """SELECT NULL::BIGINT AS model_checkpoint_id, 5 AS embedding_model_id, vec_id AS snippet_id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[5]::DOUBLE, 6) AS z FROM embeddings
UNION ALL SELECT 70, 4, vec_id, 0.5, 0.5 FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 2 = 1
UNION ALL SELECT 70, 5, vec_id, round(embedding[1]::DOUBLE, 6), CASE WHEN vec_id % 3 = 0 THEN 0.5 END FROM embeddings WHERE vec_id % 2 = 0"""
)
def reused_coordinates(spark, sf):
    """A linear checkpoint takes over its dataset's points in two dimensions."""
    checkpoints = read(spark, sf, "region").where("r_regionkey = 0").select(F.lit(70).cast("long").alias("id"), F.col("r_regionkey").cast("long").alias("dataset_id"), F.lit(5).cast("long").alias("embedding_model_id"))
    out = platform.reused_coordinates(laid_out(spark, sf), checkpoints, False)
    return out.select("model_checkpoint_id", "embedding_model_id", "snippet_id", r6(F.col("pca_2d_x"), "x"), r6(F.col("pca_3d_z"), "z"))


@query(
    """SELECT vec_id // 64 * 64 AS first_id, count(*) AS n, array_to_string(list(vec_id ORDER BY vec_id), ',') AS ids, round(sum(embedding[1]::DOUBLE), 6) AS x, count(*) FILTER (vec_id % 4 = 0) AS some_z, true AS no_z FROM embeddings GROUP BY 1"""
)
def columnar_points(spark, sf):
    """Arrays of 64 ids a row; one method has a third dimension at some points, one at none."""
    v = read(spark, sf, "embeddings")
    points = v.select(
        F.col("vec_id").alias("snippet_id"), F.element_at("embedding", 1).cast("double").alias("pca_x"),
        F.when(F.col("vec_id") % 4 == 0, 1.0).alias("pca_z"), F.lit(None).cast("double").alias("umap_z"),
    )
    there = F.size(F.filter("pca_z", lambda z: z.isNotNull())).cast("long")
    return platform.columnar(points, 64).select(
        "first_id", F.size("snippet_ids").cast("long").alias("n"), F.array_join(F.col("snippet_ids").cast("array<string>"), ",").alias("ids"),
        r6(V.total(F.col("pca_x")), "x"), there.alias("some_z"), F.col("umap_z").isNull().alias("no_z"),
    )


# --- expressions ---------------------------------------------------------------------------


@query(
    """SELECT o_orderkey AS id, printf('%.2f', o_totalprice / 8)::DOUBLE AS eighth, printf('%.1f', (o_orderkey % 1000) / 4)::DOUBLE AS quarter, printf('%.2f', (o_orderkey % 100000 + 0.5::DOUBLE) / 100)::DOUBLE AS middle, printf('%.0f', -(o_orderkey % 50) / 2)::DOUBLE AS below FROM orders"""
)
def half_even_rounding(spark, sf):
    """Exact halves, values that only seem to be halves, and negative ones."""
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(
        k.alias("id"), round_half_even(F.col("o_totalprice") / 8, 2).alias("eighth"), round_half_even((k % 1000) / 4, 1).alias("quarter"),
        round_half_even((k % 100000 + F.lit(0.5)) / 100, 2).alias("middle"), round_half_even(-(k % 50) / 2, 0).alias("below"),
    )


@query(
    """SELECT vec_id AS snippet_id, round(list_dot_product(e, e), 6) AS length, round(e[1], 6) AS first, round(1 / (1 + exp(-v[1])), 6) AS sigmoid, round(ln((1 / (1 + exp(-v[1]))) / (1 - 1 / (1 + exp(-v[1])))), 6) AS logit, round(greatest(0, v[1]), 6) AS relu
FROM (SELECT vec_id, v, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS e FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))"""
)
def unit_vectors(spark, sf):
    """V2, V11"""
    first = F.element_at("vector", 1).cast("double")
    rows = vectors(spark, sf).withColumn("u", V.l2_normalise(F.col("vector")))
    return rows.select(
        "snippet_id", r6(V.dot(F.col("u"), F.col("u")), "length"), r6(F.element_at("u", 1), "first"), r6(V.sigmoid(first), "sigmoid"), r6(V.logit(V.sigmoid(first)), "logit"), r6(V.relu(first), "relu")
    )


ORDER = [f"sp{i}" for i in range(5)]


@query(
    """SELECT vec_id AS snippet_id, round(embedding[4]::DOUBLE, 6) AS p3, coalesce(nullif(array_to_string(list_filter(['sp0', 'sp1', 'sp2', 'sp3', 'sp4'], lambda x: embedding[replace(x, 'sp', '')::INT + 1] > 0), ','), ''), 'None') AS hot,
coalesce(array_to_string(list_filter(['sp0', 'sp1', 'sp2', 'sp3', 'sp4'], lambda x: embedding[replace(x, 'sp', '')::INT + 1] > 0 AND x <> 'sp2'), ','), '') AS without_sp2, list_aggregate(list_transform(embedding[1:5], lambda x: x > 0), 'bool_or') = false AS negative,
CASE WHEN vec_id % 2 = 0 THEN 'sp0' ELSE 'class_0' END AS first_class, (vec_id % 7 > 0 AND vec_id % 7 <= 5)::INT AS n_picked, 3 - (vec_id % 7 > 0 AND vec_id % 7 <= 5)::INT AS n_skipped, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS merged FROM embeddings"""
)
def label_arrays(spark, sf):
    """C2, C4, C8, C9, C10, C14, C17"""
    order = F.array(*map(F.lit, ORDER))
    k = F.col("vec_id")
    rows = read(spark, sf, "embeddings").withColumn("probs", F.slice("embedding", 1, 5).cast("array<double>"))
    hot = L.from_multi_hot(F.transform("probs", lambda x: F.when(x > 0, 1).otherwise(0)), ORDER)
    asked = F.array((k % 7).cast("int"), (k % 7).cast("int"), F.lit(9))
    old = F.create_map(F.lit("a"), F.lit("old"))
    new = F.when(k % 3 == 0, F.create_map(F.lit("a"), F.lit("new"))).otherwise(F.create_map(F.lit("b"), F.lit("new")))
    return rows.withColumn("hot", hot).select(
        k.alias("snippet_id"), r6(F.element_at(L.probability_map(order, F.col("probs")), "sp3"), "p3"), F.array_join("hot", ",").alias("hot"),
        F.array_join(L.without(L.without(F.col("hot"), "sp2"), T.NO_EVENT), ",").alias("without_sp2"), L.confirmed_negative(F.col("hot")).alias("negative"),
        F.element_at(L.label_order([F.when(k % 2 == 0, order).otherwise(F.array(F.lit("one")))], 5), 1).alias("first_class"),
        F.size(L.picked(order, asked)).alias("n_picked"), L.skipped(order, asked).alias("n_skipped"), F.element_at(L.merged(old, new), "a").alias("merged"),
    )


@query(
    """SELECT o_orderkey AS id, concat('models/', o_custkey, '/fam_', o_orderpriority, '_ckpt_', o_orderkey, '.pt') AS path, concat('models/', o_custkey, '/fam_', o_orderpriority, '_labels_', o_orderkey, '.json') AS labels_path,
concat('v1_manual_', epoch(o_orderdate)::BIGINT) AS manual, concat('v1_r', epoch(o_orderdate)::BIGINT) AS retrained, CASE o_orderkey % 4 WHEN 0 THEN 'p' WHEN 1 THEN 's' WHEN 2 THEN 'm' ELSE 'other' END AS preferred,
o_orderkey % 6 = 0 OR epoch(TIMESTAMP '1996-06-01') - epoch(o_orderdate) > 86400 AS stale, concat('envo:', o_orderkey, '_x') AS term FROM orders"""
)
def checkpoint_names(spark, sf):
    """F11, F13, F18, F21, C15"""
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    paths = F.create_map(
        F.lit("preferred"), F.when(k % 4 == 0, "p").otherwise(""), F.lit("best_micro_model_segment"), F.when(k % 4 == 1, "s"), F.lit("best_micro_model"), F.when(k % 4 == 2, "m")
    )
    named = (F.lit("models"), F.col("o_custkey"), F.lit("fam"), F.col("o_orderpriority"), k)
    return read(spark, sf, "orders").select(
        k.alias("id"), T.checkpoint_path("models", *named[1:]).alias("path"), T.checkpoint_path("models", *named[1:], labels=True).alias("labels_path"),
        T.version(F.lit("v1"), "manual", at).alias("manual"), T.version(F.lit("v1"), "retrain", at).alias("retrained"), L.preferred_path(paths, F.lit("other")).alias("preferred"),
        T.older_than(F.when(k % 6 != 0, at), 86400, now()).alias("stale"), T.short_form_id(F.concat(F.lit("ENVO_"), k.cast("string"), F.lit("_X"))).alias("term"),
    )
