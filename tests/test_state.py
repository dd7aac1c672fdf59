"""Annotation state, access and rounding by hand-made rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sonoflock.functions import labels as L
from sonoflock.functions.numbers import round_half_even
from sonoflock.operators import canonical, label_state, platform, segment, stats, taxonomy, upsert
from sonoflock.sources import tables

NOW = "2024-05-01 00:00:00"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def world(spark):
    return {
        "known": spark.createDataFrame([("gbif:1", "Parus major"), ("gbif:2", None), ("custom:ab", "Own")], "taxon_id string, name string"),
        "species": spark.createDataFrame([("Parus Major", "gbif:1", "Parus major")], "species string, taxon_id string, name string"),
        "taxonomies": spark.createDataFrame([(9, "custom:late", 1, "wren"), (3, "custom:early", 1, "wren")], "id long, taxonomy_id string, team_id long, name string"),
        "datasets": spark.createDataFrame([(1, 1), (2, None)], "id long, team_id long"),
        "memberships": spark.createDataFrame([(8, 70, 5), (7, 71, 5)], "id long, team_id long, user_id long"),
    }


CONFIRMED = "id long, dataset_id long, snippet_id long, user_id long, label string"


def test_labels_are_resolved_by_id_species_and_code(spark, world):
    new = [
        (1, 1, 10, 5, "gbif:1"), (2, 1, 11, 5, "gbif:2"), (3, 1, 12, 5, "gbif:99"), (4, 1, 13, 5, "envo:tree"), (5, 1, 14, 5, "odd:1"), (6, 1, 15, 5, "\tparus MAJOR "),
        (7, 1, 16, 5, "wren"), (8, 1, 17, 5, "robin"), (9, 2, 18, 5, "robin"), (10, 2, 19, 6, "robin"), (11, 1, 20, None, "robin"), (12, 1, 21, 5, "  "), (13, 1, 22, 5, None), (14, 5, 23, 6, "robin"),
    ]
    got = {r.id: r for r in canonical.resolved(spark.createDataFrame(new, CONFIRMED), **world).collect()}
    assert sorted(got) == [1, 2, 4, 6, 7, 8, 9, 10, 14]
    assert [got[i].taxon_id for i in (1, 2, 4, 6, 7)] == ["gbif:1", "gbif:2", "envo:tree", "gbif:1", "custom:early"]
    assert [got[i].resolved_name_snapshot for i in (1, 2, 4, 6, 7)] == ["Parus major", "gbif:2", "tree", "Parus major", "wren"]
    # the dataset's team, the first membership, none: only teams get taxonomies
    assert [(got[i].team_id, got[i].made) for i in (8, 9, 10, 14)] == [(1, True), (71, True), (None, False), (None, False)]
    assert len({got[i].taxon_id for i in (8, 9, 10, 14)}) == 4
    assert all(len(got[i].taxon_id) == len("custom:") + 36 for i in (8, 9, 10, 14))


def test_the_last_confirmation_that_names_anything_replaces(spark, world):
    old = spark.createDataFrame(
        [(10, 5, "gbif:7", "x", None), (10, 6, "gbif:7", "x", None), (11, 5, "gbif:7", "x", None)], "snippet_id long, user_id long, taxon_id string, resolved_name_snapshot string, metadata string"
    )
    new = [(1, 1, 10, 5, "robin"), (2, 1, 10, 5, "gbif:1"), (2, 1, 10, 5, "Parus major"), (2, 1, 10, 5, "wren"), (3, 1, 10, 5, "gbif:404"), (4, 1, 11, 5, "")]
    found = canonical.resolved(spark.createDataFrame(new, CONFIRMED), **world)
    annotations, taxonomies = canonical.confirmed(old, world["taxonomies"], found)
    assert rows(annotations, "snippet_id", "user_id", "taxon_id") == [(10, 5, "custom:early"), (10, 5, "gbif:1"), (10, 6, "gbif:7"), (11, 5, "gbif:7")]
    # the code of an event that was replaced has its taxonomy all the same
    assert sorted(r.name for r in taxonomies.collect()) == ["robin", "wren", "wren"]
    # what came from confirmations goes, the rest and nobody's stay
    gone = spark.createDataFrame([(10, 5), (10, 6), (None, None)], "snippet_id long, user_id long")
    assert rows(canonical.unlearned(annotations, gone), "snippet_id", "user_id") == [(10, 6), (11, 5)]
    # a second run makes the same ids
    again = canonical.confirmed(old, taxonomies, canonical.resolved(spark.createDataFrame(new, CONFIRMED), **(world | {"taxonomies": taxonomies})))[1]
    assert again.count() == 3


def test_confirming_nothing_changes_nothing(spark, world):
    old = spark.createDataFrame([(10, 5, "gbif:7", "x", None)], "snippet_id long, user_id long, taxon_id string, resolved_name_snapshot string, metadata string")
    found = canonical.resolved(spark.createDataFrame([], CONFIRMED), **world)
    annotations, taxonomies = canonical.confirmed(old, world["taxonomies"], found)
    assert annotations.count() == 1 and taxonomies.count() == 2


def test_metadata_that_is_no_json(spark):
    df = spark.createDataFrame([("{",), (None,), ('{"source": "active_learning"}',), ('{"source": 1}',)], "m string")
    assert [r[0] for r in df.select(canonical.learned(F.col("m"))).collect()] == [False, False, True, False]


def test_labels_taken_back(spark):
    labels = spark.createDataFrame([(1, 10, "a", "user"), (1, 10, "a", "ground_truth"), (2, 10, "a", "user"), (1, 11, "a", "user")], "dataset_id long, snippet_id long, label string, source string")
    annotations = spark.createDataFrame([(10, "a", 1), (10, "a", 2), (10, "b", 1), (11, "a", 1)], "snippet_id long, resolved_name_snapshot string, user_id long")
    gone = spark.createDataFrame([(1, 10, " a ", "user"), (1, 11, "a", "model"), (1, 11, " ", "user")], labels.schema)
    one, two = canonical.label_removed(labels, annotations, gone)
    assert rows(one) == [(1, 10, "a", "ground_truth"), (1, 11, "a", "user"), (2, 10, "a", "user")]
    assert rows(two) == [(10, "b", 1), (11, "a", 1)]
    truth = spark.createDataFrame([(1, 10, "a", "ground_truth")], labels.schema)
    assert [x.count() for x in canonical.label_removed(labels, annotations, truth)] == [3, 4]


def test_rounding_is_pythons(spark):
    values = [2.675, 0.125, 0.375, 1.005, 0.5, 1.5, 2.5, -0.5, -1.5, 0.0, 1e15, -2.675, 1e300, 0.045, 99.995, 33.335, 5e-324]
    random.seed(3)
    values += [random.randint(0, 10**7) / 8 for _ in range(500)] + [(random.randint(0, 10**6) + 0.5) / 100 for _ in range(2000)] + [random.uniform(-1e6, 1e6) for _ in range(500)]
    values += [math.nextafter((k + 0.5) / 100, s * math.inf) for k in range(300) for s in (1, -1)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 2, 4):
        got = [r[0] for r in df.select(round_half_even(F.col("x"), digits)).collect()]
        assert got == [float(round(v, digits)) for v in values]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "x double").select(round_half_even(F.col("x")))
    assert repr([r[0] for r in odd.collect()]) == "[None, nan, inf]"
    with pytest.raises(ValueError):
        round_half_even(F.col("x"), 7)


def test_inference_is_enqueued_once(spark):
    jobs = spark.createDataFrame(
        [(1, 1, 1, "wssed_inference", 0, "COMPLETED", NOW), (2, 1, 1, "manual", 0, "FAILED", NOW), (3, 2, 1, "wssed_inference", 0, "COMPLETED", "2024-01-01"), (4, 2, 1, "wssed_inference", 0, "FAILED", NOW)],
        "id long, model_checkpoint_id long, dataset_id long, trigger string, feedback_count long, status string, created_at string",
    ).withColumn("created_at", F.to_timestamp("created_at"))
    training = spark.createDataFrame([(1, 1, 1, None), (2, 2, 1, None), (3, 2, 1, None), (4, 3, 1, None), (5, 2, 2, 77)], "id long, model_checkpoint_id long, dataset_id long, inference_job_id long")
    checkpoints = spark.createDataFrame([(1, 5), (2, 5), (3, 0)], "id long, resolved_snippet_set_id long")
    after, linked = platform.enqueued(jobs, training, checkpoints, F.to_timestamp(F.lit(NOW)))
    assert rows(linked, "id", "inference_job_id") == [(1, 1), (2, 6), (3, 6), (4, None), (5, 77)]
    assert rows(after.where("id > 4"), "id", "model_checkpoint_id", "status") == [(6, 2, "PENDING")]
    # a second run finds what the first one enqueued
    again = platform.enqueued(after, training, checkpoints, F.to_timestamp(F.lit(NOW)))[0]
    assert again.count() == after.count()


def test_invitations(spark):
    invitations = spark.createDataFrame([(1, None), (2, 4)], "id long, used_count long")
    invited = spark.createDataFrame([(1, 10), (1, 11), (1, 12)], "invitation_id long, dataset_id long")
    uses = spark.createDataFrame([(1, 5), (1, 6)], "invitation_id long, user_id long")
    datasets = spark.createDataFrame([(10, 3), (11, 3), (12, None)], "id long, team_id long")
    members = spark.createDataFrame([(5, 3, "member")], "user_id long, team_id long, role string")
    grants = spark.createDataFrame([], "user_id long, dataset_id long, granted_by_invitation_id long")
    m, g, i = platform.redeemed(invitations, invited, uses, datasets, members, grants)
    assert rows(m) == [(5, 3, "member"), (6, 3, "owner")]
    assert rows(g) == [(5, 12, 1), (6, 12, 1)]
    assert rows(i) == [(1, 2), (2, 4)]
    team = spark.createDataFrame([(7, 3, "member", 0)], "id long, team_id long, target_role string, used_count long")
    m, i = platform.redeemed_team(team, spark.createDataFrame([(7, 5), (7, 9)], "invitation_id long, user_id long"), members)
    assert rows(m) == [(5, 3, "member"), (9, 3, "member")] and rows(i, "used_count") == [(1,)]


def test_teams_and_focal_datasets(spark):
    members = spark.createDataFrame([(1, 3, "owner"), (2, 3, "member"), (2, 4, None)], "user_id long, team_id long, role string")
    asked = spark.createDataFrame([(1, False, 3), (2, False, 3), (3, False, 3), (4, True, 9), (2, False, 4)], "user_id long, is_admin boolean, team_id long")
    got = {(r.user_id, r.team_id): (r.may_see, r.may_manage) for r in platform.team_access(asked, members).collect()}
    assert got[1, 3] == (True, True) and got[2, 3] == (True, False) and got[3, 3] == (False, False) and got[4, 9] == (True, True)
    datasets = spark.createDataFrame([(1, 3, "FOCAL_RECORDINGS"), (2, None, "FOCAL_RECORDINGS"), (3, 3, "PAM")], "id long, team_id long, dataset_type string")
    users = spark.createDataFrame([(1, False), (5, False), (6, True)], "user_id long, is_admin boolean")
    grants = spark.createDataFrame([(1, 1), (1, 2)], "user_id long, dataset_id long")
    assert rows(stats.focal_access(users, datasets, members, grants)) == [(1, 2, True), (5, 0, False), (6, 2, True)]
    assert rows(stats.focal_access(users, datasets.limit(0), members, grants), "n_focal", "enabled") == [(0, False), (0, False), (0, True)]


def test_coordinates_are_reused(spark):
    points = spark.createDataFrame(
        [(1, None, 5, 10, 1.0, 2.0), (1, None, 6, 10, 8.0, 8.0), (1, None, 5, 11, 3.0, 4.0), (1, 70, 4, 10, 0.0, 9.0), (2, None, 5, 12, 7.0, 7.0)],
        "dataset_id long, model_checkpoint_id long, embedding_model_id long, snippet_id long, pca_2d_x double, pca_3d_z double",
    )
    checkpoints = spark.createDataFrame([(70, 1, 5), (71, 9, 5)], "id long, dataset_id long, embedding_model_id long")
    flat = platform.reused_coordinates(points, checkpoints, False).where("model_checkpoint_id is not null")
    assert rows(flat, "snippet_id", "embedding_model_id", "pca_2d_x", "pca_3d_z") == [(10, 5, 1.0, 9.0), (11, 5, 3.0, None)]
    deep = platform.reused_coordinates(points, checkpoints, True).where("model_checkpoint_id is not null")
    assert rows(deep, "snippet_id", "pca_3d_z") == [(10, 2.0), (11, 4.0)]


def test_columnar_points(spark):
    points = spark.createDataFrame([(i, float(i), None, 1.0 if i == 3 else None) for i in (12, 3, 1)], "snippet_id long, a_x double, a_z double, b_z double")
    got = {r.first_id: r for r in platform.columnar(points, 10).collect()}
    assert got[0].snippet_ids == [1, 3] and got[0].a_x == [1.0, 3.0] and got[0].a_z is None and got[0].b_z == [None, 1.0]
    assert got[10].b_z == [None]
    assert platform.columnar(points.limit(0), 10).count() == 0


def test_suggestions(spark):
    remote = spark.createDataFrame([("gbif:1", "Blue tit", None, 1), ("gbif:2", "Tit", None, 2), ("gbif:3", "Titan", None, 3)], "id string, canonical_name string, scientific_name string, position long")
    trees = spark.sql("SELECT 'custom:x' AS taxonomy_id, 1 AS position, 'active' AS status, parse_json('{\"nodes\": [{\"id\": \"n\", \"name\": \"Great tit\"}]}') AS tree")
    assert [r.id for r in taxonomy.suggest(remote, trees, "tit", None, 3).collect()] == ["gbif:2", "gbif:3", "gbif:1"]
    assert [r.id for r in taxonomy.suggest(remote, trees, "tit", " , ", 50).collect()] == ["gbif:2", "gbif:3", "gbif:1", "n"]
    assert [r.id for r in taxonomy.suggest(remote, trees, "tit", "custom:x", 3).collect()] == ["n"]
    assert [r.id for r in taxonomy.suggest(remote, trees, "tit", "gbif", 2).collect()] == ["gbif:2", "gbif:1"]
    assert taxonomy.suggest(remote, trees, "tit", "custom:y", 3).count() == 0
    with pytest.raises(ValueError):
        taxonomy.suggest(remote, trees, "", None, 3)


def test_labels_keep_the_order_of_predictions(spark):
    df = spark.createDataFrame([(2, 1, ["b", " a "]), (1, 1, ["c", "", "b"]), (3, 1, None), (4, 2, [None])], "id long, snippet_id long, predicted_labels array<string>")
    assert rows(label_state.predicted_labels(df)) == [(1, ["c", "b", "a"])]


def test_repeats_and_changes(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (1, "a", None), (2, "b", 5)], "id long, k string, v long")
    assert rows(upsert.without_repeats(df, ["k", "v"])) == [(1, "a", None), (2, "b", 5)]
    taxa = spark.createDataFrame([(1, "n", "d", "active", None), (2, "m", "d", "active", None)], "id long, name string, description string, status string, updated_at timestamp")
    changes = spark.createDataFrame([(1, None, "archived"), (9, "x", "x")], "id long, name string, status string")
    out = platform.changed(taxa, changes, F.to_timestamp(F.lit(NOW)))
    assert rows(out.withColumn("touched", F.col("updated_at").isNotNull()), "id", "name", "status", "touched") == [(1, "n", "archived", True), (2, "m", "active", False)]


def test_paths_and_picks(spark):
    df = spark.createDataFrame([({"preferred": "", "best_micro_model": "m"}, "o"), (None, "o"), ({}, None)], "p map<string,string>, o string")
    assert [r[0] for r in df.select(L.preferred_path(F.col("p"), F.col("o"))).collect()] == ["m", "o", None]
    items = F.array(F.lit("a"), F.lit("b"))
    one = spark.range(1).select(L.picked(items, F.array(F.lit(2), F.lit(2), F.lit(0), F.lit(3))).alias("p"), L.skipped(items, F.array(F.lit(2), F.lit(2), F.lit(0), F.lit(3))).alias("s")).first()
    assert one.p == ["b"] and one.s == 3


def test_measurements_keep_their_first_columns(spark, tmp_path):
    path = f"file://{tmp_path}/measured"
    tables.append_measurements(spark.createDataFrame([("a", 1.5, "x")], "stage string, seconds double, extra string"), path, ["stage", "seconds"])
    tables.append_measurements(spark.createDataFrame([("b", 7)], "stage string, other long"), path, ["other"])
    back = spark.read.csv(path, header=True)
    assert back.columns == ["stage", "seconds"] and rows(back) == [("a", "1.5"), ("b", None)]


def test_ground_truth_without_names_or_labels(spark):
    df = spark.createDataFrame([(" a.wav ", "s"), ("", "s"), (None, "s"), ("b.wav", "zzz"), ("c.wav", None)], "file_name string, label string")
    assert rows(tables.ground_truth(df, ["s", "t"])) == [("a.wav", ["s"]), ("b.wav", []), ("c.wav", [])]
    with pytest.raises(ValueError):
        tables.ground_truth(df.drop("label"), ["s"])


def test_draws_are_disjoint(spark):
    ids = spark.range(100).select(F.col("id").alias("snippet_id"))
    pool, labelled = [{r[0] for r in x.collect()} for x in platform.disjoint_draws(ids, 70, 30)]
    assert len(pool) == 70 and len(labelled) == 30 and not pool & labelled
    pool, labelled = [{r[0] for r in x.collect()} for x in platform.disjoint_draws(ids, 90, 30)]
    assert len(labelled) == 30 and labelled <= pool


def test_events_are_counted_since_the_retrain(spark):
    feedback = spark.createDataFrame([(1, 1, "2024-01-01"), (2, 1, "2024-03-01"), (3, None, "2024-01-01"), (4, None, "2024-03-01"), (5, 2, "2024-01-01")], "id long, model_checkpoint_id long, created_at string")
    jobs = spark.createDataFrame([(1, "COMPLETED", "manual", "2024-02-01"), (None, "COMPLETED", "manual", "2024-01-01"), (2, "FAILED", "manual", "2024-02-01")], "model_checkpoint_id long, status string, trigger string, completed_at string")
    assert rows(label_state.events_since_retrain(feedback, jobs)) == [(1, 1), (2, 1), (None, 1)]


def test_datasets_that_are_asked_for(spark):
    old = spark.createDataFrame([(1, 3, "a"), (2, None, "b")], "id long, team_id long, source_uri string")
    asked = [(10, False, None, "a"), (11, True, None, "b"), (12, True, None, "a"), (13, False, 3, "a"), (14, False, 9, "a"), (15, False, 3, "zz"), (16, False, 3, "b"), (17, True, 3, "b"), (18, False, 3, None)]
    new = spark.createDataFrame(asked, "id long, is_admin boolean, team_id long, source_uri string")
    teams, paths = spark.createDataFrame([(3,)], "id long"), spark.createDataFrame([("a",), ("b",)], "path string")
    after, errors = platform.created_datasets(old, new, teams, paths)
    d = "duplicate_dataset"
    assert {r.id: r.error for r in errors.collect()} == {
        10: "team_id_required", 11: d, 12: None, 13: d, 14: "team_not_found", 15: "invalid_source_uri", 16: None, 17: d, 18: "invalid_source_uri"
    }
    assert sorted(r.id for r in after.collect()) == [1, 2, 12, 16]


def test_repeated_memberships_and_removals_meet_each_row_once(spark):
    """Joins by few keys that many rows repeat: the rows that a join makes or compares follow the input."""
    rows = spark.range(3000)
    gone = rows.selectExpr("id % 3 as snippet_id", "id % 2 as user_id")
    annotations = rows.selectExpr("id", "id % 3 as snippet_id", "id % 2 as user_id", "case when id % 5 = 0 then '{\"source\": \"active_learning\"}' end as metadata")
    out = canonical.unlearned(annotations, gone)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_s" in plan and out.count() == 2400 and out.columns == annotations.columns
    users = spark.range(3).selectExpr("id as user_id", "id = 2 as is_admin")
    datasets = rows.selectExpr("id", "id % 2 as team_id", "'FOCAL_RECORDINGS' as dataset_type")
    found = stats.focal_access(users, datasets, rows.selectExpr("id % 2 as user_id", "id % 2 as team_id"), rows.selectExpr("id % 2 as user_id", "id % 4 as dataset_id"))
    assert sorted(tuple(r) for r in found.collect()) == [(0, 1500, True), (1, 1500, True), (2, 3000, True)]
    made = [int(m.value()) for m in joined_rows(found)]
    assert made and max(made) <= 3000


def joined_rows(frame):
    """The counts of rows that the joins of a collected frame made."""
    todo, out = [frame._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        if "Join" in node.nodeName():
            out.append(node.metrics().apply("numOutputRows"))
        inner = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if "QueryStage" in node.nodeName() else None
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())] + ([inner] if inner is not None else [])
    return out


def test_existing_segments_are_not_broadcast(spark):
    recordings = spark.range(50).selectExpr("id", "30 as duration")
    new = segment.new_snippets(segment.segment(recordings, 3.0, 1.5), segment.segment(recordings, 3.0, 3.0))
    assert new.count() == 50 * 9
    assert "BroadcastHashJoin" not in new._jdf.queryExecution().executedPlan().toString()
