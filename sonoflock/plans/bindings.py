"""Views that bind the entities of the data model to the tables at hand.

Each is a DataFrame and the SQL of a common table expression with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "datasets": (
        "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS team_id, "
        "CASE WHEN c_custkey % 4 = 0 THEN 'FOCAL_RECORDINGS' ELSE 'PAM' END AS dataset_type FROM customer"
    ),
    "recordings": (
        "SELECT o_orderkey AS id, o_custkey AS dataset_id, concat('data/ds', CAST(o_custkey AS STRING), '/', o_orderpriority, '/LOC', "
        "CAST(o_orderkey % 7 AS STRING), '_', CAST(o_orderkey AS STRING), '.wav') AS file_path, concat('LOC', CAST(o_orderkey % 7 AS STRING), "
        "'_', CAST(o_orderkey AS STRING), '.wav') AS file_name, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 5000 END AS duration, "
        "CASE WHEN o_orderkey % 13 = 0 THEN 'harbour' WHEN o_orderkey % 13 = 1 THEN '' ELSE NULL END AS noted, o_orderdate AS created_at FROM orders"
    ),
    "snippets": (
        "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS recording_id, CAST(l_suppkey % 3 AS BIGINT) AS snippet_set_id, "
        "l_linenumber * 3.0E0 AS start_time, l_linenumber * 3.0E0 + 3.0E0 AS end_time FROM lineitem"
    ),
    "annotations": (
        "SELECT l_orderkey * 100 + l_linenumber AS id, concat('Species ', CAST(l_partkey % 40 AS STRING)) AS resolved_name_snapshot, "
        "l_orderkey * 10 + l_linenumber AS snippet_id, CAST(l_suppkey % 17 AS BIGINT) AS user_id, concat('gbif:', CAST(l_partkey % 40 AS STRING)) "
        "AS taxon_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount * 10 END AS confidence, l_shipdate AS created_at FROM lineitem WHERE l_quantity > 30"
    ),
    "feedback": (
        "SELECT event_id AS id, event_id % 97 AS snippet_id, user_id, CASE event_type WHEN 'purchase' THEN 'ACCEPT' WHEN 'click' THEN 'MODIFY' ELSE "
        "'REJECT' END AS action, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('sp', CAST(event_id % 5 AS STRING)) END AS label, ts AS created_at, "
        "event_id % 4 AS model_checkpoint_id FROM events"
    ),
    "al_labels": (
        "SELECT vec_id AS snippet_id, concat('sp', CAST(label AS STRING)) AS label, CASE WHEN vec_id % 10 = 0 THEN 'ground_truth' ELSE 'user' END AS source, "
        "CASE WHEN vec_id % 10 = 0 THEN NULL ELSE vec_id % 7 END AS user_id FROM embeddings WHERE vec_id % 5 = 0"
    ),
    "feeds": (
        "SELECT event_id AS id, user_id, event_type AS method, ts AS created_at, event_id % 9 AS dataset_id FROM events"
    ),
    "jobs": (
        "SELECT o_orderkey AS id, o_custkey AS model_checkpoint_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status, "
        "CASE WHEN o_orderkey % 3 = 0 THEN 'auto_feedback' WHEN o_orderkey % 3 = 1 THEN 'manual' ELSE 'initial' END AS trigger, o_orderdate AS created_at, "
        "CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE NULL END AS started_at FROM orders"
    ),
    "confirmed": (
        "SELECT CAST(floor(event_id / 2) AS BIGINT) AS id, CAST(floor(event_id / 2) AS BIGINT) % 50 + 1 AS dataset_id, CAST(floor(event_id / 2) AS BIGINT) % 97 AS snippet_id, "
        "CASE WHEN CAST(floor(event_id / 2) AS BIGINT) % 11 = 10 THEN NULL ELSE CAST(floor(event_id / 2) AS BIGINT) % 11 END AS user_id, CASE event_id % 7 "
        "WHEN 0 THEN concat('gbif:', CAST(event_id % 40 AS STRING)) WHEN 1 THEN concat(' Species ', CAST(event_id % 12 AS STRING), ' ') "
        "WHEN 2 THEN concat('code', CAST(event_id % 6 AS STRING)) WHEN 3 THEN concat('envo:', CAST(event_id % 3 AS STRING)) WHEN 4 THEN NULL WHEN 5 THEN '  ' "
        "ELSE concat('odd:', CAST(event_id % 3 AS STRING)) END AS label FROM events"
    ),
    "said": (
        "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey % 97 AS snippet_id, CAST(l_linenumber AS BIGINT) AS user_id, concat('gbif:', CAST(l_partkey % 40 AS STRING)) AS taxon_id, "
        "concat('Species ', CAST(l_partkey % 40 AS STRING)) AS resolved_name_snapshot, CASE WHEN l_suppkey % 3 = 0 THEN 'active_learning' WHEN l_suppkey % 3 = 1 THEN 'import' "
        "ELSE NULL END AS origin FROM lineitem"
    ),
    "set_labels": (
        "SELECT l_orderkey * 10 + l_linenumber AS snippet_id, l_orderkey % 50 AS dataset_id, concat('Species ', CAST(l_partkey % 40 AS STRING)) AS label, "
        "CASE WHEN l_partkey % 4 = 0 THEN 'ground_truth' ELSE 'user' END AS source, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_suppkey % 7 END AS user_id FROM lineitem WHERE l_quantity > 20"
    ),
    "team_taxonomies": (
        "SELECT CAST(n_nationkey AS BIGINT) AS id, concat('custom:', md5(concat('t', CAST(n_nationkey AS STRING)))) AS taxonomy_id, CAST(n_nationkey AS BIGINT) AS team_id, "
        "concat('code', CAST(n_nationkey % 5 AS STRING)) AS name, n_name AS description, 'active' AS status FROM nation"
    ),
    "memberships": (
        "SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS team_id, s_suppkey % 10 AS user_id, CASE WHEN s_suppkey % 3 = 0 THEN 'owner' ELSE 'member' END AS role FROM supplier"
    ),
    "training_jobs": (
        "SELECT p_partkey AS id, p_partkey % 20 + 1 AS model_checkpoint_id, p_partkey % 3 AS dataset_id, CASE WHEN p_size > 40 THEN p_partkey ELSE NULL END AS inference_job_id FROM part"
    ),
    "inferences": (
        "SELECT o_orderkey AS id, o_custkey % 40 AS model_checkpoint_id, o_orderkey % 3 AS dataset_id, CASE WHEN o_orderkey % 5 = 0 THEN 'manual' ELSE 'wssed_inference' END AS trigger, "
        "CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'COMPLETED' ELSE 'PENDING' END AS status, o_orderdate AS created_at FROM orders WHERE o_custkey % 2 = 0"
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; the table is read with only the columns that are used."""
    text = VIEWS[name]
    source = text.split(" FROM ")[1].split()[0]
    return spark.sql(text.replace(f" FROM {source}", " FROM {t}"), t=read(spark, sf_dir, source))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(sql: str, *names: str) -> str:
    """SQL with the views it uses before it."""
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {views}{',' if sql.lstrip().upper().startswith('WITH ') else ''}\n{sql.lstrip()[5:] if sql.lstrip().upper().startswith('WITH ') else sql}"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("snippet_id"), F.col("embedding").alias("vector"), F.concat(F.lit("sp"), "label").alias("label")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snippet_id, probs): ten labels, each a sigmoid of one number of the vector."""
    v = read(spark, sf_dir, "embeddings")
    keys = F.array(*[F.lit(f"sp{i}") for i in range(10)])
    probs = F.transform(F.slice("embedding", 1, 10).cast("array<double>"), lambda x: 1 / (1 + F.exp(-4 * x)))
    return v.select(F.col("vec_id").alias("snippet_id"), F.map_from_arrays(keys, probs).alias("probs"))


#: predictions() as SQL, one row for each label.
PREDICTIONS_SQL = (
    "SELECT vec_id AS snippet_id, concat('sp', CAST(i AS VARCHAR)) AS label, 1 / (1 + exp(-4 * CAST(embedding[i + 1] AS DOUBLE))) AS p "
    "FROM embeddings, (SELECT unnest(range(10)) AS i)"
)
