"""Changes of tables by key, as functions from the old table to the new one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of keys in which NULL equals NULL."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows take the place of old ones of equal keys, all columns;
    columns that new rows lack become NULL. new has each key once."""
    new = new.alias("n")
    kept = old.join(new, same(old, new, keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True).select(*old.columns)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't there yet, each key once, are added."""
    fresh = new.dropDuplicates(keys)
    return old.unionByName(fresh.join(old, same(fresh, old, keys), "left_anti"), allowMissingColumns=True)


def delete(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of these keys go."""
    return old.join(gone, same(old, gone, keys), "left_anti")


def conflicts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are there already, or more than once among the new rows."""
    twice = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    there = new.join(old, same(new, old, keys), "left_semi").select(*keys)
    return twice.unionByName(there).distinct()


def update(old: DataFrame, keys: list[str], supplied: DataFrame) -> DataFrame:
    """P20: the columns that the update has, NULL included, of the rows that it names."""
    columns = [c for c in supplied.columns if c not in keys]
    renamed = supplied.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    met = reduce(lambda a, b: a & b, [old[k].eqNullSafe(renamed[f"_{k}"]) for k in keys])
    out = old.join(renamed, met, "left")
    return out.select(*[F.when(F.col("_there"), F.col(f"_{c}")).otherwise(old[c]).alias(c) if c in columns else old[c] for c in old.columns])


def fill_in(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values where there are any, else the old ones."""
    renamed = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = old.join(renamed, old[key] == F.col("_key"), "left")
    return out.select(*[F.coalesce(F.col(f"_{c}"), old[c]).alias(c) if c in columns else old[c] for c in old.columns])


def cascade(root: DataFrame, gone: DataFrame, children: list[tuple[DataFrame, str]]) -> list[DataFrame]:
    """What stays of a chain of tables after rows of the first are deleted. Each child names
    the column that holds its parent's id."""
    out, kept = [root.join(gone, "id", "left_anti")], None
    parent_gone = gone.select("id")
    for child, column in children:
        dead = child.join(parent_gone.select(F.col("id").alias("_gone")), child[column] == F.col("_gone"), "left_semi")
        kept = child.join(parent_gone.select(F.col("id").alias("_gone")), child[column] == F.col("_gone"), "left_anti")
        out.append(kept)
        parent_gone = dead.select("id") if "id" in child.columns else dead.select(F.col(column).alias("id"))
    return out


def protected_delete(sets: DataFrame, snippets: DataFrame, annotations: DataFrame) -> DataFrame:
    """Which snippet sets may go, with what they hold: those without annotations."""
    n = annotations.groupBy("snippet_id").agg(F.count(F.lit(1)).alias("n"))
    held = snippets.join(n, snippets["id"] == F.col("snippet_id"), "left").groupBy("snippet_set_id").agg(
        F.count(F.lit(1)).alias("n_snippets"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_annotations")
    )
    whole = sets.join(held, sets["id"] == F.col("snippet_set_id"), "left").na.fill(0, ["n_snippets", "n_annotations"])
    return whole.select("id", "n_snippets", "n_annotations", (F.col("n_annotations") == 0).alias("may_delete"))


def without_repeats(rows: DataFrame, keys: list[str], id_column: str = "id") -> DataFrame:
    """Of rows of equal keys, NULL included, the one with the smallest id stays, and of equal
    ids the one whose other columns are smallest. One aggregate, with no join of the table to itself."""
    rest = [id_column, *[c for c in rows.columns if c not in (*keys, id_column)]]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_first"))
    return first.select(*keys, "_first.*").select(*rows.columns)
