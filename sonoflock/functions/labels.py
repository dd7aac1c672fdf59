"""Expressions over arrays and maps of labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonoflock.functions.text import NO_EVENT


def normalised(labels: Column) -> Column:
    """trimmed, without NULL, empty and placeholder labels, each once, in order."""
    trimmed = F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "") & (F.lower(x) != "string")))


def above(probs: Column, threshold: float = 0.3) -> Column:
    """Labels whose probability reaches the threshold, by name; none is one of its own."""
    hit = F.sort_array(F.map_keys(F.map_filter(probs, lambda _, p: p >= threshold)))
    return F.when(F.size(hit) == 0, F.array(F.lit(NO_EVENT))).otherwise(hit)


def probability_map(order: Column, probs: Column) -> Column:
    """C2"""
    return F.map_from_arrays(order, probs)


def multi_hot(labels: Column, order: list[str]) -> Column:
    """0 or 1 for each label of an order; others are ignored."""
    return F.array(*[F.coalesce(F.array_contains(labels, x), F.lit(False)).cast("int") for x in order])


def from_multi_hot(row: Column, order: list[str]) -> Column:
    """C4"""
    names = F.array(*map(F.lit, order))
    hit = F.filter(names, lambda x: F.element_at(row, F.array_position(names, x).cast("int")) == 1)
    return F.when(F.size(hit) == 0, F.array(F.lit(NO_EVENT))).otherwise(hit)


def in_scope(probs: Column, scope: list[str] | None) -> Column:
    """The probabilities of some labels, as an array."""
    return F.map_values(probs if scope is None else F.map_filter(probs, lambda k, _: k.isin(*scope)))


def confirmed_negative(labels: Column) -> Column:
    """C17"""
    return F.array_distinct(labels).eqNullSafe(F.array(F.lit(NO_EVENT)))


def resolved(action: Column, predicted: Column, incoming: Column) -> Column:
    """What a feedback action makes the labels; NULL for a MODIFY without labels."""
    given = normalised(incoming)
    none = F.array().cast("array<string>")
    return (
        F.when(action == "ACCEPT", F.coalesce(predicted, none))
        .when((action == "MODIFY") & (F.size(given) > 0), given)
        .when(action == "REJECT", none)
    )


def label_order(candidates: list[Column], n_classes: int) -> Column:
    """C14: the first candidate of the right length, or names made up."""
    made_up = F.array(*[F.lit(f"class_{i}") for i in range(n_classes)])
    return F.coalesce(*[F.when(F.size(c) == n_classes, c) for c in candidates], made_up)


def merged(old: Column, new: Column) -> Column:
    """Two maps, the right one wins."""
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)


def picked(items: Column, indexes: Column) -> Column:
    """Items at 1-based places, in the order asked for; places out of range are skipped."""
    good = F.filter(F.array_distinct(indexes), lambda i: (i >= 1) & (i <= F.size(items)))
    return F.transform(good, lambda i: F.element_at(items, i))


def without(items: Column, label: str) -> Column:
    """D13, C8"""
    return F.array_remove(items, label)


def with_new(items: Column, label: str) -> Column:
    """Appended unless it is there."""
    return F.when(F.array_contains(items, label), items).otherwise(F.concat(items, F.array(F.lit(label))))


def whole_quick_labels(items: Column) -> Column:
    """Quick labels with both fields."""
    return F.filter(items, lambda x: x["taxon_id"].isNotNull() & x["display_name"].isNotNull())


def ordered_union(lists: Column) -> Column:
    """F8: labels of several lists, each once, in order."""
    return normalised(F.flatten(lists))


def skipped(items: Column, indexes: Column) -> Column:
    """How many places asked for picked() leaves out, as out of range or asked for before."""
    return F.size(indexes) - F.size(picked(items, indexes))


def preferred_path(paths: Column, otherwise: Column) -> Column:
    """The path of the model that is preferred, of the best segment model, of the best model,
    or another; empty ones don't count."""
    names = ("preferred", "best_micro_model_segment", "best_micro_model")
    return F.coalesce(*[F.nullif(F.try_element_at(paths, F.lit(n)), F.lit("")) for n in names], otherwise)
