"""Expressions over arrays of numbers. All arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """V1: 1 minus the cosine distance; norms are always divided by."""
    return dot(a, b) / (norm(a) * norm(b))


def l2_normalise(v: Column) -> Column:
    """V2"""
    size = F.greatest(norm(v), F.lit(EPS))
    return F.transform(doubles(v), lambda x: x / size)


def unit_distance(similarity: Column) -> Column:
    """V3: Euclidean distance of unit vectors of a given cosine."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * similarity))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def uncertainty(probs: Column) -> Column:
    """Mean binary entropy of an array of probabilities, in bits, within 0 to 1."""
    h = total(F.transform(probs, lambda p: p * F.ln(p + EPS) + (1 - p) * F.ln(1 - p + EPS)))
    return clamp(-h / F.size(probs) / F.ln(F.lit(2.0)))


def noisy_or(probs: Column) -> Column:
    """The chance of at least one; 0 for none."""
    return 1 - F.aggregate(probs, F.lit(1.0), lambda acc, p: acc * (1 - clamp(p)))


def composite(u: Column, d: Column, s: Column, weights: tuple[float, float, float]) -> Column:
    """V7: weighted mean of uncertainty, diversity and density; 0 if weights don't add up."""
    whole = sum(weights)
    if whole <= 0:
        return F.lit(0.0)
    return u * (weights[0] / whole) + d * (weights[1] / whole) + s * (weights[2] / whole)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clamp(p, eps, 1 - eps)
    return F.ln(q / (1 - q))


def relu(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def pos_weight(pos: Column, n: Column) -> Column:
    """V12"""
    return F.when(pos > 0, (n - pos) / F.greatest(pos, F.lit(1))).otherwise(F.lit(1.0))
