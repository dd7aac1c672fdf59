"""Functions for use in SQL: registered for a session by one call.

Scalar functions are temporary SQL functions, which Catalyst inlines; segmentation is a table
function, one call for each recording of a lateral join.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

DOT = "aggregate(zip_with({0}, {1}, (x, y) -> double(x) * double(y)), 0D, (acc, x) -> acc + x)"
SCALARS = {
    # V1
    "cosine_similarity": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"{DOT.format('a', 'b')} / (sqrt({DOT.format('a', 'a')}) * sqrt({DOT.format('b', 'b')}))"),
    # V3
    "unit_distance": ("similarity DOUBLE", "DOUBLE", "sqrt(greatest(0D, 2D - 2D * similarity))"),
    # V4: mean binary entropy in bits
    "label_uncertainty": (
        "probs ARRAY<DOUBLE>", "DOUBLE",
        "greatest(0D, least(1D, -aggregate(probs, 0D, (acc, p) -> acc + p * ln(p + 1e-12D) + (1 - p) * ln(1 - p + 1e-12D)) / size(probs) / ln(2D)))",
    ),
    # A11
    "any_label": ("probs ARRAY<DOUBLE>", "DOUBLE", "1D - aggregate(probs, 1D, (acc, p) -> acc * (1D - greatest(0D, least(1D, p))))"),
}


@F.udtf(returnType="start_time double, end_time double")
class Segments:
    """M1 for one recording: windows that fit, their starts summed up step by step."""

    def eval(self, duration: float, window: float, step: float) -> Iterator[tuple[float, float]]:
        if step is not None and step <= 0:
            raise ValueError("the step must be positive")
        start = 0.0
        while None not in (duration, window, step) and start + window <= duration:
            yield start, start + window
            start += step


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session's SQL; returns their names."""
    for name, (arguments, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("segments_of", Segments)
    return [*SCALARS, "segments_of"]
