"""Streaming forms: score filter and windowed label evidence over late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scantable.functions.exprs import safe_double


def scored(stream: DataFrame, score: str, least: float) -> DataFrame:
    """Rows of a stream with a finite score of at least so much; stateless."""
    return stream.where(safe_double(score) >= least)


def windowed_evidence(stream: DataFrame, time: str, label: str, value: str, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(start, label, n, evidence) per tumbling window; rows later than the watermark are dropped, state is bounded by it."""
    w = F.window(time, width)
    out = stream.withWatermark(time, late).groupBy(w, label).agg(F.count(F.lit(1)).alias("n"), F.sum(safe_double(value, 0.0)).alias("evidence"))
    return out.select(F.col("window.start").alias("start"), label, "n", "evidence")


def distinct_records(stream: DataFrame, id_col: str, time: str, late: str = "30 minutes") -> DataFrame:
    """First delivery of every record within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([id_col])
