"""Measures over streams: the grains of a model as event-time windows, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RequestError
from ..expr import build
from ..functions import AGGREGATES
from ..model import Kind

_WINDOWS = {"second": "1 second", "minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days"}


def measures(k: Kind, names: list[str]) -> list[Column]:
    """Aggregates of a dataset's measures over the rows of a stream; those that need all rows at once can't stream."""
    out = []
    for n in names:
        m = k.measures[n]
        if m.agg in ("count_distinct", "median", "percentile_cont", "string_agg"):
            raise RequestError("STREAM_E_AGG", f"{m.agg} of {n} needs all rows at once; approx_count_distinct can stream")
        x = build(m.expr, F.col) if m.expr is not None else F.col(n)
        for f in m.filters:
            x = F.when(build(f, F.col), x)
        out.append(AGGREGATES[m.agg](x, *m.args).alias(n))
    return out


def rollup(stream: DataFrame, k: Kind, axis: str, grain: str, dims: list[str], names: list[str], watermark: str = "0 seconds", slide: str | None = None) -> DataFrame:
    """dims, the start of each window as axis, and measures. State is kept until the watermark passes a window's end.

    Weeks start on Mondays; months and longer have no fixed length and can't be windows of a stream.
    """
    if grain not in _WINDOWS:
        raise RequestError("STREAM_E_GRAIN", f"{grain} isn't a window of fixed length")
    w = F.window(axis, _WINDOWS[grain], slide, "4 days" if grain == "week" else None)
    grouped = stream.withWatermark(axis, watermark).groupBy(w, *dims).agg(*measures(k, names))
    return grouped.select(F.col("window.start").alias(axis), *dims, *names)


def sessions(stream: DataFrame, k: Kind, axis: str, gap: str, dims: list[str], names: list[str], watermark: str = "0 seconds") -> DataFrame:
    """Measures of sessions: rows of equal dims with no gap as long as that between them."""
    grouped = stream.withWatermark(axis, watermark).groupBy(F.session_window(axis, gap), *dims).agg(*measures(k, names))
    return grouped.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *dims, *names)
