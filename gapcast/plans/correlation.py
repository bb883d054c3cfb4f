"""How the columns of a history hang together, seen from one label."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from gapcast.functions.calendar import calendar_features
from gapcast.operators.binning import finite_ranges, histograms, scatter_pairs
from gapcast.operators.correlation import corr_with_label
from gapcast.operators.profile import describe_all
from gapcast.schema import TIMESTAMP, numeric_columns


@dataclass
class CorrelationReport:
    profile: DataFrame
    correlations: DataFrame
    pairs: DataFrame
    histograms: DataFrame


def correlation_report(
    history: DataFrame,
    label: str,
    timestamp: str | None = TIMESTAMP,
    tz: str = "UTC",
    fraction: float | None = None,
    seed: int = 0,
    bins: int = 10,
    nulls: str = "zero",
) -> CorrelationReport:
    """Profile, correlations with the label, pair densities and histograms.

    Densities cover every row; ``fraction`` takes a sample for them instead.
    """
    table = history if timestamp is None else calendar_features(history, timestamp, tz, as_int=True)
    columns = numeric_columns(table)
    ranges = finite_ranges(table, columns)
    profile = describe_all(table)
    return CorrelationReport(
        profile,
        corr_with_label(table, label, columns, nulls),
        scatter_pairs(table, columns, bins, ranges, fraction, seed),
        histograms(table, columns, bins, ranges, fraction, seed),
    )
