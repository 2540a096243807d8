"""Boosted squared-error regression on the residuals of a base forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidecast.operators.boost import Boosted, boost_rows, flagged, squared


def fit_residual_boost(
    train: DataFrame, valid: DataFrame | None, label: str, key: Sequence[str], series: Sequence[str] = (), **options
) -> Boosted:
    """Trees grown on all series, with leaf values per series where ``series`` names its columns.

    ``options`` as in ``boost_rows``. A model for each series alone would have to find its splits in the rows of that
    series; here the splits are found once, in all rows, and only the leaves are told apart, so the work does not grow
    with the number of series and a short series falls back on the others.
    """
    columns = ["features", label, *key, *series]
    return boost_rows(flagged(train, valid, columns), label, key, loss=squared(), series=series, **options)


def fit_residual_cells(cells: DataFrame, series: Sequence[str] = (), **options) -> Boosted:
    """As ``fit_residual_boost``, from rows that ``boost.alike`` has brought together; no subsample is drawn of them."""
    return boost_rows(cells, "y", (), loss=squared(), series=series, **options)
