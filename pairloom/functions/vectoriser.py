"""User-supplied vectorisers with heavy state built once per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def with_vectoriser(
    df: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str
) -> DataFrame:
    """Apply a batch function to ``df``; ``factory`` runs once per task, before the first batch,
    and returns the function (frame of rows -> frame with ``schema``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transform = factory()
        for batch in batches:
            yield transform(batch)

    return df.mapInPandas(run, schema)
