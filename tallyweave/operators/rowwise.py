"""A function of the caller run over rows in batches: the hook for models and other opaque work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def mapped_rows(df: DataFrame, key: str, column: str, result: str, call: Callable[[pd.Series], list] | None = None) -> DataFrame:
    """``key`` and the fields of ``result`` (a DDL row) for each row: what ``call`` gives for the values of ``column``.

    ``call`` takes a batch and returns a dict or None for each value, None for a NULL included. A
    value it has nothing for, and every value if there is no ``call``, has NULL in all fields.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in result.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = call(pdf[column]) if call else [None] * len(pdf)
            yield pd.DataFrame({key: pdf[key], **{n: [(g or {}).get(n) for g in got] for n in names}})

    return df.select(key, column).mapInPandas(run, f"{key} {kind}, {result}")
