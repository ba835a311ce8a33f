"""Models on the executors: loaded by the worker that first needs them, once per worker process."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import shipped

_LOADED: dict[str, Any] = {}


def loaded(key: str, loader: Callable[[], Any]) -> Any:
    """What ``loader`` gives, called once for a key in this process."""
    if key not in _LOADED:
        _LOADED[key] = loader()
    return _LOADED[key]


def model_column(loader: Callable[[], Callable[[list], list]], kind: T.DataType | str) -> Callable[..., Column]:
    """A function of Columns backed by a model. ``loader`` gives a function from a batch (a list of values, or of tuples
    where there are several columns) to a list of results, and is called on the executors only.

    An embedder is ``model_column(load, "array<double>")``, a captioner of image bytes or a summariser of texts
    ``model_column(load, "string")``, a cross-encoder of (query, text) ``model_column(load, "double")``.
    """
    key = uuid.uuid4().hex

    @shipped
    def made(*columns: Column) -> Column:
        if len(columns) == 1:

            @F.pandas_udf(kind)
            def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                model = loaded(key, loader)
                for batch in batches:
                    yield pd.Series(model(list(batch)), dtype="object")

            return one(*columns)

        @F.pandas_udf(kind)
        def several(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            model = loaded(key, loader)
            for batch in batches:
                yield pd.Series(model(list(zip(*batch))), dtype="object")

        return several(*columns)

    return made
