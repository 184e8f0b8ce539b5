"""Extension points: scorers and classifiers of texts that are loaded once for each worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

#: A loader returns a function of a list of texts; null texts come as empty ones.
Loader = Callable[[], Callable[[list[str]], Sequence[float]]]


def _udf(load: Loader, kind):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = load()
        for texts in batches:
            out = list(f(texts.fillna("").tolist()))
            if len(out) != len(texts):
                raise ValueError("a scorer gives one value for each text")
            yield pd.Series(out)

    return run


def scorer(load: Loader, text: str = "text") -> Column:
    """A score (double) of each text."""
    return _udf(load, DoubleType())(F.col(text))


def classifier(load: Loader, text: str = "text") -> Column:
    """A domain (long) of each text."""
    return _udf(load, LongType())(F.col(text))


def extract(df: DataFrame, scorers: Sequence[Loader], domain: Loader, criteria: int, text: str = "text") -> DataFrame:
    """Add q0, q1, ... and domain. As many scorers as criteria are needed."""
    if len(scorers) != criteria:
        raise ValueError(f"{criteria} criteria need as many scorers, not {len(scorers)}")
    return df.withColumns({f"q{i}": scorer(s, text) for i, s in enumerate(scorers)} | {"domain": classifier(domain, text)})
