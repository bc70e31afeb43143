"""The seam for model calls: a scorer takes batches and gives a column; the offline one is deterministic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[pd.Series], pd.Series]


def offline_scorer(texts: pd.Series) -> pd.Series:
    """0 to 10 from the text's length and letters: a stand-in for a model, the same on every run."""
    return pd.Series([(len(t or "") * 7 + sum(map(ord, (t or "")[:50]))) % 101 / 10 for t in texts], dtype=float)


def scored(df: DataFrame, text: str, scorer: Scorer = offline_scorer, into: str = "promise", failed: float | None = None) -> DataFrame:
    """df with the scorer's column. A batch that raises gives `failed` for its rows, so one bad call loses no others."""

    @F.pandas_udf("double")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            try:
                yield scorer(batch)
            except Exception:  # noqa: BLE001  whatever a remote call raises
                yield pd.Series([failed] * len(batch), dtype=float)

    return df.withColumn(into, call.asNondeterministic()(F.col(text)))


def indexed_verdicts(reply: Column, count: Column, pattern: str = r"(\d+)\s*:\s*([A-Z]+)", missing: str = "P") -> Column:
    """Verdicts of items 1 to count from a reply like `1:P 2:X`; items that the reply leaves out get `missing`."""
    at = F.transform(F.regexp_extract_all(reply, F.lit(pattern), F.lit(1)), lambda x: x.try_cast("int"))
    verdict = F.regexp_extract_all(reply, F.lit(pattern), F.lit(2))
    pairs = F.arrays_zip(at.alias("at"), verdict.alias("verdict"))
    return F.transform(F.sequence(F.lit(1), count), lambda i: F.coalesce(F.try_element_at(F.filter(pairs, lambda p: p["at"] == i), F.lit(1))["verdict"], F.lit(missing)))
