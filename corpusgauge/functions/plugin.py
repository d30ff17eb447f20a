"""Hook for a caller's batch scorer (a model, a rule set)."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Scorer = Callable[[pd.Series], pd.Series]


def score_batches(df: DataFrame, column: str, scorer: Scorer, keep: Sequence[str], batch: int = 256) -> DataFrame:
    """Run ``scorer`` on mini-batches of one column; keeps the listed columns."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start : start + batch]
                yield part[list(keep)].assign(score=scorer(part[column]).astype(float).to_numpy())

    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*[f"`{c}` {fields[c]}" for c in keep], "score double"])
    return df.select(*keep, column).mapInPandas(run, schema)


def lexicon_scorer(lexicon: Sequence[tuple[str, float]]) -> Scorer:
    """Default scorer: mean lexicon value of the words in each array."""
    values = dict(lexicon)

    def score(words: pd.Series) -> pd.Series:
        def one(ws) -> float | None:
            hits = [values[w] for w in ws if w in values]
            return sum(hits) / len(hits) if hits else None

        return pd.Series([one(ws) for ws in words], dtype="float64")

    return score
