"""User function surface (U1, U2): Arrow-batched, never row-at-a-time.

``map_batches`` is the batched-map-with-column-replacement contract: a
function gets a pandas batch and returns new columns; the ``keep``
columns ride along so results join back.  ``score_batches`` loads a
scorer once per Python worker task (iterator form) and applies it to
every batch of sequences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                keep: tuple = ()) -> DataFrame:
    """``fn(batch) -> DataFrame`` of new columns; input columns other than ``keep`` are dropped."""
    keep = list(keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = fn(pdf)
            if keep:
                out = pd.concat([pdf[keep].reset_index(drop=True), out.reset_index(drop=True)], axis=1)
            yield out

    return df.mapInPandas(run, schema=schema)


def score_batches(seqs: DataFrame, load_fn: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
                  schema: str) -> DataFrame:
    """``load_fn()`` builds the scorer once per task; the scorer maps each batch to rows of ``schema``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load_fn()
        for pdf in batches:
            yield scorer(pdf)

    return seqs.mapInPandas(run, schema=schema)
