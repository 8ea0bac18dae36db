"""The hook for a user's batch encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def encode_missing(clips: DataFrame, artifacts: DataFrame, kind: str, encode: Callable[[pd.DataFrame], pd.DataFrame], payload: str, schema: str) -> DataFrame:
    """Run `encode` on batches of clips that lack an artifact of `kind`; clips without a payload get a placeholder (no token length).

    `encode` takes the clips' columns and returns (stem, token_len) in the given schema. What exists is
    left alone, so that the result can be appended again and again.
    """
    todo = clips.join(artifacts.where(F.col("kind") == kind), "stem", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            empty = f[payload].isna() | (f[payload] == "")
            if (~empty).any():
                yield encode(f[~empty])
            yield pd.DataFrame({"stem": f["stem"][empty], "token_len": pd.array([None] * int(empty.sum()), "Int32")})

    return todo.mapInPandas(run, schema).withColumn("kind", F.lit(kind))
