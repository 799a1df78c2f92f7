"""The hook for a text generator supplied by the caller."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Generator(Protocol):
    """Anything that answers a batch of prompts in order."""

    def generate(self, prompts: Sequence[str]) -> Sequence[str]: ...


def generate(prompts: DataFrame, generator: Generator, prompt: str = "prompt") -> DataFrame:
    """Add ``raw_response``.  Runs per Arrow batch on the executors; everything
    before and after stays native."""
    schema = T.StructType([*prompts.schema.fields, T.StructField("raw_response", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(generator.generate(batch[prompt].tolist()))
            if len(texts) != len(batch):
                raise RuntimeError(f"generator gave {len(texts)} texts for {len(batch)} prompts")
            yield batch.assign(raw_response=texts)

    return prompts.mapInPandas(run, schema)
