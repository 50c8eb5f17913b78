"""Token counters: the one measure of length, from the vocabulary file of a public tokenizer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TokenCounter:
    """Tokens of a text by a vocabulary: a tokenizer's .json, or a sentence piece .model.

    Made on the driver of the file's bytes, a few MB, which go to the workers
    with the function that uses it; each worker loads them once.
    """

    def __init__(self, content: bytes, name: str):
        self.content, self.name, self.encode = content, name, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"encode": None}

    def _load(self) -> Callable[[str], int]:
        if self.name.endswith(".json"):
            from tokenizers import Tokenizer

            model = Tokenizer.from_buffer(self.content)
            model.encode_special_tokens = True
            return lambda text: len(model.encode(text, add_special_tokens=False).ids)
        if self.name.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_proto=self.content)
            return lambda text: len(model.encode(text))
        raise ValueError(f"no tokenizer is known for {self.name}")

    def __call__(self, text: str) -> int:
        if self.encode is None:
            self.encode = self._load()
        return self.encode(text)


def load_counter(spark: SparkSession, path: str) -> TokenCounter:
    """A counter of a vocabulary file in any store that Spark reads."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    return TokenCounter(bytes(row["content"]), path)


def n_tokens(counter: Callable[[str], int], text: Column) -> Column:
    """Tokens of a text; null has none."""

    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: counter(t) if t else 0)

    return run(text)
