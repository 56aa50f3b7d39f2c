"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=4)
def encoder(vocabulary: str):  # noqa: ANN201
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text; 0 for a null or empty one. Special tokens' names count as ordinary text."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(vocabulary).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def sized(documents: DataFrame, *keep: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """`doc_id`, the columns to keep, and `n_tokens`. Rows without doc_id name no text and are left out."""
    return documents.where(F.col("doc_id").isNotNull()).select("doc_id", *keep, token_count(F.col("text"), vocabulary).alias("n_tokens"))
