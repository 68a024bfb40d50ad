"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import cache

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that goes with the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@cache
def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column | str, path: str = VOCABULARY) -> Column:
    """The number of tokens of a text; 0 for null and empty ones."""

    @F.arrow_udf("long")
    def count(a: pa.Array) -> pa.Array:
        encode = encoding(path).encode_ordinary
        return pa.array([0 if not t else len(encode(t)) for t in a.to_pylist()], pa.int64())

    return count(text)


def sized(documents: DataFrame, *columns: str, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and the named columns, computed once and kept: texts are encoded a single time."""
    from cairn.session import cut

    return cut(documents.select("doc_id", *columns, n_tokens("text", path).alias("n_tokens")))
