"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["TOKENIZER", "encoding", "token_count", "with_tokens"]

#: Default path of the ranks; any tiktoken file of a public byte-level BPE will do.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pre-tokenization pattern of these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_READ: dict[bytes, object] = {}


def encoding(ranks: str | bytes = TOKENIZER):
    """The tokenizer of the ranks in a file, or in its content; each is built once in a process."""
    import tiktoken

    if isinstance(ranks, str):
        with open(ranks, "rb") as f:
            ranks = f.read()
    if ranks not in _READ:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        _READ[ranks] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _READ[ranks]


def token_count(text: Column | str, spark: SparkSession, path: str = TOKENIZER) -> Column:
    """Number of tokens of a whole text; 0 for null and empty. Special tokens' strings are ordinary text.

    The driver reads the file and broadcasts it (a vocabulary of a fixed size), so executors need no copy of it.
    """
    with open(path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = encoding(ranks.value)
        for s in parts:
            yield pd.Series([len(t.encode_ordinary(x)) if x else 0 for x in s], dtype="int64")

    return F.pandas_udf(run, "bigint")(text)


def with_tokens(documents: DataFrame, path: str = TOKENIZER, text: str = "text") -> DataFrame:
    """``doc_id, source, n_tokens`` of every document: the text stays behind."""
    source = F.col("source") if "source" in documents.columns else F.lit(None).cast("string")
    return documents.select("doc_id", source.alias("source"), token_count(F.col(f"`{text}`"), documents.sparkSession, path).alias("n_tokens"))
