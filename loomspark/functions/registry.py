"""The library's functions by name for SQL: normalisation without Python, Arrow functions, and packing as a table function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import FOLD_FROM, FOLD_TO
from loomspark.operators.tokenize import ENCODERS, Vocabulary, decode_ids
from loomspark.sources.extract import json_line_text


class PackTokens:
    """The token arrays of a partition, in the order given, cut into sequences of length + 1; the tail is dropped.

    ``SELECT * FROM pack_tokens(TABLE(t) PARTITION BY (k) ORDER BY (o), 512)`` over a table (k, tokens) with the key first in the result. A partition
    is packed by one task that holds one sequence at a time; ``operators.pack.pack`` packs a whole table in many.
    """

    def __init__(self) -> None:
        self.key, self.held, self.n = None, [], 0

    def eval(self, row: Row, length: int) -> Iterator[tuple]:
        self.key = row["k"]
        self.held.extend(row["tokens"] or [])
        at = 0
        while len(self.held) - at > length:
            yield self.key, self.n, self.held[at : at + length + 1]
            self.n, at = self.n + 1, at + length + 1
        del self.held[:at]


def register(spark: SparkSession, vocabulary: Vocabulary | None = None, algorithm: str = "bpe") -> list[str]:
    """Register the functions for a session and return their names; those that encode and decode need a vocabulary."""
    names = ["normalize_text", "json_line_text", "pack_tokens"]
    quoted = lambda s: s.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_text(t STRING) RETURNS STRING RETURN translate(lower(t), '{quoted(FOLD_FROM)}', '{quoted(FOLD_TO)}')")
    spark.udf.register("json_line_text", F.pandas_udf(lambda s: s.map(lambda x: json_line_text(x or "")), "string"))
    spark.udtf.register("pack_tokens", F.udtf(PackTokens, returnType="k string, seq_id long, tokens array<int>"))
    if vocabulary is not None:
        one, shared = ENCODERS[algorithm], spark.sparkContext.broadcast(vocabulary)

        def encode(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: one(t or "", shared.value))

        def decode(ids: pd.Series) -> pd.Series:
            return ids.map(lambda x: decode_ids([] if x is None else list(x), shared.value))

        spark.udf.register("encode_text", F.pandas_udf(encode, "array<int>"))
        spark.udf.register("decode_ids", F.pandas_udf(decode, "string"))
        names += ["encode_text", "decode_ids"]
    return names
