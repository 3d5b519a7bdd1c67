"""Attention over blocks of positions: partial results of a query block and a key block, merged associatively.

Blocks travel as tiles of many positions, and a task merges the blocks of a tile before anything leaves it, so that what is shuffled and written grows with the number of tiles, not of blocks.

For a query, a set of keys and values with scores s gives (m, l, o): the largest score, the sum of exp(s - m), and the sum of exp(s - m) * v. Two such results for other
keys make one of their union, so that keys can be taken block by block in any order. A key tile is sent to the query tiles that may see
it and meets them, with all query heads of its group, in an equi-join on sequence, key head and tile; a task computes one pair of tiles at a time, and
results are merged by groups of at most ``FAN_IN``, level by level. So a sequence of any length is never in one task, nor joined with itself row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.modelmath import kv_head
from loomspark.session import arrow_batches, materialize

BLOCK = 256
TILE = 4096  # positions that travel together
ROWS = 4  # pairs of tiles in a batch
FAN_IN = 32


def _matrix(rows: pa.ListScalar, field: str) -> np.ndarray:
    """A field of a list of structs as [row, component]."""
    column = rows.values.field(field)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _tile_scores(head: int, at: np.ndarray, q: np.ndarray, kat: np.ndarray, k: np.ndarray, v: np.ndarray, causal: bool, window: int | None, alibi: bool, block: int):
    """(m, l, o) of the queries over the keys of a tile, a block of keys at a time; m is -inf where none is seen."""
    n = len(at)
    m, l, o = np.full(n, -np.inf), np.zeros(n), np.zeros((n, v.shape[1]))
    slope = 2.0 ** (-8 - head)
    for lo in range(0, len(kat), block):
        part = kat[lo : lo + block]
        back = at[:, None] - part[None]
        seen = back >= 0 if causal else np.ones_like(back, bool)
        if window is not None:
            seen &= np.abs(back) <= window
        some = np.flatnonzero(seen.any(1))
        if not len(some):
            continue
        score = q[some] @ k[lo : lo + block].T / np.sqrt(q.shape[1])
        if alibi:
            score -= np.maximum(back[some], 0) * slope
        score[~seen[some]] = -np.inf
        top = np.maximum(m[some], score.max(1))
        weight = np.exp(score - top[:, None])
        old = np.exp(m[some] - top)
        m[some], l[some], o[some] = top, l[some] * old + weight.sum(1), o[some] * old[:, None] + weight @ v[lo : lo + block]
    return m, l, o


def _pair_scores(causal: bool, window: int | None, alibi: bool, block: int):
    schema = pa.schema([("seq", pa.int64()), ("head", pa.int32()), ("pos", pa.int64()), ("block", pa.int64()), ("m", pa.float64()), ("l", pa.float64()), ("o", pa.list_(pa.float64()))])
    step = max(block, 256)  # the scores of so many queries and keys are held at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq, tile, queries, keys in zip(*batch.columns, strict=True):
                order = np.argsort(keys.values.field("pos").to_numpy(), kind="stable")
                kat, k, v = keys.values.field("pos").to_numpy()[order], _matrix(keys, "k")[order], _matrix(keys, "v")[order]
                heads, places, q = queries.values.field("head").to_numpy(), queries.values.field("pos").to_numpy(), _matrix(queries, "q")
                for head in np.unique(heads):
                    mine = np.flatnonzero(heads == head)
                    mine = mine[np.argsort(places[mine], kind="stable")]
                    for lo in range(0, len(mine), step):
                        some = mine[lo : lo + step]
                        at = places[some]
                        near = np.ones(len(kat), bool)
                        if causal:
                            near &= kat <= at[-1]
                        if window is not None:
                            near &= (kat >= at[0] - window) & (kat <= at[-1] + window)
                        m, l, o = _tile_scores(int(head), at, q[some], kat[near], k[near], v[near], causal, window, alibi, step)
                        there = m > -np.inf
                        n = int(there.sum())
                        if n:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([seq.as_py()] * n, pa.int64()), pa.array([head] * n, pa.int32()), pa.array(at[there]), pa.array([tile.as_py()] * n, pa.int64()), pa.array(m[there]), pa.array(l[there]), pa.array(list(o[there]), pa.list_(pa.float64()))], schema=schema
                            )

    return run


def merge_partials(parts: DataFrame, levels: int) -> DataFrame:
    """(seq, head, pos, m, l, o) of all keys, from (seq, head, pos, block, m, l, o) by key block."""
    for _ in range(max(levels, 1)):
        grouped = parts.groupBy("seq", "head", "pos", F.floor(F.col("block") / FAN_IN).alias("block")).agg(F.max("m").alias("top"), F.collect_list(F.struct("m", "l", "o")).alias("p"))
        factor = lambda x: F.exp(x["m"] - F.col("top"))
        total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x["l"] * factor(x))
        start = F.transform(F.get("p", F.lit(0))["o"], lambda _: F.lit(0.0))
        out = F.aggregate("p", start, lambda s, x: F.zip_with(s, x["o"], lambda a, b: a + b * factor(x)))
        parts = grouped.select("seq", "head", "pos", "block", F.col("top").alias("m"), total.alias("l"), out.alias("o"))
    return parts.drop("block")


def blocked_attention(
    queries: DataFrame, keys: DataFrame, heads: int, kv_heads: int, causal: bool = True, window: int | None = None, alibi: bool = False, block: int = BLOCK
) -> DataFrame:
    """(seq, head, pos, out) from queries (seq long, head int, pos long, q) and keys (seq, kv_head, pos, k, v[, pad]); arrays are of doubles.

    Query heads share key-value heads by groups. Keys with a true ``pad`` are seen by nobody; a query that sees no key has no row. Null positions are left out.
    """
    if "pad" in keys.columns:
        keys = keys.where(~F.coalesce("pad", F.lit(False)))
    longest = queries.agg(F.max("pos")).first()[0] or 0
    tile = max(TILE // block, 1) * block
    last = longest // tile
    levels, n = 1, last + 1
    while n > FAN_IN:
        n, levels = -(-n // FAN_IN), levels + 1
    of = F.floor(F.col("pos") / tile)
    # A query head belongs to one key head, and travels with the others of its group.
    grouped = queries.where(f"pos IS NOT NULL AND head >= 0 AND head < {heads}").withColumn("kv_head", kv_head(F.col("head"), heads, kv_heads))
    q = grouped.groupBy("seq", "kv_head", of.alias("qtile")).agg(F.collect_list(F.struct("head", "pos", "q")).alias("queries"))
    k = keys.where("pos IS NOT NULL").groupBy("seq", "kv_head", of.alias("tile")).agg(F.collect_list(F.struct("pos", "k", "v")).alias("keys"))
    reach = F.lit(last) if window is None else F.least(F.lit(last), F.floor(((F.col("tile") + 1) * tile - 1 + window) / tile))
    first = F.col("tile") if causal else F.lit(0) if window is None else F.greatest(F.lit(0), F.floor((F.col("tile") * tile - window) / tile))
    # A key tile, once for each query tile that may see it.
    sent = k.where(first <= reach).select("seq", "kv_head", "tile", "keys", F.explode(F.sequence(first.cast("long"), reach.cast("long"))).alias("qtile"))
    pairs = q.join(sent, ["seq", "kv_head", "qtile"]).select("seq", "tile", "queries", "keys")
    parts = pairs.mapInArrow(_pair_scores(causal, window, alibi, block), "seq long, head int, pos long, block long, m double, l double, o array<double>")
    with arrow_batches(queries.sparkSession, ROWS):
        parts = materialize(parts, "attention-parts")
    done = merge_partials(parts, levels)
    return done.select("seq", "head", "pos", F.transform("o", lambda x: x / F.col("l")).alias("out"))
