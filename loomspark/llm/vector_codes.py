"""Vector codes by product quantisation with integer codebooks.

Every component x becomes the integer floor(SCALE * x). Vectors are cut into equal consecutive parts, and each part
position has a codebook of its own. It starts from the vectors of least id; each round broadcasts the codebooks, assigns every
part to its nearest entry, and replaces each entry by the floor of the mean of its parts. Arrow batches compute all
distances of a part position at once by norm expansion, |x|^2 - 2 x.c + |c|^2, with exact int64 matrix products; the first
least one wins. A task sums its parts for each entry before the shuffle, and the sums are merged by a grouped
aggregation, so a round moves entries * dimension numbers a task, however often a vector is repeated. The codebooks
(entries * dimension integers) are all that reaches the driver.

All is exact: where a batch or the codebooks hold integers so large that int64 distances could overflow, the same products run on
Python's integers.

Edge cases: rows whose vector is null or holds null, NaN or infinite components are dropped. Integers beyond 2^62 are set to it.
Vectors shorter than the longest kept one, or whose length is no multiple of the parts, count as padded with zeros at their end; an
empty vector is all zeros. A repeated vec_id is coded row by row, and starts a codebook entry once, with its least
vector; null ids come last. With fewer ids than entries the codebooks are as much smaller. Errors beyond a long are set to its
maximum. An empty table gives no rows and empty codebooks; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.session import materialize

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LARGEST = 1 << 62
MAX_LONG = (1 << 63) - 1


@dataclass
class Codebooks:
    """Integer entries [part, entry, position]; an object array where int64 is too small."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        """Digest of the decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()


def kept_rows(vectors: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes of the rows that are coded, the lengths of their vectors, and their components as one float64 array."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()  # of the rows that are not null
    value = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    good = size >= 0
    good[row[~np.isfinite(value)]] = False
    return np.flatnonzero(good), size[good], value[good[row]]


def integers(size: np.ndarray, value: np.ndarray, width: int, scale: int = SCALE) -> np.ndarray:
    """[row, component] of floor(scale * x), padded with zeros to the width."""
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)] = np.clip(np.floor(value * scale), -LARGEST, LARGEST).astype(np.int64)
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes [row, part] and squared distances [row, part] of integer vectors [row, component]."""
    parts, _, width = entries.shape
    cut = x.reshape(len(x), parts, width)
    largest = max(int(abs(x).max(initial=0)), int(abs(entries).max(initial=0)))
    kind = np.int64 if 4 * largest * largest * width < 1 << 63 else object
    cut, entries = cut.astype(kind, copy=False), entries.astype(kind, copy=False)
    code, least = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), kind)
    for p in range(parts):
        of = cut[:, p]
        distance = (of * of).sum(1)[:, None] - 2 * (of @ entries[p].T) + (entries[p] * entries[p]).sum(1)[None, :]
        code[:, p] = np.argmin(distance, 1)
        least[:, p] = np.take_along_axis(distance, code[:, p, None], 1)[:, 0]
    return code, least


def _codebooks_from(rows: list, width: int, parts: int) -> np.ndarray:
    entries = np.zeros((len(rows), width), np.int64)
    for n, r in enumerate(rows):
        entries[n, : len(r)] = r
    return entries.reshape(len(rows), parts, width // parts).transpose(1, 0, 2).copy()


def _first_vectors(vectors: DataFrame, entries: int, scale: int) -> tuple[list, int]:
    """Vectors of the least ids, and the length of the longest kept vector."""
    kind = dict(vectors.dtypes)["vec_id"]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The least ids of each batch with their vectors, and one row with the batch's greatest length."""
        for batch in batches:
            at, size, value = kept_rows(batch.column(1))
            if len(at):
                ids = batch.column(0).take(pa.array(at))
                known = ids.unique()
                known = known.take(pc.array_sort_indices(known, null_placement="at_end")[:entries])
                few = np.flatnonzero(pc.is_in(ids, value_set=known).to_numpy(zero_copy_only=False))
                ends = np.cumsum(size)
                vectors = [integers(size[i : i + 1], value[ends[i] - size[i] : ends[i]], size[i], scale)[0].tolist() for i in few]
                longest = [int(size.max())] * len(few)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(few)), pa.array(vectors, pa.list_(pa.int64())), pa.array(longest, pa.int64())], names=["vec_id", "x", "longest"])

    found = vectors.select("vec_id", "embedding").mapInArrow(candidates, f"vec_id {kind}, x array<long>, longest long")
    least = found.groupBy("vec_id").agg(F.min("x").alias("x"), F.max("longest").alias("longest")).persist()
    try:
        longest = least.agg(F.max("longest")).first()[0] or 0
        return [r.x for r in least.orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()], longest
    finally:
        least.unpersist()


def train_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of all kept ``vectors`` (vec_id, embedding) after so many rounds."""
    rows, longest = _first_vectors(vectors, entries, scale)
    width = -(-longest // parts) * parts
    books = _codebooks_from(rows, width, parts)
    if not books.size:
        return Codebooks(books)
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds):
        sent = context.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            """A task's count and component sums for each entry that it uses."""
            of = sent.value
            n = np.zeros(of.shape[:2], np.int64)
            total = np.zeros(of.shape, object)
            for batch in batches:
                at, size, value = kept_rows(batch.column(0))
                if not len(at):
                    continue
                x = integers(size, value, width, scale)
                code, _ = nearest(x, of)
                cut = x.reshape(len(x), *of.shape[::2])
                kind = np.int64 if int(abs(x).max(initial=0)) * len(x) < 1 << 62 else object
                for p in range(of.shape[0]):
                    chosen = (code[:, p, None] == np.arange(of.shape[1])).astype(np.int64)
                    n[p] += chosen.sum(0)
                    total[p] += (chosen.T.astype(kind) @ cut[:, p].astype(kind)).astype(object)
            part, entry = np.nonzero(n)
            if len(part):
                w = of.shape[2]
                values = [Decimal(int(v)) for v in total[part, entry].ravel()]
                columns = [pa.array(np.repeat(part, w), pa.int32()), pa.array(np.repeat(entry, w), pa.int32()), pa.array(np.tile(np.arange(w), len(part)), pa.int32()), pa.array(values, pa.decimal128(38, 0)), pa.array(np.repeat(n[part, entry], w))]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "position", "total", "n"])

        got = vectors.select("embedding").mapInArrow(sums, "part int, entry int, position int, total decimal(38,0), n long")
        merged = got.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        sent.destroy()
        books = books.astype(object)
        for r in merged:
            books[r.part, r.entry, r.position] = int(r.total) // int(r.n)
        books = books.astype(np.int64)  # means of integers within LARGEST stay within it
    return Codebooks(books)


def encode(vectors: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error) of every kept row: two hex digits a part, and the squared distances summed over the parts."""
    types = dict(vectors.dtypes)
    schema = f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"
    rows = vectors.select("vec_id", "label", "embedding")
    if not books.entries.size:  # only vectors without components are kept, if any
        return rows.where(F.size("embedding") == 0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    sent = vectors.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for batch in batches:
            at, size, value = kept_rows(batch.column(2))
            code, distance = nearest(integers(size, value, of.shape[0] * of.shape[2], scale), of)
            digits = code.astype(np.uint8).tobytes().hex()
            step = 2 * of.shape[0]
            text = [digits[i : i + step] for i in range(0, len(digits), step)]
            exact = distance.dtype == object or int(distance.max(initial=0)) * of.shape[0] > MAX_LONG
            error = [min(int(e), MAX_LONG) for e in distance.astype(object).sum(1)] if exact else distance.sum(1)
            pick = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, schema)


def report(vectors: DataFrame) -> DataFrame:
    """Codes and errors of every kept row, the error of all rows of its label, and the digest of the codebooks."""
    books = train_codebooks(vectors)
    coded = materialize(encode(vectors, books), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MAX_LONG).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    joined = coded.join(by_label, coded["label"].eqNullSafe(by_label["_label"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
