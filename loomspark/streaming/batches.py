"""Streaming batches: a shuffle buffer kept as state between micro-batches, and token files cut into chunks that a stream resumes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomspark.operators.pack import line_window_count, line_windows
from loomspark.session import arrow_batches, discard, materialize, shuffle_width
from loomspark.sources.readers import token_lines

LINES = 1024  # of a batch that is numbered
ORDER = ["lane", "batch", "pos", "seq_id", "filled"]
FRAME = 50_000  # rows of a frame that a lane gives out
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started in the block keep their state in RocksDB, which ``shuffled_stream`` needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _draw(*parts: object) -> str:
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


class _ShuffleBuffer(StatefulProcessor):
    """Of one lane: sequences that wait, the batch that is not full yet, and how many rounds and batches there were."""

    row = "seq_id long, tokens array<int>"

    def __init__(self, length: int, size: int, seed: int, drop_last: bool) -> None:
        self.length, self.size, self.seed, self.drop_last = length, size, seed, drop_last
        self.room = min(10 * size, 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getListState("buffer", self.row)
        self.open = handle.getListState("open", self.row)
        self.place = handle.getValueState("place", "round long, batch long")

    def _batch(self, lane: int, batch: int, rows: list[tuple], own: int) -> pd.DataFrame:
        pairs = []
        for pos, (_, tokens) in enumerate(rows):
            one, two = list(tokens[: self.length]), list(tokens[1 : self.length + 1])
            if pos >= own and self.length > 1:  # a repeat: one in ten has two neighbours swapped
                d = _draw(self.seed, "swap", lane, batch, pos)
                if int(d[:8], 16) % 10 == 0:
                    k = int(d[8:16], 16) % (self.length - 1)
                    for x in (one, two):
                        x[k], x[k + 1] = x[k + 1], x[k]
            pairs.append((one, two))
        return pd.DataFrame({
            "lane": lane, "batch": batch, "pos": range(len(rows)), "seq_id": [r[0] for r in rows],
            "input": [p[0] for p in pairs], "target": [p[1] for p in pairs], "filled": [n >= own for n in range(len(rows))],
        })

    def _come(self, rows: pd.DataFrame) -> Iterator[tuple]:
        rows = rows[rows["tokens"].notna()].sort_values("seq_id", kind="stable")
        for seq_id, tokens in zip(rows["seq_id"], rows["tokens"], strict=True):
            if len(tokens) > self.length:
                yield int(seq_id), [int(t) for t in tokens]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.buffer.get()) if self.buffer.exists() else []
        full = list(self.open.get()) if self.open.exists() else []
        turn, batch = self.place.get() if self.place.exists() else (0, 0)
        lane, come = int(key[0]), pd.concat(list(rows))
        ended = bool(come["last"].fillna(False).astype(bool).any())

        def taken(n: int) -> Iterator[object]:
            """The first n sequences of a round in hash order go to the batches."""
            nonlocal held, full, turn, batch
            held.sort(key=lambda r: (_draw(self.seed, turn, lane, r[0]), r[0]))
            for row in held[:n]:
                full.append(row)
                if len(full) == self.size:
                    yield self._batch(lane, batch, full, self.size)
                    full, batch = [], batch + 1
            held, turn = held[n:], turn + 1

        for row in self._come(come):
            held.append(row)
            if len(held) >= 2 * self.room:
                yield from taken(self.room)
        if ended:
            yield from taken(len(held))
            if full and not self.drop_last:
                own = len(full)
                full += [full[int(_draw(self.seed, "fill", lane, batch, pos)[:8], 16) % own] for pos in range(own, self.size)]
                yield self._batch(lane, batch, full, own)
                batch += 1
            full = []
        for state, values in ((self.buffer, held), (self.open, full)):
            if values:
                state.put(values)
            else:
                state.clear()
        self.place.update((turn, batch))

    def close(self) -> None:
        pass


class _ShuffleOrder(_ShuffleBuffer):
    """The same over ids alone."""

    row = "seq_id long"

    def _come(self, rows: pd.DataFrame) -> Iterator[tuple]:
        ids = rows["seq_id"].to_numpy()[(rows["n"] > self.length).to_numpy(bool)]
        return ((i,) for i in np.sort(ids, kind="stable").tolist())

    def _batch(self, lane: int, batch: int, rows: list[tuple], own: int) -> list[tuple]:
        return [(lane, batch, pos, row[0], pos >= own) for pos, row in enumerate(rows)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in super().handleInputRows(key, rows, timerValues):
            held += batch
            if len(held) >= FRAME:
                yield pd.DataFrame(held, columns=ORDER)
                held = []
        if held:
            yield pd.DataFrame(held, columns=ORDER)


def shuffled_order(sizes: DataFrame, length: int, size: int, seed: int, lanes: int, drop_last: bool = False) -> DataFrame:
    """(lane, batch, pos, seq_id, filled) of the batches that ``shuffled_stream`` makes, from a stream of (seq_id, n, last), n the number of tokens.

    A lane is one task, so only ids pass it; ``with_tokens`` brings the sequences to their places over all tasks.
    """
    rows = sizes.select(F.pmod("seq_id", F.lit(lanes)).cast("int").alias("lane"), "seq_id", F.coalesce("n", F.lit(0)).alias("n"), "last")
    return rows.groupBy("lane").transformWithStateInPandas(_ShuffleOrder(length, size, seed, drop_last), "lane int, batch long, pos int, seq_id long, filled boolean", "Append", "None")


def with_tokens(order: DataFrame, sequences: DataFrame, length: int, seed: int) -> DataFrame:
    """Rows of ``shuffled_order`` with ``input`` and ``target`` as in ``shuffled_stream``, from a table of (seq_id, tokens)."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("swap"), *[F.col(c).cast("string") for c in ("lane", "batch", "pos")]))
    number = lambda at: F.conv(F.substring("_draw", at, 8), 16, 10).cast("long")
    at = F.when(F.col("filled") & F.lit(length > 1) & (number(1) % 10 == 0), (number(9) % max(length - 1, 1)).cast("int"))
    placed = order.select("*", draw.alias("_draw")).select("lane", "batch", "pos", "seq_id", "filled", at.alias("_at"))
    rows = placed.join(sequences.select("seq_id", F.col("tokens").cast("array<int>").alias("_t")), "seq_id")

    def swapped(x: Column) -> Column:
        k = F.col("_at")
        two = F.array(F.get(x, k + 1), F.get(x, k))
        return F.when(k.isNull(), x).otherwise(F.concat(F.slice(x, F.lit(1), k), two, F.slice(x, k + 3, F.greatest(F.lit(length - 2) - k, F.lit(0)))))

    one, two = F.slice("_t", 1, length), F.slice("_t", 2, length)
    return rows.select("lane", "batch", "pos", "seq_id", swapped(one).alias("input"), swapped(two).alias("target"), "filled")


def shuffled_stream(sequences: DataFrame, length: int, size: int, seed: int, lanes: int, drop_last: bool = False) -> DataFrame:
    """Batches of exactly ``size`` sequences from a stream of (seq_id, tokens, last), in ``lanes`` buffers that run side by side.

    A buffer takes up sequences of over ``length`` tokens until it holds twice its room (room: ten batches, at most 1,000), then gives as
    many as its room to the batches, in an order drawn by hash of seed, round, lane and seq_id; what is left waits, as does a batch that is not full,
    until later micro-batches bring more, or a restart does. A row with ``last`` ends its lane (``end_rows``): what waits is
    given out, and the last batch is dropped or filled with repeats of its own sequences, one in ten with two neighbours swapped.

    The order inside a micro-batch is that of seq_id; state is at most 2 * room sequences a lane. Start it in a ``rocksdb_state`` block.
    """
    rows = sequences.select(F.pmod("seq_id", F.lit(lanes)).cast("int").alias("lane"), "seq_id", F.col("tokens").cast("array<int>").alias("tokens"), "last")
    out = "lane int, batch long, pos int, seq_id long, input array<int>, target array<int>, filled boolean"
    return rows.groupBy("lane").transformWithStateInPandas(_ShuffleBuffer(length, size, seed, drop_last), out, "Append", "None")


def end_rows(spark: SparkSession, lanes: int) -> DataFrame:
    """Rows that end each lane of a stream; write them to its folder after all others."""
    return spark.range(lanes).select(F.col("id").alias("seq_id"), F.lit(None).cast("array<int>").alias("tokens"), F.lit(True).alias("last"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, base, ..., n) with the sum of n before each row inside its block, from the base on, in place of the base; a block's rows come one after the other."""
    at, done = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks, n = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), batch.column(batch.num_columns - 1).to_numpy()
        starts = [0, *(i for i in range(1, len(blocks)) if blocks[i] != blocks[i - 1])]
        places = np.cumsum(n) - n
        for lo, hi in zip(starts, [*starts[1:], len(blocks)], strict=True):
            if blocks[lo] != at:
                at, done = blocks[lo], batch.column(2)[lo].as_py()
            places[lo:hi] += done - places[lo]
            done = int(places[hi - 1] + n[hi - 1])
        yield batch.set_column(2, batch.schema.names[2], pa.array(places, pa.int64()))


def write_chunks(spark: SparkSession, path: str, out: str, length: int, size: int = 1000) -> None:
    """The sequences of token files (windows of length + 1 in each line) as chunks of at most ``size``, for ``read_chunks``: a Parquet file each, or one from each file block that holds a part of it.

    A sequence keeps its file, the line's place among the lines that the file's block holds, and its place in the line: a stream over the chunks
    resumes at the next chunk after a restart, and says of every sequence where it stands. Sequences are counted in each file block, and a block's lines are numbered from the sum of those
    before it where they are read, so that nothing is shuffled but a row for each block; blank lines give no sequences.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    windows = token_lines(lines, keep=["file", "block", "row"]).select("file", "block", "row", line_windows(F.col("tokens"), length).alias("w"), line_window_count(F.col("tokens"), length).alias("n"))  # no filter on n: pushed down, it would parse every line twice
    sums = materialize(windows.groupBy("file", "block").agg(F.sum("n").alias("sum")), "chunk-blocks")
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    base = sums.select("file", "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).cast("long").alias("first"))
    placed = windows.join(F.broadcast(base), ["file", "block"]).select("file", "block", "first", "row", "w", "n")
    with arrow_batches(spark, LINES):
        placed = placed.mapInArrow(_numbered, placed.schema).select("file", "block", "row", "first", F.posexplode("w").alias("part", "tokens"))
        placed = placed.withColumn("seq_id", F.col("first") + F.col("part")).withColumn("chunk", F.floor(F.col("seq_id") / size))
        numbered = placed.select("chunk", "seq_id", "file", "block", "row", "part", "tokens")
        numbered.sortWithinPartitions("chunk", "seq_id").write.partitionBy("chunk").mode("overwrite").parquet(out)
    discard(sums)


def read_chunks(spark: SparkSession, path: str, chunks_per_batch: int = 1, per_task: bool = False) -> DataFrame:
    """A stream of the sequences that ``write_chunks`` wrote, so many chunk files a micro-batch; the query's checkpoint says which were read.

    ``per_task``: so many for each task of a micro-batch, as a micro-batch of a few chunks costs as much as one that occupies all tasks.
    """
    schema = "seq_id long, file string, block long, row long, part int, tokens array<int>, chunk long"
    tasks = max(shuffle_width(spark), spark.sparkContext.defaultParallelism) if per_task else 1
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", chunks_per_batch * tasks).parquet(path)
