"""Packing, windowing, batching, shuffling, splitting, augmenting and validating token sequences.

Random choices are keyed by md5 of a seed and a key, so every run and every partitioning agrees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from loomspark.operators.draws import place_draws
from loomspark.session import discard, materialize, shuffle_width


def hash_key(*parts: Column | str | int) -> Column:
    """First 32 bits of the md5 of the parts joined by colons, as a long."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """The same in [0, 1)."""
    return hash_key(*parts) / float(1 << 32)


def char_tokens(text: Column) -> Column:
    """Code points of a text as ids: the tokenizer the checks use, as it needs no vocabulary."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


# ---- packing ----------------------------------------------------------------------------------


def offsets(rows: DataFrame, order: str, size: str, out: str = "offset", two_level: bool = True) -> DataFrame:
    """Running sum of sizes before each row.

    Two levels by default: range partitions are summed, their sums (a row each) are added up, and a
    running sum inside each partition starts from there, so no task sees all rows.
    """
    if not two_level:
        w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))
    n = shuffle_width(rows.sparkSession)
    ranged = materialize(rows.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()), "pack-ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("_part").agg(F.sum(size).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(base.select("_part", "_base")), "_part")  # a row for each partition
    return joined.withColumn(out, (F.col("_base") + F.coalesce(F.sum(size).over(inside), F.lit(0))).cast("long")).drop("_part", "_base")


NULL_ID = -(1 << 63)
FLUSH = 1 << 20  # ids that a task gathers before it gives sequences out


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's ids (no list is empty) as bytes of the least width that holds a row's: 1 and 2 unsigned, 4 and 8 signed, nulls as ``NULL_ID``."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        ends = lists.offsets.to_numpy()
        ids = lists.values.slice(ends[0], ends[-1] - ends[0])
        ids = (ids.cast(pa.int64()).fill_null(NULL_ID) if ids.null_count else ids).to_numpy()
        ends = ends - ends[0]
        low, high = np.minimum.reduceat(ids, ends[:-1]), np.maximum.reduceat(ids, ends[:-1])
        small = np.where((low >= -(1 << 31)) & (high < 1 << 31), 4, 8)
        width = np.where((low >= 0) & (high < 1 << 16), np.where(high < 1 << 8, 1, 2), small)
        packed = [ids[lo:hi].astype(WIDTHS[w]).tobytes() for lo, hi, w in zip(ends[:-1].tolist(), ends[1:].tolist(), width.tolist(), strict=True)]
        columns = [*batch.columns[:-1], pa.array(np.diff(ends), pa.int64()), pa.array(width, pa.int32()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "_n", "_w", "_b"])


WIDTHS = {1: "<u1", 2: "<u2", 4: "<i4", 8: "<i8"}


def _sequences(size: int, kind: pa.DataType, keyed: bool):
    """Pieces ([by], block, at, width, bytes), in order of block and place and each block whole, to ([by], seq_id, tokens); an incomplete end is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have, first, block, end, of = [], 0, 0, None, None, None

        def given() -> Iterator[pa.RecordBatch]:
            nonlocal held, have, first
            n = have // size
            if n:
                ids = np.concatenate(held)
                held, have, whole = [ids[n * size :]], have - n * size, ids[: n * size]
                values = pa.array(whole.astype(kind.to_pandas_dtype()), kind, mask=whole == NULL_ID if whole.dtype == np.int64 else None)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * size, size), pa.int32()), values)
                key = [of.take(pa.array([0] * n))] if keyed else []
                yield pa.RecordBatch.from_arrays([*key, pa.array(np.arange(first, first + n), pa.int64()), lists], names=[*["by"] * keyed, "seq_id", "tokens"])
                first += n

        for batch in batches:
            blocks, places, widths, packed = batch.columns[keyed:]
            for i, (b, at, w, x) in enumerate(zip(blocks.to_pylist(), places.to_pylist(), widths.to_pylist(), packed, strict=True)):
                if b != block or at != end:  # the next block, or the same of another value
                    yield from given()
                    held, have, first, block, of = [], 0, at // size, b, batch.column(0).slice(i, 1)
                ids = np.frombuffer(x.as_buffer(), WIDTHS[w])
                held.append(ids)
                have, end = have + len(ids), at + len(ids)
                if have >= FLUSH:
                    yield from given()
        yield from given()

    return run


def _ranges(rows: DataFrame, by: str | None, order: str, n: int) -> tuple[DataFrame, int]:
    """Ranges of ([by], order) in order, as one row ``_ranges`` of (low, base, start): least key, sum of ``_n`` before it, and where its value of ``by`` starts; and the sum of all."""
    keys = [by] if by else []
    held = materialize(rows.select(F.struct(*keys, order).alias("_key"), "_n"), "pack-sizes")
    ranged = materialize(held.repartitionByRange(n, "_key").withColumn("_part", F.spark_partition_id()), "pack-ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = ranged.groupBy("_part").agg(F.min("_key").alias("low"), F.sum("_n").alias("_sum")).withColumn("base", F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long"))
    if by:
        value = F.col("_key")[by].alias("_value")
        inside = Window.partitionBy("_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
        sums = ranged.groupBy("_part", value).agg(F.sum("_n").alias("_n")).withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        starts = sums.join(F.broadcast(base.select("_part", "base")), "_part").groupBy("_value").agg(F.min(F.col("base") + F.col("_in")).cast("long").alias("start"))
        base = base.join(starts, F.col("low")[by].eqNullSafe(F.col("_value")))
    else:
        base = base.withColumn("start", F.lit(0).cast("long"))
    one = materialize(base.agg(F.array_sort(F.collect_list(F.struct("base", "low", "start"))).alias("_ranges")), "pack-bounds")
    total = ranged.agg(F.sum("_n")).first()[0] or 0
    discard(held)
    discard(ranged)
    return one, total


def pack(rows: DataFrame, length: int, order: str, tokens: str = "tokens", by: str | None = None) -> DataFrame:
    """(seq_id, tokens): the ids of all rows in order, cut into sequences of length + 1; the tail is dropped. Partitions and their rows are in order of seq_id.

    Ranges of the order are cut over sizes alone. Then ids travel twice, in bytes of the least width that holds them: rows to their range, where a running sum gives their places, and
    slices to blocks of as many sequences as makes one block for each task, so that a long row is dealt over blocks. With ``by``, the rows of each of its values are packed apart, as
    (by, seq_id, tokens): places are counted over all rows in order of value and row, less the value's first place, so a value may hold most rows.
    """
    size, n = length + 1, shuffle_width(rows.sparkSession)
    keys = [by] if by else []
    keyed = rows.select(*keys, order, F.col(tokens).alias("_tokens")).where(F.size("_tokens") > 0)
    bounds, total = _ranges(keyed.select(*keys, order, F.size("_tokens").cast("long").alias("_n")), by, order, n)
    per = max(1, -(-total // (size * n)))  # sequences of a block

    kept = StructType([keyed.schema[c] for c in (*keys, order)])
    bytes_of = keyed.mapInArrow(_narrow, StructType([*kept, StructField("_n", LongType()), StructField("_w", IntegerType()), StructField("_b", BinaryType())]))
    key, steps = F.struct(*keys, order), [1 << k for k in reversed(range(n.bit_length()))]
    up = lambda at, k: F.get("_ranges", at + k)["low"] <= key
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, k: F.when(up(at, k), at + k).otherwise(at))
    ranged = bytes_of.crossJoin(F.broadcast(bounds)).withColumn("_part", found)  # one row
    ranged = ranged.select(*kept.names, "_n", "_w", "_b", "_part", F.get("_ranges", F.col("_part")).alias("_range")).repartition(n, "_part")
    inside = Window.partitionBy("_part").orderBy(*keys, order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_at", F.col("_range")["base"] + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    if by:  # only the first value of a range may have started before it
        start = F.min("_at").over(Window.partitionBy("_part", by))
        placed = placed.withColumn("_at", F.col("_at") - F.when(F.col(by).eqNullSafe(F.col("_range")["low"][by]), F.col("_range")["start"]).otherwise(start))

    def piece(block: Column) -> Column:
        lo = F.greatest(block * (size * per), F.col("_at"))
        hi = F.least((block + 1) * (size * per), F.col("_at") + F.col("_n"))
        part = F.col("_b").substr(((lo - F.col("_at")) * F.col("_w") + 1).cast("int"), ((hi - lo) * F.col("_w")).cast("int"))
        return F.struct(block.alias("block"), lo.alias("at"), F.col("_w").alias("w"), part.alias("b"))

    # Sliced before the explode, so that no row carries the ids of the whole text.
    blocks = F.sequence(F.floor(F.col("_at") / (size * per)), F.floor((F.col("_at") + F.col("_n") - 1) / (size * per)))
    sliced = placed.select(*keys, F.explode(F.transform(blocks, piece)).alias("p")).select(*keys, "p.*")
    dealt = sliced.repartition(n, by, "block") if by else sliced.repartitionById(n, F.col("block").cast("int"))
    kind = keyed.schema["_tokens"].dataType
    out = StructType([*[keyed.schema[c] for c in keys], StructField("seq_id", LongType()), StructField("tokens", kind)])
    arrow = pa.int32() if kind.elementType == IntegerType() else pa.int64()
    return dealt.sortWithinPartitions(*keys, "block", "at").mapInArrow(_sequences(size, arrow, bool(by)), out)


def pack_stats(rows: DataFrame, length: int, text: str, tokens: str = "tokens") -> DataFrame:
    """Samples, UTF-8 bytes, tokens, whole sequences, and tokens per sequence."""
    r = rows.agg(F.count("*").alias("num_samples"), F.sum(F.octet_length(text)).cast("long").alias("total_bytes"), F.sum(F.size(tokens)).cast("long").alias("total_tokens"))
    r = r.withColumn("num_sequences", F.floor(F.col("total_tokens") / (length + 1)).cast("long"))
    return r.withColumn("avg_sequence_length", F.when(F.col("num_sequences") > 0, F.col("total_tokens") / F.col("num_sequences")))


def line_windows(tokens: Column, length: int) -> Column:
    """Windows of length + 1 at that stride, and one overlapping window at the end; shorter lines give none."""
    n, size = F.size(tokens), length + 1
    starts = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(size))
    tail = F.when((n - size > 0) & ((n - size) % size != 0), F.array(n - size)).otherwise(F.array().cast("array<int>"))
    every = F.transform(F.concat(starts, tail), lambda i: F.slice(tokens, i + 1, size))
    return F.when(n > length, every).otherwise(F.array().cast("array<array<int>>"))


def line_window_count(tokens: Column, length: int) -> Column:
    """How many windows ``line_windows`` gives."""
    return F.when(F.size(tokens) > length, F.ceil(F.size(tokens) / (length + 1))).otherwise(0).cast("long")


def shifted(tokens: Column, length: int) -> tuple[Column, Column]:
    """Input and target of a window."""
    return F.slice(tokens, 1, length), F.slice(tokens, 2, length)


# ---- batches ----------------------------------------------------------------------------------


def ranked(rows: DataFrame, *order: Column | str, out: str = "rn") -> DataFrame:
    """Rank from 0 over all rows by a two-level count, like `offsets`."""
    key = F.struct(*order)
    return offsets(rows.withColumn("_key", key).withColumn("_one", F.lit(1)), "_key", "_one", out).drop("_key", "_one")


def batches(rows: DataFrame, size: int, key: str, seed: int | None = None, epoch: int = 0, drop_last: bool = False) -> DataFrame:
    """Adds batch_id and pos_in_batch, in key order or shuffled by seed and epoch."""
    order = [F.col(key)] if seed is None else [hash_key(seed, epoch, F.col(key)), F.col(key)]
    out = ranked(rows, *order).withColumn("batch_id", F.floor(F.col("rn") / size).cast("long")).withColumn("pos_in_batch", (F.col("rn") % size).cast("long"))
    if drop_last:
        full = rows.agg(F.floor(F.count("*") / size).alias("full"))
        out = out.crossJoin(F.broadcast(full)).where("batch_id < full").drop("full")  # one row
    return out.drop("rn")


def batch_count(rows: DataFrame, size: int) -> DataFrame:
    n = F.count("*")
    return rows.agg(F.floor(n / size).cast("long").alias("dropping_last"), F.ceil(n / size).cast("long").alias("keeping_last"))


def fill_batch(rows: DataFrame, size: int, key: str, seed: int) -> DataFrame:
    """Adds rows drawn by hash from the table until the last batch is full."""
    n = rows.count()
    missing = -n % size
    if n == 0 or missing == 0:
        return rows.withColumn("filled", F.lit(False))
    extra = rows.orderBy(hash_key(seed, F.col(key)), key).limit(missing)
    return rows.withColumn("filled", F.lit(False)).unionByName(extra.withColumn("filled", F.lit(True)))


def micro_batch(pos: Column, micro: int) -> Column:
    return F.floor(pos / micro).cast("long")


def shuffled(rows: DataFrame, key: str, seed: int, epoch: int = 0) -> DataFrame:
    """Order of an epoch, as a rank column."""
    return ranked(rows, hash_key(seed, epoch, F.col(key)), F.col(key), out="shuffle_pos")


# ---- splits -----------------------------------------------------------------------------------


def n_validation(n: Column, ratio: float) -> Column:
    """ceil(n * ratio), at least 1, but never all: a single item leaves validation empty."""
    return F.least(F.greatest(F.ceil(n * ratio), F.lit(1)), n - 1).cast("long")


def split(rows: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """Adds is_validation by rank of the keyed hash."""
    placed = ranked(rows, hash_key(seed, F.col(key)), F.col(key))
    total = rows.agg(F.count("*").alias("_n"))
    return placed.crossJoin(F.broadcast(total)).withColumn("is_validation", F.col("rn") < n_validation(F.col("_n"), ratio)).drop("rn", "_n")  # one row


def stratified_split(rows: DataFrame, stratum: str, key: str, ratio: float, seed: int) -> DataFrame:
    """The same inside each stratum.

    A stratum that holds most rows is still ranked by parts: ranks are counted within hash ranges
    of a stratum, whose sizes are added up.
    """
    h = hash_key(seed, F.col(key))
    cut = rows.withColumn("_h", h).withColumn("_cell", F.floor(F.col("_h") / float(1 << 26)).cast("int"))
    cells = cut.groupBy(stratum, "_cell").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(stratum).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(stratum)))
    inner = Window.partitionBy(stratum, "_cell").orderBy("_h", key)
    placed = cut.join(cells.select(stratum, "_cell", "_before", "_n"), [stratum, "_cell"]).withColumn("_rn", F.col("_before") + F.row_number().over(inner) - 1)
    return placed.withColumn("is_validation", F.col("_rn") < n_validation(F.col("_n"), ratio)).drop("_h", "_cell", "_before", "_n", "_rn")


# ---- augmentation and checks --------------------------------------------------------------------


def _at_least(share: float) -> str:
    """The least 8 hexadecimal digits whose value is at least that share of 2 ** 32."""
    return f"{min(math.ceil(share * (1 << 32)), (1 << 32) - 1):08x}" if share < 1 else "g"


def _least_number(share: float) -> int:
    """The same as a number."""
    return min(math.ceil(share * (1 << 32)), (1 << 32) - 1) if share < 1 else 1 << 32


def augment(tokens: Column, key: Column, mask_id: int, probability: float = 0.15, seed: int = 0, shuffle: bool = True) -> Column:
    """Shuffles inside windows of three, then masks: 80 % mask, 10 % a random id below it, 10 % kept.

    One md5 of seed, key and position gives four draws of 8 hexadecimal digits: whether the place is picked, how it is
    changed, to which id, and the order of what stood there in its window. Digits compare like the numbers they write.
    """
    draws = F.transform(tokens, lambda _, i: F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), i.cast("string"))))

    def changed(d: Column) -> Column:
        moved = tokens
        if shuffle:
            placed = F.transform(tokens, lambda x, i: F.struct((i - i % 3).alias("w"), F.substring(F.get(d, i), 25, 8).alias("s"), i.alias("i"), x.alias("x")))
            moved = F.transform(F.array_sort(placed), lambda p: p["x"])
        other = lambda h: F.floor(F.conv(F.substring(h, 17, 8), 16, 10).cast("long") * mask_id / float(1 << 32)).cast("int")
        kind = lambda h: F.substring(h, 9, 8)
        picked = lambda x, h: F.when(kind(h) < _at_least(0.8), F.lit(mask_id)).when((kind(h) < _at_least(0.9)) & F.lit(mask_id > 0), other(h)).otherwise(x)
        return F.zip_with(moved, d, lambda x, h: F.when(h >= _at_least(probability), x).otherwise(picked(x, h)))

    return F.get(F.transform(F.array(draws), changed), F.lit(0))  # binds the draws once


def augment_rows(rows: DataFrame, tokens: str, key: str, mask_id: int, probability: float = 0.15, seed: int = 0, shuffle: bool = True, keep: tuple[str, ...] = (), out: str = "augmented") -> DataFrame:
    """(key, columns to keep, out) of each row: what ``augment`` gives, a row's draws made together as arrays. Null and empty token arrays stay as they are."""
    kept = [key, *keep]
    given = rows.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)], F.col(key).cast("string").alias("_key"), F.col(tokens).cast("array<int>").alias("_x"))
    changed, kind, other = (_least_number(x) for x in (probability, 0.8, 0.9))

    def one(name: str | None, x: pa.Array) -> pa.Array:
        n = len(x)
        h = place_draws(f"{seed}:" if name is None else f"{seed}:{name}:", n).astype(np.int64)
        moved, none = x.fill_null(0).to_numpy(), x.is_null().to_numpy(zero_copy_only=False)
        if shuffle:
            order = np.argsort((np.arange(n) // 3 << 32) + h[3], kind="stable")
            moved, none = moved[order], none[order]
        masked = (h[0] < changed) & (h[1] < kind)
        drawn = (h[0] < changed) & ~masked & (h[1] < other) if mask_id > 0 else np.zeros(n, bool)
        y = np.where(masked, mask_id, np.where(drawn, np.floor(h[2] * mask_id / float(1 << 32)).astype(np.int64), moved))
        return pa.array(y.astype(np.int32), pa.int32(), mask=none & ~masked & ~drawn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, names = batch.column(len(kept) + 1), batch.column(len(kept))
            step = max(1, int((1 << 24) * batch.num_rows / max(lists.nbytes, 1)))
            for lo in range(0, batch.num_rows, step):
                part = lists.slice(lo, step)
                done = [one(name.as_py(), x.values) if x.is_valid and len(x.values) else pa.array([], pa.int32()) for name, x in zip(names.slice(lo, step), part, strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(y) for y in done])]).astype(np.int32)
                lost = np.append(part.is_null().to_numpy(zero_copy_only=False), False)
                y = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=lost), pa.concat_arrays(done))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, step).columns[: len(kept)], y], names=[*batch.schema.names[: len(kept)], "_y"])

    done = given.mapInArrow(run, ", ".join([*(f"`{n}` {k}" for n, k in given.dtypes[: len(kept)]), "_y array<int>"]))
    return done.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(kept)], F.col("_y").alias(out))


def valid_batch(inputs: Column, targets: Column, vocabulary: int) -> Column:
    """Equal non-empty batches of equal lengths with ids below the vocabulary size."""
    below = lambda rows: F.forall(rows, lambda r: F.forall(r, lambda x: (x >= 0) & (x < vocabulary)))
    even = lambda rows: F.forall(rows, lambda r: F.size(r) == F.size(F.get(rows, F.lit(0))))
    pairs = F.forall(F.zip_with(inputs, targets, lambda a, b: F.size(a) == F.size(b)), lambda x: F.coalesce(x, F.lit(False)))
    return (F.size(inputs) == F.size(targets)) & (F.size(inputs) > 0) & (F.size(F.get(inputs, F.lit(0))) > 0) & even(inputs) & even(targets) & pairs & below(inputs) & below(targets)


def first_violation(inputs: Column, targets: Column, vocabulary: int) -> Column:
    """What is wrong first with a batch, as (problem, sample, position), or null: ``sizes``, ``empty``, then sample by sample ``length``, ``input`` and ``target`` (an id that is no id of the vocabulary)."""
    row = lambda problem, i=None, j=None: F.struct(F.lit(problem).alias("problem"), (F.lit(None) if i is None else i).cast("int").alias("sample"), (F.lit(None) if j is None else j).cast("int").alias("position"))
    bad = lambda ids: F.array_position(F.transform(ids, lambda x: F.coalesce((x < 0) | (x >= vocabulary), F.lit(True))), True) - 1

    def sample(pair: Column, i: Column) -> Column:
        a, b = pair["a"], pair["b"]
        return F.when(~F.coalesce(F.size(a) == F.size(b), F.lit(False)), row("length", i)).when(bad(a) >= 0, row("input", i, bad(a))).when(bad(b) >= 0, row("target", i, bad(b)))

    pairs = F.arrays_zip(inputs.alias("a"), targets.alias("b"))
    found = F.get(F.filter(F.transform(pairs, sample), lambda v: v.isNotNull()), F.lit(0))
    return F.when(~F.coalesce(F.size(inputs) == F.size(targets), F.lit(False)), row("sizes")).when(F.size(inputs) == 0, row("empty")).otherwise(found)


def batch_statistics(rows: DataFrame, batch: str, tokens: str = "tokens") -> DataFrame:
    """Per batch: sequences, tokens, distinct ids and their share."""
    sizes = rows.groupBy(batch).agg(F.count("*").alias("batch_size"), F.sum(F.size(tokens)).cast("long").alias("total_tokens"))
    kinds = rows.select(batch, F.explode(tokens).alias("t")).groupBy(batch).agg(F.countDistinct("t").alias("unique_tokens"))
    out = sizes.join(kinds, batch, "left").withColumn("unique_tokens", F.coalesce("unique_tokens", F.lit(0).cast("long")))
    return out.withColumn("density", F.when(F.col("total_tokens") > 0, F.col("unique_tokens") / F.col("total_tokens")).otherwise(0.0))
