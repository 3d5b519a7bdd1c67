"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sources get shares of all words by weight (5, 2, 1 repeating over the sources in code point order,
null last); a target stops at ``MAX_REPEAT`` times its source's words and the excess goes to the
other sources by weight. Inside a source, documents fall into blocks by a hash. The mix takes every
block as many whole times as the target holds the source, and draws the rest of the target block by
block in a permuted order; the block that the target ends in is taken in part, down to documents.

The block instances of all sources (their quotas) are then dealt to ``n_shards`` output shards. A
binary tree over the shards halves the number of instances at each node, and how many of each source
go left follows the multivariate hypergeometric law, drawn source after source by inverting the
conditional law with a hashed uniform number. So every quota is met exactly, every shard is a random
draw without replacement, and no step sorts or counts a whole source: tables beside the documents
have at most 256 rows for each source, or one row for each node and source of the tree.

Only built-in functions run on the path. The number of sources must fit one array (a row of the tree
holds one number for each source).

Edge cases: null or empty texts have size 0 and are taken 0 words; null sources form a source of
their own; a null or repeated doc_id is dealt with like any other value (its rows share their fate);
an empty table gives an empty mix; extra columns pass through. The draw depends on
``seed``, ids and sizes alone, so reruns agree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.words import text_or_empty
from loomspark.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
FAN_OUT = 256
BLOCK_DOCS = 256
LEVELS = 3
SEED = 20_240_607
SHARDS = 16
PART_WORDS = 1 << 22
TASK_ROWS = 1 << 16


def word_count(text: str) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """Inverse of the hypergeometric law at u in [0, 1), for long columns.

    Weights relative to the first value follow from the ratio of neighbours; ten standard deviations
    to either side hold all of the law that doubles can tell from zero.
    """
    big, k, n = (c.cast("double") for c in (total, good, drawn))
    mean = n * k / big
    spread = 10 * F.sqrt(mean * (1 - k / big) * (big - n) / big) + 10
    first = F.greatest(F.lit(0), drawn + good - total, F.floor(mean - spread))
    last = F.least(good, drawn, F.ceil(mean + spread))

    def step(s: Column, x: Column, limit: Column | None = None) -> Column:
        c = s["c"] + s["p"]
        ratio = (k - x) * (n - x) / ((x + 1) * (big - k - n + x + 1))
        hit = s["x"] if limit is None else F.when((s["x"] < 0) & (c >= limit), x).otherwise(s["x"])
        return F.struct((s["p"] * ratio).alias("p"), c.alias("c"), hit.alias("x"))

    zero = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("c"), F.lit(-1).cast("long").alias("x"))
    whole = F.aggregate(F.sequence(first, last), zero, lambda s, x: step(s, x))["c"]
    at = lambda w: F.aggregate(F.sequence(first, last), zero, lambda s, x: step(s, x, u * w))["x"]
    found = F.element_at(F.transform(F.array(whole), at), 1)
    return F.when((total <= 0) | (drawn <= 0) | (good <= 0), F.lit(0).cast("long")).when(found < 0, last).otherwise(found)


def _uniform(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)).cast("double") / float(1 << 52)


def split_tree(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """Deal block quotas out: (rank, quota) with ranks 1.. to (shard, rank, part), parts of a rank summing to its quota."""
    depth = (n_shards - 1).bit_length()
    if n_shards != 1 << depth:
        raise ValueError("n_shards must be a power of two")
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "quota"))).alias("q")).select(F.lit(0).alias("shard"), F.transform("q", lambda x: x["quota"]).alias("q"))
    for level in range(depth):
        total = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x)
        coin = (_uniform(F.lit(seed), F.lit(level), F.col("shard"), F.lit("coin")) * 2).cast("int")
        node = node.select("shard", "q", F.lit(level).alias("level"), total.alias("t"), (F.floor((total + coin) / 2)).cast("long").alias("n"))

        def draw(s: Column, quota: Column) -> Column:
            u = _uniform(F.lit(seed), F.col("level"), F.col("shard"), F.size(s["left"]))
            x = _hypergeometric(s["t"], quota, s["n"], u)
            return F.struct((s["t"] - quota).alias("t"), (s["n"] - x).alias("n"), F.array_append(s["left"], x).alias("left"))

        first = F.struct(F.col("t"), F.col("n"), F.array().cast("array<bigint>").alias("left"))
        node = node.select("shard", "q", F.aggregate("q", first, draw)["left"].alias("l"))
        right = F.zip_with("q", "l", lambda a, b: a - b)
        both = F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("l").alias("q")), F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("q")))
        node = materialize(node.select(F.explode(both).alias("x")).select("x.shard", "x.q"), "mix-tree")
    return node.select("shard", F.posexplode("q").alias("pos", "part")).select("shard", (F.col("pos") + 1).alias("rank"), "part")


@dataclass
class MixPlan:
    """sources: a row for each source; draws: (source, cell) to the instances of its block; extra: documents taken of the last, partial block."""

    sizes: DataFrame
    sources: DataFrame
    draws: DataFrame
    extra: DataFrame


def source_targets(sizes: DataFrame) -> DataFrame:
    """Target words of each source. Water level: the largest ratio of words left to weights left, over sources in the order they reach their cap."""
    everything = Window.partitionBy()
    by_name = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n_docs"))
    ranked = by_name.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1)
    cap = (MAX_REPEAT * F.col("source_size")).cast("double")
    shared = ranked.withColumn("weight", weight).withColumn("cap", cap)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left_words = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = shared.withColumn("level", left_words / left_weight).withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("cap"), F.col("weight") * F.col("level"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    return level.withColumn("target", target).withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).select("source", "rank", "source_size", "n_docs", "target", "whole", "need")


def _cell(level: int, h: str = "h") -> Column:
    return F.shiftrightunsigned(F.col(h), 8 * level).bitwiseAND(F.lit(FAN_OUT - 1)).cast("int")


def _same_source(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"])


def _walk(docs: DataFrame, state: DataFrame, level: int, seed: int) -> DataFrame:
    """Blocks of one level in permuted order with the words before and after each; cells is the list of hash cells of a block."""
    cells = docs.groupBy("source", _cell(level).alias("cell")).agg(F.sum("size").alias("w"), F.countDistinct("doc_id").alias("n"))
    s = state.select(F.col("source").alias("s"), "need", "fan", "rank")
    joined = cells.join(s, cells["source"].eqNullSafe(s["s"])).drop("s")
    blocks = joined.groupBy("source", "rank", "need", "fan", (F.col("cell") % F.col("fan")).alias("block")).agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.collect_list("cell").alias("cells"))
    # An odd multiplier and an offset permute 0..fan-1, as fan is a power of two.
    place = F.pmod(F.col("block") * 167 + F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("rank")), F.lit(FAN_OUT)), F.col("fan"))
    upto = Window.partitionBy("rank").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("place", place).withColumn("upto", F.sum("w").over(upto)).withColumn("before", F.col("upto") - F.col("w"))


def _fan(n: Column) -> Column:
    """Power of two near n / BLOCK_DOCS, from 1 to FAN_OUT."""
    steps = F.greatest(F.lit(0.0), F.round(F.log2(F.greatest(n, F.lit(1)) / float(BLOCK_DOCS))))
    return F.least(F.lit(FAN_OUT), F.pow(F.lit(2.0), steps).cast("int"))


def _writers(sources: DataFrame) -> int:
    """Tasks that write a table beside the documents: ``TASK_ROWS`` rows each of the cells of all sources and a block's documents of each."""
    rows = sources.agg(F.coalesce(F.sum(FAN_OUT + F.col("n_docs") / F.col("fan")), F.lit(0.0)).alias("n")).first().n
    return max(1, math.ceil(rows / TASK_ROWS))


def plan_mix(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED) -> MixPlan:
    """Decide how often each document is taken and in which shards."""
    sizes = materialize(docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("h")), "mix-sizes")
    sources = materialize(source_targets(sizes).withColumn("fan", _fan(F.col("n_docs"))), "mix-sources")
    writers = _writers(sources)
    live = sizes.where("size > 0")

    top = materialize(_walk(live, sources, 0, seed).coalesce(writers), "mix-blocks")
    taken, state, inside = top, None, live
    picked: list[DataFrame] = []
    for level in range(1, LEVELS + 1):
        # The block in which the target ends, and what is still needed of it.
        edge = taken.where((F.col("before") <= F.col("need")) & (F.col("upto") > F.col("need")))
        cells = edge.select(F.col("source").alias("s"), F.explode("cells").alias("c"))
        inside = inside.join(cells, [F.col("source").eqNullSafe(F.col("s")), _cell(level - 1) == cells["c"]], "left_semi")
        state = edge.select("source", "rank", (F.col("need") - F.col("before")).alias("need"), _fan(F.col("n")).alias("fan"))
        if level == LEVELS:
            break
        inside = materialize(inside, "mix-edge")
        taken = materialize(_walk(inside, state, level, seed).coalesce(writers), "mix-edge-blocks")
        whole = taken.where("upto <= need").select(F.col("source").alias("s"), F.explode("cells").alias("c"))
        picked.append(inside.join(whole, [F.col("source").eqNullSafe(F.col("s")), _cell(level) == whole["c"]], "left_semi").select("source", "doc_id"))

    # What is left are some hundred documents of a source at most: take those that still fit, in hash order,
    # and again, as long as no document exceeds MAX_REPEAT, so that the words taken end close to the target.
    last = inside.groupBy("source", "doc_id").agg(F.sum("size").alias("size"), F.first("h").alias("h"))
    spare = sources.select(F.col("rank").alias("r"), (F.lit(MAX_REPEAT) - F.col("whole")).alias("spare"))
    s = state.join(spare, F.col("rank") == F.col("r")).select(F.col("source").alias("s"), "need", "spare")
    listed = last.join(s, F.col("source").eqNullSafe(F.col("s"))).groupBy("source", "need", "spare").agg(F.array_sort(F.collect_list(F.struct("h", "doc_id", "size"))).alias("docs"))
    start = F.struct(F.col("need").alias("room"), F.array().cast(f"array<{dict(sizes.dtypes)['doc_id']}>").alias("ids"))
    fold = F.aggregate(F.flatten(F.array_repeat("docs", F.col("spare"))), start, lambda a, d: F.when(d["size"] <= a["room"], F.struct((a["room"] - d["size"]).alias("room"), F.array_append(a["ids"], d["doc_id"]).alias("ids"))).otherwise(a))
    picked.append(listed.select("source", F.explode(fold["ids"]).alias("doc_id")))
    whole, final = [p.distinct() for p in picked[:-1]], picked[-1]
    extra = reduce(DataFrame.unionByName, [*whole, final]).groupBy("source", "doc_id").agg(F.count("*").cast("int").alias("times"))
    extra = materialize(extra.coalesce(writers), "mix-extra")

    # Block instances: each block `whole` times, and once more if the rest of the target reaches it.
    w = sources.select(F.col("rank").alias("r"), "whole")
    blocks = top.join(w, top["rank"] == w["r"]).drop("r")
    rest = F.when(F.col("upto") <= F.col("need"), F.array(F.struct(F.col("whole").alias("epoch"), F.lit(False).alias("partial"))))
    rest = rest.when(F.col("before") <= F.col("need"), F.array(F.struct(F.col("whole").alias("epoch"), F.lit(True).alias("partial"))))
    each = F.when(F.col("whole") > 0, F.transform(F.sequence(F.lit(0), F.col("whole") - 1), lambda e: F.struct(e.alias("epoch"), F.lit(False).alias("partial"))))
    none = F.array().cast("array<struct<epoch:int,partial:boolean>>")
    instances = blocks.select("source", "rank", "block", "cells", F.explode(F.concat(F.coalesce(each, none), F.coalesce(rest, none))).alias("i")).select("source", "rank", "block", "cells", "i.*")
    order = Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed), F.col("rank"), F.col("epoch"), F.col("block")), "epoch", "block")
    instances = materialize(instances.withColumn("at", F.row_number().over(order).cast("long")).coalesce(writers), "mix-instances")

    quotas = sources.select("rank").join(instances.groupBy("rank").agg(F.count("*").alias("quota")), "rank", "left").fillna(0, ["quota"])
    parts = split_tree(quotas, n_shards, seed)
    ahead = F.coalesce(F.sum("part").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    slots = parts.withColumn("ahead", ahead).where("part > 0").select("rank", "shard", F.explode(F.sequence(F.col("ahead") + 1, F.col("ahead") + F.col("part"))).alias("at"))
    dealt = instances.join(slots, ["rank", "at"])
    draws = dealt.select("source", F.explode("cells").alias("cell"), F.struct("epoch", "shard", "partial").alias("d")).groupBy("source", "cell").agg(F.array_sort(F.collect_list("d")).alias("draws"))
    return MixPlan(sizes, sources, materialize(draws.coalesce(writers), "mix-draws"), extra)


def _with_draws(rows: DataFrame, plan: MixPlan, h: str = "h") -> DataFrame:
    """rows (source, doc_id, h, ...) with an array of (epoch, shard) in _draws."""
    d = plan.draws.select(F.col("source").alias("_s"), F.col("cell").alias("_c"), F.col("draws").alias("_draws"))
    e = plan.extra.select(F.col("source").alias("_es"), F.col("doc_id").alias("_ed"), F.col("times").alias("_times"))
    out = rows.join(d, [F.col("source").eqNullSafe(F.col("_s")), _cell(0, h) == F.col("_c")], "left")
    out = out.join(e, [F.col("source").eqNullSafe(F.col("_es")), F.col("doc_id").eqNullSafe(F.col("_ed"))], "left")
    # The partial block's instance holds a document as often as it was picked.
    times = F.coalesce("_times", F.lit(0))
    copies = lambda x: F.when(x["partial"] & (times > 0), F.transform(F.sequence(F.lit(0), times - 1), lambda k: F.struct((x["epoch"] + k).alias("epoch"), x["shard"].alias("shard"))))
    one = lambda x: F.array(F.struct(x["epoch"].alias("epoch"), x["shard"].alias("shard")))
    none = F.array().cast("array<struct<epoch:int,shard:int>>")
    kept = F.flatten(F.transform("_draws", lambda x: F.coalesce(copies(x), F.when(~x["partial"], one(x)), none)))
    return out.withColumn("_draws", F.coalesce(kept, none)).drop("_s", "_c", "_es", "_ed", "_times")


def taken_words(plan: MixPlan) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes of it."""
    t = plan.sources.select(F.col("source").alias("_t"), "source_size", "target")
    rows = _with_draws(plan.sizes, plan)
    rows = rows.join(t, rows["source"].eqNullSafe(t["_t"]))
    taken = F.when(F.col("size") > 0, F.col("size") * F.size("_draws")).otherwise(F.lit(0)).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.when(F.col("size") > 0, F.transform("_draws", lambda x: x["shard"])).otherwise(F.array().cast("array<int>")).alias("shards"))


def mix(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, part_words: int = PART_WORDS) -> DataFrame:
    """The mixed corpus: the columns of docs plus shard and epoch, each shard shuffled within itself.

    A shard is written by as many tasks as its counted words need (``part_words`` each): rows are dealt to them by hash, so
    that the tasks of a shard in order are one permutation of it, whatever the size of the input.
    """
    plan = plan_mix(docs, n_shards, seed)
    rows = _with_draws(docs.withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id"))), plan, "_h").where(word_count("text") > 0)
    copies = rows.select(*docs.columns, F.explode("_draws").alias("_d")).select(*docs.columns, "_d.shard", "_d.epoch")
    words = plan.sources.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("w")).first().w
    parts = max(1, math.ceil(words / n_shards / part_words))
    place = F.xxhash64(F.lit(seed), F.col("epoch"), F.col("doc_id"))
    part = F.pmod(F.shiftright(place, 20), F.lit(parts))
    return copies.repartition(n_shards * parts, F.col("shard"), part).sortWithinPartitions("shard", part, place)
