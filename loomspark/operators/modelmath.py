"""Model arithmetic on vectors held in arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators.pack import uniform


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, not once for each element of a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("double"))


def softmax(logits: Column) -> Column:
    shares = lambda e: let(_sum(e), lambda total: F.transform(e, lambda x: x / total))
    return let(F.array_max(logits), lambda top: let(F.transform(logits, lambda x: F.exp(x - top)), shares))


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log softmax at the target (from 0), shifted by the maximum."""
    return let(F.array_max(logits), lambda top: F.ln(_sum(F.transform(logits, lambda x: F.exp(x - top)))) + top - F.get(logits, target))


def mean_cross_entropy(rows: DataFrame, logits: str, target: str, *keys: str, ignore_index: int | None = None) -> DataFrame:
    """Mean loss and the number of targets that count: those inside the vocabulary and not the one to ignore; 0 where there is none."""
    inside = (F.col(target) >= 0) & (F.col(target) < F.size(logits))
    if ignore_index is not None:
        inside = inside & (F.col(target) != ignore_index)
    loss = F.when(inside, cross_entropy(F.col(logits), F.when(inside, F.col(target)).cast("int")))
    return rows.groupBy(*keys).agg(F.coalesce(F.avg(loss), F.lit(0.0)).alias("loss"), F.count(loss).alias("n"))


def dropout(values: Column, probability: float, *keys: Column | int) -> Column:
    """Inverted dropout: elements whose hash of the keys and the place falls under the probability are 0, the others grow to keep the mean."""
    if probability <= 0:
        return values
    named = [k if isinstance(k, Column) else F.lit(k) for k in keys]
    return F.transform(values, lambda x, i: F.when(F.pmod(F.xxhash64(*named, i), F.lit(1 << 32)) / float(1 << 32) < probability, F.lit(0.0)).otherwise(x / (1 - probability)))


def residual(values: Column, added: Column, probability: float = 0.0, *keys: Column | int) -> Column:
    """values plus the added branch after dropout."""
    return F.zip_with(values, dropout(added, probability, *keys), lambda x, y: x + y)


def argmax(values: Column) -> Column:
    """Index of the largest value, the last of equal ones."""
    top = F.array_max(F.transform(values, lambda x, i: F.struct(x.alias("v"), i.alias("i"))))
    return top["i"]


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def layer_norm(values: Column, eps: float = 1e-5) -> Column:
    n = F.size(values)
    var = lambda mean: _sum(F.transform(values, lambda x: (x - mean) * (x - mean))) / n
    return let(_sum(values) / n, lambda mean: let(F.sqrt(var(mean) + eps), lambda scale: F.transform(values, lambda x: (x - mean) / scale)))


def rms_norm(values: Column, eps: float = 1e-6) -> Column:
    scale = F.sqrt(_sum(F.transform(values, lambda x: x * x)) / F.size(values) + eps)
    return let(scale, lambda s: F.transform(values, lambda x: x / s))


def quantize(value: Column, bits: int) -> Column:
    """Round trip through q = 2 ** bits - 1 levels a unit, halves away from zero."""
    q = float((1 << bits) - 1)
    return F.round(value * q) / q


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def gated(gate: Column, up: Column, kind: str) -> Column:
    """swiglu or geglu of two equally long vectors."""
    act = {"swiglu": silu, "geglu": gelu}[kind]
    return F.zip_with(gate, up, lambda g, u: act(g) * u)


def linear(values: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """x W with rows of W by input."""
    out = []
    for j in range(len(weights[0])):
        dot = F.aggregate(F.zip_with(values, F.array(*[F.lit(float(r[j])) for r in weights]), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
        out.append(dot + (bias[j] if bias else 0.0))
    return F.array(*out)


def rope(values: Column, position: Column, theta: float = 10000.0) -> Column:
    """Rotary position encoding of neighbouring pairs."""
    n = F.size(values)
    angle = lambda i: position / F.pow(F.lit(theta), (F.floor(i / 2) * 2) / n)
    return F.transform(values, lambda x, i: F.when(i % 2 == 0, x * F.cos(angle(i)) - F.get(values, i + 1) * F.sin(angle(i))).otherwise(F.get(values, i - 1) * F.sin(angle(i)) + x * F.cos(angle(i))))


def sinusoidal(position: Column, size: int) -> Column:
    return F.array(*[(F.sin if i % 2 == 0 else F.cos)(position / 10000.0 ** ((i // 2 * 2) / size)) for i in range(size)])


def embedding_lookup(ids: DataFrame, table: DataFrame, id: str = "id") -> DataFrame:
    return ids.join(table, id, "left").withColumn("found", F.col("embedding").isNotNull())


def dims(hidden: Column, heads: Column, attention: Column, groups: Column, activation: Column) -> dict[str, Column]:
    """Key-value heads and feed-forward size (a multiple of 64) of a configuration."""
    kv = F.when(attention == "mqa", F.lit(1)).when(attention.isin("gqa", "gqa_window"), groups).otherwise(heads)
    ffn = F.when(activation.isin("swiglu", "geglu"), F.floor(hidden * 8.0 / 3.0)).otherwise(hidden * 4)
    return {"head_dim": F.floor(hidden / heads).cast("long"), "kv_heads": kv.cast("long"), "ffn_dim": (F.ceil(ffn / 64) * 64).cast("long")}


def parameter_estimate(layers: Column, hidden: Column) -> Column:
    return 12 * layers * hidden * hidden


def penalised_logits(logits: Column, counts: Column, penalty: float, temperature: float, newline: int | None = 13) -> Column:
    """logit / penalty ** count; the newline's by 1.2 more; all by the temperature if it is positive. counts is a map of id to count."""
    def one(x: Column, i: Column) -> Column:
        y = x / F.pow(F.lit(penalty), F.coalesce(F.try_element_at(counts, i), F.lit(0)))
        if newline is not None:
            y = F.when(i == newline, y / 1.2).otherwise(y)
        return y / temperature if temperature > 0 else y

    return F.transform(logits, one)


def greedy(logits: Column) -> Column:
    """First index of the largest logit."""
    return F.array_position(logits, F.array_max(logits)) - 1


def nucleus(logits: Column, p: float) -> Column:
    """Ids, most likely first, of the smallest set with probability p or more."""
    ordered = F.reverse(F.array_sort(F.transform(softmax(logits), lambda x, i: F.struct(x.alias("p"), (-i).alias("i")))))
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<int>").alias("ids"))
    return F.aggregate(ordered, start, lambda a, x: F.when(a["s"] >= p, a).otherwise(F.struct((a["s"] + x["p"]).alias("s"), F.array_append(a["ids"], -x["i"]).alias("ids"))))["ids"]


def draw_nucleus(logits: Column, p: float, u: Column) -> Column:
    """A token drawn from the nucleus: the first, most likely one first, at which the probabilities added up pass ``u`` (in 0..1) times those of the whole nucleus.

    The draw is the caller's, so that runs repeat; ``uniform`` gives one by seed and key.
    """
    scored = let(softmax(logits), lambda q: F.transform(nucleus(logits, p), lambda i: F.struct(i.alias("i"), F.get(q, i).alias("p"))))

    def pick(rows: Column) -> Column:
        total = F.aggregate(rows, F.lit(0.0), lambda s, r: s + r["p"])
        start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("int").alias("i"))
        return let(total, lambda t: F.aggregate(rows, start, lambda a, r: F.when(a["i"].isNotNull(), a).otherwise(F.struct((a["s"] + r["p"]).alias("s"), F.when(a["s"] + r["p"] > u * t, r["i"]).alias("i"))))["i"])

    # Rounding may leave the last of a nucleus just under its own sum.
    return let(scored, lambda rows: F.coalesce(pick(rows), F.element_at(rows, -1)["i"]))


def kept_layers(layers: Column, probability: float, *keys: Column | int) -> Column:
    """Numbers of the layers that stochastic depth keeps: layer i of n is skipped with probability ``probability * i / n``, drawn by hash of the keys and i."""
    numbers = F.when(layers > 0, F.sequence(F.lit(0), layers.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(numbers, lambda i: uniform(*keys, i) >= probability * (i / layers))


def kv_head(head: Column, heads: int, kv_heads: int, compat: bool = False) -> Column:
    """Key-value head that a query head shares; the first heads take the remainder of an uneven split.

    ``compat``: the longer runs end after ``quotient * remainder`` heads, as the surveyed rule has it, so that the last heads go past the key-value heads.
    """
    if kv_heads >= heads:
        return F.least(head, F.lit(kv_heads - 1))
    each, rest = divmod(heads, kv_heads)
    if compat:
        return F.when(head < each * rest, F.floor(head / (each + 1))).otherwise(rest + F.floor((head - each * rest) / each)).cast("int")
    return F.when(head < (each + 1) * rest, F.floor(head / (each + 1))).otherwise(rest + F.floor((head - (each + 1) * rest) / each)).cast("int")


def alibi_slope(head: Column) -> Column:
    return F.pow(F.lit(2.0), -8 - head)


def attention(q: DataFrame, window: int | None = None, causal: bool = True, slope: float = 0.0, padding: str | None = None) -> DataFrame:
    """Scaled dot-product attention over rows (seq, pos, q, k, v): each position over the positions its mask allows.

    ``slope`` lowers a score by the distance to an earlier position; ``padding`` names a boolean column of positions that none may see.
    With a window each position is sent to the at most 2 * window + 1 positions that may see it, and meets them in an equi-join on
    both, so that no sequence is joined with itself whole; without one it is, as every pair is wanted.
    """
    k = q if padding is None else q.where(~F.col(padding))
    k = k.select("seq", F.col("pos").alias("kpos"), "k", "v")
    if window is not None:
        last = F.col("kpos") + window
        k = k.withColumn("pos", F.explode(F.sequence(F.col("kpos") if causal else F.col("kpos") - window, last)))
    seen = F.col("kpos") <= F.col("pos") if causal else F.lit(True)
    dot = F.aggregate(F.zip_with("q", "k", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) / F.sqrt(F.size("q"))
    score = dot - F.greatest(F.col("pos") - F.col("kpos"), F.lit(0)) * slope if slope else dot
    scored = q.select("seq", "pos", "q").join(k, "seq" if window is None else ["seq", "pos"]).where(seen).select("seq", "pos", score.alias("score"), "v")
    top = scored.groupBy("seq", "pos").agg(F.max("score").alias("m"))
    weighed = scored.join(top, ["seq", "pos"]).withColumn("w", F.exp(F.col("score") - F.col("m")))
    parts = weighed.select("seq", "pos", "w", F.posexplode("v").alias("i", "x")).groupBy("seq", "pos", "i").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("y"))
    return parts.groupBy("seq", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda t: t["y"]).alias("out"))
