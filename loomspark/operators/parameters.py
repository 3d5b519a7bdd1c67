"""Parameters as a table: which tensors a configuration has, how many numbers they hold, gradients applied by key, and the forward pass.

A parameter table has a row for each row of a tensor: (layer int, tensor string, row int, values array<double>); tensors outside the layers have layer -1,
vectors (norm weights) one row 0. Tensors of the forward pass whose numbers were counted as few are broadcast. For larger ones, weights are stored by input, so that a projection joins the inputs of a vector, one row each, to the weights' rows and sums the products by
output: neither a layer's weights nor a sequence need fit one task, and a small table is broadcast only where Spark finds its size small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators import modelmath as mm
from loomspark.operators.attention import blocked_attention
from loomspark.operators.chat import token_counts
from loomspark.operators.pack import uniform
from loomspark.session import dealt, discard, materialize

GLOBAL = -1


def catalogue(configs: DataFrame) -> DataFrame:
    """(config_id, ordinal, layer, part, tensor, rows, columns), a row for each tensor in the order in which parameters are flattened.

    ``configs``: config_id, vocabulary, hidden, layers, ffn, kv_size (of all key-value heads), positions (null: none learned), and the booleans tied,
    attention_bias, ffn_bias, gated, norm_bias.
    """

    def tensor(layer: Column, part: str, name: str, rows: Column | int, columns: Column | int, there: Column | None = None) -> Column:
        long = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
        row = F.struct(layer.cast("int").alias("layer"), F.lit(part).alias("part"), F.lit(name).alias("tensor"), long(rows).alias("rows"), long(columns).alias("columns"))
        return row if there is None else F.when(there, row)

    c, none = F.col, F.lit(GLOBAL)
    h, f, kv = c("hidden"), c("ffn"), c("kv_size")
    head = [
        tensor(none, "embedding", "embedding", c("vocabulary"), h),
        tensor(none, "output", "lm_head", c("vocabulary"), h, ~c("tied")),
        tensor(none, "position", "positions", c("positions"), h, c("positions").isNotNull()),
    ]

    def layer(at: Column) -> Column:
        bias, ffn_bias, gate, norm = c("attention_bias"), c("ffn_bias"), c("gated"), c("norm_bias")
        out = [
            *(tensor(at, "attention", f"{n}_proj", h, size) for n, size in (("q", h), ("k", kv), ("v", kv), ("o", h))),
            *(tensor(at, "attention", f"{n}_bias", 1, size, bias) for n, size in (("q", h), ("k", kv), ("v", kv), ("o", h))),
            tensor(at, "ffn", "up_proj", h, f), tensor(at, "ffn", "down_proj", f, h), tensor(at, "ffn", "gate_proj", h, f, gate),
            tensor(at, "ffn", "up_bias", 1, f, ffn_bias), tensor(at, "ffn", "down_bias", 1, h, ffn_bias), tensor(at, "ffn", "gate_bias", 1, f, gate & ffn_bias),
            tensor(at, "norm", "attention_norm", 1, h), tensor(at, "norm", "attention_norm_bias", 1, h, norm), tensor(at, "norm", "ffn_norm", 1, h), tensor(at, "norm", "ffn_norm_bias", 1, h, norm),
        ]
        return F.array(*out)

    tail = [tensor(none, "norm", "final_norm", 1, h), tensor(none, "norm", "final_norm_bias", 1, h, c("norm_bias"))]
    numbers = F.when(c("layers") > 0, F.sequence(F.lit(0), (c("layers") - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    every = F.filter(F.concat(F.array(*head), F.flatten(F.transform(numbers, layer)), F.array(*tail)), lambda t: t.isNotNull())
    return dealt(configs).select("config_id", F.posexplode(every).alias("ordinal", "t")).select("config_id", "ordinal", "t.*")


def parameter_counts(tensors: DataFrame, compat: bool = False) -> DataFrame:
    """(config_id, part, n): numbers held by each part. ``compat`` leaves the biases of feed-forward layers out, as the surveyed count does."""
    if compat:
        tensors = tensors.where(~F.col("tensor").isin("up_bias", "down_bias", "gate_bias"))
    return tensors.groupBy("config_id", "part").agg(F.sum(F.col("rows") * F.col("columns")).alias("n"))


def flat_offsets(tensors: DataFrame) -> DataFrame:
    """``tensors`` with the place of each one's first number among all flattened parameters of its configuration."""
    from pyspark.sql import Window

    before = Window.partitionBy("config_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return tensors.withColumn("offset", F.coalesce(F.sum(F.col("rows") * F.col("columns")).over(before), F.lit(0)))


def apply_gradients(parameters: DataFrame, gradients: DataFrame, rate: float) -> DataFrame:
    """Parameters less ``rate`` times their gradients, met by key; rows without a gradient stay."""
    keys = ["layer", "tensor", "row"]
    joined = parameters.join(gradients.withColumnRenamed("values", "_g"), keys, "left")
    changed = F.zip_with("values", "_g", lambda p, g: p - rate * F.coalesce(g, F.lit(0.0)))
    return joined.select(*keys, F.when(F.col("_g").isNull(), F.col("values")).otherwise(F.slice(changed, F.lit(1), F.size("values"))).alias("values"))


def averaged(shadow: DataFrame, parameters: DataFrame, decay: float) -> DataFrame:
    """The moving average after one more step: decay * shadow + (1 - decay) * parameters."""
    keys = ["layer", "tensor", "row"]
    both = parameters.join(shadow.withColumnRenamed("values", "_s"), keys, "left")
    mixed = F.zip_with("values", "_s", lambda p, s: F.when(s.isNull(), p).otherwise(s * decay + p * (1 - decay)))
    return both.select(*keys, F.when(F.col("_s").isNull(), F.col("values")).otherwise(mixed).alias("values"))


LOCAL_NUMBERS = 1 << 20  # of a tensor that is broadcast, 8 MB


# ---- forward pass -------------------------------------------------------------------------------------


def project(rows: DataFrame, parameters: DataFrame, layer: int, tensor: str, x: str = "x", out: str = "y") -> DataFrame:
    """(seq, pos, out): the vectors times a tensor, whose row i is joined to component i of every vector."""
    weights = parameters.where((F.col("layer") == layer) & (F.col("tensor") == tensor)).select("row", "values")
    parts = rows.select("seq", "pos", F.posexplode(x).alias("row", "a")).join(weights, "row").select("seq", "pos", "a", F.posexplode("values").alias("j", "w"))
    sums = parts.groupBy("seq", "pos", "j").agg(F.sum(F.col("a") * F.col("w")).alias("y"))
    return sums.groupBy("seq", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "y"))), lambda t: t["y"]).alias(out))


def _normed(rows: DataFrame, parameters: DataFrame, layer: int, tensor: str) -> DataFrame:
    weight = parameters.where((F.col("layer") == layer) & (F.col("tensor") == tensor)).select(F.col("values").alias("_w"))
    scaled = rows.select("seq", "pos", mm.rms_norm(F.col("x")).alias("x")).crossJoin(F.broadcast(weight))  # one row of ``hidden`` numbers
    return scaled.select("seq", "pos", F.zip_with("x", "_w", lambda a, w: a * w).alias("x"))


def _added(rows: DataFrame, more: DataFrame) -> DataFrame:
    return rows.join(more, ["seq", "pos"]).select("seq", "pos", F.zip_with("x", "y", lambda a, b: a + b).alias("x"))


def _regular(parameters: DataFrame) -> set[tuple[int, str]]:
    """(layer, tensor) of tensors of at most ``LOCAL_NUMBERS`` numbers whose rows are all there, once, and of one length."""
    length = F.size("values")
    facts = parameters.groupBy("layer", "tensor").agg(F.count("*").alias("n"), F.countDistinct("row").alias("rows"), F.min("row").alias("low"), F.max("row").alias("high"), F.min(length).alias("least"), F.max(length).alias("most"))
    return {(r.layer, r.tensor) for r in facts.where(f"n = rows AND low = 0 AND high = n - 1 AND least = most AND n * most <= {LOCAL_NUMBERS}").collect()}  # a row for each tensor


def _product(x: Column, w: Column) -> Column:
    """x times a tensor that is held as an array of its rows, added up in order of the components."""
    parts = F.transform(w, lambda r, i: F.transform(r, lambda v: F.coalesce(F.get(x, i), F.lit(0.0)) * v))
    return F.aggregate(parts, F.transform(F.get(w, F.lit(0)), lambda _: F.lit(0.0)), lambda s, r: F.zip_with(s, r, lambda a, b: a + b))


def local_project(rows: DataFrame, parameters: DataFrame, layer: int, x: str, **tensors: str) -> DataFrame:
    """``rows`` with a column more for each tensor: column ``x`` times it. Tensors are broadcast (``_regular`` ones, counted before), so no vector is taken apart or shuffled."""
    held = parameters.where((F.col("layer") == layer) & F.col("tensor").isin(list(tensors.values())))
    ordered = lambda t: F.transform(F.array_sort(F.collect_list(F.when(F.col("tensor") == t, F.struct("row", "values")))), lambda r: r["values"])
    weights = held.agg(*[ordered(t).alias(f"_{out}") for out, t in tensors.items()])
    return rows.crossJoin(F.broadcast(weights)).select(*rows.columns, *[_product(F.col(x), F.col(f"_{out}")).alias(out) for out in tensors])  # one row


def _scaled(rows: DataFrame, parameters: DataFrame, layer: int, tensor: str, x: str, out: str) -> DataFrame:
    """``rows`` with a column more: the normed vectors."""
    weight = parameters.where((F.col("layer") == layer) & (F.col("tensor") == tensor)).select(F.col("values").alias("_w"))
    return rows.crossJoin(F.broadcast(weight)).select(*rows.columns, F.zip_with(mm.rms_norm(F.col(x)), "_w", lambda a, w: a * w).alias(out))  # one row of ``hidden`` numbers


def _local_layer(x: DataFrame, parameters: DataFrame, n: int, heads: int, kv_heads: int, size: int) -> DataFrame:
    """A layer over (seq, pos, pad, x) whose tensors are broadcast: only heads and their results travel."""
    def cut(rows: DataFrame, n_heads: int, name: str, columns: list[str], *more: str) -> DataFrame:
        pieces = F.transform(F.sequence(F.lit(0), F.lit(n_heads - 1)), lambda h: F.struct(h.alias(name), *[F.slice(c, h * size + 1, size).alias(c) for c in columns]))
        return rows.select("seq", "pos", *more, F.explode(pieces).alias("_p")).select("seq", "pos", *more, "_p.*")

    rows = local_project(_scaled(x, parameters, n, "attention_norm", "x", "_y"), parameters, n, "_y", q="q_proj", k="k_proj", v="v_proj").drop("_y")
    rows = materialize(rows, "forward-heads")
    seen = blocked_attention(cut(rows, heads, "head", ["q"]), cut(rows, kv_heads, "kv_head", ["k", "v"], "pad"), heads, kv_heads)
    joined = seen.groupBy("seq", "pos").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("head", "out"))), lambda t: t["out"])).alias("_a"))
    plus = lambda rows, y: rows.select("seq", "pos", "pad", F.zip_with("x", y, lambda a, b: a + b).alias("x"))
    middle = plus(local_project(rows.select("seq", "pos", "pad", "x").join(joined, ["seq", "pos"]), parameters, n, "_a", o="o_proj"), "o")
    wide = local_project(_scaled(middle, parameters, n, "ffn_norm", "x", "_y"), parameters, n, "_y", gate="gate_proj", up="up_proj")
    inner = wide.select("seq", "pos", "pad", "x", F.zip_with(F.transform("gate", lambda a: mm.silu(a)), "up", lambda a, b: a * b).alias("_z"))
    out = materialize(plus(local_project(inner, parameters, n, "_z", y="down_proj"), "y"), "forward")
    discard(rows)
    return out


def forward(tokens: DataFrame, parameters: DataFrame, layers: int, heads: int, kv_heads: int, hidden: int, padding: int | None = None) -> DataFrame:
    """(seq, pos, logits) of (seq, pos, token): embedding and sinusoidal positions, pre-norm layers of causal attention and gated feed-forward with residuals, final norm, and the
    embedding as output weights. Tokens that are ``padding`` are seen by no other. Lineage is cut by a table after each layer.

    Tensors of up to ``LOCAL_NUMBERS`` numbers are broadcast; a model with a larger one meets its tensors in joins, component by component.
    """
    table = parameters.where(f"layer = {GLOBAL} AND tensor = 'embedding'").select(F.col("row").alias("token"), "values")
    x = tokens.join(table, "token").select("seq", "pos", F.zip_with("values", mm.sinusoidal(F.col("pos"), hidden), lambda a, b: a + b).alias("x"))
    size = hidden // heads
    pad = (F.col("token") == F.lit(padding) if padding is not None else F.lit(False)).alias("pad")
    # The embedding turned: its column i, by token, belongs to component i.
    turned = table.select("token", F.posexplode("values").alias("row", "w")).groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("token", "w"))), lambda t: t["w"]).alias("values"))
    turned = turned.select(F.lit(GLOBAL).alias("layer"), F.lit("output").alias("tensor"), "row", "values")
    needed = {(n, f"{t}_proj") for n in range(layers) for t in ("q", "k", "v", "o", "gate", "up", "down")} | {(GLOBAL, "embedding")}
    if needed <= _regular(parameters):
        held = materialize(tokens.join(table, "token").select("seq", "pos", pad, F.zip_with("values", mm.sinusoidal(F.col("pos"), hidden), lambda a, b: a + b).alias("x")), "forward")
        for n in range(layers):
            x = _local_layer(held, parameters, n, heads, kv_heads, size)
            discard(held)
            held = x
        return local_project(_scaled(held, parameters, GLOBAL, "final_norm", "x", "_y"), turned, GLOBAL, "_y", logits="output").select("seq", "pos", "logits")
    hidden_from = tokens.select("seq", "pos", pad)

    def cut(rows: DataFrame, column: str, n: int, name: str) -> DataFrame:
        pieces = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda h: F.struct(h.alias(name), F.slice(column, h * size + 1, size).alias(column)))
        return rows.select("seq", "pos", F.explode(pieces).alias("_p")).select("seq", "pos", "_p.*")

    held = x = materialize(x, "forward")
    for n in range(layers):
        normed = materialize(_normed(x, parameters, n, "attention_norm"), "forward-norm")
        q, k, v = (project(normed, parameters, n, f"{t}_proj", out=t) for t in "qkv")
        keys = cut(k, "k", kv_heads, "kv_head").join(cut(v, "v", kv_heads, "kv_head"), ["seq", "pos", "kv_head"]).join(hidden_from, ["seq", "pos"])
        seen = blocked_attention(cut(q, "q", heads, "head"), keys, heads, kv_heads)
        joined = seen.groupBy("seq", "pos").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("head", "out"))), lambda t: t["out"])).alias("x"))
        middle = materialize(_added(x, project(joined, parameters, n, "o_proj")), "forward-attention")
        normed_2 = materialize(_normed(middle, parameters, n, "ffn_norm"), "forward-norm")
        gate, up = (project(normed_2, parameters, n, f"{t}_proj", out=t) for t in ("gate", "up"))
        inner = gate.join(up, ["seq", "pos"]).select("seq", "pos", F.zip_with(F.transform("gate", lambda a: mm.silu(a)), "up", lambda a, b: a * b).alias("x"))
        x = materialize(_added(middle, project(inner, parameters, n, "down_proj")), "forward")
        for used in (held, normed, middle, normed_2):
            discard(used)
        held = x
    final = _normed(x, parameters, GLOBAL, "final_norm")
    return project(final, turned, GLOBAL, "output", out="logits")


def evaluate(tokens: DataFrame, parameters: DataFrame, at_most: int = 500, **model) -> DataFrame:
    """(sequences, loss): mean cross entropy of each next token over the first sequences by id, at most so many: an evaluation's cost is fixed. With ``averaged`` parameters
    it judges the averaged model."""
    chosen = tokens.select("seq").distinct().orderBy("seq").limit(at_most)
    some = tokens.join(chosen, "seq", "left_semi")
    logits = forward(some, parameters, **model)
    target = some.select("seq", (F.col("pos") - 1).alias("pos"), F.col("token").alias("target"))
    losses = logits.join(target, ["seq", "pos"]).select("seq", mm.cross_entropy(F.col("logits"), F.col("target").cast("int")).alias("loss"))
    return losses.agg(F.countDistinct("seq").alias("sequences"), F.avg("loss").alias("loss"))


def generate(tokens: DataFrame, parameters: DataFrame, at_most: int, end: int, temperature: float = 0.0, top_p: float = 1.0, penalty: float = 1.0, seed: int = 0, newline: int | None = 13, context: int | None = None, **model) -> DataFrame:
    """(seq, pos, token) of up to so many tokens that follow each sequence of (seq, pos from 0, token); all sequences grow by one at a time.

    Logits are divided by ``penalty`` for every time a token stands in the sequence, the newline's by 1.2 more after the first token, and by the temperature. Temperature 0 takes the likeliest
    token, else one is drawn from the nucleus by a hash of seed, sequence and place. A sequence ends before ``end`` and at ``context`` tokens.
    """
    held = materialize(tokens.select("seq", F.col("pos").cast("long").alias("pos"), F.col("token").cast("int").alias("token"), F.lit(False).alias("new")), "generate")
    for step in range(at_most):
        growing = held.groupBy("seq").agg(F.max("pos").alias("pos"), F.max_by("token", "pos").alias("last"))
        if context is not None:
            growing = growing.where(F.col("pos") + 1 < context)
        if step:  # a sequence that took no token in the round before has ended
            growing = growing.join(held.where("new").groupBy("seq").agg(F.count("*").alias("_n")).where(F.col("_n") == step), "seq", "left_semi")
        some = held.join(growing.select("seq"), "seq", "left_semi")
        logits = forward(some.select("seq", "pos", "token"), parameters, **model).join(growing.select("seq", "pos"), ["seq", "pos"])
        scored = logits.join(token_counts(some, "seq"), "seq").select("seq", "pos", mm.penalised_logits(F.col("logits"), F.col("counts"), penalty, temperature, newline if step else None).alias("y"))
        token = mm.greedy(F.col("y")) if temperature <= 0 else mm.draw_nucleus(F.col("y"), top_p, uniform(seed, F.col("seq"), F.col("pos")))
        grown = scored.select("seq", (F.col("pos") + 1).alias("pos"), token.cast("int").alias("token"), F.lit(True).alias("new")).where(F.col("token") != end)
        before, held = held, materialize(held.unionByName(grown), "generate")
        discard(before)
    return held.where("new").select("seq", "pos", "token")
