"""Queries over training series and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.catalog import Catalog
from loomspark.operators import modelmath as mm
from loomspark.operators import series
from loomspark.sources import writers
from loomspark.tables import table

ORDERED = "v AS (SELECT user_id, list(value ORDER BY ts, event_id) AS x FROM events GROUP BY 1)"
VECTORS = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)"
LR = {"lr": 0.001, "warmup": 100, "total": 1000}


def register(c: Catalog) -> None:
    def values(spark, sf_dir):
        return series.ordered_values(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")

    def vectors(spark, sf_dir):
        return table(spark, sf_dir, "embeddings").select("vec_id", "label", mm.doubles(F.col("embedding")).alias("x"))

    p = "least((s - 100) / 900.0, 1.0)"
    wave = "(0.00001 + (0.001 - 0.00001) * 0.5 * (1 + cos(pi() * {p})))"
    warm = "CASE WHEN s < 100 THEN 0.001 * s / 100 ELSE {x} END"
    curves = {
        "linear": f"0.001 * greatest(1 - {p}, 0.0)", "cosine": wave.format(p=p), "restarts": wave.format(p="((s % 250) / 250.0)"), "constant": "0.001",
        "one_cycle": f"CASE WHEN {p} < 0.3 THEN 0.001 + (0.01 - 0.001) * {p} / 0.3 ELSE 0.01 - (0.01 - 0.001) * ({p} - 0.3) / 0.7 END",
    }

    @c.query("lr_schedules", "SELECT b AS batch, " + ", ".join(f"round({warm.format(x=x)}, 12) AS lr_{k}" for k, x in curves.items()) + " FROM (SELECT event_id AS b, 2 * event_id AS s FROM events)")
    def lr_schedules(spark, sf_dir):
        s = series.effective_step(F.col("event_id"))
        cols = [F.round(series.learning_rate(s, k, min_lr=0.00001, restart=250, max_lr=0.01, **LR), 12).alias(f"lr_{k}") for k in curves]
        return table(spark, sf_dir, "events").select(F.col("event_id").alias("batch"), *cols)

    @c.query("ema_by_user", f"WITH {ORDERED} SELECT user_id, round(list_reduce(x, lambda e, y: e * 0.9 + y * (1 - 0.9)), 9) AS ema FROM v")
    def ema_by_user(spark, sf_dir):
        return values(spark, sf_dir).select("user_id", F.round(series.ema(F.col("values"), 0.9), 9).alias("ema"))

    @c.query("running_best", "SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
    def running_best(spark, sf_dir):
        return table(spark, sf_dir, "events").select("event_id", series.running_best("user_id", "ts", "event_id", value="value").alias("best"))

    @c.query(
        "early_stop_step",
        """WITH RECURSIVE o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value FROM events),
        r AS (SELECT user_id, 0::BIGINT AS i, 'Infinity'::DOUBLE AS best, 0 AS bad, NULL::BIGINT AS stop FROM (SELECT DISTINCT user_id FROM o)
        UNION ALL SELECT r.user_id, o.i, CASE WHEN o.value < r.best - 0.01 THEN o.value ELSE r.best END, CASE WHEN o.value < r.best - 0.01 THEN 0 ELSE r.bad + 1 END,
        coalesce(r.stop, CASE WHEN o.value >= r.best - 0.01 AND r.bad + 1 >= 5 THEN o.i END) FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
        SELECT user_id, arg_max(best, i) AS best, max(stop) AS stop_step FROM r GROUP BY 1""",
    )
    def early_stop_step(spark, sf_dir):
        s = values(spark, sf_dir).select("user_id", series.early_stop(F.col("values"), 5, 0.01).alias("s"))
        return s.select("user_id", "s.best", F.col("s.stop_step").cast("long").alias("stop_step"))

    @c.query(
        "loss_scale_trace",
        """WITH RECURSIVE o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value > 100 AS bad FROM events),
        r AS (SELECT user_id, 0::BIGINT AS i, 65536.0::DOUBLE AS scale, 0 AS clean, 0 AS n FROM (SELECT DISTINCT user_id FROM o)
        UNION ALL SELECT r.user_id, o.i, least(greatest(CASE WHEN o.bad THEN r.scale / 2 WHEN r.clean + 1 >= 4 AND r.scale * 2 <= 32768 THEN r.scale * 2 ELSE r.scale END, 1.0), 32768.0),
        CASE WHEN o.bad OR (r.clean + 1 >= 4 AND r.scale * 2 <= 32768) THEN 0 ELSE r.clean + 1 END, r.n + o.bad::INT FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
        SELECT user_id, arg_max(scale, i) AS scale, max(n)::INT AS overflows FROM r GROUP BY 1""",
    )
    def loss_scale_trace(spark, sf_dir):
        flags = F.transform("values", lambda x: x > 100)
        return values(spark, sf_dir).select("user_id", flags.alias("f")).select("user_id", series.loss_scale(F.col("f"), 65536.0, window=4).alias("s")).select("user_id", "s.scale", "s.overflows")

    @c.query("overflow_rate", "SELECT event_type, count(*) AS total_steps, sum((value > 100)::INT)::BIGINT AS overflow_count, round(avg((value > 100)::INT), 9) AS overflow_rate FROM events GROUP BY 1")
    def overflow_rate(spark, sf_dir):
        bad = (F.col("value") > 100).cast("int")
        return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("total_steps"), F.sum(bad).alias("overflow_count"), F.round(F.avg(bad), 9).alias("overflow_rate"))

    @c.query(
        "value_histogram_30",
        """WITH g AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
        SELECT bin, count(*) AS n FROM (SELECT coalesce(floor((value - lo) / nullif((hi - lo) / 30, 0)), 0)::INT AS bin FROM events, g WHERE value IS NOT NULL) WHERE bin < 30 GROUP BY 1""",
    )
    def value_histogram_30(spark, sf_dir):
        return series.histogram(table(spark, sf_dir, "events"), "value").select("bin", "n")

    @c.query("scalar_events", "SELECT event_id AS step, tag, v AS value FROM (SELECT event_id, unnest(['loss', 'double']) AS tag, unnest([value, value * 2]) AS v FROM events) WHERE v IS NOT NULL")
    def scalar_events(spark, sf_dir):
        rows = table(spark, sf_dir, "events").withColumn("loss", F.col("value")).withColumn("double", F.col("value") * 2)
        return writers.scalar_events(rows, "event_id", "ts", ["loss", "double"]).select("step", "tag", "value")

    @c.query("zip_losses", "SELECT user_id, (i - 1)::INT AS pos, x[i] AS loss, CASE WHEN (i - 1) % 2 = 0 THEN 0.001 ELSE 0.0 END::DOUBLE AS learning_rate, ((i - 1) * 100)::INT AS eval_step FROM (SELECT user_id, list(value ORDER BY ts, event_id) AS x FROM events GROUP BY 1), unnest(range(1, len(x) + 1)) AS r(i)")
    def zip_losses(spark, sf_dir):
        losses = values(spark, sf_dir).select("user_id", F.posexplode("values").alias("pos", "loss"))
        rates = losses.where("pos % 2 = 0").select("user_id", "pos", F.lit(0.001).alias("learning_rate"))
        return series.zip_series(losses, rates, "user_id")

    gradients = "o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value / 100 AS g FROM events)"
    begin = "FROM (SELECT DISTINCT user_id FROM o)"
    following = "FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1"
    ended = "SELECT user_id, round(arg_max(p, i), 9) AS p FROM r GROUP BY 1"

    @c.query(
        "adam_fold",
        f"""WITH RECURSIVE {gradients},
        r AS (SELECT user_id, 0::BIGINT AS i, 1.0::DOUBLE AS p, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v {begin}
        UNION ALL SELECT r.user_id, o.i, r.p - 0.001 * ((0.9 * r.m + (1 - 0.9) * o.g) / (1 - power(0.9, o.i))) / (sqrt((0.999 * r.v + (1 - 0.999) * o.g * o.g) / (1 - power(0.999, o.i))) + 1e-8),
        0.9 * r.m + (1 - 0.9) * o.g, 0.999 * r.v + (1 - 0.999) * o.g * o.g {following}) {ended}""",
    )
    def adam_fold(spark, sf_dir):
        g = F.transform("values", lambda x: x / 100)
        return values(spark, sf_dir).select("user_id", g.alias("g")).select("user_id", F.round(series.adam(F.col("g"), 1.0, 0.001), 9).alias("p"))

    @c.query(
        "sgd_fold",
        f"""WITH RECURSIVE {gradients}, r AS (SELECT user_id, 0::BIGINT AS i, 1.0::DOUBLE AS p, 0.0::DOUBLE AS v {begin}
        UNION ALL SELECT r.user_id, o.i, r.p - 0.001 * (0.9 * r.v + o.g), 0.9 * r.v + o.g {following}) {ended}""",
    )
    def sgd_fold(spark, sf_dir):
        g = F.transform("values", lambda x: x / 100)
        return values(spark, sf_dir).select("user_id", g.alias("g")).select("user_id", F.round(series.sgd_momentum(F.col("g"), 1.0, 0.001), 9).alias("p"))

    @c.query(
        "lamb_fold",
        f"""WITH RECURSIVE {VECTORS}, o AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, x AS g FROM e),
        r AS (SELECT label, 0::BIGINT AS i, list_transform(g, lambda z: 1.0::DOUBLE) AS p, list_transform(g, lambda z: 0.0::DOUBLE) AS m, list_transform(g, lambda z: 0.0::DOUBLE) AS v FROM o WHERE o.i = 1
        UNION ALL SELECT s.label, s.i, list_transform(range(1, len(p) + 1), lambda k: p[k] - CASE WHEN u[k] <> 0 THEN 0.001 * trust / (abs(u[k]) + 1e-6) ELSE 0.001 END * u[k]), m, v FROM (
            SELECT *, list_transform(range(1, len(p) + 1), lambda k: m[k] / (1 - power(0.9, i)) / (sqrt(v[k] / (1 - power(0.999, i))) + 1e-6) + 0.01 * p[k]) AS u FROM (
            SELECT r.label, o.i, r.p, list_transform(range(1, len(r.p) + 1), lambda k: 0.9 * r.m[k] + (1 - 0.9) * o.g[k]) AS m, list_transform(range(1, len(r.p) + 1), lambda k: 0.999 * r.v[k] + (1 - 0.999) * o.g[k] * o.g[k]) AS v,
                sqrt(list_sum(list_transform(r.p, lambda z: z * z))) / (sqrt(list_sum(list_transform(o.g, lambda z: z * z))) + 1e-6) AS trust
            FROM r JOIN o ON o.label = r.label AND o.i = r.i + 1)) s),
        z AS (SELECT label, arg_max(p, i) AS y FROM r GROUP BY 1)
        SELECT label, (unnest(range(1, len(y) + 1)) - 1)::INT AS i, round(unnest(y), 6) + 0.0 AS y FROM z""",
    )
    def lamb_fold(spark, sf_dir):
        g = series.ordered_values(vectors(spark, sf_dir), "label", ["vec_id"], "x")
        ones = F.transform(F.get("values", F.lit(0)), lambda _: F.lit(1.0))
        done = g.select("label", series.lamb(F.col("values"), ones, 0.001, decay=0.01).alias("p"))
        return done.select("label", F.posexplode("p").alias("i", "y")).select("label", "i", (F.round("y", 6) + 0.0).alias("y"))

    @c.query("precision_rounding", f"""WITH {VECTORS}, a AS (SELECT vec_id, unnest(range(1, len(x) + 1)) - 1 AS i, unnest(x) AS a FROM e), b AS (SELECT *, floor(log2(abs(a))) AS k FROM a)
        SELECT vec_id, i::INT AS i, CASE WHEN a = 0 THEN a ELSE round_even(a / power(2.0, greatest(k, -14) - 10), 0) * power(2.0, greatest(k, -14) - 10) END + 0.0 AS half, CASE WHEN a = 0 THEN a ELSE trunc(a / power(2.0, k - 7)) * power(2.0, k - 7) END + 0.0 AS brain FROM b""")
    def precision_rounding(spark, sf_dir):
        rows = vectors(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "a"))
        return rows.select("vec_id", "i", (series.fp16(F.col("a")) + 0.0).alias("half"), (series.bf16(F.col("a")) + 0.0).alias("brain"))

    @c.query("flat_parameters", "SELECT label, vec_id AS name, md5(array_to_string(list_transform(embedding, lambda x: round(x * 1000)::INT), ' ')) AS h FROM embeddings")
    def flat_parameters(spark, sf_dir):
        flat = series.flatten_parameters(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
        back = series.unflatten_parameters(flat, "label")
        return back.select("label", "name", F.md5(F.array_join(F.transform("values", lambda x: F.round((x * 1000).cast("float")).cast("int").cast("string")), " ")).alias("h"))

    @c.query("mean_xent", f"WITH {VECTORS}, t AS (SELECT label, x, (vec_id % (len(x) + 4)) - 2 AS t FROM e), l AS (SELECT label, CASE WHEN t BETWEEN 0 AND len(x) - 1 AND t <> 5 THEN ln(list_sum(list_transform(x, lambda y: exp(y - list_max(x))))) + list_max(x) - x[t + 1] END AS loss FROM t) SELECT label, round(coalesce(avg(loss), 0), 9) AS loss, count(loss) AS n FROM l GROUP BY 1")
    def mean_xent(spark, sf_dir):
        rows = vectors(spark, sf_dir).withColumn("t", F.col("vec_id") % (F.size("x") + 4) - 2)
        return mm.mean_cross_entropy(rows, "x", "t", "label", ignore_index=5).withColumn("loss", F.round("loss", 9))

    @c.query("kv_heads", "SELECT p_partkey, h::INT AS head, h::INT AS even, CASE WHEN h < 6 THEN h // 3 ELSE 2 + (h - 6) // 2 END::INT AS uneven, CASE WHEN h < 4 THEN h // 3 ELSE 2 + (h - 4) // 2 END::INT AS plain, 0::INT AS one FROM (SELECT p_partkey, p_partkey % 14 AS h FROM part)")
    def kv_heads(spark, sf_dir):
        h = (F.col("p_partkey") % 14).cast("int")
        # 14 heads over 6 (2 each, 2 left over), the longer runs first, or by the surveyed rule, and over 1.
        cols = {"head": h, "even": mm.kv_head(h, 14, 14), "uneven": mm.kv_head(h, 14, 6), "plain": mm.kv_head(h, 14, 6, compat=True), "one": mm.kv_head(h, 14, 1)}
        return table(spark, sf_dir, "part").select("p_partkey", *[v.cast("int").alias(k) for k, v in cols.items()])

    def each(vector):
        """The rows (vec_id, i, y) of every element of a result vector."""
        return lambda rows: rows.select("vec_id", F.posexplode(vector).alias("i", "y")).select("vec_id", "i", F.round("y", 6).alias("y"))

    every = "SELECT vec_id, (unnest(range(1, len(y) + 1)) - 1)::INT AS i, round(unnest(y), 6) + 0.0 AS y FROM r"

    total = "list_sum(list_transform(x, lambda y: y * y))"

    @c.query("l2_clip", f"WITH {VECTORS}, r AS (SELECT vec_id, list_transform(x, lambda z: z / greatest(sqrt({total}), 1.0)) AS y FROM e) {every}")
    def l2_clip(spark, sf_dir):
        return vectors(spark, sf_dir).select("vec_id", series.clip(F.col("x"), 1.0).alias("c")).transform(each("c"))

    @c.query("layer_norm", f"WITH {VECTORS}, m AS (SELECT vec_id, x, list_avg(x) AS mean FROM e), v AS (SELECT *, list_avg(list_transform(x, lambda z: (z - mean) ** 2)) AS var FROM m), r AS (SELECT vec_id, list_transform(x, lambda z: (z - mean) / sqrt(var + 1e-5)) AS y FROM v) {every}")
    def layer_norm(spark, sf_dir):
        return vectors(spark, sf_dir).select("vec_id", mm.layer_norm(F.col("x")).alias("n")).transform(each("n"))

    @c.query("rms_norm", f"WITH {VECTORS}, m AS (SELECT vec_id, x, sqrt({total} / len(x) + 1e-6) AS rms FROM e), r AS (SELECT vec_id, list_transform(x, lambda z: z / rms) AS y FROM m) {every}")
    def rms_norm(spark, sf_dir):
        return vectors(spark, sf_dir).select("vec_id", mm.rms_norm(F.col("x")).alias("n")).transform(each("n"))

    xent = "ln(list_sum(list_transform(x, lambda y: exp(y - list_max(x))))) + list_max(x) - x[label % len(x) + 1]"

    @c.query("softmax_xent", f"WITH {VECTORS} SELECT vec_id, round({xent}, 9) AS loss, round(exp({xent}), 6) AS perplexity FROM e")
    def softmax_xent(spark, sf_dir):
        loss = mm.cross_entropy(F.col("x"), (F.col("label") % F.size("x")).cast("int"))
        return vectors(spark, sf_dir).select("vec_id", F.round(loss, 9).alias("loss"), F.round(mm.perplexity(loss), 6).alias("perplexity"))

    @c.query("quantize_8bit", f"WITH {VECTORS}, r AS (SELECT vec_id, list_transform(x, lambda z: round(z * 255) / 255) AS y FROM e) {every}")
    def quantize_8bit(spark, sf_dir):
        return vectors(spark, sf_dir).select("vec_id", F.transform("x", lambda z: mm.quantize(z, 8) + 0.0).alias("q")).transform(each("q"))

    @c.query("argmax_top1", f"WITH {VECTORS} SELECT label, count(*) AS n, sum((list_position(x, list_max(x)) - 1 = label % len(x))::INT)::BIGINT AS hits FROM e GROUP BY 1")
    def argmax_top1(spark, sf_dir):
        hit = (mm.argmax(F.col("x")) == F.col("label") % F.size("x")).cast("int")
        return vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.sum(hit).alias("hits"))

    @c.query("activations", f"WITH {VECTORS}, a AS (SELECT vec_id, unnest(range(1, len(x) + 1)) - 1 AS i, unnest(x) AS a FROM e) SELECT vec_id, i::INT AS i, round(0.5 * a * (1 + tanh(sqrt(2 / pi()) * (a + 0.044715 * a * a * a))), 9) AS gelu, round(a / (1 + exp(-a)), 9) AS silu, greatest(a, 0.0) AS relu FROM a")
    def activations(spark, sf_dir):
        a = F.col("a")
        rows = vectors(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "a"))
        return rows.select("vec_id", "i", F.round(mm.gelu(a), 9).alias("gelu"), F.round(mm.silu(a), 9).alias("silu"), mm.relu(a).alias("relu"))

    @c.query("gated_halves", f"WITH {VECTORS}, h AS (SELECT vec_id, x[1:len(x) // 2] AS g, x[len(x) // 2 + 1:] AS u FROM e), r AS (SELECT vec_id, list_transform(list_zip(g, u), lambda z: z[1] / (1 + exp(-z[1])) * z[2]) AS y FROM h) {every}")
    def gated_halves(spark, sf_dir):
        half = (F.size("x") / 2).cast("int")
        return vectors(spark, sf_dir).select("vec_id", mm.gated(F.slice("x", F.lit(1), half), F.slice("x", half + 1, half), "swiglu").alias("g")).transform(each("g"))

    @c.query("gradient_sums", f"WITH {VECTORS}, l AS (SELECT label, unnest(range(len(x))) AS param_idx, unnest(x) AS g FROM e) SELECT label, param_idx::INT AS param_idx, round(sum(g) * 0.5, 6) AS g FROM l GROUP BY 1, 2")
    def gradient_sums(spark, sf_dir):
        g = vectors(spark, sf_dir).select("label", F.posexplode("x").alias("param_idx", "g"))
        return g.groupBy("label", "param_idx").agg(F.round(F.sum("g") * 0.5, 6).alias("g"))

    @c.query("finite_vectors", "SELECT label, count(*) AS n, bool_and(len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0) AS finite FROM embeddings GROUP BY 1")
    def finite_vectors(spark, sf_dir):
        return vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.bool_and(series.is_finite(F.col("x"))).alias("finite"))

    turn = "(vec_id % 128) / power(10000.0, 2 * ((i - 1) // 2) / len(x)::DOUBLE)"

    @c.query("rope_encode", f"WITH {VECTORS}, r AS (SELECT vec_id, list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN x[i] * cos({turn}) - x[i + 1] * sin({turn}) ELSE x[i - 1] * sin({turn}) + x[i] * cos({turn}) END) AS y FROM e) {every}")
    def rope_encode(spark, sf_dir):
        return vectors(spark, sf_dir).select("vec_id", mm.rope(F.col("x"), F.col("vec_id") % 128).alias("r")).transform(each("r"))

    @c.query("sinusoidal_positions", "SELECT p AS pos, i::INT AS i, round(CASE WHEN i % 2 = 0 THEN sin(p / power(10000.0, i / 32.0::DOUBLE)) ELSE cos(p / power(10000.0, (i - 1) / 32.0::DOUBLE)) END, 9) AS y FROM (SELECT p_partkey AS p FROM part), range(32) AS b(i)")
    def sinusoidal_positions(spark, sf_dir):
        rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.posexplode(mm.sinusoidal(F.col("p_partkey"), 32)).alias("i", "y"))
        return rows.select("pos", "i", F.round("y", 9).alias("y"))

    # Weights by rule: output j of input i (from 0) has ((3 * i + 5 * j) % 7 - 3) / 8.
    @c.query("linear_projection", f"WITH {VECTORS} SELECT vec_id, j::INT AS i, round(list_sum(list_transform(range(len(x)), lambda k: x[k + 1] * ((3 * k + 5 * j) % 7 - 3) / 8.0)) + j, 6) AS y FROM e, range(3) AS o(j)")
    def linear_projection(spark, sf_dir):
        rows = vectors(spark, sf_dir)
        size = rows.agg(F.max(F.size("x"))).first()[0] or 0
        weights = [[((3 * i + 5 * j) % 7 - 3) / 8 for j in range(3)] for i in range(size)]
        return rows.select("vec_id", mm.linear(F.col("x"), weights or [[0.0] * 3], [0.0, 1.0, 2.0]).alias("y0")).transform(each("y0"))

    @c.query("greedy_sample", f"WITH {VECTORS}, p AS (SELECT vec_id, list_transform(range(len(x)), lambda i: (CASE WHEN i = label THEN x[i + 1] / power(1.1, 2) ELSE x[i + 1] END) / (CASE WHEN i = 13 THEN 1.2 ELSE 1 END)) AS y FROM e) SELECT vec_id, (list_position(y, list_max(y)) - 1)::BIGINT AS token FROM p")
    def greedy_sample(spark, sf_dir):
        counts = F.create_map(F.col("label").cast("int"), F.lit(2))
        y = vectors(spark, sf_dir).select("vec_id", mm.penalised_logits(F.col("x"), counts, 1.1, 0.0).alias("y"))
        return y.select("vec_id", mm.greedy(F.col("y")).cast("long").alias("token"))

    @c.query("nucleus_size", f"WITH {VECTORS}, l AS (SELECT vec_id, unnest(range(len(x))) AS i, exp(unnest(x) - list_max(x)) AS w FROM e), s AS (SELECT vec_id, sum(w / t) OVER (PARTITION BY vec_id ORDER BY w DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT *, sum(w) OVER (PARTITION BY vec_id) AS t FROM l)) SELECT vec_id, count(*)::INT AS n FROM s WHERE coalesce(before, 0) < 0.9 GROUP BY 1")
    def nucleus_size(spark, sf_dir):
        return vectors(spark, sf_dir).select("vec_id", F.size(mm.nucleus(F.col("x"), 0.9)).alias("n"))

    @c.query("model_dims", "SELECT p_partkey, h AS hidden, (h // 8)::BIGINT AS head_dim, CASE WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN 2 ELSE 8 END::BIGINT AS kv_heads, (ceil((CASE WHEN k % 2 = 0 THEN floor(h * 8.0::DOUBLE / 3.0::DOUBLE) ELSE h * 4 END) / 64) * 64)::BIGINT AS ffn_dim, (12 * k * h * h)::BIGINT AS parameters FROM (SELECT p_partkey, p_size AS k, (p_partkey % 97 + 1) * 64 AS h FROM part)")
    def model_dims(spark, sf_dir):
        k, h = F.col("p_size").cast("long"), (F.col("p_partkey") % 97 + 1) * 64
        kind = F.when(k % 3 == 0, "mqa").when(k % 3 == 1, "gqa").otherwise("mha")
        d = mm.dims(h, F.lit(8), kind, F.lit(2), F.when(k % 2 == 0, "swiglu").otherwise("gelu"))
        return table(spark, sf_dir, "part").select("p_partkey", h.alias("hidden"), *[v.alias(n) for n, v in d.items()], mm.parameter_estimate(k, h).alias("parameters"))

    @c.query("window_attention", "WITH s AS (SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value / 100 AS a FROM events), p AS (SELECT q.seq, q.pos, q.a * k.a AS score, k.a AS v FROM s q JOIN s k ON q.seq = k.seq AND k.pos <= q.pos AND q.pos - k.pos <= 4), w AS (SELECT *, exp(score - max(score) OVER (PARTITION BY seq, pos)) AS w FROM p) SELECT seq, pos, round(sum(w * v) / sum(w), 9) AS y FROM w GROUP BY 1, 2")
    def window_attention(spark, sf_dir):
        rows = values(spark, sf_dir).select(F.col("user_id").alias("seq"), F.posexplode("values").alias("p", "x")).select("seq", (F.col("p") + 1).cast("long").alias("pos"), F.array(F.col("x") / 100).alias("q"))
        out = mm.attention(rows.withColumn("k", F.col("q")).withColumn("v", F.col("q")), window=4)
        return out.select("seq", "pos", F.round(F.get("out", F.lit(0)), 9).alias("y"))

    @c.query("shard_ranges", "WITH t AS (SELECT coalesce(sum(strlen(text)), 0)::BIGINT AS n FROM documents) SELECT i AS shard, i * 100000 AS first, least((i + 1) * 100000, n) AS last FROM t, range(greatest(1, (n + 99999) // 100000)) AS r(i)")
    def shard_ranges(spark, sf_dir):
        size = table(spark, sf_dir, "documents").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
        return writers.shard_plan(spark, size, 100_000)

    @c.query("config_hash", "SELECT c_custkey, md5(c_name || '|' || c_mktsegment) AS h FROM customer")
    def config_hash(spark, sf_dir):
        return table(spark, sf_dir, "customer").select("c_custkey", F.md5(F.concat_ws("|", "c_name", "c_mktsegment")).alias("h"))
