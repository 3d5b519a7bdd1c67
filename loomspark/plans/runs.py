"""Queries over what a training run keeps and computes: tracking store, checkpoints, event files, steps, parameters, blocked attention and the forward pass."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.catalog import Catalog
from loomspark.functions.text import is_not_blank
from loomspark.operators import attention, chat, configs, pack, parameters, series, tracking
from loomspark.operators import modelmath as mm
from loomspark.operators.checkpoints import Checkpoints, resumed
from loomspark.operators.steps import Step, StepPipeline
from loomspark.operators.tracking import Store
from loomspark.session import scratch_dir
from loomspark.sources import event_records
from loomspark.tables import table

VECTORS = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)"
HIDDEN, HEADS, FFN, VOCABULARY, LAYERS = 8, 2, 16, 16, 2
SIZE = HIDDEN // HEADS
#: (tensor, inputs, outputs, number) of a layer with one key-value head; number tells the tensors' rules apart.
TENSORS = (("q_proj", HIDDEN, HIDDEN, 1), ("k_proj", HIDDEN, SIZE, 2), ("v_proj", HIDDEN, SIZE, 3), ("o_proj", HIDDEN, HIDDEN, 4), ("up_proj", HIDDEN, FFN, 5), ("gate_proj", HIDDEN, FFN, 6), ("down_proj", FFN, HIDDEN, 7))


def _place(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/loomspark/runs-{uuid.uuid4().hex}/{name}"


def weight(i: object, j: object, number: int) -> str:
    """The rule of all weights, in SQL."""
    return f"(((3 * {i} + 5 * {j} + {number}) % 7) - 3) / 8.0"


def rule_parameters(spark: SparkSession, shift: int = 0) -> DataFrame:
    """The parameter table of the small model whose weights the rule gives."""
    rule = lambda i, j, number: ((3 * i + 5 * j + number + shift) % 7 - 3) / 8
    norm = [1 + (i % 3) / 4 for i in range(HIDDEN)]
    rows = [(-1, "embedding", i, [rule(i, j, 0) for j in range(HIDDEN)]) for i in range(VOCABULARY)] + [(-1, "final_norm", 0, norm)]
    for n in range(LAYERS):
        rows += [(n, "attention_norm", 0, norm), (n, "ffn_norm", 0, norm)]
        rows += [(n, name, i, [rule(i, j, 10 * n + number) for j in range(outputs)]) for name, inputs, outputs, number in TENSORS for i in range(inputs)]
    return spark.createDataFrame(rows, "layer int, tensor string, row int, values array<double>")


def forward_sql(tokens: str, w=weight) -> str:
    """CTEs from x0 to the last, named logits(seq, pos, y), of the small model over a query of (seq, pos, token)."""

    def proj(x: str, inputs: int, outputs: int, number: int) -> str:
        return f"list_transform(range({outputs}), lambda j: list_sum(list_transform(range({inputs}), lambda i: {x}[i + 1] * {w('i', 'j', number)})))"

    def normed(x: str) -> str:
        return f"list_transform(range({HIDDEN}), lambda i: {x}[i + 1] / sqrt(list_sum(list_transform({x}, lambda z: z * z)) / {HIDDEN} + 1e-6) * (1 + (i % 3) / 4.0))"

    wave = f"CASE WHEN j % 2 = 0 THEN sin(pos / power(10000.0, j / {HIDDEN}.0)) ELSE cos(pos / power(10000.0, (j - 1) / {HIDDEN}.0)) END"
    out = [f"t AS MATERIALIZED ({tokens})", f"x0 AS MATERIALIZED (SELECT seq, pos, list_transform(range({HIDDEN}), lambda j: {w('token', 'j', 0)} + {wave}) AS x FROM t)"]
    for n in range(LAYERS):
        number = {name: 10 * n + k for name, _, _, k in TENSORS}
        mixed = ", ".join(f"sum(w * v[{i + 1}]) / sum(w)" for i in range(SIZE))
        dot = f"list_sum(list_transform(range({SIZE}), lambda i: a.q[h * {SIZE} + i + 1] * b.k[i + 1])) / sqrt({SIZE}.0)"
        out += [
            f"a{n} AS MATERIALIZED (SELECT seq, pos, x, {normed('x')} AS y FROM x{n})",
            f"q{n} AS MATERIALIZED (SELECT seq, pos, {proj('y', HIDDEN, HIDDEN, number['q_proj'])} AS q, {proj('y', HIDDEN, SIZE, number['k_proj'])} AS k, {proj('y', HIDDEN, SIZE, number['v_proj'])} AS v FROM a{n})",
            f"s{n} AS (SELECT a.seq, a.pos, h, exp({dot}) AS w, b.v FROM q{n} a JOIN q{n} b ON a.seq = b.seq AND b.pos <= a.pos, range({HEADS}) AS r(h))",
            f"o{n} AS (SELECT seq, pos, h, [{mixed}] AS y FROM s{n} GROUP BY 1, 2, 3)",
            f"c{n} AS MATERIALIZED (SELECT seq, pos, flatten(list(y ORDER BY h)) AS y FROM o{n} GROUP BY 1, 2)",
            f"p{n} AS MATERIALIZED (SELECT seq, pos, {proj('y', HIDDEN, HIDDEN, number['o_proj'])} AS y FROM c{n})",
            f"m{n} AS MATERIALIZED (SELECT seq, pos, list_transform(range({HIDDEN}), lambda j: x[j + 1] + p{n}.y[j + 1]) AS x FROM a{n} JOIN p{n} USING (seq, pos))",
            f"b{n} AS MATERIALIZED (SELECT seq, pos, x, {normed('x')} AS y FROM m{n})",
            f"g{n} AS MATERIALIZED (SELECT seq, pos, x, {proj('y', HIDDEN, FFN, number['gate_proj'])} AS g, {proj('y', HIDDEN, FFN, number['up_proj'])} AS u FROM b{n})",
            f"i{n} AS MATERIALIZED (SELECT seq, pos, x, list_transform(range({FFN}), lambda i: g[i + 1] / (1 + exp(-g[i + 1])) * u[i + 1]) AS z FROM g{n})",
            f"d{n} AS MATERIALIZED (SELECT seq, pos, x, {proj('z', FFN, HIDDEN, number['down_proj'])} AS y FROM i{n})",
            f"x{n + 1} AS MATERIALIZED (SELECT seq, pos, list_transform(range({HIDDEN}), lambda j: x[j + 1] + y[j + 1]) AS x FROM d{n})",
        ]
    out.append(f"f AS MATERIALIZED (SELECT seq, pos, {normed('x')} AS x FROM x{LAYERS})")
    out.append(f"logits AS MATERIALIZED (SELECT seq, pos, list_transform(range({VOCABULARY}), lambda t: list_sum(list_transform(range({HIDDEN}), lambda i: x[i + 1] * {w('t', 'i', 0)}))) AS y FROM f)")
    return ", ".join(out)


TOKENS = f"SELECT conv_id AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, coalesce(length(text), 0) % {VOCABULARY} AS token FROM conversations"


def register(c: Catalog) -> None:
    def tokens(spark, sf_dir):
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
        return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seq"), place.cast("long").alias("pos"), (F.coalesce(F.length("text"), F.lit(0)) % VOCABULARY).cast("int").alias("token"))

    model = {"layers": LAYERS, "heads": HEADS, "kv_heads": 1, "hidden": HIDDEN}

    @c.query("forward_layers", f"WITH {forward_sql(TOKENS)} SELECT seq, pos, (unnest(range(len(y))))::INT AS i, round(unnest(y), 6) + 0.0 AS y FROM logits")
    def forward_layers(spark, sf_dir):
        logits = parameters.forward(tokens(spark, sf_dir), rule_parameters(spark), **model)
        return logits.select("seq", "pos", F.posexplode("logits").alias("i", "y")).select("seq", "pos", "i", (F.round("y", 6) + 0.0).alias("y"))

    @c.query(
        "generated_tokens",
        f"""WITH {forward_sql(TOKENS)}, l AS (SELECT seq, max(pos) AS pos FROM t GROUP BY 1), n AS (SELECT seq, token, count(*) AS n FROM t GROUP BY 1, 2),
        y AS (SELECT seq, pos, unnest(range(len(y))) AS i, unnest(y) AS y FROM logits JOIN l USING (seq, pos)),
        p AS (SELECT y.seq, y.pos, i, y / power(1.3, coalesce(n, 0)) AS y FROM y LEFT JOIN n ON n.seq = y.seq AND n.token = y.i),
        b AS (SELECT seq, pos + 1 AS pos, arg_max(i, round(y, 9) * 1000 - i / 1000000.0) AS token FROM p GROUP BY ALL)
        SELECT seq, pos, token::INT AS token FROM b WHERE token <> 0""",
    )
    def generated_tokens(spark, sf_dir):
        """The likeliest next token of each conversation under the repeat penalty; token 0 ends it."""
        return parameters.generate(tokens(spark, sf_dir), rule_parameters(spark), 1, 0, penalty=1.3, **model)

    @c.query(
        "chat_commands",
        """WITH m AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN '/params ' || (turn * 10) || ' hot 0.' || (conv_id % 9 + 1) || '  1.5' WHEN 1 THEN '  /save' WHEN 2 THEN '/ls dir' || conv_id || ' more' WHEN 3 THEN '/exit now' ELSE '/load' END AS t, turn % 5 AS k FROM conversations)
        SELECT conv_id, turn, ['/params', '/save', '/ls', '/quit', '/load'][k + 1] AS command, CASE k WHEN 1 THEN 'chat_history.json' WHEN 2 THEN 'dir' || conv_id END AS argument, k = 4 AS usage,
            CASE k WHEN 0 THEN turn * 10 ELSE 512 END AS max_tokens, 0.7::DOUBLE AS temperature, CASE k WHEN 0 THEN ((conv_id % 9 + 1) / 10.0)::DOUBLE ELSE 0.9 END::DOUBLE AS top_p FROM m""",
    )
    def chat_commands(spark, sf_dir):
        turn, conv = F.col("turn"), F.col("conv_id")
        line = (
            F.when(turn % 5 == 0, F.concat(F.lit("/params "), (turn * 10).cast("string"), F.lit(" hot 0."), (conv % 9 + 1).cast("string"), F.lit("  1.5"))).when(turn % 5 == 1, F.lit("  /save"))
            .when(turn % 5 == 2, F.concat(F.lit("/ls dir"), conv.cast("string"), F.lit(" more"))).when(turn % 5 == 3, F.lit("/exit now")).otherwise(F.lit("/load"))
        )
        rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line")).select("conv_id", "turn", chat.parse_command(F.col("line")).alias("c"))
        return rows.select("conv_id", "turn", "c.command", "c.argument", "c.usage", "c.max_tokens", "c.temperature", "c.top_p")

    both = lambda i, j, n: f"({weight(i, j, n)} * 0.1 + {weight(i, j, n + 3)} * 0.9)"
    xent = "ln(list_sum(list_transform(y, lambda z: exp(z - list_max(y))))) + list_max(y) - y[token + 1]"

    @c.query(
        "averaged_model_loss",
        f"WITH {forward_sql(f'SELECT * FROM ({TOKENS}) WHERE seq IN (SELECT DISTINCT conv_id FROM conversations ORDER BY 1 LIMIT 500)', both)} SELECT count(DISTINCT seq) AS sequences, round(avg({xent}), 6) AS loss FROM (SELECT l.seq, l.y, t.token FROM logits l JOIN t ON t.seq = l.seq AND t.pos = l.pos + 1)",
    )
    def averaged_model_loss(spark, sf_dir):
        """The limit is the feature: an evaluation takes at most 500 sequences."""
        mean = parameters.averaged(rule_parameters(spark, 3), rule_parameters(spark), 0.9)
        return parameters.evaluate(tokens(spark, sf_dir), mean, 500, **model).withColumn("loss", F.round("loss", 6))

    @c.query(
        "blocked_attention",
        f"""WITH {VECTORS}, p AS (SELECT label AS seq, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, x, vec_id % 5 = 0 AS pad, len(x) // 4 AS d FROM e),
        s AS (SELECT a.seq, h, a.pos, list_dot_product(a.x[h * a.d + 1:(h + 1) * a.d], b.x[(h // 2) * b.d + 1:(h // 2 + 1) * b.d]) / sqrt(a.d) - (a.pos - b.pos) * power(2.0, -8 - h) AS score, b.x[(2 + h // 2) * b.d + 1:(3 + h // 2) * b.d] AS v
              FROM p a JOIN p b ON a.seq IS NOT DISTINCT FROM b.seq AND b.pos <= a.pos AND NOT b.pad, range(4) AS r(h)),
        w AS (SELECT seq, h, pos, exp(score - max(score) OVER (PARTITION BY seq, h, pos)) AS w, v FROM s),
        y AS (SELECT seq, h, pos, unnest(range(len(v))) AS i, w, unnest(v) AS v FROM w)
        SELECT seq::BIGINT AS seq, h::INT AS head, pos, i::INT AS i, round(sum(w * v) / sum(w), 9) + 0.0 AS y FROM y GROUP BY 1, 2, 3, 4""",
    )
    def blocked_attention(spark, sf_dir):
        """Four query heads in two groups; heads are quarters of the vectors. Blocks of 16, so that there are many."""
        rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("seq"), mm.doubles(F.col("embedding")).alias("x"))
        rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("seq").orderBy("vec_id")).cast("long") - 1).withColumn("d", (F.size("x") / 4).cast("int"))
        part = lambda h: F.slice("x", h * F.col("d") + 1, F.col("d"))
        q = rows.select("seq", "pos", F.explode(F.array(*[F.struct(F.lit(h).alias("head"), part(h).alias("q")) for h in range(4)])).alias("p")).select("seq", "pos", "p.*")
        k = rows.select("seq", "pos", (F.col("vec_id") % 5 == 0).alias("pad"), F.explode(F.array(*[F.struct(F.lit(g).alias("kv_head"), part(g).alias("k"), part(2 + g).alias("v")) for g in range(2)])).alias("p"))
        out = attention.blocked_attention(q, k.select("seq", "pos", "pad", "p.*"), 4, 2, alibi=True, block=16)
        return out.select("seq", "head", "pos", F.posexplode("out").alias("i", "y")).select("seq", "head", "pos", "i", (F.round("y", 9) + 0.0).alias("y"))

    @c.query(
        "parameter_counts",
        """WITH c AS (SELECT p_partkey AS id, p_partkey % 1000 + 256 AS v, 64 * (p_partkey % 5 + 1) AS h, p_size AS l, 256 * (p_partkey % 5 + 1) AS f, 64 * (p_partkey % 5 + 1) // (1 + p_partkey % 2) AS k, p_partkey % 2 = 0 AS tied,
            (p_partkey % 5 < 2)::INT AS ab, (p_partkey % 7 < 3)::INT AS fb, (p_partkey % 3 = 1)::INT AS g, 1 + (p_partkey % 4 = 0)::INT AS n, p_partkey % 3 = 0 AS learned FROM part)
        SELECT id AS config_id, 'embedding' AS part, (v * h)::BIGINT AS n FROM c UNION ALL SELECT id, 'output', v * h FROM c WHERE NOT tied UNION ALL SELECT id, 'position', 512 * h FROM c WHERE learned
        UNION ALL SELECT id, 'attention', l * (2 * h * h + 2 * h * k + ab * (2 * h + 2 * k)) FROM c WHERE l > 0 UNION ALL SELECT id, 'ffn', l * (2 * h * f + g * h * f + fb * (f + h + g * f)) FROM c WHERE l > 0
        UNION ALL SELECT id, 'norm', (2 * l + 1) * h * n FROM c""",
    )
    def parameter_counts(spark, sf_dir):
        k = F.col("p_partkey")
        hidden = 64 * (k % 5 + 1)
        configs = table(spark, sf_dir, "part").select(
            k.alias("config_id"), (k % 1000 + 256).alias("vocabulary"), hidden.alias("hidden"), F.col("p_size").alias("layers"), (4 * hidden).alias("ffn"), F.floor(hidden / (1 + k % 2)).alias("kv_size"),
            F.when(k % 3 == 0, 512).alias("positions"), (k % 2 == 0).alias("tied"), (k % 5 < 2).alias("attention_bias"), (k % 7 < 3).alias("ffn_bias"), (k % 3 == 1).alias("gated"), (k % 4 == 0).alias("norm_bias"),
        )
        return parameters.parameter_counts(parameters.catalogue(configs))

    @c.query(
        "event_records",
        """SELECT 'scalar' AS kind, event_id AS step, round(value, 9) AS value, NULL AS h, NULL::BIGINT AS num, NULL::BIGINT AS binned FROM events WHERE value IS NOT NULL
        UNION ALL SELECT 'text', event_id, NULL, md5(props), NULL, NULL FROM events WHERE props IS NOT NULL
        UNION ALL SELECT 'histogram', user_id, round(max(value), 9), NULL, count(value), count(value) FROM events WHERE value IS NOT NULL GROUP BY user_id""",
    )
    def event_records_query(spark, sf_dir):
        events, path = table(spark, sf_dir, "events"), _place(spark, "events")
        event_records.write_events(event_records.scalars(events, "loss", "value", "event_id", "ts"), path)
        event_records.write_events(event_records.texts(events, "props", "props", "event_id", "ts"), path)
        event_records.write_events(event_records.histograms(events, "values", "value", "user_id", "ts"), path)
        got = event_records.read_events(spark, path).where("problem IS NULL")
        binned = F.aggregate("histogram.bins", F.lit(0).cast("long"), lambda s, b: s + b["n"])
        return got.select("kind", "step", F.round(F.coalesce("value", "histogram.max"), 9).alias("value"), F.md5("text").alias("h"), F.col("histogram.num").alias("num"), binned.alias("binned"))

    @c.query(
        "resumed_fold",
        """WITH RECURSIVE o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value / 100 AS g FROM events),
        r AS (SELECT user_id, 0::BIGINT AS i, 1.0::DOUBLE AS p, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM (SELECT DISTINCT user_id FROM o)
        UNION ALL SELECT r.user_id, o.i, r.p - 0.001 * ((0.9 * r.m + (1 - 0.9) * o.g) / (1 - power(0.9, o.i))) / (sqrt((0.999 * r.v + (1 - 0.999) * o.g * o.g) / (1 - power(0.999, o.i))) + 1e-8),
        0.9 * r.m + (1 - 0.9) * o.g, 0.999 * r.v + (1 - 0.999) * o.g * o.g FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
        SELECT user_id, max(i)::DOUBLE AS t, round(arg_max(p, i), 9) AS p, round(arg_max(m, i), 9) AS m, round(arg_max(v, i), 9) AS v FROM r GROUP BY 1""",
    )
    def resumed_fold(spark, sf_dir):
        """The optimizer's fold of each user's values up to step 40, a checkpoint, and the rest from the restored states."""
        values = series.ordered_values(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
        rows = values.select("user_id", F.posexplode("values").alias("step", "x")).select("user_id", "step", (F.col("x") / 100).alias("g"))
        fold = lambda g, start: series.adam_state(g, start, 0.001)
        kept = Checkpoints(spark, _place(spark, "checkpoints"))
        kept.save(40, {"optimizer": resumed(rows.where("step <= 40"), "user_id", "step", None, "s", fold, "g")}, {"rate": 0.001}, keep=2)
        step, tables, _ = kept.restore()
        done = resumed(rows, "user_id", "step", tables["optimizer"], "s", fold, "g", after=step)
        return done.select("user_id", "s.t", *[F.round(f"s.{x}", 9).alias(x) for x in "pmv"])

    @c.query(
        "tracking_store",
        """WITH r AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS id, count(*) AS n, round(sum(value), 6) AS loss FROM events GROUP BY 1)
        SELECT id, md5(user_id::VARCHAR) AS config_hash, CASE id WHEN 2 THEN 'completed' ELSE 'running' END AS status, CASE id WHEN 1 THEN -1.0 END::DOUBLE AS best_loss, CASE id WHEN 2 THEN 0.5 END::DOUBLE AS final_loss,
            n + (id = 1)::INT AS metrics, round(loss - (id = 1)::INT, 4) AS loss FROM r WHERE id <> 3""",
    )
    def tracking_store(spark, sf_dir):
        """A run for each user with a metric for each event; one run goes on, one ends, one is deleted, and the metrics are compacted."""
        store = Store(spark, _place(spark, "store"))
        events = table(spark, sf_dir, "events")
        runs = events.groupBy("user_id").agg(F.count("*").alias("total_steps"))
        store.append("training_runs", runs.select("user_id", F.md5(F.col("user_id").cast("string")).alias("config_hash"), "total_steps"), "user_id")
        ids = store.table("training_runs").select(F.col("id").alias("run_id"), "config_hash")
        metrics = events.withColumn("config_hash", F.md5(F.col("user_id").cast("string"))).join(ids, "config_hash")
        store.append("metrics", metrics.select("run_id", F.col("event_id").alias("step"), F.col("value").alias("loss")), "step")
        store.update_run(1, 1_000_000_000, -1.0, "running")
        store.complete_run(2, 0.5)
        store.delete_run(3)
        store.compact("metrics")
        by = store.table("metrics").groupBy("run_id").agg(F.count("*").alias("metrics"), F.round(F.sum("loss"), 4).alias("loss"))
        return store.table("training_runs").join(by, F.col("id") == F.col("run_id")).select("id", "config_hash", "status", "best_loss", "final_loss", "metrics", "loss")

    @c.query("listed_datasets", "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey / 100.0 ELSE 0 END::DOUBLE AS download_progress FROM supplier")
    def listed_datasets(spark, sf_dir):
        k = F.col("s_suppkey")
        return tracking.listed_datasets(table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), F.when(k % 3 > 0, k / 100.0).alias("download_progress")))

    @c.query("step_pipeline", "SELECT coalesce(lang, 'none') AS lang, count(*) AS documents, sum(length(text))::BIGINT AS chars, max(length(text))::BIGINT AS longest FROM documents WHERE regexp_matches(text, '\\S') GROUP BY 1")
    def step_pipeline(spark, sf_dir):
        """Clean, measure and summarise; the second run finds every step done."""
        clean = Step("clean", lambda s, _: table(s, sf_dir, "documents").where(is_not_blank("text")).select("doc_id", "lang", "text"), files=(f"{sf_dir}/documents.parquet",))
        sizes = Step("sizes", lambda s, t: t["clean"].select(F.coalesce("lang", F.lit("none")).alias("lang"), F.length("text").cast("long").alias("chars")), needs=("clean",))
        total = Step("total", lambda s, t: t["sizes"].groupBy("lang").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"), F.max("chars").alias("longest")), needs=("sizes",))
        path = _place(spark, "steps")
        StepPipeline(spark, path, [total, clean, sizes]).run()
        tables, done = StepPipeline(spark, path, [total, clean, sizes]).run()
        if done:
            raise RuntimeError(f"steps {done} were done again")
        return tables["total"]

    @c.query(
        "nucleus_draw",
        f"""WITH {VECTORS}, l AS (SELECT vec_id, unnest(range(len(x))) AS i, exp(unnest(x) - list_max(x)) AS w FROM e), t AS (SELECT *, sum(w) OVER (PARTITION BY vec_id) AS t FROM l),
        c AS (SELECT vec_id, i, w / t AS p, sum(w / t) OVER (PARTITION BY vec_id ORDER BY w DESC, i ROWS UNBOUNDED PRECEDING) AS s FROM t),
        n AS (SELECT *, sum(p) OVER (PARTITION BY vec_id) AS mass, ('0x' || substr(md5('5:' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM c WHERE s - p < 0.9)
        SELECT vec_id, (arg_min(i, s) FILTER (WHERE s > u * mass))::INT AS token FROM n GROUP BY 1""",
    )
    def nucleus_draw(spark, sf_dir):
        rows = table(spark, sf_dir, "embeddings").select("vec_id", mm.doubles(F.col("embedding")).alias("x"))
        return rows.select("vec_id", mm.draw_nucleus(F.col("x"), 0.9, pack.uniform(5, F.col("vec_id"))).alias("token"))

    @c.query(
        "stochastic_depth",
        """SELECT p_partkey, array_to_string(list_filter(range(p_size), lambda i: ('0x' || substr(md5('3:' || p_partkey || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= 0.5 * (i / p_size)), ' ') AS layers FROM part""",
    )
    def stochastic_depth(spark, sf_dir):
        kept = mm.kept_layers(F.col("p_size"), 0.5, 3, F.col("p_partkey"))
        return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(kept, lambda i: i.cast("string")), " ").alias("layers"))

    codes = "list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda x: x <> ''), lambda x: unicode(x))"

    @c.query(
        "first_violations",
        f"""WITH a AS (SELECT doc_id, {codes} AS a FROM documents), b AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN a[1:len(a) - 1] WHEN 1 THEN list_append(a[2:], 300) ELSE list_append(a[2:], 7) END AS b FROM a),
        v AS (SELECT doc_id, len(a) <> len(b) AS l, list_position(list_transform(a, lambda x: x >= 250), true) - 1 AS i, list_position(list_transform(b, lambda x: x >= 250), true) - 1 AS t FROM b)
        SELECT doc_id, CASE WHEN l THEN 'length' WHEN i >= 0 THEN 'input' WHEN t >= 0 THEN 'target' END AS problem, CASE WHEN l THEN NULL WHEN i >= 0 THEN i WHEN t >= 0 THEN t END::INT AS position FROM v""",
    )
    def first_violations(spark, sf_dir):
        a, n = F.col("a"), F.size("a")
        rest = F.slice("a", 2, F.greatest(n - 1, F.lit(0)))
        b = F.when(F.col("doc_id") % 5 == 0, F.slice("a", 1, F.greatest(n - 1, F.lit(0)))).when(F.col("doc_id") % 5 == 1, F.array_append(rest, F.lit(300))).otherwise(F.array_append(rest, F.lit(7)))
        rows = table(spark, sf_dir, "documents").select("doc_id", pack.char_tokens(F.coalesce("text", F.lit(""))).alias("a")).select("doc_id", "a", b.alias("b"))
        v = rows.select("doc_id", pack.first_violation(F.array(a), F.array(F.col("b")), 250).alias("v"))
        return v.select("doc_id", "v.problem", "v.position")

    @c.query(
        "training_progress",
        """WITH o AS (SELECT user_id, row_number() OVER w AS step, event_id % 7 + 1 AS tokens, epoch(ts) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        r AS (SELECT user_id, step, greatest(s - first_value(s) OVER w, 1e-6) AS e, sum(tokens) OVER w AS t FROM o WINDOW w AS (PARTITION BY user_id ORDER BY step))
        SELECT user_id, step, round(step / e, 9) AS steps_per_sec, round(t / e, 9) AS tokens_per_sec, round((10000 - step) / greatest(step / e, 1e-6), 6) AS seconds_left FROM r WHERE step % 10 = 0 OR step <= 1""",
    )
    def training_progress(spark, sf_dir):
        step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
        rows = table(spark, sf_dir, "events").select("user_id", step.alias("step"), (F.col("event_id") % 7 + 1).alias("tokens"), "ts")
        out = series.progress(rows, "user_id", "step", "ts", "tokens", F.lit(10000), 10)
        return out.select("user_id", "step", F.round("steps_per_sec", 9).alias("steps_per_sec"), F.round("tokens_per_sec", 9).alias("tokens_per_sec"), F.round("seconds_left", 6).alias("seconds_left"))

    @c.query(
        "config_files",
        """SELECT p_partkey, p_partkey % 11 = 0 AS broken, CASE WHEN p_partkey % 11 > 0 THEN 64 * (p_partkey % 5 + 1) END::INT AS hidden_dim, CASE WHEN p_partkey % 11 > 0 THEN p_size END::INT AS num_heads,
            CASE WHEN p_partkey % 11 > 0 THEN 'gqa' END AS attention, CASE WHEN p_partkey % 11 > 0 THEN p_partkey % 7 END::INT AS num_groups, CASE WHEN p_partkey % 11 > 0 THEN 0.9 END::DOUBLE AS beta1,
            CASE WHEN p_partkey % 11 > 0 THEN 1.5 END::DOUBLE AS mix_total, CASE WHEN p_partkey % 11 > 0 THEN 1 END AS mix_unnamed, CASE WHEN p_partkey % 11 > 0 THEN 1 END AS mix_out_of_range FROM part""",
    )
    def config_files(spark, sf_dir):
        """A TOML text for each part; one in eleven is cut off."""
        k = F.col("p_partkey")
        mix = '[[dataset.mix]]\nname = "a"\npercentage = 1.25\n[[dataset.mix]]\npercentage = 0.25\n'
        body = F.concat(
            F.lit(mix + "[model]\nhidden_dim = "), (64 * (k % 5 + 1)).cast("string"), F.lit("\nnum_heads = "), F.col("p_size").cast("string"), F.lit('\nattention = { type = "gqa", num_groups = '), (k % 7).cast("string"),
            F.lit(' }\n[training]\nlearning_rate = 1\noptimizer = { type = "adamw", beta1 = 0.9 }\n'),
        )
        texts = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 11 == 0, F.lit("[model\n")).otherwise(body).alias("text"))
        read = configs.read_configs(texts, "p_partkey")
        return read.select("p_partkey", F.col("problem").isNotNull().alias("broken"), "hidden_dim", "num_heads", "attention", "num_groups", "beta1", "mix_total", "mix_unnamed", "mix_out_of_range")
