"""Queries of the tracking store over stand-in tables: orders as checkpoints, events as metrics and system events, part as trials, customer as runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.catalog import Catalog
from loomspark.operators import chat, rules, series, tracking
from loomspark.tables import table

CHECKPOINTS = "c AS (SELECT o_custkey AS run_id, o_orderkey AS step, o_totalprice AS loss, 'ckpt-' || o_orderkey AS path, (o_orderstatus = 'F')::INT AS is_best, o_orderdate AS created_at FROM orders)"
METRICS = "m AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value AS loss, ts, event_id, event_type FROM events)"
STAGES = ("view", "click", "cart", "purchase")


def register(c: Catalog) -> None:
    def checkpoints(spark, sf_dir):
        o = table(spark, sf_dir, "orders")
        return o.select(
            F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("loss"),
            F.concat(F.lit("ckpt-"), "o_orderkey").alias("path"), (F.col("o_orderstatus") == "F").cast("int").alias("is_best"), F.col("o_orderdate").alias("created_at"),
        )

    def metrics(spark, sf_dir):
        from pyspark.sql import Window

        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.row_number().over(w).cast("long").alias("step"), F.col("value").alias("loss"), "ts", "event_id", "event_type")

    def trials(spark, sf_dir):
        p = table(spark, sf_dir, "part")
        return p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("param_value"), F.col("p_retailprice").alias("objective_value"), F.when(F.col("p_size") % 3 == 0, "completed").otherwise("running").alias("status"))

    @c.query("run_best", f"WITH {CHECKPOINTS} SELECT run_id, step, loss, path FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY loss, step) AS r FROM c WHERE is_best = 1) WHERE r = 1")
    def run_best(spark, sf_dir):
        return tracking.best_checkpoint(checkpoints(spark, sf_dir))

    @c.query("run_latest", f"WITH {CHECKPOINTS} SELECT run_id, step, loss, path FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS r FROM c) WHERE r = 1")
    def run_latest(spark, sf_dir):
        return tracking.latest_checkpoint(checkpoints(spark, sf_dir))

    @c.query("run_checkpoints", f"WITH {CHECKPOINTS} SELECT run_id, step, loss, path FROM c WHERE run_id = 7")
    def run_checkpoints(spark, sf_dir):
        return tracking.by_run(checkpoints(spark, sf_dir), 7).select("run_id", "step", "loss", "path").orderBy("step")

    @c.query("run_top_n", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
    def run_top_n(spark, sf_dir):
        return tracking.last_rows(table(spark, sf_dir, "orders"), 20, "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")

    @c.query("metric_series", f"WITH {METRICS} SELECT run_id, step, loss, coalesce(NULL, 0.0)::DOUBLE AS learning_rate FROM m")
    def metric_series(spark, sf_dir):
        return metrics(spark, sf_dir).select("run_id", "step", "loss", F.coalesce(F.lit(None).cast("double"), F.lit(0.0)).alias("learning_rate"))

    @c.query(
        "run_stats",
        """WITH m AS (SELECT user_id AS run_id, count(*) AS n_metrics, min(value) AS min_loss, round(avg(value), 9) AS avg_loss FROM events GROUP BY 1),
        e AS (SELECT user_id AS run_id, count(*) AS n_evaluations, min(value + 1) AS best_perplexity FROM events WHERE event_type = 'purchase' GROUP BY 1)
        SELECT run_id, coalesce(n_metrics, 0)::BIGINT AS n_metrics, coalesce(min_loss, 0.0) AS min_loss, coalesce(avg_loss, 0.0) AS avg_loss, coalesce(n_evaluations, 0)::BIGINT AS n_evaluations, best_perplexity FROM m FULL JOIN e USING (run_id)""",
    )
    def run_stats(spark, sf_dir):
        ev = table(spark, sf_dir, "events")
        m = ev.select(F.col("user_id").alias("run_id"), F.col("value").alias("loss"))
        e = ev.where("event_type = 'purchase'").select(F.col("user_id").alias("run_id"), (F.col("value") + 1).alias("perplexity"))
        return tracking.run_stats(m, e).withColumn("avg_loss", F.round("avg_loss", 9))

    @c.query("event_last_n", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
    def event_last_n(spark, sf_dir):
        return tracking.last_per_key(table(spark, sf_dir, "events"), "user_id", 5, "ts", "event_id").select("user_id", "event_id", "event_type")

    @c.query("retry_counts", "SELECT user_id, count(*) AS retry_count, max(ts) AS last_retry_at FROM events WHERE event_type = 'error' OR value < 10 GROUP BY 1")
    def retry_counts(spark, sf_dir):
        return table(spark, sf_dir, "events").where("event_type = 'error' OR value < 10").groupBy("user_id").agg(F.count("*").alias("retry_count"), F.max("ts").alias("last_retry_at"))

    @c.query("dataset_upsert", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
    def dataset_upsert(spark, sf_dir):
        return tracking.upsert(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")

    @c.query("run_progress", f"WITH {METRICS} SELECT run_id, max(step) AS current_step, min(loss) AS best_loss, arg_max(loss, step) AS final_loss FROM m GROUP BY 1")
    def run_progress(spark, sf_dir):
        return metrics(spark, sf_dir).groupBy("run_id").agg(F.max("step").alias("current_step"), F.min("loss").alias("best_loss"), F.max_by("loss", "step").alias("final_loss"))

    @c.query("hparam_best", "SELECT p_partkey AS id, p_size AS param_value, p_retailprice AS objective_value FROM part WHERE p_size % 3 = 0 ORDER BY p_retailprice, p_partkey LIMIT 25")
    def hparam_best(spark, sf_dir):
        return tracking.best_trials(trials(spark, sf_dir), 25).select("id", "param_value", "objective_value")

    @c.query("checkpoint_retention", f"WITH {CHECKPOINTS} SELECT run_id, step, row_number() OVER (PARTITION BY run_id ORDER BY created_at DESC, step DESC) <= 5 AS keep FROM c")
    def checkpoint_retention(spark, sf_dir):
        return tracking.retained(checkpoints(spark, sf_dir), 5, "created_at", "step").select("run_id", "step", "keep")

    @c.query("log_every_n_steps", f"WITH {METRICS} SELECT run_id, step, loss FROM m WHERE step % 10 = 0")
    def log_every_n_steps(spark, sf_dir):
        return metrics(spark, sf_dir).where("step % 10 = 0").select("run_id", "step", "loss")

    @c.query("batch_loss_series", f"WITH {METRICS} SELECT run_id, (step - 1) // 8 AS batch_id, round(avg(loss), 9) AS loss, max((loss > 100)::INT) = 1 AS overflow FROM m GROUP BY 1, 2")
    def batch_loss_series(spark, sf_dir):
        m = metrics(spark, sf_dir).withColumn("batch_id", F.floor((F.col("step") - 1) / 8).cast("long"))
        return m.groupBy("run_id", "batch_id").agg(F.round(F.avg("loss"), 9).alias("loss"), F.bool_or(F.col("loss") > 100).alias("overflow"))

    @c.query("throughput", "SELECT user_id, count(*) AS n, round(count(*) / greatest(epoch(max(ts)) - epoch(min(ts)), 1.0), 9) AS steps_per_sec FROM events GROUP BY 1")
    def throughput(spark, sf_dir):
        span = F.greatest(F.max("ts").cast("timestamp").cast("double") - F.min("ts").cast("timestamp").cast("double"), F.lit(1.0))
        return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.count("*") / span, 9).alias("steps_per_sec"))

    fmt = lambda d, x: f"printf('%.{d}f', {x})"

    @c.query(
        "step_log_csv",
        f"WITH {METRICS} SELECT step::VARCHAR AS step, {fmt(6, 'loss')} AS loss, CASE WHEN step % 10 = 0 THEN {fmt(6, 'loss')} ELSE '' END AS eval_loss, {fmt(8, '0.001 / step')} AS learning_rate, {fmt(2, 'loss * 2')} AS tokens_per_second, '0' AS epoch, '' AS gradient_norm, '' AS gpu_memory_mb, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp FROM m",
    )
    def step_log_csv(spark, sf_dir):
        none = F.lit(None).cast("double")
        m = metrics(spark, sf_dir)
        rows = m.select(
            "step", "loss", F.when(F.col("step") % 10 == 0, F.col("loss")).alias("eval_loss"), (0.001 / F.col("step")).alias("learning_rate"), (F.col("loss") * 2).alias("tokens_per_second"),
            F.lit(0).alias("epoch"), none.alias("gradient_norm"), none.alias("gpu_memory_mb"), F.col("ts").alias("timestamp"),
        )
        return rules.step_log(rows)

    kinds = "IO Config Data Model Training Tokenizer Database Serialization Network Download Preprocessing Validation Device Parse Checkpoint Distributed OutOfMemory GradientOverflow GPU Timeout Strange".split()
    endings = ["", " 404", " locked", " 解析", " 不能被", " 内存", " 文件不存在", " 无法下载"]
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

    @c.query(
        "error_classification",
        f"""WITH e AS (SELECT event_id, {listed(kinds)}[event_id % 21 + 1] AS k, event_type AS context, 'event ' || event_id || {listed(endings)}[event_id % 8 + 1] AS message FROM events),
        s AS (SELECT event_id, CASE WHEN k = 'Strange' THEN 'Unknown' ELSE k END AS error_type, context, message,
            CASE WHEN k IN ('OutOfMemory', 'GPU') THEN 'critical' WHEN k IN ('Network', 'Download', 'Preprocessing', 'Checkpoint', 'GradientOverflow', 'Timeout') THEN 'warning' ELSE 'error' END AS severity,
            k IN ('Network', 'Download', 'GradientOverflow', 'Timeout', 'Checkpoint', 'Preprocessing') AS recoverable, k IN ('Network', 'Download', 'Timeout') AS retry,
            CASE k WHEN 'Config' THEN CASE WHEN message LIKE '%文件不存在%' THEN 'generate a default configuration file' WHEN message LIKE '%解析%' THEN 'check that the file is valid TOML' ELSE 'check the settings' END
                WHEN 'Network' THEN 'check the connection or use a mirror' WHEN 'Download' THEN CASE WHEN message LIKE '%404%' OR message LIKE '%无法下载%' THEN 'check the name of the dataset or download it by hand' ELSE 'check the connection and the address' END
                WHEN 'OutOfMemory' THEN 'use smaller batches or accumulate gradients' WHEN 'GradientOverflow' THEN 'lower the learning rate, raise the gradient limit or use mixed precision'
                WHEN 'Device' THEN 'check the device or use the CPU' WHEN 'Validation' THEN CASE WHEN message LIKE '%不能被%' THEN 'make the dimensions of the model match' ELSE 'check the limits of the settings' END
                WHEN 'Tokenizer' THEN CASE WHEN message LIKE '%内存%' THEN 'train from files instead of texts in memory' ELSE 'check the tokenizer''s settings' END
                WHEN 'Database' THEN CASE WHEN message LIKE '%locked%' THEN 'wait for other processes or raise the timeout' ELSE 'check permissions and disk space' END END AS suggestion FROM e)
        SELECT event_id, error_type, severity, recoverable, retry, suggestion, upper(substr(severity, 1, 1)) || '|' || context || '|' || message AS compact,
            '[' || upper(severity) || '] ' || context || ': ' || error_type || ' error: ' || message || coalesce(' (hint: ' || suggestion || ')', '') AS human,
            CASE WHEN suggestion IS NOT NULL THEN md5(to_json(struct_pack(error_type, severity, context, message, recoverable, retry, suggestion))::VARCHAR) END AS h FROM s""",
    )
    def error_classification(spark, sf_dir):
        pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (F.col("event_id") % len(xs)).cast("int"))
        e = table(spark, sf_dir, "events").select("event_id", pick(kinds).alias("error_type"), F.col("event_type").alias("context"), F.concat(F.lit("event "), "event_id", pick(endings)).alias("message"))
        out = rules.error_lines(rules.classify_errors(e))
        return out.select("event_id", "error_type", "severity", "recoverable", "retry", "suggestion", "compact", "human", F.when(F.col("suggestion").isNotNull(), F.md5("json")).alias("h"))

    # Settings of the generated configurations, around each limit: a row takes the value at its number times a step, modulo the number of values.
    settings = {
        "mix_total": [1.0, 0.5, 1.0000001, 1.1], "mix_count": [2, 0, 1], "mix_unnamed": [0, 1], "mix_repeated": [0, 0, 1], "mix_out_of_range": [0, 1, 0], "size_gb": [10.0, 0.0, 1000.0, 1000.5, -1.0], "num_shards": [4, 0],
        "source": ["hub", "local", "url", "mirror"], "local_path": [None, "/x", "/y"], "local_exists": [True, False], "url": ["http://a", "https://a", "ftp://a"], "cache_is_file": [False, False, True],
        "num_layers": [12, 0, 100, 101], "hidden_dim": [768, 0, 257, 16384, 16385], "num_heads": [12, 0, 8], "attention": ["mha", "gqa", "window", "gqa_window", "mqa"], "num_groups": [4, 0, 5], "window_size": [128, 0, 4096], "kv_heads": [None, 4, 5],
        "dropout": [0.1, 0.0, 0.5, 0.6, 1.0, -0.1], "stochastic_depth": [None, 0.0, 0.99, 1.0, -0.5], "position": ["rope", "alibi", "learned", "sinusoidal"], "rope_theta": [None, 10000.0, 0.0, 999.0, 1000.0, 100000.0, 100001.0],
        "normalization": ["rms", "layer"], "rms_eps": [None, 1e-6, 0.0, 1.0], "max_positions": [1024, 0, 128000, 128001], "learning_rate": [0.0003, 0.0, -0.1, 1.0, 1.5, 1e-8], "min_learning_rate": [None, 0.00001, -1.0, 0.1],
        "scheduler": ["linear", "cosine", "restarts", "one_cycle", "constant"], "schedule_min": [0.0, -0.1], "restart_interval": [100, 0], "max_rate": [0.01, 0.0001], "pct_start": [0.3, 0.0, 1.0], "optimizer": ["adamw", "adam", "lamb", "sgd"],
        "beta1": [0.9, 1.0, -0.1], "beta2": [0.999, 1.0, 0.0], "epsilon": [1e-8, 0.0, 1.0], "momentum": [0.9, 1.0, 0.0], "weight_decay": [0.01, -0.1, 0.1, 0.2], "grad_clip": [1.0, 0.0, -1.0], "batch_size": [32, 0, 3, 4],
        "micro_batch_size": [None, 8, 0, 64], "num_steps": [1000, 0, 101], "warmup_steps": [100, 0, 500, 501, 1001, 50, 51], "sequence_length": [512, 0, 1025], "eval_interval": [100, 0, 5], "log_interval": [10, 200], "save_interval": [500, 0, 50],
        "accumulation_steps": [1, 0, 32, 33], "ema_decay": [None, 0.999, 0.9, 0.89, 1.0], "mixed_precision": [None, "bf16", "fp16", "fp8"], "max_checkpoints": [5, 0], "num_workers": [4, 0, 16, 17], "cpu_count": [8], "device": ["auto", "cuda", "mps", "rocm", "cpu"],
        "use_tf32": [False, True], "log_level": ["INFO", "warn", "verbose"], "events_is_file": [False, True, False], "csv_is_folder": [False, False, True],
    }
    gpus = [[], [0, 1], [0, 8], [2, 2]]
    steps = {name: 2 * k + 1 for k, name in enumerate(settings)}
    written = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else str(x)
    at = lambda name, n: f"((i + i // {n}) * {steps[name]}) % {n}"
    made = ", ".join(f"[{', '.join(map(written, xs))}][{at(k, len(xs))} + 1] AS {k}" for k, xs in settings.items())

    @c.query(
        "config_rules",
        f"""WITH c AS (SELECT i AS config_id, {made}, [[]::INT[], [0, 1], [0, 8], [2, 2]][(i // 3) % 4 + 1] AS gpu_ids FROM (SELECT p_partkey AS i FROM part)),
        v AS (SELECT config_id, 'dataset' AS section, [CASE WHEN mix_total < 1 - 1e-6 OR mix_total > 1 + 1e-6 THEN 'error mix_total' END, CASE mix_count WHEN 0 THEN 'error mix_none' END, CASE WHEN mix_unnamed >= 1 THEN 'error mix_unnamed' END,
                CASE WHEN mix_repeated >= 1 THEN 'warning mix_repeated' END, CASE WHEN mix_out_of_range >= 1 THEN 'error mix_range' END, CASE WHEN size_gb <= 0 THEN 'warning size_small' WHEN size_gb > 1000 THEN 'warning size_large' END,
                CASE num_shards WHEN 0 THEN 'error shards_zero' END, CASE source WHEN 'local' THEN CASE WHEN local_path IS NULL THEN 'error local_unset' WHEN NOT local_exists THEN 'error local_missing' END
                WHEN 'url' THEN CASE WHEN regexp_matches(url, '^https?://') THEN NULL ELSE 'warning url_scheme' END END, CASE WHEN cache_is_file THEN 'error cache_file' END] AS found FROM c
            UNION ALL SELECT config_id, 'model', [CASE WHEN num_layers = 0 THEN 'error layers_zero' WHEN num_layers > 100 THEN 'warning layers_many' END, CASE WHEN hidden_dim = 0 THEN 'error hidden_zero' WHEN hidden_dim > 16384 THEN 'warning hidden_large' END,
                CASE num_heads WHEN 0 THEN 'error heads_zero' ELSE CASE WHEN hidden_dim > 0 AND mod(hidden_dim, num_heads) > 0 THEN 'error hidden_heads' END END, CASE WHEN num_heads > 0 AND hidden_dim > 0 AND mod(hidden_dim, num_heads) > 0 THEN 'suggestion hidden_heads' END,
                CASE WHEN attention LIKE 'gqa%' AND num_groups = 0 THEN 'error groups_zero' END, CASE WHEN attention LIKE 'gqa%' AND num_heads > 0 THEN CASE WHEN num_groups = 0 THEN 'error groups_heads' WHEN mod(num_heads, num_groups) > 0 THEN 'error groups_heads' END END,
                CASE WHEN attention LIKE 'gqa%' AND kv_heads IS NOT NULL AND kv_heads <> num_groups THEN 'warning groups_kv' END, CASE WHEN NOT (dropout >= 0 AND dropout < 1) THEN 'error dropout_range' WHEN dropout > 0.5 THEN 'warning dropout_high' END,
                CASE WHEN NOT (stochastic_depth >= 0 AND stochastic_depth < 1) THEN 'error depth_range' END, CASE WHEN attention LIKE '%window' AND window_size = 0 THEN 'error window_zero' END, CASE WHEN attention LIKE '%window' AND window_size > max_positions THEN 'error window_large' END,
                CASE WHEN position <> 'rope' THEN NULL WHEN rope_theta <= 0 THEN 'error theta_sign' WHEN rope_theta NOT BETWEEN 1000 AND 100000 THEN 'warning theta_odd' END, CASE position WHEN 'alibi' THEN 'suggestion alibi_window' END,
                CASE WHEN normalization = 'rms' AND NOT (rms_eps > 0 AND rms_eps < 1) THEN 'error norm_eps' END, CASE WHEN max_positions = 0 THEN 'error positions_zero' WHEN max_positions > 128000 THEN 'warning positions_many' END] FROM c
            UNION ALL SELECT config_id, 'training', [CASE WHEN learning_rate <= 0 THEN 'error rate_sign' WHEN learning_rate > 1 THEN 'warning rate_high' WHEN learning_rate < 1e-7 THEN 'warning rate_low' END,
                CASE WHEN min_learning_rate < 0 THEN 'error least_rate_sign' WHEN min_learning_rate > learning_rate THEN 'error least_rate_high' END, CASE WHEN scheduler IN ('cosine', 'restarts') AND schedule_min < 0 THEN 'error schedule_least' END,
                CASE WHEN scheduler = 'restarts' AND restart_interval = 0 THEN 'error restart_zero' END, CASE WHEN scheduler = 'one_cycle' AND max_rate < learning_rate THEN 'error cycle_top' END, CASE WHEN scheduler = 'one_cycle' AND NOT (pct_start > 0 AND pct_start < 1) THEN 'error cycle_start' END,
                CASE WHEN optimizer = 'sgd' THEN CASE WHEN NOT (momentum >= 0 AND momentum < 1) THEN 'error momentum_range' END ELSE CASE WHEN NOT (beta1 >= 0 AND beta1 < 1) THEN 'error beta1_range' END END,
                CASE WHEN optimizer <> 'sgd' AND NOT (beta2 >= 0 AND beta2 < 1) THEN 'error beta2_range' END, CASE WHEN optimizer <> 'sgd' AND NOT (epsilon > 0 AND epsilon < 1) THEN 'warning epsilon_odd' END,
                CASE WHEN weight_decay < 0 THEN 'error decay_sign' WHEN weight_decay > 0.1 THEN 'warning decay_high' END, CASE WHEN grad_clip < 0 THEN 'error clip_sign' WHEN grad_clip = 0 THEN 'warning clip_off' END,
                CASE WHEN batch_size = 0 THEN 'error batch_zero' WHEN batch_size < 4 THEN 'warning batch_small' END, CASE WHEN micro_batch_size = 0 THEN 'error micro_zero' WHEN micro_batch_size > batch_size THEN 'warning micro_large' END,
                CASE num_steps WHEN 0 THEN 'error steps_zero' END, CASE WHEN warmup_steps > num_steps THEN 'error warmup_long' WHEN warmup_steps > num_steps // 2 THEN 'warning warmup_half' END,
                CASE WHEN sequence_length = 0 THEN 'error length_zero' WHEN sequence_length > max_positions THEN 'error length_positions' END, CASE WHEN eval_interval > 0 AND eval_interval < log_interval THEN 'warning eval_often' END,
                CASE WHEN save_interval > 0 AND save_interval < eval_interval THEN 'warning save_often' END, CASE WHEN accumulation_steps = 0 THEN 'error accumulation_zero' WHEN accumulation_steps > 32 THEN 'warning accumulation_many' END,
                CASE WHEN NOT (ema_decay >= 0.9 AND ema_decay < 1) THEN 'warning average_decay' END, CASE mixed_precision WHEN 'bf16' THEN 'suggestion bf16_hardware' WHEN 'fp8' THEN 'warning fp8_hardware' END, CASE max_checkpoints WHEN 0 THEN 'warning checkpoints_none' END] FROM c
            UNION ALL SELECT config_id, 'hardware', [CASE WHEN list_max(gpu_ids) >= 8 THEN 'warning gpu_number' END, CASE WHEN len(list_distinct(gpu_ids)) < len(gpu_ids) THEN 'warning gpu_repeated' END,
                CASE WHEN num_workers > cpu_count * 2 THEN 'warning workers_many' WHEN num_workers = 0 THEN 'warning workers_none' END, CASE device WHEN 'cuda' THEN 'suggestion driver_needed' WHEN 'mps' THEN 'warning device_system' WHEN 'rocm' THEN 'suggestion device_support' END,
                CASE WHEN use_tf32 THEN 'suggestion tf32_hardware' END] FROM c
            UNION ALL SELECT config_id, 'logging', [CASE WHEN upper(log_level) NOT IN ('DEBUG', 'INFO', 'WARN', 'ERROR') THEN 'warning level_unknown' END, CASE WHEN events_is_file THEN 'error events_file' END, CASE WHEN csv_is_folder THEN 'error csv_folder' END] FROM c),
        x AS (SELECT config_id, section, unnest(list_filter(found, lambda f: f IS NOT NULL)) AS f FROM v)
        SELECT config_id, section, split_part(f, ' ', 1) AS severity, split_part(f, ' ', 2) AS code FROM x""",
    )
    def config_rules(spark, sf_dir):
        i = F.col("config_id")
        value = lambda k, xs: F.get(F.array(*[F.lit(x) for x in xs]), (((i + F.floor(i / len(xs))) * steps[k]) % len(xs)).cast("int")).alias(k)
        cards = F.get(F.array(*[F.array(*[F.lit(x) for x in g]).cast("array<int>") for g in gpus]), (F.floor(i / 3) % 4).cast("int")).alias("gpu_ids")
        rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("config_id")).select("config_id", *[value(k, xs) for k, xs in settings.items()], cards)
        return rules.config_violations(rows).drop("message")

    system = "string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn) FILTER (WHERE role = 'system')"
    said = "string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn) FILTER (WHERE role <> 'system' AND NOT (role = 'assistant' AND text = '') AND back < 21)"

    @c.query(
        "chat_prompts",
        f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS back FROM conversations)
        SELECT conv_id, md5(coalesce({system}, '') || coalesce({said}, '') || '<|user|>' || chr(10) || 'Go on.' || chr(10) || '<|assistant|>' || chr(10)) AS h FROM b GROUP BY 1""",
    )
    def chat_prompts(spark, sf_dir):
        h = chat.history(table(spark, sf_dir, "conversations"), "conv_id", "turn")
        return h.select("conv_id", F.md5(chat.prompt(F.col("messages"), F.lit("Go on."))).alias("h"))

    @c.query(
        "prompt_combine_split",
        """WITH p AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY 1)
        SELECT conv_id, md5(array_to_string(t, chr(10) || chr(10) || '---SEPARATOR---' || chr(10) || chr(10))) AS combined, md5(array_to_string(list_concat(list_transform(t, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), ['', '']), '|')) AS parts FROM p""",
    )
    def prompt_combine_split(spark, sf_dir):
        h = chat.history(table(spark, sf_dir, "conversations"), "conv_id", "turn")
        joined = h.select("conv_id", chat.combine(F.transform("messages", lambda m: m["text"])).alias("c"), (F.size("messages") + 2).alias("n"))
        return joined.select("conv_id", F.md5("c").alias("combined"), F.md5(F.array_join(chat.split_responses(F.col("c"), F.col("n")), "|")).alias("parts"))

    @c.query("role_filter", "SELECT conv_id, turn, text FROM conversations WHERE role = 'system'")
    def role_filter(spark, sf_dir):
        return chat.cleared(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "text")

    @c.query("context_use", "SELECT conv_id, sum(length(text) // 2)::BIGINT AS tokens, sum(length(text) // 2) / 4096.0::DOUBLE AS share FROM conversations GROUP BY 1")
    def context_use(spark, sf_dir):
        return chat.context_use(table(spark, sf_dir, "conversations"), "conv_id", 4096)

    @c.query("latency_pctl", """WITH s AS (SELECT event_type, list_sort(list(value)) AS v, round(avg(value), 9) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms, round(quantile_cont(value, 0.5), 9) AS p50_ms FROM events GROUP BY 1)
        SELECT event_type, avg_ms, min_ms, max_ms, p50_ms, v[least(ceil(len(v) * 0.99), len(v) - 1)::INT + 1] AS p99_ms FROM s""")
    def latency_pctl(spark, sf_dir):
        return series.latency(table(spark, sf_dir, "events"), "value", "event_type").withColumn("avg_ms", F.round("avg_ms", 9)).withColumn("p50_ms", F.round("p50_ms", 9))
