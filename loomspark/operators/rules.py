"""Configuration rules, mix rules, error classes and record formats, as tables of predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Section, severity, code, predicate of a violation, message. A configuration is one row; settings that are not given are null. Fixed thresholds.
CONFIG_RULES = (
    ("dataset", "error", "mix_total", "abs(mix_total - 1) > 1e-6", "the shares of the mix must add up to 1"),
    ("dataset", "error", "mix_none", "mix_count = 0", "at least one dataset is needed"),
    ("dataset", "error", "mix_unnamed", "mix_unnamed > 0", "a dataset needs a name"),
    ("dataset", "warning", "mix_repeated", "mix_repeated > 0", "a dataset occurs more than once"),
    ("dataset", "error", "mix_range", "mix_out_of_range > 0", "a share must lie between 0 and 1"),
    ("dataset", "warning", "size_small", "size_gb <= 0", "the dataset size may be too small"),
    ("dataset", "warning", "size_large", "size_gb > 1000", "the dataset may need much disk space"),
    ("dataset", "error", "shards_zero", "num_shards = 0", "the number of shards must not be 0"),
    ("dataset", "error", "local_unset", "source = 'local' AND local_path IS NULL", "a local source needs a path"),
    ("dataset", "error", "local_missing", "source = 'local' AND local_path IS NOT NULL AND NOT local_exists", "the local path does not exist"),
    ("dataset", "warning", "url_scheme", "source = 'url' AND NOT (startswith(url, 'http://') OR startswith(url, 'https://'))", "the address may not be valid"),
    ("dataset", "error", "cache_file", "cache_is_file", "the cache folder is a file"),
    ("model", "error", "layers_zero", "num_layers = 0", "the number of layers must not be 0"),
    ("model", "warning", "layers_many", "num_layers > 100", "so many layers may need much memory"),
    ("model", "error", "hidden_zero", "hidden_dim = 0", "the hidden size must not be 0"),
    ("model", "warning", "hidden_large", "hidden_dim > 16384", "the hidden size may be too large"),
    ("model", "error", "heads_zero", "num_heads = 0", "the number of heads must not be 0"),
    ("model", "error", "hidden_heads", "hidden_dim > 0 AND num_heads > 0 AND hidden_dim % nullif(num_heads, 0) <> 0", "the hidden size must be a multiple of the number of heads"),
    ("model", "suggestion", "hidden_heads", "hidden_dim > 0 AND num_heads > 0 AND hidden_dim % nullif(num_heads, 0) <> 0", "round the hidden size up to a multiple of the number of heads"),
    ("model", "error", "groups_zero", "attention IN ('gqa', 'gqa_window') AND num_groups = 0", "the number of groups must not be 0"),
    ("model", "error", "groups_heads", "attention IN ('gqa', 'gqa_window') AND num_heads > 0 AND coalesce(num_heads % nullif(num_groups, 0), 1) <> 0", "the number of heads must be a multiple of the number of groups"),
    ("model", "warning", "groups_kv", "attention IN ('gqa', 'gqa_window') AND kv_heads <> num_groups", "key-value heads and groups differ"),
    ("model", "error", "dropout_range", "dropout < 0 OR dropout >= 1", "the dropout must lie in [0, 1)"),
    ("model", "warning", "dropout_high", "dropout > 0.5 AND dropout < 1", "so much dropout may slow convergence"),
    ("model", "error", "depth_range", "stochastic_depth < 0 OR stochastic_depth >= 1", "the stochastic depth must lie in [0, 1)"),
    ("model", "error", "window_zero", "attention IN ('window', 'gqa_window') AND window_size = 0", "the window must not be 0"),
    ("model", "error", "window_large", "attention IN ('window', 'gqa_window') AND window_size > max_positions", "the window must not exceed the positions"),
    ("model", "error", "theta_sign", "position = 'rope' AND rope_theta <= 0", "theta must be positive"),
    ("model", "warning", "theta_odd", "position = 'rope' AND rope_theta > 0 AND (rope_theta < 1000 OR rope_theta > 100000)", "theta is usually 10000"),
    ("model", "suggestion", "alibi_window", "position = 'alibi'", "linear biases go well with window attention"),
    ("model", "error", "norm_eps", "normalization = 'rms' AND (rms_eps <= 0 OR rms_eps >= 1)", "the epsilon of the norm must lie in (0, 1)"),
    ("model", "error", "positions_zero", "max_positions = 0", "the number of positions must not be 0"),
    ("model", "warning", "positions_many", "max_positions > 128000", "so many positions may need much memory"),
    ("training", "error", "rate_sign", "learning_rate <= 0", "the learning rate must be positive"),
    ("training", "warning", "rate_high", "learning_rate > 1", "the learning rate may be too high"),
    ("training", "warning", "rate_low", "learning_rate > 0 AND learning_rate < 1e-7", "the learning rate may be too low"),
    ("training", "error", "least_rate_sign", "min_learning_rate < 0", "the least learning rate must not be negative"),
    ("training", "error", "least_rate_high", "min_learning_rate >= 0 AND min_learning_rate > learning_rate", "the least learning rate must not exceed the learning rate"),
    ("training", "error", "schedule_least", "scheduler IN ('cosine', 'restarts') AND schedule_min < 0", "the least rate of the schedule must not be negative"),
    ("training", "error", "restart_zero", "scheduler = 'restarts' AND restart_interval = 0", "the restart interval must not be 0"),
    ("training", "error", "cycle_top", "scheduler = 'one_cycle' AND max_rate < learning_rate", "the top of the cycle must not be under the learning rate"),
    ("training", "error", "cycle_start", "scheduler = 'one_cycle' AND (pct_start <= 0 OR pct_start >= 1)", "the rising share of the cycle must lie in (0, 1)"),
    ("training", "error", "beta1_range", "optimizer <> 'sgd' AND (beta1 < 0 OR beta1 >= 1)", "beta1 must lie in [0, 1)"),
    ("training", "error", "beta2_range", "optimizer <> 'sgd' AND (beta2 < 0 OR beta2 >= 1)", "beta2 must lie in [0, 1)"),
    ("training", "warning", "epsilon_odd", "optimizer <> 'sgd' AND (epsilon <= 0 OR epsilon >= 1)", "this epsilon is unusual"),
    ("training", "error", "momentum_range", "optimizer = 'sgd' AND (momentum < 0 OR momentum >= 1)", "the momentum must lie in [0, 1)"),
    ("training", "error", "decay_sign", "weight_decay < 0", "the weight decay must not be negative"),
    ("training", "warning", "decay_high", "weight_decay > 0.1", "so much weight decay may underfit"),
    ("training", "error", "clip_sign", "grad_clip < 0", "the gradient limit must not be negative"),
    ("training", "warning", "clip_off", "grad_clip = 0", "a gradient limit of 0 turns clipping off"),
    ("training", "error", "batch_zero", "batch_size = 0", "the batch size must not be 0"),
    ("training", "warning", "batch_small", "batch_size > 0 AND batch_size < 4", "so small a batch may be unstable"),
    ("training", "error", "micro_zero", "micro_batch_size = 0", "the micro batch must not be 0"),
    ("training", "warning", "micro_large", "micro_batch_size > 0 AND micro_batch_size > batch_size", "the micro batch exceeds the batch, whose size is used"),
    ("training", "error", "steps_zero", "num_steps = 0", "the number of steps must be positive"),
    ("training", "error", "warmup_long", "warmup_steps > num_steps", "the warm-up must not exceed the training"),
    ("training", "warning", "warmup_half", "warmup_steps <= num_steps AND warmup_steps > floor(num_steps / 2)", "the warm-up takes over half of the training"),
    ("training", "error", "length_zero", "sequence_length = 0", "the sequence length must not be 0"),
    ("training", "error", "length_positions", "sequence_length > max_positions AND sequence_length > 0", "the sequence length must not exceed the positions"),
    ("training", "warning", "eval_often", "eval_interval > 0 AND eval_interval < log_interval", "evaluation is more frequent than logging"),
    ("training", "warning", "save_often", "save_interval > 0 AND save_interval < eval_interval", "saving is more frequent than evaluation"),
    ("training", "error", "accumulation_zero", "accumulation_steps = 0", "the accumulation steps must not be 0"),
    ("training", "warning", "accumulation_many", "accumulation_steps > 32", "so many accumulation steps may be slow"),
    ("training", "warning", "average_decay", "ema_decay < 0.9 OR ema_decay >= 1", "the decay of the average is usually 0.99 to 0.999"),
    ("training", "suggestion", "bf16_hardware", "mixed_precision = 'bf16'", "this precision needs hardware that has it"),
    ("training", "warning", "fp8_hardware", "mixed_precision = 'fp8'", "this precision needs very recent hardware"),
    ("training", "warning", "checkpoints_none", "max_checkpoints = 0", "no checkpoint would be kept"),
    ("hardware", "warning", "gpu_number", "array_max(gpu_ids) >= 8", "a device number may not exist"),
    ("hardware", "warning", "gpu_repeated", "size(gpu_ids) > 0 AND size(array_distinct(gpu_ids)) <> size(gpu_ids)", "a device number occurs more than once"),
    ("hardware", "warning", "workers_many", "num_workers > 2 * cpu_count", "more than two workers a core may be slow"),
    ("hardware", "warning", "workers_none", "num_workers = 0 AND cpu_count >= 0", "data is loaded on the main thread"),
    ("hardware", "suggestion", "driver_needed", "device = 'cuda'", "install the driver and tools of the device"),
    ("hardware", "warning", "device_system", "device = 'mps'", "this device exists on one system only"),
    ("hardware", "suggestion", "device_support", "device = 'rocm'", "this device needs special hardware and drivers"),
    ("hardware", "suggestion", "tf32_hardware", "use_tf32", "this format needs recent hardware"),
    ("logging", "warning", "level_unknown", "lower(log_level) NOT IN ('debug', 'info', 'warn', 'error')", "the log level may not be valid"),
    ("logging", "error", "events_file", "events_is_file", "the folder of event records is a file"),
    ("logging", "error", "csv_folder", "csv_is_folder", "the file of the step log is a folder"),
)
CONFIG_COLUMNS = {
    "mix_total": "double", "mix_count": "int", "mix_unnamed": "int", "mix_repeated": "int", "mix_out_of_range": "int", "size_gb": "double", "num_shards": "int", "source": "string", "local_path": "string",
    "local_exists": "boolean", "url": "string", "cache_is_file": "boolean", "num_layers": "int", "hidden_dim": "int", "num_heads": "int", "attention": "string", "num_groups": "int", "window_size": "int", "kv_heads": "int",
    "dropout": "double", "stochastic_depth": "double", "position": "string", "rope_theta": "double", "normalization": "string", "rms_eps": "double", "max_positions": "int", "learning_rate": "double",
    "min_learning_rate": "double", "scheduler": "string", "schedule_min": "double", "restart_interval": "int", "max_rate": "double", "pct_start": "double", "optimizer": "string", "beta1": "double", "beta2": "double",
    "epsilon": "double", "momentum": "double", "weight_decay": "double", "grad_clip": "double", "batch_size": "int", "micro_batch_size": "int", "num_steps": "int", "warmup_steps": "int", "sequence_length": "int",
    "eval_interval": "int", "log_interval": "int", "save_interval": "int", "accumulation_steps": "int", "ema_decay": "double", "mixed_precision": "string", "max_checkpoints": "int", "gpu_ids": "array<int>",
    "num_workers": "int", "cpu_count": "int", "device": "string", "use_tf32": "boolean", "log_level": "string", "events_is_file": "boolean", "csv_is_folder": "boolean",
}
MIX_TOLERANCE = 1e-6


def config_violations(configs: DataFrame, key: str = "config_id") -> DataFrame:
    """(key, section, severity, code, message): a row for each rule that a configuration breaks. Settings without a column count as not given."""
    full = configs.select(key, *[F.col(c).cast(k).alias(c) if c in configs.columns else F.lit(None).cast(k).alias(c) for c, k in CONFIG_COLUMNS.items()])
    hit = lambda s, v, c, p, m: F.when(F.expr(p), F.struct(F.lit(s).alias("section"), F.lit(v).alias("severity"), F.lit(c).alias("code"), F.lit(m).alias("message")))
    return full.select(key, F.explode(F.array_compact(F.array(*[hit(*r) for r in CONFIG_RULES]))).alias("v")).select(key, "v.*")


def config_is_valid(configs: DataFrame, key: str = "config_id") -> DataFrame:
    """(key, errors, warnings, is_valid): a configuration is valid without errors."""
    found = config_violations(configs, key).groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = configs.select(key).join(found, key, "left").select(key, zero("errors").alias("errors"), zero("warnings").alias("warnings"))
    return out.withColumn("is_valid", F.col("errors") == 0)


def mix_violations(mix: DataFrame) -> DataFrame:
    """Rows (severity, name, message) for a mix of (name, percentage)."""
    total = mix.agg(F.coalesce(F.sum("percentage"), F.lit(0.0)).alias("t"), F.count("*").alias("n"))
    a = total.where(F.abs(F.col("t") - 1) > MIX_TOLERANCE).select(F.lit("error").alias("severity"), F.lit("").alias("name"), F.lit("shares must add up to 1").alias("message"))
    b = total.where("n = 0").select(F.lit("error").alias("severity"), F.lit("").alias("name"), F.lit("at least one dataset is needed").alias("message"))
    c = mix.where("percentage < 0 OR percentage > 1").select(F.lit("error").alias("severity"), "name", F.lit("a share must lie between 0 and 1").alias("message"))
    d = mix.where("name = ''").select(F.lit("error").alias("severity"), "name", F.lit("a name must not be empty").alias("message"))
    e = mix.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("warning").alias("severity"), "name", F.lit("a name occurs more than once").alias("message"))
    return a.unionByName(b).unionByName(c).unionByName(d).unionByName(e)


def recommended_preset(ram_gb: Column) -> Column:
    return F.when(ram_gb >= 16, "base").when(ram_gb >= 8, "small").otherwise("tiny")


# Error kinds with severity, whether they can be recovered from, and whether to retry: fixed values.
ERROR_KINDS = (
    ("IO", "error", False, False), ("Config", "error", False, False), ("Data", "error", False, False), ("Model", "error", False, False),
    ("Training", "error", False, False), ("Tokenizer", "error", False, False), ("Database", "error", False, False), ("Serialization", "error", False, False),
    ("Network", "warning", True, True), ("Download", "warning", True, True), ("Preprocessing", "warning", True, False), ("Validation", "error", False, False),
    ("Device", "error", False, False), ("Parse", "error", False, False), ("Checkpoint", "warning", True, False), ("Distributed", "error", False, False),
    ("OutOfMemory", "critical", False, False), ("GradientOverflow", "warning", True, False), ("GPU", "critical", False, False), ("Timeout", "warning", True, True),
    ("Unknown", "error", False, False),
)


# Kind, parts of the message, the advice if the message has one of them, the advice otherwise. The parts are fixed values.
ADVICE = (
    ("Config", ("文件不存在",), "generate a default configuration file", None), ("Config", ("解析",), "check that the file is valid TOML", "check the settings"),
    ("Network", (), None, "check the connection or use a mirror"), ("Download", ("404", "无法下载"), "check the name of the dataset or download it by hand", "check the connection and the address"),
    ("OutOfMemory", (), None, "use smaller batches or accumulate gradients"), ("GradientOverflow", (), None, "lower the learning rate, raise the gradient limit or use mixed precision"),
    ("Device", (), None, "check the device or use the CPU"), ("Validation", ("不能被",), "make the dimensions of the model match", "check the limits of the settings"),
    ("Tokenizer", ("内存",), "train from files instead of texts in memory", "check the tokenizer's settings"), ("Database", ("locked",), "wait for other processes or raise the timeout", "check permissions and disk space"),
)


def suggestion(kind: Column, message: Column) -> Column:
    """Advice for an error by its kind and by parts of its message; null where there is none."""
    found = [F.when((kind == k) & message.contains(p), F.lit(yes)) for k, parts, yes, _ in ADVICE for p in parts]
    return F.coalesce(*found, *[F.when(kind == k, F.lit(no)) for k, _, _, no in ADVICE if no])


def classify_errors(errors: DataFrame, kind: str = "error_type") -> DataFrame:
    """Adds severity, recoverable, retry, and with a message the suggestion; unknown kinds count as Unknown."""
    table = errors.sparkSession.createDataFrame(list(ERROR_KINDS), f"{kind} string, severity string, recoverable boolean, retry boolean")
    known = errors.withColumn(kind, F.when(F.col(kind).isin([k for k, *_ in ERROR_KINDS]), F.col(kind)).otherwise("Unknown"))
    out = known.join(F.broadcast(table), kind)  # 21 rows
    return out.withColumn("suggestion", suggestion(F.col(kind), F.col("message"))) if "message" in errors.columns else out


def error_lines(errors: DataFrame) -> DataFrame:
    """Adds compact (first letter of the severity, context, message), json and human forms."""
    compact = F.concat_ws("|", F.upper(F.substring("severity", 1, 1)), F.coalesce("context", F.lit("")), "message")
    advice = [F.col("suggestion")] if "suggestion" in errors.columns else []
    human = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.coalesce(F.concat("context", F.lit(": ")), F.lit("")), "error_type", F.lit(" error: "), "message", *[F.coalesce(F.concat(F.lit(" (hint: "), a, F.lit(")")), F.lit("")) for a in advice])
    return errors.withColumn("compact", compact).withColumn("json", F.to_json(F.struct("error_type", "severity", "context", "message", "recoverable", "retry", *advice))).withColumn("human", human)


def fixed(value: Column, digits: int) -> Column:
    """Fixed decimals, empty where there is no value."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.format_string(f"%.{digits}f", value.cast("double")))


def step_log(steps: DataFrame) -> DataFrame:
    """The nine text columns of a step log."""
    c = F.col
    return steps.select(
        c("step").cast("string").alias("step"), fixed(c("loss"), 6).alias("loss"), fixed(c("eval_loss"), 6).alias("eval_loss"), fixed(c("learning_rate"), 8).alias("learning_rate"),
        fixed(c("tokens_per_second"), 2).alias("tokens_per_second"), c("epoch").cast("string").alias("epoch"), fixed(c("gradient_norm"), 6).alias("gradient_norm"),
        fixed(c("gpu_memory_mb"), 1).alias("gpu_memory_mb"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
    )
