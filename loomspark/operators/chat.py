"""Chat histories: prompts, batching of prompts, role filters and slash commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECENT = 21
SEPARATOR = "\n\n---SEPARATOR---\n\n"
MARK = "---SEPARATOR---"
COMMANDS = ("/load", "/ls", "/clear", "/save", "/loadhist", "/info", "/stop", "/params", "/help", "/quit")


def _block(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n"))


def history(messages: DataFrame, key: str, turn: str) -> DataFrame:
    """(key, messages): a conversation in order as structs of role and text. A conversation fits a row."""
    return messages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), "role", "text"))).alias("messages"))


def prompt(messages: Column, user_input: Column) -> Column:
    """All system messages, then the last RECENT others (empty assistant ones left out), then the user's input and an open assistant turn."""
    system = F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: _block(m["role"], m["text"]))
    recent = F.slice(messages, F.greatest(F.size(messages) - RECENT + 1, F.lit(1)), RECENT)
    said = F.filter(recent, lambda m: (m["role"] != "system") & ~((m["role"] == "assistant") & (m["text"] == "")))
    parts = F.concat(system, F.transform(said, lambda m: _block(m["role"], m["text"])), F.array(_block(F.lit("user"), user_input)))
    return F.concat(F.array_join(parts, ""), F.lit("<|assistant|>\n"))


def combine(prompts: Column) -> Column:
    return F.array_join(prompts, SEPARATOR)


def split_responses(combined: Column, n: Column) -> Column:
    """The first n parts, trimmed, empty where there are fewer."""
    parts = F.split(combined, MARK)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.regexp_replace(F.get(parts, i), "^\\s+|\\s+$", ""), F.lit("")))).otherwise(F.array().cast("array<string>"))


def cleared(messages: DataFrame) -> DataFrame:
    """What /clear leaves."""
    return messages.where("role = 'system'")


def parse_command(text: Column, parameters: tuple[int, float, float, float] = (512, 0.7, 0.9, 1.1)) -> Column:
    """Struct of a command line: the known command (null for plain text), its argument or the default of one, whether it only asks for its usage, and the four generation
    parameters after it: those given to ``/params``, where one that is no number keeps its present value; the present ones for all other lines.
    """
    parts = F.split(F.btrim(text), "\\s+")
    word = lambda i: F.get(parts, F.lit(i))
    name = F.when(word(0) == "/exit", "/quit").otherwise(word(0))
    command = F.when(name.isin(*COMMANDS), name)
    argument = F.when(command.isin("/load", "/loadhist"), word(1)).when(command == "/ls", F.coalesce(word(1), F.lit("."))).when(command == "/save", F.coalesce(word(1), F.lit("chat_history.json")))
    usage = (command.isin("/load", "/loadhist") & word(1).isNull()) | ((command == "/params") & word(4).isNull())
    sets = (command == "/params") & word(4).isNotNull()
    kinds = ("long", "double", "double", "double")
    values = [F.when(sets & (F.lit(k != "long") | ~F.coalesce(word(i + 1).startswith("-"), F.lit(False))), word(i + 1).try_cast(k)) for i, k in enumerate(kinds)]
    names = ("max_tokens", "temperature", "top_p", "repeat_penalty")
    return F.struct(command.alias("command"), argument.alias("argument"), F.coalesce(usage, F.lit(False)).alias("usage"), *[F.coalesce(v, F.lit(d).cast(k)).alias(n) for v, d, k, n in zip(values, parameters, kinds, names, strict=True)])


def token_counts(tokens: DataFrame, key: str, token: str = "token") -> DataFrame:
    """(key, counts): how often each token stands in a context, as a map, which the repeat penalty reads."""
    counted = tokens.groupBy(key, token).agg(F.count("*").cast("int").alias("n"))
    return counted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(token, "n"))).alias("counts"))


def context_use(messages: DataFrame, key: str, context: int, text: str = "text") -> DataFrame:
    """Estimated tokens (half the characters) and their share of the context."""
    used = messages.groupBy(key).agg(F.sum(F.floor(F.length(text) / 2)).cast("long").alias("tokens"))
    return used.withColumn("share", F.col("tokens") / context)
