"""Schema-driven text extraction: any row to one text, planned from the schema, without Python per row."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.text import is_not_blank

# Column and key names that carry text, in order of preference: fixed values.
TEXT_NAMES = (
    "text", "content", "data", "sentence", "document", "input", "output", "message", "description", "title",
    "body", "paragraph", "passage", "article", "dialogue", "utterance", "response", "prompt", "completion",
)
CSV_NAMES = TEXT_NAMES[:11]
MAX_DEPTH = 5
SEPARATOR = " "
MAX_MERGED_KEYS = 5

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_text_column(name: str, patterns: Sequence[str] = TEXT_NAMES) -> bool:
    """True if the lower-case name contains one of the patterns."""
    low = name.lower()
    return any(p in low for p in patterns)


def is_extractable(kind: T.DataType) -> bool:
    """Whether values of a type can become text."""
    if isinstance(kind, T.DecimalType):
        return (kind.precision, kind.scale) == (20, 0)  # how unsigned 64-bit integers arrive
    return isinstance(kind, (T.StringType, T.BinaryType, T.BooleanType, *_INTEGERS, T.FloatType, T.DoubleType, T.ArrayType, T.StructType, T.MapType))


def plain_number(value: Column) -> Column:
    """A double as shortest decimal digits: no exponent, no trailing ``.0``."""
    text = value.cast("string")
    mantissa, exponent = F.split_part(text, F.lit("E"), F.lit(1)), F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    sign = F.when(mantissa.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    bare = F.ltrim(mantissa, F.lit("-"))
    whole, fraction = F.split_part(bare, F.lit("."), F.lit(1)), F.split_part(bare, F.lit("."), F.lit(2))
    fraction = F.when(fraction == "0", F.lit("")).otherwise(fraction)
    digits = F.concat(whole, fraction)
    point = F.length(whole) + F.coalesce(exponent, F.lit(0))
    left = F.when(point <= 0, F.lit("0")).when(point >= F.length(digits), F.rpad(digits, point, "0")).otherwise(F.substring(digits, F.lit(1), point))
    right = F.when(point <= 0, F.concat(F.repeat(F.lit("0"), -point), digits)).when(point >= F.length(digits), F.lit("")).otherwise(F.substring(digits, point + 1, F.length(digits)))
    moved = F.concat(sign, left, F.when(right == "", F.lit("")).otherwise(F.concat(F.lit("."), right)))
    special = F.when(F.isnan(value), F.lit("NaN")).when(value == float("inf"), F.lit("inf")).when(value == float("-inf"), F.lit("-inf"))
    return F.when(value.isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(special, moved))


def as_text(value: Column, kind: T.DataType, depth: int = 0) -> Column:
    """Text of a value by its type; null where there is none. Nested values are joined by a space."""
    none = F.lit(None).cast("string")
    if depth > MAX_DEPTH:
        return none
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.BinaryType):
        return F.try_validate_utf8(value.cast("string"))
    if isinstance(kind, T.FloatType):
        return plain_number(value)
    if isinstance(kind, T.DoubleType):
        return plain_number(value)
    if isinstance(kind, (T.BooleanType, *_INTEGERS)) or isinstance(kind, T.DecimalType) and is_extractable(kind):
        return value.cast("string")
    if isinstance(kind, T.ArrayType):
        parts = F.filter(F.transform(value, lambda x: as_text(x, kind.elementType, depth + 1)), lambda x: x.isNotNull())
        return F.when(F.size(parts) > 0, F.array_join(parts, SEPARATOR))
    if isinstance(kind, T.StructType):
        fields = [as_text(value[f.name], f.dataType, depth + 1) for f in kind.fields]
        joined = F.concat_ws(SEPARATOR, *fields) if fields else F.lit("")
        return F.when(joined != "", joined)
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return as_text(F.map_entries(value), T.ArrayType(entry), depth)
    return none


def candidate_columns(schema: T.StructType, compat: bool = False, patterns: Sequence[str] = TEXT_NAMES) -> list[str]:
    """Columns tried for text, in schema order: those named like text, or with compat any of a type that can become text."""
    return [f.name for f in schema.fields if is_text_column(f.name, patterns) or compat and is_extractable(f.dataType)]


def extract_text(rows: DataFrame, compat: bool = False, name: str = "text", patterns: Sequence[str] = TEXT_NAMES, custom: Column | None = None, keep: dict[str, str] | None = None) -> DataFrame:
    """The first non-blank text among candidate columns, else among all; rows without any are dropped.

    ``custom`` is tried before the columns; ``keep`` names columns that are no candidates and are returned under new names.
    """
    schema, keep = T.StructType([f for f in rows.schema.fields if f.name not in (keep or {})]), keep or {}
    first = candidate_columns(schema, compat, patterns)
    order = [*first, *(c for c in schema.names if c not in first)]
    kinds = {f.name: f.dataType for f in schema.fields}
    texts = ([] if custom is None else [custom]) + [as_text(F.col(f"`{c}`"), kinds[c]) for c in order]
    picked = F.coalesce(*[F.when(is_not_blank(t), t) for t in texts]) if texts else F.lit(None).cast("string")
    return rows.select(picked.alias(name), *[F.col(f"`{a}`").alias(b) for a, b in keep.items()]).where(F.col(name).isNotNull())


def first_text(rows: DataFrame) -> Column:
    """First non-null text among the columns named like text."""
    texts = [as_text(F.col(f"`{f.name}`"), f.dataType) for f in rows.schema.fields if is_text_column(f.name)]
    return F.coalesce(*texts) if texts else F.lit(None).cast("string")


def json_value_text(value) -> str:
    """Text of a parsed JSON value: known keys first, else a few values merged in key order."""
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None:
        return ""
    if isinstance(value, (int, float)):
        return json.dumps(value)
    parts = []
    if isinstance(value, dict):
        for key in TEXT_NAMES:
            if key in value and (found := json_value_text(value[key])).strip():
                return found
        if len(value) > MAX_MERGED_KEYS:
            return ""
        parts = [json_value_text(value[k]) for k in sorted(value)]
    elif isinstance(value, list):
        parts = [json_value_text(v) for v in value]
    return SEPARATOR.join(p for p in parts if p.strip())


def json_line_text(line: str) -> str:
    """Text of a JSON line; a line that is no JSON stays if it is printable ASCII."""
    line = line.strip()
    try:
        return json_value_text(json.loads(line))
    except ValueError:
        return line if all(" " <= c <= "~" or c in "\t\n\r\x0b\x0c" for c in line) else ""


def json_texts(lines: DataFrame, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Column text of JSON lines, nested values included, and the columns to keep; lines without text are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([json_line_text(x or "") for x in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts, *batch.columns[1:]], names=["text", *batch.schema.names[1:]])

    kinds = dict(lines.dtypes)
    schema = ", ".join(["text string", *(f"`{k}` {kinds[k]}" for k in keep)])
    return lines.where(is_not_blank(value)).select(value, *keep).mapInArrow(run, schema).where(is_not_blank("text"))


def flat_json_text(value: str | Column) -> Column:
    """The same for objects with up to five scalar values, without Python: a known key, else the values in key order."""
    column = F.col(value) if isinstance(value, str) else value
    entries = F.from_json(column, "map<string,string>")
    known = [F.when(is_not_blank(F.try_element_at(entries, F.lit(k))), F.try_element_at(entries, F.lit(k))) for k in TEXT_NAMES]
    keys = F.sort_array(F.map_keys(entries))
    merged = F.array_join(F.filter(F.transform(keys, lambda k: F.try_element_at(entries, k)), lambda v: is_not_blank(v)), SEPARATOR)
    return F.coalesce(*known, F.when(F.size(keys) <= MAX_MERGED_KEYS, merged).otherwise(F.lit("")))
