"""Readers: files of any supported format to texts or token sequences, and file inspection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import is_not_blank
from loomspark.sources.extract import CSV_NAMES, extract_text, json_texts

FORMATS = {".parquet": "parquet", ".jsonl": "json", ".json": "json", ".csv": "csv"}
MAGIC = b"PAR1"


def format_of(path: str) -> str:
    """Format by suffix; anything unknown is text."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return FORMATS.get("." + name.rsplit(".", 1)[-1].lower() if "." in name else "", "text")


def files(spark: SparkSession, path: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """Path, length and modification time of files, without their contents."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", "modificationTime")


def head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file, or of the first file of a folder, through the file system that Spark reads it by."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():
        inside = sorted((x.getPath() for x in fs.listStatus(at) if x.isFile() and not x.getPath().getName().startswith(("_", "."))), key=lambda p: p.toString())
        if not inside:
            return b""
        at = inside[0]
    stream = fs.open(at)
    try:
        out = [stream.read() for _ in range(size)]
    finally:
        stream.close()
    return bytes(x for x in out if x >= 0)


def starts_with_magic(spark: SparkSession, path: str) -> bool:
    return head(spark, path, len(MAGIC)) == MAGIC


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines, untrimmed; a Parquet file under another name is read as Parquet."""
    if starts_with_magic(spark, path):
        return extract_text(spark.read.parquet(path))
    return spark.read.text(path).where(is_not_blank("value")).select(F.col("value").alias("text"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank texts of the first column whose header contains a known name, else of the first column; ragged rows fail the file."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST")
    named = [c for c in rows.columns if any(n in c.lower() for n in CSV_NAMES)]
    column = F.col(f"`{(named or rows.columns)[0]}`")
    return rows.select(column.alias("text")).where(is_not_blank("text"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row with a text per record, whatever the format."""
    kind = format_of(path)
    if kind == "parquet":
        return extract_text(spark.read.parquet(path))
    if kind == "json":
        return json_texts(spark.read.text(path))
    return read_csv(spark, path) if kind == "csv" else read_text(spark, path)


def _stem() -> Column:
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return F.regexp_replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), "[.][^.]*$", "")


def _written_tables(spark: SparkSession, path: str) -> list[str]:
    """Folders right in a folder that hold part files, in order; none if the path is a file or has wildcards."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        return []
    inside = [x.getPath() for x in fs.listStatus(at) if x.isDirectory() and not x.getPath().getName().startswith(("_", "."))]
    return sorted(p.toString() for p in inside if any(f.getPath().getName().startswith("part-") for f in fs.listStatus(p)))


def read_directory(spark: SparkSession, path: str) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Texts of all files right in a folder with their stem, and the files that failed with the reason. A folder in it that Spark wrote (it holds part files) counts as one file of its name.

    Line formats are read together, a scan for all their files; Parquet files together by schema. CSV files have a
    header each and are read one by one. Of a file that fails only its own texts are missing.
    """
    groups: dict[str, list[str]] = {"json": [], "text": []}
    parts, failed, by_schema = [], [], {}
    stem_of = lambda p: p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    for table in _written_tables(spark, path):
        try:
            texts = read_texts(spark, table)
            if format_of(table) == "csv":
                texts.agg(F.count("*")).first()
            parts.append(texts.withColumn("stem", F.lit(stem_of(table))))
        except Exception as e:  # as below
            failed.append((table, str(e).splitlines()[0]))
    for row in files(spark, path).select("path").orderBy("path").toLocalIterator():
        kind = format_of(row.path)
        try:
            if kind == "parquet" or kind == "text" and starts_with_magic(spark, row.path):
                by_schema.setdefault(spark.read.parquet(row.path).schema.json(), []).append(row.path)
            elif kind == "csv":
                texts = read_csv(spark, row.path)
                texts.agg(F.count("*")).first()  # a ragged row fails the file here, not the whole folder later
                parts.append(texts.withColumn("stem", F.lit(stem_of(row.path))))
            else:
                groups[kind].append(row.path)
        except Exception as e:  # a bad file is reported and skipped
            failed.append((row.path, str(e).splitlines()[0]))
    if groups["text"]:
        lines = spark.read.text(groups["text"]).where(is_not_blank("value"))
        parts.append(lines.select(F.col("value").alias("text"), _stem().alias("stem")))
    if groups["json"]:
        rows = spark.read.text(groups["json"]).select("value", _stem().alias("stem"))
        parts.append(json_texts(rows, keep=["stem"]))
    for paths in by_schema.values():
        rows = spark.read.parquet(*paths)
        parts.append(extract_text(rows.select("*", _stem().alias("_stem")), keep={"_stem": "stem"}))
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out, failed


def corpus_lines(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Lines of a text file, or of all files right in a folder but Parquet ones, for vocabulary training; and the names of the Parquet files left out.

    A file that is no UTF-8 gives no lines at all. Lines end at a line feed, with or without a carriage return before it.
    """
    found = [r.path for r in files(spark, path).select("path").orderBy("path").toLocalIterator()]
    skipped = [p for p in found if format_of(p) == "parquet"]
    texts = [p for p in found if format_of(p) != "parquet"]
    if not texts:
        return spark.createDataFrame([], "text string"), skipped
    lines = spark.read.option("lineSep", "\n").text(texts).select("value", F.col("_metadata.file_path").alias("file"))
    broken = lines.where(~F.is_valid_utf8("value")).select("file").distinct()
    return lines.join(broken, "file", "left_anti").select(F.regexp_replace("value", "\r$", "").alias("text")), skipped


def token_lines(lines: DataFrame, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Lines of ids parted by white space to arrays, beside the columns to keep; what is no id is dropped."""
    parts = F.split(F.trim(F.col(value)), "\\s+")
    ids = F.filter(parts.try_cast("array<int>"), lambda x: x >= 0)
    return lines.select(*keep, ids.alias("tokens"))


def read_tokens(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return token_lines(spark.read.text(paths))


def sample_lines(spark: SparkSession, path: str | list[str], at_most: int) -> DataFrame:
    """The first non-blank lines, trimmed, among the first 2 * at_most lines of a file."""
    head = spark.read.text(path).limit(2 * at_most)
    return head.select(F.trim("value").alias("text")).where(is_not_blank("text")).limit(at_most)


def inspect_file(spark: SparkSession, path: str) -> DataFrame:
    """Megabytes, lines and the first five lines (100 characters each) of a text file."""
    facts = files(spark, path).select((F.col("length") / (1024 * 1024)).alias("size_mb"))
    text = spark.read.text(path)
    head = text.limit(5).agg(F.collect_list(F.substring("value", 1, 100)).alias("preview"))
    return facts.crossJoin(text.agg(F.count("*").alias("n_lines"))).crossJoin(head)


def directory_size(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path, recursive=True).agg(F.coalesce(F.sum("length"), F.lit(0).cast("long")).alias("bytes"), F.count("*").alias("n_files"))


def find_models(spark: SparkSession, path: str, suffix: str = "gguf") -> DataFrame:
    """Model files below a folder."""
    return files(spark, path, recursive=True, pattern=f"*.{suffix}").orderBy("path")


def dataset_is_valid(spark: SparkSession, path: str) -> bool:
    """A text file that is not empty, is UTF-8 and starts with a non-blank line."""
    lines = spark.read.text(path)
    first = lines.first()
    if first is None or not first.value.strip():
        return False
    # Lines keep their bytes, so that they can be checked where they are read.
    return bool(lines.agg(F.bool_and(F.is_valid_utf8("value")).alias("ok")).first().ok)


def packed_file_is_valid(lines: DataFrame, length: int, value: str = "value") -> bool:
    """The first eleven lines hold length + 1 ids each."""
    head = lines.limit(11).select(F.split(F.trim(value), "\\s+").alias("p"))
    ok = head.agg(F.bool_and((F.size("p") == length + 1) & F.forall("p", lambda x: x.try_cast("int").isNotNull())).alias("ok")).first().ok
    return bool(ok)


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True, schema="role string, content string, timestamp string")


# ---- candidate names of hub files, as data ----------------------------------------------------

SHARD_PATTERNS = (
    ("train-{i:05d}-of-{n:05d}.parquet", 32), ("data/train-{i:05d}-of-{n:05d}.parquet", 32), ("train-{i:05d}.parquet", 16), ("data/train-{i:05d}.parquet", 16),
    ("part-{i:05d}.parquet", 16), ("shard-{i:05d}.parquet", 10), ("{i:04d}.parquet", 10),
)
SPLIT_PATTERNS = ("{s}.parquet", "data/{s}.parquet", "{s}-00000-of-00001.parquet", "data/{s}-00000-of-00001.parquet")


def split_candidates(splits: DataFrame, name: str = "split") -> DataFrame:
    """Names that a split's file may have."""
    s = F.col(name)
    names = [F.concat(*[x if i % 2 else F.lit(x) for i, x in enumerate(_around(p, s))]) for p in SPLIT_PATTERNS]
    return splits.select(s, F.posexplode(F.array(*names)).alias("rank", "filename"))


def _around(pattern: str, column):
    before, after = pattern.split("{s}")
    return before, column, after


def shard_candidates(datasets: DataFrame, name: str = "name") -> DataFrame:
    """(name, pattern, shard, filename) of every name that is probed for shards of each dataset."""
    rows = F.array(*[F.struct(F.lit(k).alias("pattern"), F.lit(i).alias("shard"), F.lit(p.format(i=i, n=n)).alias("filename")) for k, (p, n) in enumerate(SHARD_PATTERNS) for i in range(n)])
    return datasets.select(name, F.explode(rows).alias("r")).select(name, "r.*")


def data_file_names(values: DataFrame, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """File names in a JSON value that is a string, an array of strings, or an object of either, beside the columns to keep."""
    v = F.col(value)
    listed = F.from_json(v, "array<string>")
    table = F.map_values(F.from_json(v, "map<string,string>"))
    inner = F.flatten(F.transform(table, lambda x: F.when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.array(x))))
    names = F.when(v.startswith("["), listed).when(v.startswith("{"), inner).otherwise(F.array(F.btrim(v, F.lit('"'))))
    return values.select(*keep, F.explode(names).alias("filename"))
