"""Binary event files: framed, checksummed records of scalars, histograms and texts.

A record is its length in bytes (8 bytes, little-endian), the CRC-32 of its payload (4 bytes), the payload, and 12 zero bytes, the empty mask that ends a frame. The payload is
the record's JSON, which holds no zero byte, and length and checksum have at most 11 in a row: so a file is parted at the masks wherever it is split, and
is read and written in parallel by Spark's own text source with the mask as line end. Nothing here runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = "\0" * 12
HISTOGRAM = "struct<min double, max double, num long, sum double, sum_squares double, bins array<struct<bin int, n long>>>"
PAYLOAD = f"kind string, tag string, step long, wall_time double, value double, text string, histogram {HISTOGRAM}"


def scalars(rows: DataFrame, tag: str, value: str, step: str, time: str) -> DataFrame:
    """A record for each row; null values give none."""
    return _records(rows.where(F.col(value).isNotNull()), "scalar", F.lit(tag), step, time, value=F.col(value).cast("double"))


def texts(rows: DataFrame, tag: str, text: str, step: str, time: str) -> DataFrame:
    return _records(rows.where(F.col(text).isNotNull()), "text", F.lit(tag), step, time, text=F.col(text))


def histograms(rows: DataFrame, tag: str, value: str, step: str, time: str, bins: int = 30) -> DataFrame:
    """A record for each step: equal bins between its least and greatest value, the greatest in the last one."""
    known = rows.where(F.col(value).isNotNull()).select(F.col(step).alias("step"), F.col(time).alias("time"), F.col(value).cast("double").alias("v"))
    facts = known.groupBy("step").agg(F.max("time").alias("time"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("*").alias("num"), F.sum("v").alias("sum"), F.sum(F.col("v") * F.col("v")).alias("sum_squares"))
    width = (F.col("max") - F.col("min")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("min")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counted = known.join(facts, "step").groupBy("step", at.alias("bin")).agg(F.count("*").alias("n")).groupBy("step").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    joined = facts.join(counted, "step").withColumn("h", F.struct("min", "max", "num", "sum", "sum_squares", "bins"))
    return _records(joined, "histogram", F.lit(tag), "step", "time", histogram=F.col("h"))


def _records(rows: DataFrame, kind: str, tag: Column, step: str, time: str, **given: Column) -> DataFrame:
    null = lambda t: F.lit(None).cast(t)
    cols = {"value": null("double"), "text": null("string"), "histogram": null(HISTOGRAM)} | given
    return rows.select(F.lit(kind).alias("kind"), tag.alias("tag"), F.col(step).cast("long").alias("step"), F.unix_micros(F.col(time).cast("timestamp")).cast("double").__truediv__(1e6).alias("wall_time"), *[c.cast(HISTOGRAM if n == "histogram" else "double" if n == "value" else "string").alias(n) for n, c in cols.items()])


def _little_endian(number: Column, size: int) -> Column:
    """Bytes of a non-negative long, the least first."""
    digits = F.reverse(F.lpad(F.hex(number), 2 * size, "0"))
    return F.unhex(F.regexp_replace(digits, "(.)(.)", "$2$1"))


def _number(data: Column, size: int) -> Column:
    turned = F.regexp_replace(F.reverse(F.hex(data)), "(.)(.)", "$2$1")
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def write_events(records: DataFrame, path: str) -> None:
    """Append records (the columns of PAYLOAD) to a folder of event files."""
    payload = F.to_json(F.struct(*[F.col(f.name) for f in records.schema])).cast("binary")
    framed = records.select(payload.alias("p")).select(F.concat(_little_endian(F.length("p").cast("long"), 8), _little_endian(F.crc32("p"), 4), F.col("p")).cast("string").alias("value"))
    framed.write.mode("append").option("lineSep", MASK).text(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The records of event files, and what is wrong with those that cannot be read: (file, problem, and the columns of PAYLOAD).

    ``problem`` is null, ``torn`` (fewer bytes than the frame says: a writer stopped) or ``corrupt`` (checksum or payload do not fit); such frames have no other values.
    """
    raw = spark.read.option("lineSep", MASK).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("b")).where(F.length("b") > 0)
    payload = F.expr("substring(b, 13)")
    cut = raw.select("file", "b", F.when(F.length("b") >= 12, _number(F.expr("substring(b, 1, 8)"), 8)).alias("n"), F.when(F.length("b") >= 12, _number(F.expr("substring(b, 9, 4)"), 4)).alias("crc"), payload.alias("p"))
    torn = F.col("n").isNull() | (F.length("p") < F.col("n"))
    parsed = cut.withColumn("r", F.from_json(F.col("p").try_cast("string") if hasattr(F.col("p"), "try_cast") else F.col("p").cast("string"), PAYLOAD))
    wrong = (F.length("p") > F.col("n")) | (F.crc32("p") != F.col("crc")) | F.col("r").isNull() | F.col("r.kind").isNull()
    marked = parsed.withColumn("problem", F.when(torn, "torn").when(wrong, "corrupt"))
    return marked.withColumn("r", F.when(F.col("problem").isNull(), F.col("r"))).select("file", "problem", "r.*")
