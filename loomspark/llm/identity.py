"""Keys that tell documents apart where rows of one doc_id hold different texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.pack import ranked
from loomspark.session import materialize


def with_key(docs: DataFrame, key: str = "_key") -> DataFrame:
    """docs with a long that is the same for rows of one doc_id and text, differs between texts, and keeps the order of doc_ids; null for null doc_ids.

    It is the doc_id itself unless some doc_id has several texts: then the pairs of doc_id and digest of such texts are numbered in order, so
    texts of one doc_id follow each other by their SHA-256.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("_i"), F.coalesce("text", F.lit("")).alias("_t")).where("_i IS NOT NULL")
    twice = known.groupBy("_i").agg(F.count("*").alias("_c")).where("_c > 1").select("_i")
    if twice.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    twice = materialize(twice, "repeated-ids")
    digests = known.join(twice, "_i").select("_i", F.sha2("_t", 256).alias("_s")).distinct()
    several = materialize(digests.withColumn("_d", F.lit(True)), "repeated-texts")
    if several.groupBy("_i").count().where("count > 1").isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    single = known.select("_i").distinct().join(twice, "_i", "left_anti").select("_i", F.lit("").alias("_s"))
    numbers = materialize(ranked(single.unionByName(several.select("_i", "_s")), "_i", "_s", out="_number").select("_i", "_s", F.col("_number").alias(key)), "document-keys")
    marked = docs.withColumn("_j", F.col("doc_id").cast("long")).join(twice.select("_i", F.lit(True).alias("_m")), F.col("_j") == F.col("_i"), "left").drop("_i")
    marked = marked.withColumn("_z", F.when(F.col("_m"), F.sha2(F.coalesce("text", F.lit("")), 256)).otherwise(F.lit("")))
    return marked.join(numbers, (F.col("_j") == F.col("_i")) & (F.col("_z") == F.col("_s")), "left").select(*[docs[c] for c in docs.columns], key)
