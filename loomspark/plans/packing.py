"""Queries over token sequences: packing, windows, batches, splits, augmentation and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.catalog import Catalog
from loomspark.operators import pack
from loomspark.tables import table

SEED = 42
CODES = "list_transform(list_filter(string_split(text, ''), lambda x: x <> ''), lambda x: unicode(x))"
KEY = "('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT"
VAL = "least(greatest(ceil({n} * {r}), 1), {n} - 1)"


def _digest(column: str):
    return F.md5(F.array_join(F.transform(column, lambda x: x.cast("string")), " "))


def register(c: Catalog) -> None:
    def tokens(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", "lang", pack.char_tokens(F.col("text")).alias("tokens"))

    @c.query(
        "pack_sequences",
        f"""WITH t AS (SELECT doc_id, {CODES} AS x FROM documents), u AS (SELECT doc_id, i, x[i] AS tok FROM t, unnest(range(1, len(x) + 1)) AS r(i)),
        n AS (SELECT tok, row_number() OVER (ORDER BY doc_id, i) - 1 AS place FROM u)
        SELECT (place // 513)::BIGINT AS seq_id, md5(string_agg(tok::VARCHAR, ' ' ORDER BY place)) AS h FROM n GROUP BY 1 HAVING count(*) = 513""",
    )
    def pack_sequences(spark, sf_dir):
        return pack.pack(tokens(spark, sf_dir), 512, "doc_id").select("seq_id", _digest("tokens").alias("h"))

    @c.query(
        "pack_stats",
        """SELECT *, total_tokens / num_sequences::DOUBLE AS avg_sequence_length FROM (
        SELECT count(*) AS num_samples, sum(strlen(text))::BIGINT AS total_bytes, sum(length(text))::BIGINT AS total_tokens, (sum(length(text)) // 513)::BIGINT AS num_sequences FROM documents)""",
    )
    def pack_stats(spark, sf_dir):
        rows = table(spark, sf_dir, "documents").select("text", pack.char_tokens(F.col("text")).alias("tokens"))
        return pack.pack_stats(rows, 512, "text")

    windows_sql = f"""WITH t AS (SELECT doc_id, {CODES} AS x FROM documents),
        s AS (SELECT doc_id, x, list_concat(range(0, greatest(len(x) - 65, 0) + 1, 65), CASE WHEN len(x) > 65 AND (len(x) - 65) % 65 <> 0 THEN [len(x) - 65] ELSE [] END) AS st FROM t WHERE len(x) > 64),
        w AS (SELECT doc_id, (p - 1)::INT AS pos, x[st[p] + 1 : st[p] + 65] AS y FROM s, unnest(range(1, len(st) + 1)) AS r(p))"""

    @c.query("line_windows", windows_sql + " SELECT doc_id, pos, md5(array_to_string(y, ' ')) AS h FROM w")
    def line_windows(spark, sf_dir):
        w = tokens(spark, sf_dir).select("doc_id", F.posexplode(pack.line_windows(F.col("tokens"), 64)).alias("pos", "y"))
        return w.select("doc_id", "pos", _digest("y").alias("h"))

    @c.query("shifted_pairs", windows_sql + " SELECT doc_id, pos, md5(array_to_string(y[1:64], ' ')) AS input_h, md5(array_to_string(y[2:65], ' ')) AS target_h FROM w")
    def shifted_pairs(spark, sf_dir):
        w = tokens(spark, sf_dir).select("doc_id", F.posexplode(pack.line_windows(F.col("tokens"), 64)).alias("pos", "y"))
        a, b = pack.shifted(F.col("y"), 64)
        return w.select("doc_id", "pos", a.alias("a"), b.alias("b")).select("doc_id", "pos", _digest("a").alias("input_h"), _digest("b").alias("target_h"))

    @c.query("batch_assignment", "SELECT doc_id, ((rn - 1) // 32)::BIGINT AS batch_id, ((rn - 1) % 32)::BIGINT AS pos_in_batch FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)")
    def batch_assignment(spark, sf_dir):
        return pack.batches(table(spark, sf_dir, "documents").select("doc_id"), 32, "doc_id")

    @c.query(
        "batch_shuffled_droplast",
        """WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY ('0x' || substr(md5('42:1:' || doc_id), 1, 8))::BIGINT, doc_id) - 1 AS rn FROM documents)
        SELECT doc_id, (rn // 48)::BIGINT AS batch_id, (rn % 48)::BIGINT AS pos_in_batch FROM k WHERE rn // 48 < (SELECT count(*) // 48 FROM documents)""",
    )
    def batch_shuffled_droplast(spark, sf_dir):
        return pack.batches(table(spark, sf_dir, "documents").select("doc_id"), 48, "doc_id", SEED, 1, drop_last=True)

    @c.query("batch_count", "SELECT (count(*) // 48)::BIGINT AS dropping_last, ceil(count(*) / 48.0)::BIGINT AS keeping_last FROM documents")
    def batch_count(spark, sf_dir):
        return pack.batch_count(table(spark, sf_dir, "documents"), 48)

    @c.query(
        "batch_filled",
        """WITH n AS (SELECT count(*) AS n FROM documents), e AS (SELECT doc_id, row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT, doc_id) AS rn FROM documents)
        SELECT doc_id, false AS filled FROM documents UNION ALL SELECT doc_id, true FROM e, n WHERE rn <= (48 - n % 48) % 48""",
    )
    def batch_filled(spark, sf_dir):
        return pack.fill_batch(table(spark, sf_dir, "documents").select("doc_id"), 48, "doc_id", SEED)

    @c.query("micro_batch_ids", "SELECT doc_id, ((rn - 1) // 32)::BIGINT AS batch_id, ((rn - 1) % 32 // 8)::BIGINT AS micro_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)")
    def micro_batch_ids(spark, sf_dir):
        b = pack.batches(table(spark, sf_dir, "documents").select("doc_id"), 32, "doc_id")
        return b.select("doc_id", "batch_id", pack.micro_batch(F.col("pos_in_batch"), 8).alias("micro_id"))

    @c.query("shuffle_order", f"SELECT doc_id, row_number() OVER (ORDER BY {KEY.replace('42:', '42:3:')}, doc_id) - 1 AS shuffle_pos FROM documents")
    def shuffle_order(spark, sf_dir):
        return pack.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SEED, 3)

    @c.query("split_train_val", f"SELECT doc_id, rn < {VAL.format(n='n', r=0.05)} AS is_validation FROM (SELECT doc_id, row_number() OVER (ORDER BY {KEY}, doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents)")
    def split_train_val(spark, sf_dir):
        return pack.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.05, SEED)

    @c.query(
        "split_stratified",
        f"SELECT doc_id, lang, rn < {VAL.format(n='n', r=0.1)} AS is_validation FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {KEY}, doc_id) - 1 AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)",
    )
    def split_stratified(spark, sf_dir):
        return pack.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 0.1, SEED)

    @c.query(
        "pack_by_language",
        f"""WITH t AS (SELECT lang, doc_id, unnest(range(1, len({CODES}) + 1)) AS i, unnest({CODES}) AS tok FROM documents), o AS (SELECT lang, tok, row_number() OVER (PARTITION BY lang ORDER BY doc_id, i) - 1 AS place FROM t)
        SELECT lang AS k, place // 513 AS seq_id, md5(string_agg(tok::VARCHAR, ' ' ORDER BY place)) AS h FROM o GROUP BY 1, 2 HAVING count(*) = 513""",
    )
    def pack_by_language(spark, sf_dir):
        packed = pack.pack(tokens(spark, sf_dir).withColumnRenamed("lang", "k"), 512, "doc_id", by="k")
        return packed.select("k", "seq_id", _digest("tokens").alias("h"))

    u = lambda at: f"(('0x' || substr(md5('7:' || doc_id || ':' || (i - 1)), {at}, 8))::BIGINT / 4294967296.0)"

    @c.query(
        "augment_mask_hash",
        f"""WITH t AS (SELECT doc_id, {CODES} AS x FROM documents), s AS (SELECT doc_id, i, x[i] AS tok FROM t, unnest(range(1, len(x) + 1)) AS r(i)),
        o AS (SELECT doc_id, tok, row_number() OVER (PARTITION BY doc_id ORDER BY (i - 1) // 3, {u(25)}, i) AS i FROM s),
        m AS (SELECT doc_id, i, CASE WHEN {u(1)} >= 0.15 THEN tok WHEN {u(9)} < 0.8 THEN 5000 WHEN {u(9)} < 0.9 THEN floor({u(17)} * 5000)::INT ELSE tok END AS tok FROM o)
        SELECT doc_id, md5(string_agg(tok::VARCHAR, ' ' ORDER BY i)) AS h FROM m GROUP BY 1""",
    )
    def augment_mask_hash(spark, sf_dir):
        done = pack.augment_rows(tokens(spark, sf_dir).where(F.size("tokens") > 0), "tokens", "doc_id", 5000, 0.15, 7)
        return done.select("doc_id", _digest("augmented").alias("h"))

    @c.query("validate_tokens", f"SELECT lang, count(*) AS n, bool_and(len(list_filter({CODES}, lambda x: x < 0 OR x >= 256)) = 0) AS all_valid FROM documents GROUP BY 1")
    def validate_tokens(spark, sf_dir):
        one = F.array(F.col("tokens"))
        ok = pack.valid_batch(one, one, 256)
        return tokens(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.bool_and(ok).alias("all_valid"))

    @c.query(
        "batch_token_stats",
        f"""WITH t AS (SELECT lang, unnest({CODES}) AS tok FROM documents), b AS (SELECT lang, count(*) AS batch_size, sum(length(text))::BIGINT AS total_tokens FROM documents GROUP BY 1),
        k AS (SELECT lang, count(DISTINCT tok) AS unique_tokens FROM t GROUP BY 1) SELECT lang, batch_size, total_tokens, unique_tokens, unique_tokens / total_tokens::DOUBLE AS density FROM b JOIN k USING (lang)""",
    )
    def batch_token_stats(spark, sf_dir):
        return pack.batch_statistics(tokens(spark, sf_dir), "lang")
