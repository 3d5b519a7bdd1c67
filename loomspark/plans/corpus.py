"""Queries over the document corpus: extraction, normalisation, vocabularies and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.catalog import Catalog
from loomspark.functions.text import FOLD_FROM, FOLD_TO, byte_length, is_not_blank, normalize
from loomspark.operators import rules, tokenize, vocab
from loomspark.operators.pack import char_tokens
from loomspark.sources import extract, readers
from loomspark.tables import table

NORMAL = f"translate(lower(text), '{FOLD_FROM}', '{FOLD_TO}')"
LINES = f"l AS (SELECT unnest(string_split({NORMAL}, chr(10))) AS t FROM documents WHERE regexp_matches(text, '\\S'))"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PIECES = ("the ", "and ", "ing", "tion", "er", "en", "on", "th", "an", "re", "de ", "la ", "es", "ch", "e", "t", "a", "o", "n", "i", "s", "r", " ")
MERGES = (("t", "h"), ("e", " "), ("e", "r"), ("th", "e"), ("o", "n"))


def register(c: Catalog) -> None:
    def docs(spark, sf_dir):
        return table(spark, sf_dir, "documents")

    def normal(spark, sf_dir):
        return docs(spark, sf_dir).where(is_not_blank("text")).select("doc_id", normalize("text").alias("text"))

    @c.query(
        "doc_text_stats",
        """SELECT lang, count(*) AS num_samples, sum(strlen(text))::BIGINT AS total_bytes, sum(length(text))::BIGINT AS total_chars
           FROM documents WHERE regexp_matches(text, '\\S') GROUP BY lang""",
    )
    def doc_text_stats(spark, sf_dir):
        rows = docs(spark, sf_dir).where(is_not_blank("text"))
        return rows.groupBy("lang").agg(F.count("*").alias("num_samples"), F.sum(byte_length("text")).alias("total_bytes"), F.sum(F.length("text")).cast("long").alias("total_chars"))

    @c.query("doc_normalize_md5", f"SELECT doc_id, md5({NORMAL}) AS h FROM documents WHERE regexp_matches(text, '\\S')")
    def doc_normalize_md5(spark, sf_dir):
        return normal(spark, sf_dir).select("doc_id", F.md5("text").alias("h"))

    @c.query("char_freq", f"WITH {LINES}, c AS (SELECT unnest(string_split(t, '')) AS token FROM l) SELECT token, count(*) AS n FROM c WHERE token <> '' GROUP BY 1")
    def char_freq(spark, sf_dir):
        return vocab.char_counts(normal(spark, sf_dir))

    @c.query(
        "char_vocab_minfreq",
        f"""WITH {LINES}, c AS (SELECT unnest(string_split(t, '')) AS token FROM l)
        SELECT token, count(*) AS n FROM c WHERE token <> '' GROUP BY 1 HAVING count(*) >= 2
        UNION ALL SELECT printf('<0x%02X>', i), 0 FROM range(256) AS r(i)""",
    )
    def char_vocab_minfreq(spark, sf_dir):
        return vocab.char_vocabulary(normal(spark, sf_dir))

    pairs = f"WITH {LINES}, p AS (SELECT substr(t, i, 1) AS l, substr(t, i + 1, 1) AS r FROM l, unnest(range(1, length(t))) AS u(i)) SELECT l AS left_token, r AS right_token, count(*) AS n FROM p GROUP BY 1, 2"

    @c.query("bigram_counts", pairs)
    def bigram_counts(spark, sf_dir):
        return vocab.pair_counts(normal(spark, sf_dir))

    @c.query("bigram_topk", pairs + " ORDER BY n DESC, left_token, right_token LIMIT 50")
    def bigram_topk(spark, sf_dir):
        return vocab.top_k(vocab.pair_counts(normal(spark, sf_dir)), 50)

    o, e = vocab.OPEN, vocab.CLOSE
    best = "SELECT l, r, count(*) AS n FROM (SELECT x[i] AS l, x[i + 1] AS r FROM (SELECT string_split(trim(w, '{o}{e}'), '{e}{o}') AS x FROM {src} WHERE w <> ''), unnest(range(1, len(x))) AS u(i)) GROUP BY 1, 2 ORDER BY n DESC, l, r LIMIT 1"
    wrap = "regexp_replace(t, '([\\s\\S])', '{o}\\1{e}', 'g')"
    step = "SELECT replace(w, '{o}' || l || '{e}{o}' || r || '{e}', '{o}' || l || r || '{e}') AS w FROM {src}, {b}"

    @c.query(
        "bpe_merge_3",
        f"""WITH {LINES}, w0 AS (SELECT {wrap.format(o=o, e=e)} AS w FROM l), b0 AS MATERIALIZED ({best.format(o=o, e=e, src="w0")}),
        w1 AS MATERIALIZED ({step.format(o=o, e=e, src="w0", b="b0")}), b1 AS MATERIALIZED ({best.format(o=o, e=e, src="w1")}),
        w2 AS MATERIALIZED ({step.format(o=o, e=e, src="w1", b="b1")}), b2 AS ({best.format(o=o, e=e, src="w2")})
        SELECT 0 AS rank, l AS left_token, r AS right_token, n FROM b0 UNION ALL SELECT 1, l, r, n FROM b1 UNION ALL SELECT 2, l, r, n FROM b2""",
    )
    def bpe_merge_3(spark, sf_dir):
        return vocab.train_bpe(normal(spark, sf_dir), 3)

    @c.query(
        "wordpiece_scores_top",
        f"""WITH w AS (SELECT unnest(string_split_regex(trim({NORMAL}, ' ' || chr(10) || chr(9)), '\\s+')) AS w FROM documents WHERE regexp_matches(text, '\\S')),
        k AS (SELECT unnest(string_split(w, '')) AS t FROM w), c AS (SELECT t, count(*) AS n FROM k WHERE t <> '' GROUP BY 1),
        p AS (SELECT substr(w, i, 1) AS l, substr(w, i + 1, 1) AS r FROM w, unnest(range(1, length(w))) AS u(i)),
        q AS (SELECT l, r, count(*) AS n FROM p GROUP BY 1, 2)
        SELECT q.l AS left_token, q.r AS right_token, q.n AS n, round(q.n / (a.n * b.n)::DOUBLE, 12) AS score
        FROM q JOIN c a ON a.t = q.l JOIN c b ON b.t = q.r ORDER BY score DESC, left_token, right_token LIMIT 200""",
    )
    def wordpiece_scores_top(spark, sf_dir):
        scored = vocab.wordpiece_scores(normal(spark, sf_dir)).withColumn("score", F.round("score", 12))
        return scored.orderBy(F.col("score").desc(), "left_token", "right_token").limit(200)

    def best_score(src: str) -> str:
        cut = f"(SELECT string_split(trim(w, '{o}{e}'), '{e}{o}') AS x FROM {src})"
        return f"""SELECT p.l, p.r, p.n / (a.n * b.n)::DOUBLE AS score FROM (SELECT x[i] AS l, x[i + 1] AS r, count(*) AS n FROM {cut}, unnest(range(1, len(x))) AS u(i) GROUP BY 1, 2) p
        JOIN (SELECT t, count(*) AS n FROM (SELECT unnest(x) AS t FROM {cut}) GROUP BY 1) a ON a.t = p.l JOIN (SELECT t, count(*) AS n FROM (SELECT unnest(x) AS t FROM {cut}) GROUP BY 1) b ON b.t = p.r ORDER BY score DESC, l, r LIMIT 1"""

    @c.query(
        "wordpiece_merge_2",
        f"""WITH v AS (SELECT unnest(string_split_regex({NORMAL}, '\\s+')) AS t FROM documents WHERE regexp_matches(text, '\\S')), w0 AS (SELECT {wrap.format(o=o, e=e)} AS w FROM v WHERE t <> ''),
        b0 AS MATERIALIZED ({best_score("w0")}), w1 AS MATERIALIZED ({step.format(o=o, e=e, src="w0", b="b0")}), b1 AS ({best_score("w1")})
        SELECT 0 AS rank, l AS left_token, r AS right_token, round(score, 12) AS score FROM b0 UNION ALL SELECT 1, l, r, round(score, 12) FROM b1""",
    )
    def wordpiece_merge_2(spark, sf_dir):
        return vocab.train_wordpiece(normal(spark, sf_dir), 2).withColumn("score", F.round("score", 12))

    def substrings(expr: str, longest: int, k: int) -> str:
        return f"""WITH l AS (SELECT t, count(*) AS m FROM (SELECT unnest(string_split({expr}, chr(10))) AS t FROM documents WHERE regexp_matches(text, '\\S')) GROUP BY 1),
        s AS (SELECT m, substr(t, i, n) AS token FROM l, unnest(range(1, length(t) + 1)) AS u(i), unnest(range(1, {longest} + 1)) AS v(n) WHERE i + n - 1 <= length(t))
        SELECT token, sum(m)::BIGINT AS n FROM s GROUP BY 1 ORDER BY n DESC, token LIMIT {k}"""

    @c.query("substring_topk_10", substrings(NORMAL, 10, 300))
    def substring_topk_10(spark, sf_dir):
        return vocab.train_unigram(normal(spark, sf_dir), 300)

    @c.query("sp_substring_topk_16", substrings(f"('▁' || replace({NORMAL}, ' ', ' ▁'))", 16, 300))
    def sp_substring_topk_16(spark, sf_dir):
        return vocab.train_sentencepiece(normal(spark, sf_dir), 300)

    longest = sorted(PIECES, key=lambda p: (-len(p), p))
    pattern = "(" + "|".join([*longest, "[\\s\\S]"]) + ")"
    found = f"regexp_extract_all({NORMAL}, '{pattern}', 1)"

    @c.query("greedy_encode", f"SELECT doc_id, len(p)::BIGINT AS n, md5(array_to_string(p, '|')) AS h FROM (SELECT doc_id, {found} AS p FROM documents WHERE regexp_matches(text, '\\S'))")
    def greedy_encode(spark, sf_dir):
        p = tokenize.greedy_pieces(F.col("text"), PIECES)
        return normal(spark, sf_dir).select("doc_id", p.alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|")).alias("h"))

    book = lambda: tokenize.Vocabulary([*PIECES, *(a + b for a, b in MERGES), *"abcdefghijklmnopqrstuvwxyz"], MERGES)

    @c.query("unigram_encode", f"""SELECT doc_id, len(p)::BIGINT AS n, len(list_filter(p, lambda x: x NOT IN ({", ".join("'" + x + "'" for x in sorted({*PIECES, *"abcdefghijklmnopqrstuvwxyz", *(a + b for a, b in MERGES)}))})))::BIGINT AS n_unk
        FROM (SELECT doc_id, regexp_extract_all({NORMAL}, '({"|".join([*sorted({*PIECES, *(a + b for a, b in MERGES)}, key=lambda p: (-len(p), p)), "[\\s\\S]"])})', 1) AS p FROM documents WHERE regexp_matches(text, '\\S'))""")
    def unigram_encode(spark, sf_dir):
        v = book()
        rows = tokenize.encode(normal(spark, sf_dir), v, "unigram").drop("text")
        return rows.select("doc_id", F.size("tokens").cast("long").alias("n"), F.size(F.filter("tokens", lambda x: x == v.id("unk"))).cast("long").alias("n_unk"))

    book_list = "[" + ", ".join(f"'{x}'" for x in dict.fromkeys([*tokenize.SPECIAL_TOKENS.values(), *PIECES, *(a + b for a, b in MERGES), *"abcdefghijklmnopqrstuvwxyz"])) + "]"
    # With these merges a pass from the left leaves what this pattern finds, and a second one changes nothing.
    merged = f"regexp_extract_all({NORMAL}, 'the|th|e |er|on|[\\s\\S]')"

    @c.query("bpe_encode", f"SELECT doc_id, len(p)::BIGINT AS n, md5(array_to_string(list_transform(p, lambda x: coalesce(list_position({book_list}, x), 4) - 1), ' ')) AS h FROM (SELECT doc_id, {merged} AS p FROM documents WHERE regexp_matches(text, '\\S'))")
    def bpe_encode(spark, sf_dir):
        rows = tokenize.encode(normal(spark, sf_dir), book(), "bpe").drop("text")
        return rows.select("doc_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ")).alias("h"))

    inner = ("tion", "ing", "er", "en", "on", "th", "an", "re", "es", "ch")
    letters = "abcdefghijklmnopqrstuvwxyz"
    greedy = "(?:" + "|".join(inner) + "|[a-z])"

    @c.query(
        "wordpiece_encode",
        f"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex({NORMAL}, '\\s+'), lambda x: x <> '')) AS w FROM documents WHERE regexp_matches(text, '\\S')),
        k AS (SELECT doc_id, w, regexp_extract(w, '^{greedy}*') AS known FROM w)
        SELECT doc_id, sum(len(regexp_extract_all(known, '{greedy}')) + (known <> w)::INT)::BIGINT AS n, sum((known <> w)::INT)::BIGINT AS n_unk FROM k GROUP BY 1""",
    )
    def wordpiece_encode(spark, sf_dir):
        v = tokenize.Vocabulary([*inner, *letters, *("##" + x for x in (*inner, *letters))])
        rows = tokenize.encode(normal(spark, sf_dir), v, "wordpiece").drop("text")
        return rows.select("doc_id", F.size("tokens").cast("long").alias("n"), F.size(F.filter("tokens", lambda x: x == v.id("unk"))).cast("long").alias("n_unk"))

    spelled = f"list_transform(p, lambda x: CASE WHEN list_contains({book_list}, x) THEN x ELSE '<|unk|>' END)"
    ordered_book = "|".join([*sorted({*PIECES, *(a + b for a, b in MERGES)}, key=lambda p: (-len(p), p)), "[\\s\\S]"])

    @c.query(
        "decode_roundtrip",
        f"""WITH t AS (SELECT doc_id, regexp_extract_all({NORMAL}, '{ordered_book}') AS p FROM documents WHERE regexp_matches(text, '\\S')), s AS (SELECT doc_id, {spelled} AS p FROM t)
        SELECT doc_id, md5(trim(array_to_string(list_transform(p, lambda x: CASE WHEN x LIKE '% ' THEN x ELSE x || ' ' END), ''))) AS h FROM s""",
    )
    def decode_roundtrip(spark, sf_dir):
        rows = tokenize.encode(normal(spark, sf_dir), book(), "unigram").drop("text")
        return tokenize.decode(rows, book()).select("doc_id", F.md5("text").alias("h"))

    code_list = "list_transform(list_filter(string_split(text, ''), lambda x: x <> ''), lambda x: unicode(x))"

    @c.query(
        "batch_encode_shape",
        f"""WITH t AS (SELECT doc_id, {code_list} AS x FROM documents),
        f AS (SELECT doc_id, CASE WHEN len(x) + 1 > 512 THEN list_concat([1], list_concat(x[1:510], [2])) WHEN len(x) + 1 < 512 THEN list_concat([1], list_concat(x, [2])) ELSE list_concat([1], x) END AS y FROM t)
        SELECT doc_id, 512::BIGINT AS n, len(y)::BIGINT AS n_real, md5(array_to_string(list_concat(y, list_transform(range(512 - len(y)), lambda i: 0)), ' ')) AS h FROM f""",
    )
    def batch_encode_shape(spark, sf_dir):
        ids = tokenize.frame_batch(char_tokens(F.col("text")), 1, 2, 512, 0)
        rows = docs(spark, sf_dir).select("doc_id", ids.alias("y"))
        mask = F.aggregate(tokenize.attention_mask(F.col("y"), 0), F.lit(0.0), lambda s, x: s + x)
        return rows.select("doc_id", F.size("y").cast("long").alias("n"), mask.cast("long").alias("n_real"), F.md5(F.array_join(F.transform("y", lambda v: v.cast("string")), " ")).alias("h"))

    @c.query("json_props_text", "SELECT event_id, CASE WHEN json_type(v) IN ('VARCHAR') THEN v->>'$' ELSE v::VARCHAR END AS text FROM (SELECT event_id, json_extract(props, '$.' || json_keys(props)[1]) AS v FROM events)")
    def json_props_text(spark, sf_dir):
        return table(spark, sf_dir, "events").select("event_id", extract.flat_json_text("props").alias("text"))

    @c.query("json_lines_text", "SELECT CASE WHEN json_type(v) IN ('VARCHAR') THEN v->>'$' ELSE v::VARCHAR END AS text FROM (SELECT json_extract(props, '$.' || json_keys(props)[1]) AS v FROM events)")
    def json_lines_text(spark, sf_dir):
        return extract.json_texts(table(spark, sf_dir, "events").select(F.col("props").alias("value")))

    @c.query("extract_text_documents", "SELECT md5(text) AS h FROM documents WHERE regexp_matches(text, '\\S')")
    def extract_text_documents(spark, sf_dir):
        return extract.extract_text(docs(spark, sf_dir)).select(F.md5("text").alias("h"))

    @c.query("extract_compat_customer", "SELECT c_custkey::VARCHAR AS text FROM customer")
    def extract_compat_customer(spark, sf_dir):
        return extract.extract_text(table(spark, sf_dir, "customer"), compat=True)

    @c.query("plain_numbers", "SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT::VARCHAR ELSE o_totalprice::VARCHAR END AS text FROM orders")
    def plain_numbers(spark, sf_dir):
        return table(spark, sf_dir, "orders").select("o_orderkey", extract.plain_number(F.col("o_totalprice")).alias("text"))

    @c.query(
        "mix_percentages",
        """WITH t AS (SELECT source AS name, count(*) / (SELECT count(*) FROM documents)::DOUBLE * 1.5 AS percentage FROM documents GROUP BY 1)
        SELECT 'error' AS severity, '' AS name, 'shares must add up to 1' AS message FROM (SELECT sum(percentage) AS s FROM t) WHERE abs(s - 1) > 1e-6
        UNION ALL SELECT 'error', name, 'a share must lie between 0 and 1' FROM t WHERE percentage < 0 OR percentage > 1""",
    )
    def mix_percentages(spark, sf_dir):
        d = docs(spark, sf_dir)
        total = d.agg(F.count("*").alias("t"))
        mix = d.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("name", (F.col("n") / F.col("t") * 1.5).alias("percentage"))  # one row
        return rules.mix_violations(mix)

    @c.query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
    def table_counts(spark, sf_dir):
        out = None
        for t in TABLES:
            one = table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
            out = one if out is None else out.unionByName(one)
        return out

    @c.query("split_file_names", "SELECT split, rank, filename FROM (SELECT DISTINCT coalesce(source, 'none') AS split FROM documents) AS s(split), LATERAL (VALUES (0, split || '.parquet'), (1, 'data/' || split || '.parquet'), (2, split || '-00000-of-00001.parquet'), (3, 'data/' || split || '-00000-of-00001.parquet')) AS f(rank, filename)")
    def split_file_names(spark, sf_dir):
        sources = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("split")).distinct()
        return readers.split_candidates(sources)

    shard_sql = " UNION ALL ".join(
        f"SELECT n_name, {k} AS pattern, i::INT AS shard, {expr} AS filename FROM nation, range({n}) AS r(i)"
        for k, (n, expr) in enumerate((
            (32, "printf('train-%05d-of-%05d.parquet', i, 32)"), (32, "printf('data/train-%05d-of-%05d.parquet', i, 32)"), (16, "printf('train-%05d.parquet', i)"),
            (16, "printf('data/train-%05d.parquet', i)"), (16, "printf('part-%05d.parquet', i)"), (10, "printf('shard-%05d.parquet', i)"), (10, "printf('%04d.parquet', i)"),
        ))
    )

    @c.query("shard_file_names", shard_sql)
    def shard_file_names(spark, sf_dir):
        return readers.shard_candidates(table(spark, sf_dir, "nation"), "n_name")
