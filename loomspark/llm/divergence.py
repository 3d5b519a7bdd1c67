"""Divergence of the sources of each language, by aggregation in DuckDB shards.

Terms are runs of letters (``TERM``), A-Z lower-cased. Every task counts the terms of its texts in DuckDB by (lang, source, term), and
deals the counts to shards by hash of (lang, term); a shard travels as one packed table a task, not as rows. Each
shard merges its counts in SQL, keeps the terms that ``MIN_DOCS`` documents of their language hold, and writes them in pieces of whole
terms. Spark sums the sizes of groups and languages over the pieces. Each piece then computes, again in SQL, its part of every sum over pairs of sources
and its best terms; Spark merges the sums and ranks both.

A group's share of a term is p = 1 + floor(BILLION * (count + 1) / (N + V)), N its kept occurrences and V the kept
terms of its language; f(p, q) = floor((p - q)^2 / q). With p0, q0 the shares of a term that does not occur, the sum of a pair over all kept terms is

    V f(p0, q0)  +  sum over terms of the first [f(p, q0) - f(p0, q0)]  +  sum over terms of the second [f(p0, q) - f(p0, q0)]
                 +  sum over terms of both [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]

so that a piece joins only sources that share a term; the middle sums need how many terms have which count. All in integers, exactly.

Edge cases: null text, lang and source count as ''; every row is a document of its own, repeated or not; groups without terms take part, with N = 0; a
language without kept terms gives its pairs the value 0, ranked by name; a lone source has no pairs; ties rank by the item's UTF-8 bytes; an empty
table gives no rows; texts of any length are counted whole; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import materialize, shuffle_width

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
BILLION = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
#: Texts are counted when so many bytes of them have come together, and kept counts written in pieces of some PIECE_ROWS.
COUNT_BYTES = 24 << 20
PIECE_ROWS = 100_000
DUCKDB_MB = 400
#: Longer texts are cut between terms into rows of the same document, so that no SQL value is large.
CUT_CHARS = 1 << 14
_BETWEEN = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

COUNT = f"""
SELECT (hash(lang, term) % $shards)::INTEGER AS shard, lang, source, term, sum(n)::BIGINT AS n, count(*) AS docs
FROM (SELECT r, lang, source, term, count(*) AS n
      FROM (SELECT r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term
            FROM texts)
      GROUP BY ALL)
GROUP BY ALL ORDER BY shard
"""

#: Of one shard: counts of terms that enough documents of their language hold.
KEEP = f"""
SELECT lang, source, term, n FROM (
    SELECT *, sum(docs) OVER (PARTITION BY lang, term) AS holders
    FROM (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs) AS docs FROM counts GROUP BY ALL))
WHERE holders >= {MIN_DOCS} ORDER BY lang, term
"""


def _share(count: str, total: str, terms: str, kind: str) -> str:
    return f"(1 + ({BILLION}::{kind} * ({count} + 1) // ({total} + {terms}))::BIGINT)"


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) // {q})"


def piece_sql(kind: str) -> tuple[str, str]:
    """Sums of pairs and best terms of one piece; ``kind`` is the integer type that holds BILLION times a count."""
    f, f_q0, f_p0, f_00 = (_f(p, q) for p, q in (("a.p", "b.p"), ("a.p", "b.p0"), ("a.p0", "b.p"), ("a.p0", "b.p0")))
    shares = f"""
    WITH g AS (SELECT *, {_share("0", "total", "terms", kind)} AS p0 FROM groups),
    x AS (SELECT c.*, g.lang_total, g.terms, g.p0, {_share("c.n", "g.total", "g.terms", kind)} AS p FROM counts c JOIN g USING (lang, source))"""
    pairs = f"""{shares},
    h AS (SELECT lang, source, p, p0, count(*) AS k FROM x GROUP BY ALL),
    parts AS (
        SELECT a.lang, a.source, b.source AS item, {f} - {f_q0} - {f_p0} + {f_00} AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
        UNION ALL
        SELECT a.lang, a.source, b.source, a.k * ({f_q0} - {f_00}) FROM h a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        UNION ALL
        SELECT a.lang, a.source, b.source, b.k * ({f_p0} - {f_00}) FROM g a JOIN h b ON a.lang = b.lang AND a.source <> b.source)
    SELECT lang, source, 'pair' AS part, item, sum(value::HUGEINT)::DECIMAL(38, 0) AS value FROM parts GROUP BY ALL"""
    terms = f"""{shares},
    q AS (SELECT *, {_share("sum(n) OVER (PARTITION BY lang, term)", "lang_total", "terms", kind)} AS q FROM x)
    SELECT lang, source, 'term' AS part, term AS item, {_f("p", "q")}::DECIMAL(38, 0) AS value FROM q WHERE p > q
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {TOP_TERMS}"""
    return pairs, terms


@contextmanager
def _duckdb() -> Iterator[duckdb.DuckDBPyConnection]:
    """A database of one task, that spills to the task's own temporary folder and leaves nothing there."""
    with tempfile.TemporaryDirectory() as folder:
        con = duckdb.connect(config={"threads": 1, "memory_limit": f"{DUCKDB_MB}MB", "temp_directory": folder, "preserve_insertion_order": False})
        try:
            yield con
        finally:
            con.close()


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _arrow(con: duckdb.DuckDBPyConnection, sql: str, given: dict | None = None) -> pa.Table:
    got = con.execute(sql, given or {}).to_arrow_table()
    return got.combine_chunks()


def _rows(batch: pa.RecordBatch, first: int) -> pa.Table:
    """(r, lang, source, text) of a batch whose first row has number ``first``."""
    number = pa.array(range(first, first + batch.num_rows), pa.int64())
    if (pc.max(pc.utf8_length(batch.column(2))).as_py() or 0) <= CUT_CHARS:
        return pa.table([number, *batch.columns], names=["r", "lang", "source", "text"])
    out = []
    for r, lang, source, text in zip(number.to_pylist(), *(c.to_pylist() for c in batch.columns), strict=True):
        at = 0
        while text and len(text) - at > CUT_CHARS and (m := _BETWEEN.search(text, at + CUT_CHARS)):
            out.append((r, lang, source, text[at : m.start()]))
            at = m.start()
        out.append((r, lang, source, text[at:] if at else text))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["r", "lang", "source", "text"])


def _counted(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, counts): the packed counts of each task's texts, by shard."""

    def count(con: duckdb.DuckDBPyConnection, texts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        con.register("texts", pa.concat_tables(texts))
        got = _arrow(con, COUNT, {"shards": shards})
        con.unregister("texts")
        shard, rows = got.column("shard").to_numpy(), got.drop_columns("shard")
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)] if len(shard) else []
        for a, b in itertools.pairwise(cuts):
            yield pa.RecordBatch.from_arrays([pa.array([shard[a]], pa.int32()), pa.array([_packed(rows.slice(a, b - a))], pa.binary())], names=["shard", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, row = [], 0, 0
        with _duckdb() as con:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    held.append(_rows(some, row))
                    row += some.num_rows
                    size += some.nbytes
                    if size >= COUNT_BYTES:
                        yield from count(con, held)
                        held, size = [], 0
            if held:
                yield from count(con, held)

    return docs.select("lang", "source", "text").mapInArrow(run, "shard int, counts binary")


def _kept(counted: DataFrame, shards: int) -> DataFrame:
    """Pieces (shard, counts) of whole kept terms, and rows (lang, source, total) and (lang, terms) of what each piece holds."""
    schema = "shard int, lang string, source string, total long, terms long, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _duckdb() as con:
            shard = None
            for batch in batches:
                for number, data in zip(batch.column(0), batch.column(1), strict=True):
                    shard = number.as_py() if shard is None else min(shard, number.as_py())
                    con.register("packed", _unpacked(data.as_py()))
                    con.execute("CREATE TABLE IF NOT EXISTS counts AS FROM packed LIMIT 0")
                    con.execute("INSERT INTO counts FROM packed")
                    con.unregister("packed")
            if shard is None:
                return
            con.execute(f"CREATE TABLE kept AS {KEEP}")
            con.execute("DROP TABLE counts")
            con.execute(f"""CREATE TABLE cut AS SELECT lang, term, (sum(sources) OVER (ORDER BY lang, term ROWS UNBOUNDED PRECEDING) - sources)::BIGINT // {PIECE_ROWS} AS k
                            FROM (SELECT lang, term, count(*) AS sources FROM kept GROUP BY ALL)""")
            for (k,) in con.execute("SELECT DISTINCT k FROM cut ORDER BY k").fetchall():
                rows = _arrow(con, f"SELECT kept.* FROM kept JOIN cut USING (lang, term) WHERE k = {k} ORDER BY lang, term")
                con.register("piece", rows)
                facts = _arrow(con, """SELECT lang, source, sum(n)::BIGINT AS total, NULL::BIGINT AS terms FROM piece GROUP BY ALL
                                       UNION ALL SELECT lang, NULL, NULL, count(DISTINCT term) FROM piece GROUP BY ALL""")
                con.unregister("piece")
                blank = pa.nulls(facts.num_rows)
                columns = [blank.cast(pa.int32()), *(c.combine_chunks() for c in facts.columns), blank.cast(pa.binary())]
                names = ["shard", "lang", "source", "total", "terms", "counts"]
                yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names)
                one = [pa.array([shard], pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([_packed(rows)], pa.binary())]
                yield pa.RecordBatch.from_arrays(one, names=names)

    return counted.repartition(shards, "shard").mapInArrow(run, schema)


def _scored(kind: str):
    """Of the pieces of a shard and the groups: sums of pairs and best terms."""
    pairs, terms = piece_sql(kind)

    def run(pieces: pa.Table, groups: pa.Table) -> pa.Table:
        schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.decimal128(38, 0))])
        got = [schema.empty_table()]
        for data in pieces.column("counts"):
            with _duckdb() as con:
                con.register("packed", _unpacked(data.as_py()))
                con.execute("CREATE TABLE counts AS FROM packed")
                con.register("groups", groups)
                got += [_arrow(con, sql).cast(schema) for sql in (pairs, terms)]
        return pa.concat_tables(got)

    return run


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one, and its most typical terms."""
    spark = docs.sparkSession
    shards = shuffle_width(spark)
    kept = materialize(_kept(_counted(docs, shards), shards), "divergence")
    facts = kept.where("counts IS NULL")
    totals = facts.where("source IS NOT NULL").groupBy("lang", "source").agg(F.sum("total").alias("total"))
    langs = facts.groupBy("lang").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("lang_total"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms"))
    every = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialize(groups.select("lang", "source", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("total", "lang_total", "terms")]), "divergence-groups")

    # BILLION times a count fits a long for all but giant corpora; either type is exact.
    largest = groups.agg(F.max("lang_total")).first()[0] or 0
    kind = "BIGINT" if BILLION * (largest + 1) < 1 << 63 else "HUGEINT"
    pieces = kept.where("counts IS NOT NULL").select("shard", "counts")
    copies = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    sent = groups.select("*", copies.alias("shard"))  # the groups, once for each shard
    scored = pieces.groupBy("shard").cogroup(sent.groupBy("shard")).applyInArrow(_scored(kind), "lang string, source string, part string, item string, value decimal(38,0)")
    scored = materialize(scored, "divergence-parts")  # pairs and terms are ranked apart

    # Every pair of a language's sources is a row of the result. Blocks of the second source spread them over tasks.
    share = F.expr(f"CASE WHEN terms = 0 THEN 0L ELSE 1 + {BILLION} DIV (total + terms) END")
    one = groups.select("lang", "source", "terms", share.alias("p"), copies.alias("block"))
    two = groups.select("lang", F.col("source").alias("item"), share.alias("q"), F.pmod(F.xxhash64("source"), F.lit(shards)).cast("int").alias("block"))
    absent = F.expr("CASE WHEN terms = 0 THEN 0 ELSE CAST(terms AS DECIMAL(19,0)) * ((p - q) * (p - q) DIV q) END").cast("decimal(38,0)")
    base = one.join(two, ["lang", "block"]).where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", absent.alias("value"))
    names = ["lang", "source", "part", "item"]
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    # A term stands in one piece only; of each task's rows at most TOP_TERMS of a group travel.
    terms = scored.where("part = 'term'").select(*names, F.col("value").cast("long").alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    merged = base.union(scored.where("part = 'pair'")).groupBy(*names).agg(F.sum("value").cast("long").alias("value"))
    return merged.withColumn("rank", F.row_number().over(order)).union(terms)
