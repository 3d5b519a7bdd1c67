"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from loomspark.llm import decontaminate as dc
from loomspark.llm import divergence as dv
from loomspark.llm import quality_rules as qr

WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _js(p: str, q: str) -> str:
    half = "(CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0.0 END)"
    terms = "(" + half.format(a="z[1]", b="z[2]") + " + " + half.format(a="z[2]", b="z[1]") + ")"
    return f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: {terms})) / 2, 0.0))"


def _by_lang(table: dict) -> str:
    cases = " ".join(f"WHEN '{k}' THEN [{', '.join(map(str, v))}]" for k, v in table.items())
    return f"(CASE lang {cases} END)"


def op9() -> str:
    ref_words = _by_lang({k: [f"'{w}'" for w, _ in v] for k, v in qr.WORD_REFERENCE.items()})
    ref_share = _by_lang({k: [*(s for _, s in v), 1 - sum(s for _, s in v)] for k, v in qr.WORD_REFERENCE.items()})
    return f"""
    WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS} AS words,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
               FROM documents),
    g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i + 4]) AS n
          FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
    c AS (SELECT doc_id, least(5, i - lag(i, 1, -10) OVER (PARTITION BY doc_id ORDER BY i)) AS covered FROM g WHERE n > 1),
    r AS (SELECT doc_id, sum(covered)::BIGINT AS n FROM c GROUP BY 1),
    m AS (SELECT w.doc_id, lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(t)::BIGINT AS n_chars,
                 (length(t) - length(regexp_replace(t, '{qr.SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
                 length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper,
                 length(t) - length(regexp_replace(t, '\\p{{Ll}}+', '', 'g')) AS n_lower,
                 length(regexp_replace(t, '[^0-9]+', '', 'g')) AS n_digits,
                 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                 coalesce(r.n, 0)::BIGINT AS n_repeat_words,
                 list_transform({ref_words}, lambda k: len(list_filter(words, lambda x: lower(x) = k))::DOUBLE) AS hits
          FROM w LEFT JOIN r USING (doc_id)),
    d AS (SELECT *, list_transform([n_lower, n_upper, n_digits, n_chars - word_chars, n_symbols,
                       word_chars - n_symbols - n_upper - n_lower - n_digits], lambda x: x::DOUBLE / greatest(n_chars, 1)) AS classes,
                 list_transform(list_append(hits, n_words - list_sum(hits)), lambda x: x / greatest(n_words, 1)) AS shares
          FROM m),
    j AS (SELECT *, n_words < {qr.MIN_WORDS} OR 100 * n_repeat_words > {qr.REPEAT_SHARE} * n_words AS base_failed,
                 CASE WHEN n_chars >= {qr.MIN_CHARS_TO_JUDGE} THEN {_js("classes", _by_lang(qr.CLASS_REFERENCE))} END AS cd,
                 CASE WHEN n_words >= {qr.MIN_WORDS_TO_JUDGE} THEN {_js("shares", ref_share)} END AS wd
          FROM d)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT (coalesce(cd > {qr.MAX_CHAR_DISTANCE} + {qr.SHORT_TEXT_SLACK} / sqrt(n_chars), false) OR coalesce(wd > {qr.MAX_WORD_DISTANCE}, false)) AS kept
    FROM j
    """


def op5() -> str:
    return """
    WITH b AS (SELECT page_id, url, md5(coalesce(html, '')) AS tag, length(coalesce(html, ''))::VARCHAR AS size, (page_id // 10)::VARCHAR AS day,
                      regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages),
    p AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), ':(80|443)$', ''), '^www[.]', '') AS host,
                 regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
                 array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'),
                     lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|gclid|fbclid|ref|sessionid|phpsessid)='))), '&') AS query
          FROM b),
    u AS (SELECT page_id, tag, size, day, host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical_url FROM p),
    r AS (SELECT *, 8 * page_id AS id, 8 * page_id AS ts, false AS is_revisit, tag AS etag, day AS modified FROM u
          UNION ALL SELECT *, 8 * page_id + 1, 8 * page_id + 1, true, 'W/' || tag, NULL FROM u WHERE page_id % 3 = 0
          UNION ALL SELECT *, 8 * page_id + 2, 8 * page_id + 2, true, md5(tag), NULL FROM u WHERE page_id % 3 = 1
          UNION ALL SELECT *, 8 * page_id + 3, 8 * page_id + 3, true, NULL, CASE WHEN page_id % 2 = 0 THEN day ELSE 'later' END FROM u WHERE page_id % 3 = 2
          UNION ALL SELECT *, 8 * page_id + 4, 8 * page_id + 4, true, NULL, NULL FROM u WHERE page_id % 5 = 0
          UNION ALL SELECT *, 8 * page_id + 5, 8 * page_id - 1, true, tag, NULL FROM u WHERE page_id % 7 = 0),
    a AS (SELECT r.*, f.id AS refers_to, f.tag AS f_tag, f.day AS f_day, f.size AS f_size
          FROM r ASOF LEFT JOIN (SELECT * FROM r WHERE NOT is_revisit) f ON r.canonical_url = f.canonical_url AND r.ts > f.ts),
    v AS (SELECT *, CASE WHEN NOT is_revisit THEN NULL WHEN refers_to IS NULL THEN false WHEN etag IS NOT NULL THEN replace(etag, 'W/', '') = f_tag
                         WHEN modified IS NOT NULL THEN modified = f_day ELSE false END AS resolved FROM a)
    SELECT id AS record_id, canonical_url, is_revisit, CASE WHEN is_revisit THEN refers_to END AS refers_to, resolved, ts::VARCHAR AS date,
           CASE WHEN resolved AND etag IS NULL THEN f_tag ELSE etag END AS etag, CASE WHEN resolved AND modified IS NULL THEN f_day ELSE modified END AS last_modified,
           CASE WHEN NOT is_revisit THEN size WHEN resolved THEN f_size ELSE '0' END AS content_length,
           CASE WHEN NOT is_revisit OR resolved THEN 'text/html' END AS content_type, CASE WHEN is_revisit THEN 'max-age=60' END AS cache_control
    FROM v
    """


def op8() -> str:
    tokens = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    seeds = lambda rows, key: " UNION ALL ".join(
        f"SELECT {key}, i AS at, '{tag}' || {' || chr(1) || '.join(f't[i + {k + 1}]' for k in mask)} AS seed FROM {rows}, unnest(range(0, len(t) - {dc.SPAN - 1})) AS r(i) WHERE len(t) >= {dc.SPAN}" for tag, mask in enumerate(dc.MASKS)
    )
    short = lambda rows, key, n: f"SELECT {key}, i AS at, 's' || array_to_string(t[i + 1 : i + {n}], chr(1)) AS seed FROM {rows}, unnest(range(0, len(t) - {n} + 1)) AS r(i) WHERE len(t) >= {n}"
    sizes = range(dc.MIN_TOKENS, dc.SPAN)
    bench_short = " UNION ALL ".join(short(f"(SELECT * FROM b WHERE len(t) = {n})", "item_id", n) for n in sizes)
    docs_short = " UNION ALL ".join(short(f"(SELECT * FROM d WHERE (SELECT count(*) FROM b WHERE len(t) = {n}) > 0)", "doc_id", n) for n in sizes)
    return f"""
    WITH b AS (SELECT min(item_id) AS item_id, t FROM (SELECT item_id, {tokens} AS t FROM benchmark) WHERE len(t) >= {dc.MIN_TOKENS} GROUP BY t),
    d AS (SELECT doc_id, {tokens} AS t FROM documents),
    bs AS ({seeds("b", "item_id")} UNION ALL {bench_short}), ds AS ({seeds("d", "doc_id")} UNION ALL {docs_short}),
    h AS (SELECT DISTINCT doc_id, item_id, ds.at - bs.at AS shift FROM ds JOIN bs USING (seed)),
    f AS (SELECT h.doc_id, h.item_id, len(b.t) AS n, least(len(b.t), {dc.WINDOW}) AS w,
                 list_transform(range(0, len(b.t)), lambda j: CASE WHEN h.shift + j >= 0 AND d.t[h.shift + j + 1] = b.t[j + 1] THEN 1 ELSE 0 END) AS f
          FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
    v AS (SELECT doc_id, item_id, list_sum(f) AS matched FROM f
          WHERE list_max(list_transform(range(0, n - w + 1), lambda s: list_sum(f[s + 1 : s + w]))) >= CASE WHEN n < {dc.SPAN} THEN w ELSE ceil(w * {dc.SHARE} - 1e-9) END),
    c AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, max(matched)::BIGINT AS max_matched FROM v GROUP BY 1)
    SELECT d.doc_id, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(max_matched, 0)::BIGINT AS max_matched, coalesce(n_items, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id)
    """


def op12() -> str:
    """All kept terms for all groups, then all pairs of groups of a language."""
    b, top = dv.BILLION, dv.TOP_TERMS
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), '{dv.UPPER}', '{dv.LOWER}'), '{dv.TERM}') AS words FROM documents),
    t AS (SELECT r, lang, source, unnest(words) AS term FROM d),
    kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {dv.MIN_DOCS}),
    g AS (SELECT DISTINCT lang, source FROM d),
    v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
    c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
    grid AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, v
             FROM g JOIN kept ON g.lang = kept.lang JOIN v ON v.lang = g.lang
             LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
    p AS (SELECT lang, source, term, n, 1 + {b}::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p,
                 sum(n) OVER (PARTITION BY lang, term) AS ln, sum(n) OVER (PARTITION BY lang) AS total, v FROM grid),
    pairs AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p)::BIGINT AS value
              FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
    every AS (SELECT x.lang, x.source, y.source AS item, coalesce(value, 0)::BIGINT AS value
              FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
              LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source),
    q AS (SELECT *, 1 + {b}::HUGEINT * (ln + 1) // (total + v) AS q FROM p),
    terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM q WHERE n > 0 AND p > q),
    u AS (SELECT lang, source, 'pair' AS part, item, value FROM every UNION ALL SELECT lang, source, 'term', item, value FROM terms),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u)
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {top}
    """
