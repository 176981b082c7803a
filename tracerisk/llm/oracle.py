"""DuckDB SQL with the same results as the queries of this folder."""

OP2_URL_FILTER = r"""
WITH cut AS (
    SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest
    FROM pages
), parts AS (
    SELECT row_number() OVER () AS n, page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
), rules(r_host, r_path, r_verdict) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
        ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
    SELECT n, max_by(r_host || r_path, length(r_host || r_path)) AS rule, max_by(r_verdict, length(r_host || r_path)) AS verdict
    FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
    GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (n)
"""

OP10_QUALITY_RULES = r"""
WITH docs AS (
    SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS text FROM documents
), split AS (
    SELECT n, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM docs
), windows AS (
    SELECT n, i, array_to_string(words[i:i + 4], ' ') AS w
    FROM (SELECT n, words, unnest(range(1, len(words) - 3)) AS i FROM split)
), twice AS (
    SELECT n, i FROM windows QUALIFY count(*) OVER (PARTITION BY n, w) > 1
), covered AS (
    SELECT n, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT n, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY n
), counted AS (
    SELECT n, doc_id, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM split LEFT JOIN covered USING (n)
), judged AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
), flagged AS (
    SELECT source, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats,
        10 * n_symbols > n_words AS symbols
    FROM judged WHERE source IS NOT NULL
), hosts AS (
    SELECT source, rule, count(*) AS n_docs, count(*) FILTER (failed) AS n_failed
    FROM (UNPIVOT flagged ON short, repeats, symbols INTO NAME rule VALUE failed) GROUP BY source, rule
), prior AS (
    SELECT rule, avg(n_failed / n_docs) AS m, coalesce(var_samp(n_failed / n_docs)
            - avg(n_failed / n_docs) * (1 - avg(n_failed / n_docs)) * avg(1 / n_docs), 0) AS v
    FROM hosts GROUP BY rule
), strength AS (
    SELECT rule, m, CASE WHEN v > 0 THEN least(1e6, greatest(1, m * (1 - m) / v - 1)) ELSE 1e6 END AS s FROM prior
), bad AS (
    SELECT DISTINCT source FROM hosts JOIN strength USING (rule)
    WHERE (n_failed + m * s) / (n_docs + s) > least(0.8, greatest(0.3, m + 3 * sqrt(m * (1 - m) / (s + 1))))
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND bad.source IS NULL AS kept
FROM judged LEFT JOIN bad ON bad.source = judged.source
"""

OP11_JACCARD_JOIN = r"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words
    FROM documents
), sets AS (
    SELECT d, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS s
    FROM docs
), tokens AS (
    SELECT d, len(s) AS n, unnest(s) AS t FROM sets
), links AS (
    SELECT x.d AS a, y.d AS b FROM tokens x JOIN tokens y ON x.t = y.t AND x.d != y.d
    GROUP BY x.d, y.d, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach(d, other) AS (
    SELECT d, d FROM sets UNION SELECT reach.d, b FROM reach JOIN links ON a = reach.other
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM sets s JOIN reach ON reach.d = s.d JOIN sets o ON o.d = reach.other
GROUP BY s.d, s.doc_id, s.s
"""

OP12_COLLOCATIONS = r"""
WITH pieces AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
    FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    )
), counted AS (
    SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f
    FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM pieces, range(1, 6) lengths(k))
    GROUP BY ALL
), totals AS (
    SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang
), often AS (
    SELECT * FROM counted WHERE f >= 100
), candidates AS (
    SELECT * FROM often s WHERE k > 1 AND NOT EXISTS (
        SELECT 1 FROM often t
        WHERE t.lang = s.lang AND t.k > s.k AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ')
            AND 100 * t.f >= 100 * s.f)
), cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, j, x.f AS l, y.f AS r, n,
        (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
    FROM (SELECT *, string_split(phrase, ' ') AS words, unnest(range(1, k)) AS j FROM candidates) c
    JOIN often x ON x.lang = c.lang AND x.phrase = array_to_string(words[1:j], ' ')
    JOIN often y ON y.lang = c.lang AND y.phrase = array_to_string(words[j + 1:], ' ')
    JOIN totals ON totals.lang = c.lang
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
    a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""

# Kind, pattern, group whose length counts, least length; in the order of the rules (fixed values).
SECRETS = [
    (
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    # Runs of at least so many characters: the same matches as runs of any length, less short ones.
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 0),
    ("hex", r"[0-9a-f]{24,}", 0, 0),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 0),
    ("cloud_key", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("payment", r"[sr]k_live_[A-Za-z0-9]{24,}", 0, 0),
    (
        "login_url",
        r"[a-z][a-z0-9+.-]{1,20}://[^\x09-\x0D\x20:/@]{1,200}:[^\x09-\x0D\x20/@]{1,200}@",
        0,
        0,
    ),
]


def _secrets() -> str:
    """A match starts after the texts between the earlier matches and those matches themselves."""
    kinds = []
    for i, (kind, pattern, group, least) in enumerate(SECRETS):
        p = "'" + pattern.replace("'", "''") + "'"
        kinds.append(f"""
    SELECT n, {i} AS k, '{kind}' AS kind, list_sum(between[1:j]) + coalesce(list_sum(sizes[1:j - 1]), 0) AS start,
        sizes[j] AS size
    FROM (
        SELECT n, list_transform(string_split_regex(text, {p}), lambda x: length(x)) AS between,
            list_transform(regexp_extract_all(text, {p}), lambda x: length(x)) AS sizes,
            list_transform(regexp_extract_all(text, {p}, {group}), lambda x: length(x)) AS counted,
            unnest(range(1, len(sizes) + 1)) AS j
        FROM docs WHERE {"contains(text, '://') AND " if "://" in pattern else ""}regexp_matches(text, {p})
    ) WHERE counted[j] >= {least}""")
    listed = "string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, k)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(kinds)}),
listed AS (
    SELECT n, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
        count(*) FILTER (k = 2) AS n_hex, {listed} FILTER (k < 3) AS base, {listed} AS spans
    FROM spans GROUP BY n
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (n)
"""


ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": OP2_URL_FILTER,
    "op8_secret_scan": _secrets(),
    "op10_quality_rules": OP10_QUALITY_RULES,
    "op11_jaccard_join": OP11_JACCARD_JOIN,
    "op12_collocations": OP12_COLLOCATIONS,
}
