"""DuckDB SQL for the queries of this subpackage that SQL can express.

Schedules and samples drawn by Spark's hash (op7), tokenizers (op5, op6) and stored media (op8) are tested against
plain Python instead.
"""

from __future__ import annotations

BLANK = r"[\x20\x09-\x0D]"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {WORDS} AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, p, list_slice(words, p, p + 2) AS window3 FROM (SELECT r, words, unnest(generate_series(1, len(words) - 2)) AS p FROM w WHERE len(words) > 2)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, window3) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(generate_series(p, p + 2)) AS q FROM twice) GROUP BY r),
rules AS (
  SELECT r, doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM rules),
hosts AS (SELECT source AS host, count(*) AS n, sum(base_failed::BIGINT) AS fails FROM base WHERE source IS NOT NULL GROUP BY source),
moments AS (SELECT least(greatest(sum(fails) / sum(n), 1e-6), 1 - 1e-6) AS mean, avg(1 / n) AS noise, var_pop(fails / n) AS spread FROM hosts),
own AS (SELECT mean, greatest(spread - mean * (1 - mean) * noise, 1e-6) AS v FROM moments),
prior AS (SELECT mean, least(greatest(mean * (1 - mean) / v - 1, 1.0), 1e6) AS weight FROM own),
rates AS (SELECT host, (fails + mean * weight) / (n + weight) AS host_rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(host_rate, 0) <= 0.8 AS kept, source, round(host_rate, 6) AS host_rate
FROM base LEFT JOIN rates ON source = host"""

ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first, sha1(html) AS hex FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""

LINES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {STRIP}), {UPPER}, {LOWER}) AS key FROM l),
frequent AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
kept AS (SELECT r, doc_id, count(*) AS n_lines, count(frequent.key) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (frequent.key IS NULL) AS text
  FROM k LEFT JOIN frequent USING (key) GROUP BY r, doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256 FROM kept"""

REPEATS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS words FROM documents),
g AS (SELECT r, doc_id, p, array_to_string(list_slice(words, p, p + 19), ' ') AS run FROM (SELECT *, unnest(generate_series(1, len(words) - 19)) AS p FROM d WHERE len(words) > 19)),
again AS (SELECT r, p FROM (SELECT r, p, rank() OVER (PARTITION BY run ORDER BY doc_id, p) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(generate_series(p, p + 19)) AS p FROM again),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d),
kept AS (SELECT r, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone.p IS NULL) AS text FROM w LEFT JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 2 THEN [words[1]]
  ELSE list_transform(generate_series(1, len(words) - 1), lambda k: words[k] || ' ' || words[k + 1]) END) AS shingles FROM d),
classes AS (SELECT min(doc_id) AS rep, list_sort(shingles) AS shingles FROM s WHERE len(shingles) > 0 GROUP BY list_sort(shingles)),
e AS (SELECT rep, len(shingles) AS n, unnest(shingles) AS shingle FROM classes),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY df, shingle) AS place FROM (SELECT *, count(*) OVER (PARTITION BY shingle) AS df FROM e)),
-- Sets of similarity 0.8 share one of each other's rarest n - ceil(0.8 n) + 1 shingles.
prefix AS (SELECT rep, n, shingle FROM ranked WHERE place <= n - (4 * n + 4) // 5 + 1),
pairs AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM prefix x JOIN prefix y USING (shingle) WHERE x.rep < y.rep AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n),
common AS (SELECT a, b, len(list_intersect(x.shingles, y.shingles)) AS c, len(x.shingles) AS na, len(y.shingles) AS nb FROM pairs JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b),
links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT rep, rep AS other FROM classes UNION SELECT reach.rep, ways.b FROM reach JOIN ways ON ways.a = reach.other),
components AS (SELECT rep, min(other) AS component_id FROM reach GROUP BY rep),
own AS (SELECT doc_id, len(shingles)::BIGINT AS n_shingles, list_sort(shingles) AS shingles FROM s)
SELECT doc_id, n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM own LEFT JOIN classes USING (shingles) LEFT JOIN components USING (rep)"""


def url_sql(rules: list[tuple[str, str]], words: tuple[str, ...], fan: int, levels: int = 6, z: float = 1.96, smoothing: float = 5.0, limit: float = 0.8) -> str:
    """The filter of op2: the rules, then the tree's levels one after the other; paths may have as many segments as there are levels."""
    fits = []
    for action, rule in sorted(rules, key=lambda r: -len(r[1])):
        host, _, rest = rule.partition("/")
        fits.append((f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{rest}')", rule, action))
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    general = r"regexp_replace(x, '[0-9A-Fa-f]{8,}(-[0-9A-Fa-f]+)*|[0-9]+', '#', 'g')"
    unwanted = f"regexp_matches(lower(host || '/' || path), '(^|[^a-z0-9])({'|'.join(words)})([^a-z0-9]|$)')"
    out = [
        "u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        "h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM u)",
        f"p AS (SELECT page_id, translate(raw_host, {UPPER}, {LOWER}) AS host, regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM h)",
        f"a AS (SELECT *, {case(1)} AS rule, {case(2)} AS action, list_filter(string_split(path, '/'), lambda x: x <> '') AS own FROM p)",
        f"b AS (SELECT *, CASE WHEN {unwanted} THEN true ELSE action = 'block' END AS bad, array_to_string(list_transform(own, lambda x: {general}), '/') AS raw FROM a)",
        "t0 AS (SELECT host, raw, string_split(raw, '/') AS segments, count(*) AS pages, count(bad) AS labelled, count(*) FILTER (bad) AS blocked FROM b GROUP BY host, raw)",
        "g AS (SELECT CASE WHEN sum(labelled) > 0 THEN sum(blocked) / sum(labelled) ELSE 0 END AS rate FROM t0)",
    ]
    for k in range(levels):
        out += [
            f"s{k} AS (SELECT *, array_to_string(list_slice(segments, 1, {k}), '/') AS up, segments[{k + 1}] AS seg FROM t{k})",
            f"n{k} AS (SELECT host, up, seg, sum(pages) AS n, sum(labelled) AS l, sum(blocked) AS b FROM s{k} WHERE seg IS NOT NULL GROUP BY host, up, seg)",
            f"m{k} AS (SELECT *, count(*) OVER w AS fan, sum(n) OVER w AS all_n, sum(l) OVER w AS all_l, sum(b) OVER w AS all_b FROM n{k} WINDOW w AS (PARTITION BY host, up))",
            f"v{k} AS (SELECT host, up, seg, l, count(*) FILTER (l > 0 AND fan >= {fan} AND all_n <= fan * fan) OVER (PARTITION BY host, up) > 1 AS shared FROM m{k} WHERE fan > 1 AND CASE WHEN l = 0 OR all_l = l OR all_b = 0 OR all_b = all_l THEN true "
            f"ELSE (b / l - (all_b - b) / (all_l - l)) ** 2 < {z * z!r} * ((all_b / all_l) * (1 - all_b / all_l) * (1 / l + 1 / (all_l - l))) END)",
            f"j{k} AS (SELECT host, up, seg, CASE WHEN l = 0 AND NOT shared THEN '?' ELSE '*' END AS merged FROM v{k})",
            f"t{k + 1} AS (SELECT host, raw, CASE WHEN merged IS NULL THEN segments ELSE list_concat(list_append(list_slice(segments, 1, {k}), merged), list_slice(segments, {k + 2}, len(segments))) END AS segments, pages, labelled, blocked "
            f"FROM s{k} LEFT JOIN j{k} USING (host, up, seg))",
        ]
    out += [
        f"t AS (SELECT host, raw, '/' || array_to_string(segments, '/') AS template, labelled, blocked FROM t{levels})",
        f"q AS (SELECT host, template, (sum(blocked) + {smoothing} * any_value(rate)) / (sum(labelled) + {smoothing}) AS purity, sum(labelled) > 0 AS known FROM t, g GROUP BY host, template)",
    ]
    verdict = f"coalesce(action, CASE WHEN known AND purity >= {limit} THEN 'block' ELSE 'allow' END) AS verdict"
    return "WITH " + ",\n".join(out) + f"\nSELECT page_id, host, path, rule, {verdict}, template, round(purity, 6) AS purity FROM b JOIN t USING (host, raw) JOIN q USING (host, template)"
