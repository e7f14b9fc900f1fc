"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"


def _covered(name: str, words: int) -> str:
    """Words of each text in windows of ``words`` words found twice or more."""
    return f"""
grams_{name} AS (
    SELECT id, i, list_aggregate(w[i:i + {words - 1}], 'string_agg', ' ') AS gram
    FROM (SELECT id, w, unnest(range(1, len(w) - {words - 2})) AS i FROM words WHERE len(w) >= {words})),
again_{name} AS (
    SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, gram) AS n FROM grams_{name}) WHERE n > 1),
covered_{name} AS (
    SELECT id, count(DISTINCT j) AS n FROM (SELECT id, unnest(range(i, i + {words})) AS j FROM again_{name}) GROUP BY id)"""


QUALITY_RULES = rf"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
words AS (
    SELECT id, doc_id, t, list_filter(string_split_regex(t, '{_SPACE}'), lambda x: x <> '') AS w,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM texts),
{_covered('window', 5)},
{_covered('long', 20)},
{_covered('longest', 101)},
base AS (
    SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
           length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           coalesce(a.n, 0) AS n_repeat_words, coalesce(b.n, 0) AS n_long_words, coalesce(c.n, 0) AS n_over
    FROM words LEFT JOIN covered_window a USING (id) LEFT JOIN covered_long b USING (id)
    LEFT JOIN covered_longest c USING (id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
           AND 100 * n_long_words <= 15 * n_words AND n_over = 0 AS kept
FROM base"""


def _spans(kind: str, place: int, pattern: str, group: int = 0) -> str:
    """Matches of one kind with their places: lengths of the parts between
    matches and of the matches, summed up."""
    return f"""
    SELECT id, doc_id, owner, '{kind}' AS kind, {place} AS place, value, hit,
           sum(gap + hit) OVER (PARTITION BY id ORDER BY k) - hit AS a
    FROM (SELECT id, doc_id, owner, k, groups[k] AS value, length(gaps[k]) AS gap, length(hits[k]) AS hit
          FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k
                FROM (SELECT id, doc_id, owner, regexp_extract_all(t, '{pattern}', 0) AS hits,
                             regexp_extract_all(t, '{pattern}', {group}) AS groups,
                             string_split_regex(t, '{pattern}') AS gaps FROM texts)))"""


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_VENDOR = r"""\b(?:gh[opsur]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,})"""

SECRETS = f"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, source AS owner, coalesce(text, '') AS t FROM documents),
found AS ({_spans('assign', 1, _ASSIGN, 1)} UNION ALL {_spans('access', 2, 'AKIA[A-Z0-9]+')}
    UNION ALL {_spans('hex', 3, '[0-9a-f]+')} UNION ALL {_spans('vendor', 4, _VENDOR)}),
spans AS (
    SELECT id, kind, place, value, owner, doc_id, CAST(a AS BIGINT) AS a, CAST(a + hit AS BIGINT) AS b,
           kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + hit AS BIGINT) AS span
    FROM found WHERE length(value) >= CASE kind WHEN 'assign' THEN 8 WHEN 'access' THEN 16 WHEN 'hex' THEN 32 ELSE 1 END),
owners AS (
    SELECT value, count(DISTINCT coalesce(owner, '')) AS n_owners,
           count(DISTINCT coalesce(owner, '') || chr(0) || coalesce(CAST(doc_id AS VARCHAR), 'row ' || id)) AS n_repositories
    FROM spans GROUP BY value),
marked AS (
    SELECT s.*, n_owners, n_repositories, n_owners < 3 AND n_repositories < 10
           AND len(list_distinct(string_split(lower(s.value), ''))) >= 5
           AND NOT regexp_matches(lower(s.value), 'example|changeme|placeholder|your[_-]|dummy|xxxx|12345678') AS live
    FROM spans s JOIN owners o ON o.value = s.value),
grouped AS (
    SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
           count(*) FILTER (kind = 'hex') AS n_hex,
           string_agg(span, ',' ORDER BY a, place) FILTER (kind <> 'vendor') AS base,
           string_agg(span, ',' ORDER BY a, place) AS spans,
           string_agg(span || CASE WHEN live THEN ':live' ELSE ':example' END, ',' ORDER BY a, place) AS labels,
           count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_examples, max(n_owners) AS n_owners,
           max(n_repositories) AS n_repositories
    FROM marked GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_examples, 0) AS n_examples, coalesce(n_owners, 0) AS n_owners, coalesce(n_repositories, 0) AS n_repositories,
       coalesce(labels, '') AS labels
FROM texts LEFT JOIN grouped USING (id)"""


def _probability(count: str, total: str, kept: str) -> str:
    return f"(1 + (1000000000::HUGEINT * ({count} + 2)) // ({total} + 2 * {kept}))"


def _divergence(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) // ({p} + {q})"


DIVERGENCE = rf"""
WITH texts AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
found AS (
    SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM found GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL HAVING sum(docs) >= 10),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(c.n) AS n FROM counts c JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
    SELECT lang, source, coalesce(t.n, 0) AS n, v
    FROM (SELECT DISTINCT lang, source FROM texts) LEFT JOIN totals t USING (lang, source) LEFT JOIN sizes USING (lang)),
every AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_probability('coalesce(c.n, 0)', 'g.n', 'g.v')} AS p,
           {_probability('k.n', 's.n', 'g.v')} AS q
    FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang)
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
    SELECT a.lang, a.source, b.source AS item, sum({_divergence('a.p', 'b.p')}) AS value
    FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, {_divergence('p', 'q')} FROM every WHERE n > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10"""

FILL_MIDDLE = """
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
           sha256(concat('1:', CAST(doc_id AS VARCHAR))) AS h FROM documents),
numbers AS (
    SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
           CAST('0x' || h[17:24] AS BIGINT) % 100 AS rate, CAST('0x' || h[25:32] AS BIGINT) % 100 AS spm FROM texts),
cuts AS (
    SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR rate >= 90 THEN 'plain'
                WHEN spm < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (
    SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix
    FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM parts"""

MIXING = r"""
WITH rows AS (
    SELECT row_number() OVER () AS id, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
           md5(coalesce(text, '')) AS mark FROM documents),
sources AS (SELECT source, CAST(sum(size) AS HUGEINT) AS n FROM rows GROUP BY source),
weights AS (
    SELECT *, 3 * n AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, sum(n) OVER () AS everything
    FROM sources),
steps AS (
    SELECT *, sum(w) OVER () AS weight, coalesce(sum(cap) OVER earlier, 0) AS caps, coalesce(sum(w) OVER earlier, 0) AS ws
    FROM weights WINDOW earlier AS (ORDER BY (6 * cap) // w, source NULLS LAST
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, cap * (weight - ws) <= (everything - caps) * w AS full_up FROM steps),
shares AS (
    SELECT *, everything - coalesce(sum(cap) FILTER (full_up) OVER (), 0) AS rest,
           sum(w) FILTER (NOT full_up) OVER () AS others FROM capped),
targets AS (
    SELECT source, n, CASE WHEN full_up THEN CAST(cap AS DOUBLE) ELSE CAST(rest * w AS DOUBLE) / CAST(others AS DOUBLE) END AS target,
           CASE WHEN full_up THEN cap ELSE (rest * w) // others END AS goal FROM shares),
needs AS (SELECT *, CASE WHEN n > 0 THEN goal // n ELSE 0 END AS passes, CASE WHEN n > 0 THEN goal % n ELSE 0 END AS part FROM targets),
blocks AS (
    SELECT id, doc_id, source, size, mark, unnest(range(0, (size + 255) // 256)) AS block FROM rows),
placed AS (
    SELECT id, source, least(256, size - block * 256) AS words,
           coalesce(sum(least(256, size - block * 256)) OVER (
               PARTITION BY source ORDER BY substring(tag, 1, 15), doc_id NULLS FIRST, block, id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT *, md5(concat_ws('|', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), mark, CAST(block AS VARCHAR))) AS tag FROM blocks)),
drawn AS (
    SELECT id, sum(passes * words + greatest(0, least(words, part - before))) AS taken
    FROM placed p JOIN needs n ON p.source IS NOT DISTINCT FROM n.source GROUP BY id)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, target,
       CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM rows r JOIN needs s ON r.source IS NOT DISTINCT FROM s.source LEFT JOIN drawn USING (id)"""

ORACLE = {"op2_quality_rules": QUALITY_RULES, "op5_secrets": SECRETS, "op11_divergence": DIVERGENCE,
          "op12_fill_middle": FILL_MIDDLE, "op13_mixing": MIXING}
