"""Comparison SQL of the operators that SQL can express in full."""

from __future__ import annotations

_GAP, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
tri AS (SELECT r, i, concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2]) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, source, t, len(regexp_extract_all(x, '{_WORD}')) AS n,
                 translate(trim(regexp_replace(x, '{_GAP}', ' ', 'g'), ' '), '{_UPPER}', '{_LOWER}') AS line
          FROM (SELECT r, source, t, unnest(ls) AS x FROM w)),
hosts AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY source),
often AS (SELECT l.source, line FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
          GROUP BY l.source, line HAVING count(DISTINCT t) > 20 AND count(DISTINCT t) > 0.05 * max(h.n)),
lost AS (SELECT r, sum(n) AS n FROM lines l JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.line = o.line GROUP BY r),
counted AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_GAP}', '', 'g')) AS BIGINT) AS word_chars,
                   CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                   CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_words
            FROM w LEFT JOIN covered c USING (r) LEFT JOIN lost USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT *, NOT base_failed AND n_removed_words <= 0.5 * n_words AS kept FROM judged
"""


def _matches(kind: str, pattern: str, keep: str, group: int = 0) -> str:
    """(r, kind, s, e, n): where a pattern matches, from the lengths of matches and of the gaps between them."""
    return f"""
SELECT r, '{kind}' AS pattern, list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) AS s,
       list_sum(gaps[1:i]) + list_sum(sizes[1:i]) AS e, inner_sizes[i] AS n
FROM (SELECT r, gaps, sizes, inner_sizes, unnest(range(1, len(sizes) + 1)) AS i FROM (
  SELECT r, list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS gaps,
         list_transform(regexp_extract_all(t, '{pattern}'), lambda x: length(x)) AS sizes,
         list_transform(regexp_extract_all(t, '{pattern}', {group}), lambda x: length(x)) AS inner_sizes FROM d)) WHERE {keep}"""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + f"|{_either('api')}_?{_either('key')}"
_ASSIGN = rf"(?:{_KEYWORDS})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
_ENDPOINT = r"https?://[^\x20\x09-\x0D\"''<>]+"


def _near(role: str) -> str:
    return (
        f"EXISTS (SELECT 1 FROM parts q WHERE q.r = p.r AND q.role = '{role}' AND (q.s, q.kind) <> (p.s, p.kind)"
        " AND CASE WHEN (q.s, q.kind) < (p.s, p.kind) THEN p.s - q.e <= 300 ELSE q.s - p.e <= 300 END)"
    )


SECRET_SCAN = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_matches('assign', _ASSIGN, 'n >= 6', 1)}
UNION ALL {_matches('access', 'AKIA[A-Z0-9]{8,}', 'true')}
UNION ALL {_matches('hex', '[0-9a-f]{16,}', 'true')}
UNION ALL {_matches('endpoint', _ENDPOINT, 'true')}),
parts AS (SELECT r, s, e, CASE WHEN pattern = 'assign' AND n < 12 THEN 'weak_secret' WHEN pattern = 'access' AND n < 18 THEN 'weak_access' ELSE pattern END AS kind,
                 CASE pattern WHEN 'access' THEN 'id' WHEN 'endpoint' THEN 'endpoint' ELSE 'secret' END AS role FROM found),
spans AS (SELECT r, s, list_position(['assign', 'access', 'hex', 'weak_access', 'weak_secret', 'endpoint'], kind) AS k, kind, concat(kind, ':', s, ':', e) AS span
          FROM parts p WHERE kind IN ('assign', 'access', 'hex') OR (kind = 'weak_access' AND {_near('secret')} AND {_near('endpoint')})
             OR (kind = 'weak_secret' AND {_near('id')} AND {_near('endpoint')}) OR (kind = 'endpoint' AND {_near('id')} AND {_near('secret')}))
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
       count(*) FILTER (WHERE kind = 'hex') AS n_hex, sha256(coalesce(string_agg(span, ',' ORDER BY s, k) FILTER (WHERE k <= 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY s, k), '') AS spans
FROM d LEFT JOIN spans USING (r) GROUP BY r
"""
