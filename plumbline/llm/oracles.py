"""DuckDB SQL that the queries of this package must agree with, where SQL can express them."""

from __future__ import annotations


def _either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_WORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = rf"""({_WORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SCOPE = 200
# Parts told by their names: what may stand before a name, the names, and the value.
_NAMED = r"""(?i)[^A-Za-z0-9](?:[a-z0-9]{{1,40}}[_.-]){{0,4}}(?:{})["'']?\x20*[:=]\x20*["'']?{}"""
_NAME = _NAMED.format(
    r"(?:client|app|application|tenant|consumer|user|account|login)[_-]?(?:id|name)|user|login|account",
    r"[A-Za-z0-9@+_.-]{3,}",
)
_VALUE = _NAMED.format(
    r"(?:secret|access|secret[_-]?access|account|client|private|signing|auth|consumer|storage)"
    r"[_-]?key|passphrase|pass|pwd",
    r"[A-Za-z0-9+/_.~!@#$%^&*=-]{8,}",
)
_HOST = _NAMED.format(r"host(?:[_-]?name)?|server|endpoint", r"[A-Za-z0-9_.:-]{3,}")
# A random token ends a run of these characters; before it stand the run's start or a "=".
_RUN = "[A-Za-z0-9/+=_-]{40,}"
_RANDOM = "^(?:[A-Za-z0-9/+=_-]*=)?([A-Za-z0-9/+]{40}={0,2})$"


def _named(kind: int, pattern: str) -> str:
    """Matches in the text with a line break before it: they begin with the character
    before the name, so their start there is the name's start in the text itself."""
    return f"""
        SELECT doc_id, kind, start, fin - 1 AS fin
        FROM ({_matches(kind, pattern, 0, "true", "broken")})"""


def _random() -> str:
    return f"""
        SELECT doc_id, kind, fin - length(regexp_extract(hit, '{_RANDOM}', 1)) AS start, fin
        FROM ({_matches(4, _RUN, 0, f"regexp_matches(hit, '{_RANDOM}')", "known", "hit, ")})"""


def _matches(kind: int, pattern: str, group: int, test: str, source: str = "d", also: str = "") -> str:
    """Positions as sums of the lengths of what lies between matches and of the matches."""
    return f"""
        SELECT {also}doc_id, {kind} AS kind, s AS start, s + length(hit) AS fin FROM (
            SELECT doc_id, hits[i] AS hit, measured[i] AS m,
                list_sum(list_transform(between[1:i], lambda x: length(x)))
                    + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s
            FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS between,
                    regexp_extract_all(t, '{pattern}') AS hits,
                    regexp_extract_all(t, '{pattern}', {group}) AS measured,
                    unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) AS i
                  FROM {source}))
        WHERE {test}"""


SECRETS = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    base AS ({_matches(0, _ASSIGN, 2, "length(m) >= 6")}
        UNION ALL {_matches(1, "AKIA[A-Z0-9]+", 0, "length(m) >= 20")}
        UNION ALL {_matches(2, "[0-9a-f]{24,}", 0, "true")}),
    known AS (SELECT * FROM d WHERE regexp_matches(
            t, 'AKIA[A-Z0-9]{{16}}|\\b(?:ASIA|AROA|AIDA|AGPA)[A-Z0-9]{{16}}\\b')
        OR regexp_matches(chr(10) || t, '{_NAME}')),
    broken AS (SELECT doc_id, chr(10) || t AS t FROM known),
    weak AS ({_matches(3, r"\b(?:ASIA|AROA|AIDA|AGPA)[A-Z0-9]{16}\b", 0, "true", "known")}
        UNION ALL {_random()}
        UNION ALL {_named(6, _NAME)} UNION ALL {_named(7, _VALUE)} UNION ALL {_named(8, _HOST)}
        UNION ALL {_matches(5, r'''\b[a-z][a-z0-9+]{1,9}://[^\x00-\x20"''<>]+''', 0, "true", "known")}),
    parts AS (
        SELECT *, CASE WHEN kind IN (1, 3, 6) THEN 'identifier' WHEN kind IN (5, 8) THEN 'endpoint'
            ELSE 'secret' END AS role FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)),
    linked AS (
        SELECT w.doc_id, w.kind, w.start, w.fin FROM parts w JOIN parts p
        ON w.doc_id = p.doc_id AND p.role <> w.role AND p.start <= w.fin + {_SCOPE}
            AND w.start <= p.fin + {_SCOPE}
        WHERE w.kind >= 3 AND NOT EXISTS (
            SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.start < w.fin AND w.start < b.fin)
        GROUP BY ALL
        HAVING CASE WHEN w.kind IN (3, 6) THEN bool_or(p.role = 'secret')
            WHEN w.kind IN (4, 7) THEN bool_or(p.role = 'identifier')
            ELSE bool_or(p.role = 'secret') AND bool_or(p.role = 'identifier') END),
    named AS (
        SELECT *, ['assign', 'access', 'hex', 'identifier', 'random', 'endpoint', 'name', 'value',
            'host'][kind + 1]
            || ':' || start::BIGINT || ':' || fin::BIGINT AS name
        FROM (SELECT *, true AS base FROM base UNION ALL SELECT *, false FROM linked)),
    listed AS (
        SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS b,
            count(*) FILTER (WHERE kind = 2) AS c,
            string_agg(name, ',' ORDER BY start, kind) FILTER (WHERE base) AS own,
            string_agg(name, ',' ORDER BY start, kind) AS every
        FROM named GROUP BY doc_id)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access,
        coalesce(c, 0) AS n_hex, sha256(coalesce(own, '')) AS base_sha256,
        coalesce(every, '') AS spans
    FROM documents LEFT JOIN listed USING (doc_id)"""

ORACLE = {"op9_secret_scans": SECRETS}
