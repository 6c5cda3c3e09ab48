"""DuckDB SQL that each bound query must agree with.

Written from the meaning of the operators, with plain joins and windows where the
Spark side uses aggregates, fingerprints or key runs.
"""

from __future__ import annotations

_TABLES = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6,
    "lineitem": 11, "events": 6, "documents": 5, "embeddings": 3, "pages": 3,
    "benchmark": 2, "labels": 3, "conversations": 4,
}
_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"],
    "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"],
    "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"],
    "benchmark": ["item_id"], "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}
_LINKS = [
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("events", "user_id", "customer", "c_custkey"),
    ("orders", "o_orderkey", "lineitem", "l_orderkey"),
]
_LIMITS = {"int": 2147483647, "bigint": 9223372036854775807}
_INT_KEYS = {"r_regionkey", "n_nationkey", "l_linenumber"}


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _capacity(label: str, table: str, column: str, cap: int, seed: str = "mn") -> str:
    used = f"(mx::DOUBLE - {seed} + 1) * 100.0 / ({cap}::DOUBLE - {seed} + 1)"
    return f"""
        SELECT '{label}' AS table_name, '{column}' AS "column", mn AS min_value,
               mx AS max_value, {cap}::BIGINT AS cap,
               round_even({used}, 1) AS used_pct,
               CASE WHEN round_even({used}, 1) >= 90 THEN 'CRITICAL'
                    WHEN round_even({used}, 1) >= 70 THEN 'WARNING' ELSE '' END AS flag
        FROM (SELECT min({column})::BIGINT AS mn, max({column})::BIGINT AS mx
              FROM {table})"""


def _all_capacities() -> str:
    parts = [
        _capacity("orders", "orders", "o_orderkey", _LIMITS["bigint"]),
        _capacity("orders_16000", "orders", "o_orderkey", 16000),
        _capacity("orders_20000", "orders", "o_orderkey", 20000, "1"),
    ]
    for table, columns in _KEYS.items():
        if table != "orders":
            for column in columns:
                kind = "int" if column in _INT_KEYS else "bigint"
                parts.append(_capacity(table, table, column, _LIMITS[kind]))
    return _union(parts)


def _summary() -> str:
    facts = []
    for table in _TABLES:
        key = _KEYS.get(table)
        if key is None:
            facts.append(
                f"SELECT '{table}' AS t, count(*) AS n, true AS bad, false AS nk FROM {table}"
            )
            continue
        missing = " OR ".join(f"{c} IS NULL" for c in key)
        facts.append(
            f"SELECT '{table}' AS t, (SELECT count(*) FROM {table}) AS n, "
            f"(SELECT count(*) FROM {table}) <> (SELECT count(*) FROM "
            f"(SELECT DISTINCT {', '.join(key)} FROM {table})) AS bad, "
            f"EXISTS (SELECT 1 FROM {table} WHERE {missing}) AS nk"
        )
    return f"""
        WITH facts AS ({_union(facts)}),
        ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, t) AS r FROM facts)
        SELECT 'table_count' AS metric, count(*)::BIGINT AS value FROM facts
        UNION ALL SELECT 'total_rows', sum(n)::BIGINT FROM facts
        UNION ALL SELECT 'tables_without_unique_key',
            count(*) FILTER (WHERE bad OR nk)::BIGINT FROM facts
        UNION ALL SELECT 'tables_with_null_keys', count(*) FILTER (WHERE nk)::BIGINT FROM facts
        UNION ALL SELECT 'rows:' || t, n FROM ranked WHERE r <= 10"""


def _missing() -> str:
    return _union(
        [
            f"""SELECT '{child}->{parent}' AS link,
                (SELECT count({ck}) FROM {child}) AS child_rows,
                count(*) AS child_keys,
                count(*) FILTER (WHERE p IS NULL) AS orphan_keys,
                round((count(*) - count(*) FILTER (WHERE p IS NULL)) / count(*), 4) AS coverage
            FROM (SELECT DISTINCT {ck} AS c FROM {child} WHERE {ck} IS NOT NULL)
            LEFT JOIN (SELECT DISTINCT {pk} AS p FROM {parent}) ON c = p"""
            for child, ck, parent, pk in _LINKS
        ]
    )


def _candidates() -> str:
    """Columns named like another table's key, each against that key."""
    links = [
        ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        ("nation", "n_regionkey", "region", "r_regionkey"),
        ("orders", "o_custkey", "customer", "c_custkey"),
        ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ]
    return _union(
        [
            f"""SELECT '{child}.{ck}' AS link, sum(n)::BIGINT AS child_rows,
                count(*) AS child_keys, count(*) FILTER (WHERE NOT known) AS orphan_keys,
                round(count(*) FILTER (WHERE known) / count(*), 4) AS coverage
            FROM (SELECT {ck}, count(*) AS n, {ck} IN (SELECT {pk} FROM {parent}) AS known
                  FROM {child} GROUP BY {ck})"""
            for child, ck, parent, pk in links
        ]
    )


_LAYOUT = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linestatus"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus"],
    "events": ["event_id", "user_id"],
}
_FEW_VALUES = {
    "lineitem": ["l_linestatus", "l_returnflag", "l_linenumber"],
    "orders": ["o_orderstatus"],
    "events": ["event_type"],
}


def _layout(columns: dict[str, list[str]]) -> str:
    return _union(
        [
            f"""SELECT '{table}' AS table_name, '{c}' AS "column", count(*) AS ndv,
                round(count(*) / sum(n), 4) AS ndv_ratio,
                round(max(n) / sum(n), 4) AS top_share
            FROM (SELECT {c}, count(*) AS n FROM {table} GROUP BY {c})"""
            for table, names in columns.items()
            for c in names
        ]
    )


def _schema_rows(table: str, columns: list[tuple[str, str]], key: str) -> str:
    return _union(
        [
            f"""SELECT {i} AS ordinal, '{c}' AS "column", '{kind}' AS type,
                true AS nullable, count(*) - count({c}) AS nulls,
                count(DISTINCT {c}) AS distinct_count,
                count(DISTINCT {c}) = count(*) AS is_unique, {c == key} AS is_key
            FROM {table}"""
            for i, (c, kind) in enumerate(columns, start=1)
        ]
    )


def _column_diff() -> str:
    shared = {"name": "string", "nationkey": "int", "acctbal": "double"}
    parts = [
        f"""SELECT '{c}' AS "column", '{kind}' AS type_1, '{kind}' AS type_2,
            (SELECT count(*) - count(c_{c}) FROM customer) AS nulls_1,
            (SELECT count(*) - count(s_{c}) FROM supplier) AS nulls_2,
            (SELECT count(DISTINCT c_{c}) FROM customer) AS ndv_1,
            (SELECT count(DISTINCT s_{c}) FROM supplier) AS ndv_2, 'same' AS status"""
        for c, kind in shared.items()
    ]
    for c, kind in (("custkey", "bigint"), ("mktsegment", "string")):
        parts.append(
            f"""SELECT '{c}', '{kind}', NULL, count(*) - count(c_{c}), NULL,
                count(DISTINCT c_{c}), NULL, 'only_1' FROM customer"""
        )
    parts.append(
        """SELECT 'suppkey', NULL, 'bigint', NULL, count(*) - count(s_suppkey), NULL,
            count(DISTINCT s_suppkey), 'only_2' FROM supplier"""
    )
    return _union(parts)


def _profile() -> str:
    labelled = "(SELECT d.*, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))"

    def row(column: str, length: str, average: str, oversized: str) -> str:
        return f"""SELECT '{column}' AS "column", count(*) AS total,
            count({column}) AS non_null, count(*) - count({column}) AS nulls,
            round_even((count(*) - count({column})) * 100.0 / count(*), 1) AS null_pct,
            count(DISTINCT {column}) AS distinct_count,
            min({column})::VARCHAR AS min_value, max({column})::VARCHAR AS max_value,
            {length} AS max_len, {average} AS avg_len, {oversized} AS oversized
        FROM {labelled}"""

    def lengths(column: str, declared: int) -> tuple[str, str, str]:
        size = f"length(rtrim({column}, ' '))"
        return (
            f"max({size})::INTEGER",
            f"round(avg({size}), 1)",
            f"max({size}) < {declared // 2}",
        )

    return _union(
        [
            row("quality", "NULL::INTEGER", "NULL::DOUBLE", "false"),
            row("text", *lengths("text", 40000)),
            row("lang", *lengths("lang", 8)),
        ]
    )


def _name_flags(columns: bool = False) -> str:
    # Name parts that repeat the type of a thing or its version.
    prefixed = " OR ".join(
        f"starts_with(lower(name), '{p}')"
        for p in ("tbl_", "sp_", "vw_", "col_", "f_", "fn_", "usp_")
    )
    versioned = " OR ".join(
        f"ends_with(lower(name), '{s}')"
        for s in ("_v2", "_v3", "_v4", "_v5", "_final", "_old", "_backup", "_copy",
                  "_new", "_temp", "_bak")
    )
    return f"""
        WITH names AS (
            SELECT n_name AS name FROM nation UNION SELECT r_name FROM region
            UNION SELECT p_name FROM part UNION SELECT o_orderpriority FROM orders),
        flags AS (
            SELECT name, ({prefixed}) AS type_prefix, ({versioned}) AS version_suffix,
                name = upper(name) AND length(name) > 1 AS all_caps,
                contains(name, '_') AND ({columns} OR NOT ({prefixed})) AS underscore
            FROM names)"""


_NAME_RULES = ("type_prefix", "version_suffix", "all_caps", "underscore")
_COLUMN_RULES = ("type_prefix", "all_caps", "underscore")

_DOC_FLAGS = """
    SELECT doc_id,
        (length(text) - length(replace(text, chr(10), '')) + 1)::INTEGER AS lines,
        contains(upper(text), 'LICENSE') OR contains(upper(text), 'LICENCE') AS has_license,
        contains(text, '@') AS has_contact,
        contains(upper(text), 'TOKEN') OR contains(upper(text), 'PASSWORD')
            OR contains(upper(text), 'API_KEY') AS has_secret
    FROM documents"""

_MENTIONS = """
    SELECT item_id, doc_id FROM documents d JOIN benchmark b
    ON contains(lower(d.text), lower(b.text))"""

_ACTIVITY = """
    SELECT user_id,
        count(*) FILTER (WHERE event_type IN ('view', 'click')) AS reads,
        count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS writes,
        max(ts) FILTER (WHERE event_type IN ('view', 'click')) AS last_read,
        max(ts) FILTER (WHERE event_type IN ('purchase', 'signup')) AS last_write
    FROM events GROUP BY user_id"""

_LANDING = """
    names AS (
        SELECT DISTINCT event_type || '_' || strftime(ts, '%Y%m%d_%H%M%S') AS name FROM events
        UNION SELECT 'view' UNION SELECT 'audit' UNION SELECT 'x_20241399_999999'),
    snaps AS (
        SELECT name, left(name, length(name) - 16) AS base,
            try_strptime(right(name, 15), '%Y%m%d_%H%M%S') AS taken
        FROM names WHERE regexp_matches(name, '_[0-9]{8}_[0-9]{6}$')),
    plain AS (
        SELECT name FROM names WHERE NOT regexp_matches(name, '_[0-9]{8}_[0-9]{6}$'))"""

_DRIFT = """
    WITH cols AS (
        SELECT user_id::VARCHAR AS feed, ts::DATE AS snapshot,
            event_type || '_' || (hour(ts) // 6)::VARCHAR AS "column",
            floor(value / 20)::BIGINT AS band
        FROM events),
    newest AS (SELECT feed, max(snapshot) AS newest FROM cols GROUP BY feed),
    n AS (
        SELECT feed, "column", 'band' || max(band)::VARCHAR AS type
        FROM cols JOIN newest USING (feed) WHERE snapshot = newest GROUP BY ALL),
    p AS (
        SELECT feed, "column", 'band' || max(band)::VARCHAR AS type
        FROM cols JOIN newest USING (feed) WHERE snapshot < newest GROUP BY ALL),
    drift AS (
        SELECT feed, "column", n.type AS newest_type, p.type AS permanent_type,
            CASE WHEN p.type IS NULL THEN 'only_newest'
                 WHEN n.type IS NULL THEN 'only_permanent'
                 WHEN n.type = p.type THEN 'identical' ELSE 'mismatch' END AS status
        FROM n FULL JOIN p USING (feed, "column"))"""

_HALVES = """
    SELECT coalesce(a.k, b.k) AS o_custkey,
        CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b'
             ELSE 'both' END AS status
    FROM (SELECT DISTINCT o_custkey AS k FROM orders
          WHERE o_orderdate < TIMESTAMP '1998-04-16') a
    FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders
          WHERE o_orderdate >= TIMESTAMP '1998-04-16') b ON a.k = b.k"""


def _clip(text: str, limit: int, keep: int) -> str:
    return (
        f"CASE WHEN length({text}) > {limit} THEN left({text}, {keep}) || '...' "
        f"ELSE {text} END"
    )


def _cost(table: str, key: str, cost: str, measure: str, at: str, text: str) -> str:
    return f"""
        WITH log AS (
            SELECT {key} AS k, ({cost})::DECIMAL(18,2) AS c, ({measure})::DECIMAL(18,2) AS m,
                {at} AS run_time, {text} AS txt FROM {table}),
        agg AS (
            SELECT k, count(*) AS n, sum(c) AS c, sum(m) AS m, max(run_time) AS last_run
            FROM log GROUP BY k)
        SELECT k AS {key}, n AS executions, c::DOUBLE AS total_cost,
            round(c::DOUBLE / n, 4) AS avg_cost, m::DOUBLE AS total_measure,
            round(m::DOUBLE / n, 4) AS avg_measure, last_run,
            (SELECT max({_clip("trim(txt, ' ')", 200, 197)}) FROM log
             WHERE log.k = agg.k AND log.run_time = agg.last_run) AS preview
        FROM agg ORDER BY c DESC, k LIMIT 20"""


def _sizes(group: str) -> str:
    return f"""
        SELECT {group}, rows, bytes, CASE
            WHEN bytes // 1024 >= 1048576
                THEN round((bytes // 1024) / 1048576, 1)::DECIMAL(20,1)::VARCHAR || ' GB'
            WHEN bytes // 1024 >= 1024
                THEN round((bytes // 1024) / 1024, 1)::DECIMAL(20,1)::VARCHAR || ' MB'
            ELSE (bytes // 1024)::VARCHAR || ' KB' END AS label, is_total
        FROM (
            SELECT {group}, count(*) AS rows, sum(strlen(text))::BIGINT AS bytes,
                grouping({group}) = 1 AS is_total
            FROM documents GROUP BY ROLLUP ({group}))"""


def _share(table: str, key: str, measure: str, where: str) -> str:
    return f"""
        SELECT {key}, s::DOUBLE AS total, n AS events,
            round(s::DOUBLE * 100 / nullif(sum(s) OVER ()::DOUBLE, 0), 2) AS pct_total
        FROM (SELECT {key}, sum({measure}::DECIMAL(18,2)) AS s, count(*) AS n
              FROM {table} WHERE {where} GROUP BY {key})
        ORDER BY s DESC, {key} LIMIT 20"""


_TOKENS = """
    SELECT conv_id, role, lower(text) AS text,
        length(text) - length(replace(text, chr(10), '')) + 1 AS lines
    FROM conversations WHERE role IN ('user', 'assistant')"""

ORACLE: dict[str, str] = {
    "table_inventory": _union(
        [
            f"SELECT '{t}' AS table_name, count(*) AS row_count, {n}::INTEGER AS column_count FROM {t}"
            for t, n in _TABLES.items()
        ]
    ),
    "inventory_from_footers": _union(
        [
            f"SELECT '{t}' AS table_name, count(*) AS row_count, {n}::INTEGER AS column_count FROM {t}"
            for t, n in _TABLES.items()
        ]
    ),
    "bounds_from_footers": _union(
        [
            f"""SELECT '{c}' AS "column", count(*) AS row_count, min({c})::BIGINT AS min_value,
                max({c})::BIGINT AS max_value FROM {t}"""
            for t, names in _KEYS.items()
            for c in names
        ]
    ),
    "object_listing": """
        SELECT * FROM (
            SELECT 'region' AS object_type, r_name AS name FROM region
            UNION ALL SELECT 'nation', n_name FROM nation
            UNION ALL SELECT 'supplier', s_name FROM supplier
            UNION ALL SELECT 'customer', c_name FROM customer)
        WHERE contains(name, '1')""",
    "sample_rows": f"""
        SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey,
            {_clip('o_orderstatus', 30, 27)} AS o_orderstatus,
            o_totalprice::VARCHAR AS o_totalprice, o_orderdate::VARCHAR AS o_orderdate,
            {_clip('o_orderpriority', 30, 27)} AS o_orderpriority
        FROM orders ORDER BY orders.o_orderkey LIMIT 20""",
    "sample_texts": f"""
        SELECT doc_id::VARCHAR AS doc_id, {_clip('text', 30, 27)} AS text, lang
        FROM documents ORDER BY documents.doc_id LIMIT 100""",
    "lookup_by_name": "SELECT doc_id, text FROM documents WHERE doc_id = 42",
    "lookup_by_name_and_kind": """
        SELECT * FROM part WHERE p_name = 'small ring' AND p_type = 'ECONOMY'""",
    "lookup_page": """
        SELECT * FROM pages WHERE url = 'https://m.ththth.example.net/en/25#top'""",
    "lookup_in_sorted_files": """
        SELECT * FROM pages WHERE url = 'https://m.ththth.example.net/en/25#top'""",
    "search_text": """
        SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license')""",
    "external_references": """
        SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target
        FROM pages""",
    "keyword_guard": r"""
        SELECT doc_id, nullif(w, '') AS first_word, w <> '' AS blocked
        FROM (SELECT doc_id, regexp_extract(text,
            '(?i)\b(license|licensed|released|token)\b', 1) AS w FROM documents)""",
    "text_complexity": f"""
        SELECT *, lines > 50 OR has_secret AS review FROM ({_DOC_FLAGS})""",
    "text_complexity_totals": f"""
        SELECT count(*) AS total, count(*) FILTER (WHERE lines > 50 OR has_secret) AS flagged
        FROM ({_DOC_FLAGS})""",
    "page_complexity": """
        SELECT *, lines > 20 OR has_table AS review FROM (
            SELECT page_id,
                (length(html) - length(replace(html, chr(10), '')) + 1)::INTEGER AS lines,
                contains(lower(html), '<script') AS has_script,
                contains(lower(html), '<table') OR contains(lower(html), '<td') AS has_table,
                contains(lower(html), 'href=') AS has_link
            FROM pages)""",
    "name_lint": _name_flags()
    + _union([f"SELECT '{r}' AS rule, name FROM flags WHERE {r}" for r in _NAME_RULES]),
    "column_name_lint": _name_flags(columns=True)
    + _union([f"SELECT '{r}' AS rule, name FROM flags WHERE {r}" for r in _COLUMN_RULES]),
    "column_name_lint_counts": _name_flags(columns=True)
    + _union(
        [
            f"SELECT '{r}' AS rule, count(*) FILTER (WHERE {r}) AS names FROM flags"
            for r in _COLUMN_RULES
        ]
    ),
    "name_lint_counts": _name_flags()
    + _union(
        [
            f"SELECT '{r}' AS rule, count(*) FILTER (WHERE {r}) AS names FROM flags"
            for r in _NAME_RULES
        ]
    ),
    "recent_changes": """
        SELECT user_id, created, modified,
            modified - created < INTERVAL 120 SECONDS AS is_new
        FROM (SELECT user_id, min(ts) AS created, max(ts) AS modified FROM events GROUP BY user_id)
        WHERE modified >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
    "recent_failures": """
        SELECT c_name, o_orderkey, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE o_orderstatus = 'F' AND o_orderdate >=
            date_trunc('day', (SELECT max(o_orderdate) FROM orders)) - INTERVAL 7 DAYS""",
    "run_history": """
        SELECT o_orderkey, o_orderdate AS run_at,
            CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'Succeeded'
                ELSE '4' END AS status_label,
            o_orderkey % 24 * 3600 + o_orderkey % 60 * 60 AS duration_seconds
        FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE c_name = 'Customer#000000605'
        ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""",
    "missing_references": _missing(),
    "unreferenced_customers": """
        SELECT c_custkey FROM customer
        WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)""",
    "unreferenced_orders": """
        SELECT o_orderkey FROM orders
        WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "find_references": _MENTIONS,
    "mention_report": f"""
        WITH m AS ({_MENTIONS})
        SELECT doc_id,
            (length(text) - length(replace(text, chr(10), '')) + 1)::INTEGER AS lines,
            coalesce(items, '') AS items,
            items IS NOT NULL
                OR length(text) - length(replace(text, chr(10), '')) + 1 > 50 AS is_complex
        FROM documents LEFT JOIN (
            SELECT doc_id, string_agg(item_id::VARCHAR, ', ' ORDER BY item_id::VARCHAR) AS items
            FROM m GROUP BY doc_id) USING (doc_id)""",
    "grant_listing": """
        SELECT n_name, c_name, c_mktsegment, o_orderkey, o_orderstatus
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey
        WHERE n_name NOT IN ('NATION_0') AND c_mktsegment NOT IN ('BUILDING')""",
    "annotate_rows": """
        SELECT d.doc_id, quality, toxic, l.doc_id IS NOT NULL AS annotated
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
        WHERE contains(lower(lang), 'en') OR contains(lower(source), 'en')""",
    "annotate_from_json": """
        SELECT d.doc_id, l.doc_id IS NOT NULL AS annotated,
            'Document ' || l.doc_id AS object_name, 'quality ' || quality AS description
        FROM documents d LEFT JOIN (
            SELECT * FROM labels WHERE starts_with(doc_id::VARCHAR, '1')) l
        ON d.doc_id = l.doc_id""",
    "prefix_covered_lists": """
        WITH lists AS (
            SELECT user_id, ts::DATE AS day,
                list(event_type ORDER BY ts, event_id) AS items FROM events GROUP BY ALL)
        SELECT a.user_id, a.day AS covered_day, min(b.day) AS covering_day,
            count(*) AS coverers
        FROM lists a JOIN lists b ON a.user_id = b.user_id
        WHERE len(a.items) < len(b.items) AND b.items[1:len(a.items)] = a.items
        GROUP BY a.user_id, a.day""",
    "prefix_covered_pairs": """
        WITH lists AS (
            SELECT user_id, ts::DATE AS day,
                list(event_type ORDER BY ts, event_id) AS items FROM events GROUP BY ALL)
        SELECT a.user_id, a.day AS covered_day, b.day AS covering_day
        FROM lists a JOIN lists b ON a.user_id = b.user_id
        WHERE len(a.items) < len(b.items) AND b.items[1:len(a.items)] = a.items""",
    "latest_run": """
        SELECT c_custkey, event_id, ts, event_type, user_id IS NULL AS never_run
        FROM customer LEFT JOIN (
            SELECT * FROM events
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
        ON c_custkey = user_id""",
    "column_profile": _profile(),
    "nullable_without_nulls": _union(
        [
            f"""SELECT '{c}' AS "column", count(*) > count({c}) AS has_nulls
            FROM documents LEFT JOIN labels USING (doc_id)"""
            for c in ("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")
        ]
    ),
    "duplicate_groups": """
        SELECT p_name, p_brand, count(*) AS duplicate_count FROM part
        GROUP BY ALL HAVING count(*) > 1
        ORDER BY duplicate_count DESC, p_name, p_brand LIMIT 200""",
    "duplicate_line_keys": """
        SELECT l_orderkey, l_linenumber, count(*) AS duplicate_count FROM lineitem
        GROUP BY ALL HAVING count(*) > 1
        ORDER BY duplicate_count DESC, l_orderkey, l_linenumber LIMIT 200""",
    "duplicate_texts": """
        SELECT text, count(*) AS duplicate_count FROM documents
        GROUP BY text HAVING count(*) > 1
        ORDER BY duplicate_count DESC, text LIMIT 200""",
    "all_duplicate_line_keys": """
        SELECT l_orderkey, l_linenumber, count(*) AS duplicate_count FROM lineitem
        GROUP BY ALL HAVING count(*) > 1""",
    "find_short_references": """
        SELECT item_id, doc_id FROM documents d JOIN (
            SELECT item_id, array_to_string(string_split(text, ' ')[1:item_id % 4 + 1], ' ') AS t
            FROM benchmark) b
        ON contains(lower(d.text), lower(b.t))""",
    "candidate_references": _candidates(),
    "member_roles": """
        SELECT DISTINCT c_custkey, o_orderpriority AS role
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey""",
    "text_version_tokens": """
        SELECT conv_id, w AS token, CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_a'
            ELSE 'only_b' END AS side
        FROM (
            SELECT conv_id, w, bool_or(role = 'user') AS a, bool_or(role = 'assistant') AS b
            FROM (SELECT conv_id, role, unnest(regexp_split_to_array(
                    lower(text), '[ \\t\\n\\x0B\\f\\r]+')) AS w
                  FROM conversations WHERE role IN ('user', 'assistant'))
            WHERE w <> '' GROUP BY conv_id, w)""",
    "customer_schema_profile": _schema_rows(
        "customer",
        [
            ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
            ("c_acctbal", "double"), ("c_mktsegment", "string"),
        ],
        "c_custkey",
    ),
    "key_capacity": _all_capacities(),
    "dataset_summary": _summary(),
    "check_rules": """
        SELECT 'customer_balance' AS rule, 'customer' AS table_name, true AS enabled,
            count(*) AS checked, count(*) FILTER (WHERE NOT c_acctbal >= 0) AS violations,
            count(*) FILTER (WHERE NOT c_acctbal >= 0) = 0 AS trusted FROM customer
        UNION ALL SELECT 'supplier_balance', 'supplier', true, count(*),
            count(*) FILTER (WHERE NOT s_acctbal >= 0),
            count(*) FILTER (WHERE NOT s_acctbal >= 0) = 0 FROM supplier
        UNION ALL SELECT 'positive_price', 'orders', true, count(*),
            count(*) FILTER (WHERE NOT o_totalprice > 0),
            count(*) FILTER (WHERE NOT o_totalprice > 0) = 0 FROM orders
        UNION ALL SELECT 'known_status', 'orders', false, NULL, NULL, false
        UNION ALL SELECT 'shipped_after_order', 'order_lines', true, count(*),
            count(*) FILTER (WHERE NOT l_shipdate >= o_orderdate),
            count(*) FILTER (WHERE NOT l_shipdate >= o_orderdate) = 0
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "layout_candidates": _layout(_LAYOUT),
    "approximate_layout": _layout(_FEW_VALUES),
    "table_schema_profile": _schema_rows(
        "orders",
        [
            ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
            ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
            ("o_orderpriority", "string"),
        ],
        "o_orderkey",
    ),
    "role_lists": """
        SELECT r_regionkey, coalesce(string_agg(DISTINCT n_name, ', ' ORDER BY n_name), '(none)')
            AS roles
        FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey""",
    "customer_priorities": """
        SELECT c_custkey, coalesce(string_agg(DISTINCT o_orderpriority, ', '
            ORDER BY o_orderpriority), '(none)') AS roles
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey
        WHERE c_custkey NOT IN (0) GROUP BY c_custkey""",
    "event_flags": """
        SELECT user_id, day, on_view, on_click, on_signup, on_purchase, on_error,
            concat_ws(',', CASE WHEN on_view = 1 THEN 'VIEW' END,
                CASE WHEN on_click = 1 THEN 'CLK' END, CASE WHEN on_signup = 1 THEN 'SGN' END,
                CASE WHEN on_purchase = 1 THEN 'BUY' END,
                CASE WHEN on_error = 1 THEN 'ERR' END) AS label
        FROM (SELECT user_id, ts::DATE AS day,
                max((event_type = 'view')::INTEGER) AS on_view,
                max((event_type = 'click')::INTEGER) AS on_click,
                max((event_type = 'signup')::INTEGER) AS on_signup,
                max((event_type = 'purchase')::INTEGER) AS on_purchase,
                max((event_type = 'error')::INTEGER) AS on_error
            FROM events GROUP BY ALL)""",
    "activity_rates": f"""
        WITH span AS (SELECT greatest(
            date_diff('microsecond', min(ts), max(ts)) / 1000000 / 86400, 1.0) AS days FROM events)
        SELECT c_custkey, reads, writes, round(reads / days, 4) AS reads_per_day,
            round(writes / days, 4) AS writes_per_day
        FROM customer JOIN ({_ACTIVITY}) ON c_custkey = user_id, span
        WHERE reads + writes > 0""",
    "last_access": f"""
        SELECT c_custkey, last_read, last_write
        FROM customer LEFT JOIN ({_ACTIVITY}) ON c_custkey = user_id""",
    "multi_event_entities": """
        SELECT ts::DATE AS day, user_id, count(DISTINCT event_type) AS types,
            string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS label
        FROM events GROUP BY ALL HAVING count(DISTINCT event_type) > 1""",
    "multi_event_groups": """
        WITH pairs AS (SELECT DISTINCT ts::DATE AS day, user_id FROM events)
        SELECT day, count(*) OVER (PARTITION BY day) AS users, user_id FROM pairs
        QUALIFY count(*) OVER (PARTITION BY day) > 1""",
    "size_report": _sizes("source"),
    "size_by_language": _sizes("lang"),
    "top_by_cost": _cost(
        "lineitem", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate",
        "l_returnflag || '/' || l_linestatus",
    ),
    "top_events_by_cost": _cost(
        "events", "event_type", "value", "length(props)", "ts", "props"
    ),
    "top_texts_by_cost": _cost(
        "conversations", "role", "length(text)", "strlen(text)", "turn", "text"
    ),
    "share_of_total": _share("events", "event_type", "value", "event_type <> 'error'"),
    "share_of_suppliers": _share("lineitem", "l_suppkey", "l_extendedprice", "true"),
    "impact_ranking": """
        SELECT p_partkey, hits, round(price * discount * hits, 0) AS score
        FROM (SELECT p_partkey, sum(p_retailprice::DECIMAL(18,2))::DOUBLE / count(*) AS price
              FROM part GROUP BY p_partkey)
        JOIN (SELECT l_partkey,
                sum(l_discount::DECIMAL(18,2))::DOUBLE / count(*) * 100 AS discount,
                count(*) FILTER (WHERE l_returnflag IN ('R', 'A')) AS hits
              FROM lineitem GROUP BY l_partkey)
        ON p_partkey = l_partkey""",
    "clustering_fragmentation": """
        SELECT o_custkey, rows, round(bad * 100.0 / rows, 1) AS pct,
            CASE WHEN round(bad * 100.0 / rows, 1) >= 50 THEN 'REBUILD' ELSE 'REORGANIZE' END
                AS action
        FROM (SELECT o_custkey, count(*) AS rows, count(*) FILTER (WHERE o_orderdate < before) AS bad
              FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)
                        AS before FROM orders)
              GROUP BY o_custkey)
        WHERE rows >= 10 AND bad * 100.0 / rows > 10""",
    "set_compare": _HALVES,
    "set_compare_counts": f"""
        WITH h AS ({_HALVES})
        SELECT status, count(o_custkey) AS keys
        FROM (VALUES ('only_a'), ('only_b'), ('both')) s(status) LEFT JOIN h USING (status)
        GROUP BY status""",
    "column_diff": _column_diff(),
    "text_version_diff": f"""
        WITH pieces AS ({_TOKENS}),
        words AS (
            SELECT DISTINCT conv_id, role,
                unnest(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+')) AS w FROM pieces),
        per AS (
            SELECT conv_id, w, bool_or(role = 'user') AS a, bool_or(role = 'assistant') AS b
            FROM words WHERE w <> '' GROUP BY conv_id, w),
        toks AS (
            SELECT conv_id, count(*) FILTER (WHERE a AND NOT b) AS oa,
                count(*) FILTER (WHERE b AND NOT a) AS ob,
                count(*) FILTER (WHERE a AND b) AS ab
            FROM per GROUP BY conv_id),
        ln AS (
            SELECT conv_id, bool_or(role = 'user') AS in_a, bool_or(role = 'assistant') AS in_b,
                coalesce(sum(lines) FILTER (WHERE role = 'user'), 0)::BIGINT AS lines_a,
                coalesce(sum(lines) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS lines_b
            FROM pieces GROUP BY conv_id)
        SELECT conv_id, in_a, in_b, lines_a, lines_b,
            CASE WHEN in_a AND in_b THEN abs(lines_a - lines_b) END AS diff,
            CASE WHEN in_a AND in_b THEN CASE WHEN lines_a > lines_b THEN 'a'
                WHEN lines_b > lines_a THEN 'b' ELSE 'same' END END AS longer,
            CASE WHEN in_a AND in_b THEN coalesce(oa, 0) END AS tokens_only_a,
            CASE WHEN in_a AND in_b THEN coalesce(ob, 0) END AS tokens_only_b,
            CASE WHEN in_a AND in_b THEN coalesce(ab, 0) END AS tokens_both
        FROM ln LEFT JOIN toks USING (conv_id)""",
    "feed_inventory": f"""
        WITH {_LANDING}
        SELECT min(base) AS feed, count(*) AS snapshots, max(taken) AS latest,
            min(taken) AS earliest, lower(base) IN (SELECT lower(name) FROM plain) AS has_current
        FROM snaps GROUP BY lower(base)""",
    "feed_orphans": f"""
        WITH {_LANDING}
        SELECT name FROM plain WHERE lower(name) NOT IN (SELECT lower(base) FROM snaps)""",
    "feed_totals": f"""
        WITH {_LANDING}
        SELECT (SELECT count(DISTINCT lower(base)) FROM snaps) AS feeds,
            (SELECT count(*) FROM snaps) AS snapshots,
            (SELECT count(*) FROM plain
             WHERE lower(name) NOT IN (SELECT lower(base) FROM snaps)) AS orphans""",
    "feed_health": """
        WITH names AS (
            SELECT DISTINCT user_id::VARCHAR || '_' || event_type || '_'
                || floor(value / 40)::BIGINT::VARCHAR AS feed, date_trunc('second', ts) AS taken
            FROM events),
        feeds AS (
            SELECT feed, count(*) AS snapshots, max(taken) AS latest, min(taken) AS earliest
            FROM names GROUP BY feed),
        flagged AS (
            SELECT feed, snapshots, latest, concat_ws(', ',
                CASE WHEN now - latest > INTERVAL 24 HOURS THEN 'OVERDUE' END,
                CASE WHEN now - earliest > INTERVAL 5 DAYS THEN 'CLEANUP LATE' END,
                CASE WHEN snapshots > 6 THEN 'EXCESS' END) AS flags
            FROM feeds, (SELECT max(taken) AS now FROM names))
        SELECT * FROM flagged WHERE flags <> ''""",
    "snapshot_drift": _DRIFT + """
        SELECT feed, count(*) FILTER (WHERE status = 'only_newest') AS only_newest,
            count(*) FILTER (WHERE status = 'only_permanent') AS only_permanent,
            count(*) FILTER (WHERE status = 'mismatch') AS mismatched,
            count(*) FILTER (WHERE status = 'identical') AS identical
        FROM drift GROUP BY feed""",
    "snapshot_drift_columns": _DRIFT + " SELECT * FROM drift",
}
