"""The registered queries in SQL, for DuckDB over the same tables."""

from __future__ import annotations

from .fixtures import COLUMNS, ODD_NAMES
from .templates import CTES, STATEMENTS, choose_sql, fill_sql

# Event pipeline

RAW = """
raw_events AS (
  SELECT event_id, ts AS event_ts, user_id,
         user_id || '-' || strftime(ts, '%Y%m%d') AS session_id,
         CAST(round(value * 100) AS BIGINT) AS revenue_cents, n_name AS country
  FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
users AS (
  SELECT c_custkey AS user_id, lower(c_name || '@Example.com') AS email,
         CAST(first_order AS DATE) AS signup_date, c_mktsegment AS plan_tier
  FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY 1)
       ON o_custkey = c_custkey
  WHERE c_acctbal >= 0)"""


def _sessions(minutes: int) -> str:
    return f"""
sessions AS (
  SELECT user_id, session_id, min(event_ts) AS started_at, max(event_ts) AS ended_at,
         CAST(count(*) AS BIGINT) AS event_count,
         CAST(CAST(sum(revenue_cents) AS BIGINT) AS DOUBLE) / 100 AS revenue,
         arg_min_null(country, struct_pack(a := event_ts, b := event_id)) AS country
  FROM raw_events
  WHERE event_ts IS NOT NULL
    AND date_sub('minute', event_ts, TIMESTAMP '2024-01-31 00:00:00') < {minutes}
  GROUP BY user_id, session_id)"""


MONTH = f"WITH {RAW}, {_sessions(43200)}"
DAILY = """
  SELECT CAST(started_at AS DATE) AS day, plan_tier, round(sum(revenue), 2) AS revenue,
         CAST(count(DISTINCT session_id) AS BIGINT) AS sessions
  FROM sessions LEFT JOIN users USING (user_id) GROUP BY ALL"""
SESSION_COLUMNS = """
  SELECT user_id, session_id, started_at, ended_at, event_count, round(revenue, 2) AS revenue, country
  FROM sessions"""

# Source texts

NUMBERED = """
numbered AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 5 AS l,
         'main.l' || (o_orderkey % 5) || '.t' || o_custkey AS r,
         'main.l' || (o_orderkey % 5) || '.t' || (o_custkey + 7) AS r2,
         'main.l' || (o_orderkey % 5 + 1) || '.t' || (o_custkey + 3) AS w
  FROM orders)"""
STATEMENT_TEXTS = f"""{NUMBERED},
texts AS (SELECT 'q/' || k || '.sql' AS id, {choose_sql("k % 8", STATEMENTS)} AS text FROM numbered)"""
CTE_TEXTS = f"""{NUMBERED},
texts AS (SELECT 'c/' || k || '.sql' AS id, {choose_sql("k % 5", CTES)} AS text FROM numbered)"""

# The clauses once more, in this engine's syntax: it has no look-behind, so the character
# before a keyword is part of the match.
W = r"[\p{L}\p{N}_]"
B = r"(?:^|[^\p{L}\p{N}_])"
N = rf"`?([A-Za-z_]{W}*(?:`?\.`?[A-Za-z_]{W}*){{0,2}})`?"
READ_PATTERNS = (rf"(?i){B}FROM\s+{N}", rf"(?i){B}JOIN\s+{N}")
WRITE_PATTERNS = (
    rf"(?i){B}CREATE\s+(?:OR\s+REPLACE\s+)?(?:TABLE|VIEW)\s+(?:IF\s+NOT\s+EXISTS\s+)?{N}",
    rf"(?i){B}INSERT\s+(?:INTO|OVERWRITE)\s+(?:TABLE\s+)?{N}",
    rf"(?i){B}MERGE\s+INTO\s+{N}",
    rf"(?i){B}UPDATE\s+{N}",
)
CTE_PATTERN = (
    rf"(?i)(?:{B}WITH\s+(?:RECURSIVE\s+)?|,\s*)`?({W}+)`?(?:\s*\([^)]*\))?\s+AS\s*\("
)


def _found(patterns) -> str:
    lists = [f"regexp_extract_all(clean, '{p}', 1)" for p in patterns]
    return f"list_transform(flatten([{', '.join(lists)}]), lambda x: replace(x, '`', ''))"


REFS = f"""
clean AS (
  SELECT id, text, regexp_replace(text, '''[^'']*''|--[^\\n]*|(?s:/\\*.*?\\*/)', ' ', 'g') AS clean FROM texts),
lists AS (
  SELECT id, text, {_found(READ_PATTERNS)} AS r, {_found(WRITE_PATTERNS)} AS w,
         list_transform({_found([CTE_PATTERN])}, lambda x: lower(x)) AS ctes FROM clean),
named AS (
  SELECT id, text, ctes, 'READS_TABLE' AS type, unnest(list_distinct(list_filter(r, lambda x: NOT list_contains(w, x)))) AS table_name FROM lists
  UNION ALL
  SELECT id, text, ctes, 'WRITES_TABLE', unnest(list_distinct(w)) FROM lists),
refs AS (
  SELECT id, text, table_name, type FROM named
  WHERE lower(table_name) NOT IN ('select', 'values', 'lateral', 'unnest', 'table', 'set')
    AND NOT list_contains(ctes, lower(table_name)))"""
SQL_EDGES = """
sql_lines AS (
  SELECT *, CAST(regexp_extract(id, '[0-9]+') AS BIGINT) % 3 AS kind,
         CAST(length(part) - length(replace(part, chr(10), '')) + 1 AS INTEGER) AS line
  FROM (SELECT *, substr(text, 1, instr(text, split_part(table_name, '.', -1)) - 1) AS part FROM refs)),
sql_edges AS (
  SELECT CASE WHEN kind = 2 THEN 'k:file:' || id WHEN kind = 0 AND line <= 2 THEN id || '::head' ELSE id || '::all' END AS from_id,
         table_name, type, id AS file_path, line, 'literal' AS resolution
  FROM sql_lines)"""

# What the templates say, written down by hand: number, name, type, line, resolution.
CTE_EXPECTED = [
    (0, "<r>", "READS_TABLE"), (0, "<w>", "WRITES_TABLE"), (1, "<r>", "READS_TABLE"),
    (2, "three", None), (3, "<r>", "READS_TABLE"), (3, "<r2>", "READS_TABLE"),
    (4, "<r>", "READS_TABLE"), (4, "<w>", "WRITES_TABLE"),
]
PYTHON_EXPECTED = [
    (0, "main.l<l>.t<c>", "READS_TABLE", 4, "inferred", "load"),
    (1, "main.l<l>.t<c>", "WRITES_TABLE", 2, "literal", "save"),
    (2, "main.l9.t<c>", "WRITES_TABLE", 3, "literal", "build"),
    (2, "main.l<l>.t<c>", "READS_TABLE", 3, "literal", "build"),
    (3, "main.l<l>.t<c>", "READS_TABLE", 5, "literal", None),
    (5, "main.l<l>.t<c>", "READS_TABLE", 2, "literal", "both"),
    (5, "main.l<l>.t<c>", "READS_TABLE", 2, "literal", "both"),
    (5, "main.l<l>.t<c>", "WRITES_TABLE", 3, "inferred", "both"),
]


def _cte_expected() -> str:
    return " UNION ALL ".join(
        f"SELECT 'c/' || k || '.sql' AS file_path, {fill_sql(name)} AS table_name, '{kind}' AS type "
        f"FROM numbered WHERE k % 5 = {n}"
        for n, name, kind in CTE_EXPECTED
        if kind
    )


def _python_expected() -> str:
    parts = []
    for n, name, kind, line, resolution, function in PYTHON_EXPECTED:
        origin = f"'p/' || k || '.py::{function}'" if function else "'k:file:p/' || k || '.py'"
        parts.append(
            f"SELECT {origin} AS from_id, {fill_sql(name)} AS table_name, '{kind}' AS type, "
            f"'p/' || k || '.py' AS file_path, CAST({line} AS INTEGER) AS line, "
            f"'{resolution}' AS resolution FROM numbered WHERE k % 6 = {n}"
        )
    return f"py_edges AS ({' UNION ALL '.join(parts)})"


# Symbols, references, edges

SYMBOLS = """
symbols AS (
  SELECT DISTINCT 'm' || l_orderkey || '.py' AS file_path, 'f' || l_linenumber AS name, 'function' AS kind,
         CAST(10 * l_linenumber - 8 AS INTEGER) AS start_line, CAST(10 * l_linenumber AS INTEGER) AS end_line FROM lineitem
  UNION ALL
  SELECT DISTINCT 'm' || l_orderkey || '.py', 'C', 'class', 1, 60 FROM lineitem),
reference AS (
  SELECT DISTINCT l_orderkey AS k, 'm' || l_orderkey || '.py' AS file_path, CAST(l_partkey % 80 + 1 AS INTEGER) AS line
  FROM lineitem),
owned AS (
  SELECT k, r.file_path, line, arg_min(name, end_line - start_line) AS owner
  FROM reference r LEFT JOIN symbols s ON r.file_path = s.file_path AND line BETWEEN start_line AND end_line
  GROUP BY k, r.file_path, line)"""
OWNED_EDGES = f"""{SYMBOLS},
edges AS MATERIALIZED (
  SELECT *, (k + line * 7) // 3 AS id,
         'L' || (k % 4 + CASE WHEN line % 2 = 1 THEN 0 ELSE 1 END) || '.T' || ((k + line * 7) // 3) AS table_name,
         CASE WHEN line % 2 = 1 THEN 'READS_TABLE' ELSE 'WRITES_TABLE' END AS type,
         CASE WHEN owner IS NULL THEN 'file:' || file_path ELSE file_path || '::' || owner END AS from_id
  FROM owned),
good AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 50 <> 49),
written AS MATERIALIZED (
  SELECT DISTINCT k AS change_id, table_name FROM edges SEMI JOIN good USING (k)
  WHERE type = 'WRITES_TABLE' AND (owner = 'f1' OR owner IS NULL)),
pairs AS MATERIALIZED (
  SELECT DISTINCT r.table_name AS source, w.table_name AS target
  FROM edges r JOIN edges w ON r.from_id = w.from_id AND r.type = 'READS_TABLE' AND w.type = 'WRITES_TABLE'
  WHERE r.table_name <> w.table_name),
reach AS (
  SELECT table_name AS start_table, table_name, 0 AS depth FROM (SELECT DISTINCT table_name FROM written)
  UNION
  SELECT start_table, target, depth + 1 FROM reach JOIN pairs ON source = table_name),
radius AS MATERIALIZED (SELECT DISTINCT start_table, table_name FROM reach WHERE depth > 0 AND start_table <> table_name)"""
LAYERED = """
edges AS (
  SELECT DISTINCT 's' || l_orderkey AS from_id,
         CASE WHEN l_linenumber % 2 = 1 THEN 'READS_TABLE' ELSE 'WRITES_TABLE' END AS type,
         'L' || (l_orderkey % 6 + CASE WHEN l_linenumber % 2 = 1 THEN 0 ELSE 1 END) || '.t' || l_partkey || '_'
             || ((l_linenumber + 1) // 2) AS table_name,
         'm' || l_orderkey || '.py' AS file_path, l_linenumber AS line
  FROM lineitem),
pairs AS (
  SELECT DISTINCT r.table_name AS source, w.table_name AS target
  FROM edges r JOIN edges w ON r.from_id = w.from_id AND r.type = 'READS_TABLE' AND w.type = 'WRITES_TABLE'
  WHERE r.table_name <> w.table_name)"""

# Columns

ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
TYPES = ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"]
COLUMN_ROWS = ", ".join(f"('{n}', '{t}', {i})" for i, (n, t) in enumerate(zip(ORDERS, TYPES)))
ODD_ROWS = ", ".join(f"({i}, '{n}')" for i, n in enumerate(ODD_NAMES))
CORE = f"""
column_list(column_name, data_type, ordinal) AS (VALUES {COLUMN_ROWS}),
live AS (
  SELECT c_custkey AS c, 'main.core.t' || c_custkey AS table_name, column_name, data_type, ordinal
  FROM customer, column_list WHERE c_acctbal >= 0),
used AS (
  SELECT o_orderkey AS change_id, table_name, column_name, data_type, ordinal,
         (o_orderkey >> ordinal) & 1 = 1 AS mentioned
  FROM orders JOIN live ON c = o_custkey),
dropped AS (SELECT change_id, table_name, column_name, data_type, ordinal FROM used WHERE NOT mentioned),
readers AS (
  SELECT table_name, column_name,
         'r' || event_id || '.py::' || CASE WHEN ordinal < 3 THEN 'top' ELSE 'bottom' END AS consumer
  FROM events JOIN live ON c = user_id WHERE (event_id >> ordinal) & 1 = 1)"""

# Checkpoints

ENVELOPES = """
one AS (
  SELECT conv_id AS branch, turn, role, conv_id || '-' || turn AS tag,
         'q/' || (conv_id * 7 + turn) || '.sql' AS f1, 'q/' || (conv_id * 7 + turn + 1) || '.sql' AS f2
  FROM conversations),
ck AS (
  SELECT branch, turn, CAST(0 AS INTEGER) AS position,
         CASE branch % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'k' ELSE 'h' END || tag AS id,
         CASE branch % 3 WHEN 2 THEN '' ELSE 's' || branch END AS session,
         role || CASE branch % 3 WHEN 0 THEN ' asks' WHEN 1 THEN '' ELSE ' done' END AS intent,
         [f1, f2] AS files FROM one
  UNION ALL
  SELECT branch, turn, 1, 'older' || tag, '', '', [] FROM one WHERE branch % 3 = 2)"""

INTENTS = """
dated AS (SELECT DISTINCT l_orderkey AS change_id, l_orderkey % 1200 AS branch, l_orderkey % 7 AS changed_at FROM lineitem),
intents AS MATERIALIZED (
  SELECT change_id, dated.branch, changed_at, id AS checkpoint_id, intent
  FROM dated LEFT JOIN ck ON ck.branch = dated.branch AND turn <= changed_at
  QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY turn DESC NULLS LAST, position) = 1)"""


def oracle_sql() -> dict[str, str]:
    sql = {
        "bronze_ingest": f"""WITH {RAW}
            SELECT *, TIMESTAMP '2024-01-31 00:00:00' AS _ingested_at FROM raw_events""",
        "silver_sessions": f"WITH {RAW}, {_sessions(1800)} {SESSION_COLUMNS}",
        "silver_sessions_month": f"{MONTH} {SESSION_COLUMNS}",
        "silver_users": f"WITH {RAW} SELECT * FROM users",
        "gold_daily_revenue": f"{MONTH} {DAILY}",
        "gold_user_retention": f"""{MONTH}
            SELECT plan_tier, signup_date, CAST(count(DISTINCT s.user_id) AS BIGINT) AS returning_users
            FROM sessions s JOIN users u USING (user_id) WHERE event_count > 1 GROUP BY ALL""",
        "gold_revenue_by_country": f"""{MONTH}
            SELECT country, round(sum(revenue), 2) AS revenue FROM sessions GROUP BY country""",
        "dashboard_revenue": f"""{MONTH}, daily AS ({DAILY})
            SELECT day, plan_tier, revenue FROM daily
            WHERE day >= DATE '2024-01-31' - 30 ORDER BY day DESC""",
        "sql_table_refs": f"""WITH {STATEMENT_TEXTS}, {REFS}
            SELECT id AS file_path, table_name, type FROM refs""",
        "sql_refs_in_documents": f"""WITH texts AS (SELECT doc_id AS id, text FROM documents), {REFS}
            SELECT id AS doc_id, table_name, type FROM refs""",
        "cte_exclusion": f"""WITH {NUMBERED} {_cte_expected()}""",
        "known_table_refs": f"""WITH {STATEMENT_TEXTS}, {REFS}
            SELECT id AS file_path, table_name, type FROM refs WHERE table_name IN (
              SELECT 'main.l' || layer || '.t' || c_custkey
              FROM customer, (SELECT unnest(range(7)) AS layer) WHERE (c_custkey + layer) % 3 <> 0)""",
        "sql_file_edges": f"WITH {STATEMENT_TEXTS}, {REFS}, {SQL_EDGES} SELECT * FROM sql_edges",
        "python_table_refs": f"""WITH {NUMBERED}, {_python_expected()}
            SELECT file_path, table_name, type, line, resolution FROM py_edges""",
        "python_file_edges": f"WITH {NUMBERED}, {_python_expected()} SELECT * FROM py_edges",
        "edges": f"""WITH {STATEMENT_TEXTS}, {REFS}, {SQL_EDGES}, {_python_expected()}
            SELECT * FROM sql_edges UNION ALL SELECT * FROM py_edges""",
        "ref_owner": f"""WITH {SYMBOLS}
            SELECT file_path, line, file_path || '::' || owner AS owner_id FROM owned""",
        "symbols_from_ndjson": f"""WITH {SYMBOLS}
            SELECT file_path || '::' || name AS id, name, CASE kind WHEN 'class' THEN '' ELSE kind END AS kind, file_path,
                   CASE kind WHEN 'class' THEN 0 ELSE start_line END AS start_line,
                   CASE kind WHEN 'class' THEN 0 ELSE end_line END AS end_line
            FROM symbols""",
        "relation_records": f"""WITH {LAYERED}
            SELECT 'relation' AS record_type, type, from_id, 'k:Table:' || table_name AS to_id, 'table' AS to_kind,
                   'literal' AS resolution, file_path AS evidence_file, line AS evidence_line FROM edges""",
        "table_graph": f"WITH {LAYERED} SELECT source, target FROM pairs",
        "blast_radius": f"""WITH RECURSIVE {LAYERED}, r AS (
              SELECT DISTINCT table_name AS start_table, table_name, 0 AS depth FROM edges WHERE type = 'WRITES_TABLE'
              UNION SELECT start_table, target, depth + 1 FROM r JOIN pairs ON source = table_name)
            SELECT start_table, table_name, CAST(min(depth) AS INTEGER) AS depth FROM r
            WHERE start_table <> table_name GROUP BY ALL""",
        "blast_radius_order": f"""WITH RECURSIVE {LAYERED}, r AS (
              SELECT DISTINCT table_name AS start_table, table_name, 0 AS depth, [''] AS path
              FROM edges WHERE type = 'WRITES_TABLE'
              UNION ALL SELECT start_table, target, depth + 1, list_append(path, target)
              FROM r JOIN pairs ON source = table_name),
            shortest AS (
              SELECT start_table, table_name, min(struct_pack(d := depth, p := path)) AS best FROM r
              WHERE start_table <> table_name GROUP BY ALL)
            SELECT start_table, table_name, CAST(best.d AS INTEGER) AS depth,
                   row_number() OVER (PARTITION BY start_table ORDER BY best) AS bfs_rank FROM shortest""",
        "changed_entities": """
            WITH k AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 50 <> 49)
            SELECT k AS change_id, 'm' || k || '.py' AS file_path, 'f1' AS name, 'body_changed' AS change_type,
                   CAST(NULL AS BIGINT) AS was FROM k
            UNION ALL SELECT k, 'm' || k || '.py', NULL, 'removed', k FROM k
            UNION ALL SELECT k, '', 'lost', NULL, NULL FROM k""",
        "tables_written": f"WITH RECURSIVE {OWNED_EDGES} SELECT change_id, table_name FROM written",
        "consumers": f"""WITH RECURSIVE {OWNED_EDGES}
            SELECT DISTINCT table_name, file_path FROM edges WHERE type = 'READS_TABLE' AND table_name IN (
              SELECT table_name FROM written UNION SELECT table_name FROM radius)""",
        "columns_mentioned": f"""WITH {CORE}
            SELECT change_id, table_name, column_name FROM used WHERE mentioned""",
        "dropped_columns": f"WITH {CORE} SELECT * FROM dropped",
        "odd_name_mentions": f"""WITH {CORE}, odd(ordinal, odd_name) AS (VALUES {ODD_ROWS})
            SELECT table_name, odd_name AS column_name, consumer
            FROM readers JOIN column_list USING (column_name) JOIN odd USING (ordinal)""",
        "column_breaks": f"""WITH {CORE}
            SELECT change_id, table_name, column_name, data_type, consumer
            FROM dropped JOIN readers USING (table_name, column_name)""",
        "change_verdict": f"""WITH {CORE}
            SELECT o_orderkey AS change_id,
                   CASE WHEN o_orderkey IN (
                          SELECT change_id FROM dropped SEMI JOIN readers USING (table_name, column_name)) THEN 'BLOCK'
                        WHEN o_custkey NOT IN (SELECT c FROM live) THEN 'UNVERIFIED' ELSE 'PASS' END AS verdict
            FROM orders""",
        "checkpoints_normalized": f"""WITH {ENVELOPES}
            SELECT branch, turn, position, id, session, intent, array_to_string(files, ',') AS files FROM ck""",
        "latest_checkpoint": f"""WITH {ENVELOPES}
            SELECT branch, id, session, intent, array_to_string(files, ',') AS files FROM ck
            QUALIFY row_number() OVER (PARTITION BY branch ORDER BY turn DESC, position, id) = 1""",
        "checkpoint_tables": f"""WITH {ENVELOPES}, {STATEMENT_TEXTS}, {REFS},
            files AS (SELECT DISTINCT branch, ck.id, unnest(files) AS file_path FROM ck)
            SELECT DISTINCT branch, files.id, table_name, type FROM files JOIN refs ON refs.id = file_path""",
        "source_files": """
            SELECT 'r' || (c_custkey % 20) || CASE WHEN c_custkey % 3 = 0 THEN '/p' || c_custkey || '/__init__.py'
                   ELSE '/_q' || c_custkey || '.sql' END AS file_path,
                   concat('-- ', c_name, chr(10), 'SELECT ', c_custkey, chr(10), 'FROM t') AS text
            FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 11 <> 0""",
        "catalog_columns": f"""WITH column_list(column_name, data_type, ordinal) AS (VALUES {COLUMN_ROWS})
            SELECT 'main.o' || k AS table_name, column_name, data_type, CAST(ordinal AS INTEGER) AS ordinal
            FROM (SELECT DISTINCT o_custkey // 10 AS k FROM orders), column_list""",
        "intent_at": f"""WITH {ENVELOPES}, {INTENTS} SELECT * FROM intents""",
        "audit_summary": f"""WITH RECURSIVE {OWNED_EDGES}, {ENVELOPES}, {INTENTS},
            good_or_bad AS (SELECT DISTINCT l_orderkey AS k FROM lineitem),
            line_use AS MATERIALIZED (
              SELECT k, line, 'c' || ((k * 7 + line * line) % {COLUMNS}) AS column_name
              FROM good_or_bad, (SELECT unnest(range(1, 81)) AS line)),
            live AS MATERIALIZED (
              SELECT DISTINCT table_name, 'c' || i AS column_name
              FROM edges, (SELECT unnest(range({COLUMNS})) AS i) WHERE id % 5 <> 0),
            produced AS MATERIALIZED (
              SELECT DISTINCT table_name, column_name FROM edges JOIN (SELECT DISTINCT k, column_name FROM line_use) USING (k)
              WHERE type = 'WRITES_TABLE' AND k % 47 <> 5),
            blind AS MATERIALIZED (
              SELECT table_name, count(DISTINCT k) AS files, bool_or(type = 'WRITES_TABLE') AS writing FROM edges WHERE k % 47 = 5 GROUP BY table_name),
            gone AS MATERIALIZED (SELECT change_id, table_name, column_name FROM written JOIN live USING (table_name)
                     ANTI JOIN produced USING (table_name, column_name)
                     ANTI JOIN (SELECT table_name FROM blind WHERE writing) USING (table_name)),
            scope AS MATERIALIZED (
              SELECT DISTINCT k, table_name, owner, coalesce(start_line, 1) AS a, coalesce(end_line, 80) AS b
              FROM edges LEFT JOIN symbols ON edges.file_path = symbols.file_path AND owner = name
              WHERE type = 'READS_TABLE' AND k % 47 <> 5),
            in_scope AS MATERIALIZED (
              SELECT DISTINCT k, table_name, owner, column_name
              FROM (SELECT *, unnest(range(a, b + 1)) AS line FROM scope) JOIN line_use USING (k, line)),
            reading AS MATERIALIZED (SELECT * FROM in_scope SEMI JOIN live USING (table_name, column_name)),
            finding AS (
              SELECT change_id, count(*) AS findings FROM gone JOIN reading USING (table_name, column_name) GROUP BY ALL),
            per AS (
              SELECT change_id, count(*) AS tables_written, sum(coalesce(n, 0)) AS downstream,
                     bool_or(table_name NOT IN (SELECT table_name FROM live) OR files IS NOT NULL) AS unchecked, sum(files) AS files
              FROM written LEFT JOIN (SELECT start_table, count(*) AS n FROM radius GROUP BY ALL) ON start_table = table_name
              LEFT JOIN blind USING (table_name)
              GROUP BY change_id)
            SELECT g.k AS change_id, CAST(CASE WHEN g.k % 50 = 49 THEN 0 ELSE 3 END AS BIGINT) AS entities,
                   CAST(coalesce(tables_written, 0) AS BIGINT) AS tables_written,
                   CAST(coalesce(downstream, 0) AS BIGINT) AS downstream,
                   CAST(coalesce(findings, 0) AS BIGINT) AS findings,
                   CAST((SELECT count(*) FROM edges) AS BIGINT) AS edges,
                   CASE WHEN findings > 0 THEN 'BLOCK' WHEN unchecked OR g.k % 50 = 49 OR g.k % 47 = 5 THEN 'UNVERIFIED' ELSE 'PASS' END AS verdict,
                   CAST(coalesce(files, 0) + CASE WHEN g.k % 47 = 5 AND g.k % 50 <> 49 THEN 1 ELSE 0 END AS BIGINT) AS blind_spots,
                   g.k % 1200 AS branch, checkpoint_id, intent
            FROM good_or_bad g LEFT JOIN per ON per.change_id = g.k LEFT JOIN finding ON finding.change_id = g.k
            JOIN intents ON intents.change_id = g.k""",
    }
    sql["sessions_from_landing"] = sql["silver_sessions"]
    sql["users_from_landing"] = sql["silver_users"]
    sql["revenue_tables"] = sql["gold_daily_revenue"]
    return sql
