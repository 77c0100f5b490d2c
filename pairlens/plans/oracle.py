"""DuckDB SQL with the results of the registered comparison queries."""

from __future__ import annotations

NUMBER = r"[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)"
DAY = "strftime({0}, '%Y-%m-%d %H:%M:%S')"

ORDERS = f"""
prod AS (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
  CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS VARCHAR) AS o_totalprice, {DAY.format('o_orderdate')} AS o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 0),
dev AS (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, CASE WHEN o_orderkey % 61 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus,
  CAST(CAST(CASE WHEN o_orderkey % 53 = 0 THEN CAST(o_totalprice AS DECIMAL(18,4)) + CAST(0.0040 AS DECIMAL(18,4)) WHEN o_orderkey % 59 = 0 THEN CAST(o_totalprice AS DECIMAL(18,4)) + 1
  ELSE CAST(o_totalprice AS DECIMAL(18,4)) END AS DECIMAL(18,4)) AS VARCHAR) AS o_totalprice, {DAY.format('o_orderdate')} AS o_orderdate, o_orderpriority AS o_priority FROM orders WHERE o_orderkey % 89 <> 0),
m AS (SELECT p.o_orderkey, p.o_custkey AS p_o_custkey, d.o_custkey AS d_o_custkey, p.o_orderstatus AS p_o_orderstatus, d.o_orderstatus AS d_o_orderstatus, p.o_totalprice AS p_o_totalprice,
  d.o_totalprice AS d_o_totalprice, p.o_orderdate AS p_o_orderdate, d.o_orderdate AS d_o_orderdate, o_orderpriority, o_priority,
  p.o_custkey <> d.o_custkey AS x_o_custkey, p.o_orderstatus <> d.o_orderstatus AS x_o_orderstatus,
  round(CAST(p.o_totalprice AS DECIMAL(18,4)), 2) <> round(CAST(d.o_totalprice AS DECIMAL(18,4)), 2) AS x_o_totalprice, p.o_orderdate <> d.o_orderdate AS x_o_orderdate
  FROM prod p JOIN dev d ON p.o_orderkey = d.o_orderkey),
f AS (SELECT *, x_o_custkey OR x_o_orderstatus OR x_o_totalprice OR x_o_orderdate AS failed FROM m),
cells AS ({{cells}}),
sides AS (SELECT o_orderkey, 'Missing in Dev' AS side FROM prod WHERE o_orderkey NOT IN (SELECT o_orderkey FROM dev)
  UNION ALL SELECT o_orderkey, 'Extra in Dev' FROM dev WHERE o_orderkey NOT IN (SELECT o_orderkey FROM prod)),
fields AS (SELECT 'o_orderpriority' AS field, 'Missing in Dev' AS side, count(*) FILTER (WHERE o_orderpriority <> '') AS "count" FROM m
  UNION ALL SELECT 'o_priority', 'Extra in Dev', count(*) FILTER (WHERE o_priority <> '') FROM m)
"""
_COMPARED = ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
_CELLS = " UNION ALL ".join(f"SELECT o_orderkey, '{c}' AS \"column\", p_{c} AS prod_value, d_{c} AS dev_value FROM m WHERE x_{c}" for c in _COMPARED)
ORDERS = "WITH " + ORDERS.replace("{cells}", _CELLS)
_WIDE = ", ".join(f"p_{c} AS prod_{c}, d_{c} AS dev_{c}, CASE WHEN x_{c} THEN 'Fail' ELSE 'Pass' END AS compareresult_{c}" for c in _COMPARED)
_COUNTS = """(SELECT count(*) FROM prod) AS total_prod, (SELECT count(*) FROM dev) AS total_dev, (SELECT count(*) FROM f WHERE NOT failed) AS matched_passed,
  (SELECT count(*) FROM f WHERE failed) AS matched_failed, (SELECT count(*) FROM sides WHERE side = 'Extra in Dev') AS extra_dev,
  (SELECT count(*) FROM sides WHERE side = 'Missing in Dev') AS missing_dev, (SELECT count(*) FROM cells) AS total_diffs, CAST(0 AS BIGINT) AS duplicate_prod, CAST(0 AS BIGINT) AS duplicate_dev"""

_LINE = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_shipdate"


def _line(flag: str, where: str) -> str:
    return f"""SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(l_partkey AS VARCHAR) AS l_partkey,
  CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS l_quantity, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS l_extendedprice, {flag} AS l_returnflag, l_linestatus,
  {DAY.format('l_shipdate')} AS l_shipdate FROM lineitem WHERE {where}"""


_SEQ = "row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY concat_ws('|', l_partkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_shipdate)) - 1 AS seq"
LINES = f"""WITH prod AS ({_line('l_returnflag', 'l_partkey % 101 <> 0')}),
dev AS ({_line("CASE WHEN l_partkey % 53 = 0 THEN lower(l_returnflag) ELSE l_returnflag END", 'l_suppkey % 97 <> 0')}),
p AS (SELECT *, {_SEQ} FROM prod), d AS (SELECT *, {_SEQ} FROM dev)
"""
_ON = "p.l_orderkey = d.l_orderkey AND p.l_linenumber = d.l_linenumber AND p.seq = d.seq"
_SIDES = f"""SELECT coalesce(p.l_orderkey, d.l_orderkey) AS l_orderkey, coalesce(p.l_linenumber, d.l_linenumber) AS l_linenumber, coalesce(p.seq, d.seq) AS seq,
  CASE WHEN d.seq IS NULL THEN 'Missing in Dev' WHEN p.seq IS NULL THEN 'Extra in Dev' ELSE 'Matched' END AS side FROM p FULL JOIN d ON {_ON}"""
_LINE_CELLS = " UNION ALL ".join(f"SELECT p.l_orderkey, p.l_linenumber, p.seq, '{c}' AS \"column\", p.{c} AS prod_value, d.{c} AS dev_value FROM p JOIN d ON {_ON} WHERE p.{c} <> d.{c}" for c in _LINE.split(", ")[2:])
_ROW = "concat_ws('|', l_partkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_shipdate)"
_DUP = "SELECT l_orderkey, l_linenumber FROM {} GROUP BY 1, 2 HAVING count(*) > 1"

CUSTOMER = """prod AS (SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer),
dev AS (SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS c_acctbal,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment FROM customer)"""
PART = """prod AS (SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS p_retailprice FROM part),
dev AS (SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CASE WHEN p_partkey % 13 = 0 THEN lower(p_brand) ELSE p_brand END AS p_brand, p_type, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS p_size,
  CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS p_retailprice FROM part)"""
_CUSTOMER_COLUMNS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
_PART_COLUMNS = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


def _profile(columns: tuple[str, ...], name: str) -> str:
    """CTE ``name`` with a profile row for each side and column."""
    long = " UNION ALL ".join(f"SELECT '{s}' AS side, '{c}' AS \"column\", {c} AS v, CASE WHEN regexp_full_match({c}, '{NUMBER}') THEN TRY_CAST({c} AS DOUBLE) END AS n FROM {s}" for s in ("prod", "dev") for c in columns)
    return f"""{name} AS (SELECT side, "column", round(avg(CASE WHEN v = '' THEN 1.0::DOUBLE ELSE 0 END), 6) AS null_rate, count(DISTINCT nullif(v, '')) AS distinct_count,
  count(n) / count(*) > 0.9 AS is_num, round(min(n), 6) AS lo, round(max(n), 6) AS hi, round(avg(n), 4) AS mean, CASE WHEN count(*) = 1 THEN 0.0 ELSE round(stddev_samp(n), 4) END AS std, count(n) AS k
  FROM ({long}) GROUP BY side, "column")"""


_CUSTOMER_PROFILE = f"WITH {CUSTOMER}, {_profile(_CUSTOMER_COLUMNS, 'pr')}"
_PART_PROFILE = f"WITH {PART}, {_profile(_PART_COLUMNS, 'pr')}"
_MISMATCH = 'SELECT a."column" FROM {0} a JOIN {0} b ON a."column" = b."column" AND a.side = \'prod\' AND b.side = \'dev\' WHERE a.is_num <> b.is_num'
_NUM = lambda c, s: f"CASE WHEN {s}.is_num THEN {s}.{c} END"

TOLERANCE = """WITH t AS (SELECT c_mktsegment AS prod_name, 'c_' || CAST(c_custkey % 50 AS VARCHAR) AS field, trim(['2', ' 3 ', '', 'x', '-1', '0.01', '19', '0'][c_custkey % 8 + 1]) AS level FROM customer),
r AS (SELECT *, CASE WHEN regexp_full_match(level, '[+-]?[0-9]+') THEN TRY_CAST(level AS INT) END AS decimals FROM t),
rr AS (SELECT prod_name, field, decimals, CASE WHEN level = '' THEN 'blank tolerance' WHEN decimals IS NULL THEN 'tolerance is not a whole number' WHEN decimals < 0 OR decimals > 18 THEN 'tolerance out of range' END AS reason FROM r)
"""
METRICS = ("matched_failed", "matched_passed", "total_diffs", "missing_dev", "extra_dev", "missing_dev_pct", "extra_dev_pct", "dup_count_prod", "dup_count_dev", "schema_missing", "schema_extra", "type_mismatch_count")
_METRIC_SQL = {
    "missing_dev_pct": "round(missing_dev / total_prod * 100, 4)", "extra_dev_pct": "round(extra_dev / total_dev * 100, 4)", "dup_count_prod": "0", "dup_count_dev": "0",
    "schema_missing": "1", "schema_extra": "1", "type_mismatch_count": "0",
}
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

ALERTS = (
    ORDERS
    + f""", c AS (SELECT {_COUNTS}), metrics AS ({' UNION ALL '.join(f"SELECT '{m}' AS metric, CAST({_METRIC_SQL.get(m, m)} AS DOUBLE) AS v FROM c" for m in METRICS)}),
rules AS (SELECT {_LIST(METRICS)}[s_suppkey % 12 + 1] AS metric, {_LIST(['>', '<', '>=', '<=', '==', '!='])}[CAST(floor(s_suppkey / 12) AS BIGINT) % 6 + 1] AS operator, CAST(s_suppkey % 150 AS DOUBLE) AS threshold,
  'rule ' || CAST(s_suppkey AS VARCHAR) AS message FROM supplier)
SELECT 'CRITICAL' AS level, r.metric, operator, threshold, v AS actual_value, message FROM rules r JOIN metrics m ON r.metric = m.metric
WHERE CASE operator WHEN '>' THEN v > threshold WHEN '<' THEN v < threshold WHEN '>=' THEN v >= threshold WHEN '<=' THEN v <= threshold WHEN '==' THEN v = threshold ELSE v <> threshold END"""
)

_SUPPLIER_ISSUES = """WITH s AS (SELECT CAST(s_suppkey + 1 AS INT) AS job, s_suppkey AS k FROM supplier)
SELECT job, 'prod_path' AS field, 'No PROD input is named.' AS message, 'ERROR' AS severity FROM s WHERE k % 7 = 0
UNION ALL SELECT job, 'dev_path', 'No columns are known of input nowhere', 'ERROR' FROM s WHERE k % 5 = 0
UNION ALL SELECT job, 'keys', 'DEV input customer has no column for key o_orderkey', 'ERROR' FROM s WHERE k % 5 <> 0 AND k % 3 <> 0
UNION ALL SELECT job, 'keys', 'The job names no key, so rows are compared by their places.', 'WARNING' FROM s WHERE k % 3 = 0
UNION ALL SELECT job, 'tolerance', 'Tolerance of ''price'' must be a whole number from 0 to 18.', 'ERROR' FROM s WHERE k % 4 = 0"""

_PAIRS = f"""{ORDERS}, c AS (SELECT {_COUNTS}),
cust AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0) AS bad FROM customer),
parts AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_partkey % 3 = 0 OR (p_partkey % 13 = 0 AND lower(p_brand) <> p_brand)) AS bad FROM part),
supp AS (SELECT count(*) AS n, count(*) FILTER (WHERE s_suppkey % 17 <> 16) AS nd, count(*) FILTER (WHERE s_suppkey % 17 <> 16 AND s_suppkey % 9 = 0) AS bad FROM supplier),
sums AS (SELECT 'orders' AS result_name, total_prod, total_dev, matched_passed, matched_failed, extra_dev, missing_dev, CAST(NULL AS VARCHAR) AS error FROM c
UNION ALL SELECT 'customer', n, n, n - bad, bad, 0, 0, NULL FROM cust
UNION ALL SELECT 'part', n, n, n - bad, bad, 0, 0, NULL FROM parts
UNION ALL SELECT 'supplier', n, nd, nd - bad, bad, 0, n - nd, NULL FROM supp
UNION ALL SELECT 'broken', NULL, NULL, NULL, NULL, NULL, NULL, 'input cannot be read')"""

_LOG = "WITH log AS (SELECT event_id AS job_id, user_id AS batch_id, ts AS created_at, ['SUCCESS','FAILED','RUNNING','SUCCESS','SKIPPED','SUCCESS','CANCELLED','SUCCESS'][event_id % 31 % 8 + 1] AS status, CAST(event_id % 101 AS DOUBLE) AS progress FROM events)"
_SUPPLIER_TEXT = "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier"

_TEXT = """CASE o_orderkey % 5 WHEN 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS VARCHAR) WHEN 1 THEN '1,' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '.555' WHEN 2 THEN 'N/A' WHEN 3 THEN ''
  ELSE '-0.00' || CAST(o_orderkey % 10 AS VARCHAR) END"""
_ROUND = lambda n: f"coalesce(CAST(CAST(round(TRY_CAST(nullif(replace(t, ',', ''), '') AS DECIMAL(38,18)), {n}) AS DECIMAL(38,{n})) AS VARCHAR), t)"

DOUBLES = tuple(f"0.{'0' * (e - len(k))}{k}" for k in ("1", "2", "35") for e in (7, 12, 20))

SQL = {
    "value_differences": f"{ORDERS} SELECT * FROM cells",
    "missing_extra": f"{ORDERS} SELECT * FROM sides",
    "pass_report": f"{ORDERS} SELECT o_orderkey, {_WIDE} FROM f",
    "pass_report_failed": f"{ORDERS} SELECT o_orderkey, {_WIDE} FROM f WHERE failed",
    "match_summary": f"{ORDERS} SELECT {_COUNTS}",
    "diffs_by_column": f'{ORDERS} SELECT "column", count(*) AS differences FROM cells GROUP BY 1',
    "duplicate_groups": f'{LINES} SELECT l_orderkey, l_linenumber, count(*) AS "count" FROM prod GROUP BY 1, 2 HAVING count(*) > 1',
    "duplicate_summary": f"""{LINES}, a AS ({_DUP.format('prod')}), b AS ({_DUP.format('dev')}) SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_linenumber, b.l_linenumber) AS l_linenumber,
      a.l_orderkey IS NOT NULL AS duplicate_in_prod, b.l_orderkey IS NOT NULL AS duplicate_in_dev FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""",
    "seq_alignment": f"{LINES} {_SIDES}",
    "seq_value_differences": LINES + _LINE_CELLS,
    "key_alignment": f"{LINES} {_SIDES}",
    "keyed_tables": f"""{ORDERS}, r AS (SELECT "column" AS result, count(*) AS rows FROM cells GROUP BY 1 UNION ALL SELECT side, count(*) FROM sides GROUP BY 1) SELECT result, rows, CAST(0 AS BIGINT) AS exchanges FROM r""",
    "dealt_scan": "SELECT l_orderkey, count(*) AS lines, CAST(1 AS BIGINT) AS exchanges FROM lineitem WHERE l_quantity > 10 GROUP BY 1",
    "key_states": f"""{LINES}, k AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS o, coalesce(a.np, 0) AS np, coalesce(b.nd, 0) AS nd, a.rows = b.rows AS same FROM
      (SELECT l_orderkey, l_linenumber, count(*) AS np, string_agg({_ROW}, chr(10) ORDER BY {_ROW}) AS rows FROM prod GROUP BY ALL) a FULL JOIN
      (SELECT l_orderkey, l_linenumber, count(*) AS nd, string_agg({_ROW}, chr(10) ORDER BY {_ROW}) AS rows FROM dev GROUP BY ALL) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber)
      SELECT CASE WHEN nd = 0 THEN 'missing' WHEN np = 0 THEN 'extra' WHEN same THEN 'settled' ELSE 'open' END AS state, count(*) AS keys, CAST(sum(np) AS BIGINT) AS rows_prod, CAST(sum(nd) AS BIGINT) AS rows_dev FROM k GROUP BY 1""",
    "hash_first_differences": f"""{LINES}, s AS ({_SIDES}), x AS ({_LINE_CELLS}), r AS (SELECT "column" AS result, count(*) AS rows FROM x GROUP BY 1 UNION ALL SELECT side, count(*) FROM s WHERE side <> 'Matched' GROUP BY 1
      UNION ALL SELECT CASE WHEN p.l_returnflag = d.l_returnflag THEN 'flag Pass' ELSE 'flag Fail' END, count(*) FROM p JOIN d ON {_ON} GROUP BY 1) SELECT path, result, rows FROM r, (VALUES ('digests'), ('cells')) AS v(path)""",
    "seq_counted_alignment": f"{LINES}, s AS ({_SIDES}) SELECT side, count(*) AS rows, CAST(sum(seq) AS BIGINT) AS seq_sum FROM s GROUP BY side",
    "schema_differences": f"{ORDERS} SELECT * FROM fields",
    "schema_items": f"{ORDERS} SELECT side, field AS fields, CAST(0 AS INT) AS more FROM fields",
    "schema_audit": """WITH p AS (SELECT * FROM orders WHERE o_orderkey % 97 <> 0), d AS (SELECT * FROM orders WHERE o_orderkey % 89 <> 0), n AS (SELECT (SELECT count(*) FROM p) AS a, (SELECT count(*) FROM d) AS b)
      SELECT field, pt AS prod_type, dt AS dev_type, status, CAST(CASE k WHEN 2 THEN a + b WHEN 1 THEN a WHEN 0 THEN b ELSE 0 END AS BIGINT) AS filled FROM n, (VALUES
      ('o_orderkey', 'int64', 'int64', 'ok', 2), ('o_custkey', 'int64', 'string', 'type mismatch', 2), ('o_orderstatus', 'string', 'string', 'partition mismatch', 2), ('o_totalprice', 'decimal(18,4)', 'decimal(18,4)', 'ok', 2),
      ('o_orderdate', 'timestamp', 'timestamp', 'ok', 2), ('o_orderpriority', 'string', NULL, 'missing', 1), ('o_priority', NULL, 'string', 'extra', 0), ('o_missing', NULL, NULL, 'missing key', -1)) AS v(field, pt, dt, status, k)""",
    "null_rates": f'{_CUSTOMER_PROFILE} SELECT side, "column", null_rate FROM pr',
    "distinct_counts": f'{_PART_PROFILE} SELECT side, "column", distinct_count FROM pr',
    "numeric_stats": f'{_CUSTOMER_PROFILE} SELECT side, "column", lo AS "min", hi AS "max", mean, std, k AS "count" FROM pr WHERE is_num',
    "type_mismatches": f"{_CUSTOMER_PROFILE} {_MISMATCH.format('pr')} UNION ALL SELECT * FROM ({_PART_PROFILE} {_MISMATCH.format('pr')})",
    "quality_report": _CUSTOMER_PROFILE + ' SELECT a."column", a.null_rate AS null_rate_prod, b.null_rate AS null_rate_dev, a.distinct_count AS distinct_count_prod, b.distinct_count AS distinct_count_dev, '
      + ", ".join(f"{_NUM(c, s)} AS {n}_{side}" for c, n in (("lo", "min"), ("hi", "max"), ("mean", "mean"), ("std", "std")) for s, side in (("a", "prod"), ("b", "dev")))
      + ", CASE WHEN a.is_num <> b.is_num THEN 'Yes' ELSE 'No' END AS type_mismatch FROM pr a JOIN pr b ON a.\"column\" = b.\"column\" AND a.side = 'prod' AND b.side = 'dev'",
    "profile_merge": """WITH o AS (SELECT o_orderstatus, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_totalprice, o_orderpriority FROM orders),
      l AS (UNPIVOT o ON o_orderkey, o_custkey, o_totalprice, o_orderpriority INTO NAME "column" VALUE v), c AS (SELECT *, TRY_CAST(v AS DOUBLE) AS n FROM l),
      p AS (SELECT o_orderstatus, "column", count(n) > 0 AS is_num, min(n) AS lo, max(n) AS hi, avg(n) AS m, stddev_samp(n) AS s, count(n) AS k FROM c GROUP BY ALL UNION ALL SELECT 'all', "column", count(n) > 0, min(n), max(n), avg(n), stddev_samp(n), count(n) FROM c GROUP BY ALL)
      SELECT o_orderstatus, "column", CAST(0 AS DOUBLE) AS null_rate, round(lo, 4) AS "min", round(hi, 4) AS "max", round(m, 4) AS mean, round(s, 4) AS std, CASE WHEN is_num THEN k END AS "count", CASE WHEN o_orderstatus = 'all' THEN TRUE END AS near FROM p""",
    "approx_distinct_error": "SELECT c AS \"column\", n AS exact, TRUE AS within FROM (SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS c, unnest([count(DISTINCT p_partkey), count(DISTINCT p_name), count(DISTINCT p_brand), count(DISTINCT p_type), count(DISTINCT p_size), count(DISTINCT p_retailprice)]) AS n FROM part)",
    "quality_switches": _CUSTOMER_PROFILE + ' SELECT a."column", a.null_rate AS null_rate_prod, b.null_rate AS null_rate_dev, CAST(NULL AS BIGINT) AS distinct_count_prod, CAST(NULL AS BIGINT) AS distinct_count_dev, '
      + ", ".join(f"CAST(NULL AS DOUBLE) AS {n}_{side}" for n in ("min", "max", "mean", "std") for side in ("prod", "dev"))
      + ", CASE WHEN a.is_num <> b.is_num THEN 'Yes' ELSE 'No' END AS type_mismatch FROM pr a JOIN pr b ON a.\"column\" = b.\"column\" AND a.side = 'prod' AND b.side = 'dev'",
    "control_batch": f"""{ORDERS}, own AS (SELECT x_o_custkey::INT + x_o_totalprice::INT + x_o_orderdate::INT AS n FROM m),
      cust AS (SELECT (c_custkey % 5 = 0)::INT + (c_custkey % 7 = 0)::INT AS n FROM customer)
      SELECT 'orders' AS result_name, (SELECT count(*) FROM prod) AS total_prod, (SELECT count(*) FROM own WHERE n = 0) AS matched_passed, (SELECT count(*) FROM own WHERE n > 0) AS matched_failed,
        (SELECT count(*) FROM dev) AS total_dev, 'o_totalprice' AS tolerances, CAST(NULL AS VARCHAR) AS error, (SELECT CAST(sum(n) AS BIGINT) FROM own) AS value_differences, CAST(NULL AS BIGINT) AS pass_report, CAST(2 AS BIGINT) AS tolerance
      UNION ALL SELECT 'customer', count(*), count(*) FILTER (WHERE n = 0), count(*) FILTER (WHERE n > 0), count(*), '', NULL, CAST(sum(n) AS BIGINT), count(*), NULL FROM cust
      UNION ALL SELECT 'broken', NULL, NULL, NULL, NULL, NULL, 'no input nowhere', NULL, NULL, NULL""",
    "run_summary": f"{_PAIRS} SELECT result_name, matched_failed, FALSE AS overall_pass, 'r1' AS run_id FROM sums",
    "audit_log": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS capability, count(*) AS events FROM events GROUP BY 1, 2",
    "ignored_fields": f"{ORDERS} SELECT \"column\", count(*) AS n FROM cells WHERE \"column\" <> 'o_totalprice' GROUP BY 1 UNION ALL SELECT field, \"count\" FROM fields WHERE field <> 'o_priority'",
    "missing_keys": f"""{ORDERS} SELECT 'Used Keys' AS setting, 'o_orderkey' AS "value" UNION ALL SELECT 'Missing Key Columns', 'o_priority' UNION ALL SELECT 'Matched Rows', CAST(count(*) AS VARCHAR) FROM m
      UNION ALL SELECT 'Only in Prod', CAST(count(*) AS VARCHAR) FROM sides WHERE side = 'Missing in Dev'""",
    "empty_side": f"""{ORDERS}, z AS (SELECT CAST(0 AS BIGINT) AS z) SELECT 'dev' AS empty, (SELECT count(*) FROM prod) AS total_prod, z AS total_dev, (SELECT count(*) FROM prod) AS missing_dev, z AS extra_dev, z AS matched_passed, z AS matched_failed, z AS total_diffs FROM z
      UNION ALL SELECT 'prod', z, (SELECT count(*) FROM dev), z, (SELECT count(*) FROM dev), z, z, z FROM z""",
    "rule_issues": f"""{ORDERS}, c AS (SELECT (SELECT count(*) FROM cells) AS total_diffs, (SELECT count(*) FROM sides WHERE side = 'Extra in Dev') AS extra_dev),
      r AS (SELECT ['extra_dev', 'nothing', 'total_diffs'][s_suppkey % 3 + 1] AS metric, ['>', '>=', '=>', '<'][s_suppkey % 4 + 1] AS op, ['0', 'x', '1e2', NULL, '-1'][s_suppkey % 5 + 1] AS t, s_suppkey % 7 = 2 AS loud FROM supplier),
      p AS (SELECT *, CASE WHEN metric = 'nothing' THEN 'unknown metric' WHEN op = '=>' THEN 'unknown operator' WHEN t = 'x' THEN 'threshold is not a number' END AS fault, CASE WHEN t = 'x' THEN NULL ELSE CAST(coalesce(t, '0') AS DOUBLE) END AS n,
        CASE metric WHEN 'extra_dev' THEN extra_dev ELSE total_diffs END AS v FROM r, c),
      x AS (SELECT coalesce(fault, CASE WHEN loud THEN 'unknown level' END) AS problem FROM p
      UNION ALL SELECT 'fires: ' || op || ' ' || CAST(CAST(n AS INT) AS VARCHAR) FROM p WHERE fault IS NULL AND CASE op WHEN '>' THEN v > n WHEN '>=' THEN v >= n ELSE v < n END)
      SELECT problem, count(*) AS rules FROM x WHERE problem IS NOT NULL GROUP BY 1""",
    "step_switches": f"""{ORDERS}, e AS (SELECT count(*) FILTER (WHERE x_o_custkey) + count(*) FILTER (WHERE x_o_orderstatus) + count(*) FILTER (WHERE p_o_totalprice <> d_o_totalprice) + count(*) FILTER (WHERE x_o_orderdate) AS cells FROM m)
      SELECT capability, event, cells FROM e, (VALUES ('schema', 'DONE'), ('tolerance', 'SKIPPED'), ('comparison', 'DONE'), ('alerts', 'SKIPPED')) AS v(capability, event)""",
    "row_counts": "SELECT 'orders' AS name, count(*) AS rows, count(o_orderkey) AS scanned FROM orders UNION ALL SELECT 'lineitem', count(*), count(l_orderkey) FROM lineitem UNION ALL SELECT 'events', count(*), count(event_id) FROM events",
    "header_columns": " UNION ALL ".join(f"SELECT '{t}' AS path, '{c}' AS name, count({c}) AS filled FROM {t}" for t, cs in (("orders", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")), ("customer", _CUSTOMER_COLUMNS), ("part", _PART_COLUMNS)) for c in cs),
    "ordered_results": f"{ORDERS} SELECT 'value_differences' AS result, count(*) AS rows, CAST(0 AS BIGINT) AS out_of_order FROM cells UNION ALL SELECT 'count_differences', count(*), 0 FROM sides",
    "tolerance_rules": f"{TOLERANCE} SELECT prod_name, field, decimals, count(*) AS rules FROM rr WHERE reason IS NULL GROUP BY 1, 2, 3",
    "tolerance_rejects": f"{TOLERANCE} SELECT reason, count(*) AS rules FROM rr WHERE reason IS NOT NULL GROUP BY 1",
    "pair_tolerance": f"""{TOLERANCE}, x AS (SELECT field, CASE WHEN reason IS NULL THEN decimals END AS decimals, coalesce(reason, CASE WHEN field IN ('c_7', 'c_8') THEN 'ignored' WHEN CAST(substr(field, 3) AS INT) >= 40 THEN 'absent from PROD'
      WHEN CAST(substr(field, 3) AS INT) < 5 THEN 'absent from DEV' END) AS reason FROM rr WHERE prod_name = 'MACHINERY') SELECT field, decimals, reason, count(*) AS rules FROM x GROUP BY 1, 2, 3""",
    "alerts": ALERTS,
    "row_order_diff": """WITH p AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_id, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier),
      d AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_id, CASE WHEN s_suppkey % 9 = 0 THEN s_name || ' Ltd' ELSE s_name END AS s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier WHERE s_suppkey % 17 <> 16)
      SELECT p.row_id, 's_name' AS "column", p.s_name AS prod_value, d.s_name AS dev_value FROM p JOIN d ON p.row_id = d.row_id WHERE p.s_name <> d.s_name
      UNION ALL SELECT p.row_id, 's_nationkey', p.s_nationkey, d.s_nationkey FROM p JOIN d ON p.row_id = d.row_id WHERE p.s_nationkey <> d.s_nationkey""",
    "chunk_counts": "SELECT CAST(floor(rn / 1000) AS BIGINT) AS chunk_id, count(*) AS rows, min(event_id) AS first_event, max(event_id) AS last_event FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events) GROUP BY 1",
    "preflight_issues": _SUPPLIER_ISSUES,
    "active_pairs": """SELECT p_brand AS result_name, p_name AS prod, p_type AS dev, CASE WHEN p_partkey % 2 = 0 THEN 'p_partkey,p_size' ELSE 'p_partkey' END AS keys, CASE WHEN p_partkey % 3 = 0 THEN 'a,b' ELSE '' END AS ignored, TRUE AS include_pass, count(*) AS pairs
      FROM part WHERE p_partkey % 7 IN (0, 2, 3, 5) GROUP BY ALL""",
    "control_issues": """WITH i AS (SELECT p_partkey AS r, 'files path' AS field, 'is empty' AS message FROM part WHERE p_partkey % 11 = 0 UNION ALL SELECT p_partkey, 'dev file name', 'is empty' FROM part WHERE p_partkey % 5 = 0
      UNION ALL SELECT p_partkey, 'prod file name', 'file not found: in/b.csv' FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 11 <> 0) SELECT field, message, count(*) AS issues, CAST(sum(r) AS BIGINT) AS row_sum FROM i GROUP BY 1, 2""",
    "batch_summary": f"{_PAIRS} SELECT * FROM sums",
    "overall_pass": f"{_PAIRS} SELECT count(*) AS pairs, bool_and(coalesce(matched_failed, 0) = 0 AND error IS NULL AND coalesce(missing_dev, 0) = 0 AND coalesce(extra_dev, 0) = 0) AS overall_pass FROM sums",
    "run_history": f"{_LOG} SELECT job_id, batch_id, status FROM log WHERE status = 'FAILED' ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 10",
    "batch_totals": f"""{_LOG}, s AS (SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE status IN ('SUCCESS', 'FAILED', 'CANCELLED', 'SKIPPED')) AS completed, count(*) FILTER (WHERE status = 'SUCCESS') AS successful,
      count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'CANCELLED') AS cancelled, round(avg(progress), 1) AS progress FROM log GROUP BY 1)
      SELECT batch_id, total, completed, successful, failed, progress, CASE WHEN completed < total THEN 'RUNNING' WHEN cancelled > 0 THEN 'CANCELLED' WHEN failed = 0 THEN 'SUCCESS' WHEN successful > 0 THEN 'PARTIAL_SUCCESS' ELSE 'FAILED' END AS status FROM s""",
    "settings": f"""{ORDERS}, c AS (SELECT {_COUNTS}), v AS (SELECT unnest([
      {{'setting': 'Used Keys', 'value': 'o_orderkey'}}, {{'setting': 'Missing Key Columns', 'value': '-'}}, {{'setting': 'Ignored Fields', 'value': '-'}}, {{'setting': 'Tolerance Applied', 'value': 'o_totalprice(2dp)'}},
      {{'setting': 'Duplicates in Prod', 'value': '0'}}, {{'setting': 'Duplicates in Dev', 'value': '0'}}, {{'setting': 'Using Sequence Index (_SEQ_)', 'value': 'False'}}, {{'setting': 'Extra Fields in Dev', 'value': 'o_priority'}},
      {{'setting': 'Missing Fields in Dev (Prod only)', 'value': 'o_orderpriority'}}, {{'setting': 'Total Prod Rows', 'value': CAST(total_prod AS VARCHAR)}}, {{'setting': 'Total Dev Rows', 'value': CAST(total_dev AS VARCHAR)}},
      {{'setting': 'Matched Rows', 'value': CAST(matched_passed + matched_failed AS VARCHAR)}}, {{'setting': 'Only in Prod', 'value': CAST(missing_dev AS VARCHAR)}}, {{'setting': 'Only in Dev', 'value': CAST(extra_dev AS VARCHAR)}},
      {{'setting': 'Total Cell Differences', 'value': CAST(total_diffs AS VARCHAR)}}, {{'setting': 'Matched Passed', 'value': CAST(matched_passed AS VARCHAR)}}, {{'setting': 'Matched Failed', 'value': CAST(matched_failed AS VARCHAR)}},
      {{'setting': 'Result Name', 'value': 'orders'}}]) AS s FROM c) SELECT s.setting AS setting, s.value AS "value" FROM v""",
    "audit_steps": f"""{ORDERS} SELECT capability, CAST(2 AS BIGINT) AS events, (SELECT count(*) FROM cells WHERE "column" = 'o_totalprice') AS rows FROM
      (VALUES ('tolerance'), ('comparison'), ('duplicate'), ('schema'), ('data_quality'), ('alerts'), ('late_orders'), ('broken')) AS v(capability)""",
    "custom_check": f"{ORDERS} SELECT o_orderkey, prod_value, dev_value FROM cells WHERE \"column\" = 'o_totalprice'",
    "rounding": f"SELECT o_orderkey, {_ROUND(0)} AS r0, {_ROUND(2)} AS r2, {_ROUND(4)} AS r4, CASE WHEN regexp_full_match(t, '{NUMBER}') THEN TRY_CAST(t AS DOUBLE) END AS number FROM (SELECT o_orderkey, {_TEXT} AS t FROM orders)",
    "double_text": f"""SELECT o_orderkey, v AS "value", CASE WHEN k = 2 THEN v ELSE NULL END AS short, v = CAST(CAST(o_orderkey AS BIGINT) * 10000000 AS VARCHAR) AS same FROM (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderkey % 4 AS k, CASE o_orderkey % 4
      WHEN 0 THEN {_LIST(DOUBLES)}[o_orderkey % 9 + 1] WHEN 1 THEN CAST(CAST(o_orderkey AS BIGINT) * 10000000 AS VARCHAR)
      WHEN 2 THEN regexp_replace(CAST(CAST((o_orderkey - 9000) / 8.0 AS DECIMAL(18,3)) AS VARCHAR), '\\.?0+$', '') ELSE CAST(o_orderkey AS VARCHAR) END AS v FROM orders)""",
    "case_twins": "SELECT CAST(s_suppkey AS VARCHAR) AS \"ID\", 'id~2' AS \"column\", s_name AS prod_value, s_name || '!' AS dev_value FROM supplier WHERE s_suppkey % 9 = 0",
    "clean_names": "SELECT '_' || p_type || '_' || p_name || '_' AS name, count(*) AS rows FROM part GROUP BY 1",
    "csv_roundtrip": """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || ', "' || p_brand || '"' AS p_name, CAST(p_size AS VARCHAR) AS p_size FROM part""",
    "delimited_roundtrip": _SUPPLIER_TEXT,
    "delimited_mixed": _SUPPLIER_TEXT,
    "mixed_formats": f"WITH {CUSTOMER} SELECT p.c_custkey, 'c_acctbal' AS \"column\", p.c_acctbal AS prod_value, d.c_acctbal AS dev_value FROM prod p JOIN dev d ON p.c_custkey = d.c_custkey WHERE p.c_acctbal <> d.c_acctbal UNION ALL SELECT p.c_custkey, 'c_mktsegment', p.c_mktsegment, d.c_mktsegment FROM prod p JOIN dev d ON p.c_custkey = d.c_custkey WHERE p.c_mktsegment <> d.c_mktsegment",
    "fixed_width_late": "SELECT CASE WHEN c_custkey = 7 THEN 'k' WHEN c_custkey >= 120 THEN CAST(c_custkey AS VARCHAR) || '-wider' ELSE CAST(c_custkey AS VARCHAR) END AS k, CASE WHEN c_custkey = 7 THEN 'name' ELSE c_name END AS name, CASE WHEN c_custkey = 7 THEN 'nation' ELSE CAST(c_nationkey AS VARCHAR) END AS nation FROM customer",
    "delimiter_detect": f"SELECT unnest({_LIST(['|', ',', ';', '~', '^'])} || [chr(9)]) AS written, unnest({_LIST(['|', ',', ';', '~', '^'])} || [chr(9)]) AS delimiter",
    "encoding_detect": "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, '“é€ ' || s_name AS s_name FROM supplier",
    "fixed_width": _SUPPLIER_TEXT,
    "layout_mix": _SUPPLIER_TEXT,
    "fixed_width_trailer": f"SELECT 'kept' AS reason, * FROM ({_SUPPLIER_TEXT}) UNION ALL SELECT 'text between columns', 'TOTAL NUMBER OF SUPPLIERS IN THIS FILE: ' || count(*), '', '' FROM supplier",
    "rejected_rows": f"""WITH s AS ({_SUPPLIER_TEXT}), n AS (SELECT *, CAST(s_suppkey AS BIGINT) % 10 AS k FROM s),
      l AS (SELECT *, CAST(1 + sum(CASE WHEN k IN (3, 7) THEN 1 ELSE 2 END) OVER (ORDER BY CAST(s_suppkey AS BIGINT)) AS BIGINT) AS line FROM n)
      SELECT CASE WHEN k = 3 THEN 'too many cells' ELSE 'too few cells' END AS reason, s_suppkey, s_suppkey || CASE WHEN k = 3 THEN ',' || s_name || ',' || s_nationkey || ',EXTRA' ELSE '' END AS "text", line FROM l WHERE k IN (3, 7)
      UNION ALL SELECT 'kept', s_suppkey, CASE WHEN k = 7 THEN '' ELSE s_name || chr(10) || 'branch' END, CAST(0 AS BIGINT) FROM l WHERE k <> 3""",
    "quoted_breaks": """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN chr(10) || '"second", line' WHEN 1 THEN ', and' ELSE '' END AS p_name, CAST(p_size AS VARCHAR) AS p_size FROM part""",
    "blank_separated": _SUPPLIER_TEXT,
    "parquet_scan": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 49",
    "inventory": """SELECT TRUE AS is_parquet, 'o_orderstatus,y' AS partitions, '.parquet' AS ending, count(DISTINCT (o_orderstatus, year(o_orderdate))) AS folders FROM orders
      UNION ALL SELECT FALSE, '', '.csv', 1 UNION ALL SELECT TRUE, '', '', 1 UNION ALL SELECT FALSE, '', '', 1""",
    "stored_results": f"{ORDERS} SELECT 'value_differences' AS result, count(*) AS rows FROM cells UNION ALL SELECT 'count_differences', count(*) FROM sides UNION ALL SELECT 'schema_differences', count(*) FROM fields",
}
