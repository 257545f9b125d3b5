"""Inputs derived from the supplied tables, as SQL that Spark and DuckDB share.

The raw texts hold none of the wordings that the rules look for, so logs,
prompts, code, symbols, diffs and session entries are rendered from other
columns of whole tables.  ``{div}`` is the dialect's integer division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NL = "chr(10)"

LOGS = """
SELECT doc_id, line_no, CASE {div}(line_no - 1, 4) % 13
  WHEN 0 THEN 'Processing item ' || CAST(line_no AS VARCHAR(20))
  WHEN 1 THEN 'heartbeat ok'
  WHEN 2 THEN 'WARN slow query took ' || CAST(line_no AS VARCHAR(20)) || 'ms'
  WHEN 3 THEN CASE WHEN line_no % 4 = 1 THEN 'ERROR: step ' || CAST(line_no AS VARCHAR(20)) ELSE '    at run (main.js:' || CAST(line_no AS VARCHAR(20)) || ':1)' END
  WHEN 4 THEN ''
  WHEN 5 THEN '2024-01-15T10:23:45.123Z request by ' || event_type
  WHEN 6 THEN '[2024-01-15 10:23:45] tick'
  WHEN 7 THEN chr(27) || '[31m[10:23:45] poll' || chr(27) || '[0m'
  WHEN 8 THEN 'warning: disk at ' || CAST(line_no % 3 AS VARCHAR(20)) || '%'
  WHEN 9 THEN CASE WHEN line_no % 4 = 1 THEN repeat('x', 600) ELSE 'done' || '   ' END
  WHEN 10 THEN '[1705312345] beat at 10:23:45.5'
  WHEN 11 THEN event_type
  ELSE 'src/main.rs:10:5 note' END AS line
FROM (SELECT {div}(event_id, 400) AS doc_id, event_type,
  CAST(row_number() OVER (PARTITION BY {div}(event_id, 400) ORDER BY event_id) AS BIGINT) AS line_no FROM events)
"""

PROMPTS = f"""
SELECT conv_id * 1000 + turn AS prompt_id, CASE conv_id % 8
  WHEN 0 THEN 'Could you please review this in order to help? ' || text || ' Thanks in advance.'
  WHEN 1 THEN 'I think that the configuration is able to load due to the fact that it is cached!! ' || text
  WHEN 2 THEN 'As I mentioned before, please note that ' || text || {NL} || {NL} || {NL} || {NL} || 'thanks'
  WHEN 3 THEN 'Basically, it is just really simple to initialize the database and its dependencies. ' || text
  WHEN 4 THEN '<keep>Could you please keep   this</keep> Could you please go on,, and do it ??? ' || text
  WHEN 5 THEN 'Use ```please  code``` and `just  this` in a way that works ....... ' || text
  WHEN 6 THEN '@scope:fn @scope:symbol:foo.bar @optimize would you kindly check @scope:fn @scope:nope ' || text
  ELSE '@compress  ' || text || ' @scope:diff @scope:file:a-b' END AS text
FROM conversations
"""

CODE = f"""
SELECT p_partkey AS doc_id, 'src/' || replace(lower(p_brand), '#', '_') || '/part_' || CAST(p_partkey AS VARCHAR(20)) || CASE p_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.go' END AS rel_path,
  CASE WHEN p_partkey % 5 = 0 THEN '// head' || {NL} || {NL} ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN 'x = 1' || {NL} ELSE '' END
  || 'import a from "x";' || {NL} || 'import b;' || {NL} || '  import a from "x";  ' || {NL} || '/* block' || {NL} || ' more */' || {NL}
  || 'const u = "http://x"; // note ' || CAST(p_size AS VARCHAR(20)) || {NL} || '  console.log(' || CAST(p_partkey AS VARCHAR(20)) || ')' || {NL}
  || 'function camelName' || CAST(p_partkey AS VARCHAR(20)) || '() {{' || {NL} || '  return 1;   ' || {NL} || '}}' || {NL} || {NL} || {NL} || {NL}
  || '  return 1;' || {NL} || '// only ' || p_name || {NL} || CASE p_partkey % 4 WHEN 0 THEN 'ab' || {NL} || 'ab' ELSE 'snake_case_' || CAST(p_size AS VARCHAR(20)) END AS body, CAST(p_size AS BIGINT) * 997 AS size_bytes
FROM part
"""

SYMBOLS = """
SELECT c.rel_path, c.doc_id, k.k AS symbol_no, CASE k.k WHEN 0 THEN 'Widget' || CAST(c.doc_id AS VARCHAR(20)) WHEN 1 THEN 'render' WHEN 2 THEN 'renderAll' ELSE 'MAX_SIZE' END AS name,
  CASE k.k WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 2 THEN 11 ELSE 25 END AS kind_code, k.k * 3 AS start_line, CASE k.k WHEN 0 THEN 40 ELSE k.k * 3 + 5 END AS end_line,
  CASE WHEN k.k % 2 = 0 THEN '  sig ' || CAST(k.k AS VARCHAR(20)) ELSE '' END AS signature
FROM code c, (SELECT CAST(0 AS BIGINT) AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k
"""

DIFFS = f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o_orderkey, l_linenumber, part, line) AS BIGINT) AS line_no, line FROM (
  SELECT o_custkey AS doc_id, o_orderkey, CAST(-1 AS BIGINT) AS l_linenumber, 0 AS part, 'diff --git a/f' || CAST(o_orderkey AS VARCHAR(20)) || ' b/f' AS line FROM orders
  UNION ALL SELECT o_custkey, o_orderkey, CAST(0 AS BIGINT), 0, '+++ b/f' || CAST(o_orderkey AS VARCHAR(20)) FROM orders
  UNION ALL SELECT o_custkey, o_orderkey, CAST(l_linenumber AS BIGINT), 1, '@@ -' || CAST(l_linenumber AS VARCHAR(20)) || ' @@' FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  UNION ALL SELECT o_custkey, o_orderkey, CAST(l_linenumber AS BIGINT), 2, '+ ' || l_returnflag || l_linestatus || ' part ' || CAST(l_partkey AS VARCHAR(20)) FROM orders JOIN lineitem ON o_orderkey = l_orderkey) x
"""

ENTRIES = """
SELECT event_id AS entry_id, user_id AS session, ts, 'file:' || event_type AS key, CAST(event_id % 97 AS BIGINT) AS context_tokens, CAST(event_id % 101 AS BIGINT) AS total_tokens, CAST(event_id % 7 - 2 AS BIGINT) AS tokens_saved FROM events
"""


def _divided(sql: str, spark: bool) -> str:
    """``{div}(a, b)`` as ``(a div b)`` or ``(a // b)``."""
    import re

    return re.sub(r"\{div\}\(([^()]*(?:\([^()]*\))?[^(),]*), (\d+)\)", rf"((\1) {'div' if spark else '//'} \2)", sql).replace("{{", "{").replace("}}", "}")


def sql(text: str, spark: bool) -> str:
    return _divided(text, spark).strip().replace("VARCHAR(20)", "STRING" if spark else "VARCHAR")


def view(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql(text, True))
