"""All queries of the library, by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextlake.functions.text import percent_saved, rough_tokens
from contextlake.operators import code, diffs, keywords, logs, prose, repomap, scopes, session, symbols, tokens, vectors
from contextlake.sources import derived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def replaced(column: str, rules: list[tuple[str, str]]) -> str:
    """Nested DuckDB replacements of (pattern, replacement)."""
    for pattern, to in rules:
        column = f"regexp_replace({column}, {_lit(pattern)}, {_lit(to.replace('$1', chr(92) + '1'))}, 'g')"
    return column


def trimmed(column: str) -> str:
    return rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"


def duck(text: str) -> str:
    return derived.sql(text, False)


ROUGH = "CAST(ceil(length({0}) / 4.0) AS BIGINT)"

# --- inputs


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.view(spark, sf_dir, derived.LOGS, "events")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.view(spark, sf_dir, derived.PROMPTS, "conversations")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.view(spark, sf_dir, derived.CODE, "part")


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    code_files(spark, sf_dir).createOrReplaceTempView("code")
    return derived.view(spark, sf_dir, derived.SYMBOLS)


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.view(spark, sf_dir, derived.DIFFS, "orders", "lineitem")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.view(spark, sf_dir, derived.ENTRIES, "events")


L, P, C, D, E = (f"({duck(x)})" for x in (derived.LOGS, derived.PROMPTS, derived.CODE, derived.DIFFS, derived.ENTRIES))
WITH_SYMBOLS = f"WITH code AS {C}, symbols AS ({duck(derived.SYMBOLS)})"
SPLIT = "(SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(body, chr(10)) AS l FROM {0}))"

# --- tokens and costs


@query("token_rough_count", f"SELECT doc_id, {ROUGH.format('text')} AS tokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", rough_tokens(F.col("text")).alias("tokens"))


_MODEL_ROWS = ", ".join(f"({_lit(m)}, {_lit(e)}, {_lit(a)}, {p!r})" for m, e, a, p in tokens.MODELS)


@query(
    "token_cost_by_model",
    f"""SELECT doc_id, model, encoding, accuracy, round({ROUGH.format('text')} * price, 9) AS cost FROM documents
    CROSS JOIN (VALUES {_MODEL_ROWS}, ('other', 'cl100k_base', 'approximate', 5e-6)) AS m(model, encoding, accuracy, price)""",
)
def _(spark, d):
    names = F.array(*[F.lit(m[0]) for m in tokens.MODELS], F.lit("other"))
    docs = table(spark, d, "documents").select("doc_id", rough_tokens(F.col("text")).alias("n"), F.explode(names).alias("model"))
    return tokens.with_model(docs).select("doc_id", "model", "encoding", "accuracy", F.round(tokens.cost(F.col("n"), F.col("price")), 9).alias("cost"))


@query(
    "percent_saved_report",
    rf"""SELECT doc_id, before, after, CASE WHEN before > 0 THEN CAST(floor(100.0 * (before - after) / before + 0.5) AS BIGINT) ELSE 0 END AS percent
    FROM (SELECT doc_id, {ROUGH.format('text')} AS before, {ROUGH.format(replaced('text', [('[aeiou]', '')]))} AS after FROM documents)""",
)
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", rough_tokens(F.col("text")).alias("before"), rough_tokens(F.regexp_replace("text", "[aeiou]", "")).alias("after"))
    return docs.withColumn("percent", percent_saved(F.col("before"), F.col("after")))


@query("token_cost_text")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", rough_tokens(F.col("text")).alias("n"), F.lit("gpt-4o").alias("model"))
    return tokens.with_model(docs).select("doc_id", tokens.cost_text(tokens.cost(F.col("n"), F.col("price"))).alias("cost"))


# --- prose


def _pack(name: str, rules: list[tuple[str, str]]) -> None:
    @query(f"prose_{name}", f"SELECT prompt_id, {replaced('text', rules)} AS text FROM {P}")
    def _(spark, d):
        return prompts(spark, d).select("prompt_id", prose.fold(F.col("text"), rules).alias("text"))


for _name, _rules in {**prose.PACKS, "punctuation": prose.PUNCTUATION, "whitespace": prose.WHITESPACE}.items():
    _pack(_name, _rules)


def _compressed(preset: str) -> None:
    @query(f"prose_compress_{preset}")
    def _(spark, d):
        return prose.compress(prompts(spark, d), preset=preset).select("prompt_id", "output", F.array_join("rules_applied", ",").alias("rules"), "original_tokens", "output_tokens", "percent_saved")


for _name in prose.PRESETS:
    _compressed(_name)


@query("prose_keep_regions", rf"SELECT prompt_id, array_to_string(regexp_extract_all(text, '(?is)<keep>(.*?)</keep>', 1), '|') AS kept, regexp_replace(text, '(?is)<keep>(.*?)</keep>', '\1', 'g') AS text FROM {P}")
def _(spark, d):
    p = prompts(spark, d)
    marked, spans = prose.stash(F.col("text"), prose.KEEP, "K", 1)
    return p.select("prompt_id", F.array_join(spans, "|").alias("kept"), prose.restore(marked, spans, "K").alias("text"))


# --- code


def _code(name: str, f, sql: str | None) -> None:
    @query(name, f"SELECT doc_id, {sql} AS body FROM {C}" if sql else None)
    def _(spark, d):
        return code_files(spark, d).select("doc_id", f(F.col("body")).alias("body"))


_LINES = "string_split(body, chr(10))"
_code("code_block_comments", code.strip_block_comments, replaced("body", [(code.BLOCK_COMMENT, "")]))
_code("code_console", code.drop_console_calls, rf"array_to_string(list_filter({_LINES}, lambda x: NOT regexp_matches(x, {_lit(code.CONSOLE)})), chr(10))")
_code("code_trailing_ws", code.right_trim_lines, replaced("body", [(r"(?m)[ \t]+$", "")]))
_code("code_blank_lines", code.collapse_blank_lines, "regexp_replace(body, '\\n{3,}', chr(10) || chr(10), 'g')")
_code(
    "code_inline_comments",
    code.strip_inline_comments,
    rf"""array_to_string(list_transform({_LINES}, lambda x: CASE WHEN regexp_matches(x, '^\s*//') THEN '' WHEN regexp_matches(x, '^(?:"[^"]*"|[^"/])*//') THEN regexp_replace(regexp_replace(x, '^((?:"[^"]*"|[^"/])*)//.*$', '\1'), '\s+$', '') ELSE x END), chr(10))""",
)


def _dedup_sql(eligible: str) -> str:
    return f"""SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS body FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, t, {eligible} ORDER BY line_no) AS r FROM (SELECT *, {trimmed('line')} AS t FROM {SPLIT.format(C)}))
    WHERE NOT ({eligible}) OR r = 1 GROUP BY doc_id"""


@query("code_imports_dedup", _dedup_sql("starts_with(t, 'import ')"))
def _(spark, d):
    return code_files(spark, d).select("doc_id", code.dedup_imports(F.col("body")).alias("body"))


@query("code_lines_dedup", _dedup_sql("length(t) >= 3"))
def _(spark, d):
    return code_files(spark, d).select("doc_id", code.dedup_lines(F.col("body")).alias("body"))


def _trim(preset: str) -> None:
    @query(f"code_trim_{preset}")
    def _(spark, d):
        return code.trim(code_files(spark, d), "body", preset).select("doc_id", "output", F.array_join("rules_applied", ",").alias("rules"), "original_tokens", "output_tokens", "percent_saved")


for _name in code.PRESETS:
    _trim(_name)

# --- logs

_TIMES = [(p, "[T]") for p in logs.TIMESTAMPS]


def _log_column(name: str, f, sql: str) -> None:
    @query(name, f"SELECT doc_id, line_no, {sql} AS line FROM {L}")
    def _(spark, d):
        return log_lines(spark, d).withColumn("line", f(F.col("line")))


_log_column("log_strip_ansi", logs.strip_ansi, replaced("line", [(logs.ANSI, "")]))
_log_column("log_timestamps", logs.mask_timestamps, replaced("line", _TIMES))
_log_column("log_truncate", lambda c: logs.truncate_long(c, 200), "CASE WHEN length(line) > 200 THEN substr(line, 1, 200) || ' …[+' || (length(line) - 200) || ' chars]' ELSE line END")

_FRAME = "(" + " OR ".join(f"regexp_matches(line, {_lit(p)})" for p in logs.FRAMES) + ")"
_T = trimmed("line")
MASKED = f"""(SELECT doc_id, line_no, line, f OR coalesce(lead(f) OVER w, false) OR (coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AND NOT b) AS protected
  FROM (SELECT *, CASE WHEN h OR f THEN true WHEN b THEN false END AS e FROM (SELECT *, {_FRAME} AS f, {_T} = '' AS b, regexp_matches({_T}, {_lit(logs.ERROR_HEAD)}) AS h FROM {L})) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))"""
SKELETON = r"regexp_replace({0}, '\d+', '#', 'g')"


def _runs_sql(key: str, ok: str, body: str) -> str:
    return f"""WITH m AS {MASKED}, k AS (SELECT *, {key} AS k, {ok} AS ok FROM m),
    g AS (SELECT *, CASE WHEN ok AND coalesce(lag(ok) OVER w, false) AND k = lag(k) OVER w THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY line_no) AS r, count(*) OVER (PARTITION BY doc_id, g) AS c FROM s)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS line_no, {body}"""


@query("log_stack_mask", f"SELECT doc_id, line_no, protected FROM {MASKED}")
def _(spark, d):
    return logs.protect_traces(log_lines(spark, d)).select("doc_id", "line_no", "protected")


def _masked(spark, d):
    return logs.protect_traces(log_lines(spark, d))


@query("log_collapse_duplicates", _runs_sql("line", "NOT protected", "CASE WHEN c >= 3 THEN line || '  (×' || c || ')' ELSE line END AS line, protected FROM r WHERE c < 3 OR r = 1"))
def _(spark, d):
    return logs.collapse_duplicates(_masked(spark, d))


@query("log_collapse_patterns", _runs_sql(SKELETON.format("line"), rf"NOT protected AND regexp_matches(line, '\d') AND {_T} <> ''", "CASE WHEN c >= 4 AND r = 2 THEN '  …[' || (c - 2) || ' similar lines collapsed]' ELSE line END AS line, protected FROM r WHERE c < 4 OR r IN (1, 2) OR r = c"))
def _(spark, d):
    return logs.collapse_patterns(_masked(spark, d))


@query(
    "log_warning_summary",
    f"""WITH m AS {MASKED}, k AS (SELECT *, NOT protected AND regexp_matches({_T}, {_lit(logs.WARN_HEAD)}) AS w, {SKELETON.format(_T)} AS s FROM m),
    r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, w, s) AS c, row_number() OVER (PARTITION BY doc_id, w, s ORDER BY line_no) AS r FROM k),
    x AS (SELECT *, w AND c > 3 AND r > 2 AS gone FROM r), g AS (SELECT doc_id, s, count(*) AS n, min(line_no) AS f FROM x WHERE gone GROUP BY doc_id, s),
    o AS (SELECT doc_id, 0 AS part, line_no AS o, line, protected FROM x WHERE NOT gone
      UNION ALL SELECT DISTINCT doc_id, 1, 0, '', false FROM g UNION ALL SELECT DISTINCT doc_id, 2, 0, '[Warnings summary]', false FROM g
      UNION ALL SELECT doc_id, 3, f, '  • "' || s || '" — +' || n || ' more similar', false FROM g)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, o) AS line_no, line, protected FROM o""",
)
def _(spark, d):
    return logs.summarise_warnings(_masked(spark, d))


@query(
    "log_first_last",
    f"""WITH m AS {MASKED}, k AS (SELECT *, CASE WHEN NOT protected AND {_T} <> '' THEN {SKELETON.format('line')} END AS s FROM m),
    r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c, row_number() OVER (PARTITION BY doc_id, s ORDER BY line_no) AS r FROM k),
    x AS (SELECT *, s IS NOT NULL AND c > 7 AND r > 3 AND r <= c - 3 AS gone FROM r), y AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS before FROM x)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS line_no, CASE WHEN gone THEN '  …[similar lines omitted]' ELSE line END AS line, protected FROM y WHERE NOT gone OR NOT before""",
)
def _(spark, d):
    return logs.keep_ends(_masked(spark, d), 3)


@query(
    "log_blank_lines",
    f"""WITH x AS (SELECT *, {_T} = '' AS b, coalesce(lag({_T} = '') OVER (PARTITION BY doc_id ORDER BY line_no), false) AS p FROM {MASKED})
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS line_no, line, protected FROM x WHERE NOT (b AND p)""",
)
def _(spark, d):
    return logs.collapse_blanks(_masked(spark, d))


def log_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return log_lines(spark, sf_dir).groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("text"))


def _log(preset: str) -> None:
    @query(f"log_compress_{preset}")
    def _(spark, d):
        return logs.compress(log_texts(spark, d), preset=preset)


for _name in logs.PRESETS:
    _log(_name)


@query("log_json_minify", "SELECT event_id, 'head' || chr(10) || '{\"k\":' || regexp_extract(props, '[0-9]+') || '}' || chr(10) || '{' AS text FROM events")
def _(spark, d):
    spread = F.concat(F.lit("head\n{\n  \"k\" : "), F.regexp_extract("props", "[0-9]+", 0), F.lit(".0\n}\n{"))
    return table(spark, d, "events").select("event_id", logs.minify_json(spread).alias("text"))


# --- keywords and context

_STOP = ", ".join(_lit(w) for w in keywords.STOPWORDS)


def _keyword_sql(source: str, key: str, text: str) -> str:
    plain = rf"regexp_replace(regexp_replace({text}, '```[\s\S]*?```', ' ', 'g'), '`[^`]*`', ' ', 'g')"
    inner, under = "regexp_matches(t, '^.+[A-Z]')", "contains(t, '_')"
    raw = f"(1 + CASE WHEN {inner} THEN 2 ELSE 0 END + CASE WHEN {under} THEN 2 ELSE 0 END + CASE WHEN regexp_matches(t, '^[A-Z]') THEN 1 ELSE 0 END)"
    one = f"CASE WHEN NOT {inner} AND NOT {under} AND length(t) <= 4 THEN greatest({raw} - 1, 1) ELSE {raw} END"
    return f"""SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, first_pos) AS rank FROM (
    SELECT {key}, lower(t) AS keyword, CAST(sum({one}) AS BIGINT) AS score, CAST(min(p) AS BIGINT) AS first_pos FROM (
    SELECT {key}, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS p FROM (SELECT {key}, regexp_extract_all({plain}, '{keywords.IDENTIFIER}') AS l FROM {source}))
    WHERE length(t) >= 3 AND lower(t) NOT IN ({_STOP}) GROUP BY ALL)"""


@query("keyword_scores", _keyword_sql("documents", "doc_id", "text"))
def _(spark, d):
    return keywords.extract(table(spark, d, "documents"))


@query("keyword_topn", f"SELECT prompt_id, keyword, rank FROM ({_keyword_sql(P, 'prompt_id', 'text')}) WHERE rank <= 5")
def _(spark, d):
    return keywords.extract(prompts(spark, d), "prompt_id").filter("rank <= 5").select("prompt_id", "keyword", "rank")


def _hits(spark, d):
    wanted = code_files(spark, d).select("doc_id", F.concat(F.lit("look at Widget"), F.col("doc_id").cast("string"), F.lit(" and part_"), F.col("doc_id").cast("string")).alias("text"))
    return keywords.file_hits(keywords.extract(wanted), code_files(spark, d), code_symbols(spark, d))


_HITS = f"""{WITH_SYMBOLS}, kw AS ({_keyword_sql("(SELECT doc_id, 'look at Widget' || doc_id || ' and part_' || doc_id AS text FROM code)", 'doc_id', 'text')}),
  bs AS (SELECT kw.doc_id, s.rel_path, row_number() OVER (PARTITION BY kw.doc_id, keyword ORDER BY s.symbol_no, s.rel_path) AS r FROM kw JOIN symbols s ON contains(lower(s.name), keyword) WHERE rank <= 8),
  bn AS (SELECT kw.doc_id, c.rel_path, row_number() OVER (PARTITION BY kw.doc_id, keyword ORDER BY c.rel_path) AS r FROM kw JOIN code c ON contains(lower(regexp_extract(c.rel_path, '[^/]*$')), keyword) WHERE rank <= 6),
  hits AS (SELECT doc_id, rel_path, CAST(sum(s) AS BIGINT) AS score FROM (SELECT doc_id, rel_path, 3 AS s FROM bs WHERE r <= 30 UNION ALL SELECT doc_id, rel_path, 5 FROM bn WHERE r <= 30) GROUP BY ALL)"""


@query("context_file_hits", f"{_HITS} SELECT * FROM hits")
def _(spark, d):
    return _hits(spark, d)


@query("context_budget_pick")
def _(spark, d):
    sizes = code_files(spark, d).select("rel_path", rough_tokens(F.col("body")).alias("tokens"))
    return keywords.select_files(_hits(spark, d), sizes, max_files=3, budget=250)


# --- symbols and scopes


def _code_lines(spark, d):
    return logs.explode_lines(code_files(spark, d), "body")


_IMP = "(" + " OR ".join(f"regexp_matches(line, {_lit(p)})" for p in symbols.IMPORTS) + ")"


@query(
    "import_range",
    f"""WITH k AS (SELECT doc_id, line_no, {_IMP} AS imp, {_T} = '' OR regexp_matches({_T}, '^(//|#|/\\*|\\*|\"\"\"|'''''')') AS fill FROM {SPLIT.format(C)}),
    f AS (SELECT doc_id, min(CASE WHEN imp THEN line_no END) AS s, min(CASE WHEN NOT imp AND NOT fill THEN line_no END) AS code FROM k GROUP BY doc_id)
    SELECT k.doc_id, min(s) AS start_line, max(line_no) AS end_line FROM k JOIN f USING (doc_id) WHERE imp AND s IS NOT NULL AND (code IS NULL OR (code > s AND line_no < code)) GROUP BY k.doc_id""",
)
def _(spark, d):
    return symbols.import_ranges(_code_lines(spark, d))


_WANTED = "(SELECT doc_id AS query_id, rel_path, CASE doc_id % 4 WHEN 0 THEN 'render' WHEN 1 THEN 'max_size' WHEN 2 THEN 'idget' ELSE 'none' END AS query FROM code)"


@query(
    "symbol_match",
    f"""{WITH_SYMBOLS}, j AS (SELECT query_id, symbol_no, name, CASE WHEN name = query THEN 1 WHEN lower(name) = lower(query) THEN 2 WHEN contains(lower(name), lower(query)) THEN 3 END AS tier FROM {_WANTED} q JOIN symbols USING (rel_path))
    SELECT query_id, name, CAST(tier AS BIGINT) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, symbol_no) AS r FROM j WHERE tier IS NOT NULL) WHERE r = 1""",
)
def _(spark, d):
    s = code_symbols(spark, d)
    return symbols.match_symbols(spark.sql(f"SELECT * FROM {_WANTED}"), s)


@query(
    "symbol_at_cursor",
    f"""{WITH_SYMBOLS}, j AS (SELECT c.doc_id AS cursor_id, name, end_line - start_line AS span, row_number() OVER (PARTITION BY c.doc_id ORDER BY end_line - start_line, symbol_no) AS r
    FROM code c JOIN symbols s USING (rel_path) WHERE c.doc_id % 20 BETWEEN start_line AND end_line) SELECT cursor_id, name, CAST(span AS BIGINT) AS span FROM j WHERE r = 1""",
)
def _(spark, d):
    s = code_symbols(spark, d)
    return symbols.symbol_at(spark.sql("SELECT doc_id AS cursor_id, rel_path, doc_id % 20 AS line FROM code"), s.drop("doc_id"))


_KINDS = "[" + ", ".join(_lit(k) for k in symbols.KIND_NAMES) + "]"


@query("symbol_kind", f"{WITH_SYMBOLS} SELECT rel_path, name, coalesce({_KINDS}[kind_code + 1], 'symbol') AS kind, kind_code IN (10, 25, 9, 21, 22) AS is_type FROM symbols")
def _(spark, d):
    return code_symbols(spark, d).select("rel_path", "name", symbols.kind_name(F.col("kind_code")).alias("kind"), F.col("kind_code").isin(*symbols.TYPE_KINDS).alias("is_type"))


@query("function_around_cursor")
def _(spark, d):
    lines = _code_lines(spark, d)
    return symbols.function_around(lines, lines.groupBy("doc_id").agg((F.max("line_no") - 3).alias("cursor")))


_TAGS = f"""(SELECT prompt_id, CAST(generate_subscripts(k, 1) - 1 AS BIGINT) AS pos, unnest(k) AS kind, nullif(unnest(n), '') AS name FROM (SELECT prompt_id, regexp_extract_all(text, {_lit(symbols.SCOPES)}, 1) AS k, regexp_extract_all(text, {_lit(symbols.SCOPES)}, 2) AS n FROM {P}))"""


@query("scope_tags", f"SELECT * FROM {_TAGS}")
def _(spark, d):
    return symbols.scope_tags(prompts(spark, d))


@query("scope_stripped", f"SELECT prompt_id, {trimmed(replaced('text', [(symbols.SCOPES, ''), (r'[ \t]{2,}', ' ')]))} AS text FROM {P}")
def _(spark, d):
    return prompts(spark, d).select("prompt_id", symbols.strip_scopes(F.col("text")).alias("text"))


@query("scope_dedup", f"SELECT prompt_id, pos, kind || ':' || coalesce(name, '') AS key, row_number() OVER (PARTITION BY prompt_id, kind || ':' || coalesce(name, '') ORDER BY pos) > 1 AS deduped FROM {_TAGS}")
def _(spark, d):
    tags = symbols.scope_tags(prompts(spark, d))
    return symbols.repeated_scopes(tags.select("prompt_id", "pos", F.concat("kind", F.lit(":"), F.coalesce("name", F.lit(""))).alias("key")))


@query("mode_flags", f"SELECT prompt_id, contains(text, '@compress') OR NOT contains(text, '@optimize') AS compress, contains(text, '@optimize') OR NOT contains(text, '@compress') AS trim FROM {P}")
def _(spark, d):
    return symbols.mode_flags(prompts(spark, d)).select("prompt_id", "compress", "trim")


@query("line_diff", f"""WITH b AS {SPLIT.format(C)}, a AS {SPLIT.format(f"(SELECT doc_id, {replaced('body', [(code.BLOCK_COMMENT, '')])} AS body FROM {C})")}
    SELECT doc_id, line_no, CASE WHEN {_T} = '' OR (doc_id, {_T}) IN (SELECT (doc_id, {_T}) FROM a) THEN 'kept' ELSE 'removed' END AS status FROM b""")
def _(spark, d):
    files = code_files(spark, d)
    after = logs.explode_lines(files.withColumn("body", code.strip_block_comments(F.col("body"))), "body")
    return symbols.line_diff(_code_lines(spark, d), after)


# --- diffs


@query("diff_split", f"""SELECT doc_id, CAST(file_no AS BIGINT) AS file_no, CAST(hunk_no AS BIGINT) AS hunk_no, string_agg(line, chr(10) ORDER BY line_no) AS body FROM (
    SELECT *, sum(CAST(starts_with(line, '@@') AS INT)) OVER (PARTITION BY doc_id, file_no ORDER BY line_no) AS hunk_no FROM (SELECT *, sum(CAST(starts_with(line, 'diff --git') AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS file_no FROM {D})) GROUP BY ALL""")
def _(spark, d):
    return diffs.split_diff(diff_lines(spark, d))


_STATS = "SELECT o_orderkey AS diff_id, ' ' || (o_orderkey % 5) || CASE WHEN o_orderkey % 5 = 1 THEN ' file changed' ELSE ' files changed' END || CASE WHEN o_custkey % 3 > 0 THEN ', ' || o_custkey || ' insertions(+)' ELSE '' END || CASE WHEN o_custkey % 4 > 1 THEN ', 1 deletion(-)' ELSE '' END AS line FROM orders"
_SHORT = rf"SELECT diff_id, CAST(coalesce(nullif(regexp_extract(line, '{diffs.FILES}', 1), ''), '0') AS BIGINT) AS files, CAST(coalesce(nullif(regexp_extract(line, '{diffs.INSERTIONS}', 1), ''), '0') AS BIGINT) AS insertions, CAST(coalesce(nullif(regexp_extract(line, '{diffs.DELETIONS}', 1), ''), '0') AS BIGINT) AS deletions FROM ({_STATS})"


def _stats(spark, d):
    return derived.view(spark, d, _STATS, "orders").select("diff_id", *diffs.shortstat(F.col("line")))


@query("diff_shortstat", _SHORT)
def _(spark, d):
    return _stats(spark, d)


@query("diff_summary", f"SELECT diff_id, 'staged: ' || files || CASE WHEN files = 1 THEN ' file changed' ELSE ' files changed' END || CASE WHEN insertions > 0 THEN ', +' || insertions ELSE '' END || CASE WHEN deletions > 0 THEN ', -' || deletions ELSE '' END AS summary FROM ({_SHORT})")
def _(spark, d):
    return _stats(spark, d).select("diff_id", diffs.summary(F.lit("staged"), F.col("files"), F.col("insertions"), F.col("deletions")).alias("summary"))


@query("diff_truncate")
def _(spark, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    whole = diff_lines(spark, d).groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("diff"))
    return diffs.truncate(whole, 300).select("doc_id", "truncated")


# --- repository maps

_MAP = "SELECT *, regexp_extract(rel_path, 'src/([^/]*)', 1) AS map_id, coalesce({0}[kind_code + 1], 'symbol') AS kind FROM symbols".format(_KINDS)


def _map_symbols(spark, d):
    return code_symbols(spark, d).withColumn("map_id", F.regexp_extract("rel_path", "src/([^/]*)", 1)).withColumn("kind", symbols.kind_name(F.col("kind_code")))


def _listing_sql(line: str) -> str:
    return f"""{WITH_SYMBOLS}, m AS ({_MAP}), b AS (SELECT map_id, rel_path, rel_path || chr(10) || string_agg({line}, chr(10) ORDER BY symbol_no) AS b FROM m GROUP BY map_id, rel_path)
    SELECT map_id, string_agg(b, chr(10) || chr(10) ORDER BY rel_path) AS map FROM b GROUP BY map_id"""


@query("repomap_names", _listing_sql("'  • ' || name || ' (' || kind || ')'"))
def _(spark, d):
    return repomap.names(_map_symbols(spark, d))


@query("repomap_signatures", _listing_sql("'  ' || trim(coalesce(nullif(signature, ''), kind || ' ' || name))"))
def _(spark, d):
    return repomap.signatures(_map_symbols(spark, d))


def _maps(spark, d):
    s = _map_symbols(spark, d)
    files = s.select("map_id", "rel_path", F.lit(2048).alias("size_bytes")).distinct()
    trees = repomap.tree(files).withColumnRenamed("map", "tree")
    return trees.join(repomap.names(s).withColumnRenamed("map", "names"), "map_id").join(repomap.signatures(s).withColumnRenamed("map", "signatures"), "map_id")


@query("repomap_tree")
def _(spark, d):
    return _maps(spark, d).select("map_id", "tree")


@query("repomap_level")
def _(spark, d):
    return repomap.choose_level(_maps(spark, d), 400).select("map_id", "level", "map", "truncated")


@query("repomap_size", f"SELECT doc_id, CASE WHEN size_bytes < 1024 THEN size_bytes || 'b' ELSE 'k' END AS size FROM {C}")
def _(spark, d):
    shown = repomap.size_text(F.col("size_bytes"))
    return code_files(spark, d).select("doc_id", F.when(F.col("size_bytes") < 1024, shown).otherwise(F.regexp_replace(shown, r"^[0-9.]+", "")).alias("size"))


# --- vectors, chunks and the index


@query(
    "cosine_topn",
    """WITH q AS (SELECT CAST(label AS BIGINT) AS query_id, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label),
    s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS score FROM embeddings, q)
    SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.2) WHERE rank <= 5""",
)
def _(spark, d):
    index = table(spark, d, "embeddings")
    asked = index.groupBy(F.col("label").cast("long").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("query"))
    return vectors.search(index, asked).withColumn("score", F.round("score", 6))


@query("vector_normalize", "SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm, round(v[1], 6) AS first FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))")
def _(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", vectors.normalise(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda a, x: a + x), 6).alias("norm"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@query("content_hash", "SELECT doc_id, sha1(text) AS content_hash FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("content_hash"))


@query(
    "chunk_windows",
    rf"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), s AS (SELECT doc_id, l, len(l) AS n, unnest(range(0, len(l), 3)) AS start FROM l),
    t AS (SELECT doc_id, n, start, least(start + 4, n) AS stop, {trimmed("array_to_string(l[start + 1 : start + 4], chr(10))")} AS t FROM s),
    f AS (SELECT *, min(CASE WHEN t <> '' THEN start END) OVER (PARTITION BY doc_id) AS first FROM t),
    p AS (SELECT *, t <> '' AND (length(t) >= 30 OR start = first) AS push FROM f),
    d AS (SELECT *, coalesce(bool_or(push AND stop = n) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM p),
    c AS (SELECT *, sum(CAST(push AS INT)) OVER (PARTITION BY doc_id ORDER BY start) AS chunk_no FROM d WHERE NOT done AND start >= first)
    SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, min(start) AS start_line, max(stop) - 1 AS end_line, sha1(string_agg(t, chr(10) ORDER BY start)) AS content_hash FROM c GROUP BY ALL""",
)
def _(spark, d):
    return vectors.chunk_windows(table(spark, d, "documents"), window=4, overlap=1).drop("text")


@query("chunk_symbols")
def _(spark, d):
    bodies = code_files(spark, d).select("rel_path", F.concat(F.lit("part"), F.col("doc_id").cast("string")).alias("name"), F.lit(10).alias("start_line"), F.lit(40).alias("end_line"), "body")
    return vectors.chunk_symbols(bodies, most=200, window=6, overlap=2)


_OLD = "SELECT CAST(doc_id AS VARCHAR(20)) AS path, sha1(text) AS sha1, 'm1' AS model_id FROM documents WHERE doc_id % 3 <> 0"
_NEW = "SELECT CAST(doc_id AS VARCHAR(20)) AS path, sha1(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS sha1, CASE WHEN doc_id % 11 = 0 THEN 'm2' ELSE 'm1' END AS model_id FROM documents WHERE doc_id % 5 <> 0"


@query("index_incremental", duck(f"SELECT coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NULL THEN 'drop' WHEN n.sha1 = o.sha1 AND n.model_id = o.model_id THEN 'keep' ELSE 'embed' END AS action FROM ({_NEW}) n FULL JOIN ({_OLD}) o ON n.path = o.path"))
def _(spark, d):
    return vectors.changes(derived.view(spark, d, _OLD, "documents"), derived.view(spark, d, _NEW, "documents"))


# --- session


@query(
    "session_recent",
    f"""SELECT *, CASE WHEN seconds_ago IS NOT NULL THEN greatest(1, CAST(floor(seconds_ago / 60.0 + 0.5) AS BIGINT)) END AS minutes FROM (
    SELECT entry_id, session, key, CASE WHEN gap <= 600 THEN CAST(floor(gap + 0.5) AS BIGINT) END AS seconds_ago FROM (SELECT *, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY session, key ORDER BY ts, entry_id) AS gap FROM {E}))""",
)
def _(spark, d):
    return session.recent(entries(spark, d)).select("entry_id", "session", "key", "seconds_ago", "minutes")


@query("session_totals", f"SELECT session, count(*) AS entries, CAST(sum(context_tokens) AS BIGINT) AS context_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM {E} GROUP BY session")
def _(spark, d):
    return session.totals(entries(spark, d))


@query("session_history", f"SELECT session, rank, entry_id, key FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, entry_id DESC) AS rank FROM {E}) WHERE rank <= 5")
def _(spark, d):
    return session.history(entries(spark, d), 5).select("session", "rank", "entry_id", "key")


@query("metrics_summary", f"SELECT session, CAST(sum(tokens_saved) AS BIGINT) AS tokens_saved, count(*) AS optimizations, min(ts) AS first_used, max(ts) AS last_used FROM {E} WHERE tokens_saved > 0 GROUP BY session")
def _(spark, d):
    return session.savings(entries(spark, d))


@query("session_keys", "SELECT p_partkey, 'symbol:' || p_name || '#' || p_brand AS symbol_key, 'diff:staged' AS diff_key FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", session.key("symbol", F.col("p_name"), F.col("p_brand")).alias("symbol_key"), session.key("diff", F.lit("staged")).alias("diff_key"))


# --- whole prompts


def _assembled(spark, d):
    files = code_files(spark, d).select("rel_path", "body", "doc_id")
    table_ = code_symbols(spark, d)
    tags = symbols.scope_tags(prompts(spark, d))
    # keys count from 1, so a hash picks among all files and all customers' diffs
    customers = table(spark, d, "customer").agg(F.max("c_custkey")).first()[0] or 1
    last = files.agg(F.max("doc_id")).first()[0] or 1
    spread = lambda salt, n: F.pmod(F.xxhash64("prompt_id", F.lit(salt)), F.lit(n)) + 1
    tags = tags.withColumn("doc_id", spread("file", last)).withColumn("diff_id", spread("diff", customers))
    tags = tags.withColumn("cursor", spread("cursor", 12) - 1).join(files.select("doc_id", "rel_path"), "doc_id", "left").drop("doc_id")
    files = files.drop("doc_id")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    changes = diff_lines(spark, d).groupBy(F.col("doc_id").alias("diff_id")).agg(body.alias("diff")).withColumn("kind", F.lit("diff"))
    blocks = [scopes.file_blocks(tags, files, table_), scopes.function_blocks(tags, files, table_), scopes.import_blocks(tags, files)]
    for more in [*blocks[1:], scopes.diff_blocks(tags, changes), scopes.unresolved_blocks(tags)]:
        blocks[0] = blocks[0].unionByName(more)
    return scopes.assemble(blocks[0])


@query("prompt_context")
def _(spark, d):
    return _assembled(spark, d).select("prompt_id", "context", F.array_join("labels", ",").alias("labels"))


@query("prompt_accounting")
def _(spark, d):
    done = scopes.optimise(prompts(spark, d)).join(_assembled(spark, d), "prompt_id", "left")
    return scopes.account(done).select("prompt_id", "prose_in", "prose_out", "prose_saved", "percent", "context_tokens", "total_tokens", "alert")
