"""Queries over symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import symbols as ops
from ..session import table
from ..sources.corpus import SQL, events_corpus
from .scan import _quoted


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.scopes(ops.symbols(events_corpus(spark, sf_dir)))


PLACE = ["path", "ordinal", "name", "kind", "start_line", "start_char", "end_line", "end_char"]


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scopes(spark, sf_dir).select(*PLACE, "symbol_id", "parent_id")


def symbol_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scopes(spark, sf_dir).select("path", "ordinal", *ops.FLAGS, F.array_join("tainted_sources", ",").alias("tainted_sources"))


def vulnerable_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.vulnerable(_scopes(spark, sf_dir)).select("path", "ordinal", "name", ops.confidence().alias("confidence"))


def symbols_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scopes(spark, sf_dir).groupBy("language", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"))


def name_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.postings(_scopes(spark, sf_dir)).select("term", "score", "symbol_id", "kind", "path")


def find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.find_symbol(ops.postings(_scopes(spark, sf_dir)), "V1", [ops.VARIABLE]).select("term", "score", "symbol_id", "path")


def symbol_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol at the third character of every line."""
    rows = _scopes(spark, sf_dir)
    n = F.size(F.split("content", "\n", -1))
    positions = events_corpus(spark, sf_dir).select("path", F.explode(F.sequence(F.lit(0), n - 1)).alias("line"), F.lit(2).alias("char"))
    return ops.symbol_at(rows, positions).select("path", "line", "symbol_id", "name")


def symbol_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.outline(_scopes(spark, sf_dir))


def symbol_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.symbol_findings(_scopes(spark, sf_dir))


#: Files of one line for the rules over symbols: language, extension, line (``@`` stands for the event), then the name, rule and confidence to be found.
RULED = [
    ("php", "php", 'function runQuery@($q) { return mysqli_query($db, $_GET["q"]); }', "runQuery@", 0, 100), ("javascript", "js", "function renderPage@(a) { out.innerHTML = request.query; }", "renderPage@", 1, 85),
    ("python", "py", "def shellOut@(a): os.system(request.params)", "shellOut@", 2, 100), ("go", "go", "func execQuery@(r) { db.Query(r.Form) }", "execQuery@", 0, 95), ("php", "php", '$secretToken@ = $_GET["t"];', "secretToken@", 3, 85),
    ("ruby", "rb", "function printQuery@(a) { mysql_query($_GET) }", None, None, None), ("php", "php", "function runQuery@($q) { return 1; }", None, None, None),
]


def symbol_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four rules over symbols, on files of one line each."""
    k = (F.col("event_id") % len(RULED) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(r[i]) for r in RULED]), k)
    path = F.concat(F.lit("/rules/e"), F.col("event_id").cast("string"), F.lit("."), pick(1))
    files = table(spark, sf_dir, "events").select(path.alias("path"), pick(0).alias("language"), F.replace(pick(2), F.lit("@"), F.col("event_id").cast("string")).alias("content"))
    return ops.rule_findings(ops.scopes(ops.symbols(files)))


def _extract(language: str, seq: int, kind: int, pattern: str) -> str:
    where = f"language = '{language}'" if language != "*" else "language NOT IN (" + ", ".join(_quoted(k) for k in ops.EXTRACTORS if k != "*") + ")"
    q = _quoted(pattern)
    return f"SELECT path, language, content, lines, {seq} AS seq, {kind} AS kind, regexp_extract_all(content, {q}, 0) AS m, regexp_extract_all(content, {q}, 1) AS g, regexp_split_to_array(content, {q}) AS sp FROM code_files WHERE {where} AND regexp_matches(content, {q})"


_BRANCHES = " UNION ALL ".join(_extract(lang, s, kind, p) for lang, own in ops.EXTRACTORS.items() for s, (kind, p) in enumerate(own))
_ANY = lambda words, lower=True: " OR ".join(f"contains(body, {_quoted(w.lower())})" for w in words)
_FLAGS = ", ".join(f"({_ANY(words)}) AS \"{name}\"" for name, words in ops.FLAGS.items())
_TAINT = ", ".join(f"CASE WHEN contains(body, {_quoted(w.lower())}) THEN {_quoted(w)} END" for w in ops.TAINT)
SYMBOLS = f"""WITH {SQL}, extracted AS ({_BRANCHES}),
spans AS (SELECT * EXCLUDE (m, g, sp), g[i] AS name, i, (list_sum(list_transform(sp[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: strlen(x))), 0))::BIGINT AS s, strlen(m[i]) AS n
  FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM extracted)),
starts AS (SELECT path, list_transform(generate_series(1, len(lines)), lambda k: coalesce(list_sum(list_transform(lines[1:k - 1], lambda x: strlen(x) + 1)), 0)::BIGINT) AS begins FROM code_files),
placed AS (SELECT spans.*, row_number() OVER (PARTITION BY path ORDER BY seq, i) - 1 AS ordinal, len(list_filter(begins, lambda a: a <= s)) - 1 AS start_line, len(list_filter(begins, lambda a: a <= s + n)) - 1 AS end_line, begins FROM spans JOIN starts USING (path)),
bodies AS (SELECT *, s - begins[start_line + 1] AS start_char, s + n - begins[end_line + 1] AS end_char, lower(array_to_string(lines[start_line + 1:end_line + 1], chr(10))) AS body FROM placed),
flagged AS (SELECT path, language, ordinal::INTEGER AS ordinal, name, kind::INTEGER AS kind, start_line::INTEGER AS start_line, start_char::INTEGER AS start_char, end_line::INTEGER AS end_line, end_char::INTEGER AS end_char, {_FLAGS},
  list_filter([{_TAINT}], lambda x: x IS NOT NULL) AS tainted, substr(sha256('file://' || path || ':' || start_line || ':' || start_char || ':' || end_line || ':' || end_char || ':' || kind), 1, 16) AS symbol_id FROM bodies),
s AS (SELECT *, CASE WHEN ordinal > 0 THEN first_value(symbol_id) OVER (PARTITION BY path ORDER BY ordinal) END AS parent_id,
  least(100, 50 + CASE WHEN user_input THEN 20 ELSE 0 END + CASE WHEN "sql" THEN 25 ELSE 0 END + CASE WHEN command THEN 25 ELSE 0 END + CASE WHEN len(tainted) > 0 THEN 15 ELSE 0 END)::INTEGER AS confidence FROM flagged),
v AS (SELECT * FROM s WHERE user_input OR "sql" OR command OR filesystem OR len(tainted) > 0),
snake AS (SELECT *, lower(name[1] || regexp_replace(name[2:], '([A-Z])', '_\\1', 'g')) AS form FROM s),
postings AS (SELECT lower(name) AS term, 1.0::DOUBLE AS score, symbol_id, kind, path FROM s UNION ALL SELECT lower(name), 1.0, symbol_id, kind, path FROM s UNION ALL SELECT form, 0.8, symbol_id, kind, path FROM snake WHERE form <> name)
"""
QUERIES = {
    "symbols": symbols,
    "symbol_flags": symbol_flags,
    "vulnerable_symbols": vulnerable_symbols,
    "symbols_by_kind": symbols_by_kind,
    "name_postings": name_postings,
    "find_symbol": find_symbol,
    "symbol_at_position": symbol_at_position,
    "symbol_findings": symbol_findings,
    "symbol_rule_findings": symbol_rule_findings,
    "symbol_outline": symbol_outline,
}
ORACLES = {
    "symbols": SYMBOLS + f"SELECT {', '.join(PLACE)}, symbol_id, parent_id FROM s",
    "symbol_flags": SYMBOLS + 'SELECT path, ordinal, user_input, "sql", command, filesystem, auth, crypto, array_to_string(tainted, \',\') AS tainted_sources FROM s',
    "vulnerable_symbols": SYMBOLS + "SELECT path, ordinal, name, confidence FROM v",
    "symbols_by_kind": SYMBOLS + "SELECT language, kind, count(*) AS n, count(DISTINCT name) AS names FROM s GROUP BY ALL",
    "name_postings": SYMBOLS + "SELECT * FROM postings",
    "find_symbol": SYMBOLS + "SELECT term, CASE WHEN term = 'v1' THEN score ELSE score * 0.7 END AS score, symbol_id, path FROM postings WHERE kind = 13 AND contains(term, 'v1')",
    "symbol_at_position": SYMBOLS + """, p AS (SELECT path, (line_no - 1)::INTEGER AS line, (line_no - 1) * 1000000 + 2 AS spot FROM code_lines),
x AS (SELECT *, start_line * 1000000 + start_char AS a, end_line * 1000000 + end_char AS b FROM s)
SELECT p.path, p.line, x.symbol_id, x.name FROM p LEFT JOIN x ON p.path = x.path AND p.spot BETWEEN x.a AND x.b
QUALIFY row_number() OVER (PARTITION BY p.path, p.line ORDER BY b - a, -a, x.symbol_id) = 1""",
    "symbol_outline": SYMBOLS + "SELECT path, string_agg(CASE WHEN ordinal > 0 THEN '  ' ELSE '' END || name || ' (' || kind || ')', chr(10) ORDER BY ordinal) AS outline FROM s GROUP BY path",
    "symbol_findings": SYMBOLS + f"""SELECT '{ops.SECRET_RULE}' AS rule_id, path, (start_line + 1)::INTEGER AS line, (start_char + 1)::INTEGER AS "column", name,
 '{ops.SECRET_TEXT} detected in symbol ''' || name || ''' (' || name || ')' AS description, confidence FROM v WHERE kind IN (13, 14, 8) AND ({' OR '.join(f"contains(lower(name), '{w}')" for w in ops.SECRET_NAMES)})""",
    "symbol_rule_findings": "WITH r(k, ext, name, rule_id, severity, cwe, text, confidence) AS (VALUES " + ", ".join(
        f"({k}, '{r[1]}', '{r[3]}', '{ops.SYMBOL_RULES[r[4]].rule_id}', {ops.SYMBOL_RULES[r[4]].severity}, '{ops.SYMBOL_RULES[r[4]].cwe}', '{ops.SYMBOL_RULES[r[4]].description}', {r[5]})" for k, r in enumerate(RULED) if r[3]
    ) + f"""), e AS (SELECT event_id, event_id % {len(RULED)} AS k FROM events), f AS (SELECT *, replace(name, '@', event_id::VARCHAR) AS own FROM e JOIN r USING (k))
SELECT rule_id, severity, cwe, '/rules/e' || event_id || '.' || ext AS path, 1 AS line, 1 AS "column", own AS name, text || ' detected in symbol ''' || own || ''' (' || own || ')' AS description, confidence FROM f""",
}
