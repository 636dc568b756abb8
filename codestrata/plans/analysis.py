"""Queries over syntax, taint, graphs, control flow and incremental analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flow, graphs, incremental, syntax
from ..operators.match import line_count
from ..session import table
from ..sources.corpus import SQL, events_corpus
from .scan import _quoted


def _php(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.source_lines(events_corpus(spark, sf_dir), "php")


def _join(column: str) -> F.Column:
    return F.array_join(column, ",").alias(column)


def php_functions(spark, sf_dir):
    return syntax.functions(_php(spark, sf_dir)).select("path", "line", "name", _join("params"))


def php_classes(spark, sf_dir):
    return syntax.classes(_php(spark, sf_dir)).select("path", "line", "name", "extends", _join("implements"))


def php_assignments(spark, sf_dir):
    return syntax.assignments(_php(spark, sf_dir)).drop("text")


def php_calls(spark, sf_dir):
    return syntax.calls(_php(spark, sf_dir)).select("path", "line", "seq", "name", F.array_join("args", "|").alias("args"))


def php_last_definitions(spark, sf_dir):
    return graphs.last_definitions(syntax.assignments(_php(spark, sf_dir)))


def tainted_variables(spark, sf_dir):
    return syntax.tainted_variables(syntax.assignments(_php(spark, sf_dir)))


def syntax_findings(spark, sf_dir):
    return syntax.rule_findings(_php(spark, sf_dir))


def syntax_summary(spark, sf_dir):
    return syntax.summary(syntax.rule_findings(_php(spark, sf_dir)))


def syntax_metrics(spark, sf_dir):
    return syntax.metrics(_php(spark, sf_dir))


def imports(spark, sf_dir):
    return syntax.imports(syntax.source_lines(events_corpus(spark, sf_dir)))


def taint_paths(spark, sf_dir):
    return syntax.taint_paths(_php(spark, sf_dir)).withColumn("trail", F.array_join(F.col("trail").cast("array<string>"), ","))


def function_findings(spark, sf_dir):
    return syntax.function_findings(_php(spark, sf_dir), ["query", "mysqli", "serialize"])


def use_bindings(spark, sf_dir):
    return graphs.use_bindings(_php(spark, sf_dir))


def resolved_names(spark, sf_dir):
    return graphs.resolved_names(_php(spark, sf_dir))


def inheritance(spark, sf_dir):
    return graphs.inheritance(_php(spark, sf_dir))


def call_edges(spark, sf_dir):
    return graphs.call_edges(_php(spark, sf_dir))


def include_edges(spark, sf_dir):
    return graphs.include_edges(_php(spark, sf_dir), events_corpus(spark, sf_dir))


def dependency_edges(spark, sf_dir):
    return graphs.dependencies(_php(spark, sf_dir), events_corpus(spark, sf_dir))


def dependency_degrees(spark, sf_dir):
    return graphs.degree(dependency_edges(spark, sf_dir))


def _index(spark, sf_dir) -> DataFrame:
    """An older copy of the index: files with an error event have changed since, those with a signup in their first lines are unknown."""
    rows = table(spark, sf_dir, "events").withColumn("f", F.floor(F.col("event_id") / 20))
    marks = rows.groupBy("f").agg(F.max((F.col("event_type") == "error").cast("int")).alias("changed"), F.min("event_type").alias("first"), F.sum("value").alias("v"))
    return marks.withColumn("stem", F.concat(F.lit("f"), F.col("f").cast("string")))


def _files(spark, sf_dir) -> DataFrame:
    size = F.octet_length("content")
    return events_corpus(spark, sf_dir).select("path", "content", F.sha2("content", 256).alias("sha256"), F.timestamp_seconds(F.lit(1_700_000_000) + size).alias("mtime"), size.cast("long").alias("n_bytes"), F.regexp_extract("path", r"([^/.]+)\.[^/]*$", 1).alias("stem"))


def _old_index(spark, sf_dir) -> DataFrame:
    joined = _files(spark, sf_dir).join(_index(spark, sf_dir), "stem")
    known = joined.filter("n_bytes % 9 <> 0")
    return known.select("path", F.when(F.col("n_bytes") % 4 == 0, F.sha2(F.concat("content", F.lit("old")), 256)).otherwise(F.col("sha256")).alias("sha256"), "mtime", F.timestamp_seconds(F.lit(1_699_000_000)).alias("created_at"))


def change_plan(spark, sf_dir):
    return incremental.change_plan(_files(spark, sf_dir), _old_index(spark, sf_dir))


def files_to_process(spark, sf_dir):
    return incremental.to_process(change_plan(spark, sf_dir), dependency_edges(spark, sf_dir))


def affected_files(spark, sf_dir):
    changed = change_plan(spark, sf_dir).filter("action = 'changed'")
    return graphs.affected(dependency_edges(spark, sf_dir), changed)


def index_upsert(spark, sf_dir):
    rows = _files(spark, sf_dir).select("path", "sha256", "mtime", F.timestamp_seconds(F.lit(1_701_000_000)).alias("created_at"))
    merged = incremental.upsert(_old_index(spark, sf_dir), rows)
    return merged.select("path", "sha256", F.unix_seconds("mtime").alias("mtime"), F.unix_seconds("created_at").alias("created_at"), "touched")


NOW = "2024-01-30 23:59:59"


def _entries(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(
        F.concat(F.lit("/cache/"), F.col("event_id").cast("string")).alias("path"), F.sha2(F.col("event_id").cast("string"), 256).alias("file_hash"), F.col("ts").alias("mod_time"), F.col("ts").alias("created_at"),
        (F.col("event_id") % 977 + 1).alias("file_size"), (F.col("user_id") * 10 + 1).alias("cache_size"), F.when(F.col("event_type") == "error", "0").otherwise("1").alias("version"), "event_type", "event_id",
    )


def cache_validity(spark, sf_dir):
    e = _entries(spark, sf_dir)
    cols = ["file_hash", "mod_time", "created_at", "file_size", "version"]
    file = F.struct(F.when(F.col("event_type") == "click", "other").otherwise(F.col("file_hash")).alias("sha256"), F.col("mod_time").alias("mtime"), F.col("file_size").alias("n_bytes"))
    return e.select("path", incremental.valid(F.struct(*cols), file, F.to_timestamp(F.lit(NOW))).alias("valid"))


def cache_eviction(spark, sf_dir):
    return incremental.evict(_entries(spark, sf_dir), F.to_timestamp(F.lit(NOW)), max_bytes=300_000)


def cache_stats(spark, sf_dir):
    return _entries(spark, sf_dir).groupBy("version").agg(F.count(F.lit(1)).alias("entries"), F.sum("cache_size").alias("total_size"))


def flow_edges(spark, sf_dir):
    return flow.edges(flow.statements(_php(spark, sf_dir))).drop("seq")


def flow_nodes(spark, sf_dir):
    return flow.nodes(flow.statements(_php(spark, sf_dir)))


def flow_loops(spark, sf_dir):
    return flow.loops(flow.statements(_php(spark, sf_dir)), connected=True)


def flow_dominators(spark, sf_dir):
    return flow.dominators(flow.statements(_php(spark, sf_dir)), connected=True)


def flow_metrics(spark, sf_dir):
    return flow.metrics(flow.statements(_php(spark, sf_dir)), connected=True)


def flow_dot(spark, sf_dir):
    return flow.dot(flow.statements(_php(spark, sf_dir)))


def statement_counts(spark, sf_dir):
    """Statements of each kind and lines by file."""
    rows = flow.statements(_php(spark, sf_dir)).groupBy("unit", "kind").agg(F.count(F.lit(1)).alias("n"))
    lines = events_corpus(spark, sf_dir).select(F.col("path").alias("unit"), line_count(F.col("content")).cast("long").alias("n_lines"))
    return rows.join(lines, "unit")


def _rx(pattern: str) -> str:
    return _quoted(pattern)


_F, _C, _A, _K, _P, _U = syntax.FUNCTION, syntax.CLASS, syntax.ASSIGNMENT, syntax.CALL, syntax.PRINTED, syntax.USE
_LIST = lambda words: ", ".join(map(_quoted, words))
_SG = _quoted(syntax.SUPERGLOBALS)
BASE = f"""WITH RECURSIVE {SQL}, php AS (SELECT path, line_no AS line, text FROM code_lines WHERE language = 'php'),
functions AS (SELECT path, line, regexp_extract(text, {_rx(_F)}, 1) AS name, regexp_extract_all(regexp_extract(text, {_rx(_F)}, 2), '\\$([a-zA-Z_][a-zA-Z0-9_]*)', 1) AS params FROM php WHERE regexp_matches(text, {_rx(_F)})),
classes AS (SELECT path, line, regexp_extract(text, {_rx(_C)}, 1) AS name, nullif(regexp_extract(text, {_rx(_C)}, 2), '') AS extends,
  list_filter(list_transform(string_split(regexp_extract(text, {_rx(_C)}, 3), ','), lambda x: trim(x)), lambda x: x <> '') AS implements FROM php WHERE regexp_matches(text, {_rx(_C)})),
assignments AS (SELECT *, nullif(regexp_extract(rhs, '^\\$([a-zA-Z_][a-zA-Z0-9_]*)$', 1), '') AS rhs_name, regexp_matches(rhs, {_SG}) AS tainted
  FROM (SELECT path, line, text, regexp_extract(text, {_rx(_A)}, 1) AS target, regexp_extract(text, {_rx(_A)}, 2) AS rhs FROM php WHERE regexp_matches(text, {_rx(_A)}))),
found AS (SELECT path, line, unnest(list_concat(list_filter(list_zip(regexp_extract_all(text, {_rx(_K)}, 1), regexp_extract_all(text, {_rx(_K)}, 2)), lambda c: NOT list_contains([{_LIST(syntax.CONSTRUCTS)}], lower(c[1]))),
  CASE WHEN regexp_matches(text, {_rx(_P)}) THEN [row(regexp_extract(text, {_rx(_P)}, 1), regexp_extract(text, {_rx(_P)}, 2))] ELSE [] END)) AS c, generate_subscripts(list_concat(list_filter(list_zip(regexp_extract_all(text, {_rx(_K)}, 1), regexp_extract_all(text, {_rx(_K)}, 2)), lambda c: NOT list_contains([{_LIST(syntax.CONSTRUCTS)}], lower(c[1]))),
  CASE WHEN regexp_matches(text, {_rx(_P)}) THEN [row('', '')] ELSE [] END), 1) - 1 AS seq FROM php),
calls AS (SELECT path, line, seq::INTEGER AS seq, c[1] AS name, CASE WHEN trim(c[2]) = '' THEN [] ELSE list_transform(string_split(c[2], ','), lambda x: trim(x)) END AS args FROM found),
args AS (SELECT path, line, seq, name, value, nullif(regexp_extract(value, '^\\$([a-zA-Z_][a-zA-Z0-9_]*)$', 1), '') AS variable, regexp_matches(value, '["''$A-Za-z0-9_\\])]\\s*[.+]\\s*["''$]') AS concat FROM (SELECT path, line, seq, name, unnest(args) AS value FROM calls)),
seeds AS (SELECT path, target AS variable, min(line) AS line FROM assignments WHERE tainted GROUP BY ALL),
moves AS (SELECT path, rhs_name AS variable, target, line FROM assignments WHERE rhs_name IS NOT NULL),
reach AS (SELECT path, variable, 0 AS steps FROM seeds UNION SELECT r.path, e.target, r.steps + 1 FROM reach r JOIN moves e USING (path, variable) WHERE r.steps < 20),
fewest AS (SELECT path, variable, min(steps) AS steps FROM reach GROUP BY ALL),
way AS (SELECT path, variable, 0 AS steps, line AS source_line, line::VARCHAR AS trail, NULL::VARCHAR AS previous, line FROM seeds
  UNION ALL SELECT * EXCLUDE (place) FROM (SELECT w.path, e.target AS variable, w.steps + 1 AS steps, w.source_line, w.trail || ',' || e.line AS trail, w.variable AS previous, e.line,
    row_number() OVER (PARTITION BY w.path, e.target ORDER BY w.source_line, w.variable, e.line) AS place
    FROM way w JOIN moves e ON e.path = w.path AND e.variable = w.variable JOIN fewest f ON f.path = w.path AND f.variable = e.target AND f.steps = w.steps + 1) WHERE place = 1),
taint AS (SELECT * FROM way),
dirty AS (SELECT * FROM args WHERE (path, variable) IN (SELECT path, variable FROM taint) UNION ALL SELECT * FROM args WHERE regexp_matches(value, {_SG})),
uses AS (SELECT path, line, regexp_extract(text, {_rx(_U)}, 1) AS fqn, regexp_extract(text, {_rx(_U)}, 2) AS alias FROM php WHERE regexp_matches(text, {_rx(_U)})),
parents AS (SELECT path, name AS class, 'extends' AS relation, extends AS parent FROM classes WHERE extends IS NOT NULL UNION ALL SELECT path, name, 'implements', unnest(implements) FROM classes),
inherits AS (SELECT p.*, k.parent_path FROM parents p LEFT JOIN (SELECT name, min(path) AS parent_path FROM classes GROUP BY name) k ON k.name = p.parent),
included AS (SELECT path, regexp_extract(text, {_rx(syntax.INCLUDE)}, 1) AS kind, regexp_extract(text, {_rx(syntax.INCLUDE)}, 2) AS target FROM php WHERE regexp_matches(text, {_rx(syntax.INCLUDE)})),
joined AS (SELECT path, kind, CASE WHEN starts_with(target, '/') THEN target ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || target END AS target FROM included),
one_up AS (SELECT path, kind, regexp_replace(target, '/[^/.]+/\\.\\./', '/') AS target FROM joined),
includes AS (SELECT DISTINCT i.path AS from_path, c.path AS to_path, kind FROM (SELECT path, kind, regexp_replace(target, '/[^/.]+/\\.\\./', '/') AS target FROM one_up) i JOIN code_files c ON c.path = i.target),
dependencies AS (SELECT from_path, to_path, kind FROM includes UNION SELECT path, parent_path, 'class_ref' FROM inherits WHERE parent_path IS NOT NULL AND parent_path <> path),
files AS (SELECT path, content, sha256(content) AS sha256, 1700000000 + strlen(content) AS mtime, strlen(content) AS n_bytes FROM code_files),
plan AS (SELECT path, CASE WHEN n_bytes % 9 = 0 THEN 'new' WHEN n_bytes % 4 = 0 THEN 'changed' ELSE 'up_to_date' END AS action FROM files),
affected AS (SELECT path, 0 AS distance FROM plan WHERE action = 'changed' UNION ALL SELECT d.from_path, a.distance + 1 FROM affected a JOIN (SELECT DISTINCT from_path, to_path FROM dependencies) d ON d.to_path = a.path WHERE a.distance < 3),
touched AS (SELECT path, 0 AS distance FROM plan WHERE action <> 'up_to_date' UNION ALL SELECT d.from_path, a.distance + 1 FROM touched a JOIN (SELECT DISTINCT from_path, to_path FROM dependencies) d ON d.to_path = a.path WHERE a.distance < 3),
kinds AS (SELECT path AS unit, line, CASE lower(regexp_extract(text, '^\\s*([A-Za-z]+)', 1)) WHEN 'if' THEN 'if' WHEN 'for' THEN 'loop' WHEN 'foreach' THEN 'loop' WHEN 'while' THEN 'loop' WHEN 'switch' THEN 'switch' WHEN 'try' THEN 'try' WHEN 'return' THEN 'return' WHEN 'throw' THEN 'throw' WHEN 'break' THEN 'break' ELSE 'basic' END AS kind FROM php)
"""


def _flow(connected: bool) -> str:
    """The graphs of all units, written out case by case: made(unit, node, kind), linked(unit, from_node, to_node, label)."""
    added = [("if", [("conditional", ""), ("basic", ""), ("basic", ""), ("basic", "")]), ("loop", [("loop", ""), ("basic", ""), ("basic", "")]), ("switch", [("conditional", ""), ("basic", ""), ("basic", "")]),
             ("try", [("try", ""), ("catch", ""), ("finally", ""), ("basic", "")]), ("return", [("block", ""), ("basic", "")]), ("throw", [("block", ""), ("basic", "")]), ("break", [("block", ""), ("basic", "")])]
    shapes = ", ".join(f"('{kind}', {i + 1}, '{node}')" for kind, nodes in added for i, (node, _) in enumerate(nodes))
    arcs = {"if": "c>1 1>2:true 1>3:false 2>4 3>4", "loop": "c>1 1>2:true 1>3:false 2>1", "switch": "c>1 1>3 3>2", "try": "c>1 1>2:throw 1>3 2>3 3>4", "return": "c>1 1>x:return", "throw": "c>1 1>x:throw", "break": "c>1"}
    place = lambda p: {"c": "came", "x": "2"}.get(p, f"base + {p}")
    rows = " UNION ALL ".join(
        f"SELECT unit, {place(a.split('>')[0])} AS from_node, {place(a.split('>')[1].split(':')[0])} AS to_node, '{(a.split(':') + [''])[1]}' AS label FROM spots WHERE kind = '{kind}'" for kind, text in arcs.items() for a in text.split()
    )
    ends = ("SELECT unit, 1, 3, '' FROM ended WHERE plain = 1 UNION ALL SELECT unit, finish, 2, '' FROM ended" if connected else "SELECT unit, 1, finish, '' FROM ended WHERE finish <> 1")
    return f""", widths(kind, width, leaves) AS (VALUES ('if', 4, 4), ('loop', 3, 3), ('switch', 3, 2), ('try', 4, 4), ('return', 2, 2), ('throw', 2, 2), ('break', 2, 2), ('basic', 0, NULL)),
counted AS (SELECT unit, line, kind, width, leaves, max(CASE WHEN kind = 'basic' THEN 1 ELSE 0 END) OVER (PARTITION BY unit) AS plain, count(*) OVER (PARTITION BY unit) AS stmts FROM kinds JOIN widths USING (kind)),
based AS (SELECT *, 2 + plain + coalesce(sum(width) OVER (PARTITION BY unit ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM counted),
spots AS (SELECT *, coalesce((SELECT max(b.base + b.leaves) FROM based b WHERE b.unit = o.unit AND b.line < o.line AND b.leaves IS NOT NULL), CASE WHEN plain = 1 THEN 3 ELSE 1 END) AS came FROM based o),
ended AS (SELECT unit, max(plain) AS plain, max(base + width) AS n, max(stmts) AS stmts, arg_max(coalesce(base + leaves, came), line) AS finish FROM spots GROUP BY unit),
linked(unit, from_node, to_node, label) AS ({rows} UNION ALL {ends}),
own(kind, i, node) AS (VALUES {shapes}),
made AS (SELECT unit, base + i AS node, o.node AS kind, CASE WHEN o.node = 'block' THEN stmts END AS stmts FROM spots JOIN own o USING (kind) UNION ALL SELECT unit, 1, 'entry', NULL FROM ended UNION ALL SELECT unit, 2, 'exit', NULL FROM ended UNION ALL SELECT unit, 3, 'block', stmts FROM ended WHERE plain = 1)"""


#: avoided(unit, without, node): nodes that some root reaches on a path without another node; what is missing there is dominated.
_PATHS = """, roots AS (SELECT unit, node FROM made WHERE node = 1 OR (unit, node) NOT IN (SELECT unit, to_node FROM linked)),
walked AS (SELECT DISTINCT unit, 1 AS node FROM made UNION SELECT w.unit, l.to_node FROM walked w JOIN linked l ON w.unit = l.unit AND w.node = l.from_node),
avoided AS (SELECT m.unit, m.node AS without, r.node FROM made m JOIN roots r ON r.unit = m.unit AND r.node <> m.node
  UNION SELECT a.unit, a.without, l.to_node FROM avoided a JOIN linked l ON l.unit = a.unit AND l.from_node = a.node AND l.to_node <> a.without),
over AS (SELECT m.unit, d.node AS dominator, m.node FROM made m JOIN made d ON d.unit = m.unit WHERE d.node = m.node OR (m.unit, d.node, m.node) NOT IN (SELECT unit, without, node FROM avoided))"""
_SANE = lambda names: f"(path, coalesce(variable, '')) NOT IN (SELECT path, target FROM assignments WHERE regexp_matches(rhs, '^({'|'.join(names)})\\s*\\('))"


def _rule(rule: str, source: str, subject: str, where: str, seq: str = "seq") -> str:
    severity, sure = syntax.RULES[rule]
    return f"SELECT DISTINCT '{rule}' AS rule_id, path, line, {seq} AS seq, {subject} AS subject, {severity} AS severity, {sure} AS confidence FROM {source} WHERE {where}"


_NAME_IN = lambda words: f"lower(name) IN ({_LIST(words)})"
FINDINGS = " UNION ALL ".join([
    _rule("SQL-001", f"(SELECT *, unnest([{_LIST(syntax.SQL_CALLS)}]) AS sink FROM dirty)", "sink", "contains(lower(name), sink)"),
    _rule("SQL-002", "args", "name", f"{_NAME_IN(syntax.PDO_CALLS)} AND concat"),
    _rule("XSS-001", "dirty", "name", f"{_NAME_IN(syntax.OUTPUTS)} AND {_SANE(syntax.ESCAPES)}"),
    _rule("XSS-002", "assignments", "target", "regexp_matches(rhs, '\\$?_(GET|POST|REQUEST|COOKIE|SERVER)')", "0"),
    _rule("CMD-001", "dirty", "name", _NAME_IN(syntax.COMMANDS)),
    _rule("PATH-001", "(SELECT * FROM dirty WHERE " + _SANE(syntax.PATH_CHECKS) + " UNION ALL SELECT * FROM args WHERE regexp_matches(value, '^[\"''].*\\.\\.[/\\\\]'))", "name", _NAME_IN(syntax.FILES)),
    *[_rule("SEC-001", "assignments", f"'pattern {k}'", f"regexp_matches(text, {_quoted(p)})", "0") for k, p in enumerate(syntax.SECRETS)],
    _rule("CRYPTO-001", "calls", "lower(name)", _NAME_IN(syntax.CRYPTO)),
    _rule("DESER-001", "calls", "lower(name)", _NAME_IN(syntax.UNSAFE)),
])

#: Metrics of the graphs of kinds(unit, line, kind).
METRICS_SQL = _flow(True) + _PATHS + """, e AS (SELECT unit, count(*) AS edges FROM linked GROUP BY unit), r AS (SELECT unit, count(*) AS reachable FROM walked GROUP BY unit),
b AS (SELECT l.unit, count(*) AS loops FROM linked l JOIN over o ON o.unit = l.unit AND o.dominator = l.to_node AND o.node = l.from_node GROUP BY l.unit),
d AS (SELECT o.unit, count(*) AS dominated FROM over o JOIN walked w ON w.unit = o.unit AND w.node = o.node WHERE o.dominator <> o.node GROUP BY o.unit),
stop AS (SELECT unit, min(line) AS line, arg_min(kind, line) AS kind FROM kinds WHERE kind IN ('return', 'throw', 'break') GROUP BY unit),
deep AS (SELECT k.unit, max(CASE WHEN k.kind = 'basic' THEN 1 ELSE 0 END) + sum(CASE WHEN s.line IS NOT NULL AND k.line >= s.line THEN 0 WHEN k.kind IN ('if', 'switch', 'try') THEN 3 WHEN k.kind = 'loop' THEN 2 ELSE 0 END) + max(CASE WHEN s.kind IN ('return', 'throw') THEN 2 ELSE 1 END) AS max_depth
  FROM kinds k LEFT JOIN stop s ON s.unit = k.unit GROUP BY k.unit)
SELECT x.unit, x.n::BIGINT AS nodes, e.edges, (e.edges - x.n + 2)::BIGINT AS complexity, r.reachable, (x.n - r.reachable)::BIGINT AS unreachable, coalesce(b.loops, 0)::BIGINT AS loops, (2 * coalesce(b.loops, 0))::BIGINT AS loop_nodes, deep.max_depth::BIGINT AS max_depth, coalesce(d.dominated, 0)::BIGINT AS dominated
FROM ended x LEFT JOIN e USING (unit) LEFT JOIN r USING (unit) LEFT JOIN b USING (unit) LEFT JOIN d USING (unit) LEFT JOIN deep USING (unit)"""

QUERIES = {f.__name__: f for f in (
    php_functions, php_classes, php_assignments, php_calls, php_last_definitions, tainted_variables, syntax_findings, syntax_summary, syntax_metrics, imports, taint_paths, function_findings, use_bindings, resolved_names, inheritance, call_edges, dependency_edges,
    include_edges, dependency_degrees, change_plan, files_to_process, affected_files, index_upsert, cache_validity, cache_eviction, cache_stats, flow_edges, flow_nodes, flow_loops, flow_dominators, flow_metrics, flow_dot, statement_counts,
)}
ORACLES = {
    "php_functions": BASE + "SELECT path, line, name, array_to_string(params, ',') AS params FROM functions",
    "php_classes": BASE + "SELECT path, line, name, extends, array_to_string(implements, ',') AS implements FROM classes",
    "php_assignments": BASE + "SELECT path, line, target, rhs, rhs_name, tainted FROM assignments",
    "php_calls": BASE + "SELECT path, line, seq, name, array_to_string(args, '|') AS args FROM calls",
    "php_last_definitions": BASE + "SELECT path, target AS variable, max(line) AS line, arg_max(tainted, line) AS tainted FROM assignments GROUP BY ALL",
    "tainted_variables": BASE + "SELECT path, variable, steps::INTEGER AS steps, source_line, previous, line FROM taint",
    "syntax_findings": BASE + FINDINGS,
    "syntax_summary": BASE + f"SELECT severity, rule_id, count(*) AS n FROM ({FINDINGS}) GROUP BY GROUPING SETS ((severity), (rule_id))",
    "syntax_metrics": BASE + f"""SELECT p.path, p.functions, p.classes, p.assignments, coalesce(c.calls, 0)::BIGINT AS calls FROM (SELECT path, sum(regexp_matches(text, {_rx(_F)})::INT)::BIGINT AS functions,
 sum(regexp_matches(text, {_rx(_C)})::INT)::BIGINT AS classes, sum(regexp_matches(text, {_rx(_A)})::INT)::BIGINT AS assignments FROM php GROUP BY path) p LEFT JOIN (SELECT path, count(*) AS calls FROM calls GROUP BY path) c USING (path)""",
    "imports": f"WITH {SQL} " + " UNION ALL ".join(f"SELECT path, line_no AS line, regexp_extract(text, {_quoted(p)}, 1) AS module FROM code_lines WHERE language = '{k}' AND regexp_matches(text, {_quoted(p)})" for k, p in syntax.IMPORTS.items()),
    "taint_paths": BASE + f"""SELECT DISTINCT a.path, a.variable, t.source_line, a.name AS sink, a.line AS sink_line, t.steps::INTEGER AS steps, t.trail FROM args a JOIN taint t USING (path, variable) WHERE a.name IN ({_LIST(syntax.SINKS)})""",
    "function_findings": BASE + "SELECT path, line, seq, name, wanted, 90 AS confidence FROM (SELECT *, unnest(['query', 'mysqli', 'serialize']) AS wanted FROM calls) WHERE contains(name, wanted)",
    "use_bindings": BASE + "SELECT path, line, CASE WHEN alias <> '' THEN alias ELSE regexp_extract(fqn, '([^\\\\]+)$', 1) END AS alias, chr(92) || fqn AS fqn FROM uses",
    "resolved_names": BASE + f""", n AS (SELECT path, parent AS name, 'class' AS kind FROM parents UNION SELECT path, name, 'function' FROM calls),
u AS (SELECT path, CASE WHEN alias <> '' THEN alias ELSE regexp_extract(fqn, '([^\\\\]+)$', 1) END AS name, arg_max(chr(92) || fqn, line) AS bound FROM uses GROUP BY ALL),
sp AS (SELECT path, arg_min(regexp_extract(text, {_rx(syntax.NAMESPACE)}, 1), line) AS space FROM php WHERE regexp_matches(text, {_rx(syntax.NAMESPACE)}) GROUP BY path)
SELECT n.path, n.kind, n.name,
 CASE WHEN n.kind = 'function' AND starts_with(n.name, chr(92)) THEN n.name WHEN bound IS NOT NULL THEN bound WHEN n.kind = 'function' AND n.name IN (SELECT name FROM functions) THEN chr(92) || n.name
  ELSE chr(92) || coalesce(space || chr(92), '') || n.name END AS fqn,
 CASE WHEN n.kind = 'function' AND starts_with(n.name, chr(92)) THEN 'name' WHEN bound IS NOT NULL THEN 'use' WHEN n.kind = 'function' AND n.name IN (SELECT name FROM functions) THEN 'global' ELSE 'namespace' END AS via
FROM n LEFT JOIN u ON u.path = n.path AND u.name = n.name LEFT JOIN sp ON sp.path = n.path""",
    "inheritance": BASE + "SELECT * FROM inherits",
    "call_edges": BASE + """SELECT c.path AS caller_path, c.line, c.seq, c.name AS callee, CASE WHEN list_contains(d.paths, c.path) THEN c.path ELSE d.paths[1] END AS callee_path, d.paths IS NOT NULL AS is_direct
FROM calls c LEFT JOIN (SELECT name, list_sort(list(DISTINCT path)) AS paths FROM functions GROUP BY name) d ON d.name = c.name""",
    "dependency_edges": BASE + "SELECT from_path, to_path, kind FROM dependencies",
    "dependency_degrees": BASE + "SELECT path, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT from_path AS path, 1 AS o, 0 AS i FROM dependencies UNION ALL SELECT to_path, 0, 1 FROM dependencies) GROUP BY path",
    "change_plan": BASE + "SELECT * FROM plan",
    "files_to_process": BASE + "SELECT path, action AS reason FROM plan WHERE action <> 'up_to_date' UNION ALL SELECT path, 'affected' FROM plan WHERE action = 'up_to_date' AND path IN (SELECT path FROM touched WHERE distance > 0)",
    "include_edges": BASE + "SELECT from_path, to_path, kind FROM includes",
    "affected_files": BASE + "SELECT path, min(distance) AS distance FROM affected GROUP BY path",
    "index_upsert": BASE + "SELECT path, sha256, mtime::BIGINT AS mtime, CASE WHEN n_bytes % 9 = 0 THEN 1701000000 ELSE 1699000000 END::BIGINT AS created_at, true AS touched FROM files",
    "cache_validity": f"SELECT '/cache/' || event_id AS path, event_type NOT IN ('error', 'click') AND epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) <= 168 * 3600000000 AS valid FROM events",
    "cache_eviction": f"""WITH e AS (SELECT '/cache/' || event_id AS path, ts, user_id * 10 + 1 AS n, epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts) > 168 * 3600000000 AS expired FROM events)
SELECT path, NOT expired AND sum(n) OVER (PARTITION BY expired ORDER BY ts DESC, path DESC ROWS UNBOUNDED PRECEDING) <= 300000 AS keep FROM e""",
    "cache_stats": "SELECT CASE WHEN event_type = 'error' THEN '0' ELSE '1' END AS version, count(*) AS entries, sum(user_id * 10 + 1)::BIGINT AS total_size FROM events GROUP BY ALL",
    "flow_edges": BASE + _flow(False) + " SELECT unit, from_node::BIGINT AS from_node, to_node::BIGINT AS to_node, label FROM linked",
    "flow_nodes": BASE + _flow(False) + " SELECT unit, node::BIGINT AS node, kind, stmts FROM made",
    "flow_dominators": BASE + _flow(True) + _PATHS + """, ranked AS (SELECT unit, node, dominator, count(*) OVER (PARTITION BY unit, node) - 1 AS depth FROM over)
SELECT m.unit, m.node::BIGINT AS node, (SELECT arg_max(o.dominator, r.depth) FROM over o JOIN (SELECT DISTINCT unit, node, depth FROM ranked) r ON r.unit = o.unit AND r.node = o.dominator WHERE o.unit = m.unit AND o.node = m.node AND o.dominator <> m.node)::BIGINT AS dominator, m.depth
FROM (SELECT DISTINCT unit, node, depth FROM ranked) m""",
    "flow_loops": BASE + _flow(True) + _PATHS + """, backs AS (SELECT l.unit, to_node AS header, from_node AS latch FROM linked l JOIN over o ON o.unit = l.unit AND o.dominator = l.to_node AND o.node = l.from_node),
bodies AS (SELECT unit, header, latch, latch AS node FROM backs UNION SELECT b.unit, b.header, b.latch, l.from_node FROM bodies b JOIN linked l ON l.unit = b.unit AND l.to_node = b.node WHERE b.node <> b.header)
SELECT unit, header::BIGINT AS header, latch::BIGINT AS latch, node::BIGINT AS node FROM (SELECT * FROM bodies UNION SELECT unit, header, latch, header FROM backs)""",
    "flow_metrics": BASE + METRICS_SQL,
    "statement_counts": BASE + "SELECT unit, kind, count(*) AS n, any_value(c.n_lines)::BIGINT AS n_lines FROM kinds JOIN code_files c ON c.path = unit GROUP BY unit, kind",
}
