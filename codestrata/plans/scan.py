"""Queries of the scan: selection of files, rule matching, statistics, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import match, report
from ..operators.rules import RULES, Rule, chosen
from ..session import table
from ..sources.corpus import SQL, events_corpus

#: A rule with a literal pattern, as the catalogue itself has none.
LITERAL = Rule("LOCAL-001", "inner_html", "Inner HTML", "Markup set from script", 1, ("*",), "", "", "", "", literals=("innerHTML", "é"))
COLUMNS = ["finding_id", "pattern", "rule_id", "type", "severity", "title", "file", "line", "column", "code", "cwe", "owasp", "confidence"]


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.findings(events_corpus(spark, sf_dir))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).select(*COLUMNS, F.array_join("context", "\n").alias("context"))


def findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.by_severity(_findings(spark, sf_dir))


def findings_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.by_type(_findings(spark, sf_dir))


def findings_at_least_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.at_least(_findings(spark, sf_dir), 3).groupBy("file", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("last_line"))


def findings_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = chosen(["sql_injection", "xss", "path_traversal", "no_such_rule"], ["path_traversal"])
    return match.findings(events_corpus(spark, sf_dir), rules).groupBy("rule_id", "type").agg(F.count(F.lit(1)).alias("n"))


def literal_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.findings(events_corpus(spark, sf_dir), [LITERAL]).select("finding_id", "pattern", "file", "line", "column", "code", "confidence")


def selected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return events_corpus(spark, sf_dir).select(
        "path", paths.extension(path).alias("extension"), paths.language_of(path).alias("scanner_language"), paths.language_of(F.upper(path), "parser").alias("parser_language"),
        paths.readable(path).alias("readable"), paths.ignored(path).alias("ignored"), paths.ignored(path, ["/corpus/src", "app"], ["f1?.php"], []).alias("ignored_by_list"),
        match.line_count(F.col("content")).cast("long").alias("n_lines"), F.sha2("content", 256).alias("sha256"),
    )


def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = events_corpus(spark, sf_dir)
    read = paths.readable(F.col("path")) & ~paths.ignored(F.col("path"))
    return match.scan_stats(files, match.findings(files.filter(read)), read)


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.text_blocks(_findings(spark, sf_dir)).select("file", F.col("ordinal").cast("int").alias("ordinal"), F.md5(F.col("block").cast("binary")).alias("digest"), F.length("block").alias("size"))


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.json_findings(_findings(spark, sf_dir))


def report_sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif_rules(_findings(spark, sf_dir))


def report_sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif_results(_findings(spark, sf_dir))


def findings_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.by_rule(_findings(spark, sf_dir))


def severity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.gate(_findings(spark, sf_dir))


def first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's limit on files, as a report of what it would read."""
    return paths.at_most(events_corpus(spark, sf_dir), 100).select("path", paths.to_uri(F.col("path")).alias("uri"), match.line_count(F.col("content")).cast("long").alias("n_lines"))


def document_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets assigned in the lines of documents, by the looser pattern of the syntax rules."""
    rule = Rule("SEC-001", "hardcoded_secrets", "Secret", "Hardcoded secret detected in assignment", 3, ("*",), "CWE-798", "A02:2021", "Cryptographic Failures", "", (SECRET,))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"))
    return match.findings(files, [rule]).select(F.col("file").cast("long").alias("doc_id"), "line", "column", "code")


SECRET = r"""(?i)(secret|token)\s*=\s*["'][^"']{12,}["']"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _branch(rule: Rule, k: int, seq: int, pattern: str, lines: str = "code_lines") -> str:
    where = "" if "*" in rule.languages else f" AND language IN ({', '.join(map(_quoted, rule.languages))})"
    q = _quoted(pattern)
    return f"SELECT path, language, line_no, text, {k} AS rule, {seq} AS pattern, regexp_extract_all(text, {q}, 0) AS m, regexp_split_to_array(text, {q}) AS sp FROM {lines} WHERE regexp_matches(text, {q}){where}"


def hits_sql(rules: list[Rule], lines: str = "code_lines") -> str:
    """CTEs hits(path, language, line_no, text, rule, pattern, start)."""
    branches = " UNION ALL ".join(_branch(r, k, s, p, lines) for k, r in enumerate(rules) for s, p in enumerate(r.patterns))
    return f"""every AS ({branches}),
hits AS (SELECT path, language, line_no, text, rule, pattern, unnest(list_transform(generate_series(1, len(m)), lambda i:
    (list_sum(list_transform(sp[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: strlen(x))), 0))::BIGINT)) AS start FROM every)"""


def _meta(rules: list[Rule]) -> str:
    rows = ", ".join(f"({k}, " + ", ".join(_quoted(x) for x in (r.rule_id, r.type, r.name, r.description, r.cwe, r.owasp, r.category, r.remediation)) + f", {r.severity})" for k, r in enumerate(rules))
    return f"meta AS (SELECT * FROM (VALUES {rows}) v(rule, rule_id, type, title, description, cwe, owasp, category, remediation, severity))"


FOUND = f"""WITH {SQL}, {hits_sql(RULES)}, {_meta(RULES)},
found AS (SELECT rule_id || '-' || h.path || '-' || line_no || '-' || start AS finding_id, pattern::INTEGER AS pattern, rule_id, type, severity::INTEGER AS severity, title, description, h.path AS file,
  line_no AS line, (start + 1)::INTEGER AS "column", trim(text) AS code, cwe, owasp, category, remediation, 85::INTEGER AS confidence,
  array_to_string(list_transform(generate_series(greatest(1, line_no - 2), least(n_lines, line_no + 2)), lambda k: CASE WHEN k = line_no THEN '>> ' ELSE '   ' END || lpad(k::VARCHAR, 4, ' ') || ': ' || lines[k]), chr(10)) AS context
  FROM hits h JOIN meta USING (rule) JOIN code_files c ON c.path = h.path)
"""
NAME = "CASE severity WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END"
_ORDERED = 'ORDER BY severity DESC, file, line, "column", finding_id'
_EXCLUDED = "|".join(x.replace(".", "[.]") for x in paths.EXCLUDED)
_FILES = f"""WITH {SQL}, p AS (SELECT *, regexp_extract(path, '([.][^./]*)$', 1) AS extension, regexp_replace(path, '/[^/]*$', '') AS folder FROM code_files),
s AS (SELECT *, extension IN ({', '.join(map(_quoted, paths.EXTENSIONS))}) AS readable, regexp_matches('/' || folder || '/', '/({_EXCLUDED})/') AS ignored,
  NOT (starts_with(folder, '/corpus/src') OR contains('/' || folder || '/', '/app/')) OR regexp_matches(folder, '(^|/)f1[^/][.]php(/|$)') AS ignored_by_list FROM p)
"""
_LANG = "CASE extension WHEN '.php' THEN 'php' WHEN '.js' THEN 'javascript' WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.go' THEN 'go' WHEN '.rb' THEN 'ruby' ELSE 'unknown' END"
_JSON = """'{"finding_id":' || to_json(finding_id) || ',"rule_id":' || to_json(rule_id) || ',"type":' || to_json(type) || ',"severity":' || severity || ',"file":' || to_json(file) || ',"line":' || line || ',"column":' || "column" || ',"code":' || to_json(code) || ',"cwe":' || to_json(cwe) || ',"confidence":' || confidence || '}'"""
_BLOCK = """'[' || ordinal || '] ' || title || chr(10) || '    Severity: ' || upper(name) || chr(10) || '    File: ' || file || ':' || line || ':' || "column" || chr(10) || '    Type: ' || type || chr(10) ||
 '    Rule: ' || rule_id || chr(10) || '    CWE: ' || cwe || chr(10) || '    OWASP: ' || owasp || ' (' || category || ')' || chr(10) || '    Description: ' || description || CASE WHEN code <> '' THEN chr(10) || '    Code: ' || code ELSE '' END || chr(10) || '    Context:' || chr(10) ||
 '      ' || replace(context, chr(10), chr(10) || '      ') || chr(10) || '    Remediation: ' || remediation || chr(10) || '    Confidence: ' || confidence || '%'"""
_LEVEL = "CASE WHEN severity IN (2, 3) THEN 'error' WHEN severity = 0 THEN 'note' ELSE 'warning' END"
_LITERALS = " UNION ALL ".join(f"SELECT path, line_no, text, {s} AS pattern, strlen(split_part(text, {_quoted(p)}, 1)) AS start FROM code_lines WHERE contains(text, {_quoted(p)})" for s, p in enumerate(LITERAL.literals))

QUERIES = {
    "findings": findings,
    "findings_by_severity": findings_by_severity,
    "findings_by_type": findings_by_type,
    "findings_at_least_high": findings_at_least_high,
    "findings_enabled": findings_enabled,
    "literal_findings": literal_findings,
    "selected_files": selected_files,
    "scan_stats": scan_stats,
    "report_text": report_text,
    "report_json": report_json,
    "report_sarif_rules": report_sarif_rules,
    "report_sarif_results": report_sarif_results,
    "findings_by_rule": findings_by_rule,
    "severity_gate": severity_gate,
    "first_files": first_files,
    "document_secrets": document_secrets,
}
ORACLES = {
    "findings": FOUND + f"SELECT {', '.join(c if c != 'column' else chr(34) + c + chr(34) for c in COLUMNS)}, context FROM found",
    "findings_by_severity": FOUND + f"SELECT {NAME} AS severity, count(*) AS n FROM found GROUP BY ALL",
    "findings_by_type": FOUND + "SELECT type, count(*) AS n FROM found GROUP BY ALL",
    "findings_at_least_high": FOUND + "SELECT file, rule_id, count(*) AS n, max(line) AS last_line FROM found WHERE severity >= 3 GROUP BY ALL",
    "findings_enabled": FOUND + "SELECT rule_id, type, count(*) AS n FROM found WHERE type IN ('sql_injection', 'xss') GROUP BY ALL",
    "literal_findings": f"""WITH {SQL}, l AS ({_LITERALS})
SELECT 'LOCAL-001-' || path || '-' || line_no || '-' || start AS finding_id, pattern::INTEGER AS pattern, path AS file, line_no AS line, (start + 1)::INTEGER AS "column", trim(text) AS code, 75::INTEGER AS confidence FROM l""",
    "selected_files": _FILES + f"SELECT path, extension, {_LANG} AS scanner_language, {_LANG} AS parser_language, readable, ignored, ignored_by_list, n_lines::BIGINT AS n_lines, sha256(content) AS sha256 FROM s",
    "scan_stats": FOUND.replace("WITH ", _FILES + ", ", 1).replace(f"{SQL}, every", "every", 1)
    + "SELECT (SELECT count(*) FROM s WHERE readable AND NOT ignored) AS files_scanned, (SELECT count(*) FROM s WHERE NOT readable OR ignored) AS files_skipped, (SELECT sum(n_lines)::BIGINT FROM s WHERE readable AND NOT ignored) AS lines_scanned, (SELECT count(*) FROM found JOIN s ON s.path = file WHERE readable AND NOT ignored) AS findings_total",
    "report_text": FOUND + f""", r AS (SELECT *, {NAME} AS name, row_number() OVER ({_ORDERED}) AS ordinal FROM found), b AS (SELECT file, ordinal, {_BLOCK} AS block FROM r)
SELECT file, ordinal::INTEGER AS ordinal, md5(block) AS digest, length(block)::INTEGER AS size FROM b""",
    "report_json": FOUND + f"SELECT finding_id, pattern, {_JSON} AS json FROM found",
    "report_sarif_rules": FOUND + f"""SELECT rule_id, '{{"id":' || to_json(rule_id) || ',"name":' || to_json(title) || ',"shortDescription":{{"text":' || to_json(title) || '}},"fullDescription":{{"text":' || to_json(description)
 || '}},"defaultConfiguration":{{"level":"' || {_LEVEL} || '"}},"properties":{{"tags":["' || type || '","' || {NAME} || '"],"cwe":"' || cwe || '","owasp":"' || owasp || '"}}}}' AS json FROM (SELECT DISTINCT rule_id, title, description, severity, type, cwe, owasp FROM found)""",
    "report_sarif_results": FOUND + f"""SELECT finding_id, pattern, {_LEVEL} AS level, '{{"ruleId":' || to_json(rule_id) || ',"message":{{"text":' || to_json(description) || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":' || to_json(file)
 || '}},"region":{{"startLine":' || line || ',"startColumn":' || "column" || '}}' || CASE WHEN code <> '' THEN ',"contextRegion":{{"snippet":{{"text":' || to_json(code) || '}}}}' ELSE '' END || '}}}}],"level":"' || {_LEVEL} || '"}}' AS json FROM found""",
    "findings_by_rule": FOUND + ', r AS (SELECT rule_id, count(*) OVER (PARTITION BY rule_id) AS n, file, line, "column", row_number() OVER (PARTITION BY rule_id ORDER BY file, line, "column") AS k FROM found) SELECT rule_id, n, (SELECT count(DISTINCT file) FROM found f WHERE f.rule_id = r.rule_id) AS files, file, line, "column" FROM r WHERE k = 1',
    "severity_gate": FOUND + "SELECT file, bool_or(severity = 3) AS has_critical, bool_or(severity = 2) AS has_high FROM found GROUP BY file",
    "first_files": f"WITH {SQL} SELECT path, 'file://' || path AS uri, n_lines::BIGINT AS n_lines FROM code_files ORDER BY path LIMIT 100",
    "document_secrets": f"""WITH doc_lines AS (SELECT doc_id::VARCHAR AS path, lang AS language, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents),
{hits_sql([Rule("", "", "", "", 3, ("*",), "", "", "", "", (SECRET,))], "doc_lines")}
SELECT path::BIGINT AS doc_id, line_no::INTEGER AS line, (start + 1)::INTEGER AS "column", trim(text) AS code FROM hits""",
}
