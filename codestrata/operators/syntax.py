"""Syntax of PHP lines as relations, the rules over them, and taint.

Every relation has path and line. Classes, functions, calls and assignments are read line by line.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import portable
from .match import lines_of

NAME = "([a-zA-Z_][a-zA-Z0-9_]*)"
# Line patterns, name lists and messages of the syntax rules.
FUNCTION = rf"function\s+{NAME}\s*\(([^)]*)\)"
CLASS = rf"class\s+{NAME}\s*(?:extends\s+{NAME})?\s*(?:implements\s+([^{{]+))?\s*\{{"
ASSIGNMENT = rf"\${NAME}\s*=\s*(.+);"
CALL = rf"{NAME}\s*\(([^)]*)\)"
PRINTED = rf"^\s*(echo|print)\s+([^;]+);"
USE = r"^\s*use\s+([A-Za-z0-9_\\]+)(?:\s+as\s+([A-Za-z0-9_]+))?\s*;"
NAMESPACE = r"^\s*namespace\s+([A-Za-z0-9_\\]+)\s*[;{]"
INCLUDE = r"""^\s*(include|include_once|require|require_once)\s*\(?\s*["']([^"']+)["']"""
SUPERGLOBALS = r"\$_(GET|POST|REQUEST|COOKIE|FILES|SERVER)"
CONSTRUCTS = ["if", "for", "foreach", "while", "switch", "catch", "function", "array", "isset", "empty", "list", "return", "echo", "print"]
SQL_CALLS = ["mysql_query", "mysqli_query", "pg_query", "sqlite_query", "query", "exec", "execute", "prepare"]
PDO_CALLS = ["query", "exec", "prepare"]
OUTPUTS = ["echo", "print", "printf", "sprintf", "print_r", "var_dump"]
ESCAPES = ["htmlspecialchars", "htmlentities", "strip_tags", "filter_var"]
COMMANDS = ["exec", "system", "shell_exec", "passthru", "eval", "popen", "proc_open", "backticks"]
FILES = ["file_get_contents", "file_put_contents", "fopen", "readfile", "include", "require", "include_once", "require_once"]
PATH_CHECKS = ["realpath", "basename", "pathinfo", "filter_var"]
CRYPTO = ["md5", "sha1", "crypt", "mcrypt"]
UNSAFE = ["unserialize", "eval"]
SECRETS = [
    r"""(?i)(password|pwd|pass)\s*=\s*["'][^"']{8,}["']""",
    r"""(?i)(api_key|apikey|access_key)\s*=\s*["'][^"']{16,}["']""",
    r"""(?i)(secret|token)\s*=\s*["'][^"']{12,}["']""",
    r"""(?i)(db_pass|database_password)\s*=\s*["'][^"']{4,}["']""",
]
#: Severity (0 to 4) and confidence of each rule.
RULES = {"SQL-001": (3, 85), "SQL-002": (3, 90), "XSS-001": (3, 80), "XSS-002": (3, 75), "CMD-001": (4, 90), "PATH-001": (3, 85), "SEC-001": (3, 95), "CRYPTO-001": (2, 90), "DESER-001": (3, 85)}


def source_lines(files: DataFrame, language: str | None = None) -> DataFrame:
    """path, language, line (from 1), text."""
    rows = files.filter(F.col("language") == language) if language else files
    return rows.select("path", "language", F.posexplode(lines_of(F.col("content"))).alias("i", "text")).select("path", "language", (F.col("i") + 1).alias("line"), "text")


def _group(pattern: str, k: int) -> Column:
    return F.regexp_extract("text", portable(pattern), k)


def functions(lines: DataFrame) -> DataFrame:
    """path, line, name, params: the first function header of a line."""
    params = F.regexp_extract_all(_group(FUNCTION, 2), F.lit(rf"\${NAME}"), F.lit(1))
    return lines.filter(F.col("text").rlike(portable(FUNCTION))).select("path", "line", _group(FUNCTION, 1).alias("name"), params.alias("params"))


def classes(lines: DataFrame) -> DataFrame:
    """path, line, name, extends (null if none), implements."""
    names = F.filter(F.transform(F.split(_group(CLASS, 3), ","), lambda x: F.trim(x)), lambda x: x != "")
    return lines.filter(F.col("text").rlike(portable(CLASS))).select("path", "line", _group(CLASS, 1).alias("name"), F.nullif(_group(CLASS, 2), F.lit("")).alias("extends"), names.alias("implements"))


def assignments(lines: DataFrame) -> DataFrame:
    """path, line, target, rhs, rhs_name (of a right side that is one variable), tainted."""
    rhs = _group(ASSIGNMENT, 2)
    return lines.filter(F.col("text").rlike(portable(ASSIGNMENT))).select(
        "path", "line", "text", _group(ASSIGNMENT, 1).alias("target"), rhs.alias("rhs"), F.nullif(F.regexp_extract(rhs, rf"^\${NAME}$", 1), F.lit("")).alias("rhs_name"), rhs.rlike(SUPERGLOBALS).alias("tainted")
    )


def calls(lines: DataFrame) -> DataFrame:
    """path, line, seq, name, args: calls of a line, language constructs left out; echo and print take what follows them."""
    none = F.array().cast("array<string>")
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(portable(CALL)), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(portable(CALL)), F.lit(2)).alias("raw"))
    printed = F.when(F.col("text").rlike(portable(PRINTED)), F.array(F.struct(_group(PRINTED, 1).alias("name"), _group(PRINTED, 2).alias("raw")))).otherwise(F.array().cast("array<struct<name:string,raw:string>>"))
    kept = F.concat(F.filter(found, lambda c: ~F.lower(c["name"]).isin(CONSTRUCTS)), printed)
    rows = lines.filter(F.col("text").rlike(portable(CALL)) | F.col("text").rlike(portable(PRINTED))).select("path", "line", F.posexplode(kept).alias("seq", "c"))
    args = F.when(F.trim("c.raw") == "", none).otherwise(F.transform(F.split("c.raw", ","), lambda x: F.trim(x)))
    return rows.select("path", "line", "seq", "c.name", args.alias("args"))


def arguments(rows: DataFrame) -> DataFrame:
    """path, line, seq, name, idx, value, variable (null if the argument is not one variable), concat."""
    value = F.col("value")
    concat = value.rlike(r"""["'$A-Za-z0-9_\])]\s*[.+]\s*["'$]""")
    return rows.select("path", "line", "seq", "name", F.posexplode("args").alias("idx", "value")).select("*", F.nullif(F.regexp_extract(value, rf"^\${NAME}$", 1), F.lit("")).alias("variable"), concat.alias("concat"))


def _followed(seeds: list[tuple[str, int]], edges: list[tuple[str, str, int]]) -> dict[str, tuple[int, int, str | None, int]]:
    """variable -> (steps, line of the source, the variable before, line of the assignment from it; for a source its own line). Breadth first, so
    that steps are the fewest; of equals the earliest source decides, then the predecessor's name, then the line."""
    onward: dict[str, list[tuple[str, int]]] = {}
    for variable, target, line in edges:
        onward.setdefault(variable, []).append((target, line))
    found: dict[str, tuple[int, int, str | None, int]] = {}
    for variable, line in sorted(seeds, key=lambda s: s[1]):
        found.setdefault(variable, (0, line, None, line))
    last, steps = list(found), 0
    while last:
        steps += 1
        reached: dict[str, tuple[int, str, int]] = {}
        for variable in last:
            for target, line in onward.get(variable, ()):
                if target not in found:
                    way = (found[variable][1], variable, line)
                    if target not in reached or way < reached[target]:
                        reached[target] = way
        found.update({target: (steps, *way) for target, way in reached.items()})
        last = list(reached)
    return found


def _closures(assigned: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """path, variable, steps, source_line, previous, line; with ``wanted`` (path, variable) only these, and the lines of the whole way as ``trail``."""
    picked = assigned.filter("tainted OR rhs_name IS NOT NULL").select("path", F.struct("line", "target", "rhs_name", "tainted").alias("a"))
    files = picked.groupBy("path").agg(F.collect_list("a").alias("a"), F.max("a.tainted").alias("any")).filter("any")
    if wanted is None:
        files = files.withColumn("wanted", F.lit(None).cast("array<string>"))
    else:
        files = files.join(wanted.groupBy("path").agg(F.collect_set("variable").alias("wanted")), "path")

    @F.arrow_udf("array<struct<variable: string, steps: int, source_line: int, previous: string, line: int, trail: array<int>>>")
    def followed(column: pa.Array, wanted_of: pa.Array) -> pa.Array:
        out = []
        for rows, names in zip(column.to_pylist(), wanted_of.to_pylist()):
            found = _followed([(r["target"], r["line"]) for r in rows if r["tainted"]], [(r["rhs_name"], r["target"], r["line"]) for r in rows if r["rhs_name"] is not None])
            own = []
            for variable in found if names is None else [n for n in names if n in found]:
                steps, source, previous, line = found[variable]
                trail, at = [], None if names is None else variable
                while at is not None:
                    trail.append(found[at][3])
                    at = found[at][2]
                own.append({"variable": variable, "steps": steps, "source_line": source, "previous": previous, "line": line, "trail": trail[::-1]})
            out.append(own)
        kind = pa.struct([("variable", pa.string()), ("steps", pa.int32()), ("source_line", pa.int32()), ("previous", pa.string()), ("line", pa.int32()), ("trail", pa.list_(pa.int32()))])
        return pa.array(out, pa.list_(kind))

    return files.select("path", F.explode(followed("a", "wanted")).alias("t")).select("path", "t.*")


def tainted_variables(assigned: DataFrame) -> DataFrame:
    """path, variable, steps, source_line, previous, line: variables that user input reaches through variable-to-variable assignments, the fewest
    steps, the line of the assignment that took the input in, and the variable and assignment it comes from last. Each file's assignments come
    together in one shuffle and are followed once, so chains of any length and cycles take no further rounds."""
    return _closures(assigned).drop("trail")


def rule_findings(lines: DataFrame) -> DataFrame:
    """rule_id, path, line, seq, subject, severity, confidence of the rules over calls, arguments and assignments.

    Each relation is passed over once: its rows get the findings of all rules that look at it as an array.
    """
    assigned, called = assignments(lines), calls(lines)
    name, value = F.lower("name"), F.col("value")

    def hit(rule: str, holds: Column, subject: Column) -> Column:
        severity, sure = RULES[rule]
        return F.when(holds, F.array(F.struct(F.lit(rule).alias("rule_id"), subject.alias("subject"), F.lit(severity).alias("severity"), F.lit(sure).alias("confidence"))))

    def hits(rows: DataFrame, *found: Column) -> DataFrame:
        none = F.array().cast("array<struct<rule_id:string,subject:string,severity:int,confidence:int>>")
        every = F.concat(*[F.coalesce(f, none) for f in found])
        return rows.select("path", "line", "seq", F.explode(every).alias("h")).select("h.rule_id", "path", "line", "seq", "h.subject", "h.severity", "h.confidence")

    # What is known of each variable of a file, in one row: tainted, escaped, checked.
    marks = [F.col("rhs").rlike(rf"^({'|'.join(names)})\s*\(").cast("int").alias(c) for c, names in (("escaped", ESCAPES), ("checked", PATH_CHECKS))]
    known = assigned.select("path", F.col("target").alias("variable"), F.lit(0).alias("tainted"), *marks)
    known = known.unionByName(tainted_variables(assigned).select("path", "variable", F.lit(1).alias("tainted"), F.lit(0).alias("escaped"), F.lit(0).alias("checked")))
    known = known.groupBy("path", "variable").agg(*[(F.max(c) == 1).alias(c) for c in ("tainted", "escaped", "checked")])

    args = arguments(called).join(known, ["path", "variable"], "left").withColumn("dirty", F.coalesce("tainted", F.lit(False)) | value.rlike(SUPERGLOBALS))
    dirty, untreated = F.col("dirty"), lambda c: F.col("dirty") & ~F.coalesce(c, F.lit(False))
    severity, sure = RULES["SQL-001"]
    sinks = F.filter(F.array(*map(F.lit, SQL_CALLS)), lambda s: name.contains(s))
    per_sink = F.when(dirty, F.transform(sinks, lambda s: F.struct(F.lit("SQL-001").alias("rule_id"), s.alias("subject"), F.lit(severity).alias("severity"), F.lit(sure).alias("confidence"))))
    from_args = hits(
        args,
        per_sink,
        hit("SQL-002", name.isin(PDO_CALLS) & F.col("concat"), F.col("name")),
        hit("XSS-001", name.isin(OUTPUTS) & untreated("escaped"), F.col("name")),
        hit("CMD-001", name.isin(COMMANDS) & dirty, F.col("name")),
        hit("PATH-001", name.isin(FILES) & (untreated("checked") | value.rlike(r"""^["'].*\.\.[/\\]""")), F.col("name")),
    ).distinct()  # several arguments of a call give a finding once
    from_calls = hits(called, hit("CRYPTO-001", name.isin(CRYPTO), name), hit("DESER-001", name.isin(UNSAFE), name)).distinct()
    from_assignments = hits(
        assigned.withColumn("seq", F.lit(0)),
        hit("XSS-002", F.col("rhs").rlike(r"\$?_(GET|POST|REQUEST|COOKIE|SERVER)"), F.col("target")),
        *[hit("SEC-001", F.col("text").rlike(portable(p)), F.lit(f"pattern {k}")) for k, p in enumerate(SECRETS)],
    )
    return from_args.unionByName(from_calls).unionByName(from_assignments)


def summary(found: DataFrame) -> DataFrame:
    """One row per severity and per rule, from one pass over the findings."""
    return found.groupingSets([["severity"], ["rule_id"]], "severity", "rule_id").agg(F.count(F.lit(1)).alias("n"))


# Import statements by language; the first group is what is imported.
IMPORTS = {
    "go": r"""^\s*import\s+(?:[A-Za-z_.]+\s+)?"([^"]+)["]""",
    "python": r"^\s*(?:import|from)\s+([A-Za-z0-9_.]+)",
    "java": r"^\s*import\s+(?:static\s+)?([A-Za-z0-9_.*]+)\s*;",
    "javascript": r"""^\s*import\s.*["']([^"']+)["']""",
    "php": USE,
}
SINKS = ["echo", "print", "query", "exec", "system", "mysqli_query"]


def imports(lines: DataFrame) -> DataFrame:
    """path, line, module of the import statements of every language."""
    module = F.lit(None).cast("string")
    for language, pattern in IMPORTS.items():
        own = (F.col("language") == language) & F.col("text").rlike(portable(pattern))
        module = F.when(own, F.regexp_extract("text", portable(pattern), 1)).otherwise(module)
    return lines.withColumn("module", module).filter("module IS NOT NULL").select("path", "line", "module")


def metrics(lines: DataFrame) -> DataFrame:
    """path, functions, classes, assignments, calls of every file with lines."""
    text = F.col("text")
    marks = [F.when(text.rlike(portable(p)), 1).otherwise(0).alias(c) for c, p in (("functions", FUNCTION), ("classes", CLASS), ("assignments", ASSIGNMENT))]
    counted = lines.select("path", *marks, F.lit(0).alias("calls")).unionByName(calls(lines).select("path", *[F.lit(0).alias(c) for c in ("functions", "classes", "assignments")], F.lit(1).alias("calls")))
    return counted.groupBy("path").agg(*[F.sum(c).alias(c) for c in ("functions", "classes", "assignments", "calls")])


def taint_paths(lines: DataFrame) -> DataFrame:
    """path, variable, source_line, sink, sink_line, steps, trail: each tainted variable that stands in a sink's argument, with the line
    that took the input in and the lines it passed from there."""
    args = arguments(calls(lines)).filter(F.col("name").isin(SINKS) & F.col("variable").isNotNull())
    sinks = args.select("path", "variable", "name", "line").distinct()
    found = _closures(assignments(lines), sinks).withColumnRenamed("line", "last_line")
    return sinks.join(found, ["path", "variable"]).select("path", "variable", "source_line", F.col("name").alias("sink"), F.col("line").alias("sink_line"), "steps", "trail")


def function_findings(lines: DataFrame, names: list[str], confidence: int = 90) -> DataFrame:
    """path, line, name, wanted, confidence: calls whose names contain one of the texts."""
    wanted = F.explode(F.filter(F.array(*map(F.lit, names)), lambda n: F.col("name").contains(n))).alias("wanted")
    return calls(lines).select("path", "line", "seq", "name", wanted).withColumn("confidence", F.lit(confidence))
