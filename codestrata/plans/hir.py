"""Queries over statements with taint, on PHP functions derived from events; a file holds a run of 200."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexer import tokens
from ..operators import hir
from ..session import table

PER_FILE = 200
BLOCKS = [
    """function q@($db) {
    $id = $_GET["id"];
    $sql = "SELECT " . $id;
    mysqli_query($db, $sql);
    $id = 1;
    $sql = "SELECT " . $id;
    mysqli_query($db, $sql);
}
""",
    """function r@($db, $b) {
    $a = $_POST["a"];
    if ($a > 1) {
        $a = intval($a);
    }
    $db->query("X" . $a);
    while ($b) {
        $db->query($c);
        $c = $a;
    }
    $a .= "more";
    exec($a);
}
""",
    """function s@($db) {
    $a = $_GET["a"];
    if ($db) {
        $a = 1;
    } else {
        $a = "2";
    }
    mysqli_query($db, $a);
    return mysqli_query($db, $_COOKIE["c"]);
}
""",
]
#: Of each kind of function: its name, and line, subject and line of the source of its findings.
FOUND = [("q@", [(3, "$sql", 1)]), ("r@", [(5, "$a", 1), (7, "$c", 1), (11, "$a", 1)]), ("s@", [(8, "$_COOKIE", 8)])]
#: Kinds of statements of each, in order, with their targets.
STATED = [
    [(1, "assign", "$id"), (2, "assign", "$sql"), (3, "call", None), (4, "assign", "$id"), (5, "assign", "$sql"), (6, "call", None)],
    [(1, "assign", "$a"), (2, "if", None), (3, "assign", "$a"), (5, "call", None), (6, "while", None), (7, "call", None), (8, "assign", "$c"), (10, "assign", "$a"), (11, "call", None)],
    [(1, "assign", "$a"), (2, "if", None), (3, "assign", "$a"), (4, "else", None), (5, "assign", "$a"), (7, "call", None), (8, "return", None)],
]


def _statements(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / PER_FILE).alias("f"))
    block = F.replace(F.element_at(F.array(*map(F.lit, BLOCKS)), (F.col("event_id") % len(BLOCKS) + 1).cast("int")), F.lit("@"), F.col("event_id").cast("string"))
    files = rows.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("event_id", block.alias("text")))).alias("b"))
    files = files.select(F.format_string("/hir/f%d.php", "f").alias("path"), F.lit("php").alias("language"), F.concat(F.lit("<?php\n"), F.array_join(F.transform("b", lambda b: b["text"]), "")).alias("content"))
    return hir.statements(tokens(files, ["path", "language", "n", "stmt", "head", "chain", "function", "own"], {"first": True}))


def hir_statements(spark, sf_dir):
    return _statements(spark, sf_dir).select("unit", "line", "kind", "target")


def hir_findings(spark, sf_dir):
    return hir.findings(_statements(spark, sf_dir))


_SIZES = ", ".join(f"({k}, {b.count(chr(10))}, '{FOUND[k][0]}')" for k, b in enumerate(BLOCKS))
_SQL = f"""WITH sizes(k, lines, name) AS (VALUES {_SIZES}), placed AS (SELECT event_id, event_id // {PER_FILE} AS f, event_id % {len(BLOCKS)} AS k FROM events),
units AS (SELECT '/hir/f' || f || '.php' AS path, k, replace(name, '@', event_id::VARCHAR) AS name, (1 + coalesce(sum(lines) OVER (PARTITION BY f ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS first FROM placed JOIN sizes USING (k))"""
_text = lambda x: "NULL" if x is None else f"'{x}'"
_FOUND = ", ".join(f"({k}, {line}, '{subject}', {source})" for k, (_, own) in enumerate(FOUND) for line, subject, source in own)
_STATED = ", ".join(f"({k}, {line}, '{kind}', {_text(target)})" for k, own in enumerate(STATED) for line, kind, target in own)
QUERIES = {f.__name__: f for f in (hir_statements, hir_findings)}
ORACLES = {
    "hir_statements": _SQL + f", s(k, line, kind, target) AS (VALUES {_STATED}) SELECT path || '#' || name || '#' || first AS unit, (first + line)::INTEGER AS line, kind, target FROM units JOIN s USING (k)",
    "hir_findings": _SQL + f""", s(k, line, subject, source) AS (VALUES {_FOUND}) SELECT '{hir.RULE}' AS rule_id, path, path || '#' || name || '#' || first AS unit, (first + line)::INTEGER AS line, subject, (first + source)::INTEGER AS source_line,
 {hir.SEVERITY} AS severity, {hir.CONFIDENCE} AS confidence, '{hir.MESSAGE}' AS message FROM units JOIN s USING (k)""",
}
