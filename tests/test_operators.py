import json
import re
from pathlib import Path

import random
import time

import pytest
from pyspark.sql import functions as F

from codestrata.functions import paths
from codestrata.functions.regex import match_offsets, match_spans, portable
from codestrata.operators import flow, graphs, incremental, match, report, symbols, syntax
from codestrata.operators.rules import RULES, SEVERITIES, chosen, parse_severity
from codestrata.scan import scan
from codestrata.streaming import reanalysis

PHP = """<?php
class User extends Model implements A, B {
public function find($id, $name) {
$user_id = $_GET["id"];
$copy = $user_id;
mysqli_query($db, $copy);
echo $user_id;
$safe = htmlspecialchars($copy);
exec($user_id);
$password = "supersecret1";
$token = "0123456789abcdef";
md5($x); unserialize($y);
"""


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("/a/u.php", "php", PHP), ("/a/n.php", "php", None), ("/a/e.php", "php", ""), ("/a/x.ts", "typescript", 'é api_key = "0123456789abcdef"\n')], "path string, language string, content string")


def test_severities_and_choice():
    assert [parse_severity(s) for s in ("low", "Medium", "HIGH", "critical", "invalid")] == [0, 1, 2, 3, 1]
    assert [r.type for r in chosen(["sql_injection", "xss", "unknown"], ["xss"])] == ["sql_injection"]
    assert len(chosen()) == len(RULES) == 5


def test_offsets_are_bytes(spark):
    text = "é ../a é../b"
    (row,) = spark.createDataFrame([(text,)], "t string").select(match_offsets(F.col("t"), portable(r"(?i)\.\.\/|\.\.\\")).alias("m"), match_spans(F.col("t"), portable(r"\.\./([a-z])")).alias("s")).collect()
    wanted = [m.start() for m in re.finditer(rb"\.\./", text.encode())]
    assert [m["start"] for m in row["m"]] == wanted == [m["start"] for m in row["s"]]
    assert [m["value"] for m in row["s"]] == ["a", "b"]


def test_portable_patterns(spark):
    checks = [(r"a\sb", "a\x0bb", False), (r"a.b", "a b", True), (r"(?i)select", "ſelect", True), (r"(?m)^b", "a\rb", False), (r"[\s]x", " x", True)]
    for pattern, text, wanted in checks:
        assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(portable(pattern))).first()[0] is wanted


def test_findings(files):
    rows = {(r["rule_id"], r["file"], r["line"]): r for r in match.findings(files).collect()}
    secret = rows["OWASP-A02-001", "/a/x.ts", 1]
    assert secret["column"] == 4 and secret["confidence"] == 85 and secret["context"] == ['>>    1: é api_key = "0123456789abcdef"', "      2: "]
    assert ("OWASP-A02-001", "/a/u.php", 10) in rows and not any(f == "/a/x.ts" and r != "OWASP-A02-001" for r, f, _ in rows)
    (stats,) = match.scan_stats(files, match.findings(files), F.lit(True)).collect()
    assert (stats["files_scanned"], stats["lines_scanned"], stats["findings_total"]) == (4, 13, len(rows))


def whole(folder):
    """A report's files, one after another."""
    return "".join(p.read_text() for p in sorted(Path(folder).glob("part-*")))


def test_names_are_resolved(spark):
    text = "<?php\nnamespace Shop\\Web;\nuse App\\Model as M;\nuse Lib\\send;\nclass A extends M implements Near {\nfunction local($x) {\nsend($x);\nlocal($x);\nelsewhere($x);\n"
    other = "<?php\nclass B extends M {\n"
    rows = spark.createDataFrame([("/a.php", "php", text), ("/b.php", "php", other)], "path string, language string, content string")
    got = {(r["path"], r["kind"], r["name"]): (r["fqn"], r["via"]) for r in graphs.resolved_names(syntax.source_lines(rows, "php")).collect()}
    assert got["/a.php", "class", "M"] == ("\\App\\Model", "use") and got["/b.php", "class", "M"] == ("\\M", "namespace")
    assert got["/a.php", "class", "Near"] == ("\\Shop\\Web\\Near", "namespace")
    assert got["/a.php", "function", "send"] == ("\\Lib\\send", "use") and got["/a.php", "function", "local"] == ("\\local", "global")
    assert got["/a.php", "function", "elsewhere"] == ("\\Shop\\Web\\elsewhere", "namespace")


def test_reports(spark, files, tmp_path):
    found = match.findings(files).withColumn("severity", F.when(F.col("line") > 5, 3).otherwise(1))
    stats = match.scan_stats(files, found, F.lit(True))
    n = found.count()
    for kind in ("text", "json", "SARIF", ""):
        report.write_report(found, stats, str(tmp_path / (kind or "plain")), kind)
    text = whole(tmp_path / "text")
    assert text == whole(tmp_path / "plain") and text.startswith("=== Security Scanner Report ===\n\nFiles scanned: 4\n") and "    Context:\n" in text
    heads = [line for line in text.split("\n") if line.startswith("[")]
    assert [line.split("]")[0] for line in heads] == [f"[{k + 1}" for k in range(n)]
    places = [SEVERITIES.index(line.split(": ")[1].lower()) for line in text.split("\n") if line.startswith("    Severity: ")]
    assert places == sorted(places, reverse=True) and len(set(places)) > 1
    one = json.loads(whole(tmp_path / "json"))
    assert len(one["findings"]) == n == one["statistics"]["findings_total"] == sum(one["statistics"]["by_severity"].values())
    log = json.loads(whole(tmp_path / "SARIF"))
    (run,) = log["runs"]
    assert len(run["results"]) == n and {r["id"] for r in run["tool"]["driver"]["rules"]} == {r["ruleId"] for r in run["results"]}
    nothing = found.limit(0)
    report.write_report(nothing, match.scan_stats(files, nothing, F.lit(True)), str(tmp_path / "none"))
    assert whole(tmp_path / "none").endswith(report.NONE_FOUND + "\n")
    for kind in ("json", "sarif"):
        report.write_report(nothing, match.scan_stats(files, nothing, F.lit(True)), str(tmp_path / f"none-{kind}"), kind)
        assert json.loads(whole(tmp_path / f"none-{kind}"))
    with pytest.raises(ValueError):
        report.write_report(found, stats, str(tmp_path / "bad"), "xml")


def test_scan_of_a_folder(spark, tmp_path):
    for name, text in (("src/a.php", '$password = "longenough";\n'), ("src/b.php", "echo 1;"), ("vendor/c.php", '$password = "longenough";'), ("src/d.txt", "x"), ("lib/e.php", "echo 1;\n$q;")):
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    root = str(tmp_path / "in")
    every = scan(spark, root, ["hardcoded_secrets"])
    assert [r["file"] for r in every.findings.collect()] == [f"{root}/src/a.php"]
    row = every.stats.first()
    assert (row["files_scanned"], row["files_skipped"], row["findings_total"]) == (3, 2, 1)
    assert every.passes("critical") and not every.passes("high")
    assert scan(spark, root, disabled=["hardcoded_secrets"]).findings.isEmpty()
    assert scan(spark, root, allow_dirs=[f"{root}/lib"]).stats.first()["files_scanned"] == 1
    assert scan(spark, root, exclude_dirs=["src"]).stats.first()["files_scanned"] == 1
    assert scan(spark, root, max_files=2).stats.first()["files_scanned"] == 2
    assert scan(spark, root, severity="critical").document().filter(F.col("text").contains(report.NONE_FOUND)).count() == 1
    with pytest.raises(ValueError):
        every.document("xml")


def test_paths(spark):
    rows = [("/p/src/a.php", False), ("/p/vendor/a.php", True), ("/p/node_modules/x/a.js", True), ("/p/lib/a_test.go", False), ("/p/build/a.c", True)]
    df = spark.createDataFrame(rows, "p string, wanted boolean")
    assert df.filter(paths.ignored(F.col("p")) != F.col("wanted")).count() == 0
    assert df.filter(~paths.ignored(F.col("p"), ["/p/src"], [], [])).count() == 1
    (r,) = spark.createDataFrame([("/a/B.JSX",)], "p string").select(paths.language_of(F.col("p")), paths.language_of(F.col("p"), "parser"), paths.extension(F.col("p"))).collect()
    assert tuple(r) == ("unknown", "javascript", ".JSX")


def test_symbols(files):
    rows = {r["name"]: r for r in symbols.scopes(symbols.symbols(files)).collect()}
    assert {"User", "find", "user_id", "password"} <= set(rows)
    assert rows["User"]["parent_id"] is None and rows["find"]["parent_id"] == rows["User"]["symbol_id"]
    assert rows["user_id"]["user_input"] and rows["user_id"]["tainted_sources"] == ["$_GET"]
    assert (rows["find"]["start_line"], rows["find"]["start_char"], rows["find"]["kind"]) == (2, 0, symbols.FUNCTION)


def test_syntax_rules(files):
    lines = syntax.source_lines(files, "php")
    found = {(r["rule_id"], r["line"]) for r in syntax.rule_findings(lines).collect()}
    assert {("SQL-001", 6), ("XSS-001", 7), ("CMD-001", 9), ("SEC-001", 10), ("SEC-001", 11), ("CRYPTO-001", 12), ("DESER-001", 12), ("XSS-002", 4)} <= found
    taint = {r["variable"]: r["steps"] for r in syntax.tainted_variables(syntax.assignments(lines)).collect()}
    assert taint == {"user_id": 0, "copy": 1}
    (c,) = syntax.classes(lines).collect()
    assert (c["name"], c["extends"], c["implements"]) == ("User", "Model", ["A", "B"])
    (f,) = syntax.functions(lines).collect()
    assert (f["name"], f["params"]) == ("find", ["id", "name"])


def graph_of(spark, kinds, connected=False):
    rows = spark.createDataFrame([("u", k, kind) for k, kind in enumerate(kinds)], "unit string, line int, kind string")
    pairs = [(r["from_node"], r["to_node"]) for r in flow.edges(rows, connected).orderBy("seq").collect()]
    return rows, flow.Graph(flow.nodes(rows).count(), pairs)


@pytest.mark.parametrize("kinds, n, wanted, seen, depth", [
    (["basic", "basic"], 3, [(1, 3)], {1, 3}, 1),
    (["basic", "if"], 7, [(3, 4), (4, 5), (4, 6), (5, 7), (6, 7), (1, 7)], {1, 7}, 1),
    (["return", "loop"], 7, [(1, 3), (3, 2), (4, 5), (5, 6), (5, 7), (6, 5), (1, 7)], {1, 2, 3, 7}, 2),
    (["try", "throw"], 8, [(1, 3), (3, 5), (5, 6), (3, 4), (4, 5), (6, 7), (7, 2), (1, 8)], {1, 2, 3, 4, 5, 6, 7, 8}, 5),
])
def test_control_flow(spark, kinds, n, wanted, seen, depth):
    _, graph = graph_of(spark, kinds)
    found, deepest = graph.search()
    assert graph.n == n and graph.pairs == wanted and {v for v in range(n + 1) if found[v]} == seen and deepest == depth


def test_dominators_are_nodes_no_path_avoids():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(2, 12)
        graph = flow.Graph(n, [(rng.randint(1, n), rng.randint(2, n)) for _ in range(rng.randint(0, 20))])
        above, _ = graph.immediate_dominators()
        roots = [v for v in range(1, n + 1) if v == flow.ENTRY or not graph.ahead[v]]

        def reached(without):
            seen, waiting = set(), [r for r in roots if r != without]
            while waiting:
                v = waiting.pop()
                if v not in seen and v != without:
                    seen.add(v)
                    waiting += graph.after[v]
            return seen

        everywhere = reached(None)
        for v in everywhere:
            chain, u = set(), v
            while u:
                chain.add(u)
                u = above[u]
            assert chain == {u for u in everywhere if u == v or v not in reached(u)}
        for header, latch, inside in graph.loops():
            assert {header, latch} <= set(inside) and (latch, header) in graph.pairs


def test_fifty_thousand_statements_in_a_unit(spark):
    kinds = ["if", "loop", "basic", "try", "switch"] * 10_000
    rows, _ = graph_of(spark, kinds[:5])
    rows = spark.range(50_000).selectExpr("'u' AS unit", "int(id) AS line", "element_at(array('if', 'loop', 'basic', 'try', 'switch'), int(id % 5) + 1) AS kind")
    start = time.perf_counter()
    (m,) = flow.metrics(rows, connected=True).collect()
    assert time.perf_counter() - start < 60
    assert (m["nodes"], m["edges"], m["loops"], m["loop_nodes"], m["unreachable"], m["max_depth"]) == (140_003, 170_002, 10_000, 20_000, 0, 110_002)


def test_dot(spark):
    rows, _ = graph_of(spark, ["basic", "return"])
    (r,) = flow.dot(rows).collect()
    assert r["dot"] == """digraph CFG {
  rankdir=TB;
  node [shape=box];

  1 [label="ENTRY", shape=ellipse];
  2 [label="EXIT", shape=ellipse];
  3 [label="Block 3\\n(2 stmts)", shape=box];
  4 [label="Block 4\\n(2 stmts)", shape=box];
  5 [label="Block 5", shape=box];

  3 -> 4 [label="", style=solid];
  4 -> 2 [label="return", style=bold];
  1 -> 5 [label="", style=solid];
}
"""


def test_affected_files_in_a_cycle(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("e", "d")], "from_path string, to_path string")
    got = {r["path"]: r["distance"] for r in graphs.affected(edges, spark.createDataFrame([("a",)], "path string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_affected_files_in_a_dense_graph(spark):
    edges = spark.range(60).selectExpr("concat('f', id) AS from_path").crossJoin(spark.range(60).selectExpr("concat('f', id) AS to_path"))
    got = {r["path"]: r["distance"] for r in graphs.affected(edges, spark.createDataFrame([("f7",)], "path string"), depth=30).collect()}
    assert got == {f"f{k}": int(k != 7) for k in range(60)}


def test_includes_start_at_the_folder_of_the_file(spark):
    rows = [("/p/q/a.php", 'include "lib/b.php";'), ("/p/q/a.php", 'require_once "../c.php";'), ("/p/q/a.php", 'require "./x/../d.php";'), ("/p/q/a.php", 'include "b";'), ("/p/q/a.php", 'include "/e.php";')]
    lines = spark.createDataFrame([(p, k, t) for k, (p, t) in enumerate(rows)], "path string, line int, text string")
    files = spark.createDataFrame([(p,) for p in ("/p/q/lib/b.php", "/p/c.php", "/p/q/d.php", "/p/lib/b.php", "/z/b.php")], "path string")
    got = {(r["to_path"], r["kind"]) for r in graphs.include_edges(lines, files).collect()}
    assert got == {("/p/q/lib/b.php", "include"), ("/p/c.php", "require_once"), ("/p/q/d.php", "require"), ("/e.php", "include")}


def test_a_call_is_of_the_own_file_or_of_the_first(spark):
    rows = [("a", 1, "function f($x) {"), ("b", 1, "function f($x) {"), ("b", 2, "f($x);"), ("c", 1, "f($x);"), ("c", 2, "g($x);")]
    got = {(r["caller_path"], r["callee"]): r["callee_path"] for r in graphs.call_edges(spark.createDataFrame(rows, "path string, line int, text string")).collect()}
    assert got["b", "f"] == "b" and got["c", "f"] == "a" and got["c", "g"] is None


def test_plan_and_replace(spark):
    files = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("c", "3", 1)], "path string, sha256 string, mtime int")
    index = spark.createDataFrame([("a", "1", 1), ("b", "x", 1), ("z", "9", 1)], "path string, sha256 string, mtime int")
    plan = incremental.change_plan(files, index)
    assert {tuple(r) for r in plan.collect()} == {("a", "up_to_date"), ("b", "changed"), ("c", "new"), ("z", "deleted")}
    assert {r["action"] for r in incremental.change_plan(files, index, force=True).collect()} == {"changed", "new", "deleted"}
    old = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    new = incremental.replace_by_path(old, spark.createDataFrame([("b", 7)], "path string, n int"), plan.filter("action = 'changed'"))
    assert {tuple(r) for r in new.collect()} == {("a", 1), ("b", 7)}


def test_stream(spark, files, tmp_path):
    arrived = files.withColumn("mtime", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    for k in range(2):
        arrived.write.mode("append").parquet(str(tmp_path / "in"))
    stream = reanalysis.arriving_files(spark, str(tmp_path / "in"))
    query = reanalysis.write_findings(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == match.findings(files).count()


def test_folder_corpus(spark, tmp_path):
    from codestrata.sources.corpus import folder_corpus

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.php").write_text(PHP)
    (r,) = folder_corpus(spark, str(tmp_path)).collect()
    assert r["path"] == str(tmp_path / "src" / "a.php") and r["language"] == "php" and r["content"] == PHP


def test_a_folder_of_anything(spark, tmp_path):
    line = b'$q = "SELECT * FROM t WHERE id = " . $_GET["id"];\n'
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "sub folder+é").mkdir()
    (tmp_path / "plain.php").write_bytes(b"<?php\n" + line)
    (tmp_path / "latin.php").write_bytes(b"<?php // caf\xe9\n\xe9\xe8 " + line)
    (tmp_path / "sub folder+é" / "deep.php").write_bytes(line)
    (tmp_path / "binary.php").write_bytes(bytes(range(256)) * 4)
    (tmp_path / "empty.php").write_bytes(b"")
    (tmp_path / "node_modules" / "huge.php").write_bytes(line * 100)
    (tmp_path / "huge.php").write_bytes(line * 100)
    (tmp_path / "image.png").write_bytes(b"\x89PNG")
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength", None)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "2000")
    try:
        found = scan(spark, str(tmp_path))
        places = {(Path(r["file"]).name, r["line"], r["column"]) for r in found.findings.collect()}
        (stats,) = found.stats.collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength") if before is None else spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
    plain = {p[2] for p in places if p[0] == "plain.php"}
    assert plain and {p[2] for p in places if p[0] == "deep.php"} == plain
    assert {p[2] for p in places if p[0] == "latin.php"} == {c + 3 for c in plain}, "offsets are those of the bytes"
    assert {p[0] for p in places} == {"plain.php", "latin.php", "deep.php"}
    assert (stats["files_scanned"], stats["files_skipped"], stats["lines_scanned"]) == (4, 3, 2 + 2 + 1 + 5) and stats["findings_total"] == len(places)


def test_symbols_of_a_long_file_in_proportion(spark):
    block = 'class K extends B implements I {\n  public function f($a) {\n    $v = $_GET["é"];\n  }\n}\n'
    files = spark.createDataFrame([("/long.php", "php", block * 20_000)], "path string, language string, content string")
    start = time.perf_counter()
    rows = symbols.symbols(files).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("end_line").alias("last"), F.sum(F.col("user_input").cast("int")).alias("inputs")).collect()
    assert {(r["kind"], r["n"], r["last"], r["inputs"]) for r in rows} == {(symbols.CLASS, 20_000, 99_995, 0), (symbols.FUNCTION, 20_000, 99_996, 0), (symbols.VARIABLE, 20_000, 99_997, 20_000)}
    assert time.perf_counter() - start < 60  # 100,000 lines
