"""Taint of expressions along the ways through a function."""

import pyarrow as pa
import pytest

from codestrata.functions.lexer import tokens
from codestrata.operators import hir

CASES = {
    "straight": ("$a = $_GET['x'];\nquery($a);\n$a = 1;\nquery($a);", {(2, "$a", 1)}),
    "either branch": ("$a = 1;\nif ($c) {\n$a = $_GET['x'];\n} else if ($d) {\n$a = $_POST['y'];\n} else {\n$a = 2;\n}\nquery($a);", {(9, "$a", 3), (9, "$a", 5)}),
    "all branches clean": ("$a = $_GET['x'];\nif ($c) {\n$a = 1;\n} elseif ($d) {\n$a = 2;\n} else {\n$a = 3;\n}\nquery($a);", set()),
    "one way left": ("$a = $_GET['x'];\nif ($c) {\n$a = 1;\n} elseif ($d) {\n$a = 2;\n}\nquery($a);", {(7, "$a", 1)}),
    "carried by a loop": ("foreach ($rows as $k => $v) {\nquery($b);\n$b = $a;\n$a = $_GET['x'];\n}", {(2, "$b", 4)}),
    "loop variable": ("foreach ($_GET as $v) {\nquery($v);\n}\n$v = 1;\nquery($v);", {(2, "$v", 1)}),
    "break keeps": ("while (1) {\n$a = $_GET['x'];\nif ($c) {\nbreak;\n}\n$a = 1;\n}\nquery($a);", {(8, "$a", 2)}),
    "continue goes back": ("while ($a) {\nquery($b);\nif ($c) {\n$b = $_GET['x'];\ncontinue;\n}\n$b = 1;\n}", {(2, "$b", 4)}),
    "return cuts": ("$a = $_GET['x'];\nif ($c) {\nreturn 1;\n}\n$a = 1;\nquery($a);\nreturn 2;\nquery($_GET['y']);", set()),
    "switch": ("$a = 1;\nswitch ($c) {\ncase 1:\n$a = $_GET['x'];\nbreak;\ndefault:\n$b = 1;\n}\nquery($a);", {(9, "$a", 4)}),
    "try": ("try {\n$a = $_GET['x'];\nrisk();\n$a = 1;\n} catch (E $e) {\nquery($a);\n} finally {\nclose();\n}\nquery($a);", {(6, "$a", 2), (10, "$a", 2)}),
    "cleaned and mixed": ("$a = intval($_GET['x']);\nquery($a);\n$a = intval(1) . $_GET['x'];\nquery($a);\n$b .= $a;\n$b .= 'x';\nquery($b);", {(4, "$a", 3), (7, "$b", 3)}),
    "direct": ("$db->query('x' . $_COOKIE['c']);\n$_GET = 1;", {(1, "$_COOKIE", 1)}),
    "without braces": ("$a = $_GET['x'];\nif ($c) $a = 1;\nquery($a);", {(3, "$a", 1)}),
    "two sources": ("$a = $_GET['x'];\n$b = $_POST['y'];\n$c = $a . $b;\nquery($c);", {(4, "$c", 1), (4, "$c", 2)}),
}


def test_findings_along_the_ways(spark):
    files = [(f"/{name}.php", "php", "<?php function f() {" + text + "}") for name, (text, _) in CASES.items()]
    files += [("/outside.php", "php", "<?php query($_GET['x']);"), ("/empty.php", "php", "<?php function f() { }"), ("/null.php", "php", None)]
    rows = tokens(spark.createDataFrame(files, "path string, language string, content string"))
    found = {}
    for r in hir.findings(hir.statements(rows)).collect():
        found.setdefault(r["path"][1:-4], set()).add((r["line"] + 1, r["subject"], r["source_line"] + 1))
    for name, (_, wanted) in CASES.items():
        assert found.pop(name, set()) == wanted, name
    assert not found


def test_long_functions_take_time_in_proportion():
    rows = [{"n": i, "line": i, "target": f"$a{i}", "adds": False, "reads": [f"$a{i - 1}"], "sources": [], "cleaned": i % 50 == 0, "risky": [], "head": "x", "parent": 0, "body": 0, "blocks": []} for i in range(1, 4000)]
    state = hir.reaching(rows)
    assert len(state) == 3999 and all(s is not None for s in state)


@pytest.mark.parametrize("head", ["if", "while", "try", "switch", "else"])
def test_wiring_of_empty_blocks_ends(head):
    row = {"parent": 0, "body": 0, "head": head, "blocks": [5], "reads": []}
    last = {"parent": 0, "body": 0, "head": "x", "blocks": [], "reads": []}
    assert (0, 1) in hir.wire([row, last]) and (-1, 0) in hir.wire([row, last])


def test_statements_stay_where_their_file_is(spark):
    files = spark.createDataFrame([("/a.php", "php", "<?php function f() { $a = 1; }")], "path string, language string, content string")
    plan = hir.statements(tokens(files))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan  # nothing is shuffled or written to find a statement's tokens and its function


def test_columns_become_values_at_once():
    rows = [[{"n": 1, "name": "é", "many": ["a", "b"], "at": [{"k": None}, {"k": 2}], "is": True}], [], None, [{"n": None, "name": None, "many": [], "at": [], "is": False}, {"n": 3, "name": "", "many": ["c"], "at": [{"k": 4}], "is": True}]]
    column = pa.array(rows)
    assert [v or None for v in hir.plain(column)] == [v or None for v in rows] and hir.plain(column.slice(3)) == rows[3:] and hir.plain(column.slice(0, 1)) == rows[:1]
