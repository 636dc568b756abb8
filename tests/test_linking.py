import pytest

from codestrata.functions.lexer import file_tokens, tokens
from codestrata.operators import linking

FILES = "path string, language string, content string"


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("use A\\B;", [("class", "B", "\\A\\B")]),
        ("use \\A\\B as C, D;", [("class", "C", "\\A\\B"), ("class", "D", "\\D")]),
        ("use function A\\f, A\\g as h;", [("function", "f", "\\A\\f"), ("function", "h", "\\A\\g")]),
        ("use const A\\X;", [("const", "X", "\\A\\X")]),
        ("use A\\{B, C\\D as E, function f, const X};", [("class", "B", "\\A\\B"), ("class", "E", "\\A\\C\\D"), ("function", "f", "\\A\\f"), ("const", "X", "\\A\\X")]),
        ("use;", []),
    ],
)
def test_uses(text, wanted):
    assert linking.php_uses(file_tokens(text, "php")["text"]) == wanted


def test_closures_end_in_cycles_and_take_few_rounds(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "b")], "a string, b string")
    found = {(r["a"], r["b"]): r["distance"] for r in linking.closure(edges).collect()}
    assert found == {("a", "b"): 1, ("a", "c"): 2, ("a", "a"): 3, ("a", "d"): 3, ("b", "c"): 1, ("b", "a"): 2, ("b", "b"): 3, ("b", "d"): 2, ("c", "a"): 1, ("c", "d"): 1, ("c", "b"): 2, ("c", "c"): 3}
    rounds, kept = [], linking.written
    monkeypatch.setattr(linking, "written", lambda df: (rounds.append(1), kept(df))[1])
    chain = spark.range(100).selectExpr("string(id) AS a", "string(id + 1) AS b")
    assert linking.closure(chain).count() == 100 * 101 // 2 and len(rounds) <= 9
    assert linking.closure(chain.limit(0)).count() == 0


def test_names_by_the_rules_of_the_language(spark):
    one = r"""<?php
namespace A;
use X\helper as notafunction;
use function X\helper;
class C extends \Base\D implements E, \F\G { use SomeTrait; function run() { \Foo\bar(1); helper(1); own(); everywhere(); parent::run(); static::missing(); new namespace\C; } }
function own() { $f = function () { return own(); }; }
$g = new class extends \Base\D { };
"""
    two = "<?php\nfunction everywhere() { }\nnamespace Base;\nclass D { function run() { } }\nfunction own() { own(); }\n"
    program = linking.link(tokens(spark.createDataFrame([("/one.php", "php", one), ("/two.php", "php", two), ("/empty.php", "php", None), ("/no.go", "go", "func f() {}")], FILES)))
    assert {(r["fqn"], r["relation"], r["parent"], r["parent_path"]) for r in program.parents.collect()} == {
        ("\\A\\C", "extends", "\\Base\\D", "/two.php"), ("\\A\\C", "implements", "\\A\\E", None), ("\\A\\C", "implements", "\\F\\G", None),
    }
    assert {(r["alias"], r["kind"], r["fqn"]) for r in program.uses.collect()} == {("notafunction", "class", "\\X\\helper"), ("helper", "function", "\\X\\helper")}
    assert {(r["caller"], r["kind"], r["callee"], r["callee_path"]) for r in program.calls.collect()} == {
        ("\\A\\C::run", "function", "\\Foo\\bar", None), ("\\A\\C::run", "function", "\\X\\helper", None), ("\\A\\C::run", "function", "\\A\\own", "/one.php"), ("\\A\\C::run", "function", "\\everywhere", "/two.php"),
        ("\\A\\C::run", "static", "\\Base\\D::run", "/two.php"), ("\\A\\C::run", "static", "\\A\\C::missing", None), ("\\A\\C::run", "new", "\\A\\C", "/one.php"), ("\\A\\own", "function", "\\A\\own", "/one.php"), ("\\Base\\own", "function", "\\Base\\own", "/two.php"),
    }
    assert [(r["fqn"], r["overridden"]) for r in program.overrides.collect()] == [("\\A\\C::run", "\\Base\\D::run")]


LINKED = [("/a.php", "php", "<?php namespace A; use B\\C; class D extends C { use T; function f() { parent::f(); g(); } } function g() { }"), ("/b.php", "php", "<?php namespace B; class C implements \\I { function f() { } }")]


def written_for(spark, monkeypatch, relation):
    """A relation's rows, and which tables were written for it."""
    program, tables, kept = linking.link(tokens(spark.createDataFrame(LINKED, FILES))), [], linking.written
    monkeypatch.setattr(linking, "written", lambda df: (tables.append(df.columns), kept(df))[1])
    return getattr(program, relation).collect(), tables


def test_calls_take_their_function_and_class_from_their_tokens(spark, monkeypatch):
    rows, tables = written_for(spark, monkeypatch, "calls")
    assert {(r["caller"], r["callee"], r["callee_path"]) for r in rows} == {("\\A\\D::f", "\\B\\C::f", "/b.php"), ("\\A\\D::f", "\\A\\g", "/a.php")}
    assert sum("how" in columns for columns in tables) == 1  # once, with caller and class, where it was written, joined twice with what is around, and written again


def test_what_leads_nowhere_takes_no_part_in_the_rounds(spark, monkeypatch):
    tables, kept = [], linking.written
    monkeypatch.setattr(linking, "written", lambda df: (tables.append(kept(df)), tables[-1])[1])
    edges = spark.range(50).selectExpr("string(id) AS a", "'thing' AS b").union(spark.createDataFrame([("0", "1"), ("1", "2"), ("2", "above")], "a string, b string"))
    found = {(r["a"], r["b"]): r["distance"] for r in linking.closure(edges).collect()}
    assert found == {(str(k), "thing"): 1 for k in range(50)} | {("0", "1"): 1, ("1", "2"): 1, ("0", "2"): 2, ("2", "above"): 1, ("1", "above"): 2, ("0", "above"): 3}
    assert max(t.count() for t in tables) == 3 and len(tables) == 3


def test_parents_are_linked_without_calls_and_ancestors(spark, monkeypatch):
    rows, tables = written_for(spark, monkeypatch, "parents")
    assert {(r["fqn"], r["parent"], r["parent_path"]) for r in rows} == {("\\A\\D", "\\B\\C", "/b.php"), ("\\B\\C", "\\I", None)}
    assert len(tables) == 2


def test_uses_alone_write_no_table(spark, monkeypatch):
    rows, tables = written_for(spark, monkeypatch, "uses")
    assert [(r["path"], r["alias"], r["fqn"]) for r in rows] == [("/a.php", "C", "\\B\\C")] and not tables


def test_overridden_methods_are_linked_without_calls(spark, monkeypatch):
    rows, tables = written_for(spark, monkeypatch, "overrides")
    assert [(r["fqn"], r["overridden"], r["distance"]) for r in rows] == [("\\A\\D::f", "\\B\\C::f", 1)]
    assert not any("how" in columns for columns in tables)
