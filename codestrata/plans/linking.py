"""Queries over linked programs, on files of PHP that use each other's names; one for each event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexer import tokens
from ..operators import linking
from ..session import table, written

#: {0}, {1}, {2} stand for the event and the next two, {s0} to {s3} for their namespaces' numbers.
FILE = r"""<?php
namespace App\M{s0};

use App\M{s1}\Kind{1} as Base;
use function App\M{s1}\helper{1};
use App\M{s2}\{Kind{2} as Other, function helper{2} as second};

/* class Ghost{0} extends Base { */
class Kind{0} {extends}implements \Lib\Thing {
    public function act($x) {
        helper{1}($x); second($x); \App\M{s3}\helper{3}(1);
        strlen($x); local{0}("local(");
        $this->make(); parent::act(1); self::make();
        Other::act(2); $x->act(new Base());
        Other\deep($x); namespace\local{0}();
    }
    public static function make() { return 1; }
}
function helper{0}($a) { return $a; }
function local{0}() { }
helper{0}(1);
"""


#: Tokens that linking looks at: those of uses and names of types, names of functions, and calls.
COLUMNS = ["path", "language", "n", "kind", "text", "line", "stmt", "chain", "before", "opens", "function", "type", "space", "own"]
USES, TYPES, FUNCTIONS, CALLS = {"text": ["use"]}, {"last": ["class", "interface", "trait"]}, {"last": ["function"]}, {"text": ["("], "last": ["new"]}


def _tokens(spark: SparkSession, sf_dir: str, *kept: dict) -> DataFrame:
    e = F.col("event_id")
    text = F.lit(FILE)
    for k in range(4):
        text = F.replace(F.replace(text, F.lit(f"{{{k}}}"), (e + k).cast("string")), F.lit(f"{{s{k}}}"), ((e + k) % 7).cast("string"))
    text = F.replace(text, F.lit("{extends}"), F.when(e % 4 == 3, "").otherwise("extends Base "))
    events = table(spark, sf_dir, "events").select("event_id").repartition(spark.sparkContext.defaultParallelism, "event_id")
    files = events.select(F.format_string("/link/e%d.php", "event_id").alias("path"), F.lit("php").alias("language"), text.alias("content"))
    return tokens(files, COLUMNS, {k: [x for one in kept for x in one.get(k, ())] for k in ("text", "last")})


def linked_uses(spark, sf_dir) -> DataFrame:
    return linking.link(_tokens(spark, sf_dir, USES)).uses


def linked_parents(spark, sf_dir) -> DataFrame:
    return linking.link(written(_tokens(spark, sf_dir, USES, TYPES))).parents


def linked_ancestors(spark, sf_dir) -> DataFrame:
    return linking.link(written(_tokens(spark, sf_dir, USES, TYPES))).ancestors


def overridden_methods(spark, sf_dir) -> DataFrame:
    return linking.link(written(_tokens(spark, sf_dir, USES, TYPES, FUNCTIONS))).overrides


def linked_calls(spark, sf_dir) -> DataFrame:
    return linking.link(written(_tokens(spark, sf_dir, USES, TYPES, FUNCTIONS, CALLS))).calls


def _kind(k: int) -> str:
    return rf"'\App\M' || ((e + {k}) % 7) || '\Kind' || (e + {k})"


def _fn(name: str, k: int) -> str:
    return rf"'\App\M' || ((e + {k}) % 7) || '\{name}' || (e + {k})"


_EVENTS = "ev AS (SELECT event_id AS e, '/link/e' || event_id || '.php' AS path FROM events), top AS (SELECT max(e) AS most FROM ev)"
_HERE = lambda k: f"CASE WHEN (e + {k}) IN (SELECT e FROM ev) THEN '/link/e' || (e + {k}) || '.php' END"
#: A method that the class has itself or, without one in the program, keeps its asked name.
_METHOD = lambda name, k: f"{_kind(k)} || '::{name}'"
_CALLS = [
    (10, "act", "function", _fn("helper", 1), _HERE(1)), (10, "act", "function", _fn("helper", 2), _HERE(2)), (10, "act", "function", _fn("helper", 3), _HERE(3)), (11, "act", "function", r"'\App\M' || (e % 7) || '\strlen'", "NULL"),
    (11, "act", "function", _fn("local", 0), "path"), (12, "act", "method", _METHOD("make", 0), "path"), (12, "act", "static", "CASE WHEN e % 4 = 3 THEN " + _METHOD("act", 0) + " ELSE " + _METHOD("act", 1) + " END", "CASE WHEN e % 4 <> 3 THEN " + _HERE(1) + " END"),
    (12, "act", "static", _METHOD("make", 0), "path"), (13, "act", "static", _METHOD("act", 2), _HERE(2)), (13, "act", "method", "'act'", "NULL"), (13, "act", "new", _kind(1), _HERE(1)),
    (14, "act", "function", _kind(2) + r" || '\deep'", "NULL"), (14, "act", "function", _fn("local", 0), "path"), (20, None, "function", _fn("helper", 0), "path"),
]
_FOUND = " UNION ALL ".join(
    f"SELECT path, {line} AS line, {'path' if caller is None else _METHOD(caller, 0)} AS caller, '{kind}' AS kind, {callee} AS callee, {where} AS callee_path FROM ev" for line, caller, kind, callee, where in _CALLS
)
_STEPS = f"steps AS (SELECT e, unnest(generate_series(1, 3 - e % 4)) AS d FROM ev), known AS (SELECT e, d FROM steps WHERE (SELECT most FROM top) >= e + d - 1)"
QUERIES = {f.__name__: f for f in (linked_uses, linked_parents, linked_ancestors, overridden_methods, linked_calls)}
ORACLES = {
    "linked_uses": rf"""WITH {_EVENTS} SELECT path, 'class' AS kind, 'Base' AS alias, {_kind(1)} AS fqn FROM ev UNION ALL SELECT path, 'function', 'helper' || (e + 1), {_fn("helper", 1)} FROM ev
UNION ALL SELECT path, 'class', 'Other', {_kind(2)} FROM ev UNION ALL SELECT path, 'function', 'second', {_fn("helper", 2)} FROM ev""",
    "linked_parents": rf"""WITH {_EVENTS} SELECT {_kind(0)} AS fqn, 'extends' AS relation, {_kind(1)} AS parent, {_HERE(1)} AS parent_path FROM ev WHERE e % 4 <> 3
UNION ALL SELECT {_kind(0)}, 'implements', '\Lib\Thing', NULL FROM ev""",
    "linked_ancestors": rf"""WITH {_EVENTS}, {_STEPS} SELECT {_kind(0)} AS fqn, '\App\M' || ((e + d) % 7) || '\Kind' || (e + d) AS ancestor, d::INTEGER AS distance FROM known
UNION ALL SELECT {_kind(0)}, '\Lib\Thing', 1 FROM ev""",
    "overridden_methods": rf"""WITH {_EVENTS}, m AS (SELECT unnest(['act', 'make']) AS name) SELECT {_kind(0)} || '::' || name AS fqn, {_kind(1)} || '::' || name AS overridden, 1 AS distance FROM ev, m WHERE e % 4 <> 3 AND (e + 1) IN (SELECT e FROM ev)""",
    "linked_calls": f"WITH {_EVENTS}, f AS ({_FOUND}) SELECT path, line::INTEGER AS line, caller, kind, callee, callee_path, callee_path IS NOT NULL AS is_direct FROM f",
}
