"""Control flow of units: nodes, edges, dominators, loops, metrics, DOT.

A unit is a function, or a file, as its statements in order. What a statement adds to the graph depends on its kind alone, so
nodes and edges need no walk: a running count gives each statement its first node, and the node that control comes from is the last
one that an earlier statement left open. Both are windows over a unit.

Only analyses that follow paths take a unit's edges together: immediate dominators as one array in reverse
postorder, the loops of back edges, and the depth of a search, each in time that is close to proportional.

The entry is linked to the node that is open at the end, as in ``faithful`` mode, or (``connected``) to the first, with the last to
the exit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ENTRY, EXIT = 1, 2
#: By kind of statement: kinds of the nodes it adds, its edges (0: the open node before, -1: the exit, else its own nodes from 1), and the node it leaves open.
SHAPES = {
    "if": (["conditional", "basic", "basic", "basic"], [(0, 1, ""), (1, 2, "true"), (1, 3, "false"), (2, 4, ""), (3, 4, "")], 4),
    "loop": (["loop", "basic", "basic"], [(0, 1, ""), (1, 2, "true"), (1, 3, "false"), (2, 1, "")], 3),
    "switch": (["conditional", "basic", "basic"], [(0, 1, ""), (1, 3, ""), (3, 2, "")], 2),
    "try": (["try", "catch", "finally", "basic"], [(0, 1, ""), (1, 3, ""), (3, 4, ""), (1, 2, "throw"), (2, 3, "")], 4),
    "return": (["block", "basic"], [(0, 1, ""), (1, -1, "return")], 2),
    "throw": (["block", "basic"], [(0, 1, ""), (1, -1, "throw")], 2),
    "break": (["block", "basic"], [(0, 1, "")], 2),
}
# What nodes and edges look like in DOT.
LABELS = {"entry": "ENTRY", "exit": "EXIT", "conditional": "CONDITION", "loop": "LOOP", "try": "TRY", "catch": "CATCH", "finally": "FINALLY"}
FORMS = {"entry": "ellipse", "exit": "ellipse", "conditional": "diamond", "loop": "hexagon", "try": "trapezium", "catch": "trapezium", "finally": "trapezium"}
STYLES = {"throw": "dashed", "return": "bold"}


def statement_kind(text: Column) -> Column:
    head = F.lower(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))
    return (
        F.when(head == "if", "if").when(head.isin("for", "foreach", "while"), "loop").when(head == "switch", "switch").when(head == "try", "try")
        .when(head == "return", "return").when(head == "throw", "throw").when(head == "break", "break").otherwise("basic")
    )


def statements(lines: DataFrame) -> DataFrame:
    """unit, line, kind: every line of a file is a statement."""
    return lines.select(F.col("path").alias("unit"), "line", statement_kind(F.col("text")).alias("kind"))


def function_statements(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """unit (path, name path and line of the function), line (its first token's number), kind: statements of functions from tokens, each in its innermost
    function that has a name."""
    heads = rows.filter((F.col("n") == F.col("stmt")) & (F.size("chain") > 0) & ~F.col("text").isin("}", ";"))
    unit = lambda name, line: F.concat_ws("#", "path", name, F.col(line).cast("string")).alias("unit")
    # The lexer knows PHP's functions; those of Go are known by their declarations.
    known = heads.filter((F.col("language") == "php") & F.col("function").isNotNull()).select(unit("function.name", "function.line"), "n", "text")
    bodies = declared.filter(F.col("kind").isin("function", "method") & F.col("opens").isNotNull()).select("path", F.col("opens").alias("at"), unit("name", "line"))
    others = heads.filter("language <> 'php'").select("path", "n", "text", F.explode("chain").alias("at"))
    inner = others.join(bodies, ["path", "at"]).groupBy("path", "n", "text").agg(F.max_by("unit", "at").alias("unit"))
    return known.unionByName(inner.select("unit", "n", "text")).select("unit", F.col("n").alias("line"), statement_kind(F.col("text")).alias("kind"))


def _by_kind(values: dict[str, object], kind: Column, otherwise: object) -> Column:
    out = F.lit(otherwise)
    for k, v in values.items():
        out = F.when(kind == k, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def _placed(rows: DataFrame) -> DataFrame:
    """Statements with ``base`` (nodes before their own), ``before`` (the node control comes from), ``stmts`` of their unit, and whether it has a first block."""
    unit, upto = W.partitionBy("unit"), W.partitionBy("unit").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    whole = rows.withColumn("stmts", F.count(F.lit(1)).over(unit)).withColumn("plain", F.max((F.col("kind") == "basic").cast("int")).over(unit))
    size, leaves = _by_kind({k: len(s[0]) for k, s in SHAPES.items()}, F.col("kind"), 0), _by_kind({k: s[2] for k, s in SHAPES.items()}, F.col("kind"), None)
    sized = whole.withColumn("size", size).withColumn("base", F.coalesce(F.sum("size").over(upto), F.lit(0)) + EXIT + F.col("plain"))
    left = sized.withColumn("open", F.col("base") + leaves)
    first = F.when(F.col("plain") == 1, EXIT + 1).otherwise(ENTRY)
    return left.withColumn("before", F.coalesce(F.last("open", ignorenulls=True).over(upto), first).cast("long"))


def nodes(rows: DataFrame) -> DataFrame:
    """unit, node, kind, stmts: entry and exit, a block for plain statements (kind block, with how many statements there are), and what the others add."""
    placed, none = _placed(rows), F.lit(None).cast("long")
    own = _by_kind({k: F.array(*map(F.lit, s[0])) for k, s in SHAPES.items()}, F.col("kind"), None)
    added = placed.select("unit", "base", "stmts", F.posexplode(own).alias("i", "kind")).select("unit", (F.col("base") + F.col("i") + 1).cast("long").alias("node"), "kind", F.when(F.col("kind") == "block", F.col("stmts")).alias("stmts"))
    units = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("stmts"), F.max((F.col("kind") == "basic").cast("int")).alias("plain"))
    ends = F.array(F.struct(F.lit(ENTRY).cast("long").alias("node"), F.lit("entry").alias("kind"), none.alias("stmts")), F.struct(F.lit(EXIT).cast("long").alias("node"), F.lit("exit").alias("kind"), none.alias("stmts")))
    block = F.when(F.col("plain") == 1, F.array(F.struct(F.lit(EXIT + 1).cast("long").alias("node"), F.lit("block").alias("kind"), F.col("stmts").alias("stmts")))).otherwise(F.array().cast("array<struct<node:bigint,kind:string,stmts:bigint>>"))
    return units.select("unit", F.explode(F.concat(ends, block)).alias("e")).select("unit", "e.*").unionByName(added)


def edges(rows: DataFrame, connected: bool = False) -> DataFrame:
    """unit, seq (order in which they are made), from_node, to_node, label (true, false, throw, return, or empty)."""
    placed = _placed(rows)

    def node(k: int) -> Column:
        return (F.col("before") if k == 0 else F.lit(EXIT) if k == -1 else F.col("base") + k).cast("long")

    own = _by_kind({k: F.array(*[F.struct(node(a).alias("from_node"), node(b).alias("to_node"), F.lit(label).alias("label")) for a, b, label in s[1]]) for k, s in SHAPES.items()}, F.col("kind"), None)
    made = placed.select("unit", "base", F.posexplode(own).alias("i", "e")).select("unit", (F.col("base") * 8 + F.col("i")).cast("long").alias("seq"), "e.*")
    ends = placed.groupBy("unit").agg(F.max(F.struct("line", F.coalesce("open", "before").alias("node")))["node"].alias("last"), F.max("plain").alias("plain"), F.max("base").alias("base"))
    late, link = (F.col("base") * 8 + 64).cast("long"), lambda a, b: F.struct(a.cast("long").alias("from_node"), b.cast("long").alias("to_node"))
    entry, out = F.lit(ENTRY), F.lit(EXIT)
    if connected:
        links = F.array_compact(F.array(F.when(F.col("plain") == 1, link(entry, F.lit(EXIT + 1))), link(F.col("last"), out)))
    else:
        links = F.array_compact(F.array(F.when(F.col("last") != ENTRY, link(entry, F.col("last")))))
    return made.unionByName(ends.select("unit", late.alias("late"), F.posexplode(links).alias("i", "e")).select("unit", (F.col("late") + F.col("i")).alias("seq"), "e.*", F.lit("").alias("label")))


class Graph:
    """One unit's graph: nodes 1 to n, edges in the order in which they were made."""

    def __init__(self, n: int, pairs: list[tuple[int, int]]):
        self.n, self.pairs = n, pairs
        self.after: list[list[int]] = [[] for _ in range(n + 1)]
        self.ahead: list[list[int]] = [[] for _ in range(n + 1)]
        for a, b in pairs:
            self.after[a].append(b)
            self.ahead[b].append(a)

    def search(self) -> tuple[list[bool], int]:
        """What the entry reaches, and the greatest depth of a depth-first search that takes the depth below a node from its first visit."""
        seen, depth = [False] * (self.n + 1), [0] * (self.n + 1)
        seen[ENTRY], path = True, [(ENTRY, iter(self.after[ENTRY]), 0)]
        while path:
            node, following, at = path[-1]
            for b in following:
                if not seen[b]:
                    seen[b], depth[b] = True, at + 1
                    path.append((b, iter(self.after[b]), at + 1))
                    break
                depth[node] = max(depth[node], depth[b])
            else:
                path.pop()
                if path:
                    depth[path[-1][0]] = max(depth[path[-1][0]], depth[node])
        return seen, depth[ENTRY]

    def immediate_dominators(self) -> tuple[list[int], list[int]]:
        """The immediate dominator of each node (0: none) and its depth in their tree. Entry, and nodes without a predecessor, are roots; a node that
        several roots reach apart has none."""
        roots = [v for v in range(1, self.n + 1) if v == ENTRY or not self.ahead[v]]
        order, state = [], [0] * (self.n + 1)
        for root in roots:
            if not state[root]:
                state[root], path = 1, [(root, iter(self.after[root]))]
                while path:
                    node, following = path[-1]
                    for b in following:
                        if not state[b]:
                            state[b] = 1
                            path.append((b, iter(self.after[b])))
                            break
                    else:
                        order.append(node)
                        path.pop()
        place = [0] * (self.n + 1)
        for k, v in enumerate(reversed(order)):
            place[v] = k + 1
        above, known, is_root = [0] * (self.n + 1), [False] * (self.n + 1), set(roots)
        known[0] = True
        changed = True
        while changed:
            changed = False
            for v in reversed(order):
                if v in is_root:
                    new = 0
                else:
                    new = None
                    for p in self.ahead[v]:
                        if known[p]:
                            a = p if new is None else new
                            b = p
                            while a != b:
                                while place[a] > place[b]:
                                    a = above[a]
                                while place[b] > place[a]:
                                    b = above[b]
                            new = a
                if not known[v] or above[v] != new:
                    above[v], known[v], changed = new, True, True
        deep = [0] * (self.n + 1)
        for v in reversed(order):
            deep[v] = deep[above[v]] + 1
        return above, deep

    def loops(self) -> Iterator[tuple[int, int, list[int]]]:
        """(header, latch, nodes) of the natural loop of each back edge: one whose target dominates its source."""
        above, deep = self.immediate_dominators()
        first, last = self._intervals(above, deep)
        for a, b in self.pairs:
            if first[b] <= first[a] < last[b]:
                inside, waiting = {b, a}, [a] if a != b else []
                while waiting:
                    for p in self.ahead[waiting.pop()]:
                        if p not in inside:
                            inside.add(p)
                            waiting.append(p)
                yield b, a, sorted(inside)

    def _intervals(self, above: list[int], deep: list[int]) -> tuple[list[int], list[int]]:
        """Numbers of the dominator tree's nodes so that a node's descendants are those from ``first`` to before ``last``."""
        sizes = [1] * (self.n + 1)
        order = np.argsort(deep, kind="stable").tolist()
        for v in reversed(order):
            if v and above[v]:
                sizes[above[v]] += sizes[v]
        first, last, free = [0] * (self.n + 1), [0] * (self.n + 1), [0] * (self.n + 1)
        for v in order:
            if v:
                up = above[v]
                first[v] = free[up]
                free[up] += sizes[v]
                free[v], last[v] = first[v] + 1, first[v] + sizes[v]
        return first, last


def _units(rows: DataFrame, connected: bool) -> DataFrame:
    """unit, n, pairs: each unit's graph as one row."""
    found = edges(rows, connected).groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("seq", "from_node", "to_node"))).alias("e"))
    sizes = _placed(rows).groupBy("unit").agg(F.max(F.col("base") + F.col("size")).alias("n"))
    return sizes.join(found, "unit", "left").select("unit", "n", F.col("e.from_node").alias("a"), F.col("e.to_node").alias("b"))


def metrics(rows: DataFrame, connected: bool = False) -> DataFrame:
    """unit, nodes, edges, complexity (E - N + 2), reachable, unreachable, loops, loop_nodes (in their bodies together), max_depth, dominated (pairs of a dominator
    and another node that the entry reaches)."""
    columns = ["nodes", "edges", "complexity", "reachable", "unreachable", "loops", "loop_nodes", "max_depth", "dominated"]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for unit, n, a, b in zip(batch["unit"], batch["n"], batch["a"], batch["b"]):
                graph = Graph(n, [] if a is None else list(zip(a.tolist(), b.tolist())))
                seen, depth = graph.search()
                _, deep = graph.immediate_dominators()
                bodies = [len(inside) for _, _, inside in graph.loops()]
                out.append((unit, n, len(graph.pairs), len(graph.pairs) - n + 2, sum(seen), n - sum(seen), len(bodies), sum(bodies), depth, sum(deep[v] - 1 for v in range(1, n + 1) if seen[v])))
            yield pd.DataFrame(out, columns=["unit", *columns])

    return _units(rows, connected).mapInPandas(of, "unit string, " + ", ".join(f"{c} long" for c in columns))


def dominators(rows: DataFrame, connected: bool = False) -> DataFrame:
    """unit, node, dominator (the immediate one; null if none), depth (in the tree of dominators, from 0)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for unit, n, a, b in zip(batch["unit"], batch["n"], batch["a"], batch["b"]):
                above, deep = Graph(n, [] if a is None else list(zip(a.tolist(), b.tolist()))).immediate_dominators()
                yield pd.DataFrame({"unit": unit, "node": range(1, n + 1), "dominator": pd.array([x or None for x in above[1:]], "Int64"), "depth": [d - 1 for d in deep[1:]]})

    return _units(rows, connected).mapInPandas(of, "unit string, node long, dominator long, depth long")


def loops(rows: DataFrame, connected: bool = False) -> DataFrame:
    """unit, header, latch, node: one row for each node in the natural loop of each back edge."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for unit, n, a, b in zip(batch["unit"], batch["n"], batch["a"], batch["b"]):
                found = [(unit, header, latch, v) for header, latch, inside in Graph(n, [] if a is None else list(zip(a.tolist(), b.tolist()))).loops() for v in inside]
                yield pd.DataFrame(found, columns=["unit", "header", "latch", "node"])

    return _units(rows, connected).mapInPandas(of, "unit string, header long, latch long, node long")


def dot(rows: DataFrame, connected: bool = False) -> DataFrame:
    """unit, dot: the graph of each unit as DOT text, nodes by number, edges in order."""
    label = F.coalesce(_by_kind(LABELS, F.col("kind"), None), F.concat(F.lit("Block "), F.col("node").cast("string"), F.when(F.col("stmts").isNotNull(), F.concat(F.lit("\\n("), F.col("stmts").cast("string"), F.lit(" stmts)"))).otherwise("")))
    shown = nodes(rows).select("unit", "node", F.format_string('  %d [label="%s", shape=%s];\n', "node", label, _by_kind(FORMS, F.col("kind"), "box")).alias("text"))
    line = F.format_string('  %d -> %d [label="%s", style=%s];\n', "from_node", "to_node", "label", _by_kind(STYLES, F.col("label"), "solid"))
    links = edges(rows, connected).select("unit", "seq", line.alias("text"))
    joined = lambda t, by: t.groupBy("unit").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, "text"))), lambda x: x["text"]), "").alias(by))
    both = joined(shown, "node").join(joined(links, "seq"), "unit", "left")
    return both.select("unit", F.concat(F.lit("digraph CFG {\n  rankdir=TB;\n  node [shape=box];\n\n"), "node", F.lit("\n"), F.coalesce("seq", F.lit("")), F.lit("}\n")).alias("dot"))
