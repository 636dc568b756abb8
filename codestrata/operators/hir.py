"""Statements of PHP functions with the taint of their expressions, by reaching definitions.

A statement's row says what it assigns, reads and calls. The rows of a function are wired as its blocks nest, and what is tainted
where follows from gen and kill sets to a fixpoint: an assignment of something clean ends a variable's taint on the ways that
pass it, and only there. Findings are the calls that run SQL with something tainted at that place.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import plain

# The rule and the names it looks for.
RULE, SEVERITY, CONFIDENCE = "HIR-SQL-001", 3, 95
MESSAGE = "SQL injection vulnerability detected via HIR analysis"
SQL_CALLS = ["mysql_query", "mysqli_query", "pg_query", "sqlite_query", "query", "exec", "execute", "prepare"]
SUPERGLOBALS = ["$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_FILES", "$_SERVER", "$_SESSION", "$_ENV"]
CLEANERS = ["intval", "floatval", "boolval", "count", "strlen", "md5", "sha1", "hash", "filter_var", "mysqli_real_escape_string", "real_escape_string", "mysql_real_escape_string", "pg_escape_string", "addslashes", "quote", "htmlspecialchars", "htmlentities"]
ASSIGN = ["=", ".=", "+=", "-=", "*=", "/=", "%="]
BRANCHES, LOOPS, NOT_CALLS = ["if", "elseif", "else"], ["for", "foreach", "while", "do"], ["if", "elseif", "for", "foreach", "while", "switch", "catch", "function", "return", "echo", "print", "array", "list", "isset", "empty", "use"]


def superglobal(name):
    """Whether a variable's name is one of the eight that bring user input or the environment in."""
    return name.isin(SUPERGLOBALS)


def statements(rows: DataFrame) -> DataFrame:
    """Tokens -> path, unit (path, name and line of the innermost named function), n, line, kind, target, adds, reads, sources, source_line, cleaned, calls, risky, head, parent, blocks.

    kind is assign, call, or the head of a control statement. reads are the variables it uses, sources the superglobals; ``cleaned`` if what is assigned is the result
    of one function that makes input harmless; ``adds`` if the target keeps what it had (``.=``, or an assignment inside a control statement without
    braces). risky are the variables and superglobals in the brackets of calls that run SQL. parent is the block around the statement, blocks those it opens.
    """
    whole = rows.filter((F.col("language") == "php") & (F.col("n") == F.col("stmt")) & F.col("function").isNotNull()).withColumnRenamed("own", "t")
    texts = lambda c: F.transform(c, lambda x: x["text"])
    is_variable = lambda x: x["text"].startswith("$") & (x["kind"] == "word")
    # A statement's tokens are gone through once for its variables and once for brackets behind a name; all else looks at these few.
    whole = whole.withColumn("v", F.filter("t", is_variable)).withColumn("b", F.filter("t", lambda x: (x["text"] == "(") & x["last"].rlike(r"^[\\A-Za-z_]")))
    assigned = F.filter("v", lambda x: x["next"].isin(ASSIGN))
    looped = F.filter("v", lambda x: x["last"].isin("as", "=>"))
    first = F.when((F.col("head") == "foreach") & (F.size(looped) > 0), F.element_at(looped, F.size(looped))).otherwise(F.try_element_at(assigned, F.lit(1)))
    whole = whole.withColumn("head", F.when((F.col("head") == "else") & (F.col("t")[0]["next"] == "if"), "elseif").otherwise(F.col("head")))
    placed = whole.filter(~F.col("head").isin("}", ";", "class", "interface", "trait")).withColumn("to", first)
    placed = placed.withColumn("read", F.filter("v", lambda x: F.col("to").isNull() | (x["n"] != F.col("to.n")))).withColumn("given", F.filter("read", lambda x: superglobal(x["text"])))
    after = F.filter("t", lambda x: x["n"] == F.col("to.n") + 2)
    clean = F.when(F.col("to").isNull() | (F.size("b") != 1), F.lit(False)).otherwise(F.coalesce(F.try_element_at(after, F.lit(1))["text"].isin(CLEANERS), F.lit(False)) & ~F.exists("t", lambda x: x["text"].isin(".", "+")))
    called = F.filter("b", lambda x: ~F.lower(x["last"]).isin(NOT_CALLS))
    risky = F.filter("v", lambda x: F.lower(x["lead"]).isin(SQL_CALLS))
    control = F.col("head").isin(*BRANCHES, *LOOPS, "switch", "try", "catch", "finally", "return", "throw", "break", "continue", "case", "default")
    adds = (F.col("to.next") != "=") | F.col("head").isin(*BRANCHES, *[h for h in LOOPS if h != "foreach"])
    out = placed.select(
        "path", F.col("stmt").alias("n"), F.col("t")[0]["line"].alias("line"), F.when(control, F.col("head")).when(F.col("to").isNotNull(), "assign").when(F.size(called) > 0, "call").otherwise("other").alias("kind"),
        F.col("to.text").alias("target"), F.coalesce(adds, F.lit(False)).alias("adds"), F.array_distinct(texts(F.filter("read", lambda x: ~superglobal(x["text"])))).alias("reads"), F.array_distinct(texts("given")).alias("sources"),
        F.array_min(F.transform("given", lambda x: x["line"])).alias("source_line"),
        clean.alias("cleaned"), F.transform(called, lambda x: x["last"]).alias("calls"), F.transform(risky, lambda x: F.struct(x["text"].alias("name"), x["line"].alias("line"))).alias("risky"), "head", "chain", F.transform(F.filter("t", lambda x: (x["text"] == "{") & (F.coalesce(x["last"], F.lit("")) != "\\")), lambda x: x["n"]).alias("blocks"),
        F.concat_ws("#", "path", "function.name", F.col("function.line").cast("string")).alias("unit"), F.col("function.at").alias("body"),
    )
    return out.select("path", "unit", "body", *[c for c in out.columns if c not in ("path", "unit", "body", "chain")], F.element_at("chain", -1).alias("parent"))


def wire(rows: list[dict]) -> list[tuple[int, int]]:
    """Edges between a function's statements, which come in order, by their places in the list; -1 stands for the start."""
    children: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        children.setdefault(r["parent"], []).append(i)
    edges: set[tuple[int, int]] = set()

    def run(block: int, before: list[int], out: list[int] | None, again: int | None) -> list[int]:
        """Wire a block's statements after ``before``; what is open at its end. ``out`` takes a loop's breaks, ``again`` is its head."""
        own, k = children.get(block, []), 0
        while k < len(own):
            i = own[k]
            r = rows[i]
            edges.update((b, i) for b in before)
            k += 1
            if r["head"] in ("if", "switch", "try", *LOOPS):
                loop = r["head"] in LOOPS
                breaks = [] if loop or r["head"] == "switch" else out
                after: list[int] = []
                inside = [i]
                for b in r["blocks"]:
                    ends = run(b, [i], breaks, i if loop else again)
                    after += ends
                    inside += [j for j in children.get(b, [])]
                if r["head"] == "switch":
                    edges.update((i, j) for j in inside[1:] if rows[j]["head"] in ("case", "default"))
                if loop:
                    edges.update((e, i) for e in after)
                    before = [i, *breaks]
                    continue
                test, closed = i, False
                while k < len(own) and rows[own[k]]["head"] in (("else", "elseif") if r["head"] == "if" else ("catch", "finally") if r["head"] == "try" else ()):
                    j = own[k]
                    head = rows[j]["head"]
                    edges.update((e, j) for e in ([test] if head in ("else", "elseif") else [*after, *inside] if head == "finally" else inside))
                    ends = [e for b in rows[j]["blocks"] for e in run(b, [j], out, again)] if rows[j]["blocks"] else [j]
                    after = ends if head == "finally" else [*after, *ends]
                    test, closed = j, closed or head == "else"
                    k += 1
                before = [*after, *([] if closed or r["head"] == "try" and after else [test]), *(breaks if r["head"] == "switch" else [])]
                if r["head"] == "if" and not r["blocks"] and i not in before:
                    before.append(i)
            elif r["head"] in ("return", "throw", "exit", "die"):
                before = []
            elif r["head"] == "break" and out is not None:
                out.append(i)
                before = []
            elif r["head"] == "continue" and again is not None:
                edges.add((i, again))
                before = []
            else:
                before = [i, *(e for b in r["blocks"] for e in run(b, [i], None, None))]
        return before

    run(rows[0]["body"], [-1], None, None)
    return sorted(edges)


def reaching(rows: list[dict]) -> list[dict[str, frozenset[int]] | None]:
    """For each statement, in a function's order, which variables are tainted when it starts, each with the lines of the sources; None where control never comes."""
    after: dict[int, list[int]] = {}
    for a, b in wire(rows):
        after.setdefault(a, []).append(b)
    state: list[dict[str, frozenset[int]] | None] = [None] * len(rows)

    def passed(i: int) -> dict[str, frozenset[int]]:
        now, r = dict(state[i]), rows[i]
        if r["target"] is not None:
            taint: frozenset[int] = frozenset() if r["cleaned"] else frozenset().union(*(now.get(v, frozenset()) for v in r["reads"]), [r["source_line"]] if r["sources"] else [])
            taint = taint | now.get(r["target"], frozenset()) if r["adds"] else taint
            now.pop(r["target"], None)
            if taint:
                now[r["target"]] = taint
        return now

    waiting = []
    for b in after.get(-1, []):
        state[b] = {}
        waiting.append(b)
    while waiting:
        i = waiting.pop()
        now = passed(i)
        for b in after.get(i, []):
            old = state[b]
            new = now if old is None else old | {v: old.get(v, frozenset()) | lines for v, lines in now.items()}
            if old is None or new != old:
                state[b] = new
                waiting.append(b)
    return state


def findings(found: DataFrame) -> DataFrame:
    """Statements -> rule_id, path, unit, line, subject, source_line, severity, confidence, message: calls that run SQL with a tainted variable or a superglobal in
    their brackets, one row for each line, subject and source. A function's statements come together; files and their functions are dealt out."""
    columns = ["n", "line", "target", "adds", "reads", "sources", "source_line", "cleaned", "risky", "head", "parent", "body", "blocks"]
    units = found.groupBy("path", "unit").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"), F.max(F.size("risky")).alias("most")).filter(F.col("most") > 0)
    kind = pa.struct([("line", pa.int32()), ("subject", pa.string()), ("source_line", pa.int32())])

    @F.arrow_udf("array<struct<line: int, subject: string, source_line: int>>")
    def reached(column: pa.Array) -> pa.Array:
        out = []
        for rows in plain(column):
            hits = set()
            for r, state in zip(rows, reaching(rows)):
                for risk in r["risky"] if state is not None else ():
                    name, line = risk["name"], risk["line"]
                    hits.update((line, name, source) for source in ([line] if name in SUPERGLOBALS else state.get(name, ())))
            out.append([dict(zip(("line", "subject", "source_line"), h)) for h in sorted(hits)])
        return pa.array(out, pa.list_(kind))

    rows = units.select("path", "unit", F.explode(reached("rows")).alias("h"))
    return rows.select(F.lit(RULE).alias("rule_id"), "path", "unit", "h.line", "h.subject", "h.source_line", F.lit(SEVERITY).alias("severity"), F.lit(CONFIDENCE).alias("confidence"), F.lit(MESSAGE).alias("message"))
