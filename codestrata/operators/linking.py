"""Linking of PHP programs by qualified names, from tokens: uses, classes with all their ancestors, overridden methods, calls.

Each stage is a relation that the next ones join: namespaces and uses give names their meaning, named classes give
ancestors, and these say which method a call reaches. Nothing is matched by bare names.
"""

from __future__ import annotations

from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexer import TYPES
from ..session import written

#: Words that a bracket may follow without a call.
NO_CALLS = [
    "if", "elseif", "for", "foreach", "while", "switch", "match", "catch", "function", "fn", "use", "array", "list", "isset", "unset", "empty", "exit", "die", "return", "echo", "print", "and", "or", "xor", "declare", "include",
    "include_once", "require", "require_once",
]
OWN = ["self", "static", "$this"]


def php_uses(texts: list[str]) -> list[tuple[str, str, str]]:
    """(kind, alias, qualified name) of a use statement's tokens: class, function or const; lists and groups too."""
    out: list[tuple[str, str, str]] = []

    def items(words: list[str], kind: str, prefix: str) -> None:
        if words[:1] in (["function"], ["const"]) and len(words) > 1:
            kind, words = words[0], words[1:]
        if "{" in words:
            at = words.index("{")
            inner: list[str] = []
            for w in [*words[at + 1 :], ","]:
                if w in (",", "}"):
                    if inner:
                        items(inner, kind, words[0].strip("\\") + "\\")
                    inner = []
                else:
                    inner.append(w)
        elif words and words[0][0] not in ";,}":
            name = prefix + words[0].strip("\\")
            out.append((kind, words[2] if len(words) > 2 and words[1] == "as" else name.rsplit("\\", 1)[-1], "\\" + name))

    kind, words, deep, first = "class", [], 0, True
    for w in [*texts[1:], ";"]:
        deep += (w == "{") - (w == "}")
        if w in (",", ";") and not deep:
            if first and words[:1] in (["function"], ["const"]):
                kind = words[0]
            items(words, kind, "")
            words, first = [], False
        else:
            words.append(w)
    return out


def php_parents(texts: list[str]) -> list[tuple[str, str]]:
    """(relation, name) of what a class statement's tokens extend and implement."""
    relation, out = None, []
    for w in texts:
        if w == "{":
            break
        if w in ("extends", "implements"):
            relation = w
        elif relation and w != ",":
            out.append((relation, w))
    return out


def _read(rows: DataFrame, read, kind: str, fields: list[str]) -> DataFrame:
    """Rows of tokens with their statement (``own``) -> the other columns and what a small reader finds in the statement's texts."""
    names = [c for c in rows.columns if c != "own"]

    @F.arrow_udf(f"array<struct<{kind}>>")
    def parsed(texts: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(fields, found)) for found in read(own)] for own in texts.to_pylist()], pa.list_(pa.struct([(f, pa.string()) for f in fields])))

    return rows.select(*names, F.explode(parsed(F.transform("own", lambda t: t["text"]))).alias("p")).select(*names, "p.*")


def last(k: int) -> Column:
    return F.coalesce(F.try_element_at("before", F.lit(-k)), F.lit(""))


def _resolved(names: DataFrame, uses: DataFrame, functions: bool = False) -> DataFrame:
    """Adds fqn and above to names(path, name, space, ...). Written in full, a name stands for itself; else a use of its first part decides (of the kind that is asked for, if it
    has one part only); else it lies in its namespace. A function that no use names may also be a global one: above is its name there, else null."""
    name = F.col("name")
    first, rest = F.substring_index("name", "\\", 1), F.expr("substring(name, length(substring_index(name, '\\\\', 1)) + 1)")
    one = ~name.contains("\\")
    keyed = names.withColumn("use_kind", F.when(one, F.lit("function" if functions else "class")).otherwise("class")).withColumn("first", first).withColumn("rest", rest)
    kinds = ["class", "function"] if functions else ["class"]
    bound = uses.filter(F.col("kind").isin(kinds)).groupBy("path", F.col("kind").alias("use_kind"), F.col("alias").alias("first")).agg(F.max("fqn").alias("bound"))
    joined = keyed.join(bound, ["path", "use_kind", "first"], "left")
    here = F.when(first == "namespace", F.concat("space", F.expr("substring(name, 11)"))).otherwise(F.concat("space", "name"))
    fqn = F.when(name.startswith("\\"), name).when(F.col("bound").isNotNull(), F.concat("bound", "rest")).otherwise(here)
    above = F.when(F.lit(functions) & one & F.col("bound").isNull(), F.concat(F.lit("\\"), "name"))
    return joined.withColumn("fqn", fqn).withColumn("above", above).select(*names.columns, "fqn", "above")


def closure(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> a, b, distance: all that is reached, at the fewest steps. Paths are doubled, so a chain of n takes log n rounds; cycles end.
    What leads nowhere itself is reached by one last step, and takes no part in the rounds."""
    every = edges.select("a", "b").distinct()
    inner = every.join(every.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
    found, steps = written(inner.withColumn("distance", F.lit(1))), 1
    # If some were further apart than so many steps, some would be just so many apart.
    while (found.agg(F.max("distance")).first()[0] or 0) == steps:
        onward = found.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("distance").alias("more"))
        longer = found.join(onward, "b").select("a", F.col("c").alias("b"), (F.col("distance") + F.col("more")).alias("distance"))
        found, steps = written(found.unionByName(longer).groupBy("a", "b").agg(F.min("distance").alias("distance"))), steps * 2
    ends = every.join(every.select(F.col("a").alias("b")).distinct(), "b", "left_anti").select("a", "b")
    onto = found.join(ends.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"), (F.col("distance") + 1).alias("distance"))
    return found.unionByName(ends.withColumn("distance", F.lit(1)).unionByName(onto).groupBy("a", "b").agg(F.min("distance").alias("distance")))


class Program:
    """The linked relations of a program, each made when it is asked for. The tokens are read several times for all but ``uses``: pass a written table.

    uses: path, kind, alias, fqn. classes: fqn, kind, path, line. functions: fqn, owner (class; null of plain ones), name, path, line, opens.
    parents: fqn, relation, parent, parent_path. ancestors: fqn, ancestor, distance. overrides: fqn, overridden, distance. calls: path, line, caller,
    kind (function, static, method, new), callee, callee_path, is_direct. A name that the program does not define keeps its qualified form and has no path.
    """

    def __init__(self, tokens: DataFrame):
        self.rows = tokens.filter(F.col("language") == "php")

    @cached_property
    def uses(self) -> DataFrame:
        scope = F.try_element_at("chain", F.lit(-1))
        heads = self.rows.filter((F.col("text") == "use") & (F.col("n") == F.col("stmt")) & ~F.coalesce(scope == F.col("type.at"), F.lit(False)))  # in a class it is a trait
        return _read(heads.select("path", "own"), php_uses, "kind: string, alias: string, fqn: string", ["kind", "alias", "fqn"])

    @cached_property
    def _uses(self) -> DataFrame:
        return written(self.uses)

    @cached_property
    def _types(self) -> DataFrame:
        """Names of types with their statements."""
        named = (F.col("kind") == "word") & last(1).isin(*TYPES) & (last(2) != "::") & ~F.col("text").isin("extends", "implements")
        return self.rows.filter(named).select(F.concat("space", "text").alias("fqn"), last(1).alias("kind"), "path", "line", "space", "own")

    @cached_property
    def classes(self) -> DataFrame:
        return self._types.select("fqn", "kind", "path", "line")

    @cached_property
    def functions(self) -> DataFrame:
        of = F.when(F.try_element_at("chain", F.lit(-1)) == F.col("type.at"), F.concat("space", "type.name"))
        named = self.rows.filter((F.col("kind") == "word") & (last(1) == "function")).withColumn("owner", of)
        fqn = F.when(F.col("owner").isNull(), F.concat("space", "text")).otherwise(F.concat("owner", F.lit("::"), "text"))
        return named.select(fqn.alias("fqn"), "owner", F.col("text").alias("name"), "path", "line", "opens")

    @cached_property
    def _edges(self) -> DataFrame:
        named = _read(self._types.select("path", "space", F.col("fqn").alias("of"), "own"), php_parents, "relation: string, name: string", ["relation", "name"])
        return written(_resolved(named, self._uses).select(F.col("of").alias("fqn"), "relation", F.col("fqn").alias("parent")).distinct())

    @cached_property
    def homes(self) -> DataFrame:
        return self.classes.groupBy("fqn").agg(F.min("path").alias("home"))

    @cached_property
    def parents(self) -> DataFrame:
        homes = self.homes.select(F.col("fqn").alias("parent"), F.col("home").alias("parent_path"))
        return self._edges.join(homes, "parent", "left").select("fqn", "relation", "parent", "parent_path")

    @cached_property
    def ancestors(self) -> DataFrame:
        return closure(self._edges.select(F.col("fqn").alias("a"), F.col("parent").alias("b"))).select(F.col("a").alias("fqn"), F.col("b").alias("ancestor"), "distance")

    @cached_property
    def _methods(self) -> DataFrame:
        return written(self.functions.filter("owner IS NOT NULL").groupBy("owner", "name").agg(F.min_by(F.struct("fqn", "path"), "path").alias("m")))

    @cached_property
    def _inherited(self) -> DataFrame:
        """fqn, name, distance, m: the methods of a class's ancestors."""
        return self.ancestors.join(self._methods.withColumnRenamed("owner", "ancestor"), "ancestor").select("fqn", "name", "distance", "m")

    @cached_property
    def overrides(self) -> DataFrame:
        methods = self._methods.select(F.col("owner").alias("fqn"), "name", F.col("m.fqn").alias("method"))
        met = methods.join(self._inherited.select("fqn", "name", "distance", F.col("m.fqn").alias("overridden")), ["fqn", "name"])
        nearest = met.groupBy("method").agg(F.min(F.struct("distance", "overridden")).alias("o"))
        return nearest.select(F.col("method").alias("fqn"), "o.overridden", "o.distance")

    @cached_property
    def calls(self) -> DataFrame:
        return _calls(self)


def link(tokens: DataFrame) -> Program:
    """Tokens (``functions.lexer``) of a program -> its linked relations."""
    return Program(tokens)


def _calls(program: Program) -> DataFrame:
    word = last(1).rlike(r"^\\?[\p{L}_]") & ~F.lower(last(1)).isin(NO_CALLS)
    opened = F.col("text") == "("
    made = (F.col("kind") == "word") & (last(1) == "new") & ~F.col("text").startswith("$") & (F.col("text") != "class")
    kind = (
        F.when(made, "new").when(opened & word & (last(2) == "::"), "static").when(opened & word & (last(2) == "->"), "method")
        .when(opened & word & ~last(2).isin("function", "new", "fn", "const"), "function")
    )
    name = F.when(kind == "new", F.col("text")).when(kind == "static", last(3)).otherwise(last(1))
    # The function and the class that a call stands in are the innermost around it, as the lexer knows them.
    function = F.concat("space", F.coalesce(F.concat("function.of", F.lit("::")), F.lit("")), "function.name")
    columns = ["path", "line", "caller", "how"]
    placed = program.rows.select("path", "line", F.coalesce(function, "path").alias("caller"), kind.alias("how"), name.alias("name"), last(1).alias("method"), last(3).alias("object"), F.concat("space", "type.name").alias("home"), "space")
    placed = written(placed.filter("how IS NOT NULL"))

    plain = _resolved(placed.filter("how = 'function'").select(*columns, "name", "space"), program._uses, functions=True)
    defined = written(program.functions.filter("owner IS NULL").groupBy("fqn").agg(F.min("path").alias("callee_path")))
    plain = plain.join(defined, "fqn", "left").withColumn("second", F.coalesce("above", "fqn"))
    plain = plain.join(defined.select(F.col("fqn").alias("second"), F.col("callee_path").alias("second_path")), "second", "left")
    is_above = F.col("callee_path").isNull() & F.col("second_path").isNotNull()
    plain = plain.select(*columns, F.when(is_above, F.col("second")).otherwise(F.col("fqn")).alias("callee"), F.coalesce("callee_path", "second_path").alias("callee_path"))

    fixed = placed.filter(F.col("how").isin("new", "static") & ~F.col("name").isin(*OWN, "parent")).select(*columns, "name", "space", "method")
    fixed = _resolved(fixed, program._uses).withColumn("least", F.lit(0)).drop("space", "above")
    own = placed.filter(((F.col("how") == "method") & (F.col("object") == "$this") | F.col("how").isin("new", "static") & F.col("name").isin(*OWN, "parent")) & F.col("home").isNotNull())
    own = own.select(*columns, "name", "method", F.col("home").alias("fqn"), F.when(F.col("name") == "parent", 1).otherwise(0).alias("least"))
    of_class = fixed.unionByName(own)
    homes = program.homes.withColumnRenamed("home", "callee_path")
    made_of = of_class.filter("how = 'new'").join(homes, "fqn", "left").select(*columns, F.col("fqn").alias("callee"), "callee_path")

    # A method is the class's own or that of the nearest ancestor; parent:: asks for the latter.
    reached = program._methods.select(F.col("owner").alias("fqn"), "name", F.lit(0).alias("distance"), "m").unionByName(program._inherited)
    near = F.struct("distance", "m.fqn", "m.path")
    best = reached.groupBy("fqn", F.col("name").alias("method")).agg(F.min(near).alias("b0"), F.min(F.when(F.col("distance") > 0, near)).alias("b1"))
    on_class = of_class.filter("how <> 'new'").join(best, ["fqn", "method"], "left").withColumn("b", F.when(F.col("least") == 0, F.col("b0")).otherwise(F.col("b1")))
    on_class = on_class.select(*columns, F.coalesce("b.fqn", F.concat("fqn", F.lit("::"), "method")).alias("callee"), F.col("b.path").alias("callee_path"))

    open_ = placed.filter("how = 'method' AND (object <> '$this' OR home IS NULL)").select(*columns, F.col("method").alias("callee"), F.lit(None).cast("string").alias("callee_path"))
    every = plain.unionByName(made_of).unionByName(on_class).unionByName(open_)
    return every.select("path", "line", "caller", F.col("how").alias("kind"), "callee", "callee_path", F.col("callee_path").isNotNull().alias("is_direct"))
