"""Linking: names to symbols, calls, includes, inheritance, dependencies, and closures over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.regex import portable
from ..session import written
from . import syntax


def use_bindings(lines: DataFrame) -> DataFrame:
    """path, alias, fqn: the last component is the alias where none is given."""
    fqn, alias = F.regexp_extract("text", portable(syntax.USE), 1), F.regexp_extract("text", portable(syntax.USE), 2)
    return lines.filter(F.col("text").rlike(portable(syntax.USE))).select("path", "line", F.when(alias != "", alias).otherwise(F.regexp_extract(fqn, r"([^\\]+)$", 1)).alias("alias"), F.concat(F.lit("\\"), fqn).alias("fqn"))


def resolved_names(lines: DataFrame) -> DataFrame:
    """path, kind, name, fqn, via: what the names of parents, contracts and called functions stand for in their file.

    A class is what the file's last use of that alias binds it to, else a class of the file's namespace. A function that is
    written in full stands for itself; else the file's use decides, then a function of that name in the program, then the
    file's namespace (its first; none is the global one).
    """
    own = syntax.classes(lines)
    classes = own.select("path", F.explode(F.array_compact(F.concat(F.array("extends"), F.coalesce("implements", F.array().cast("array<string>"))))).alias("name"))
    names = classes.withColumn("kind", F.lit("class")).unionByName(syntax.calls(lines).select("path", "name", F.lit("function").alias("kind"))).distinct()
    uses = use_bindings(lines).groupBy("path", F.col("alias").alias("name")).agg(F.max_by("fqn", "line").alias("bound"))
    pattern = portable(syntax.NAMESPACE)
    spaces = lines.filter(F.col("text").rlike(pattern)).groupBy("path").agg(F.min_by(F.regexp_extract("text", pattern, 1), "line").alias("space"))
    program = syntax.functions(lines).select("name", F.lit("function").alias("kind")).distinct().withColumn("known", F.lit(True))
    joined = names.join(uses, ["path", "name"], "left").join(program, ["name", "kind"], "left").join(spaces, "path", "left")
    whole = (F.col("kind") == "function") & F.col("name").startswith("\\")
    via = F.when(whole, "name").when(F.col("bound").isNotNull(), "use").when(F.col("known"), "global").otherwise("namespace")
    local = F.concat(F.lit("\\"), F.coalesce(F.concat("space", F.lit("\\")), F.lit("")), "name")
    fqn = F.when(whole, F.col("name")).when(F.col("bound").isNotNull(), F.col("bound")).when(F.col("known"), F.concat(F.lit("\\"), "name")).otherwise(local)
    return joined.select("path", "kind", "name", fqn.alias("fqn"), via.alias("via"))


def inheritance(lines: DataFrame) -> DataFrame:
    """path, class, relation, parent, parent_path: resolved against the classes of the program; null path if not among them."""
    own = syntax.classes(lines)
    parents = own.select("path", "name", F.lit("extends").alias("relation"), F.col("extends").alias("parent")).filter("parent IS NOT NULL")
    contracts = own.select("path", "name", F.lit("implements").alias("relation"), F.explode("implements").alias("parent"))
    known = own.groupBy("name").agg(F.min("path").alias("parent_path")).withColumnRenamed("name", "known")
    edges = parents.unionByName(contracts)
    return edges.join(known, edges["parent"] == known["known"], "left").select("path", F.col("name").alias("class"), "relation", "parent", "parent_path")


def call_edges(lines: DataFrame) -> DataFrame:
    """caller_path, line, seq, callee, callee_path, is_direct: a call is direct if a function of the program has its name; of
    several, the caller's own file comes first, then the first path."""
    called = syntax.calls(lines).select(F.col("path").alias("caller_path"), "line", "seq", F.col("name").alias("callee"))
    defined = syntax.functions(lines).select(F.col("name").alias("callee"), "path").distinct()
    own = defined.withColumnRenamed("path", "caller_path").withColumn("here", F.lit(True))
    first = defined.groupBy("callee").agg(F.min("path").alias("first_path"))
    joined = called.join(own, ["callee", "caller_path"], "left").join(first, "callee", "left")
    where = F.when(F.col("here"), F.col("caller_path")).otherwise(F.col("first_path"))
    return joined.select("caller_path", "line", "seq", "callee", where.alias("callee_path"), F.col("first_path").isNotNull().alias("is_direct"))


def resolved(folder: Column, target: Column) -> Column:
    """A path relative to a folder, as an absolute one without ``.`` and ``..``; those above the root stay at the root."""
    none = F.array().cast("array<string>")
    parts = F.split(F.concat_ws("/", folder, target), "/")
    step = lambda done, c: F.when(c.isin("", "."), done).when(c == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(c)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, none, step), "/"))


def include_edges(lines: DataFrame, files: DataFrame) -> DataFrame:
    """from_path, to_path, kind: relative targets start at the folder of the including file and have to be files of the
    program; absolute ones stay."""
    pattern = portable(syntax.INCLUDE)
    rows = lines.filter(F.col("text").rlike(pattern)).select(F.col("path").alias("from_path"), F.regexp_extract("text", pattern, 1).alias("kind"), F.regexp_extract("text", pattern, 2).alias("target"))
    absolute = F.col("target").startswith("/")
    relative = rows.filter(~absolute).select("from_path", "kind", resolved(F.regexp_extract("from_path", "^(.*)/[^/]*$", 1), F.col("target")).alias("to_path"))
    relative = relative.join(files.select(F.col("path").alias("to_path")), "to_path", "left_semi").select("from_path", "to_path", "kind")
    return relative.unionByName(rows.filter(absolute).select("from_path", F.col("target").alias("to_path"), "kind")).distinct()


def dependencies(lines: DataFrame, files: DataFrame) -> DataFrame:
    """from_path, to_path, kind: includes of each kind and resolved class references; the reverse edge is the same row read
    the other way."""
    classes = inheritance(lines).filter("parent_path IS NOT NULL AND parent_path <> path").select(F.col("path").alias("from_path"), F.col("parent_path").alias("to_path"), F.lit("class_ref").alias("kind"))
    return include_edges(lines, files).unionByName(classes).distinct()


def affected(edges: DataFrame, changed: DataFrame, depth: int = 3) -> DataFrame:
    """path, distance: changed files and all that depend on them within ``depth`` steps, at their fewest steps. Each round
    follows the files reached last and keeps those that are new, so that cycles and dense graphs end."""
    steps = written(edges.select(F.col("to_path").alias("path"), F.col("from_path").alias("next")).distinct())
    found = last = written(changed.select("path", F.lit(0).alias("distance")).distinct())
    for distance in range(1, depth + 1):
        reached = last.join(steps, "path").select(F.col("next").alias("path")).distinct()
        last = written(reached.join(found, "path", "left_anti").withColumn("distance", F.lit(distance)))
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return found


def degree(edges: DataFrame) -> DataFrame:
    """path, n_out, n_in of every file with an edge."""
    ends = edges.select(F.col("from_path").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("to_path").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("path").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def last_definitions(assigned: DataFrame) -> DataFrame:
    """path, variable, line, tainted: the last assignment of each variable decides."""
    newest = F.row_number().over(W.partitionBy("path", "target").orderBy(F.desc("line")))
    return assigned.withColumn("n", newest).filter("n = 1").select("path", F.col("target").alias("variable"), "line", "tainted")
