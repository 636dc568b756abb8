"""Rules over lines: findings with byte-exact positions and context.

A file's lines come from one row, so that context needs neither a shuffle nor a window. A pattern is tried only on lines
that hold a literal it cannot do without.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.literals import folded, holds, required
from ..functions.regex import portable
from .rules import RULES, Rule, severity_name

CONTEXT = 2


def lines_of(content: Column) -> Column:
    """Lines by newline, the empty one after a last newline included; null content has none."""
    return F.when(content.isNull(), F.array().cast("array<string>")).otherwise(F.split(content, "\n", -1))


def line_count(content: Column) -> Column:
    """Lines without the empty one after a last newline."""
    return F.when(content.isNull() | (content == ""), 0).otherwise(F.size(F.split(content, "\n", -1)) - F.when(content.endswith("\n"), 1).otherwise(0))


def context_of(lines: Column, i: Column, around: int = CONTEXT) -> Column:
    """The lines around line i (from 0), numbered, with the line itself marked."""

    def numbered(d: int) -> Column:
        n = (i + d + 1).cast("string")
        return F.concat(F.lit(">> " if d == 0 else "   "), F.when(F.length(n) < 4, F.lpad(n, 4, " ")).otherwise(n), F.lit(": "), F.get(lines, i + d))

    near = F.array(*[numbered(d) for d in range(-around, around + 1)])
    first, last = F.greatest(i - around, F.lit(0)), F.least(i + around, F.size(lines) - 1)
    return F.slice(near, first - i + around + 1, last - first + 1)


def trimmed(text: Column) -> Column:
    """Without white space at both ends. Text that begins and ends with visible ASCII has none there."""
    visible = F.ascii(text).between(33, 126) & F.ascii(F.right(text, F.lit(1))).between(33, 126)
    return F.when(visible, text).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def applies(rule: Rule, language: Column) -> Column:
    return F.lit(True) if "*" in rule.languages else F.coalesce(language.isin(*rule.languages), F.lit(False))


def findings(files: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """files(path, language, content) -> one row per match of a rule's pattern, and one per line with a literal."""
    tried = [(rule, seq, p, seq >= len(rule.patterns)) for rule in rules for seq, p in enumerate([*rule.patterns, *rule.literals])]
    if not tried:
        return findings(files.limit(0))
    needs = [required(re.escape(p) if literal else p) for _, _, p, literal in tried]
    text, language, path, none = F.col("text"), F.col("language"), F.coalesce("path", F.lit("null")), F.lit(None).cast("array<string>")

    def by_pattern(value: Callable[[str, bool], Column]) -> Column:
        """The value of the pattern that a row stands for; regular expressions have to be constants."""
        return reduce(lambda case, x: case.when(F.col("k") == x[0], value(x[1][2], x[1][3])), enumerate(tried), F.when(F.lit(False), none))

    split = files.select("path", "language", lines_of(F.col("content")).alias("lines"), lines_of(folded(F.col("content"))).alias("low"))
    lines = split.select("path", "language", "lines", F.posexplode_outer(F.arrays_zip(F.col("lines").alias("text"), F.col("low").alias("low"))).alias("i", "line"))
    lines = lines.select("path", "language", "lines", "i", "line.text", "line.low").filter(holds(F.col("low"), None if None in needs else frozenset().union(*needs)))
    # Outer, as a plain explode also filters by its array and works it out twice. The two array_compact cut the generated
    # stage: a method for all patterns and generators at once is too large for the JVM to compile, and twice as slow.
    # A pattern is tried where its literals stand: one row for each that matches.
    matching = [F.when(applies(rule, language) & holds(F.col("low"), s) & (text.contains(p) if literal else text.rlike(portable(p))), k) for k, ((rule, _, p, literal), s) in enumerate(zip(tried, needs))]
    lines = lines.select("path", "language", "lines", "i", "text", F.explode_outer(F.array_compact(F.array(*matching))).alias("k")).filter("k IS NOT NULL")
    # What it matches, and the text split there; of literals the first only.
    found = lines.select(
        "path", "language", "i", "text", "k", context_of(F.col("lines"), F.col("i")).alias("context"),
        by_pattern(lambda p, literal: F.array(F.lit(p)) if literal else F.regexp_extract_all(text, F.lit(portable(p)), F.lit(0))).alias("matches"),
        F.array_compact(by_pattern(lambda p, literal: F.array(F.substring_index(text, p, 1)) if literal else F.split(text, portable(p), -1))).alias("between"),
    )
    hits = found.select("path", "language", "i", "text", "k", "context", "matches", "between", F.posexplode_outer("matches").alias("j", "match")).drop("match")
    before = F.when(F.col("j") == 0, F.octet_length(F.get("between", F.lit(0)))).otherwise(
        F.octet_length(F.array_join(F.slice("between", F.lit(1), F.col("j") + 1), "")) + F.octet_length(F.array_join(F.slice("matches", F.lit(1), F.col("j")), ""))
    )
    shown = ("rule_id", "type", "severity", "name", "description", "cwe", "owasp", "category", "remediation")
    details = F.array(*[F.struct(*[F.lit(getattr(r, c)).alias(c) for c in shown], F.lit(seq).alias("seq"), F.lit(75 if literal else 85).alias("confidence")) for r, seq, _, literal in tried])
    hits = hits.select("path", "text", "context", F.element_at(details, F.col("k") + 1).alias("r"), (F.col("i") + 1).alias("line"), before.alias("start"))
    return hits.select(
        F.concat("r.rule_id", F.lit("-"), path, F.lit("-"), F.col("line").cast("string"), F.lit("-"), F.col("start").cast("string")).alias("finding_id"),
        "r.rule_id", "r.type", "r.severity", F.col("r.name").alias("title"), "r.description", F.col("path").alias("file"), "line", (F.col("start") + 1).alias("column"),
        trimmed(text).alias("code"), "context", "r.remediation", "r.cwe", "r.owasp", "r.category", "r.confidence", F.col("r.seq").alias("pattern"),
    )


def at_least(rows: DataFrame, severity: int) -> DataFrame:
    return rows.filter(F.col("severity") >= severity)


def by_severity(rows: DataFrame) -> DataFrame:
    return rows.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).select(severity_name(F.col("severity")).alias("severity"), "n")


def by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def scan_stats(files: DataFrame, rows: DataFrame, read: Column) -> DataFrame:
    """One row: files scanned and skipped by ``read``, lines of the scanned ones, findings."""
    counted = files.select(F.when(read, 1).otherwise(0).alias("scanned"), F.when(read, line_count(F.col("content"))).otherwise(0).alias("n"), F.lit(0).alias("finding"))
    every = counted.unionByName(rows.select(F.lit(None).cast("int").alias("scanned"), F.lit(0).alias("n"), F.lit(1).alias("finding")))
    return every.agg(
        F.sum("scanned").alias("files_scanned"), F.sum(1 - F.col("scanned")).alias("files_skipped"), F.sum("n").cast("long").alias("lines_scanned"), F.sum("finding").alias("findings_total")
    )


def listing_stats(listed: DataFrame, scanned: DataFrame, rows: DataFrame) -> DataFrame:
    """As ``scan_stats``, of a listing (path) and what of it was read: scanned(path, n lines). Other files count as skipped."""
    zero = F.lit(0).cast("long")
    every = listed.select(F.lit(1).cast("long").alias("listed"), zero.alias("read"), zero.alias("n"), zero.alias("finding"))
    every = every.unionByName(scanned.select(zero.alias("listed"), F.lit(1).cast("long").alias("read"), "n", zero.alias("finding")))
    every = every.unionByName(rows.select(zero.alias("listed"), zero.alias("read"), zero.alias("n"), F.lit(1).cast("long").alias("finding")))
    sums = every.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("listed", "read", "n", "finding")])
    return sums.select(F.col("read").alias("files_scanned"), (F.col("listed") - F.col("read")).alias("files_skipped"), F.col("n").alias("lines_scanned"), F.col("finding").alias("findings_total"))


def by_rule(rows: DataFrame) -> DataFrame:
    """What a report says of each rule: findings, files, and the first place by path, line and column."""
    first = F.min(F.struct("file", "line", "column"))
    return rows.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"), first.alias("f")).select("rule_id", "n", "files", "f.file", "f.line", "f.column")


def gate(rows: DataFrame) -> DataFrame:
    """file, has_critical, has_high (exactly high): what a build may stop on."""
    return rows.groupBy("file").agg(F.bool_or(F.col("severity") == 3).alias("has_critical"), F.bool_or(F.col("severity") == 2).alias("has_high"))
