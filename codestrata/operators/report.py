"""Reports: text blocks, JSON and SARIF 2.1.0, as rows that a sink can write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .rules import severity_name

# Labels and headings of the reports.
ORDER = [F.desc, F.asc, F.asc, F.asc, F.asc]
KEYS = ["severity", "file", "line", "column", "finding_id"]
NONE_FOUND = "No findings match the specified severity criteria."
TITLE, BY_SEVERITY, DETAILS = "=== Security Scanner Report ===", "Findings by Severity:", "=== Detailed Findings ==="
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
SARIF_HEAD = '{"version":"2.1.0","$schema":"' + SARIF_SCHEMA + '","runs":[{"tool":{"driver":{"name":"codestrata","version":"1.0.0","rules":['


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*[f(c) for f, c in zip(ORDER, KEYS)])


def level(severity: Column) -> Column:
    return F.when(severity.isin(2, 3), "error").when(severity == 1, "warning").when(severity == 0, "note").otherwise("warning")


def numbered(rows: DataFrame) -> DataFrame:
    """Findings with their ordinal in report order. The sorted ranges are written once; a range's rows are numbered from the
    count of those before it, so no task holds more than its range."""
    place = F.monotonically_increasing_id()
    parts = written(ordered(rows).select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("within")))
    before = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = before.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    return parts.join(F.broadcast(before), "part").withColumn("ordinal", F.col("before") + F.col("within") + 1).drop("part", "within", "before")


def text_blocks(rows: DataFrame) -> DataFrame:
    """file, ordinal (in the whole report), block: the detail block of each finding; empty entries are left out."""
    r = F.col
    entry = lambda label, name: F.when(r(name) != "", F.concat(F.lit(f"    {label}: "), r(name)))
    block = F.concat_ws(
        "\n",
        F.format_string("[%d] %s", r("ordinal"), r("title")),
        F.concat(F.lit("    Severity: "), F.upper(severity_name(r("severity")))),
        F.format_string("    File: %s:%d:%d", r("file"), r("line"), r("column")),
        F.concat(F.lit("    Type: "), r("type")),
        F.concat(F.lit("    Rule: "), r("rule_id")),
        entry("CWE", "cwe"),
        F.when(r("owasp") != "", F.format_string("    OWASP: %s (%s)", r("owasp"), r("category"))),
        F.concat(F.lit("    Description: "), r("description")),
        entry("Code", "code"),
        F.when(F.size("context") > 0, F.concat(F.lit("    Context:\n"), F.array_join(F.transform("context", lambda c: F.concat(F.lit("      "), c)), "\n"))),
        entry("Remediation", "remediation"),
        F.format_string("    Confidence: %d%%", r("confidence")),
    )
    return numbered(rows).select("file", "ordinal", block.alias("block"))


def json_findings(rows: DataFrame, *also: str) -> DataFrame:
    """finding_id, json: one object per finding; severities are numbers."""
    return rows.select("finding_id", F.col("pattern"), *also, F.to_json(F.struct("finding_id", "rule_id", "type", "severity", "file", "line", "column", "code", "cwe", "confidence")).alias("json"))


def sarif_rules(rows: DataFrame) -> DataFrame:
    """rule_id, json: each rule once, by the first of its findings."""
    first = F.min_by(F.struct("title", "description", "severity", "type", "cwe", "owasp"), F.struct("file", "line", "column"))
    r = rows.groupBy("rule_id").agg(first.alias("r"))
    rule = F.struct(
        F.col("rule_id").alias("id"), F.col("r.title").alias("name"), F.struct(F.col("r.title").alias("text")).alias("shortDescription"),
        F.struct(F.col("r.description").alias("text")).alias("fullDescription"), F.struct(level(F.col("r.severity")).alias("level")).alias("defaultConfiguration"),
        F.struct(F.array("r.type", severity_name(F.col("r.severity"))).alias("tags"), F.col("r.cwe").alias("cwe"), F.col("r.owasp").alias("owasp")).alias("properties"),
    )
    return r.select("rule_id", F.to_json(rule).alias("json"))


def sarif_results(rows: DataFrame, *also: str) -> DataFrame:
    """finding_id, level, json: one SARIF result per finding; an empty snippet is left out."""
    snippet = F.when(F.col("code") != "", F.struct(F.struct(F.col("code").alias("text")).alias("snippet")))
    where = F.struct(
        F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn")).alias("region"), snippet.alias("contextRegion")
    )
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.struct(F.col("description").alias("text")).alias("message"), F.array(F.struct(where.alias("physicalLocation"))).alias("locations"), level(F.col("severity")).alias("level")
    )
    return rows.select("finding_id", "pattern", *also, level(F.col("severity")).alias("level"), F.to_json(result).alias("json"))


def _whole(head: DataFrame, body: DataFrame, tail: list[str]) -> DataFrame:
    """position, text: the pieces of a document; read in order of position they are the document."""
    spark = body.sparkSession
    last = spark.createDataFrame([(2, k, t) for k, t in enumerate(tail)], "section int, position long, text string")
    return head.unionByName(body).unionByName(last)


def _listed(rows: DataFrame, column: str = "json", section: int = 1) -> DataFrame:
    comma = F.when(F.col("ordinal") > 1, ",").otherwise("")
    return rows.select(F.lit(section).alias("section"), F.col("ordinal").cast("long").alias("position"), F.concat(comma, column).alias("text"))


def text_document(rows: DataFrame, stats: DataFrame, least: int = 0) -> DataFrame:
    """section, position, text: header, counts by severity, and the findings of severity ``least`` and above in report order.

    stats: one row as of ``scan_stats``. The counts are those of all findings.
    """
    named = rows.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    counts = named.select(F.lit(0).alias("section"), (10 - F.col("severity")).cast("long").alias("position"), F.concat(F.lit("  "), F.upper(severity_name(F.col("severity"))), F.lit(": "), F.col("n")).alias("text"))
    top = F.concat_ws(
        "\n", F.lit(TITLE), F.lit(""), *[F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c), F.lit(0))) for label, c in (("Files scanned", "files_scanned"), ("Files skipped", "files_skipped"), ("Lines scanned", "lines_scanned"), ("Total findings", "findings_total"))],
        F.lit(""), F.lit(BY_SEVERITY),
    )
    kept = rows.filter(F.col("severity") >= least)
    found = kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("section"), F.lit(11).cast("long").alias("position"), F.when(F.col("n") > 0, f"\n{DETAILS}\n").otherwise(f"\n{NONE_FOUND}").alias("text"))
    head = stats.select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("position"), top.alias("text")).unionByName(counts).unionByName(found)
    blocks = text_blocks(kept).select(F.lit(1).alias("section"), F.col("ordinal").cast("long").alias("position"), F.concat("block", F.lit("\n")).alias("text"))
    return _whole(head, blocks, [])


def json_document(rows: DataFrame, stats: DataFrame, least: int = 0) -> DataFrame:
    """As ``text_document``: one JSON object with statistics and findings."""
    counts = rows.groupBy(severity_name(F.col("severity")).alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias("by_severity"))  # four rows
    head = stats.crossJoin(F.broadcast(counts)).select(  # one row and one row
        F.lit(0).alias("section"), F.lit(0).cast("long").alias("position"),
        F.concat(F.lit('{"statistics":'), F.to_json(F.struct("files_scanned", "files_skipped", "lines_scanned", "findings_total", "by_severity")), F.lit(',"findings":[')).alias("text"),
    )
    body = numbered(rows.filter(F.col("severity") >= least))
    return _whole(head, _listed(json_findings(body, "ordinal")), ["]}"])


def sarif_document(rows: DataFrame, stats: DataFrame, least: int = 0) -> DataFrame:
    """As ``text_document``: one SARIF 2.1.0 log, with the rules that have findings."""
    spark, kept = rows.sparkSession, rows.filter(F.col("severity") >= least)
    rules = sarif_rules(kept).withColumn("ordinal", F.row_number().over(W.orderBy("rule_id")))  # a row for each rule of the catalogue
    fixed = spark.createDataFrame([(0, 0, SARIF_HEAD), (0, 1 << 40, ']}},"results":[')], "section int, position long, text string")
    return _whole(fixed.unionByName(_listed(rules, section=0)), _listed(sarif_results(numbered(kept), "ordinal")), ["]}]}"])


DOCUMENTS = {"": text_document, "text": text_document, "json": json_document, "sarif": sarif_document}


def write_report(rows: DataFrame, stats: DataFrame, path: str, kind: str = "text", least: int = 0) -> None:
    """Write a report as text files; in order of their names they are one document. An unknown kind is an error."""
    if kind.lower() not in DOCUMENTS:
        raise ValueError(f"unsupported report format: {kind}")
    DOCUMENTS[kind.lower()](rows, stats, least).orderBy("section", "position").select("text").write.text(path)
