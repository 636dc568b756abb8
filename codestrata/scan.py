"""A scan from end to end: a folder of source files to findings, statistics and a report."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .operators import match, report
from .operators.rules import chosen, parse_severity
from .session import written
from .sources.corpus import folder_corpus, folder_listing, listed_path


@dataclass(frozen=True)
class Scan:
    """findings: all of them, whatever their severity. stats: one row of totals. least: what reports show at least."""

    findings: DataFrame
    stats: DataFrame
    least: int

    def document(self, kind: str = "text") -> DataFrame:
        """section, position, text: the report in pieces, in that order."""
        if kind.lower() not in report.DOCUMENTS:
            raise ValueError(f"unsupported report format: {kind}")
        return report.DOCUMENTS[kind.lower()](self.findings, self.stats, self.least)

    def write(self, path: str, kind: str = "text") -> None:
        report.write_report(self.findings, self.stats, path, kind, self.least)

    def passes(self, severity: str = "high") -> bool:
        """Whether nothing of that severity or above was found."""
        return match.at_least(self.findings, parse_severity(severity)).isEmpty()


def scan(
    spark: SparkSession, folder: str, enabled: list[str] | None = None, disabled: list[str] = (), severity: str = "medium", allow_dirs: list[str] = (),
    exclude_dirs: list[str] = (), ignore: list[str] = tuple(paths.IGNORED), max_files: int = 0,
) -> Scan:
    """Scan a folder. Files are skipped if their extension is not read, their folder is not among ``allow_dirs`` (where
    given), is excluded, or holds an ignored part; of the rest the first ``max_files`` by path are read (0: all).
    Exclusions and relative patterns look at paths below the folder, so where it lies does not matter.

    The folder is listed first, and only files that are scanned are opened, whatever lies beside them. Files that cannot be
    read, or exceed the session's limit of ``binaryFile``, count as skipped; bytes that are not UTF-8 do no harm. Spark's listings leave out files without a byte, so they are not counted. Findings are written to the shared folder
    once, as reports and statistics read them several times.
    """
    listed = written(folder_listing(spark, folder))
    root = re.sub("^[a-z0-9+.-]+:(//[^/]*)?", "", folder).rstrip("/")
    absolute = [d for d in allow_dirs if d.startswith("/")]
    relative = [d for d in allow_dirs if not d.startswith("/")]

    def read(path: Column) -> Column:
        below = F.regexp_replace(path, f"^{re.escape(root)}/", "./")
        out = paths.readable(path) & ~paths.ignored(below, [], [*paths.EXCLUDED, *exclude_dirs], list(ignore))
        if allow_dirs:
            out = out & (paths.any_pattern(paths.folder(path), absolute) | paths.any_pattern(paths.folder(below), relative))
        return out if last is None else out & (path <= last)

    last = None
    if max_files > 0:
        last = listed.filter(read(F.col("path"))).select("path").orderBy("path").limit(max_files).agg(F.max("path")).first()[0]
    files = folder_corpus(spark, folder, keep=read(listed_path()))
    found = written(match.findings(files, chosen(enabled, disabled)))
    lines = files.select("path", match.line_count(F.col("content")).cast("long").alias("n"))
    stats = written(match.listing_stats(listed, lines, found))
    return Scan(found, stats, parse_severity(severity))
