"""Paths: extensions, languages, and the rules that leave files out. All are column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages by extension, extensions read, and defaults that leave paths out.
LANGUAGES = {
    "scanner": {".go": "go", ".php": "php", ".js": "javascript", ".mjs": "javascript", ".ts": "typescript", ".java": "java", ".py": "python", ".rb": "ruby", ".cs": "csharp", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".html": "html", ".htm": "html"},
    "parser": {".go": "go", ".php": "php", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".py": "python", ".rb": "ruby", ".cs": "csharp", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c"},
}
EXTENSIONS = [".go", ".php", ".js", ".ts", ".java", ".py", ".rb", ".cs", ".cpp", ".c", ".h", ".hpp", ".jsx", ".tsx", ".vue", ".html"]
IGNORED = ["vendor/", "node_modules/", ".git/", "*.min.js", "*.test.*", "*_test.go"]
EXCLUDED = ["vendor", "node_modules", ".git", ".svn", ".hg", "build", "dist", "target", "bin", "obj", "tmp", "temp", "cache", "logs", ".vscode", ".idea", ".DS_Store", "coverage", "__pycache__", ".pytest_cache", ".tox", ".mypy_cache"]


def extension(path: Column) -> Column:
    """From the last dot of the last component, the dot included; empty if there is none."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def language_of(path: Column, scope: str = "scanner") -> Column:
    """``unknown`` for other extensions. The parser's table ignores case, the scanner's does not."""
    ext = extension(path)
    ext = F.lower(ext) if scope == "parser" else ext
    pairs = [F.lit(x) for item in LANGUAGES[scope].items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), ext), F.lit("unknown"))


def readable(path: Column) -> Column:
    return extension(path).isin(EXTENSIONS)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def pattern_regex(patterns: list[str]) -> str:
    """One regular expression for all patterns. An absolute pattern is a prefix. A relative one is a prefix, a run of
    whole components, or a glob over the path or one component."""
    prefixes, runs, globs = [re.escape(p) for p in patterns], [], []
    for p in patterns:
        if not p.startswith("/"):
            glob = re.escape(p).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
            runs.append(re.escape(p.strip("/")))
            (globs if "/" in p else runs).append(glob)
    either = lambda xs: "(?:" + "|".join(dict.fromkeys(xs)) + ")"
    parts = ["^" + either(prefixes)] + [f"(?:^|/){either(runs)}(?:/|$)"] * bool(runs) + [f"^{either(globs)}$"] * bool(globs)
    return "|".join(parts)


def any_pattern(path: Column, patterns: list[str]) -> Column:
    return path.rlike(pattern_regex(patterns)) if patterns else F.lit(False)


def matches_pattern(path: Column, pattern: str) -> Column:
    return any_pattern(path, [pattern])


def ignored(path: Column, allowed: list[str] = (), excluded: list[str] = EXCLUDED, ignore: list[str] = IGNORED) -> Column:
    """Whether a file's folder is left out: by the allow list, then exclusions, then plain substrings. A
    component pattern holds for a folder if it holds for one above it, so the file's own folder decides."""
    where = folder(path)
    inside = [re.escape(s.removesuffix("/")) + ("(?:/|$)" if s.endswith("/") else "") for s in ignore]
    left_out = "|".join(([pattern_regex(list(excluded))] if excluded else []) + inside)
    out = where.rlike(left_out) if left_out else F.lit(False)
    return out | ~any_pattern(where, list(allowed)) if allowed else out


def to_uri(path: Column) -> Column:
    return F.concat(F.lit("file://"), path)


def from_uri(uri: Column) -> Column:
    return F.regexp_replace(uri, "^file://", "")


def at_most(files: DataFrame, n: int) -> DataFrame:
    """The first n files by path: a limit that does not depend on the order in which files are met."""
    return files.orderBy("path").limit(n)
