"""Symbols of source files: extraction by language, scopes, name index, lookups, flags, symbol rules."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.regex import portable

CLASS, METHOD, FUNCTION, VARIABLE, CONSTANT, FIELD = 5, 6, 12, 13, 14, 8

# Extraction patterns by language, in order of emission. The last entry serves other languages.
EXTRACTORS = {
    "php": [
        (CLASS, r"(?m)^\s*(?:abstract\s+|final\s+)?class\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*(?:extends\s+[a-zA-Z_][a-zA-Z0-9_]*\s*)?(?:implements\s+[a-zA-Z_][a-zA-Z0-9_,\s]*\s*)?\{"),
        (FUNCTION, r"(?m)^\s*(?:public\s+|private\s+|protected\s+|static\s+)*function\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\("),
        (VARIABLE, r"(?m)^\s*(?:public\s+|private\s+|protected\s+|static\s+)*\$([a-zA-Z_][a-zA-Z0-9_]*)\s*[=;]"),
    ],
    "javascript": [
        (FUNCTION, r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\("),
        (CLASS, r"(?m)^\s*(?:export\s+)?class\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*(?:extends\s+[a-zA-Z_$][a-zA-Z0-9_$]*\s*)?\{"),
        (VARIABLE, r"(?m)^\s*(?:const|let|var)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*[=;]"),
    ],
    "python": [(CLASS, r"(?m)^\s*class\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*(?:\([^)]*\))?\s*:"), (FUNCTION, r"(?m)^\s*def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(")],
    "java": [
        (CLASS, r"(?m)^\s*(?:public\s+|private\s+|protected\s+)?(?:abstract\s+|final\s+)?class\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*(?:extends\s+[a-zA-Z_][a-zA-Z0-9_]*\s*)?(?:implements\s+[a-zA-Z_][a-zA-Z0-9_,\s]*\s*)?\{"),
        (METHOD, r"(?m)^\s*(?:public\s+|private\s+|protected\s+)?(?:static\s+)?(?:abstract\s+|final\s+)?[a-zA-Z_<>\[\]]+\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\("),
    ],
    # Go is read by an approximation of its declarations, not by a parser.
    "go": [(FUNCTION, r"(?m)^func\s+(?:\([^)]*\)\s*)?([a-zA-Z_][a-zA-Z0-9_]*)\s*\("), (CLASS, r"(?m)^type\s+([a-zA-Z_][a-zA-Z0-9_]*)\s"), (VARIABLE, r"(?m)^\s*(?:var|const)\s+([a-zA-Z_][a-zA-Z0-9_]*)")],
    "*": [(FUNCTION, r"(?m)^\s*(?:function|def|func|sub|procedure)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*[\(\{]")],
}
EXTRACTORS["typescript"] = EXTRACTORS["javascript"]

# Substrings of a symbol's lines, lower-cased, that set its flags.
FLAGS = {
    "user_input": ["$_get", "$_post", "$_request", "$_cookie", "$_session", "request.query", "request.body", "request.params", "http.request", "r.url.query", "r.form"],
    "sql": ["select ", "insert ", "update ", "delete ", "drop ", "mysql_query", "mysqli_query", "pg_query", "db.query", "execute(", "prepare(", "query("],
    "command": ["system(", "exec(", "shell_exec(", "passthru(", "os.system", "subprocess.", "exec.command", "runtime.exec", "processbuilder"],
    "filesystem": ["file_get_contents", "fopen(", "fwrite(", "include(", "require(", "readfile(", "os.open", "open(", "ioutil.readfile", "os.readfile", "filepath.walk"],
    "auth": ["password", "authenticate", "login", "session", "jwt", "token", "auth", "credential"],
    "crypto": ["md5(", "sha1(", "crypt(", "hash(", "encrypt", "decrypt", "cipher", "crypto.", "bcrypt", "scrypt", "pbkdf2"],
}
TAINT = ["$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "request.query", "request.body", "request.params", "http.Request", "user input", "external data"]
SECRET_RULE, SECRET_KINDS = "SYMBOL-SECRET-001", [VARIABLE, CONSTANT, FIELD]
SECRET_NAMES = ["password", "passwd", "pwd", "secret", "key", "token", "api_key", "apikey", "private_key", "credential", "auth", "certificate"]
SECRET_TEXT = "Detects hardcoded secrets through variable analysis"


_PLACED = [("ordinal", pa.int32()), ("name", pa.string()), ("kind", pa.int32()), ("start_line", pa.int32()), ("start_char", pa.int32()), ("end_line", pa.int32()), ("end_char", pa.int32()), ("body", pa.string())]


def place(content: str, found: list[dict]) -> list[dict]:
    """Where matches lie in a file. found: for each pattern its kind, the bytes between matches and of matches, in order, and the names. One pass over
    the file's line starts, and sums along the matches."""
    raw = np.frombuffer(content.encode(), np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(raw == 10) + 1])
    out: list[dict] = []
    for own in found:
        if not own["names"]:
            continue
        n = len(own["names"])
        end = np.cumsum(np.add(own["between"][:n], own["matched"]))
        start = end - np.array(own["matched"])
        first, last = np.searchsorted(starts, start, "right") - 1, np.searchsorted(starts, end, "right") - 1
        stop = np.append(starts[1:] - 1, len(raw))[last]
        for name, a, z, i, j, e in zip(own["names"], start.tolist(), end.tolist(), first.tolist(), last.tolist(), stop.tolist()):
            line, until = int(starts[i]), int(starts[j])
            out.append({"ordinal": len(out), "name": name, "kind": own["kind"], "start_line": i, "start_char": a - line, "end_line": j, "end_char": z - until, "body": raw[line:e].tobytes().decode()})
    return out


def symbols(files: DataFrame) -> DataFrame:
    """files -> path, language, ordinal, name, kind, start_line, start_char, end_line, end_char (from 0), flags, tainted_sources.

    Symbols come in order of pattern, then of place; an extent is that of the matched header. Matching is Spark's; what it finds is placed file by
    file in time that grows with the file, and flags look at each symbol's own lines once.
    """
    content = F.col("content")

    def found(language: str) -> Column:
        def of(kind: int, pattern: str) -> Column:
            java = portable(pattern)
            sizes = lambda texts: F.transform(texts, lambda x: F.octet_length(x))
            matches = F.regexp_extract_all(content, F.lit(java), F.lit(0))
            return F.struct(
                F.lit(kind).alias("kind"), sizes(F.split(content, java, -1)).alias("between"), sizes(matches).alias("matched"), F.regexp_extract_all(content, F.lit(java), F.lit(1)).alias("names")
            )

        return F.array(*[of(k, p) for k, p in EXTRACTORS[language]])

    known = [k for k in EXTRACTORS if k != "*"]
    by_language = found("*")
    for k in known:
        by_language = F.when(F.col("language") == k, found(k)).otherwise(by_language)

    @F.arrow_udf(f"array<struct<{', '.join(f'{c}: ' + ('string' if t == pa.string() else 'int') for c, t in _PLACED)}>>")
    def placed(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([place(t, f) if t is not None and f is not None else None for t, f in zip(texts.to_pylist(), spans.to_pylist())], pa.list_(pa.struct(_PLACED)))

    rows = files.filter(content.isNotNull()).select("path", "language", F.explode(placed(content, by_language)).alias("s")).select("path", "language", "s.*").withColumn("lowered", F.lower("body"))
    body = F.col("lowered")
    flags = [body.rlike("|".join(re.escape(w) for w in words)).alias(name) for name, words in FLAGS.items()]
    taint = F.array_compact(F.array(*[F.when(body.contains(w.lower()), F.lit(w)) for w in TAINT])).alias("tainted_sources")
    return rows.select("path", "language", *[c for c, _ in _PLACED if c != "body"], *flags, taint)


def symbol_id(path: Column) -> Column:
    """The first half of a digest of where and what the symbol is."""
    key = F.concat_ws(":", F.concat(F.lit("file://"), path), *[F.col(c).cast("string") for c in ("start_line", "start_char", "end_line", "end_char", "kind")])
    return F.substring(F.sha2(key, 256), 1, 16)


def scopes(rows: DataFrame) -> DataFrame:
    """Adds symbol_id and parent_id: a file's first symbol is its root, later ones hang from it."""
    ids = rows.withColumn("symbol_id", symbol_id(F.col("path"))).withColumn("name_path", F.col("name"))
    first = F.first("symbol_id").over(W.partitionBy("path").orderBy("ordinal"))
    return ids.withColumn("parent_id", F.when(F.col("ordinal") > 0, first))


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<!^)([A-Z])", "_$1"))


def postings(rows: DataFrame) -> DataFrame:
    """term, score, symbol_id, name_path, kind, path: the exact name, each component of the path, the snake form."""
    def entry(term: Column, score: Column) -> Column:
        return F.struct(F.lower(term).alias("term"), score.cast("double").alias("score"))

    parts = F.transform(F.split("name_path", "[.]"), lambda p, i: entry(p, 1.0 / (i + 1)))
    snake = F.when(snake_case(F.col("name")) != F.col("name"), F.array(entry(snake_case(F.col("name")), F.lit(0.8)))).otherwise(F.array().cast("array<struct<term:string,score:double>>"))
    entries = F.concat(F.array(entry(F.col("name"), F.lit(1.0))), parts, snake)
    return rows.select("symbol_id", "name_path", "kind", "path", F.explode(entries).alias("e")).select("e.term", "e.score", "symbol_id", "name_path", "kind", "path")


def find_symbol(index: DataFrame, query: str, kinds: list[int] = ()) -> DataFrame:
    """Exact terms by their score, terms that contain the query by 0.7 of it."""
    q = query.lower()
    rows = index.filter(F.col("kind").isin(*kinds)) if kinds else index
    return rows.filter(F.col("term").contains(q)).withColumn("score", F.when(F.col("term") == q, F.col("score")).otherwise(F.col("score") * 0.7))


def symbol_at(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """positions(path, line, char, ...) -> with the innermost symbol there; none stays null. Extents hold both ends."""
    at, start, end = (F.col(a).cast("long") * 1_000_000 + F.col(b) for a, b in (("line", "char"), ("start_line", "start_char"), ("end_line", "end_char")))
    # A symbol meets the positions on its own lines only.
    own = rows.select(F.col("path").alias("own"), "symbol_id", "name", start.alias("start"), end.alias("end"), F.explode(F.sequence("start_line", "end_line")).alias("own_line"))
    joined = positions.join(own, (F.col("path") == F.col("own")) & (F.col("line") == F.col("own_line")) & at.between(F.col("start"), F.col("end")), "left")
    inner = F.min_by(F.struct("symbol_id", "name"), F.struct(F.col("end") - F.col("start"), -F.col("start"), "symbol_id"))
    return joined.groupBy(*positions.columns).agg(inner.alias("s")).select(*positions.columns, "s.symbol_id", "s.name")


def vulnerable(rows: DataFrame) -> DataFrame:
    return rows.filter("user_input OR sql OR command OR filesystem OR size(tainted_sources) > 0")


def confidence() -> Column:
    points = F.lit(50)
    for flag, n in (("user_input", 20), ("sql", 25), ("command", 25)):
        points = points + F.when(F.col(flag), n).otherwise(0)
    return F.least(F.lit(100), points + F.when(F.size("tainted_sources") > 0, 15).otherwise(0))


def symbol_findings(rows: DataFrame) -> DataFrame:
    """Of vulnerable symbols, the variables whose names speak of secrets: the one rule that holds for all languages."""
    named = F.exists(F.array(*map(F.lit, SECRET_NAMES)), lambda w: F.lower("name").contains(w))
    hits = vulnerable(rows).filter(F.col("kind").isin(SECRET_KINDS) & named)
    text = F.format_string("%s detected in symbol '%s' (%s)", F.lit(SECRET_TEXT), "name", "name_path")
    return hits.select(F.lit(SECRET_RULE).alias("rule_id"), "path", (F.col("start_line") + 1).alias("line"), (F.col("start_char") + 1).alias("column"), "name", text.alias("description"), confidence().alias("confidence"))


@dataclass(frozen=True)
class SymbolRule:
    """A rule over symbols: of these kinds and languages, with one of the names in theirs, and all of the flags."""

    rule_id: str
    description: str
    severity: int
    cwe: str
    languages: tuple[str, ...]
    kinds: tuple[int, ...]
    names: tuple[str, ...]
    flags: tuple[str, ...] = ()


# The rules over symbols.
SYMBOL_RULES = [
    SymbolRule("SYMBOL-SQL-001", "Detects SQL injection vulnerabilities through data flow analysis", 3, "CWE-89", ("go", "php", "java", "python", "javascript"), (FUNCTION, METHOD), ("query", "execute", "prepare"), ("user_input", "sql")),
    SymbolRule("SYMBOL-XSS-001", "Detects XSS vulnerabilities through output context analysis", 2, "CWE-79", ("php", "javascript", "java", "python"), (FUNCTION, METHOD), ("echo", "print", "write", "render"), ("user_input",)),
    SymbolRule("SYMBOL-CMD-001", "Detects command injection through system call analysis", 3, "CWE-78", ("php", "python", "java", "go"), (FUNCTION,), ("system", "exec", "command", "shell"), ("user_input", "command")),
    SymbolRule(SECRET_RULE, SECRET_TEXT, 2, "CWE-798", ("*",), tuple(SECRET_KINDS), tuple(SECRET_NAMES)),
]


def rule_findings(rows: DataFrame, rules: list[SymbolRule] = SYMBOL_RULES) -> DataFrame:
    """rule_id, severity, cwe, path, line, column, name, description, confidence: each rule that holds for a symbol that is vulnerable at all, by what the rules
    are meant to find: their languages count. One pass over the symbols."""

    def hit(rule: SymbolRule) -> Column:
        own = F.lit("*" in rule.languages) | F.col("language").isin(*rule.languages)
        holds = own & F.col("kind").isin(*rule.kinds) & F.lower("name").rlike("|".join(map(re.escape, rule.names)))
        for flag in rule.flags:
            holds = holds & F.col(flag)
        return F.when(holds, F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.severity).alias("severity"), F.lit(rule.cwe).alias("cwe"), F.lit(rule.description).alias("text")))

    every = vulnerable(rows).withColumn("rule", F.explode(F.array_compact(F.array(*map(hit, rules)))))
    text = F.format_string("%s detected in symbol '%s' (%s)", "rule.text", "name", "name_path")
    return every.select("rule.rule_id", "rule.severity", "rule.cwe", "path", (F.col("start_line") + 1).alias("line"), (F.col("start_char") + 1).alias("column"), "name", text.alias("description"), confidence().alias("confidence"))


def outline(rows: DataFrame) -> DataFrame:
    """path, outline: a file's scopes in order, each two blanks deeper than its parent."""
    text = F.concat(F.when(F.col("parent_id").isNull(), "").otherwise("  "), F.format_string("%s (%d)", "name", "kind"))
    entries = F.sort_array(F.collect_list(F.struct("ordinal", text.alias("text"))))
    return rows.groupBy("path").agg(F.array_join(F.transform(entries, lambda e: e["text"]), "\n").alias("outline"))
