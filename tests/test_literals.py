"""Literals that patterns cannot do without: no line that a pattern matches may be left out."""

import random

import pytest
from pyspark.sql import functions as F

from codestrata.functions.literals import folded, holds, required
from codestrata.functions.regex import portable
from codestrata.operators import match
from codestrata.operators.rules import RULES, Rule

PATTERNS = [p for r in RULES for p in r.patterns] + [r"(?i)ki(s|x)s", "é+a", "(?i)É", r"(ab)?c", "a|b*", r"\bfoo\b.*(bar|baz)", r"x{2,}y", "(?i)[s-u]k"]


@pytest.mark.parametrize(
    "pattern, strings",
    [
        (r"(?i)(api[_-]?key|pwd)\s*=", {"api_key", "api-key", "apikey", "pwd"}),
        (r"a(b|c)+d", {"a", "d"}),
        ("(ab)?c", {"abc", "c"}),
        ("a|b*", None),
        (r"\pL+x", None),
        (r"[a&&b]c", None),
        ("(?i)é", None),
        ("é", {"é"}),
        ("(", None),
    ],
)
def test_required(pattern, strings):
    found = required(pattern)
    assert found is None if strings is None else found and found <= strings


def test_no_match_is_left_out(spark):
    rng = random.Random(5)
    parts = ["select ", "ſelect ", "SELECT\t", "* ", "$_GET", "$_REQUEſT", "$_Get", "../", "..\\", "os.", "ſystem(", "pass", "WORD", "='", '="', "12345678", "\"'", "aPI-", "Key", "K", "ı", "İ", "ki", "s", "x", "é", "É", "a", "ab", "c", "foo ", " bar", "xxy", "Σ", "request.", "-----begin", "secret", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(3000)]
    low = folded(F.col("t"))
    missed = [F.sum((F.col("t").rlike(portable(p)) & ~holds(low, required(p))).cast("int")).alias(f"m{k}") for k, p in enumerate(PATTERNS)]
    matched = [F.sum(F.col("t").rlike(portable(p)).cast("int")).alias(f"n{k}") for k, p in enumerate(PATTERNS)]
    row = spark.createDataFrame([(t,) for t in texts], "t string").agg(*missed, *matched).first().asDict()
    assert not any(v for k, v in row.items() if k[0] == "m") and sum(v > 0 for k, v in row.items() if k[0] == "n") > 10


def test_findings_by_brute_force(spark):
    """Many lines, several matches in a line, literals, rules without a known literal, many literals, null and empty content."""
    many = Rule("M", "many", "", "", 1, ("*",), "", "", "", "", patterns=(r"(?i)[k-m]+\d", "z|y*q"), literals=tuple(f"w{n}w" for n in range(40)))
    none = Rule("N", "none", "", "", 1, ("go",), "", "", "", "", patterns=("q",))
    lines = ["éL1 Kk2 w3w w3w", "", "zz q", "w12w", "nothing", "ü w0w\tl9"]
    rows = [("a.php", "php", "\n".join(lines * 3)), ("b", None, None), ("c", None, ""), ("d", "go", "q")]
    found = match.findings(spark.createDataFrame(rows, "path string, language string, content string"), [many, none]).collect()
    got = sorted((r["rule_id"], r["file"], r["line"], r["column"], r["pattern"]) for r in found)
    want = []
    for path, language, content in rows:
        for n, text in enumerate((content or "").split("\n"), 1):
            starts = {"éL1 Kk2 w3w w3w": [(0, 2), (0, 5)], "zz q": [(1, 0), (1, 1), (1, 3)], "ü w0w\tl9": [(0, 7)], "q": [(1, 0)]}.get(text, [])
            want += [("M", path, n, at + 1, k) for k, at in starts]
            want += [("M", path, n, len(text[: text.index(w)].encode()) + 1, k + 2) for k, w in enumerate(many.literals) if w in text]
            want += [("N", path, n, 1, 0)] if language == "go" and "q" in text else []
    assert got == sorted(want)
    context = {r["line"]: r["context"] for r in found if r["file"] == "a.php"}
    assert context[1] == [">>    1: " + lines[0], "      2: ", "      3: zz q"] and len(context[7]) == 5
