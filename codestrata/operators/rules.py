"""The rule catalogue as data, and which of its rules take part."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ["low", "medium", "high", "critical"]


def parse_severity(name: str) -> int:
    """Unknown names are medium."""
    return SEVERITIES.index(name.lower()) if name.lower() in SEVERITIES else 1


def severity_name(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), level + 1)


@dataclass(frozen=True)
class Rule:
    rule_id: str
    type: str
    name: str
    description: str
    severity: int
    languages: tuple[str, ...]
    cwe: str
    owasp: str
    category: str
    remediation: str
    patterns: tuple[str, ...] = field(default=())
    literals: tuple[str, ...] = field(default=())


# The rules' texts and patterns.
RULES = [
    Rule(
        "OWASP-A03-001", "sql_injection", "SQL Injection Vulnerability",
        "Direct concatenation of user input into SQL queries without proper escaping or parameterization",
        3, ("php", "java", "csharp", "python", "javascript", "go"), "CWE-89", "A03:2021", "Injection",
        "Use parameterized queries or prepared statements. Validate and sanitize all user inputs.",
        (
            r"(?i)(select|insert|update|delete|drop|create|alter|exec|execute)\s+.*\$_(GET|POST|REQUEST|COOKIE|SESSION)",
            r"(?i)(mysql_query|mysqli_query|pg_query)\s*\(\s*[^$]*\$_(GET|POST|REQUEST)",
            r"""(?i)query\s*\(\s*["'][^"']*["']\s*\+\s*.*\$_(GET|POST|REQUEST)""",
        ),
    ),
    Rule(
        "OWASP-A03-002", "xss", "Cross-Site Scripting Vulnerability", "User input displayed without proper encoding or validation",
        2, ("php", "javascript", "html", "java", "csharp", "python"), "CWE-79", "A03:2021", "Injection",
        "Always encode output data. Use HTML entity encoding for HTML context, JavaScript encoding for JS context.",
        (r"(?i)echo\s+\$_(GET|POST|REQUEST|COOKIE|SESSION)", r"(?i)innerHTML\s*=\s*.*\$_(GET|POST|REQUEST)", r"(?i)document\.write\s*\(\s*.*\$_(GET|POST|REQUEST)"),
    ),
    Rule(
        "OWASP-A01-001", "path_traversal", "Path Traversal Vulnerability", "User input used in file paths without proper validation",
        2, ("php", "java", "python", "javascript", "go", "csharp"), "CWE-22", "A01:2021", "Broken Access Control",
        "Validate file paths against a whitelist. Use absolute paths and avoid user input in file operations.",
        (r"(?i)(file_get_contents|fopen|include|require)\s*\(\s*.*\$_(GET|POST|REQUEST)", r"(?i)\.\.\/|\.\.\\"),
    ),
    Rule(
        "OWASP-A03-003", "command_injection", "Command Injection Vulnerability", "User input used in system commands without proper validation",
        3, ("php", "python", "java", "javascript", "go", "ruby"), "CWE-78", "A03:2021", "Injection",
        "Never use user input in system commands. Use parameterized APIs or validate input against strict whitelists.",
        (r"(?i)(system|exec|shell_exec|passthru|popen)\s*\(\s*.*\$_(GET|POST|REQUEST)", r"(?i)os\.(system|popen|exec)\s*\(\s*.*request\."),
    ),
    Rule(
        "OWASP-A02-001", "hardcoded_secrets", "Hardcoded Secrets", "Hardcoded passwords, API keys, or other sensitive data",
        2, ("*",), "CWE-798", "A02:2021", "Cryptographic Failures",
        "Use environment variables or secure configuration management for secrets.",
        (
            r"""(?i)(password|passwd|pwd)\s*=\s*["'][^"']{8,}["']""",
            r"""(?i)(api[_-]?key|apikey|secret[_-]?key)\s*=\s*["'][^"']{16,}["']""",
            r"""(?i)(private[_-]?key|secret)\s*=\s*["']-----BEGIN""",
        ),
    ),
]
RULES_BY_TYPE = {r.type: r for r in RULES}


def chosen(enabled: list[str] | None = None, disabled: list[str] = (), rules: list[Rule] = RULES) -> list[Rule]:
    """Enabled and known types, minus disabled ones; unknown names are ignored."""
    return [r for r in rules if (enabled is None or r.type in enabled) and r.type not in disabled]
