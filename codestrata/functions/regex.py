"""Regular expressions that mean the same in linear-time engines and in Java, and where they match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def portable(pattern: str) -> str:
    """UNIX lines only; white space without the vertical tab; letters fold as Unicode ones where case is ignored."""
    flags = "d"
    if pattern.startswith("(?"):
        own, pattern = pattern[2:].split(")", 1)
        flags += own + ("u" if "i" in own else "")
    out, in_class, at = [], False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            pair = pattern[at : at + 2]
            out.append((r"\t\n\f\r " if in_class else r"[\t\n\f\r ]") if pair == r"\s" else pair)
            at += 2
            continue
        in_class = c == "[" or in_class and c != "]"
        out.append(c)
        at += 1
    return f"(?{flags})" + "".join(out)


def match_offsets(text: Column, pattern: str) -> Column:
    """array<struct<start, end>> of all matches, in bytes from 0, left to right; the pattern never matches the
    empty string. What lies before a match is the text split at the matches, and the matches before it."""
    java = F.lit(pattern)
    matches, between = F.regexp_extract_all(text, java, F.lit(0)), F.split(text, pattern, -1)

    def bytes_of(strings: Column) -> Column:
        return F.aggregate(strings, F.lit(0), lambda n, s: n + F.octet_length(s))

    def place(match: Column, i: Column) -> Column:
        start = bytes_of(F.slice(between, F.lit(1), i + 1)) + bytes_of(F.slice(matches, F.lit(1), i))
        return F.struct(start.alias("start"), (start + F.octet_length(match)).alias("end"))

    return F.when(text.rlike(pattern), F.transform(matches, place)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def match_spans(text: Column, pattern: str, group: int = 1) -> Column:
    """array<struct<start, end, value>>: all matches in bytes from 0, and a group's text. One pass along the text."""
    java = F.lit(pattern)
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, java, F.lit(0)).alias("match"), F.regexp_extract_all(text, java, F.lit(group)).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.octet_length(x["between"])
        end = at + F.coalesce(F.octet_length(x["match"]), F.lit(0))
        own = F.struct(at.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["match"].isNotNull(), F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])
