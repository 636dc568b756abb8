"""Exact duplicates by distributed MSD radix partitioning.

Texts are split by successive runs of bytes, most significant first. The first digit is the
text's length with its first bytes; each later digit is the next, sixteen times longer run. A
group of one row leaves at once; a group whose digits have reached the end of its texts is a
class of equal texts. No digest takes part in the comparison.

Each round is one aggregation by (group, digit), pre-aggregated before its shuffle, and one join
that carries the verdict back to the rows. A hot class is a hot key on the row side of that join
only, where adaptive execution splits it: verdicts are written first, as it does not split a join
whose other side is an aggregation in the same plan. Rows that have left the recursion carry no text, so each
round moves less.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, col, written

FIRST_DIGIT = 64
#: First digits shared by several rows that may be broadcast, some 40 MB.
BROADCAST_ROWS = 200_000
GROWTH = 16


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[Column | str] = ()) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, and struct ``carried`` with what was asked for.

    Texts are equal if identical after lower-casing A-Z. The row with the largest id stays.
    Null text counts as empty, and empty texts are copies of each other. A null id ranks below every
    other. Where several rows share the largest id and the text (repeated rows), exactly one of
    them stays. An empty table gives an empty result. Other columns of ``docs`` are ignored unless
    carried; they come back inside ``carried``, so their names cannot clash.
    """
    carried = F.struct(*[col(c).alias(c) if isinstance(c, str) else c for c in carry]) if carry else F.struct(F.lit(True).alias("none"))
    whole = any(isinstance(c, str) and c == text_col for c in carry)  # then the text goes along once, among what is carried
    body = F.lit(b"") if whole else ascii_lower(F.coalesce(col(text_col), F.lit(""))).cast("binary")
    head = F.substring(ascii_lower(F.substring(F.coalesce(col(text_col), F.lit("")), 1, FIRST_DIGIT)).cast("binary"), 1, FIRST_DIGIT)
    length = F.octet_length(F.coalesce(col(text_col), F.lit("")))

    rows = docs.select(col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), carried.alias("carried"), length.alias("length"), head.alias("digit"), body.alias("body"))
    groups = written(rows.groupBy("length", "digit").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("grp")).filter("n > 1").select("length", "digit", "grp"))
    if groups.count() <= BROADCAST_ROWS:  # else all rows are dealt by their digit, texts included
        groups = F.broadcast(groups)
    split = written(rows.join(groups, ["length", "digit"], "left").select("id", "row", "carried", "length", "grp", F.when(F.col("grp").isNotNull(), F.col("body")).alias("body")))

    results = [split.filter("grp IS NULL").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "carried")]
    live, done, width = split.filter("grp IS NOT NULL"), 0, FIRST_DIGIT
    while not live.isEmpty():
        text = ascii_lower(F.coalesce(F.col("carried")[text_col], F.lit(""))).cast("binary") if whole else F.col("body")
        digits = live.withColumn("digit", F.substring(text, done + 1, width))
        verdicts = written(digits.groupBy("grp", "digit").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"), F.max(F.struct("id", "row")).alias("last")))
        ended = (F.col("n") == 1) | (F.col("length") <= done + width)
        split = written(
            digits.join(verdicts, ["grp", "digit"]).select(
                "id", "row", "carried", "length", "n", "last", F.col("first").alias("grp"), ended.alias("ended"), F.when(~ended, F.col("body")).alias("body")
            )
        )
        results.append(split.filter("ended").select("id", F.col("last.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("last.row")).alias("kept"), "carried"))
        live = split.filter("NOT ended").drop("n", "last", "ended")
        done, width = done + width, width * GROWTH
    result = results[0]
    for more in results[1:]:
        result = result.unionByName(more)
    return result.withColumnRenamed("id", id_col)
