"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source size`` copies. Documents of a source stand in
one order, by size and id; expected copies are summed along it, one offset is added, and a document
is emitted once for each integer that its stretch of the sum crosses. Ordered by size, the words
taken differ from the target by less than twice the source's largest document.

The order is a range partition of the whole table, so that a hot source spreads over as many tasks
as its rows need; ranks come from each partition's first row and a prefix sum over partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, col, written

#: Expected copies are whole numbers of this part, so that sums are exact.
SCALE_BITS = 24
#: Rows of (partition, source) that may be broadcast, some 50 MB.
BROADCAST_ROWS = 400_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """source, source_size -> with its target: the fixed point of sharing all words by weight, stopping at
    ``cap`` times a source's size and sharing the excess again. One row per source goes in and out."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_level = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    levels = (
        totals.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * cap)
        .withColumn("words", F.sum("source_size").over(everything))
        .withColumn("left", F.col("words") - F.coalesce(F.sum("most").over(before), F.lit(0)))
        .withColumn("sharing", F.sum("weight").over(after))
        .withColumn("full", F.col("left") * F.col("weight") >= F.col("most") * F.col("sharing"))
        .withColumn("left", F.col("words") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everything), F.lit(0)))
        .withColumn("sharing", F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything))
    )
    share = (F.col("left") * F.col("weight")).cast("double") / F.col("sharing").cast("double")
    return levels.select("source", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(share).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: id, size, source_size, target, copies, taken, and struct ``carried``.

    Size is the number of words, 0 for null text. Sources are ordered by code point with null last
    and take the weights in turn. A null source is a source. A document of size 0 may be
    emitted, which takes no words. Repeated rows are documents of their own. An empty table gives an
    empty result. Other columns are ignored unless carried, inside ``carried``.
    """
    carried = F.struct(*[col(c).alias(c) for c in carry]) if carry else F.struct(F.lit(True).alias("none"))
    sized = written(docs.select(col(id_col).alias("id"), col(source_col).alias("source"), word_count(col(text_col)).alias("size"), carried.alias("carried"), F.monotonically_increasing_id().alias("row")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    part = F.lit(1 << SCALE_BITS)
    targets = written(
        source_targets(totals, weights, cap)
        .withColumn("step", F.when(F.col("source_size") > 0, F.floor(F.col("target") * part.cast("double") / F.col("source_size") + 0.5)).otherwise(part).cast("long"))
        .withColumn("offset", F.conv(F.substring(F.md5(F.concat(F.coalesce("source", F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, SCALE_BITS // 4), 16, 10).cast("long"))
    )

    # What is ordered is narrow: texts stay where they are until each row's copies are known.
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("id"), F.col("row")]
    narrow = sized.select("source", "size", "id", "row").repartitionByRange(*order).sortWithinPartitions(*order)
    # monotonically_increasing_id holds the partition above bit 33 and the place within it below.
    laid = written(narrow.select("source", "row", F.monotonically_increasing_id().alias("place"))).withColumn("part", F.shiftright("place", 33))
    firsts = laid.groupBy("part", "source").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = firsts.select("part", F.col("source").alias("s"), "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    firsts = written(firsts.join(targets.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t"))).drop("t").withColumnRenamed("part", "p"))

    # One row per partition and source in it: the ranges cut the ordered table, so these are at most
    # partitions + sources rows. Only a corpus of very many sources has too many to send to every task.
    ranked = laid.join(_small(firsts), (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    rank = F.col("earlier") + F.col("place") - F.col("first")
    crossed = F.shiftright((rank + 1) * F.col("step") + F.col("offset"), SCALE_BITS) - F.shiftright(rank * F.col("step") + F.col("offset"), SCALE_BITS)
    copies = written(ranked.select("row", crossed.alias("copies")))
    every = sized.join(_small(copies), "row").join(_small(targets.select(F.col("source").alias("t"), "source_size", "target")), F.col("source").eqNullSafe(F.col("t")))
    return every.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "carried")


def _small(rows: DataFrame) -> DataFrame:
    """A written table, to be broadcast where it is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document as often as it was emitted."""
    names = docs.columns
    emitted = mix_sources(docs, carry=names, **options).filter("copies > 0")
    return emitted.select("carried", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select(*[F.col("carried")[c].alias(c) for c in names])
