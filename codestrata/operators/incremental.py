"""Incremental analysis: what changed, what the cache still answers, what to evict, and index upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import graphs

MAX_AGE_HOURS, MAX_BYTES, VERSION = 168, 1 << 30, "1"


def _micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def change_plan(files: DataFrame, index: DataFrame, force: bool = False) -> DataFrame:
    """files(path, sha256, mtime) against index(path, sha256, mtime) -> path, action: new, changed, up_to_date or deleted."""
    now, old = files.select("path", "sha256", "mtime", F.lit(True).alias("here")), index.select("path", F.col("sha256").alias("old_sha256"), F.col("mtime").alias("old_mtime"), F.lit(True).alias("known"))
    same = F.col("sha256").eqNullSafe(F.col("old_sha256")) & F.col("mtime").eqNullSafe(F.col("old_mtime"))
    action = F.when(F.col("here").isNull(), "deleted").when(F.col("known").isNull(), "new").when(F.lit(force) | ~same, "changed").otherwise("up_to_date")
    return now.join(old, "path", "full_outer").select("path", action.alias("action"))


def to_process(plan: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """path, reason: new and changed files, and those that depend on changed or deleted ones; each once."""
    changed = plan.filter(F.col("action") != "up_to_date")
    own = plan.filter(F.col("action").isin("new", "changed")).select("path", F.col("action").alias("reason"))
    near = graphs.affected(edges, changed, depth).filter("distance > 0").select("path", F.lit("affected").alias("reason"))
    return own.unionByName(near.join(plan.filter("action = 'up_to_date'").select("path"), "path", "left_semi"))


def valid(entry: Column, file: Column, now: Column, version: str = VERSION, max_age_hours: int = MAX_AGE_HOURS) -> Column:
    """Whether a cached entry still answers for a file: version, hash, time, size and age."""
    fresh = _micros(now) - _micros(entry["created_at"]) <= max_age_hours * 3_600_000_000
    return F.coalesce((entry["version"] == version) & (entry["file_hash"] == file["sha256"]) & (entry["mod_time"] == file["mtime"]) & (entry["file_size"] == file["n_bytes"]) & fresh, F.lit(False))


def evict(entries: DataFrame, now: Column, max_age_hours: int = MAX_AGE_HOURS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path, keep: expired entries go, then the oldest until the rest fits the budget.

    Sizes are summed by hour first and then within an hour, so that no task sees every entry.
    """
    hour = F.floor(_micros(F.col("created_at")) / 3_600_000_000)
    live = entries.withColumn("hour", hour).withColumn("expired", _micros(now) - _micros(F.col("created_at")) > max_age_hours * 3_600_000_000)
    sizes = live.filter("NOT expired").groupBy("hour").agg(F.sum("cache_size").alias("n"))
    # One row for each hour of the greatest age kept: max_age_hours + 1 at most.
    newer = sizes.select("hour", F.coalesce(F.sum("n").over(W.orderBy(F.desc("hour")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("newer"))
    within = F.sum("cache_size").over(W.partitionBy("hour", "expired").orderBy(F.desc("created_at"), F.desc("path")).rowsBetween(W.unboundedPreceding, 0))
    placed = live.withColumn("within", within).join(F.broadcast(newer), "hour", "left")
    return placed.select("path", (~F.col("expired") & (F.col("newer") + F.col("within") <= max_bytes)).alias("keep"))


def upsert(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index with rows put in by path: a known path keeps its created_at and takes the rest."""
    old = index.select("path", F.struct("sha256", "mtime", "created_at").alias("o"))
    new = rows.select("path", F.struct("sha256", "mtime", "created_at").alias("n"))
    pick = lambda c: F.coalesce(F.col("n")[c], F.col("o")[c]).alias(c)
    return old.join(new, "path", "full_outer").select("path", pick("sha256"), pick("mtime"), F.coalesce(F.col("o.created_at"), F.col("n.created_at")).alias("created_at"), F.col("n").isNotNull().alias("touched"))


def replace_by_path(table: DataFrame, rows: DataFrame, processed: DataFrame) -> DataFrame:
    """A result table after re-analysis: all rows of processed paths are replaced."""
    return table.join(processed.select("path").distinct(), "path", "left_anti").unionByName(rows)


def append_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or ignore: rows whose keys the table does not have, each key once."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))
