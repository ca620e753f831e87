"""Attempts, runs and what may be deleted of them. All are joins and aggregations over their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapforge.errors import ShardCoverageError

LAST = (1 << 63) - 1


def _order() -> Column:
    return F.struct(F.col("attempt"), F.coalesce(F.col("task_attempt_id"), F.lit(LAST)), F.col("db_url"))


def select_winners(attempts: DataFrame) -> DataFrame:
    """One attempt per db_id: the least attempt, then task, then url. Combined before the shuffle."""
    best = F.min_by(F.struct(*[c for c in attempts.columns if c != "db_id"]), _order()).alias("_w")
    return attempts.groupBy("db_id").agg(best).select("db_id", *[F.col(f"_w.{c}").alias(c) for c in attempts.columns if c != "db_id"])


def check_coverage(attempts: DataFrame, num_shards: int) -> None:
    """Shards without attempts are empty; attempts for shards that don't exist are an error."""
    extra = [r[0] for r in attempts.where((F.col("db_id") < 0) | (F.col("db_id") >= num_shards)).select("db_id").distinct().limit(10).collect()]
    if extra:
        raise ShardCoverageError(f"attempts for shards beyond {num_shards}: {sorted(extra)}")


def losers(attempts: DataFrame, winners: DataFrame) -> DataFrame:
    """The attempts whose url no winner has."""
    return attempts.join(winners.select("db_url").distinct(), "db_url", "left_anti")


def build_stats(attempts: DataFrame, winners: DataFrame) -> DataFrame:
    """rows_written, num_attempts and num_winners, one row."""
    tagged = attempts.select(F.lit(0).cast("long").alias("r"), F.lit(1).alias("a"), F.lit(0).alias("w")).unionAll(winners.select(F.col("row_count").cast("long"), F.lit(0), F.lit(1)))
    return tagged.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("r", "rows_written"), ("a", "num_attempts"), ("w", "num_winners"))])


def history(runs: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """The newest runs by published_at, then run_id: a top-k, not a sort of all."""
    return runs.orderBy(F.desc("published_at"), F.desc("run_id")).offset(offset).limit(limit)


def protected_runs(runs: DataFrame, current: str, older_than: Column | None = None, keep_last: int | None = None) -> DataFrame:
    """The run_ids that a cleanup spares: those that every criterion spares, and the current one.

    older_than spares what was published at that time or later; keep_last spares the newest so many;
    without either all known runs are spared.
    """
    spared = runs.select("run_id").distinct()
    if older_than is not None:
        spared = spared.intersect(runs.where(F.col("published_at") >= older_than).select("run_id"))
    if keep_last is not None:
        spared = spared.intersect(history(runs, keep_last).select("run_id"))
    return spared.union(runs.where(F.col("run_id") == current).select("run_id")).distinct()


def stale_runs(present: DataFrame, protected: DataFrame) -> DataFrame:
    return present.join(protected, "run_id", "left_anti")


def nth_newest(runs: DataFrame, n: int) -> DataFrame:
    """The run that a rollback by n goes to; 0 is the newest."""
    return history(runs, 1, n)


def ranked(runs: DataFrame) -> DataFrame:
    """runs with their place in the history, newest 0. One row per run, so one task."""
    return runs.withColumn("place", (F.row_number().over(Window.orderBy(F.desc("published_at"), F.desc("run_id"))) - 1).cast("long"))
