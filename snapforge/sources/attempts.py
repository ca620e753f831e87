"""Attempts of shards in a store that keeps one folder for each try, and what may go of them.

folder/db=00003/attempt=01/   the second try at shard 3

Spark's own committer leaves no tries behind; this is for stores whose shards are written by other means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snapforge.operators.lifecycle import losers
from snapforge.sources.manifest import Files

SCHEMA = "db_id int, attempt int, db_url string"


def _number(name: str, start: str) -> int | None:
    digits = name.removeprefix(start)
    return int(digits) if name.startswith(start) and digits.isdigit() else None


def attempts_in(spark: SparkSession, folder: str) -> DataFrame:
    """(db_id, attempt, db_url) of the tries in a folder; names of another form are left alone."""
    files, found = Files(spark, folder), []
    for shard in files.names(""):
        if (db := _number(shard, "db=")) is not None:
            tries = [(t, _number(t, "attempt=")) for t in files.names(shard)]
            found += [(db, n, f"{files.root}/{shard}/{t}") for t, n in tries if n is not None]
    return spark.createDataFrame(found, SCHEMA)


def clean_attempts(spark: SparkSession, folder: str, winners: DataFrame, dry_run: bool = True) -> list[str]:
    """Delete the tries in a folder that no winner (db_url) names. Returns those that are (or would be) deleted, sorted.

    At best effort: a try that can't be deleted stays, and the next cleaning finds it.
    """
    files = Files(spark, folder)
    urls = sorted(r["db_url"] for r in losers(attempts_in(spark, folder), winners).toLocalIterator())
    return urls if dry_run else [u for u in urls if files.try_delete(u.removeprefix(f"{files.root}/"))]
