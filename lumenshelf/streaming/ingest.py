"""Incremental ingest (N1): new file listings and hashes go through scan diff and index merge, batch by batch.

The library is stored in versions: ``<store>/media/version=0`` and
``<store>/media_deleted/version=0`` are its base, and each batch adds a version with the
rows that it changed or added. A medium is the row of its largest version (``current``),
so a batch writes as much as it changes, not the library.

``compact`` writes a snapshot of a version, ``<store>/snapshots/version=K``, and then the
empty file set ``<store>/ready/version=K`` that makes it count: readers start from the
last snapshot up to the version they want, so a stream goes on with its old checkpoint,
and a batch that is run again reads the version that it read before, with or without the
snapshot. ``prune`` deletes what no later batch needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import index_changes, scan_diff
from ..plans.lineage import children, exists, remove

FILES = "path string, hash string"


def current(spark: SparkSession, store: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(media, tombstones) as of a version, by default the last.

    Versions after the last snapshot are few rows beside it, which is read as it is but
    for the media that have changed.
    """
    first = max([k for k in snapshots(spark, store) if version is None or k <= version], default=0)
    names = ("media", "media_deleted")
    if first:
        base, dead = (spark.read.parquet(f"{store}/snapshots/version={first}/{name}") for name in names)
    else:
        base, dead = (spark.read.parquet(f"{store}/{name}/version=0") for name in names)
    later = lambda name: [k for k in versions(spark, store, name) if k > first and (version is None or k <= version)]
    read = lambda name: spark.read.option("basePath", f"{store}/{name}").parquet(*[f"{store}/{name}/version={k}" for k in later(name)])
    if later("media_deleted"):
        dead = dead.select("hash", "path").unionByName(read("media_deleted").select("hash", "path"))
    dead = dead.select("hash", "path").distinct()
    if not later("media"):
        return base, dead
    row = F.struct(*[F.col(c) for c in base.columns])
    last = read("media").groupBy("hash").agg(F.max_by(row, "version").alias("row")).select("row.*")
    return base.join(last.select("hash"), "hash", "left_anti").select(base.columns).unionByName(last), dead


def versions(spark: SparkSession, store: str, name: str = "media") -> list[int]:
    """Versions that were written to their end."""
    numbers = sorted(int(x.removeprefix("version=")) for x in children(spark, f"{store}/{name}") if x.startswith("version="))
    return [k for k in numbers if exists(spark, f"{store}/{name}/version={k}/_SUCCESS")]


def snapshots(spark: SparkSession, store: str) -> list[int]:
    return versions(spark, store, "ready")


def start(spark: SparkSession, incoming: str, store: str, checkpoint: str, now: int) -> StreamingQuery:
    """Takes all files that have come to ``incoming`` (JSON lines of path and hash) and stops.

    A batch reads the versions up to its own number and writes the next one, so a batch
    that is run again gives the same result.
    """

    def merge(batch: DataFrame, number: int) -> None:
        media, deleted = current(spark, store, number)
        new = scan_diff(batch, media, deleted).filter("state = 'new'")
        files = batch.join(new.select("path"), "path", "left_semi").select("hash", "path")
        changed, dead = index_changes(media, deleted, files, now)
        changed.write.mode("overwrite").parquet(f"{store}/media/version={number + 1}")
        dead.write.mode("overwrite").parquet(f"{store}/media_deleted/version={number + 1}")

    stream = spark.readStream.schema(FILES).json(incoming)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, store: str) -> int:
    """Makes the last version a snapshot, beside a running stream too; returns its number.

    A version that a batch is just writing isn't in it and counts on top of it.
    """
    # a batch writes its tombstones last
    last = max(versions(spark, store, "media_deleted"))
    if last and last not in snapshots(spark, store):
        media, deleted = current(spark, store, last)
        media.write.mode("overwrite").parquet(f"{store}/snapshots/version={last}/media")
        deleted.write.mode("overwrite").parquet(f"{store}/snapshots/version={last}/media_deleted")
        spark.range(0).write.mode("overwrite").parquet(f"{store}/ready/version={last}")
    return last


def prune(spark: SparkSession, store: str, version: int) -> None:
    """Deletes what only versions before ``version`` need: the caller's stream has committed its batches up to there."""
    kept = max([k for k in snapshots(spark, store) if k <= version], default=0)
    for name in ("media", "media_deleted"):
        for k in versions(spark, store, name):
            if k <= kept and kept:
                remove(spark, f"{store}/{name}/version={k}")
    for k in snapshots(spark, store):
        if k < kept:
            remove(spark, f"{store}/ready/version={k}")
            remove(spark, f"{store}/snapshots/version={k}")
