"""Scans, indexing and maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dir_name, media_type
from ..plans.sizes import narrow
from .substrings import containing

#: Renames are broadcast up to this many.
BROADCAST_RENAMES = 500_000


def created_at(modified: Column) -> Column:
    """Epoch seconds of a file time."""
    return F.round(F.unix_micros(modified.cast("timestamp")) / 1_000_000).cast("long")


def metadata(probe: DataFrame) -> DataFrame:
    """From probe rows (hash, tags map, sidecar struct(artist, album, title), duration, width, coded_width, height, coded_height).

    Tags win over the sidecar in this order of names; empty texts count as unset.
    """
    tag = lambda *names: [F.nullif(F.col("tags")[n], F.lit("")) for n in names]
    side = lambda n: F.nullif(F.col("sidecar")[n], F.lit(""))
    return probe.select(
        "hash",
        F.coalesce(*tag("artist", "album_artist", "ARTIST"), side("artist")).alias("artist"),
        F.coalesce(*tag("album", "ALBUM"), side("album")).alias("album"),
        F.coalesce(*tag("title", "TITLE"), side("title")).alias("title"),
        F.ceil("duration").cast("int").alias("length"),
        F.coalesce(F.nullif("width", F.lit(0)), "coded_width").alias("width"),
        F.coalesce(F.nullif("height", F.lit(0)), "coded_height").alias("height"),
    )


def scan_diff(listing: DataFrame, media: DataFrame, deleted: DataFrame) -> DataFrame:
    """(path, state): new files of a known type that are neither known nor tombstoned, and missing ones."""
    files = listing.select("path").filter(media_type(F.col("path")).isNotNull()).distinct()
    known = media.select("path").filter("path is not null").distinct()
    new = files.join(known, "path", "left_anti").join(deleted.select("path"), "path", "left_anti")
    return new.withColumn("state", F.lit("new")).unionByName(known.join(files, "path", "left_anti").withColumn("state", F.lit("missing")))


def scan_summary(diff: DataFrame) -> DataFrame:
    """B6."""
    return diff.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def _fresh(media: DataFrame, deleted: DataFrame, one: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Of files (hash, _path) with unknown hashes: (new media, tombstones)."""
    fresh = one.join(media.select("hash"), "hash", "left_anti")
    dead = fresh.join(deleted.select("hash"), "hash", "left_semi").select("hash", F.col("_path").alias("path"))
    born = fresh.join(deleted.select("hash"), "hash", "left_anti").withColumnRenamed("_path", "path")
    given = {
        "hash": F.col("hash"), "path": F.col("path"), "dir": dir_name(F.col("path")), "type": media_type(F.col("path")),
        "hash_date": F.lit(now).cast("long"), "rotation": F.lit(0), "corrupted": F.lit(False),
    }
    return born.select(*[given.get(c, F.lit(None)).cast(media.schema[c].dataType).alias(c) for c in media.columns]), dead


def index_files(media: DataFrame, deleted: DataFrame, files: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """New files (hash, path) into (media, tombstones).

    A known hash takes the new path only, a tombstoned one adds a tombstone, others
    become media. Of several paths with one hash the largest counts.
    """
    one = files.groupBy("hash").agg(F.max("path").alias("_path"))
    updated = media.join(one, "hash", "left").withColumn("path", F.coalesce("_path", "path")).select(media.columns)
    born, dead = _fresh(media, deleted, one, now)
    return updated.unionByName(born), deleted.select("hash", "path").unionByName(dead).distinct()


def index_changes(media: DataFrame, deleted: DataFrame, files: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """B7's changes alone: media that are new or have a new path, and new tombstones."""
    one = files.groupBy("hash").agg(F.max("path").alias("_path"))
    moved = media.join(one, "hash").filter(~F.col("path").eqNullSafe(F.col("_path"))).withColumn("path", F.col("_path")).select(media.columns)
    born, dead = _fresh(media, deleted, one, now)
    return moved.unionByName(born), dead.distinct()


def match_missing(media: DataFrame, missing: DataFrame) -> DataFrame:
    """Per missing path the media whose path contains it, ignoring case: (path, n, hash); delete where n is 1."""
    m = missing.select(F.col("path").alias("_path"), F.lower("path").alias("part")).distinct()
    got = containing(media.select(F.col("hash").alias("key"), F.lower("path").alias("text")), m.filter("part is not null").select("part").distinct())
    return m.join(got, "part", "left").select(
        F.col("_path").alias("path"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        F.when(F.col("n") == 1, F.col("key")).alias("hash"),
    )


def remove_media(tables: dict[str, DataFrame], gone: DataFrame, tombstone: bool = True) -> dict[str, DataFrame]:
    """Without the media ``gone`` (hash), in all tables; playlists close their gaps."""
    from .playlists import densify

    g = gone.select("hash").distinct()
    by_media = g.withColumnRenamed("hash", "media_hash")
    out = dict(tables)
    if tombstone:
        out["media_deleted"] = tables["media_deleted"].select("hash", "path").unionByName(tables["media"].join(g, "hash", "left_semi").select("hash", "path")).distinct()
    out["media"] = tables["media"].join(g, "hash", "left_anti")
    for name in ("media_tags", "media_actors"):
        out[name] = tables[name].join(by_media, "media_hash", "left_anti")
    out["media_playlists"] = densify(tables["media_playlists"].join(by_media, "media_hash", "left_anti"))
    return out


def rename_hashes(tables: dict[str, DataFrame], changes: DataFrame) -> dict[str, DataFrame]:
    """``changes`` (old, new) in media, what points at it, and all bridges, all at once. Of repeated old hashes the smallest new one counts; new hashes must not be in use."""
    c = narrow(changes.filter("old <> new").groupBy("old").agg(F.min("new").alias("new")), "renames", BROADCAST_RENAMES)

    def renamed(df: DataFrame, column: str) -> DataFrame:
        return df.join(c, F.col(column) == F.col("old"), "left").withColumn(column, F.coalesce("new", column)).select(df.columns)

    out = {name: renamed(df, "hash" if name in ("media", "media_deleted") else "media_hash") for name, df in tables.items()}
    if "duplicate_of" in out["media"].columns:
        out["media"] = renamed(out["media"], "duplicate_of")
    return out


def fill_created(media: DataFrame, times: DataFrame) -> DataFrame:
    """``times`` (path, created) where metadata exists and the time is unset or zero."""
    t = times.groupBy("path").agg(F.min("created").alias("_t"))
    unset = F.col("width").isNotNull() & (F.coalesce("created_at", F.lit(0)) == 0)
    return media.join(t, "path", "left").withColumn("created_at", F.when(unset, F.coalesce("_t", "created_at")).otherwise(F.col("created_at"))).select(
        media.columns,
    )


def fill_tags(media: DataFrame, probed: DataFrame) -> DataFrame:
    """Artist, album and title of uncorrupted videos where unset, from ``probed`` (hash, ...). Of repeated hashes the smallest values that are not empty count."""
    names = ("artist", "album", "title")
    p = probed.groupBy("hash").agg(*[F.min(F.nullif(n, F.lit(""))).alias(f"_{n}") for n in names])
    can = (F.col("type") == "video") & ~F.coalesce("corrupted", F.lit(False))
    out = media.join(p, "hash", "left")
    for n in names:
        out = out.withColumn(n, F.when(can, F.coalesce(F.nullif(n, F.lit("")), F.col(f"_{n}"))).otherwise(F.col(n)))
    return out.select(media.columns)


def verify_artifacts(media: DataFrame, artifacts: DataFrame, flag: str = "thumbnail") -> DataFrame:
    """The flag, and its _optimised one, go where it is set and ``artifacts`` (hash) has no file."""
    a = artifacts.select("hash", F.lit(True).alias("_there")).distinct()
    lost = F.col(flag) & F.col("_there").isNull()
    both = [c for c in (flag, f"{flag}_optimised") if c in media.columns]
    out = media.join(a, "hash", "left").withColumns({c: F.when(lost, F.lit(False)).otherwise(F.col(c)) for c in both})
    return out.select(media.columns)


def verify_cache(media: DataFrame, segments: DataFrame, files: DataFrame) -> DataFrame:
    """Keeps the stored qualities up to the first of which a segment file is missing.

    ``segments`` (hash, segment) are expected for every quality; ``files`` (hash, quality, segment) exist.
    """
    q = media.filter(F.size("quality_cache") > 0).select("hash", F.posexplode("quality_cache").alias("pos", "quality"))
    need = q.join(segments, "hash")
    bad = need.join(files.select("hash", "quality", "segment"), ["hash", "quality", "segment"], "left_anti").groupBy("hash").agg(
        F.min("pos").alias("_bad"),
    )
    kept = F.when(F.col("_bad").isNotNull(), F.slice("quality_cache", F.lit(1), F.col("_bad"))).otherwise(F.col("quality_cache"))
    return media.join(bad, "hash", "left").withColumn("quality_cache", kept).select(media.columns)


def reset_auto_tags(media: DataFrame) -> DataFrame:
    """B15."""
    return media.withColumn("auto_tags", F.lit(None).cast("array<string>"))


def uncorrupt(media: DataFrame) -> DataFrame:
    """B15."""
    return media.withColumn("corrupted", F.when(F.col("corrupted"), F.lit(False)).otherwise(F.col("corrupted")))


_VIDEO, _STILL, _OWN = {"equalsAll": ["video"]}, {"equalsAll": ["still"]}, {"exists": False}
#: Work queues as search constraints; fixed values.
QUEUES = {
    "thumbnails": {"thumbnail": False, "corrupted": False, "indexed": True},
    "previews": {"preview": False, "corrupted": False, "type": _VIDEO, "duplicateOf": _OWN},
    "cache": {"type": _VIDEO, "corrupted": False, "duplicateOf": _OWN},
    "keyframes": {"type": _VIDEO, "indexed": True, "duplicateOf": _OWN},
    "phash": {"type": _STILL, "indexed": True, "corrupted": False, "phashed": False, "thumbnail": True},
    "clones": {"type": _STILL, "phashed": True, "duplicateOf": _OWN},
    "classify": {"type": _STILL, "autoTags": _OWN, "thumbnail": True},
    "optimise_thumbnails": {"thumbnail": True, "corrupted": False, "thumbnailOptimised": False},
    "optimise_previews": {"preview": True, "corrupted": False, "previewOptimised": False, "type": _VIDEO, "sortBy": "length"},
    "rescan": {"corrupted": False, "type": _VIDEO},
}


def normalise_import(rows: DataFrame, root: str, version: int | None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason) of imported media.

    Dumps of version 3 or none had one quality for every medium, and copied videos.
    """
    indexed = F.col("width").isNotNull() | F.col("height").isNotNull()
    reason = F.when(F.coalesce("hash", F.lit("")) == "", "no hash").when(~indexed, "no metadata")
    if version is None or version == 3:
        reason = reason.when((F.col("type") != "video") & (F.coalesce("width", F.lit(0)) == 0), "no width")
    out = rows.withColumn("reason", reason)
    ok = out.filter("reason is null").drop("reason")
    prefix = root.rstrip("/") + "/"
    strip = lambda c: F.when(F.col(c).startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 20)).otherwise(F.col(c))
    ok = ok.withColumn("rotation", F.coalesce("rotation", F.lit(0))).withColumn("path", strip("path")).withColumn("dir", strip("dir"))
    if version is None or version == 3:
        copied = F.when(F.col("type") == "video", F.lit(True)).otherwise(F.col("max_copy"))
        ok = ok.withColumn("quality_cache", F.array("height")).withColumn("max_copy", copied)
    return ok, out.filter("reason is not null")
