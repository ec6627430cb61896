"""Ordered playlists (G1-G9): entries (media_hash, playlist_id, position), positions 0..n-1 in each playlist.

Functions return new entry tables. Positions come from ranges of (playlist, order), so
a playlist of any size is no single task's work (``plans.ranks``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settled
from ..plans.ranks import ranked
from ..plans.sizes import narrow

_ENTRY = ["media_hash", "playlist_id", "position"]
#: Places of a playlist that share one list of stretches, and such lists that are broadcast.
BLOCK, BROADCAST_BLOCKS = 1 << 16, 20_000


def densify(entries: DataFrame) -> DataFrame:
    """Positions 0..n-1 again, in their present order."""
    order = ranked(entries.select(_ENTRY), [F.col("position")], ["media_hash"], ["playlist_id"])
    return order.withColumn("position", F.col("rank").cast("int")).select(_ENTRY)


def append(entries: DataFrame, more: DataFrame) -> DataFrame:
    """``more`` (media_hash, playlist_id, rank) goes to the end in order of rank; what is there already stays where it is, and of repeats the first counts."""
    new = more.groupBy("media_hash", "playlist_id").agg(F.min("rank").alias("rank")).join(
        entries.select("media_hash", "playlist_id"),
        ["media_hash", "playlist_id"],
        "left_anti",
    )
    last = entries.groupBy("playlist_id").agg(F.max("position").alias("_last"))
    placed = ranked(new.withColumnRenamed("rank", "_rank"), [F.col("_rank")], ["media_hash"], ["playlist_id"]).join(last, "playlist_id", "left")
    position = F.coalesce("_last", F.lit(-1)) + 1 + F.col("rank")
    return entries.select(_ENTRY).unionByName(placed.select("media_hash", "playlist_id", position.cast("int").alias("position")))


def create(playlists: DataFrame, entries: DataFrame, new: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G1: ``new`` (id, name, thumbnail) with ``members`` (media_hash, playlist_id, rank)."""
    entries = append(entries, members)
    return refresh(playlists.unionByName(new, allowMissingColumns=True), entries), entries


def refresh(playlists: DataFrame, entries: DataFrame) -> DataFrame:
    """Sizes, and the thumbnail: the first member if none is set; none if it isn't a member any more and the playlist is empty."""
    stats = entries.groupBy(F.col("playlist_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_size"),
        F.min_by("media_hash", "position").alias("_first"),
    )
    return playlists.join(stats, "id", "left").select(
        "id",
        "name",
        F.coalesce("thumbnail", "_first").alias("thumbnail"),
        F.coalesce("_size", F.lit(0)).cast("long").alias("size"),
    )


def folded(media: list[str], starts: list[int], targets: list[int]) -> tuple[dict[str, int], list[tuple[int, int]]]:
    """Moves of one playlist in their order: final places of the media moved, and (first place, shift) of the stretches of all others.

    ``starts`` are places before all moves. Only places of media that are ever moved are
    kept, as each move shifts some of them by one. The others keep their order and fill
    what is free, so their shift changes only at the moved media's first and last places.
    """
    known = sorted(set(zip(starts, media, strict=True)))
    number = {m: i for i, (_, m) in enumerate(known)}
    first = np.array([p for p, _ in known], np.int64)
    at = first.copy()
    for m, to in zip(media, targets, strict=True):
        i = number[m]
        start = at[i]
        if to > start:
            at[(at > start) & (at <= to)] -= 1
        else:
            at[(at >= to) & (at < start)] += 1
        at[i] = to
    # the r-th of the others stands at r + (moved first places before it), and goes to r + (taken places before it)
    one = np.arange(len(first))
    before, taken = first - one, np.sort(at) - one
    places = np.unique(np.concatenate([[0], first + 1, taken + np.searchsorted(before, taken, "right")]))
    r = places - np.searchsorted(first, places)
    shift = r + np.searchsorted(taken, r, "right") - places
    return {m: int(at[i]) for m, i in number.items()}, list(zip(places.tolist(), shift.tolist(), strict=True))


def _fold(group: pa.Table) -> pa.Table:
    """One row per moved medium (media_hash, place) and per stretch (place, until, shift) of a playlist."""
    group = group.sort_by([("seq", "ascending"), ("media_hash", "ascending"), ("to", "ascending")])
    name, size = group.column("playlist_id")[0].as_py(), group.column("size")[0].as_py()
    moved, stretches = folded(*(group.column(c).to_pylist() for c in ("media_hash", "position", "to")))
    until = [*[p for p, _ in stretches[1:]], size]
    rows = [(name, m, p, None, None) for m, p in moved.items()]
    rows += [(name, None, p, u, s) for (p, s), u in zip(stretches, until, strict=True) if p < u]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["playlist_id", "media_hash", "place", "until", "shift"])


def move(entries: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves`` (playlist_id, media_hash, to[, seq]), made one after the other in each playlist, by seq, then media_hash, then to.

    Those to a place outside the playlist, or of a medium not in it, are refused (nothing
    changes), and the others are made. The moves of one playlist are folded in one task,
    as each depends on those before it; its entries, however many, are only shifted by
    the stretch that they stand in.
    """
    seq = F.col("seq").cast("long") if "seq" in moves.columns else F.lit(0).cast("long")
    wanted = narrow(moves.select("playlist_id", "media_hash", F.col("to").cast("long").alias("to"), seq.alias("seq")), "moves")
    sizes = entries.join(narrow(wanted.select("playlist_id").distinct(), "moved-playlists"), "playlist_id", "left_semi").groupBy("playlist_id").agg(F.count(F.lit(1)).alias("size"))
    at = entries.select("playlist_id", "media_hash", F.col("position").cast("long").alias("position")).join(wanted, ["playlist_id", "media_hash"]).join(sizes, "playlist_id")
    made = at.filter((F.col("to") >= 0) & (F.col("to") < F.col("size"))).groupBy("playlist_id").applyInArrow(_fold, "playlist_id string, media_hash string, place long, until long, shift long")
    made = settled(made, "folded-moves")
    moved = narrow(made.filter("until is null").select("playlist_id", "media_hash", "place"), "moved-media")
    block = F.explode(F.sequence(F.floor(F.col("place") / BLOCK), F.floor((F.col("until") - 1) / BLOCK)))
    stretches = made.filter("until is not null").select("playlist_id", block.alias("_block"), F.struct(F.col("place").alias("start"), "shift").alias("s"))
    stretches = narrow(stretches.groupBy("playlist_id", "_block").agg(F.sort_array(F.collect_list("s")).alias("_s")), "stretches", BROADCAST_BLOCKS)
    out = entries.withColumn("_block", F.floor(F.col("position") / BLOCK)).join(moved, ["playlist_id", "media_hash"], "left").join(stretches, ["playlist_id", "_block"], "left")
    shift = F.element_at(F.filter("_s", lambda s: s["start"] <= F.col("position")), -1)["shift"]
    place = F.coalesce("place", F.col("position") + shift, "position")
    return out.select("media_hash", "playlist_id", place.cast("int").alias("position"))


def remove(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """Without ``gone`` (media_hash, playlist_id); gaps close."""
    return densify(entries.join(gone.select("media_hash", "playlist_id"), ["media_hash", "playlist_id"], "left_anti"))


def clear_thumbnails(playlists: DataFrame, gone: DataFrame) -> DataFrame:
    """No thumbnail where it was a medium removed from the playlist."""
    hit = gone.select(F.col("playlist_id").alias("id"), F.col("media_hash").alias("thumbnail"), F.lit(True).alias("_gone")).distinct()
    return playlists.join(hit, ["id", "thumbnail"], "left").select(
        "id",
        "name",
        F.when(F.col("_gone").isNull(), F.col("thumbnail")).alias("thumbnail"),
        "size",
    )


def delete(playlists: DataFrame, entries: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Playlists ``ids`` (id) and their entries."""
    return playlists.join(ids, "id", "left_anti"), entries.join(ids.withColumnRenamed("id", "playlist_id"), "playlist_id", "left_anti").select(_ENTRY)


def update(playlists: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (id, name, thumbnail); null or empty keeps the old value. Of repeated ids the smallest name and thumbnail count."""
    real = [F.min(F.nullif(c, F.lit(""))).alias(f"_{c}") for c in ("name", "thumbnail")]
    c = changes.groupBy("id").agg(*real)
    return playlists.join(c, "id", "left").select(
        "id",
        F.coalesce("_name", "name").alias("name"),
        F.coalesce("_thumbnail", "thumbnail").alias("thumbnail"),
        "size",
    )


def in_order(entries: DataFrame) -> DataFrame:
    """All entries by playlist and position, one row each."""
    return entries.select(_ENTRY).orderBy("playlist_id", "position", "media_hash")


def ordered(entries: DataFrame) -> DataFrame:
    """G9 as dumps have it: (playlist_id, hashes in order). A playlist is one value, so it must fit into a row; see in_order()."""
    return entries.groupBy("playlist_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", "media_hash"))), lambda e: e["media_hash"]).alias("hashes"),
    )
