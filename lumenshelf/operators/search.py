"""Declarative search (C1-C22), sorting, sampling and paging."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fixtures import Library
from ..plans.ranks import ranked
from . import text
from .grams import GramStore, like_filter
from .postings import TokenStore

#: Direction of a sort key where none is given.
DESCENDING = {"hashDate", "rating", "createdAt", "length", "recommended"}
COLUMNS = {
    "hashDate": "hash_date",
    "createdAt": "created_at",
    "order": "position",
    "duplicateOf": "duplicate_of",
    "quality": "height",
    "thumbnailOptimised": "thumbnail_optimised",
    "previewOptimised": "preview_optimised",
}
_STRINGS = ("type", "dir", "path", "artist", "album", "title", "hash", "duplicateOf")
_NUMBERS = ("quality", "rating", "length")
_LIKES = ("likeAny", "likeAll", "likeNone")
_FLAGS = ("corrupted", "thumbnail", "thumbnailOptimised", "preview", "previewOptimised")
_STATES = ("indexed", "cached", "phashed", "hasClones")
_OTHER = ("tags", "actors", "autoTags", "playlist", "keywordSearch", "sortBy", "sortDirection", "sample", "limit", "minimumCount")


def array_filter(media: DataFrame, bridge: DataFrame, column: str, want: dict[str, Any], lists: DataFrame | None = None) -> DataFrame:
    """C1-C4 on a bridge table (media_hash, ``column``); only matching bridge rows are shuffled. ``lists`` are the same rows as (media_hash, words)."""
    rows = bridge.select(F.col("media_hash").alias("hash"), F.col(column).alias("_v"))
    if (any_ := want.get("equalsAny")) is not None:
        media = media.join(rows.filter(F.col("_v").isin(any_)), "hash", "left_semi")
    if all_ := want.get("equalsAll"):
        # a value listed twice can never be matched twice
        full = rows.filter(F.col("_v").isin(all_)).groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(all_))
        media = media.join(full, "hash", "left_semi")
    if none := want.get("equalsNone"):
        media = media.join(rows.filter(F.col("_v").isin(none)), "hash", "left_anti")
    if want.get("exists") is not None:
        some = rows if lists is None else lists.filter(F.size("words") > 0).select(F.col("media_hash").alias("hash"))
        media = media.join(some.select("hash"), "hash", "left_semi" if want["exists"] else "left_anti")
    return media


def string_filter(c: Column, want: dict[str, Any]) -> Column:
    """C5-C11. Like patterns are literal and ignore case."""
    like = lambda v: F.contains(F.lower(c), F.lit(v.lower()))
    out = F.lit(True)
    if want.get("equalsAny") is not None:
        out &= c.isin(want["equalsAny"]) if want["equalsAny"] else F.lit(False)
    if want.get("equalsAll"):
        out &= c == want["equalsAll"][0]
    if want.get("equalsNone"):
        out &= ~c.isin(want["equalsNone"]) | c.isNull()
    if want.get("exists") is not None:
        out &= c.isNotNull() if want["exists"] else c.isNull()
    if want.get("before"):
        out &= c < want["before"]
    if want.get("after"):
        out &= c > want["after"]
    if want.get("likeAny"):
        out &= reduce(lambda a, b: a | b, map(like, want["likeAny"]))
    if want.get("likeAll"):
        out &= reduce(lambda a, b: a & b, map(like, want["likeAll"]))
    if want.get("likeNone"):
        out &= ~reduce(lambda a, b: a | b, map(like, want["likeNone"])) | c.isNull()
    return out


def number_filter(c: Column, want: dict[str, Any]) -> Column:
    """C12. A maximum of zero also takes what is unset."""
    out = F.lit(True)
    if want.get("min") is not None:
        out &= c >= want["min"]
    if want.get("max") is not None:
        out &= (c <= want["max"]) | c.isNull() if want["max"] == 0 else c <= want["max"]
    if want.get("equalsAny") is not None:
        out &= c.isin(want["equalsAny"]) if want["equalsAny"] else F.lit(False)
    return out


def flag_filter(c: Column, want: bool) -> Column:
    """False also takes what is unset."""
    return F.coalesce(c, F.lit(False)) == want


def state_filter(name: str, want: bool) -> Column:
    """C14-C17."""
    size = lambda c: F.size(F.coalesce(F.col(c), F.array()))
    made = {
        "indexed": lambda: F.col("width").isNotNull(),
        "cached": lambda: (F.col("type") != "video") | (size("quality_cache") > 0),
        "phashed": lambda: F.col("phash").isNotNull(),
        "hasClones": lambda: size("clones") > 0,
    }[name]()
    return made if want else ~made


def visible() -> dict[str, Any]:
    """What any gallery shows by default."""
    return {"corrupted": False, "indexed": True, "duplicateOf": {"exists": False}}


def search(
    lib: Library,
    want: dict[str, Any],
    fields: list[str] | None = None,
    seed: int = 0,
    store: TokenStore | None = None,
    grams: GramStore | None = None,
) -> DataFrame:
    """The media that meet all constraints in ``want``.

    Column conditions come first, where the scan can take them; then semi and anti joins
    on hash. ``sortBy``, ``sortDirection``, ``sample`` and ``limit`` come last, in that
    order. ``fields`` defaults to all columns. ``autoTags`` is a column of lists and knows
    ``exists`` only. An unknown constraint is an error. ``store`` is a stored token index,
    from which recommendations are made, and ``grams`` a stored trigram index, from which
    like patterns of its columns are met.
    """
    media = lib.media
    liked = []
    for name, w in want.items():
        if name in _STRINGS:
            column = COLUMNS.get(name, name)
            if grams is not None and column in grams.columns and any(w.get(k) for k in _LIKES):
                liked.append((column, w))
                w = {k: v for k, v in w.items() if k not in _LIKES}
            media = media.filter(string_filter(F.col(column), w))
        elif name in _NUMBERS:
            media = media.filter(number_filter(F.col(COLUMNS.get(name, name)), w))
        elif name in _FLAGS:
            media = media.filter(flag_filter(F.col(COLUMNS.get(name, name)), w))
        elif name in _STATES:
            media = media.filter(state_filter(name, w))
        elif name == "autoTags":
            media = media.filter(F.col("auto_tags").isNotNull() == w["exists"])
        elif name not in _OTHER:
            raise ValueError(f"unknown constraint {name}")
    for column, w in liked:
        media = like_filter(media, grams, column, w)
    if "tags" in want:
        media = array_filter(media, lib.media_tags, "tag_id", want["tags"], lib.tag_lists)
    if "actors" in want:
        media = array_filter(media, lib.media_actors, "actor_id", want["actors"])
    if "playlist" in want:
        members = lib.media_playlists.filter(F.col("playlist_id") == want["playlist"]).select(F.col("media_hash").alias("hash"), "position")
        media = media.join(members, "hash")
    if want.get("keywordSearch"):
        media = media.join(text.keyword_matches(lib, want["keywordSearch"]), "hash", "left_semi")
    sort_by = want.get("sortBy") or ("order" if "playlist" in want else None)
    if sort_by == "recommended":
        from .insights import recommendations

        # only what was found is scored
        scores = recommendations(lib, want.get("minimumCount", 20), media.select("hash"), store=store)
        media = media.join(scores.withColumnRenamed("score", "recommended"), "hash")
    if want.get("sample"):
        media = sample(media, want["sample"], seed)
    if sort_by:
        media = media.orderBy(*sort_keys(sort_by, want.get("sortDirection")))
    if want.get("limit"):
        media = media.limit(want["limit"])
    return media.select(*fields) if fields else media


def sort_keys(sort_by: str, direction: str | None = None) -> list[Column]:
    """Null is lowest; hash settles ties."""
    c = F.col(COLUMNS.get(sort_by, sort_by))
    down = direction.upper() == "DESC" if direction else sort_by in DESCENDING
    return [c.desc_nulls_last() if down else c.asc_nulls_first(), F.col("hash").asc()]


def seeded(seed: int) -> Column:
    """A key's place in the order of a seed: retries and other engines draw the same."""
    return F.md5(F.concat("hash", F.lit(f"|{seed}")))


def sample(media: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The n rows that come first in the order of the seed."""
    return media.orderBy(seeded(seed), "hash").limit(n)


def shuffled(media: DataFrame, seed: int) -> DataFrame:
    """Adds rank, the place in one permutation per seed."""
    return ranked(media, [seeded(seed)], ["hash"])


def neighbour_dirs(media: DataFrame) -> DataFrame:
    """E4 for all directories: (dir, previous, next).

    Directories are range-partitioned and each partition only needs its neighbours'
    ends; ``ranked`` gives positions without one global window.
    """
    dirs = ranked(media.select("dir").filter("dir is not null").distinct(), [F.col("dir")], ["dir"])
    near = lambda shift, name: dirs.select((F.col("rank") + shift).alias("rank"), F.col("dir").alias(name))
    return dirs.join(near(1, "previous"), "rank", "left").join(near(-1, "next"), "rank", "left").select("dir", "previous", "next")


def next_dir(media: DataFrame, dir_: str, previous: bool = False) -> DataFrame:
    """The directory strictly after (before) ``dir_``; at most one row."""
    c = F.col("dir")
    return media.filter(c < dir_ if previous else c > dir_).select("dir").distinct().orderBy(c.desc() if previous else c.asc()).limit(1)


def pages(rows: DataFrame, sort_by: str, size: int, direction: str | None = None) -> DataFrame:
    """E5: adds rank and page; size 0 is one page."""
    out = ranked(rows, sort_keys(sort_by, direction)[:1], ["hash"])
    return out.withColumn("page", F.floor(F.col("rank") / size) if size else F.lit(0).cast("long"))


def page(rows: DataFrame, sort_by: str, size: int, number: int, direction: str | None = None) -> DataFrame:
    return pages(rows, sort_by, size, direction).filter(F.col("page") == number)


def neighbours(rows: DataFrame, sort_by: str, direction: str | None = None) -> DataFrame:
    """(hash, previous, next), wrapping round at the ends."""
    r = ranked(
        rows.select("hash", *([COLUMNS.get(sort_by, sort_by)] if sort_by != "hash" else [])),
        sort_keys(sort_by, direction)[:1],
        ["hash"],
    ).select("hash", "rank")
    n = r.count()
    near = lambda shift, name: r.select(F.pmod(F.col("rank") + shift, F.lit(max(n, 1))).alias("rank"), F.col("hash").alias(name))
    return r.join(near(1, "previous"), "rank").join(near(-1, "next"), "rank").select("hash", "previous", "next")


#: Orders that a form may ask for.
_FORM_SORTS = ("hashDate", "recommended", "rating", "length", "createdAt", "path")


def form_constraints(form: dict[str, Any]) -> dict[str, Any]:
    """A search form as constraints.

    Fields: keywords, minimumResolution, ratingMin and ratingMax (negative: unset),
    lengthMin and lengthMax in minutes, typeVideo, typeGif, typeStill, tags and actors
    (equalsAny, equalsAll, equalsNone), tagged, untagged (wins over tagged), artist,
    album, title, path and dir (like, notLike), playlist (sets the order), sortBy,
    hasClones. Empty fields and lists vanish.
    """
    out: dict[str, Any] = {}
    if form.get("keywords"):
        out["keywordSearch"] = form["keywords"]
    if form.get("minimumResolution"):
        out["quality"] = {"min": int(form["minimumResolution"])}
    bounds = {op: form.get(f"rating{op.title()}") for op in ("min", "max")}
    if rating := {op: v for op, v in bounds.items() if v is not None and v >= 0}:
        out["rating"] = rating
    if form.get("sortBy") in _FORM_SORTS:
        out["sortBy"] = form["sortBy"]
    if types := [t for t in ("video", "gif", "still") if form.get(f"type{t.title()}")]:
        out["type"] = {"equalsAny": types}
    bounds = {op: form.get(f"length{op.title()}") for op in ("min", "max")}
    if length := {op: v * 60 for op, v in bounds.items() if v is not None}:
        out["length"] = length
    for name in ("tags", "actors"):
        if lists := {op: v for op, v in (form.get(name) or {}).items() if op in ("equalsAny", "equalsAll", "equalsNone") and v}:
            out[name] = lists
    for flag, there in (("tagged", True), ("untagged", False)):
        if form.get(flag):
            out["tags"] = out.get("tags", {}) | {"exists": there}
    if form.get("playlist"):
        out |= {"playlist": form["playlist"], "sortBy": "order"}
    for name in ("artist", "album", "title", "path", "dir"):
        texts = form.get(name) or {}
        if likes := {op: [texts[key]] for op, key in (("likeAny", "like"), ("likeNone", "notLike")) if texts.get(key)}:
            out[name] = likes
    if form.get("hasClones"):
        out["hasClones"] = True
    return out
