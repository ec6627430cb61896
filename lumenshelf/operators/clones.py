"""Near-duplicate stills by perceptual hash."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hamming
from ..plans.fixtures import Library
from ..plans.lineage import settled

CHUNKS, DIGITS = 4, 64
#: Largest distance of clones; banding into four is exact up to three.
DISTANCE = 2
#: Hashes of one key that meet all others of it in one task.
BLOCK = 2000


def _none() -> Column:
    return F.array().cast("array<string>")


def _chunk(c: str, i: int) -> Column:
    size = DIGITS // CHUNKS
    return F.substring(c, 1 + size * i, size)


def _places(most: int) -> list[tuple[int, ...]]:
    """The chunks that one join key holds, for each key of a hash."""
    return list(itertools.combinations(range(CHUNKS), CHUNKS - most))


def banded(hashes: DataFrame, most: int) -> DataFrame:
    """(phash, pos, key): each hash with its join keys."""
    bands = F.array(*[F.concat(*[_chunk("phash", i) for i in p]) for p in _places(most)])
    return hashes.select("phash", F.posexplode(bands).alias("pos", "key"))


def met_earlier(most: int) -> Column:
    """Whether the hashes a and b, met at pos, share a key before that."""
    out = F.lit(False)
    for n, p in enumerate(_places(most)[:-1]):
        out |= (F.col("pos") > n) & reduce(lambda x, y: x & y, [_chunk("a", i) == _chunk("b", i) for i in p])
    return out


def hash_pairs(hashes: DataFrame, most: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b, distance), a < b, of distinct values of ``phash`` at most ``most`` (0 to 3) bits apart.

    Of four chunks at most ``most`` differ, so a pair agrees in 4 - ``most`` chunks at
    their places; one join key holds that many chunks. At the default of 2 a key is half
    of the hash, so a band that many images share (plain sky, black edges) makes no
    candidates by itself. Equal hashes are collapsed first; a pair that shares several
    keys is kept at the first one only, so no distinct is needed. A key of more than
    ``block`` hashes is split: one side is dealt to blocks, the other goes to each.
    """
    if not 0 <= most < CHUNKS:
        raise ValueError(f"banding into {CHUNKS} is exact below {CHUNKS} bits, not for {most}")
    one = hashes.select("phash").filter(F.length("phash") == DIGITS).distinct()
    keyed = banded(one, most)
    shared = keyed.groupBy("pos", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = keyed.join(shared.withColumn("_blocks", F.ceil(F.col("n") / block).cast("int")), ["pos", "key"])
    dealt = F.pmod(F.xxhash64("phash"), F.col("_blocks")).cast("int")
    a = keyed.select(F.col("phash").alias("a"), "pos", "key", dealt.alias("_block"))
    b = keyed.select(F.col("phash").alias("b"), "pos", "key", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    met = a.join(b, ["pos", "key", "_block"]).filter((F.col("a") < F.col("b")) & ~met_earlier(most))
    return met.select("a", "b", hamming(F.col("a"), F.col("b")).alias("distance")).filter(F.col("distance") <= most)


def _candidates(media: DataFrame) -> DataFrame:
    return media.filter("type = 'still' and phash is not null and duplicate_of is null").select("hash", "phash")


def clone_classes(media: DataFrame, most: int = DISTANCE) -> tuple[DataFrame, DataFrame]:
    """I4 without lists: members (hash, phash), and pairs (a, b, distance) of different hashes that are clones.

    Media of one hash are clones of each other too. Both tables grow with the media and
    with the pairs of different hashes, not with the square of a group of equal ones.
    """
    stills = _candidates(media)
    return stills, hash_pairs(stills, most)


def clone_map(media: DataFrame, most: int = DISTANCE, unrelated: DataFrame | None = None, classes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """I4: (hash, clones) for each still with a hash that is no duplicate; ``unrelated`` (a, b) are pairs of media marked so, in either direction.

    Lists are what media store, so n media of one hash have n lists of n - 1; use
    clone_classes() where groups are too large for that. ``classes`` are members and pairs
    of a stored index (``bands``), or a part of them.
    """
    stills, near = classes or clone_classes(media, most)
    both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both.unionByName(stills.select(F.col("phash").alias("a"), F.col("phash").alias("b")).distinct())
    others = stills.select(F.col("hash").alias("clone"), F.col("phash").alias("b"))
    pairs = stills.join(both, F.col("phash") == F.col("a")).select("hash", "b").join(others, "b").filter("hash <> clone").select("hash", "clone")
    if unrelated is not None:
        marked = unrelated.select(F.col("a").alias("hash"), F.col("b").alias("clone"))
        marked = marked.unionByName(unrelated.select(F.col("b").alias("hash"), F.col("a").alias("clone")))
        pairs = pairs.join(marked, ["hash", "clone"], "left_anti")
    lists = pairs.groupBy("hash").agg(F.sort_array(F.collect_list("clone")).alias("clones"))
    return stills.select("hash").join(lists, "hash", "left").select("hash", F.coalesce("clones", _none()).alias("clones"))


def write_back(media: DataFrame, clones: DataFrame, now: int) -> DataFrame:
    """New clone lists and clone_date where the sorted list changed."""
    new = media.join(clones.select("hash", F.sort_array("clones").alias("_new")), "hash", "left")
    changed = F.col("_new").isNotNull() & ~F.sort_array(F.coalesce("clones", F.array().cast("array<string>"))).eqNullSafe(F.col("_new"))
    changed |= F.col("_new").isNotNull() & F.col("clones").isNull()
    out = new.withColumn("clone_date", F.when(changed, F.lit(now)).otherwise(F.col("clone_date"))).withColumn(
        "clones",
        F.when(changed, F.col("_new")).otherwise(F.col("clones")),
    )
    return out.select(media.columns)


def final_targets(to: DataFrame) -> DataFrame:
    """(alias, target) with chains followed to their ends; ``to`` has one row per alias.

    Pointer jumping: each round doubles the steps that a row has gone. Of n rows that have
    not ended after n steps or more, those that ever end do so in one more round: a longer
    chain would have more rows behind it. The others lead into cycles; they stand on
    them by then and know the smallest member, which is where the cycle is broken: all
    that lead into it get that member, which itself is no alias any more.
    """
    aliases = to.select(F.col("alias").alias("target"), F.lit(True).alias("more"))
    start = to.join(aliases, "target", "left").select(
        "alias",
        F.col("target").alias("at"),
        F.col("alias").alias("low"),
        F.col("more").isNull().alias("done"),
    )
    state, steps = settled(start, "targets"), 1
    going, last = state.filter("not done").count(), False
    while going and not last:
        last = steps >= going
        hop = state.select(F.col("alias").alias("at"), F.col("at").alias("_at"), F.col("low").alias("_low"), F.col("done").alias("_done"))
        moved = state.join(hop, "at", "left").select(
            "alias",
            F.coalesce("_at", "at").alias("at"),
            F.least("low", "_low").alias("low"),
            F.coalesce("_done", F.lit(True)).alias("done"),
        )
        state, steps = settled(moved, "targets"), 2 * steps
        going = state.filter("not done").count()
    ends = state.filter("done").select("alias", F.col("at").alias("target"))
    least = state.select(F.col("alias").alias("at"), F.col("low").alias("target"))
    cyclic = state.filter("not done").select("alias", "at").join(least, "at").filter("alias <> target")
    return ends.unionByName(cyclic.select("alias", "target"))


def resolve(media: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``decisions`` (hash, aliases, unrelated) must cover all clones of their medium; returns (media, rejected decisions).

    A medium whose clones are null has none to resolve, and its decision is rejected.
    Decisions on one medium are united. Aliases point at their medium, and so does what
    pointed at an alias; chains among decisions are followed and cycles broken at their
    smallest hash (``final_targets``). A medium named by several decisions goes to the
    smallest hash.
    """
    united = [F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, _none())))).alias(c) for c in ("aliases", "unrelated")]
    asked = decisions.groupBy("hash").agg(*united)
    with_clones = asked.join(media.select("hash", F.col("clones").alias("_clones")), "hash")
    covered = F.coalesce(F.size(F.array_except("_clones", F.concat("aliases", "unrelated"))) == 0, F.lit(False)) & F.col("_clones").isNotNull()
    good, bad = with_clones.filter(covered).drop("_clones"), with_clones.filter(~covered).select("hash", "aliases", "unrelated")
    to = good.select(F.explode("aliases").alias("alias"), F.col("hash").alias("target")).filter("alias <> target")
    to = settled(final_targets(to.groupBy("alias").agg(F.min("target").alias("target"))), "targets")
    here = to.select(F.col("alias").alias("hash"), F.col("target").alias("_own"))
    via = to.select(F.col("alias").alias("duplicate_of"), F.col("target").alias("_via"))
    done = good.select("hash", F.col("unrelated").alias("_unrelated"))
    out = media.join(here, "hash", "left").join(via, "duplicate_of", "left").join(done, "hash", "left")
    out = out.withColumn(
        "duplicate_of",
        F.coalesce("_own", F.when(F.col("_via") != F.col("hash"), F.col("_via")), F.when(F.col("_via").isNull(), F.col("duplicate_of"))),
    )
    out = out.withColumn("clones", F.when(F.col("_unrelated").isNotNull(), _none()).otherwise(F.col("clones")))
    out = out.withColumn("unrelated", F.coalesce("_unrelated", "unrelated"))
    return out.select(media.columns), bad


def auto_resolve(lib: Library, groups: DataFrame) -> DataFrame:
    """One row per group (group_id, hash): the winner with what it takes from the others.

    The winner has the most pixels (then the smallest hash). Artist, album and title
    are the first that are set in that order, the rating is the highest, tags and
    actors are united; the rest are aliases.
    """
    pixels = F.coalesce(F.col("width").cast("long") * F.col("height"), F.lit(-1))
    rows = groups.join(lib.media, "hash").withColumn("_key", F.struct((-pixels).alias("p"), F.col("hash").alias("h")))
    first = lambda c: F.min_by(F.nullif(c, F.lit("")), F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col("_key"))).alias(c)
    one = rows.groupBy("group_id").agg(
        F.min_by("hash", "_key").alias("hash"),
        first("artist"),
        first("album"),
        first("title"),
        F.max(F.nullif("rating", F.lit(0))).alias("rating"),
        F.sort_array(F.collect_set("hash")).alias("_all"),
    )

    def words(lists: DataFrame, name: str) -> DataFrame:
        """United lists (media_hash, words) of each group; lists are exchanged, not their rows."""
        own = groups.join(lists.withColumnRenamed("media_hash", "hash"), "hash").groupBy("group_id")
        return own.agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("words")))).alias(name))

    actors = lib.media_actors.groupBy("media_hash").agg(F.collect_list("actor_id").alias("words"))
    out = one.join(words(lib.lists_of_tags(), "tags"), "group_id", "left").join(words(actors, "actors"), "group_id", "left")
    none = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return out.select(
        "group_id",
        "hash",
        "artist",
        "album",
        "title",
        "rating",
        none("tags"),
        none("actors"),
        F.array_except("_all", F.array("hash")).alias("aliases"),
    )
