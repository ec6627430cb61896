"""Rating insights and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import absolute_path
from ..plans.fixtures import Library
from ..plans.lineage import settled
from . import postings
from .postings import TokenStore
from .text import token_index

#: An average nearer to zero says nothing.
LEAST_AVERAGE = 0.1
#: Token averages are broadcast up to this many.
BROADCAST_TOKENS = 1_000_000


def token_averages(lib: Library, minimum_count: int = 20, index: DataFrame | None = None) -> DataFrame:
    """(token, average, count) over rated media; ratings 1..5 count as -1..1.

    Tokens such as the media type stand in every row; partial sums absorb that.
    """
    index = token_index(lib) if index is None else index
    rated = lib.media.filter("rating is not null and rating <> 0").select("hash", ((F.col("rating") - 3) / 2).alias("value"))
    per = index.join(rated, "hash").groupBy("token").agg(F.avg("value").alias("average"), F.count(F.lit(1)).alias("count"))
    return per.filter((F.col("count") >= minimum_count) & (F.abs("average") >= LEAST_AVERAGE))


def insights(lib: Library, minimum_count: int = 20, store: TokenStore | None = None) -> DataFrame:
    """F2; from the sums of a stored index, if there is one."""
    averages = postings.token_averages(store, minimum_count, LEAST_AVERAGE) if store else token_averages(lib, minimum_count)
    return averages.orderBy(F.desc("average"), "token")


def recommendations(
    lib: Library, minimum_count: int = 20, hashes: DataFrame | None = None, index: DataFrame | None = None, store: TokenStore | None = None,
) -> DataFrame:
    """(hash, score), the sum of the averages of a medium's distinct tokens; 0 without any.

    ``hashes`` limits what is scored, not what the averages are taken over. ``store`` is
    a stored index with its sums, ``index`` only its rows; without them, an index is
    computed and written once for both steps.
    """
    if store is not None:
        index, averages = store.rows(), postings.token_averages(store, minimum_count, LEAST_AVERAGE)
    else:
        index = settled(token_index(lib), "token-index") if index is None else index
        averages = token_averages(lib, minimum_count, index)
    averages = settled(averages.select("token", "average"), "token-averages")
    if averages.count() <= BROADCAST_TOKENS:
        averages = F.broadcast(averages)
    # rows of a medium are few and stand together in an index, so sums come before anything else is joined
    scores = index.join(averages, "token").groupBy("hash").agg(F.sum("average").alias("score"))
    media = lib.media.select("hash") if hashes is None else hashes.select("hash").distinct()
    return media.join(scores, "hash", "left").select("hash", F.coalesce("score", F.lit(0.0)).alias("score"))


def playlist_sizes(playlists: DataFrame, entries: DataFrame) -> DataFrame:
    """playlists with their size, 0 if empty."""
    n = entries.groupBy(F.col("playlist_id").alias("id")).agg(F.count(F.lit(1)).alias("size"))
    return playlists.drop("size").join(n, "id", "left").withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))


def vocabulary(bridge: DataFrame, column: str) -> DataFrame:
    """sorted distinct values (id)."""
    return bridge.select(F.col(column).alias("id")).distinct().orderBy("id")


def details(lib: Library, root: str = "/") -> DataFrame:
    """media with sorted tags and actors, playlists (id, order) and the absolute path; all joined on hash, where tags come as lists if the library holds them so."""
    lists = lambda b, c, name: b.groupBy(F.col("media_hash").alias("hash")).agg(F.sort_array(F.collect_list(c)).alias(name))
    tags = lists(lib.media_tags, "tag_id", "tags") if lib.tag_lists is None else lib.tag_lists.select(F.col("media_hash").alias("hash"), F.sort_array("words").alias("tags"))
    playlists = lib.media_playlists.groupBy(F.col("media_hash").alias("hash")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("playlist_id").alias("id"), F.col("position").alias("order")))).alias("playlists"),
    )
    none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    out = lib.media.join(tags, "hash", "left").join(lists(lib.media_actors, "actor_id", "actors"), "hash", "left").join(playlists, "hash", "left")
    return out.select(
        *lib.media.columns,
        none("tags", "array<string>"),
        none("actors", "array<string>"),
        none("playlists", "array<struct<id:string,order:int>>"),
        absolute_path(root, F.col("path")).alias("absolute_path"),
    )
