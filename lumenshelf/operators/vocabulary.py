"""Tags and actors: vocabularies (id) and bridges (media_hash, tag_id or actor_id) (H1-H5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settled
from ..plans.sizes import narrow

#: Media whose sets are replaced are broadcast up to this many.
BROADCAST_HASHES = 500_000


def _without(bridge: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """Rows of a bridge that are not in ``gone`` (media_hash, column); only rows whose words it has are shuffled."""
    words = narrow(gone.select(column).filter(F.col(column).isNotNull()).distinct(), "words")
    rows = bridge.select("media_hash", column)
    kept = rows.join(words, column, "left_anti")
    return kept.select("media_hash", column).unionByName(rows.join(words, column, "left_semi").join(gone.select("media_hash", column), ["media_hash", column], "left_anti"))


def add_to_media(bridge: DataFrame, more: DataFrame, vocabulary: DataFrame, media: DataFrame, column: str) -> DataFrame:
    """H1: a set; the word must be in the vocabulary and the medium must exist. ``bridge`` is a set already, and only its rows with the new words are shuffled."""
    known = more.select("media_hash", column).join(vocabulary.select(F.col("id").alias(column)), column, "left_semi").join(
        media.select(F.col("hash").alias("media_hash")),
        "media_hash",
        "left_semi",
    )
    known = settled(known.select("media_hash", column).dropDuplicates(), "added")
    here = bridge.select("media_hash", column).join(narrow(known.select(column).distinct(), "words"), column, "left_semi")
    return bridge.select("media_hash", column).unionByName(known.join(here, ["media_hash", column], "left_anti"))


def remove_from_media(bridge: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """H2."""
    return _without(bridge, gone, column)


def add_words(vocabulary: DataFrame, more: DataFrame) -> DataFrame:
    """H3."""
    return vocabulary.select("id").unionByName(more.select("id")).filter("id is not null").dropDuplicates()


def remove_words(vocabulary: DataFrame, bridge: DataFrame, gone: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """H4: from the vocabulary and from all media; few words shuffle neither."""
    gone = narrow(gone.select("id").distinct(), "gone-words")
    return vocabulary.join(gone, "id", "left_anti"), bridge.join(gone.withColumnRenamed("id", column), column, "left_anti").select("media_hash", column)


def replace_sets(bridge: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """H5: ``new`` (hash, words) replaces the whole set of each of its media; an empty or null list clears it. A repeated hash gets the union of its lists."""
    replaced = narrow(new.select(F.col("hash").alias("media_hash")).distinct(), "replaced", BROADCAST_HASHES)
    kept = bridge.join(replaced, "media_hash", "left_anti").select("media_hash", column)
    return kept.unionByName(new.select(F.col("hash").alias("media_hash"), F.explode("words").alias(column)).distinct())
