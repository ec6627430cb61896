"""Sparse and bulk updates (K1, K2).

Change sets of at most BROADCAST_ROWS rows are broadcast, so media are neither shuffled
nor sorted for them; larger ones are joined by shuffle.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sizes import narrow


def one_patch(patches: DataFrame, given: list[str]) -> DataFrame:
    """One row per hash: _hash, _keys, _<column> for each of ``given``, and _new if there is new_hash.

    Patches of one hash are merged column by column. Where several set a column, that of
    the largest ``seq`` counts (a column that patches may have), then the largest value.
    """
    seq = F.col("seq") if "seq" in patches.columns else F.lit(0)

    def last(c: str) -> Column:
        sets = F.array_contains("keys", c) if c in given else F.col(c).isNotNull()
        return F.max(F.when(sets, F.struct(seq.alias("seq"), F.col(c).alias("value"))))

    columns = [last(c)["value"].alias(f"_{c}") for c in given]
    if "new_hash" in patches.columns:
        columns.append(last("new_hash")["value"].alias("_new"))
    keys = F.array_distinct(F.flatten(F.collect_set("keys")))  # names of columns: few
    return patches.groupBy(F.col("hash").alias("_hash")).agg(keys.alias("_keys"), *columns)


def upsert(media: DataFrame, patches: DataFrame) -> DataFrame:
    """K1: ``patches`` have hash, any media columns, and keys, the names of the columns that the patch sets.

    A listed column takes the patch's value, null included; others keep theirs. Unknown
    hashes are inserted. ``new_hash``, if there, renames. Patches may repeat a hash
    (``one_patch``).
    """
    given = [c for c in media.columns if c in patches.columns and c != "hash"]
    patch = narrow(one_patch(patches, given), "patches")
    # unknown hashes: of those in the patch, the ones that no medium has
    known = media.select(F.col("hash").alias("_hash")).join(patch.select("_hash"), "_hash", "left_semi").distinct()
    born = patch.join(known, "_hash", "left_anti")

    def value(c: str, old: bool) -> Column:
        if c == "hash":
            return F.coalesce(*["_new"] * ("new_hash" in patches.columns), *["hash"] * old, "_hash").alias("hash")
        kept = F.col(c) if old else F.lit(None)
        new = F.when(F.array_contains("_keys", c), F.col(f"_{c}")).otherwise(kept) if c in given else kept
        return new.cast(media.schema[c].dataType).alias(c)

    changed = media.join(patch, F.col("hash") == F.col("_hash"), "left").select(*[value(c, True) for c in media.columns])
    return changed.unionByName(born.select(*[value(c, False) for c in media.columns]))


def bulk_update(media: DataFrame, matches: DataFrame, patch: dict[str, Any]) -> tuple[DataFrame, int]:
    """K2: sets ``patch`` on all media in ``matches`` (hash); returns the table and how many matched."""
    m = narrow(matches.select("hash", F.lit(True).alias("_hit")).distinct(), "matches")
    out = media.join(m, "hash", "left")
    for c, v in patch.items():
        out = out.withColumn(c, F.when(F.col("_hit"), F.lit(v).cast(media.schema[c].dataType)).otherwise(F.col(c)))
    return out.select(media.columns), m.count()
