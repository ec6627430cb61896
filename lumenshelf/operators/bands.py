"""Clones of a growing library (I4): a stored index of hash bands that only new hashes probe.

Tables under one folder, each in versions
    values/v            (phash): hashes that the version brought
    bands/v/bucket      (pos, key, phash): their bands, as ``clones.hash_pairs`` joins them
    pairs/v             (a, b, distance), a < b: pairs of a new hash with any other
    members/v           (hash, phash): the media of a batch, null if one has no hash any more
    ready/v             written last; a version without it doesn't exist

A batch costs its own rows and the stored rows of its bands' keys, not the library. A
medium counts as its last version has it. Pairs of hashes never change, so those of
hashes that no medium has now are left out when classes are read; batches in any order
end in the classes of a full run. Lists per medium are made from classes on demand.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hamming
from ..plans.lineage import exists, settled
from ..plans.sizes import narrow
from .clones import BLOCK, DIGITS, DISTANCE, banded, met_earlier

BUCKETS = 64
_SCHEMAS = {
    "values": "phash string, v int", "bands": "pos int, key string, phash string, v int, bucket int", "pairs": "a string, b string, distance int, v int",
    "members": "hash string, phash string, v int",
}


@dataclass(frozen=True)
class BandStore:
    spark: SparkSession
    root: str
    versions: tuple[int, ...] = ()
    most: int = DISTANCE
    buckets: int = BUCKETS

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/{name}/v={v}" for v in self.versions]
        if buckets is not None:
            paths = [f"{p}/bucket={k}" for p in paths for k in buckets]
        paths = [p for p in paths if exists(self.spark, p)]
        if not paths:
            return self.spark.createDataFrame([], _SCHEMAS[name])
        return self.spark.read.schema(_SCHEMAS[name]).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def members(self) -> DataFrame:
        """(hash, phash) of the media as their last versions have them."""
        last = self.read("members").groupBy("hash").agg(F.max_by("phash", "v").alias("phash"))
        return last.filter("phash is not null")

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """Members and pairs, as clones.clone_classes has them."""
        members = self.members()
        now = settled(members.select("phash").distinct(), "hashes")
        pairs = self.read("pairs").drop("v")
        for c in ("a", "b"):
            pairs = pairs.join(now.withColumnRenamed("phash", c), c, "left_semi")
        return members, pairs.select("a", "b", "distance")


def add(store: BandStore, media: DataFrame, block: int = BLOCK) -> BandStore:
    """A version with ``media`` (hash, phash): new, changed or, with a null phash, no more a candidate. Of a repeated hash the largest phash counts."""
    spark, v = store.spark, max(store.versions, default=-1) + 1
    path = lambda name: f"{store.root}/{name}/v={v}"
    batch = settled(media.groupBy("hash").agg(F.max("phash").alias("phash")), "clone-batch")
    batch.write.parquet(path("members"))
    wanted = narrow(batch.select("phash").filter(F.length("phash") == DIGITS).distinct(), "batch-hashes")
    known = store.read("values").select("phash").join(wanted, "phash", "left_semi")
    fresh = settled(wanted.join(known, "phash", "left_anti"), "fresh-hashes")
    fresh.write.parquet(path("values"))
    bucket = F.pmod(F.xxhash64("pos", "key"), F.lit(store.buckets)).cast("int")
    own = settled(banded(fresh, store.most).select("pos", "key", "phash", bucket.alias("bucket")), "fresh-bands")
    keys = narrow(own.groupBy("pos", "key").agg(F.count(F.lit(1)).alias("_fresh")), "fresh-keys")
    # no more numbers than the index has buckets
    numbers = [r[0] for r in own.select("bucket").distinct().collect()]
    old = store.read("bands", numbers).select("pos", "key", "phash", F.lit(False).alias("_new")).join(keys.select("pos", "key"), ["pos", "key"], "left_semi")
    met = settled(old.unionByName(own.select("pos", "key", "phash", F.lit(True).alias("_new"))), "met-bands")
    # a key with any number of hashes is a grid of blocks
    sizes = met.groupBy("pos", "key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").join(keys, ["pos", "key"])
    grid = met.join(sizes.select("pos", "key", F.ceil(F.col("_fresh") / block).alias("_rows"), F.ceil(F.col("_n") / block).alias("_columns")), ["pos", "key"])
    deal, spread = (lambda n: F.pmod(F.xxhash64("phash"), F.col(n))), (lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    a = grid.filter("_new").select("pos", "key", F.col("phash").alias("a"), deal("_rows").alias("_i"), spread("_columns").alias("_j"))
    b = grid.select("pos", "key", F.col("phash").alias("b"), F.col("_new").alias("_both"), deal("_columns").alias("_j"), spread("_rows").alias("_i"))
    pairs = a.join(b, ["pos", "key", "_i", "_j"]).filter((F.col("a") != F.col("b")) & (~F.col("_both") | (F.col("a") < F.col("b"))) & ~met_earlier(store.most))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), hamming(F.col("a"), F.col("b")).alias("distance"))
    pairs.filter(F.col("distance") <= store.most).write.parquet(path("pairs"))
    own.repartition("bucket").sortWithinPartitions("bucket", "pos", "key").write.partitionBy("bucket").parquet(path("bands"))
    spark.range(1).write.parquet(path("ready"))
    return replace(store, versions=(*store.versions, v))


def reopen(spark: SparkSession, root: str, **options) -> BandStore:
    """The index under ``root`` with the versions that were written to their end."""
    versions, v = [], 0
    while exists(spark, f"{root}/ready/v={v}/_SUCCESS"):
        versions.append(v)
        v += 1
    return BandStore(spark, root, tuple(versions), **options)
