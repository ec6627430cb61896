"""Helpers that several operators of this subpackage share. Intermediate tables live where ``plans.lineage`` puts them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import new_folder

#: Rows and bytes in one Arrow batch: a batch of long texts must fit a Python worker.
ARROW_ROWS = 512
ARROW_BYTES = 16 << 20
#: A key is hot from this share of all rows on; so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 1 / 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive.

    The settings are read when a plan runs, after the operator has returned it, so
    they stay for the session; a smaller bound that is already set is kept.
    """
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: ends its lineage, computes it once."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumen_path = path  # for drop()
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables written by cut() that no later step reads."""
    for df in frames:
        remove(df.sparkSession, df._lumen_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup(big: DataFrame, per_key: DataFrame, key: str, count: str, how: str = "left") -> DataFrame:
    """Join rows to a table with one row per ``key``, in one scan of ``big`` and without a hot task.

    ``per_key`` must be a cut() table whose column ``count`` says how many rows of
    ``big`` have the key. Keys with HOT_SHARE of all rows or more are at most
    1 / HOT_SHARE; their rows are dealt by the partition that they come from, and
    their entry is repeated for each of the places, so that the join is an ordinary
    shuffle join on (key, place). The place of a row doesn't change when its task is
    run again. Null keys are allowed on the left, match nothing and are dealt likewise.
    """
    total = per_key.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    least, places = max(1000, int(total * HOT_SHARE)), shuffle_parts(big.sparkSession)
    hot = per_key.filter(F.col(count) >= least).select(F.col(key).alias("_hot"))
    place = F.pmod(F.spark_partition_id(), F.lit(places))
    dealt = big.withColumn("_from", place).join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    spread = F.col("_hot").isNotNull() | F.col(key).isNull()
    dealt = dealt.withColumn("_place", F.when(spread, F.col("_from")).otherwise(0)).drop("_hot", "_from")
    wanted = F.when(F.col(count) >= least, F.sequence(F.lit(0), F.lit(places - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(per_key.withColumn("_place", F.explode(wanted)), [key, "_place"], how).drop("_place")


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b); one row (node, component) per node with an edge.

    The component is the smallest node in it (nodes may be longs or strings).
    Alternates large-star and small-star steps (Kiveris et al. 2014): a node's edges
    only meet its smallest neighbour, so a hub with any number of neighbours is
    aggregated by a map-side minimum and no neighbour list is ever gathered. Each
    round is written to the shared folder. Self-loops and repeated edges are ignored.
    """
    real = edges.select("a", "b").filter(F.col("a") != F.col("b"))
    now = cut(real.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    for _ in range(rounds):
        digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        mark = now.agg(F.count(F.lit(1)).alias("n"), digest.alias("h")).first()
        if before == tuple(mark):
            break
        before = tuple(mark)
        now = _star(_star(now, large=True, name=name), large=False, name=name)
    else:
        raise RuntimeError(f"components of {name} did not settle in {rounds} rounds")
    ends = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ends)


def _star(edges: DataFrame, large: bool, name: str) -> DataFrame:
    """One star step on a cut() table of edges u > v; deletes its input."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    if large:
        both = both.unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    smallest = both.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n"))
    least = cut(smallest.withColumn("m", F.least("x", "m")), name)
    rows = lookup(both, least, "x", "n", "inner")
    if large:
        out = rows.filter(F.col("y") > F.col("x")).select(F.col("y").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select(F.col("x").alias("u"), F.col("m").alias("v"))
        out = rows.select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(own)
    done = cut(out.filter(F.col("u") != F.col("v")).distinct(), name)
    drop(edges, least)
    return done
