"""A stored order of media (E5, E6): a page or a medium's neighbours come from one or two files.

``rows/part=k`` has the ranks k * step to (k + 1) * step - 1 in one file, in order;
``places/bucket=b`` has (hash, rank); ``size`` has the number of rows and the step. So the
place of every rank is known without a scan, and a page of up to ``step`` rows is in two
files at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import exists
from ..plans.ranks import ranked
from .search import sort_keys

#: Rows of a file, and files of places.
STEP, BUCKETS = 100_000, 32


@dataclass(frozen=True)
class StoredOrder:
    spark: SparkSession
    root: str
    n: int
    step: int
    buckets: int
    columns: str  # of the rows

    def _read(self, name: str, numbers: list[int]) -> DataFrame:
        whole = f"{self.columns}, rank long, part long" if name == "rows" else "hash string, rank long, bucket long"
        paths = [p for k in numbers if exists(self.spark, p := f"{self.root}/{name}/{'part' if name == 'rows' else 'bucket'}={k}")]
        if not paths:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def between(self, low: int, high: int) -> DataFrame:
        """Rows with ranks low to high - 1, from the files that hold them."""
        low, high = max(low, 0), min(high, self.n)
        parts = list(range(low // self.step, (high - 1) // self.step + 1)) if low < high else []
        return self._read("rows", parts).filter((F.col("rank") >= low) & (F.col("rank") < high)).drop("part")

    def page(self, size: int, number: int) -> DataFrame:
        """E5: page ``number``, in order; size 0 is one page."""
        low, high = (number * size, (number + 1) * size) if size else (0, 0 if number else self.n)
        return self.between(low, high).withColumn("page", F.lit(number).cast("long")).orderBy("rank")

    def neighbours(self, hash_: str) -> tuple[str, str] | None:
        """The media before and after one, wrapping round at the ends; None if it isn't there."""
        number = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(hash_)), F.lit(self.buckets))).first()[0]
        at = self._read("places", [number]).filter(F.col("hash") == hash_).select("rank").first()
        if at is None:
            return None
        near = [(at[0] - 1) % self.n, (at[0] + 1) % self.n]
        rows = self._read("rows", sorted({r // self.step for r in near})).filter(F.col("rank").isin(near)).select("rank", "hash")
        found = {r["rank"]: r["hash"] for r in rows.collect()}  # two rows
        return found[near[0]], found[near[1]]


def store(rows: DataFrame, root: str, sort_by: str, direction: str | None = None, step: int = STEP, buckets: int = BUCKETS) -> StoredOrder:
    """Writes ``rows`` (hash, the sort column, ...) in order into the empty folder ``root``."""
    spark = rows.sparkSession
    placed = ranked(rows, sort_keys(sort_by, direction)[:1], ["hash"]).withColumn("part", F.floor(F.col("rank") / step))
    placed.repartition("part").sortWithinPartitions("part", "rank").write.partitionBy("part").parquet(f"{root}/rows")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    written = spark.read.schema(f"{columns}, rank long, part long").parquet(f"{root}/rows")
    places = written.select("hash", "rank", F.pmod(F.xxhash64("hash"), F.lit(buckets)).alias("bucket"))
    places.repartition("bucket").sortWithinPartitions("bucket", "hash").write.partitionBy("bucket").parquet(f"{root}/places")
    spark.createDataFrame([(written.count(), step, buckets, columns)], "n long, step long, buckets int, columns string").coalesce(1).write.parquet(f"{root}/size")
    return reopen(spark, root)


def reopen(spark: SparkSession, root: str) -> StoredOrder:
    return StoredOrder(spark, root, *spark.read.parquet(f"{root}/size").first())
