"""A stored trigram index of string columns (C10, C11): like patterns open the files of their rarest trigrams, and the rows of candidates.

Tables under one folder, each in versions
    rows/v/place               (id, hash, columns): the values. ``id`` is the medium's number in the version
    grams/v/column/bucket/part (gram, place, first, n, offsets): trigrams of the lower-cased values, with lists
                               of the ``n`` media ``first + offset`` of a place. A bucket holds some trigrams,
                               and a part of it some places, so a trigram of all media is in as many files as
                               there are parts
    counts/v/column/bucket     (gram, n): media of a trigram, by which a query picks rare ones
    ready/v                    written last; a version without it doesn't exist

Values are exchanged once, by place, and trigrams as lists: a task that reads rows makes the
lists of ``SPAN`` numbers or about ``HELD`` entries, and only these are exchanged and sorted.

A query takes the media that have the ``PICKED`` rarest trigrams of each pattern, opens the
places of those media alone, and compares their values with the patterns, so its rows are
those of a scan. Patterns of one or two characters have no trigram: they are compared with
all stored values. An update adds a version with the changed media; trigrams of their
earlier values only make candidates that the comparison with their last values drops.

Edge cases: null values match no pattern, so they meet ``likeNone``; an empty pattern is in
every value that isn't null; a removed medium is an update with nulls in all columns.
``hash`` is a key without nulls; rows that repeat it in a build or an update are one medium
with the least of their values.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate, chain
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import children
from ..plans.sizes import narrow

BUCKETS, PARTS, PLACES = 32, 4, 32
#: Trigrams of a pattern whose media are intersected.
PICKED = 3
#: What names a medium's values in one version.
_NUMBER = ["v", "place", "id"]
#: Numbers that the lists of one step may reach over: offsets are short integers.
SPAN = 1 << 15
#: Entries of lists that a task holds before it hands them on.
HELD = 4_000_000


def _bucket(key: Column, buckets: int) -> Column:
    return (F.crc32(key.cast("binary")) % buckets).cast("int")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of numbers by column and trigram, from rows (place, id, lower-cased values); the lists of a step are of one place."""
    held: dict[tuple[str, str], list[int]] = {}
    place, first, entries = None, 0, 0

    def out() -> pa.RecordBatch:
        n = [len(x) for x in held.values()]
        offsets = pa.ListArray.from_arrays(pa.array([0, *accumulate(n)], pa.int32()), pa.array(chain.from_iterable(held.values()), pa.int16(), size=sum(n)))
        keys = [pa.array([k[i] for k in held], pa.string()) for i in range(2)]
        same = [pa.array([x] * len(n), t) for x, t in ((place, pa.int32()), (first, pa.int64()))]
        return pa.RecordBatch.from_arrays([*keys, *same, pa.array(n, pa.int32()), offsets], names=["column", "gram", "place", "first", "n", "offsets"])

    for batch in batches:
        names = batch.schema.names[2:]
        for at, id_, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != place or not 0 <= id_ - first < SPAN or entries > HELD:
                if held:
                    yield out()
                held, place, first, entries = {}, at, id_, 0
            offset = id_ - first
            for column, text in zip(names, texts, strict=True):
                grams = {text[i : i + 3] for i in range(len(text) - 2)} if text else ()
                entries += len(grams)
                for gram in grams:
                    held.setdefault((column, gram), []).append(offset)
    if held:
        yield out()


@dataclass(frozen=True)
class GramStore:
    spark: SparkSession
    root: str
    columns: tuple[str, ...]
    buckets: int = BUCKETS
    parts: int = PARTS
    places: int = PLACES

    @property
    def _values(self) -> str:
        return ", ".join(f"`{c}` string" for c in self.columns)

    def versions(self) -> list[int]:
        return sorted(int(name.removeprefix("v=")) for name in children(self.spark, f"{self.root}/ready"))

    def read(self, name: str, column: str = "", numbers: Sequence[int] | None = None) -> DataFrame:
        """All versions of a table; of ``column`` and of ``numbers``, its buckets or places, only those folders."""
        schema = {
            "grams": "gram string, place int, first long, n int, offsets array<short>, v int, column string, bucket int, part int",
            "counts": "gram string, n long, v int, column string, bucket int",
            "rows": f"id long, hash string, {self._values}, v int, place int",
        }[name]
        split = "place" if name == "rows" else "bucket"
        paths = []
        for v in self.versions():
            folder = f"{self.root}/{name}/v={v}" + (f"/column={column}" if column else "")
            folders = [x for x in children(self.spark, folder) if x.startswith((f"{split}=", "column="))]  # none in an empty table
            if numbers is not None:
                paths += [f"{folder}/{x}" for x in folders if int(x.split("=")[1]) in numbers]
            elif folders:
                paths.append(folder)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def current(self) -> DataFrame:
        """hash and the last values of each medium."""
        return self._last().select("hash", *self.columns)

    def _last(self, places: Sequence[int] | None = None) -> DataFrame:
        """The rows (v, place, id, hash, columns) of last values; only of the given places."""
        rows = self.read("rows", numbers=places)
        if len(self.versions()) > 1:
            rows = rows.groupBy("hash").agg(F.max_by(F.struct(*_NUMBER, *self.columns), "v").alias("_last")).select("hash", "_last.*")
        return rows.select(*_NUMBER, "hash", *self.columns)

    def add(self, media: DataFrame) -> None:
        """Media that are new or have changed, as a further version."""
        v = 1 + max((int(x.removeprefix("v=")) for x in children(self.spark, f"{self.root}/rows")), default=-1)
        path = lambda name: f"{self.root}/{name}/v={v}"
        write = lambda df, name, *split: df.write.option("compression", "zstd").partitionBy(*split).parquet(path(name))
        # a place is dealt in as many pieces as fill all partitions about evenly
        pieces = max(1, 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.places)
        placed = media.select("hash", *(F.col(c).cast("string").alias(c) for c in self.columns)).withColumn("place", _bucket(F.col("hash"), self.places))
        dealt = placed.withColumn("piece", F.pmod(F.xxhash64("hash"), F.lit(pieces))).repartition("place", "piece")
        rows = dealt.groupBy("place", "piece", "hash").agg(F.min(F.struct(*self.columns)).alias("_r")).select("place", "hash", "_r.*").sortWithinPartitions("place", "hash")
        # numbers that a repeated task could give otherwise are read from the files only
        write(rows.select(F.monotonically_increasing_id().alias("id"), "hash", *self.columns, "place"), "rows", "place")
        texts = self.spark.read.schema(f"id long, {self._values}, place int").parquet(path("rows")).select("place", "id", *(F.lower(c).alias(c) for c in self.columns))
        lists = texts.mapInArrow(_lists, "column string, gram string, place int, first long, n int, offsets array<short>")
        lists = lists.withColumns({"bucket": _bucket(F.col("gram"), self.buckets), "part": F.col("place") % self.parts}).repartition("column", "bucket", "part")
        write(lists.sortWithinPartitions("column", "bucket", "part", "gram", "place", "first"), "grams", "column", "bucket", "part")
        written = self.spark.read.schema("gram string, n int, column string, bucket int").parquet(path("grams"))
        counts = written.groupBy("column", "bucket", "gram").agg(F.sum("n").alias("n")).repartition("column", "bucket")
        write(counts.sortWithinPartitions("column", "bucket", "gram"), "counts", "column", "bucket")
        kind = "columns array<string>, buckets int, parts int, places int"
        sizes = self.spark.createDataFrame([(list(self.columns), self.buckets, self.parts, self.places)], kind)
        sizes.coalesce(1).write.parquet(path("ready"))

    def _having(self, column: str, grams: set[str]) -> DataFrame | None:
        """Numbers of the media that have all of the rarest of the trigrams, by version; None if a trigram is nowhere."""
        numbers = {zlib.crc32(g.encode()) % self.buckets for g in grams}
        known = self.read("counts", column, numbers).filter(F.col("gram").isin(sorted(grams)))
        counts = {r["gram"]: r["n"] for r in known.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # one row per trigram of a pattern
        if len(counts) < len(grams):
            return None
        rarest = sorted(grams, key=lambda g: (counts[g], g))[:PICKED]
        hits = self.read("grams", column, {zlib.crc32(g.encode()) % self.buckets for g in rarest}).filter(F.col("gram").isin(rarest))
        which = reduce(lambda c, k: F.when(F.col("gram") == rarest[k], F.lit(1 << k)).otherwise(c), range(1, len(rarest)), F.lit(1))
        numbered = hits.select("v", "place", "first", which.alias("_has"), F.explode("offsets").alias("_at")).select("v", "place", (F.col("first") + F.col("_at")).alias("id"), "_has")
        if len(rarest) > 1:  # a list names a medium once
            numbered = numbered.groupBy(*_NUMBER).agg(F.bit_or("_has").alias("_all")).filter(F.col("_all") == (1 << len(rarest)) - 1)
        return numbered.select(*_NUMBER)

    def _candidates(self, column: str, patterns: Sequence[str]) -> DataFrame | None:
        """Numbers of media that may hold one of the patterns; None for all media."""
        out = self.spark.createDataFrame([], "v int, place int, id long")
        for pattern in patterns:
            grams = {pattern[i : i + 3] for i in range(len(pattern) - 2)}
            if not grams:
                return None
            had = self._having(column, grams)
            out = out if had is None else out.union(had)
        return out

    def find(self, column: str, want: dict[str, Any]) -> DataFrame:
        """hash of the media whose values meet ``likeAny`` and ``likeAll``, each if it isn't empty."""
        lower = {k: sorted({p.lower() for p in want.get(k) or []}) for k in ("likeAny", "likeAll")}
        groups = [x for x in (lower["likeAny"], *([p] for p in lower["likeAll"])) if x]
        lists = [x for x in (self._candidates(column, g) for g in groups) if x is not None]
        rows = self._last()
        if lists:
            both = reduce(lambda a, b: a.join(b, _NUMBER, "left_semi"), lists).distinct()
            few = narrow(both, "gram-candidates")
            opened = [r["place"] for r in few.select("place").distinct().collect()]  # at most ``places`` numbers
            rows = self._last(opened).join(few, _NUMBER, "left_semi")
        has = lambda p: F.contains(F.lower(column), F.lit(p))
        for g in groups:
            rows = rows.filter(reduce(lambda a, b: a | b, map(has, g)))
        return rows.select("hash")


def like_filter(media: DataFrame, store: GramStore, column: str, want: dict[str, Any]) -> DataFrame:
    """C10, C11 of media in the state that the index has, by semi and anti joins on hash."""
    if want.get("likeAny") or want.get("likeAll"):
        media = media.join(narrow(store.find(column, want), "gram-found"), "hash", "left_semi")
    if want.get("likeNone"):
        media = media.join(narrow(store.find(column, {"likeAny": want["likeNone"]}), "gram-found"), "hash", "left_anti")
    return media


def build(media: DataFrame, root: str, columns: Sequence[str] = ("path", "title"), buckets: int = BUCKETS, parts: int = PARTS, places: int = PLACES) -> GramStore:
    """Index of ``media`` (hash, columns) in the empty folder ``root``."""
    out = GramStore(media.sparkSession, root, tuple(columns), buckets, parts, places)
    out.add(media)
    return out


def reopen(spark: SparkSession, root: str) -> GramStore:
    sizes = spark.read.parquet(f"{root}/ready").select("columns", "buckets", "parts", "places").first()
    return GramStore(spark, root, tuple(sizes[0]), *sizes[1:])
