"""A stored token index with rating sums (D2-D4, F1-F4), as tables that a query prunes.

Tables under one folder, each in versions
    forward/v/part      (id, range, hash, value, votes, tokens, weights): a row per medium, clustered by hash. ``id`` is
                        its number in the version, ``range`` one of ``ranges`` ranges of hashes, ``value`` the
                        sum of its ``votes`` ratings, one or none
    postings/v/bucket   (token, range, id, weight, value, votes), clustered by token; the rows of a token in a range
                        are a block. Numbers in order take a few bytes, where hashes would take most of the index
    dictionary/v/bucket (token, top, n, frequent): greatest weight and number of rows of a token
    blocks/v/bucket     (token, range, top, n): the same of each block of a frequent token
    sums/v              (token, total, n): ratings of the token's media, as signed changes
    touched/v           (hash): media whose rows of earlier versions don't count any more
    ready/v             written last; a version without it doesn't exist

A query opens only the buckets of its tokens, and in their files the row groups and pages
of its tokens. With a limit it takes ranges by the greatest score that their blocks allow,
and ends when no range left can reach the last of its best rows; what it reads of a range
it scores exactly. An update adds a version: its media's new rows, and the differences of
the sums, which need only the old and the new rows of those media. Sums of all versions
are the sums of a new index. ``compact`` writes a new base.

An index of kind ``words`` holds the words of keyword search (D6, D7) instead of weighted
tokens: it names the media that have all words of a phrase, and only their texts are read
for the phrase itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import STOP_WORDS, phrase_text, tokenise
from ..plans.fixtures import Library
from ..plans.lineage import exists, settled, stamp
from ..plans.sizes import narrow
from .text import lists_of, no_value, token_fields, weighed

BUCKETS, RANGES = 32, 1024
#: Tokens with fewer rows have no blocks of their own.
FREQUENT = 4096
#: Rows of the first step of a limited query, about; each further step takes twice as many.
STEP_ROWS = 4_000_000
#: Limited queries keep so many best rows on the driver at most; larger limits sort all rows instead.
DRIVER_ROWS = 10_000
#: Touched media are broadcast up to this many.
BROADCAST_TOUCHED = 500_000

#: Bytes of the forward table, of which a posting takes about as many, for each task that sorts postings.
TASK_BYTES = 8 << 20

_SCHEMAS = {
    "forward": "id long, range int, hash string, value double, votes long, tokens array<string>, weights array<long>, v int, part int",
    "postings": "token string, range int, id long, weight long, value double, votes long, v int, bucket int",
    "dictionary": "token string, top long, n long, frequent boolean, v int, bucket int", "blocks": "token string, range int, top long, n long, v int, bucket int",
    "sums": "token string, total double, n long, v int", "touched": "hash string, v int",
}
_SPLIT = {"forward": "part", "postings": "bucket", "dictionary": "bucket", "blocks": "bucket"}


@dataclass(frozen=True)
class TokenStore:
    """An index under ``root`` with its versions."""

    spark: SparkSession
    root: str
    versions: tuple[int, ...]
    buckets: int = BUCKETS
    ranges: int = RANGES
    stop_words: frozenset[str] = STOP_WORDS
    kind: str = "tokens"

    def read(self, name: str, split: list[int] | None = None) -> DataFrame:
        """A table's rows of all versions; only of the given buckets or parts. Postings have their hashes."""
        return self.named(self.stored(name, split)) if name == "postings" else self.stored(name, split)

    def named(self, rows: DataFrame, ranges: list[int] | None = None) -> DataFrame:
        """Rows (v, id, ...), all of ``ranges`` if they are given, with their hash."""
        names = self.stored("forward", None if ranges is None else sorted({r % self.buckets for r in ranges}))
        if ranges is not None:
            names = names.filter(F.col("range").isin(ranges))
        return rows.join(names.select("v", "id", "hash"), ["v", "id"]).drop("id")

    def stored(self, name: str, split: list[int] | None = None) -> DataFrame:
        """read() without hashes of postings."""
        paths = [f"{self.root}/{name}/v={v}" for v in self.versions]
        if split is not None:
            paths = [f"{p}/{_SPLIT[name]}={k}" for p in paths for k in split]
        paths = [p for p in paths if exists(self.spark, p)]
        if not paths:
            return self.spark.createDataFrame([], _SCHEMAS[name])
        return self.spark.read.schema(_SCHEMAS[name]).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def last_touched(self) -> DataFrame | None:
        """(hash, last): the last version that replaced a medium's rows; None if none did."""
        if len(self.versions) < 2:
            return None
        rows = settled(self.read("touched").groupBy("hash").agg(F.max("v").alias("last")), "touched")
        return F.broadcast(rows) if rows.count() <= BROADCAST_TOUCHED else rows

    def valid(self, rows: DataFrame, touched: DataFrame | None) -> DataFrame:
        """Rows (hash, v, ...) that no later version replaced."""
        if touched is None:
            return rows.drop("v")
        return rows.join(touched, "hash", "left").filter(F.col("last").isNull() | (F.col("v") >= F.col("last"))).drop("v", "last")

    def rows(self, parts: list[int] | None = None) -> DataFrame:
        """The index, (hash, token, weight), in clusters of hashes."""
        pairs = F.explode(F.arrays_zip("tokens", "weights")).alias("t")
        return self.media(parts).select("hash", pairs).select("hash", F.col("t.tokens").alias("token"), F.col("t.weights").alias("weight"))

    def media(self, parts: list[int] | None = None) -> DataFrame:
        """(hash, value, votes, tokens, weights): the index with a row per medium."""
        return self.valid(self.stored("forward", parts), self.last_touched()).select("hash", "value", "votes", "tokens", "weights")

    def sums(self) -> DataFrame:
        """(token, total, n) of rated media."""
        return self.read("sums").groupBy("token").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).filter("n > 0")


def _range(store: TokenStore) -> Column:
    return F.pmod(F.xxhash64("hash"), F.lit(store.ranges)).cast("int")


def _bucket(store: TokenStore, token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(store.buckets)).cast("int")


def _write(store: TokenStore, v: int, media: DataFrame, before: DataFrame | None, touched: DataFrame | None) -> TokenStore:
    """One version: rows (hash, value, votes, tokens, weights), and ``before``: sums (token, total, n) that go."""
    spark = store.spark
    path = lambda name: f"{store.root}/{name}/v={v}"
    write = lambda df, name: df.write.option("compression", "zstd").partitionBy(_SPLIT[name]).parquet(path(name))
    new = replace(store, versions=(*store.versions, v))
    only = replace(store, versions=(v,))
    rows = media.withColumn("range", _range(store)).withColumn("part", F.col("range") % store.buckets).sortWithinPartitions("part", "range", "hash")
    # numbers that a repeated task could give otherwise are read from the files only
    write(rows.select(F.monotonically_increasing_id().alias("id"), "range", "hash", "value", "votes", "tokens", "weights", "part"), "forward")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), stamp(spark, path("forward"))[0] // TASK_BYTES)
    by_token = ["bucket", "token", "range", "id"]
    pairs = only.stored("forward").select("range", "id", "value", "votes", F.explode(F.arrays_zip("tokens", "weights")).alias("t"))
    rows = pairs.select(F.col("t.tokens").alias("token"), "range", "id", F.col("t.weights").alias("weight"), "value", "votes", _bucket(store, F.col("t.tokens")).alias("bucket"))
    write(rows.repartitionByRange(n, *by_token).sortWithinPartitions(*by_token), "postings")
    postings = only.stored("postings")
    few = lambda df, *order: df.withColumn("bucket", _bucket(store, F.col("token"))).repartition("bucket").sortWithinPartitions("bucket", *order)
    # tokens stand together in the postings, so partial results are few
    words = postings.groupBy("token").agg(F.max("weight").alias("top"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum("votes").alias("rated"))
    words = settled(words.withColumn("frequent", F.col("n") >= FREQUENT), "words")
    write(few(words.select("token", "top", "n", "frequent"), "token"), "dictionary")
    frequent = narrow(only.read("dictionary").filter("frequent").select("token"), "frequent")
    blocks = postings.join(frequent, "token", "left_semi").groupBy("token", "range").agg(F.max("weight").alias("top"), F.count(F.lit(1)).alias("n"))
    write(few(blocks, "token", "range"), "blocks")
    sums = words.filter("rated > 0").select("token", "total", F.col("rated").alias("n"))
    if before is not None:
        gone = before.select("token", -F.col("total"), -F.col("n"))
        sums = sums.unionAll(gone).groupBy("token").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).filter("n <> 0 or total <> 0")
    sums.write.parquet(path("sums"))
    if touched is not None:
        touched.write.parquet(path("touched"))
    spark.range(1).write.parquet(path("ready"))
    return new


def word_fields(lib: Library) -> DataFrame:
    """(hash, value, fields) as of ``text.token_fields``: the words of all fields that keyword search looks at, each with weight 1, as no count is asked for."""
    def one(texts: Column) -> Column:
        # what stands between words goes, so all texts of a row are one
        words = F.trim(phrase_text(F.array_join(texts, " ")))
        return F.array(F.struct(F.lit(1).alias("weight"), F.lit(0).alias("least"), words.alias("words"))).alias("fields")

    texts = F.array(*(F.col(c) for c in ("hash", "path", "type", "artist", "album", "title")))
    if "auto_tags" in lib.media.columns:
        texts = F.concat(texts, F.coalesce("auto_tags", F.array().cast("array<string>")))
    rows = lib.media.select("hash", no_value(), one(texts))
    for bridge, c in ((lists_of(lib), "words"), (lib.media_actors.select("media_hash", F.array("actor_id").alias("words")), "words")):
        rows = rows.unionByName(bridge.select(F.col("media_hash").alias("hash"), no_value(), one(F.col(c))))
    return rows


def _indexed(store: TokenStore, lib: Library) -> DataFrame:
    """A library's rows (hash, value, votes, tokens, weights)."""
    return weighed(word_fields(lib) if store.kind == "words" else token_fields(lib, store.stop_words, rated=True))


def build(lib: Library, root: str, stop_words: frozenset[str] = STOP_WORDS, buckets: int = BUCKETS, ranges: int = RANGES, kind: str = "tokens") -> TokenStore:
    """A new index of a library in the empty folder ``root``."""
    store = TokenStore(lib.media.sparkSession, root, (), buckets, ranges, stop_words, kind)
    return _write(store, 0, _indexed(store, lib), None, None)


def reopen(spark: SparkSession, root: str, **options) -> TokenStore:
    """The index under ``root`` with the versions that were written to their end."""
    versions, v = [], 0
    while exists(spark, f"{root}/touched/v={v}") or exists(spark, f"{root}/ready/v={v}"):
        if exists(spark, f"{root}/ready/v={v}/_SUCCESS"):
            versions.append(v)
        v += 1
    return TokenStore(spark, root, tuple(versions), **options)


def of_media(lib: Library, hashes: DataFrame) -> Library:
    """The part of a library that belongs to the media ``hashes`` (hash)."""
    keep = lambda df, c: df.join(hashes.select(F.col("hash").alias(c)), c, "left_semi")
    return Library(keep(lib.media, "hash"), keep(lib.media_tags, "media_hash"), keep(lib.media_actors, "media_hash"), keep(lib.media_playlists, "media_hash"), None if lib.tag_lists is None else keep(lib.tag_lists, "media_hash"))


def update(store: TokenStore, lib: Library, hashes: DataFrame) -> TokenStore:
    """A version in which the media ``hashes`` (hash) are as ``lib`` has them now: changed, new or, if it lacks them, gone."""
    hashes = settled(hashes.select("hash").distinct(), "touched")
    few = F.broadcast(hashes) if hashes.count() <= BROADCAST_TOUCHED else hashes
    # no more parts than the index has buckets
    parts = [r[0] for r in hashes.select((_range(store) % store.buckets).alias("p")).distinct().collect()]
    old = store.media(parts).join(few, "hash", "left_semi").filter("votes > 0").select("value", "votes", F.explode("tokens").alias("token"))
    before = settled(old.groupBy("token").agg(F.sum("value").alias("total"), F.sum("votes").alias("n")), "old-sums")
    return _write(store, max(store.versions) + 1, _indexed(store, of_media(lib, few)), before, hashes)


def compact(store: TokenStore, root: str) -> TokenStore:
    """The index as one version in the empty folder ``root``; the old folder is the caller's to delete."""
    rows = store.media().repartition("hash")
    return _write(replace(store, root=root, versions=()), 0, rows, None, None)


def query_words(store: TokenStore, query: str) -> tuple[dict[str, int], list[int]]:
    """How often a query has each of its tokens, and the buckets that hold them."""
    words = store.spark.range(1).select(F.explode(tokenise(F.lit(query), store.stop_words)).alias("t"))
    found = words.select("t", _bucket(store, F.col("t")).alias("b")).collect()  # the words of one query are few
    return dict(Counter(r["t"] for r in found)), sorted({r["b"] for r in found})


def _in_order(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("score"), "hash")


def weighted_query(store: TokenStore, query: str, limit: int | None = None, step_rows: int = STEP_ROWS) -> DataFrame:
    """(hash, score) by falling score, as text.weighted_query, from the blocks of the query's tokens."""
    spark = store.spark
    times, buckets = query_words(store, query)
    if not times:
        return spark.createDataFrame([], "hash string, score long")
    of_query = F.col("token").isin(list(times))
    touched = store.last_touched()
    counted = F.create_map(*[F.lit(x) for pair in times.items() for x in pair])
    postings = store.stored("postings", buckets).filter(of_query)

    def scored(rows: DataFrame, ranges: list[int] | None = None) -> DataFrame:
        found = rows.groupBy("v", "id").agg(F.sum(F.col("weight") * counted[F.col("token")]).cast("long").alias("score")).filter("score > 0")
        return store.valid(store.named(found, ranges).select("hash", "score", "v"), touched)

    if not limit or limit > DRIVER_ROWS:
        ordered = _in_order(scored(postings))
        return ordered.limit(limit) if limit else ordered
    words = store.read("dictionary", buckets).filter(of_query).collect()  # one row for each token and version
    if sum(r["n"] for r in words) <= step_rows:
        return _in_order(scored(postings)).limit(limit)
    best: list[tuple[str, int]] = []
    for ranges in _steps(store, times, buckets, words, step_rows):
        bound, numbers = ranges
        if len(best) == limit and bound < best[-1][1]:
            break
        found = _in_order(scored(postings.filter(F.col("range").isin(numbers)), numbers)).limit(limit).collect()
        best = sorted([*best, *map(tuple, found)], key=lambda r: (-r[1], r[0]))[:limit]
    return _in_order(spark.createDataFrame(best, "hash string, score long"))


def _steps(store: TokenStore, times: dict[str, int], buckets: list[int], words: list, step_rows: int) -> list[tuple[int, list[int]]]:
    """(greatest score in the step, its ranges), best first; a score in a range is at most the sum of its blocks' greatest weights."""
    blocks = store.read("blocks", buckets).filter(F.col("token").isin(list(times))).groupBy("range", "token").agg(F.max("top").alias("top"), F.sum("n").alias("n"))
    tops, rows = {r: Counter() for r in range(store.ranges)}, Counter()
    for b in blocks.collect():  # at most one row for each range and token
        tops[b["range"]][b["token"]] = b["top"]
        rows[b["range"]] += b["n"]
    for w in words:
        if not w["frequent"]:  # it may be in any range
            for r in tops:
                tops[r][w["token"]] = max(tops[r][w["token"]], w["top"])
                rows[r] += w["n"] / store.ranges
    bounds = sorted(((sum(times[t] * top for t, top in c.items()), r) for r, c in tops.items() if c), reverse=True)
    out: list[tuple[int, list[int]]] = []
    held, wanted = 0, step_rows
    for bound, r in bounds:
        if not out or held >= wanted:
            if out:
                wanted *= 2
            out.append((bound, []))
            held = 0
        out[-1][1].append(r)
        held += rows[r]
    return out


def token_averages(store: TokenStore, minimum_count: int = 20, least_average: float = 0.1) -> DataFrame:
    """(token, average, count) from the stored sums."""
    per = store.sums().select("token", (F.col("total") / F.col("n")).alias("average"), F.col("n").alias("count"))
    return per.filter((F.col("count") >= minimum_count) & (F.abs("average") >= least_average))


def holding(store: TokenStore, phrases: Sequence[str]) -> DataFrame:
    """(hash) of media that have all words of one of ``phrases`` (words between single spaces), from an index of words."""
    spark = store.spark
    words = sorted({w for p in phrases for w in p.split(" ")})
    if not words:
        return spark.createDataFrame([], "hash string")
    # the words of one query are few
    buckets = [r[0] for r in spark.createDataFrame([(w,) for w in words], "t string").select(_bucket(store, F.col("t"))).distinct().collect()]
    rows = store.stored("postings", buckets).filter(F.col("token").isin(words))
    named = store.valid(store.named(rows.select("v", "id", "token")), store.last_touched())
    have = named.groupBy("hash").agg(F.collect_set("token").alias("_have"))
    all_of = lambda p: reduce(lambda a, b: a & b, [F.array_contains("_have", w) for w in p.split(" ")])
    return have.filter(reduce(lambda a, b: a | b, [all_of(p) for p in phrases])).select("hash")


def library_of(lib: Library, phrases: Sequence[str], store: TokenStore) -> Library:
    """The part of a library in which ``phrases`` may stand; few media shuffle none of it."""
    return of_media(lib, narrow(holding(store, phrases), "candidates"))
