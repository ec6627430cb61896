"""Library dumps as JSON (A2, A3): the nested camelCase records that media servers exchange, and flat tables.

A dump is one JSON record of tags, actors, media, playlists and deleted media. A
library of any size is written either as one folder of JSON lines per part
(``export``), or as one record in pieces: the files of ``export_record``, put one after
another in order of their names, are the record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.insights import details
from ..operators.playlists import ordered
from ..plans.fixtures import Library
from ..plans.lineage import settled
from ..plans.sizes import narrow
from . import record

VERSION = 4
#: Fields of media and of their metadata, by the column of the flat table; given, never inferred.
MEDIA = {
    "hash": ("hash", "string"), "path": ("path", "string"), "dir": ("dir", "string"), "rotation": ("rotation", "int"), "type": ("type", "string"),
    "hash_date": ("hashDate", "bigint"), "corrupted": ("corrupted", "boolean"), "thumbnail": ("thumbnail", "boolean"),
    "thumbnail_optimised": ("thumbnailOptimised", "boolean"), "preview": ("preview", "boolean"), "preview_optimised": ("previewOptimised", "boolean"),
    "rating": ("rating", "int"), "phash": ("phash", "string"), "duplicate_of": ("duplicateOf", "string"), "clone_date": ("cloneDate", "bigint"),
    "clones": ("clones", "array<string>"), "unrelated": ("unrelated", "array<string>"), "auto_tags": ("autoTags", "array<string>"),
}
METADATA = {
    "width": ("width", "int"), "height": ("height", "int"), "length": ("length", "double"), "artist": ("artist", "string"), "album": ("album", "string"),
    "title": ("title", "string"), "created_at": ("createdAt", "bigint"), "codec": ("codec", "string"), "quality_cache": ("qualityCache", "array<int>"),
    "max_copy": ("maxCopy", "boolean"), "segments": ("segments", "struct<standard:array<struct<start:double,end:double>>>"),
}
_LISTS = {"tags": "array<string>", "actors": "array<string>", "playlists": "array<struct<id:string,order:int>>"}


_METADATA = f"struct<{','.join(f'{name}:{kind}' for name, kind in METADATA.values())}>"
#: The fields of each part's elements; tags and actors are texts.
FIELDS = {
    "media": [*MEDIA.values(), ("metadata", _METADATA), *_LISTS.items()],
    "playlists": [("id", "string"), ("name", "string"), ("thumbnail", "string"), ("size", "bigint"), ("hashes", "array<string>")],
    "deleted": [("hash", "string"), ("path", "string")],
}
PARTS = ("media", "playlists", "deleted", "tags", "actors")


def _element(part: str) -> str:
    return f"struct<{','.join(f'{name}:{kind}' for name, kind in FIELDS[part])}>" if part in FIELDS else "string"


DUMP = "version int, " + ", ".join(f"{part} array<{_element(part)}>" for part in PARTS)


def nested(media: DataFrame) -> DataFrame:
    """Flat media, with tags, actors and playlists if there, as records. Columns that are missing are unset."""
    def fields(columns: dict[str, tuple[str, str]]) -> list[Column]:
        return [(F.col(c) if c in media.columns else F.lit(None)).cast(kind).alias(name) for c, (name, kind) in columns.items()]

    known = [F.col(c).isNotNull() for c in METADATA if c in media.columns]
    any_known = known[0] if known else F.lit(False)
    for k in known[1:]:
        any_known |= k
    lists = [F.col(c) for c in _LISTS if c in media.columns]
    return media.select(*fields(MEDIA), F.when(any_known, F.struct(*fields(METADATA))).alias("metadata"), *lists)


def flat(records: DataFrame) -> DataFrame:
    """Media records as a flat table, with tags and actors."""
    own = [F.col(name).cast(kind).alias(c) for c, (name, kind) in MEDIA.items()]
    more = [F.col("metadata")[name].cast(kind).alias(c) for c, (name, kind) in METADATA.items() if c != "length"]
    length = F.ceil(F.col("metadata")["length"]).cast("int").alias("length")
    return records.select(*own, *more, length, "tags", "actors")


def records(lib: Library, playlists: DataFrame, deleted: DataFrame) -> dict[str, DataFrame]:
    """The parts of a dump, one row per element."""
    lists = ordered(lib.media_playlists).withColumnRenamed("playlist_id", "id")
    hashes = F.coalesce("hashes", F.array().cast("array<string>")).alias("hashes")
    kept = playlists.drop("size").join(lists, "id", "left").select("id", "name", "thumbnail", F.size(hashes).cast("long").alias("size"), hashes)
    words = {name: bridge.select(F.col(c).alias("id")).distinct() for name, bridge, c in (("tags", lib.media_tags, "tag_id"), ("actors", lib.media_actors, "actor_id"))}
    return {"media": nested(details(lib).drop("absolute_path")), "playlists": kept, "deleted": deleted.select("hash", "path"), **words}


def export(lib: Library, playlists: DataFrame, deleted: DataFrame, path: str, compression: str = "none") -> None:
    """A3: one folder of JSON lines per part; media carry their tags, actors and playlists, playlists their ordered hashes."""
    for name, part in records(lib, playlists, deleted).items():
        part.write.mode("overwrite").option("compression", compression).json(f"{path}/{name}")


def export_record(lib: Library, playlists: DataFrame, deleted: DataFrame, path: str) -> None:
    """A3: one JSON record of the whole library in pieces, which are its text in order of their names."""
    spark = lib.media.sparkSession
    own = []
    for at, (name, part) in enumerate(records(lib, playlists, deleted).items()):
        one = F.to_json(F.array("id"))  # a text is written as a list of one, without its brackets
        text = F.to_json(F.struct("*")) if name in FIELDS else one.substr(F.lit(2), F.length(one) - 2)
        key = F.col(part.columns[0]).cast("string")
        own.append(part.select(F.lit(2 * at + 1).alias("at"), key.alias("key"), text.alias("line")))
    # the first line of each part has no comma before it: the least key is found by keys alone, then its line
    first = []
    for lines in own:
        least = lines.select("key").distinct().agg(F.min("key"), F.max(F.col("key").isNull())).first()
        same = F.col("key").isNull() if least[1] else F.col("key") == F.lit(least[0])
        first.append(lines.filter(same).groupBy("at").agg(F.min(F.struct("key", "line")).alias("first")))
    first = settled(reduce(DataFrame.unionByName, first), "dump-first-lines")  # one row per part
    heads = [(2 * at, "", (f'{{"version":{VERSION},' if not at else "],") + f'"{name}":[') for at, name in enumerate(PARTS)] + [(2 * len(PARTS), "", "]}")]
    both = reduce(DataFrame.unionByName, own).unionByName(spark.createDataFrame(heads, "at int, key string, line string"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # lines are exchanged once and never stored in between; equal ones stand side by side in one range
    again = F.row_number().over(Window.partitionBy("at", "key", "line").orderBy("line"))
    lines = both.repartitionByRange(n, "at", "key", "line").withColumn("again", again).filter("again = 1")
    lines = lines.join(F.broadcast(first), "at", "left").sortWithinPartitions("at", "key", "line")
    # a head is first in its own place
    bare = F.coalesce(F.struct("key", "line") == F.col("first"), F.col("at") % 2 == 0)
    lines.select(F.when(bare, F.col("line")).otherwise(F.concat(F.lit(","), "line")).alias("line")).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A2 for dumps of export()."""
    ddl = {part: ", ".join(f"{name} {kind}" for name, kind in FIELDS.get(part, [("id", "string")])) for part in PARTS}
    return split_tables({part: spark.read.schema(ddl[part]).json(f"{path}/{part}") for part in PARTS}, look=True)


def load_single(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A2 for a dump that is one nested JSON record; parts that it lacks are empty."""
    one = spark.read.schema(DUMP).option("multiLine", True).json(path)
    return split_tables({part: one.select(F.explode(part).alias("id")).select("id.*" if part in FIELDS else "id") for part in PARTS})


def load_record(spark: SparkSession, path: str, block: int = record.BLOCK) -> dict[str, DataFrame]:
    """A2 for one nested JSON record of any length, in a file or in pieces as of export_record(): its elements are found and read by many tasks.

    Gives the tables of load_single(); an element that is no JSON of its part is a row of
    nulls, where load_single() loses the whole record.
    """
    found = record.find(spark, path, block)

    def part(name: str) -> DataFrame:
        wrapped = F.from_json(F.concat(F.lit('{"id":'), "element", F.lit("}")), f"id {_element(name)}")["id"].alias("id")
        return found.elements(name).select(wrapped).select("id.*" if name in FIELDS else "id")

    return split_tables({name: part(name) for name in PARTS})


def split_tables(parts: dict[str, DataFrame], look: bool = False) -> dict[str, DataFrame]:
    """Tables of the parts of a dump. With ``look`` a run over the records finds hashes that repeat, so that lists of all others are not exchanged."""
    media = flat(parts["media"])
    again = narrow(media.groupBy("hash").count().filter("count > 1").select(F.col("hash").alias("again")), "repeated") if look else None

    def bridge(c: str, name: str) -> DataFrame:
        """Rows of a list; the lists of records that repeat a hash are united, so lists are exchanged, not their rows."""
        lists = media.filter(F.size(c) > 0).select("hash", F.array_distinct(c).alias("words"))
        united = lambda df: df.groupBy("hash").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
        if again is None:
            lists = united(lists)
        else:
            same = F.col("hash").eqNullSafe(F.col("again"))
            lists = lists.join(again, same, "left_anti").unionByName(united(lists.join(again, same, "left_semi")))
        return lists.select(F.col("hash").alias("media_hash"), F.explode("words").alias(name))

    entries = parts["playlists"].select(F.col("id").alias("playlist_id"), F.posexplode("hashes").alias("position", "media_hash"))
    size = F.size(F.coalesce("hashes", F.array().cast("array<string>"))).cast("long").alias("size")
    return {
        "media": media.drop("tags", "actors"), "media_tags": bridge("tags", "tag_id"), "media_actors": bridge("actors", "actor_id"),
        "playlists": parts["playlists"].select("id", "name", "thumbnail", size), "media_playlists": entries.select("media_hash", "playlist_id", "position"),
        "media_deleted": parts["deleted"], "tags": parts["tags"], "actors": parts["actors"],
    }
