"""A media library derived from the test tables, as Spark views and as DuckDB expressions of the same SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import exists, new_folder, stamp

_SPARK = {
    "s": "string", "sha": "sha2(text, 256)", "ints": "array", "none": "cast(array() as array<int>)",
    "words": "explode(array_distinct(split(lower(text), ' ')))", "strings": "array",
}
_DUCK = {
    "s": "varchar", "sha": "sha256(text)", "ints": "list_value", "none": "cast([] as integer[])",
    "words": "unnest(list_distinct(string_split(lower(text), ' ')))", "strings": "list_value",
}

VIEWS = {
    "media": """
      SELECT md5(cast(d.doc_id AS {s})) AS hash,
        concat(lang, '/', source, '/', cast(d.doc_id AS {s}), CASE d.doc_id % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.gif' WHEN 2 THEN '.jpg' ELSE '.PNG' END) AS path,
        concat(lang, '/', source) AS dir,
        CASE d.doc_id % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'gif' ELSE 'still' END AS type,
        1700000000 + 60 * d.doc_id AS hash_date,
        cast(CASE WHEN l.doc_id IS NOT NULL THEN 1 + 2 * quality + 2 - 2 * toxic - CASE WHEN d.doc_id % 3 = 0 THEN 1 ELSE 0 END END AS int) AS rating,
        CASE d.doc_id % 20 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS corrupted,
        CASE WHEN d.doc_id % 4 >= 2 AND d.doc_id % 24 <> 2 THEN concat(substr({sha}, 1, 63), cast(d.doc_id % 4 AS {s})) END AS phash,
        cast(NULL AS {s}) AS duplicate_of,
        d.doc_id % 3 > 0 AS thumbnail,
        CASE WHEN d.doc_id % 3 > 0 THEN d.doc_id % 2 = 0 END AS thumbnail_optimised,
        CASE WHEN d.doc_id % 4 = 0 THEN d.doc_id % 8 = 0 END AS preview,
        CASE WHEN d.doc_id % 8 = 0 THEN d.doc_id % 16 = 0 END AS preview_optimised,
        cast(CASE d.doc_id % 6 WHEN 1 THEN 90 WHEN 2 THEN 180 ELSE 0 END AS int) AS rotation,
        CASE WHEN d.doc_id % 4 >= 2 AND d.doc_id % 3 = 0 THEN {strings}(concat('auto-', source), 'sky') END AS auto_tags,
        CASE WHEN d.doc_id % 4 = 0 THEN d.doc_id % 12 = 0 END AS max_copy,
        CASE WHEN d.doc_id % 4 = 0 THEN 'h264' END AS codec,
        cast(CASE WHEN d.doc_id % 50 <> 7 THEN CASE d.doc_id % 5 WHEN 0 THEN 426 WHEN 1 THEN 853 WHEN 2 THEN 1280 WHEN 3 THEN 1920 ELSE 3840 END END AS int) AS width,
        cast(CASE WHEN d.doc_id % 50 <> 7 THEN CASE d.doc_id % 5 WHEN 0 THEN 240 WHEN 1 THEN 480 WHEN 2 THEN 720 WHEN 3 THEN 1080 ELSE 2160 END END AS int) AS height,
        cast(CASE WHEN d.doc_id % 50 <> 7 AND d.doc_id % 4 = 0 THEN n_chars END AS int) AS length,
        CASE WHEN d.doc_id % 50 <> 7 AND d.doc_id % 7 <> 0 THEN source END AS artist,
        CASE WHEN d.doc_id % 50 <> 7 THEN lang END AS album,
        CASE WHEN d.doc_id % 50 <> 7 THEN text END AS title,
        CASE WHEN d.doc_id % 50 <> 7 AND d.doc_id % 11 <> 0 THEN 1700000000 + 60 * d.doc_id END AS created_at,
        CASE WHEN d.doc_id % 50 <> 7 AND d.doc_id % 4 = 0 THEN CASE d.doc_id % 3 WHEN 0 THEN {none} WHEN 1 THEN {ints}(240) ELSE {ints}(240, 480) END END AS quality_cache
      FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "media_tags": "SELECT DISTINCT media_hash, tag_id FROM (SELECT md5(cast(doc_id AS {s})) AS media_hash, {words} AS tag_id FROM {documents}) t WHERE length(tag_id) > 1",
    "media_actors": "SELECT md5(cast(doc_id AS {s})) AS media_hash, concat('actor ', cast(doc_id % 97 AS {s})) AS actor_id FROM {documents} WHERE doc_id % 3 = 0",
    "media_playlists": "SELECT md5(cast(conv_id * 10 + turn AS {s})) AS media_hash, concat('pl-', cast(conv_id AS {s})) AS playlist_id, cast(turn AS int) AS position FROM {conversations}",
    "media_deleted": "SELECT md5(cast(d.doc_id AS {s})) AS hash, concat(lang, '/', source, '/', cast(d.doc_id AS {s}), '.gone') AS path FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE toxic = 1",
    "listing": """
      SELECT concat(lang, '/', source, '/', cast(doc_id AS {s}), CASE doc_id % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.gif' WHEN 2 THEN '.jpg' ELSE '.PNG' END) AS path FROM {documents} WHERE doc_id % 10 <> 3
      UNION ALL SELECT concat('pages/', cast(page_id AS {s}), '.jpg') FROM {pages}
      UNION ALL SELECT concat('pages/', cast(page_id AS {s}), '.txt') FROM {pages}""",
}
_TABLES = ("documents", "labels", "conversations", "pages", "events", "embeddings")


def spark_view(spark: SparkSession, sf_dir: str, name: str, unused: tuple[str, ...] = ()) -> DataFrame:
    """The view as a lazy DataFrame; the tables come as parameters, so no name is registered.

    ``unused`` are tables of outer joins that give none of the columns which the caller takes: the joins,
    which would exchange whole texts where such a table is not broadcast, go from the plan.
    """
    if name == "media_tags":
        return spark_tags(spark, sf_dir)[0]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if "{" + t + "}" in VIEWS[name]}
    if "documents" in used:
        used["documents"] = _dealt(used["documents"], "doc_id")
    used |= {t: used[t].filter(F.lit(False)) for t in unused}
    return spark.sql(VIEWS[name].format(**_SPARK, **{t: "{" + t + "}" for t in _TABLES}), **used)


_REPEATED: dict[tuple, str | None] = {}


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """(doc_id) of ids that several documents have, by one exchange of ids; None if there are none. Found once for a session and a state of the table."""
    path = f"{sf_dir}/documents.parquet"
    key = (spark.sparkContext.applicationId, path, stamp(spark, path))
    if key not in _REPEATED or _REPEATED[key] and not exists(spark, _REPEATED[key]):
        found = new_folder(spark, "repeated-ids")
        spark.read.parquet(path).groupBy("doc_id").count().filter("count > 1").select("doc_id").write.parquet(found)
        _REPEATED[key] = None if spark.read.schema("doc_id long").parquet(found).isEmpty() else found
    return spark.read.schema("doc_id long").parquet(_REPEATED[key]) if _REPEATED[key] else None


def spark_tags(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The view media_tags, and the same rows as one list per medium (media_hash, words).

    Words of a document of its own id are distinct within its row; only documents that
    share an id need an exchange of their words.
    """
    docs = _dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), "doc_id")
    again = _repeated(spark, sf_dir)
    listed = lambda rows: rows.select(
        F.md5(F.col("doc_id").cast("string")).alias("media_hash"),
        F.filter(F.array_distinct(F.split(F.lower("text"), " ")), lambda w: F.length(w) > 1).alias("words"),
    )
    pairs = lambda lists: lists.select("media_hash", F.explode("words").alias("tag_id"))
    if again is None:
        lists = listed(docs)
        return pairs(lists), lists
    same = docs["doc_id"].eqNullSafe(again["doc_id"])
    single = listed(docs.join(again, same, "left_anti"))
    shared = pairs(listed(docs.join(again, same, "left_semi"))).distinct()
    united = shared.groupBy("media_hash").agg(F.collect_list("tag_id").alias("words"))
    return pairs(single).unionByName(shared), single.unionByName(united)


def _dealt(table: DataFrame, key: str) -> DataFrame:
    """A table of fewer splits than cores, whose long texts would keep one core busy, over all of them; larger ones as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores, key)


def duck(sql: str) -> str:
    """``sql`` with the views that it names put before it."""
    names = [n for n in VIEWS if n in sql]
    if not names:
        return sql
    views = ", ".join(f"{n} AS ({VIEWS[n].format(**_DUCK, **{t: t for t in _TABLES})})" for n in names)
    return f"WITH {views} {'' if not sql.lstrip().startswith('WITH ') else ','} {sql.lstrip().removeprefix('WITH ')}"


@dataclass
class Library:
    """The tables of a media library."""

    media: DataFrame
    media_tags: DataFrame
    media_actors: DataFrame
    media_playlists: DataFrame
    #: The rows of media_tags as (media_hash, words), if the library holds them so.
    tag_lists: DataFrame | None = None

    def lists_of_tags(self) -> DataFrame:
        """(media_hash, words), where no medium repeats a tag."""
        if self.tag_lists is not None:
            return self.tag_lists
        return self.media_tags.groupBy("media_hash").agg(F.collect_list("tag_id").alias("words"))


def library(spark: SparkSession, sf_dir: str) -> Library:
    tags, lists = spark_tags(spark, sf_dir)
    return Library(spark_view(spark, sf_dir, "media"), tags, *(spark_view(spark, sf_dir, n) for n in ("media_actors", "media_playlists")), lists)
