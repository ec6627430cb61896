"""The registered media-library queries and their DuckDB counterparts.

Each query runs over the library that ``plans.fixtures`` derives from the given tables.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import image_hash, scalars, video, words
from .operators import clones, grams, ingest, insights, ordered, playlists, postings, search, text, updates, vocabulary
from .plans.fixtures import Library, duck, library, spark_view
from .plans.lineage import exists, new_folder, stamp
from .sources import dump
from .sources import library as store
from .streaming import ingest as incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The count below which a token has no average; 20 would leave little at small scales.
MINIMUM_COUNT = 5


def _register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = duck(sql)


def _search(name: str, want: dict[str, Any], sql: str, fields: tuple[str, ...] = ("hash",)) -> None:
    _register(name, lambda s, d: search.search(library(s, d), want, list(fields)), sql)


_STORES: dict[tuple, postings.TokenStore] = {}


def stored_index(spark: SparkSession, sf_dir: str, kind: str = "tokens") -> postings.TokenStore:
    """An index of the library, built once for a session and a state of its tables, and shared by the queries that use one."""
    state = tuple(stamp(spark, f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    key = (spark.sparkContext.applicationId, sf_dir, state, kind)
    if key not in _STORES or not exists(spark, _STORES[key].root):
        _STORES[key] = postings.build(library(spark, sf_dir), new_folder(spark, f"{kind}-store"), kind=kind)
    return _STORES[key]


def _among(spark: SparkSession, sf_dir: str) -> Callable[[Library, list[str]], Library]:
    return lambda lib, phrases: postings.library_of(lib, phrases, stored_index(spark, sf_dir, "words"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible media by recommendation."""
    return search.search(
        library(spark, sf_dir),
        search.visible() | {"sortBy": "recommended", "minimumCount": MINIMUM_COUNT},
        ["hash", "recommended"],
        store=stored_index(spark, sf_dir),
    )


_VISIBLE = "NOT coalesce(corrupted, false) AND width IS NOT NULL AND duplicate_of IS NULL"

# ---- C, E: search ------------------------------------------------------------------

_search(
    "subset_basic",
    search.visible() | {"tags": {"equalsAny": ["the", "of"]}, "sortBy": "hashDate", "limit": 100},
    f"""
  SELECT hash FROM media WHERE {_VISIBLE} AND hash IN (SELECT media_hash FROM media_tags WHERE tag_id IN ('the', 'of')) ORDER BY hash_date DESC NULLS LAST, hash LIMIT 100""",
)
_search("c02_tags_all", {"tags": {"equalsAll": ["the", "of"]}}, """
  SELECT hash FROM media WHERE hash IN (SELECT media_hash FROM media_tags WHERE tag_id IN ('the', 'of') GROUP BY 1 HAVING count(*) = 2)""")
_search(
    "c03_tags_none",
    {"tags": {"equalsNone": ["the", "de", "la"]}},
    "SELECT hash FROM media WHERE hash NOT IN (SELECT media_hash FROM media_tags WHERE tag_id IN ('the', 'de', 'la'))",
)
_search("c04_actors_exist", {"actors": {"exists": True}}, "SELECT hash FROM media WHERE hash IN (SELECT media_hash FROM media_actors)")
_search(
    "c04_actors_absent",
    {"actors": {"exists": False}},
    "SELECT hash FROM media WHERE hash NOT IN (SELECT media_hash FROM media_actors)",
)
_search(
    "c05_c07_strings",
    {"album": {"equalsAny": ["en", "fr"]}, "artist": {"equalsNone": ["src0", "src7"]}},
    "SELECT hash FROM media WHERE album IN ('en', 'fr') AND (artist NOT IN ('src0', 'src7') OR artist IS NULL)",
)
_search(
    "c06_c08_strings",
    {"album": {"equalsAll": ["de", "en"]}, "artist": {"exists": False}},
    "SELECT hash FROM media WHERE album = 'de' AND artist IS NULL",
)
_search(
    "c09_dir_range",
    {"dir": {"after": "en/src1", "before": "es/src3"}},
    "SELECT hash FROM media WHERE dir > 'en/src1' AND dir < 'es/src3'",
)
_LIKE = {"title": {"likeAny": ["THE ", "la "], "likeNone": ["ing "]}, "path": {"likeAll": ["SRC", ".png"]}}
_LIKE_SQL = """
  SELECT hash FROM media WHERE (contains(lower(title), 'the ') OR contains(lower(title), 'la ')) AND (NOT contains(lower(title), 'ing ') OR title IS NULL) AND contains(lower(path), 'src') AND contains(lower(path), '.png')"""
_search("c10_c11_like", _LIKE, _LIKE_SQL)


def _like_from_index(s: SparkSession, d: str) -> DataFrame:
    """The same from a stored trigram index, built for the query."""
    # paths and titles depend on documents alone
    made = grams.build(spark_view(s, d, "media", unused=("labels",)), new_folder(s, "grams"))
    return search.search(library(s, d), _LIKE, ["hash"], grams=made)


_register("c10_c11_stored_index", _like_from_index, _LIKE_SQL)
_search(
    "c12_numbers",
    {"quality": {"min": 480, "max": 1080}, "rating": {"equalsAny": [3, 4, 5]}},
    "SELECT hash, height, rating FROM media WHERE height >= 480 AND height <= 1080 AND rating IN (3, 4, 5)",
    ("hash", "height", "rating"),
)
_search("c12_unrated", {"rating": {"max": 0}}, "SELECT hash FROM media WHERE rating <= 0 OR rating IS NULL")
_search("c13_not_corrupted", {"corrupted": False}, "SELECT hash FROM media WHERE NOT coalesce(corrupted, false)")
_search("c14_c16_states", {"indexed": False, "phashed": True}, "SELECT hash FROM media WHERE width IS NULL AND phash IS NOT NULL")
_search("c15_uncached", {"cached": False}, "SELECT hash FROM media WHERE type = 'video' AND coalesce(len(quality_cache), 0) = 0")
_search(
    "c18_playlist",
    {"playlist": "pl-3"},
    "SELECT hash, position FROM media JOIN media_playlists ON hash = media_hash WHERE playlist_id = 'pl-3'",
    ("hash", "position"),
)
_search("c19_visible", search.visible(), f"SELECT hash, path FROM media WHERE {_VISIBLE}", ("hash", "path"))
_search(
    "e1_rating_order",
    {"type": {"equalsAny": ["video"]}, "sortBy": "rating", "limit": 50},
    "SELECT hash, rating FROM media WHERE type = 'video' ORDER BY rating DESC NULLS LAST, hash LIMIT 50",
    ("hash", "rating"),
)
_search(
    "e1_created_ascending",
    {"sortBy": "createdAt", "sortDirection": "ASC", "limit": 120},
    "SELECT hash, created_at FROM media ORDER BY created_at ASC NULLS FIRST, hash LIMIT 120",
    ("hash", "created_at"),
)
_register(
    "e3_sample",
    lambda s, d: search.search(library(s, d), {"sample": 50}, ["hash"], seed=7),
    "SELECT hash FROM media ORDER BY md5(hash || '|7'), hash LIMIT 50",
)
_register(
    "e4_directories",
    lambda s, d: search.neighbour_dirs(spark_view(s, d, "media")),
    "SELECT dir, lag(dir) OVER (ORDER BY dir) AS previous, lead(dir) OVER (ORDER BY dir) AS next FROM (SELECT DISTINCT dir FROM media)",
)
_register(
    "e5_pages",
    lambda s, d: search.pages(spark_view(s, d, "media").select("hash", "rating"), "rating", 15).select("hash", "rank", "page"),
    """
  SELECT hash, rank, rank // 15 AS page FROM (SELECT hash, row_number() OVER (ORDER BY rating DESC NULLS LAST, hash) - 1 AS rank FROM media)""",
)
_register(
    "e5_stored_page",
    lambda s, d: ordered.store(spark_view(s, d, "media").select("hash", "rating"), new_folder(s, "order"), "rating", step=500).page(15, 3).select("hash", "rank"),
    """
  SELECT hash, rank FROM (SELECT hash, row_number() OVER (ORDER BY rating DESC NULLS LAST, hash) - 1 AS rank FROM media) WHERE rank // 15 = 3""",
)
_register(
    "e6_neighbours",
    lambda s, d: search.neighbours(spark_view(s, d, "media"), "hashDate"),
    """
  SELECT hash, coalesce(lag(hash) OVER w, first_value(hash) OVER (ORDER BY hash_date, hash DESC)) AS previous, coalesce(lead(hash) OVER w, first_value(hash) OVER (ORDER BY hash_date DESC, hash)) AS next
  FROM media WINDOW w AS (ORDER BY hash_date DESC, hash)""",
)
_register(
    "e7_shuffle",
    lambda s, d: search.shuffled(spark_view(s, d, "media"), 11).select("hash", "rank"),
    "SELECT hash, row_number() OVER (ORDER BY md5(hash || '|11'), hash) - 1 AS rank FROM media",
)

# ---- D: text -----------------------------------------------------------------------


def _words_sql(fields: str) -> str:
    """CTEs that end in field_words(hash, weight, kind, token), from a relation (hash, x, weight, kind); one step per separator, as nested lambdas take DuckDB long to plan."""
    stop = ",".join(sorted(words.STOP_WORDS))
    steps = [f"step0 AS MATERIALIZED (SELECT hash, lower(x) AS x, weight, kind FROM ({fields}))"]
    for i, sep in enumerate(words.SEPARATORS):
        keep = f"NOT contains(',{stop},', ',' || trim(w, ' ' || chr(9) || chr(10) || chr(13)) || ',') OR contains(w, ',') OR trim(w, ' ' || chr(9) || chr(10) || chr(13)) = ''"
        steps.append(f"step{i + 1} AS MATERIALIZED (SELECT hash, array_to_string(list_filter(string_split(x, '{sep}'), lambda w: {keep}), ' ') AS x, weight, kind FROM step{i})")
    last = f"SELECT hash, weight, kind, regexp_replace(unnest(string_split(x, ' ')), '[^a-z0-9]', '', 'g') AS token FROM step{len(words.SEPARATORS)}"
    return ", ".join(steps) + f", field_words AS MATERIALIZED (SELECT * FROM ({last}) WHERE token <> '' AND NOT regexp_full_match(token, '[0-9]+'))"


def _index_sql(query: str | None = None) -> str:
    more = f" UNION ALL SELECT NULL, '{query}', 0, 'query'" if query else ""
    fields = f"""SELECT hash, artist AS x, 5 AS weight, 'own' AS kind FROM media UNION ALL SELECT hash, album, 5, 'own' FROM media UNION ALL SELECT hash, title, 5, 'own' FROM media
      UNION ALL SELECT media_hash, actor_id, 7, 'word' FROM media_actors UNION ALL SELECT media_hash, tag_id, 7, 'word' FROM media_tags
      UNION ALL SELECT hash, unnest(auto_tags), 2, 'word' FROM media{more}"""
    return f"""{_words_sql(fields)}, tokens AS (
      SELECT hash, token, sum(weight) AS weight FROM (SELECT hash, token, weight FROM field_words WHERE kind <> 'query' AND (kind = 'word' OR length(token) > 1) UNION ALL SELECT hash, type, 10 FROM media) GROUP BY ALL)"""


_INDEX = _index_sql()
_AVERAGES = f"""averages AS (
  SELECT token, avg((rating - 3) / 2.0) AS average, count(*) AS count FROM tokens JOIN media USING (hash) WHERE rating <> 0
  GROUP BY token HAVING count(*) >= {MINIMUM_COUNT} AND abs(avg((rating - 3) / 2.0)) >= 0.1)"""

_register(
    "d1_tokens",
    lambda s, d: spark_view(s, d, "media").select("hash", F.explode_outer(words.tokenise(F.col("title"))).alias("token")).filter("token is not null"),
    f"WITH {_words_sql("SELECT hash, title AS x, 1 AS weight, 'own' AS kind FROM media")} SELECT hash, token FROM field_words",
)
_register(
    "d2_token_index",
    lambda s, d: text.token_index(library(s, d)).select("hash", "token", F.col("weight").cast("long").alias("weight")),
    f"WITH {_INDEX} SELECT hash, token, cast(weight AS BIGINT) AS weight FROM tokens",
)
_register(
    "d2_dictionary",
    lambda s, d: stored_index(s, d).read("dictionary").select("token", "top", "n"),
    f"WITH {_INDEX} SELECT token, cast(max(weight) AS BIGINT) AS top, count(*) AS n FROM tokens GROUP BY token",
)
_register(
    "d3_weighted_query",
    lambda s, d: postings.weighted_query(stored_index(s, d), "video en the src3", 200),
    f"""
  WITH {_index_sql('video en the src3')} SELECT hash, cast(sum(weight) AS BIGINT) AS score FROM tokens JOIN (SELECT token FROM field_words WHERE kind = 'query') USING (token) GROUP BY hash ORDER BY score DESC, hash LIMIT 200""",
)
_register(
    "d5_search_document",
    lambda s, d: text.search_document(library(s, d)),
    """
  SELECT hash, path, type, artist, album, title, array_to_string(auto_tags, ',') AS auto_tags, tags, actors FROM media LEFT JOIN (SELECT media_hash AS hash, string_agg(DISTINCT tag_id, ',' ORDER BY tag_id) AS tags FROM media_tags GROUP BY 1) USING (hash)
  LEFT JOIN (SELECT media_hash AS hash, string_agg(DISTINCT actor_id, ',' ORDER BY actor_id) AS actors FROM media_actors GROUP BY 1) USING (hash)""",
)
_PHRASE = r"(' ' || trim(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ')"
_ANY = " OR ".join(f"contains({_PHRASE.format(x=x)}, ' src3 ') OR contains({_PHRASE.format(x=x)}, ' actor 5 ')" for x in ("x",))
_TEXTS = """SELECT hash, unnest([hash, path, type, artist, album, title]) AS x FROM media UNION ALL SELECT hash, unnest(auto_tags) FROM media
    UNION ALL SELECT media_hash, tag_id FROM media_tags UNION ALL SELECT media_hash, actor_id FROM media_actors"""
_D6 = f"SELECT DISTINCT hash FROM ({_TEXTS}) WHERE {_ANY}"
_register("d6_keywords", lambda s, d: text.keyword_matches(library(s, d), "src3 actor-5"), _D6)
_register("d6_stored_index", lambda s, d: text.keyword_matches(library(s, d), "src3 actor-5", _among(s, d)), _D6)
_D7 = f"""
  WITH f AS (
    SELECT hash, {_PHRASE.format(x='x')} AS t, w FROM (
      SELECT hash, path AS x, 1 AS w FROM media UNION ALL SELECT hash, artist, 5 FROM media UNION ALL SELECT hash, album, 7 FROM media UNION ALL SELECT hash, title, 7 FROM media UNION ALL SELECT hash, type, 10 FROM media
      UNION ALL SELECT hash, unnest(auto_tags), 1 FROM media UNION ALL SELECT media_hash, tag_id, 3 FROM media_tags UNION ALL SELECT media_hash, actor_id, 8 FROM media_actors))
  SELECT hash, cast(sum(w * (len(regexp_extract_all(replace(t, ' ', '  '), ' the ')) + len(regexp_extract_all(replace(t, ' ', '  '), ' actor  5 ')) + len(regexp_extract_all(replace(t, ' ', '  '), ' src3 ')))) AS BIGINT) AS score
  FROM f WHERE hash NOT IN (SELECT hash FROM f WHERE contains(t, ' gif ')) GROUP BY hash HAVING score > 0"""
_QUERY = 'the "actor 5" src3 -gif'
_register("d7_ranked_keywords", lambda s, d: text.ranked_keywords(library(s, d), _QUERY), _D7)
_register("d7_stored_index", lambda s, d: text.ranked_keywords(library(s, d), _QUERY, _among(s, d)), _D7)

# ---- F: insights -------------------------------------------------------------------

_register(
    "f2_insights",
    lambda s, d: insights.insights(library(s, d), MINIMUM_COUNT, stored_index(s, d)).select("token", F.round("average", 6).alias("average"), "count"),
    f"WITH {_INDEX}, {_AVERAGES} SELECT token, round(average, 6) AS average, count FROM averages",
)
_register(
    "f3_recommendations",
    lambda s, d: insights.recommendations(library(s, d), MINIMUM_COUNT, store=stored_index(s, d)).select("hash", F.round("score", 6).alias("score")),
    f"""
  WITH {_INDEX}, {_AVERAGES} SELECT hash, round(coalesce(score, 0), 6) AS score FROM media LEFT JOIN (SELECT hash, sum(average) AS score FROM tokens JOIN averages USING (token) GROUP BY hash) USING (hash)""",
)
_register(
    "f4_recommended_search",
    lambda s, d: flagship(s, d).select("hash", F.round("recommended", 6).alias("recommended")),
    f"""
  WITH {_INDEX}, {_AVERAGES} SELECT hash, round(coalesce(score, 0), 6) AS recommended FROM media LEFT JOIN (SELECT hash, sum(average) AS score FROM tokens JOIN averages USING (token) GROUP BY hash) USING (hash) WHERE {_VISIBLE}""",
)
_LISTS = lambda e: e.select(
    F.col("playlist_id").alias("id"),
    F.concat(F.lit("List "), "playlist_id").alias("name"),
    F.lit(None).cast("string").alias("thumbnail"),
).distinct()
_register(
    "f5_playlist_sizes",
    lambda s, d: insights.playlist_sizes(_LISTS(spark_view(s, d, "media_playlists")), spark_view(s, d, "media_playlists")).select("id", "size"),
    """
  SELECT playlist_id AS id, count(*) AS size FROM media_playlists GROUP BY 1""",
)
_register(
    "f6_vocabulary",
    lambda s, d: insights.vocabulary(spark_view(s, d, "media_tags"), "tag_id"),
    "SELECT DISTINCT tag_id AS id FROM media_tags",
)
_register(
    "f7_details",
    lambda s, d: insights.details(library(s, d), "/lib").select(
        "hash",
        "absolute_path",
        F.array_join("tags", ",").alias("tags"),
        F.size("actors").alias("n_actors"),
        F.to_json("playlists").alias("playlists"),
    ),
    """
  SELECT hash, '/lib/' || path AS absolute_path, coalesce(tags, '') AS tags, cast(coalesce(n, 0) AS INTEGER) AS n_actors, coalesce(playlists, '[]') AS playlists FROM media
  LEFT JOIN (SELECT media_hash AS hash, string_agg(tag_id, ',' ORDER BY tag_id) AS tags FROM media_tags GROUP BY 1) USING (hash) LEFT JOIN (SELECT media_hash AS hash, count(*) AS n FROM media_actors GROUP BY 1) USING (hash)
  LEFT JOIN (SELECT media_hash AS hash, '[' || string_agg('{"id":"' || playlist_id || '","order":' || position || '}', ',' ORDER BY playlist_id, position) || ']' AS playlists FROM media_playlists GROUP BY 1) USING (hash)""",
)

# ---- G, H: playlists and vocabularies ------------------------------------------------

_ENTRIES = lambda s, d: spark_view(s, d, "media_playlists")
_register(
    "g2_append",
    lambda s, d: playlists.append(
        _ENTRIES(s, d),
        spark_view(s, d, "media").filter("rating = 5").select(
            F.col("hash").alias("media_hash"),
            F.lit("pl-1").alias("playlist_id"),
            F.col("hash_date").alias("rank"),
        ),
    ),
    """
  SELECT media_hash, playlist_id, position FROM media_playlists UNION ALL
  SELECT hash, 'pl-1', cast((SELECT coalesce(max(position), -1) FROM media_playlists WHERE playlist_id = 'pl-1') + row_number() OVER (ORDER BY hash_date, hash) AS INTEGER) FROM media
  WHERE rating = 5 AND hash NOT IN (SELECT media_hash FROM media_playlists WHERE playlist_id = 'pl-1')""",
)


def _moves(s: SparkSession, d: str) -> DataFrame:
    """Three moves of each playlist, one after the other: its first three media go to places 2, 3 and 0."""
    to = F.when(F.col("position") == 0, 2).when(F.col("position") == 1, 3).otherwise(0)
    return _ENTRIES(s, d).filter("position < 3").select("playlist_id", "media_hash", to.alias("to"), (F.col("position") + 1).alias("seq"))


def _moved_sql(k: int) -> str:
    """The k-th move of each playlist, as a step from made<k - 1> to made<k>."""
    return f"""made{k} AS (
    SELECT m.media_hash, m.playlist_id, CASE WHEN v.target IS NULL OR v.target >= n THEN m.position WHEN m.media_hash = v.media_hash THEN v.target
        WHEN a.position < v.target AND m.position > a.position AND m.position <= v.target THEN m.position - 1
        WHEN a.position > v.target AND m.position >= v.target AND m.position < a.position THEN m.position + 1 ELSE m.position END AS position
    FROM made{k - 1} m JOIN sizes s ON s.playlist_id = m.playlist_id LEFT JOIN moves v ON v.playlist_id = m.playlist_id AND v.seq = {k}
      LEFT JOIN made{k - 1} a ON a.playlist_id = v.playlist_id AND a.media_hash = v.media_hash)"""


_register(
    "g4_move",
    lambda s, d: playlists.move(_ENTRIES(s, d), _moves(s, d)),
    f"""
  WITH moves AS (
    SELECT playlist_id, media_hash, CASE position WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 0 END AS target, position + 1 AS seq FROM media_playlists WHERE position < 3
  ), sizes AS (
    SELECT playlist_id, count(*) AS n FROM media_playlists GROUP BY 1
  ), made0 AS (
    SELECT media_hash, playlist_id, position FROM media_playlists
  ), {", ".join(_moved_sql(k) for k in (1, 2, 3))} SELECT media_hash, playlist_id, cast(position AS INTEGER) AS position FROM made3""",
)
_register(
    "g5_remove",
    lambda s, d: playlists.remove(_ENTRIES(s, d), _ENTRIES(s, d).filter("position = 1")),
    """
  SELECT media_hash, playlist_id, CASE WHEN position > 1 THEN position - 1 ELSE position END AS position FROM media_playlists WHERE position <> 1""",
)
_register("g9_in_order", lambda s, d: playlists.in_order(_ENTRIES(s, d)), "SELECT media_hash, playlist_id, position FROM media_playlists")
_register(
    "i4_clone_classes",
    lambda s, d: clones.clone_classes(spark_view(s, d, "media"))[0],
    "SELECT hash, phash FROM media WHERE type = 'still' AND phash IS NOT NULL AND duplicate_of IS NULL",
)
_register(
    "g9_ordered",
    lambda s, d: playlists.ordered(_ENTRIES(s, d)).select("playlist_id", F.array_join("hashes", ",").alias("hashes")),
    "SELECT playlist_id, string_agg(media_hash, ',' ORDER BY position, media_hash) AS hashes FROM media_playlists GROUP BY 1",
)
_WORDS = lambda s, d: insights.vocabulary(spark_view(s, d, "media_tags"), "tag_id")
_register(
    "h1_add_tags",
    lambda s, d: vocabulary.add_to_media(
        spark_view(s, d, "media_tags"),
        spark_view(s, d, "media").filter("rating >= 4").select(
            F.col("hash").alias("media_hash"),
            F.explode(F.array(F.lit("the"), F.lit("no such tag"))).alias("tag_id"),
        ),
        _WORDS(s, d),
        spark_view(s, d, "media"),
        "tag_id",
    ),
    """
  SELECT media_hash, tag_id FROM media_tags UNION SELECT hash, 'the' FROM media WHERE rating >= 4 AND EXISTS (SELECT 1 FROM media_tags WHERE tag_id = 'the')""",
)
_register(
    "h2_remove_tags",
    lambda s, d: vocabulary.remove_from_media(
        spark_view(s, d, "media_tags"),
        spark_view(s, d, "media").filter("type = 'gif'").select(F.col("hash").alias("media_hash"), F.lit("the").alias("tag_id")),
        "tag_id",
    ),
    """
  SELECT media_hash, tag_id FROM media_tags WHERE NOT (tag_id = 'the' AND media_hash IN (SELECT hash FROM media WHERE type = 'gif'))""",
)
_register(
    "h4_remove_words",
    lambda s, d: vocabulary.remove_words(_WORDS(s, d), spark_view(s, d, "media_tags"), _WORDS(s, d).filter("length(id) <= 3"), "tag_id")[1],
    "SELECT media_hash, tag_id FROM media_tags WHERE length(tag_id) > 3",
)
_register(
    "h5_replace_sets",
    lambda s, d: vocabulary.replace_sets(
        spark_view(s, d, "media_tags"),
        spark_view(s, d, "media").filter("rating = 1").select("hash", F.array("album", "type", "type").alias("words")),
        "tag_id",
    ).filter("tag_id is not null"),
    """
  SELECT media_hash, tag_id FROM media_tags WHERE media_hash NOT IN (SELECT hash FROM media WHERE rating = 1) UNION ALL SELECT hash, unnest(list_distinct([album, type])) FROM media WHERE rating = 1""",
)

# ---- I: clones -----------------------------------------------------------------------

_BITS = lambda a, b: " + ".join(f"bit_count(xor(('0x' || substr({a}, {i}, 8))::BIGINT, ('0x' || substr({b}, {i}, 8))::BIGINT))::BIGINT" for i in range(1, 65, 8))
_register(
    "i3_hash_pairs",
    lambda s, d: clones.hash_pairs(spark_view(s, d, "media").filter("type = 'still'"), 3).select(
        "a",
        "b",
        F.col("distance").cast("long").alias("distance"),
    ),
    f"""
  WITH p AS (SELECT DISTINCT phash FROM media WHERE type = 'still' AND phash IS NOT NULL)
  SELECT x.phash AS a, y.phash AS b, cast({_BITS('x.phash', 'y.phash')} AS BIGINT) AS distance FROM p x JOIN p y ON x.phash < y.phash WHERE {_BITS('x.phash', 'y.phash')} <= 3""",
)
_register(
    "i4_clone_map",
    lambda s, d: clones.clone_map(spark_view(s, d, "media")).select("hash", F.array_join("clones", ",").alias("clones")),
    f"""
  WITH p AS (SELECT hash, phash FROM media WHERE type = 'still' AND phash IS NOT NULL AND duplicate_of IS NULL)
  SELECT x.hash, coalesce(string_agg(y.hash, ',' ORDER BY y.hash), '') AS clones FROM p x LEFT JOIN p y ON x.hash <> y.hash AND {_BITS('x.phash', 'y.phash')} <= 2 GROUP BY x.hash""",
)


def _groups(s: SparkSession, d: str) -> DataFrame:
    return spark_view(s, d, "media").filter("phash is not null").select(F.substring("phash", 1, 63).alias("group_id"), "hash")


_register(
    "i7_auto_resolve",
    lambda s, d: clones.auto_resolve(library(s, d), _groups(s, d)).select(
        "group_id",
        "hash",
        "artist",
        "rating",
        F.array_join("aliases", ",").alias("aliases"),
        F.size("tags").alias("n_tags"),
    ),
    """
  WITH g AS (SELECT substr(phash, 1, 63) AS group_id, *, coalesce(width::BIGINT * height, -1) AS px FROM media WHERE phash IS NOT NULL), w AS (
    SELECT group_id, arg_min(hash, (-px, hash)) AS hash, arg_min(artist, (-px, hash)) FILTER (artist <> '') AS artist, max(nullif(rating, 0)) AS rating, list_sort(list(hash)) AS everyone FROM g GROUP BY 1)
  SELECT w.group_id, w.hash, w.artist, w.rating, array_to_string(list_filter(everyone, lambda x: x <> w.hash), ',') AS aliases,
    cast((SELECT count(DISTINCT tag_id) FROM g JOIN media_tags t ON g.hash = t.media_hash WHERE g.group_id = w.group_id) AS INTEGER) AS n_tags FROM w""",
)

# ---- B, K: ingest and updates ----------------------------------------------------------

_register(
    "b1_media_types",
    lambda s, d: spark_view(s, d, "listing").select("path", scalars.media_type(F.col("path")).alias("type")),
    r"""
  SELECT path, CASE lower(regexp_extract(path, '\.([^./]+)$', 1)) WHEN 'mp4' THEN 'video' WHEN 'gif' THEN 'gif' WHEN 'jpg' THEN 'still' WHEN 'png' THEN 'still' END AS type FROM listing""",
)
_register(
    "b2_content_hash",
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", scalars.content_hash(F.encode("text", "utf-8")).alias("hash")),
    """
  WITH b AS (SELECT doc_id, encode(text) AS c FROM documents)
  SELECT doc_id, md5(CASE WHEN octet_length(c) > 65536 THEN unhex(substr(hex(c), 1, 131072) || substr(hex(c), -131072)) ELSE c END) AS hash FROM b""",
)
_register(
    "b5_scan_diff",
    lambda s, d: ingest.scan_diff(spark_view(s, d, "listing"), spark_view(s, d, "media"), spark_view(s, d, "media_deleted")),
    """
  SELECT path, 'new' AS state FROM listing WHERE NOT path LIKE '%.txt' AND path NOT IN (SELECT path FROM media) AND path NOT IN (SELECT path FROM media_deleted) UNION ALL
  SELECT path, 'missing' FROM media WHERE path NOT IN (SELECT path FROM listing)""",
)
_register(
    "b6_scan_summary",
    lambda s, d: ingest.scan_summary(ingest.scan_diff(spark_view(s, d, "listing"), spark_view(s, d, "media"), spark_view(s, d, "media_deleted"))),
    """
  SELECT 'new' AS state, count(*) AS n FROM listing WHERE NOT path LIKE '%.txt' AND path NOT IN (SELECT path FROM media) UNION ALL SELECT 'missing', count(*) FROM media WHERE path NOT IN (SELECT path FROM listing)""",
)


def _new_files(s: SparkSession, d: str) -> DataFrame:
    return spark_view(s, d, "listing").filter("path like 'pages/%.jpg'").select("path", F.md5(F.regexp_extract("path", "[0-9]+", 0)).alias("hash"))


_register(
    "b7_index",
    lambda s, d: ingest.index_files(spark_view(s, d, "media"), spark_view(s, d, "media_deleted"), _new_files(s, d), 1_800_000_000)[0].select(
        "hash",
        "path",
        "dir",
        "type",
        "hash_date",
    ),
    """
  WITH f AS (SELECT md5(regexp_extract(path, '[0-9]+', 0)) AS hash, path FROM listing WHERE path LIKE 'pages/%.jpg')
  SELECT m.hash, coalesce(f.path, m.path) AS path, dir, type, hash_date FROM media m LEFT JOIN f ON m.hash = f.hash UNION ALL
  SELECT hash, path, 'pages', 'still', 1800000000 FROM f WHERE hash NOT IN (SELECT hash FROM media) AND hash NOT IN (SELECT hash FROM media_deleted)""",
)
_register(
    "b8_match_missing",
    lambda s, d: ingest.match_missing(
        spark_view(s, d, "media"),
        spark_view(s, d, "media").filter("album = 'es'").select(F.upper(F.regexp_replace("path", r"\.\w+$", "")).alias("path")),
    ),
    r"""
  WITH m AS (SELECT DISTINCT upper(regexp_replace(path, '\.\w+$', '')) AS path FROM media WHERE album = 'es')
  SELECT m.path, count(x.hash) AS n, CASE WHEN count(x.hash) = 1 THEN min(x.hash) END AS hash FROM m LEFT JOIN media x ON contains(lower(x.path), lower(m.path)) GROUP BY 1""",
)


def _tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: spark_view(s, d, n) for n in ("media", "media_tags", "media_actors", "media_playlists", "media_deleted")}


_register(
    "b9_remove_media",
    lambda s, d: ingest.remove_media(_tables(s, d), spark_view(s, d, "media").filter("type = 'gif'"))["media_playlists"],
    """
  SELECT media_hash, playlist_id, cast(row_number() OVER (PARTITION BY playlist_id ORDER BY position, media_hash) - 1 AS INTEGER) AS position FROM media_playlists WHERE media_hash NOT IN (SELECT hash FROM media WHERE type = 'gif')""",
)
_register(
    "b10_rename",
    lambda s, d: ingest.rename_hashes(_tables(s, d), spark_view(s, d, "media").filter("rating = 2").select(F.col("hash").alias("old"), F.md5("path").alias("new")))["media_tags"],
    """
  SELECT coalesce(md5(path), media_hash) AS media_hash, tag_id FROM media_tags LEFT JOIN (SELECT * FROM media WHERE rating = 2) ON hash = media_hash""",
)
_register(
    "b13_verify_thumbnails",
    lambda s, d: ingest.verify_artifacts(spark_view(s, d, "media"), spark_view(s, d, "media").filter("height > 480").select("hash")).select(
        "hash",
        "thumbnail",
    ),
    """
  SELECT hash, CASE WHEN thumbnail AND NOT coalesce(height > 480, false) THEN false ELSE thumbnail END AS thumbnail FROM media""",
)
_register(
    "b13_verify_previews",
    lambda s, d: ingest.verify_artifacts(spark_view(s, d, "media"), spark_view(s, d, "media").filter("height > 480").select("hash"), "preview").select(
        "hash",
        "preview",
        "preview_optimised",
    ),
    """
  SELECT hash, CASE WHEN preview AND NOT coalesce(height > 480, false) THEN false ELSE preview END AS preview,
    CASE WHEN preview AND NOT coalesce(height > 480, false) THEN false ELSE preview_optimised END AS preview_optimised FROM media""",
)
_register(
    "b14_verify_cache",
    lambda s, d: ingest.verify_cache(
        spark_view(s, d, "media"),
        spark_view(s, d, "media").select("hash", F.explode(F.array(F.lit(0), F.lit(1))).alias("segment")),
        _segment_files(s, d),
    ).select("hash", F.array_join(F.col("quality_cache").cast("array<string>"), ",").alias("kept")),
    """
  SELECT hash, CASE WHEN quality_cache IS NULL THEN NULL WHEN hash_date % 7 = 0 THEN CASE WHEN len(quality_cache) > 0 THEN '240' ELSE '' END ELSE array_to_string(quality_cache, ',') END AS kept FROM media""",
)


def _segment_files(s: SparkSession, d: str) -> DataFrame:
    """Cached segments: both of every quality, but where hash_date % 7 is 0 the second of 480 is gone."""
    media = spark_view(s, d, "media")
    rows = media.select("hash", "hash_date", F.explode("quality_cache").alias("quality"))
    rows = rows.select("hash", "hash_date", "quality", F.explode(F.array(F.lit(0), F.lit(1))).alias("segment"))
    return rows.filter("not (hash_date % 7 = 0 and quality = 480 and segment = 1)")


_register(
    "b16_thumbnail_queue",
    lambda s, d: search.search(library(s, d), ingest.QUEUES["thumbnails"], ["hash"]),
    "SELECT hash FROM media WHERE NOT coalesce(corrupted, false) AND NOT coalesce(thumbnail, false) AND width IS NOT NULL",
)
_register(
    "b17_import",
    lambda s, d: ingest.normalise_import(spark_view(s, d, "media").withColumn("rotation", F.lit(None).cast("int")).withColumn("max_copy", F.lit(None).cast("boolean")), "en", 3)[0].select(
        "hash",
        "path",
        "rotation",
        F.element_at("quality_cache", 1).alias("quality"),
        "max_copy",
    ),
    """
  SELECT hash, CASE WHEN starts_with(path, 'en/') THEN substr(path, 4) ELSE path END AS path, 0 AS rotation, height AS quality, CASE WHEN type = 'video' THEN true END AS max_copy FROM media WHERE width IS NOT NULL""",
)


def _patches(s: SparkSession, d: str) -> DataFrame:
    known = spark_view(s, d, "media").filter("rating = 3").select(
        "hash",
        F.lit(5).alias("rating"),
        F.lit(None).cast("string").alias("artist"),
        F.array(F.lit("rating")).alias("keys"),
    )
    cleared = spark_view(s, d, "media").filter("rating = 1").select(
        "hash",
        F.lit(4).alias("rating"),
        F.lit(None).cast("string").alias("artist"),
        F.array(F.lit("artist")).alias("keys"),
    )
    new = s.read.parquet(f"{d}/pages.parquet").select(
        F.md5("url").alias("hash"),
        F.lit(2).alias("rating"),
        F.lit("web").alias("artist"),
        F.array(F.lit("rating"), F.lit("artist")).alias("keys"),
    ).dropDuplicates(["hash"])
    return known.unionByName(cleared).unionByName(new)


_register(
    "k1_upsert",
    lambda s, d: updates.upsert(spark_view(s, d, "media"), _patches(s, d)).select("hash", "rating", "artist", "path"),
    """
  SELECT hash, CASE WHEN rating = 3 THEN 5 ELSE rating END AS rating, CASE WHEN rating = 1 THEN NULL ELSE artist END AS artist, path FROM media UNION ALL SELECT DISTINCT md5(url), 2, 'web', NULL FROM pages""",
)


def _bulk(s: SparkSession, d: str) -> DataFrame:
    found = search.search(library(s, d), {"corrupted": False, "indexed": True, "quality": {"max": 240}}, ["hash"])
    media, matched = updates.bulk_update(spark_view(s, d, "media"), found, {"rating": 1})
    return media.select("hash", "rating", F.lit(matched).cast("long").alias("matched"))


_register("k2_bulk_update", _bulk, """
  SELECT hash, CASE WHEN hit THEN 1 ELSE rating END AS rating, count(*) FILTER (hit) OVER () AS matched
  FROM (SELECT *, coalesce(NOT coalesce(corrupted, false) AND height <= 240, false) AS hit FROM media)""")

# ---- J, L: video and names --------------------------------------------------------------

_QUALITIES = [240, 480, 720, 1080]
_VIDEOS = lambda s, d: spark_view(s, d, "media").filter("type = 'video' and width is not null")
_JOINED = lambda c: F.array_join(c.cast("array<string>"), ",")


def _qualities(s: SparkSession, d: str) -> DataFrame:
    v = _VIDEOS(s, d).withColumn("want", video.desired_qualities(F.col("height"), _QUALITIES, 480))
    return v.select(
        "hash",
        _JOINED(F.col("want")).alias("desired"),
        _JOINED(video.missing_qualities(F.col("want"), F.col("quality_cache"))).alias("missing"),
        _JOINED(video.redundant_qualities(F.col("want"), F.col("quality_cache"))).alias("redundant"),
    )


_register(
    "j1_j2_qualities",
    _qualities,
    """
  WITH v AS (SELECT hash, quality_cache AS c, list_sort(list_distinct(list_transform([240, 480, 720, 1080], lambda q: CASE WHEN height <= 480 OR q > height THEN height ELSE q END))) AS w FROM media WHERE type = 'video' AND width IS NOT NULL)
  SELECT hash, array_to_string(w, ',') AS desired, array_to_string(list_filter(w, lambda q: NOT list_contains(c, q)), ',') AS missing, array_to_string(list_filter(c, lambda q: NOT list_contains(w, q)), ',') AS redundant FROM v""",
)
_register(
    "j3_variants",
    lambda s, d: _VIDEOS(s, d).select(
        "hash",
        F.explode(video.stream_variants(F.col("width"), F.col("height"), F.col("quality_cache"), _QUALITIES)).alias("v"),
    ).select("hash", "v.*"),
    """
  SELECT hash, q AS quality, cast(ceil(width / height * q) AS INTEGER) AS width, cast(ceil(q::DOUBLE * q * width / height) AS BIGINT) AS bandwidth FROM (
    SELECT hash, width, height, unnest(list_distinct(list_concat(list_filter([240, 480, 720, 1080], lambda q: q <= least(width, height)), quality_cache))) AS q FROM media WHERE type = 'video' AND width IS NOT NULL)""",
)


def _segments(s: SparkSession, d: str) -> DataFrame:
    """Events of a user as keyframes, in hours from the first, read as seconds: real gaps would always be over the limit."""
    events = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = events.groupBy("id").agg(F.min("us").alias("first"))
    rows = events.join(first, "id").select(
        "id",
        ((F.col("us") - F.col("first")) / 3_600_000_000).alias("at"),
        F.lit(None).cast("double").alias("length"),
    )
    return video.segment_summary(rows).withColumnRenamed("id", "user_id")


_register(
    "j4_j9_segments",
    _segments,
    """
  WITH RECURSIVE k AS (
    SELECT user_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3600000000::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY user_id) AS c FROM events),
  fold AS (
    SELECT user_id, i, c, t, t AS last, 0 AS n, 0::DOUBLE AS longest, false AS emitted FROM k WHERE i = 1 UNION ALL
    SELECT k.user_id, k.i, k.c, k.t, CASE WHEN k.t - f.last > 10 THEN k.t ELSE f.last END, CASE WHEN k.t - f.last > 10 THEN f.n + 1 ELSE f.n END,
      CASE WHEN k.t - f.last > 10 THEN greatest(f.longest, k.t - f.last) ELSE f.longest END, k.t - f.last > 10
    FROM fold f JOIN k ON k.user_id = f.user_id AND k.i = f.i + 1),
  closed AS (SELECT *, ceil(t + 1) AS length FROM fold WHERE i = c)
  SELECT user_id, cast(CASE WHEN c = 1 OR length < 10 THEN 1 WHEN emitted THEN n ELSE n + 1 END AS BIGINT) AS n,
    cast(ceil(CASE WHEN c = 1 OR length < 10 THEN length WHEN emitted THEN longest ELSE greatest(longest, length - last) END) AS BIGINT) AS longest,
    CASE WHEN c > 1 AND length >= 10 AND emitted THEN last ELSE length END AS "end" FROM closed""",
)
_register(
    "j6_preview_sheet",
    lambda s, d: _VIDEOS(s, d).filter("length is not null").select("hash", video.preview_sheet(F.col("length"), F.col("height")).alias("p")).select(
        "hash",
        "p.*",
    ),
    """
  SELECT hash, count, columns, cast(ceil(count / columns) AS INTEGER) AS rows FROM (SELECT *, cast(ceil(count / (2160 / height)) AS INTEGER) AS columns FROM (SELECT hash, height, greatest(1, cast(floor(length / 10) AS INTEGER)) AS count FROM media WHERE type = 'video' AND length IS NOT NULL))""",
)
_register(
    "j7_top_labels",
    lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select(
        "vec_id",
        F.array_join(
            video.top_labels(
                F.col("embedding").cast("array<double>"),
                F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.concat(F.lit("class-"), i.cast("string"))),
            ),
            ",",
        ).alias("labels"),
    ),
    """
  SELECT vec_id, string_agg('class-' || i, ',' ORDER BY x DESC, i) AS labels FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(0, 64)) AS i FROM embeddings)) WHERE r <= 5 GROUP BY 1""",
)
_register(
    "j8_multi_hot",
    lambda s, d: insights.details(library(s, d)).select(
        "hash",
        F.array_join(video.multi_hot(F.col("tags"), ["the", "of", "la", "die"]).cast("array<string>"), "").alias("hot"),
    ),
    """
  SELECT hash, string_agg(CASE WHEN t.tag_id IS NULL THEN '0' ELSE '1' END, '' ORDER BY i) AS hot FROM media CROSS JOIN (VALUES (1, 'the'), (2, 'of'), (3, 'la'), (4, 'die')) v(i, w) LEFT JOIN media_tags t ON t.media_hash = hash AND t.tag_id = w GROUP BY hash""",
)
_register(
    "l1_l4_names",
    lambda s, d: spark_view(s, d, "media").select(
        "hash",
        scalars.title(F.col("album"), F.col("title"), F.col("path")).alias("title"),
        scalars.subtitle(F.col("type"), F.coalesce("length", F.lit(0)), F.col("width"), F.col("height")).alias("subtitle"),
        scalars.dir_name(F.col("path")).alias("dir"),
        scalars.file_name(F.col("path")).alias("file"),
    ),
    r"""
  SELECT hash, CASE WHEN title IS NULL AND album IS NULL THEN regexp_extract(path, '[^/]*$') ELSE concat_ws(' - ', nullif(album, ''), nullif(title, '')) END AS title,
    concat_ws(' | ', upper(type[1]) || type[2:], CASE WHEN type = 'video' THEN printf('%02d:%02d:%02d', coalesce(length, 0) // 3600, coalesce(length, 0) // 60 % 60, coalesce(length, 0) % 60) END, CASE WHEN width IS NOT NULL THEN width || 'x' || height END) AS subtitle,
    dir, regexp_extract(path, '[^/]*$') AS file FROM media""",
)

# ---- A, N: sources, sinks and incremental ingest -------------------------------------------


def _dumped(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """The library written as a dump and read back."""
    path = new_folder(s, "dump")
    dump.export(library(s, d), _LISTS(_ENTRIES(s, d)), spark_view(s, d, "media_deleted"), path, "gzip")
    return dump.load(s, path)


def _stored(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s, "tables")
    store.write_tables({"media": spark_view(s, d, "media")}, path)
    return store.read_tables(s, path, ["media"])["media"]


def _sidecars(s: SparkSession, d: str) -> DataFrame:
    """Sidecar texts: the author plain or as an object, every seventh text broken."""
    author = "CASE WHEN doc_id % 2 = 0 THEN to_json(named_struct('author', named_struct('name', source), 'album', lang, 'content', '')) ELSE to_json(named_struct('artist', source, 'album', named_struct('name', lang), 'title', cast(doc_id AS string))) END"
    texts = s.read.parquet(f"{d}/documents.parquet").selectExpr(
        "doc_id",
        f"CASE WHEN doc_id % 7 = 0 THEN concat('not json ', source) ELSE {author} END AS sidecar",
    )
    return texts.select("doc_id", store.sidecar(F.col("sidecar")).alias("s")).select("doc_id", "s.*")


def _incremental(s: SparkSession, d: str) -> DataFrame:
    root = new_folder(s, "ingest")
    spark_view(s, d, "media").write.parquet(f"{root}/store/media/version=0")
    spark_view(s, d, "media_deleted").write.parquet(f"{root}/store/media_deleted/version=0")
    _new_files(s, d).select("path", "hash").write.json(f"{root}/in")
    incremental.start(s, f"{root}/in", f"{root}/store", f"{root}/state", 1_800_000_000).awaitTermination()
    return incremental.current(s, f"{root}/store")[0].select("hash", "path", "dir", "type", "hash_date")


_ENDINGS = {0: ".jpg", 1: ".MP4", 2: ".gif", 3: ".txt", 4: ""}


def _listed(s: SparkSession, d: str) -> DataFrame:
    """Pages written as files under several endings; the tree listed, and the ends of its files hashed."""
    root, kind = new_folder(s, "tree"), F.col("page_id") % 5
    ending = F.lit("")
    for k, text_ in _ENDINGS.items():
        ending = F.when(kind == k, text_).otherwise(ending)
    pages = s.read.parquet(f"{d}/pages.parquet")
    path = F.concat(F.lit("a b/"), (F.col("page_id") % 7).cast("string"), F.lit("/"), F.col("page_id").cast("string"), ending)
    store.write_tree(pages.select(path.alias("path"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("content")), root)
    listed = store.list_files(s, root).select("path", "length", scalars.media_type(F.col("path")).alias("type"))
    return store.hash_files(listed, root).drop("bytes_read")


_register(
    "a1_listing",
    _listed,
    """
  WITH f AS (SELECT 'a b/' || page_id % 7 || '/' || page_id || CASE page_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.MP4' ELSE '.gif' END AS path, page_id % 5 AS k, encode(coalesce(html, '')) AS c FROM pages WHERE page_id % 5 < 3)
  SELECT path, octet_length(c) AS length, CASE k WHEN 0 THEN 'still' WHEN 1 THEN 'video' ELSE 'gif' END AS type,
    md5(CASE WHEN octet_length(c) > 65536 THEN unhex(substr(hex(c), 1, 131072) || substr(hex(c), -131072)) ELSE c END) AS hash FROM f""",
)
_register(
    "a2_dump_media",
    lambda s, d: _dumped(s, d)["media"].select(
        "hash",
        "path",
        "rating",
        "corrupted",
        "thumbnail",
        "phash",
        "height",
        "length",
        "codec",
        "max_copy",
        "title",
        "created_at",
        "hash_date",
        F.array_join("auto_tags", ",").alias("auto_tags"),
        _JOINED(F.col("quality_cache")).alias("qualities"),
    ),
    """
  SELECT hash, path, rating, corrupted, thumbnail, phash, height, length, codec, max_copy, title, created_at, hash_date, array_to_string(auto_tags, ',') AS auto_tags, CASE WHEN quality_cache IS NOT NULL THEN array_to_string(quality_cache, ',') END AS qualities FROM media""",
)
_register("a2_dump_tags", lambda s, d: _dumped(s, d)["media_tags"], "SELECT media_hash, tag_id FROM media_tags")
_register(
    "a3_dump_playlists",
    lambda s, d: _dumped(s, d)["media_playlists"],
    "SELECT media_hash, playlist_id, position FROM media_playlists",
)


def _record(s: SparkSession, d: str) -> DataFrame:
    """The library written as one record in pieces and read back in blocks."""
    path = new_folder(s, "record")
    dump.export_record(library(s, d), _LISTS(_ENTRIES(s, d)), spark_view(s, d, "media_deleted"), path)
    return dump.load_record(s, path, 1 << 18)["media"].select("hash", "path", "rating", "corrupted", "phash", "height", "title", "created_at", "hash_date")


_register("a2_dump_record", _record, "SELECT hash, path, rating, corrupted, phash, height, title, created_at, hash_date FROM media")
_register("a4_tables", lambda s, d: _stored(s, d).select("hash", "path", "type", "width"), "SELECT hash, path, type, width FROM media")
_register(
    "a5_sidecars",
    _sidecars,
    """
  SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN source END AS artist, CASE WHEN doc_id % 7 <> 0 THEN lang END AS album, CASE WHEN doc_id % 7 <> 0 AND doc_id % 2 = 1 THEN cast(doc_id AS varchar) END AS title FROM documents""",
)
_register(
    "n1_incremental_ingest",
    _incremental,
    """
  WITH f AS (SELECT md5(regexp_extract(path, '[0-9]+', 0)) AS hash, path FROM listing WHERE path LIKE 'pages/%.jpg')
  SELECT m.hash, coalesce(f.path, m.path) AS path, dir, type, hash_date FROM media m LEFT JOIN f ON m.hash = f.hash UNION ALL
  SELECT hash, path, 'pages', 'still', 1800000000 FROM f WHERE hash NOT IN (SELECT hash FROM media) AND hash NOT IN (SELECT hash FROM media_deleted)""",
)

# ---- B, C: more maintenance and search -------------------------------------------------------


def _metadata(s: SparkSession, d: str) -> DataFrame:
    """Probe rows: artists under three names of tags, sidecar values, coded sizes."""
    probe = s.read.parquet(f"{d}/documents.parquet").selectExpr(
        "cast(doc_id AS string) AS hash",
        "map(CASE doc_id % 3 WHEN 0 THEN 'artist' WHEN 1 THEN 'album_artist' ELSE 'other' END, source, 'ALBUM', CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END) AS tags",
        "named_struct('artist', 'side', 'album', 'side', 'title', cast(null AS string)) AS sidecar",
        "n_chars / 8.0D AS duration",
        "cast(doc_id % 4 AS int) AS width",
        "99 AS coded_width",
        "cast(null AS int) AS height",
        "cast(doc_id % 9 AS int) AS coded_height",
    )
    return ingest.metadata(probe)


_register(
    "b4_metadata",
    _metadata,
    """
  SELECT cast(doc_id AS varchar) AS hash, CASE WHEN doc_id % 3 = 2 THEN 'side' ELSE coalesce(nullif(source, ''), 'side') END AS artist, CASE WHEN doc_id % 5 = 0 THEN 'side' ELSE coalesce(nullif(lang, ''), 'side') END AS album, cast(NULL AS varchar) AS title,
    cast(ceil(n_chars / 8.0) AS INTEGER) AS length, CASE WHEN doc_id % 4 = 0 THEN 99 ELSE cast(doc_id % 4 AS INTEGER) END AS width, cast(doc_id % 9 AS INTEGER) AS height FROM documents""",
)
_register(
    "b3_created_times",
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", ingest.created_at(F.col("ts")).alias("created")),
    "SELECT event_id, cast(round(epoch_us(ts) / 1000000.0) AS BIGINT) AS created FROM events",
)
_register(
    "b11_fill_created",
    lambda s, d: ingest.fill_created(spark_view(s, d, "media"), spark_view(s, d, "media").select("path", (F.col("hash_date") + 1).alias("created"))).select(
        "hash",
        "created_at",
    ),
    """
  SELECT hash, CASE WHEN width IS NOT NULL AND coalesce(created_at, 0) = 0 THEN hash_date + 1 ELSE created_at END AS created_at FROM media""",
)
_register(
    "b12_fill_tags",
    lambda s, d: ingest.fill_tags(
        spark_view(s, d, "media"),
        spark_view(s, d, "media").select("hash", F.col("dir").alias("artist"), F.col("type").alias("album"), F.col("path").alias("title")),
    ).select("hash", "artist", "album", "title"),
    """
  SELECT hash, CASE WHEN v THEN coalesce(nullif(artist, ''), dir) ELSE artist END AS artist, CASE WHEN v THEN coalesce(nullif(album, ''), type) ELSE album END AS album, CASE WHEN v THEN coalesce(nullif(title, ''), path) ELSE title END AS title
  FROM (SELECT *, type = 'video' AND NOT coalesce(corrupted, false) AS v FROM media)""",
)
_register(
    "b15_uncorrupt",
    lambda s, d: ingest.reset_auto_tags(ingest.uncorrupt(spark_view(s, d, "media").withColumn("auto_tags", F.array("type")))).select(
        "hash",
        "corrupted",
        F.array_join("auto_tags", ",").alias("auto_tags"),
    ),
    """
  SELECT hash, CASE WHEN corrupted THEN false ELSE corrupted END AS corrupted, cast(NULL AS varchar) AS auto_tags FROM media""",
)
for _queue, _sql in {
    "cache": "type = 'video' AND NOT coalesce(corrupted, false) AND duplicate_of IS NULL",
    "keyframes": "type = 'video' AND width IS NOT NULL AND duplicate_of IS NULL",
    "phash": "type = 'still' AND width IS NOT NULL AND NOT coalesce(corrupted, false) AND phash IS NULL AND thumbnail",
    "clones": "type = 'still' AND phash IS NOT NULL AND duplicate_of IS NULL",
    "rescan": "type = 'video' AND NOT coalesce(corrupted, false)",
    "previews": "type = 'video' AND NOT coalesce(preview, false) AND NOT coalesce(corrupted, false) AND duplicate_of IS NULL",
    "classify": "type = 'still' AND auto_tags IS NULL AND thumbnail",
    "optimise_thumbnails": "thumbnail AND NOT coalesce(corrupted, false) AND NOT coalesce(thumbnail_optimised, false)",
    "optimise_previews": "type = 'video' AND preview AND NOT coalesce(corrupted, false) AND NOT coalesce(preview_optimised, false)",
}.items():
    _search(f"b16_{_queue}_queue", ingest.QUEUES[_queue], f"SELECT hash FROM media WHERE {_sql}")


def _with_clones(s: SparkSession, d: str) -> DataFrame:
    media = spark_view(s, d, "media")
    return media.join(clones.clone_map(media), "hash", "left").withColumn("unrelated", F.lit(None).cast("array<string>"))


_CLUSTER = "min(hash) OVER (PARTITION BY substr(phash, 1, 63))"
_register(
    "c17_has_clones",
    lambda s, d: search.search(
        Library(_with_clones(s, d), spark_view(s, d, "media_tags"), spark_view(s, d, "media_actors"), _ENTRIES(s, d)),
        {"hasClones": True},
        ["hash"],
    ),
    """
  SELECT hash FROM (SELECT hash, phash, count(*) OVER (PARTITION BY substr(phash, 1, 63)) AS n FROM media) WHERE phash IS NOT NULL AND n > 1""",
)
_FORM = {
    "keywords": "src3 en",
    "minimumResolution": "480",
    "ratingMin": 1,
    "ratingMax": -1,
    "typeVideo": True,
    "typeStill": True,
    "tags": {"equalsAny": [], "equalsNone": ["zzz"]},
    "tagged": True,
    "title": {"like": "e", "notLike": "qq"},
    "lengthMax": 100,
}
_search(
    "c22_form",
    search.form_constraints(_FORM),
    f"""
  SELECT hash FROM media WHERE hash IN (SELECT hash FROM ({_TEXTS})
      WHERE contains({_PHRASE.format(x='x')}, ' src3 ') OR contains({_PHRASE.format(x='x')}, ' en '))
    AND height >= 480 AND rating >= 1 AND type IN ('video', 'still') AND hash NOT IN (SELECT media_hash FROM media_tags WHERE tag_id = 'zzz') AND hash IN (SELECT media_hash FROM media_tags)
    AND contains(lower(title), 'e') AND NOT contains(lower(title), 'qq') AND length <= 6000""",
)

# ---- G, H: more playlists and vocabularies ---------------------------------------------------

_RATED = {"type": {"equalsAny": ["video"]}, "rating": {"min": 1}, "sortBy": "rating"}


def _created(s: SparkSession, d: str) -> DataFrame:
    """One new playlist per language, of its rated media."""
    media = spark_view(s, d, "media")
    new = media.select(F.col("album").alias("id")).filter("id is not null").distinct().select(
        "id",
        F.upper("id").alias("name"),
        F.lit(None).cast("string").alias("thumbnail"),
    )
    members = media.filter("rating >= 4 and album is not null").select(
        F.col("hash").alias("media_hash"),
        F.col("album").alias("playlist_id"),
        F.col("hash_date").alias("rank"),
    )
    return playlists.create(_LISTS(_ENTRIES(s, d)), _ENTRIES(s, d), new, members)[0]


def _append_search(s: SparkSession, d: str) -> DataFrame:
    found = search.search(library(s, d), _RATED, ["hash", "rating"])
    return playlists.append(
        _ENTRIES(s, d),
        found.select(F.col("hash").alias("media_hash"), F.lit("pl-2").alias("playlist_id"), (-F.col("rating")).alias("rank")),
    )


def _updated_lists(s: SparkSession, d: str) -> DataFrame:
    lists = insights.playlist_sizes(_LISTS(_ENTRIES(s, d)), _ENTRIES(s, d))
    changes = lists.filter("size > 3").select(
        "id",
        F.when(F.col("size") > 5, F.lit("")).otherwise(F.lit("Short")).alias("name"),
        F.concat(F.lit("thumb-"), "id").alias("thumbnail"),
    )
    return playlists.update(lists, changes).select("id", "name", "thumbnail", "size")


_register(
    "g1_create",
    _created,
    """
  WITH e AS (SELECT playlist_id AS id, count(*) AS size, arg_min(media_hash, position) AS thumbnail FROM media_playlists GROUP BY 1), n AS (SELECT album AS id, count(*) FILTER (rating >= 4) AS size, arg_min(hash, hash_date) FILTER (rating >= 4) AS thumbnail FROM media WHERE album IS NOT NULL GROUP BY 1)
  SELECT id, 'List ' || id AS name, thumbnail, size FROM e UNION ALL SELECT id, upper(id), thumbnail, size FROM n""",
)
_register(
    "g3_append_search",
    _append_search,
    """
  SELECT media_hash, playlist_id, position FROM media_playlists UNION ALL
  SELECT hash, 'pl-2', cast((SELECT coalesce(max(position), -1) FROM media_playlists WHERE playlist_id = 'pl-2') + row_number() OVER (ORDER BY rating DESC, hash) AS INTEGER) FROM media
  WHERE type = 'video' AND rating >= 1 AND hash NOT IN (SELECT media_hash FROM media_playlists WHERE playlist_id = 'pl-2')""",
)
_register(
    "g6_remove_search",
    lambda s, d: playlists.remove(
        _ENTRIES(s, d),
        search.search(library(s, d), {"type": {"equalsAny": ["still"]}}, ["hash"]).select(
            F.col("hash").alias("media_hash"),
            F.lit("pl-1").alias("playlist_id"),
        ),
    ),
    """
  SELECT media_hash, playlist_id, cast(row_number() OVER (PARTITION BY playlist_id ORDER BY position) - 1 AS INTEGER) AS position FROM media_playlists
  WHERE NOT (playlist_id = 'pl-1' AND media_hash IN (SELECT hash FROM media WHERE type = 'still'))""",
)
_register(
    "g7_delete",
    lambda s, d: playlists.delete(_LISTS(_ENTRIES(s, d)), _ENTRIES(s, d), _ENTRIES(s, d).filter("position = 4").select(F.col("playlist_id").alias("id")))[1],
    """
  SELECT media_hash, playlist_id, position FROM media_playlists WHERE playlist_id NOT IN (SELECT playlist_id FROM media_playlists WHERE position = 4)""",
)
_register(
    "g8_update",
    _updated_lists,
    """
  SELECT playlist_id AS id, CASE WHEN count(*) IN (4, 5) THEN 'Short' ELSE 'List ' || playlist_id END AS name, CASE WHEN count(*) > 3 THEN 'thumb-' || playlist_id END AS thumbnail, count(*) AS size FROM media_playlists GROUP BY playlist_id""",
)
_register(
    "h3_add_words",
    lambda s, d: vocabulary.add_words(_WORDS(s, d), spark_view(s, d, "media_actors").select(F.col("actor_id").alias("id"))),
    "SELECT tag_id AS id FROM media_tags UNION SELECT actor_id FROM media_actors",
)

# ---- I, J, M: more clones, video and sets ----------------------------------------------------


def _written_back(s: SparkSession, d: str) -> DataFrame:
    """Some media already have an empty list; it only changes where there are clones."""
    media = spark_view(s, d, "media")
    old = media.withColumn("clones", F.when(F.col("hash_date") % 120 == 0, F.array().cast("array<string>"))).withColumn(
        "clone_date",
        F.lit(None).cast("long"),
    )
    return clones.write_back(old, clones.clone_map(media), 99).select("hash", F.array_join("clones", ",").alias("clones"), "clone_date")


def _resolved(s: SparkSession, d: str) -> DataFrame:
    """The smallest hash of each group of clones takes the others."""
    media = _with_clones(s, d)
    decisions = media.filter("size(clones) > 0 and hash < clones[0]").select(
        "hash",
        F.col("clones").alias("aliases"),
        F.array().cast("array<string>").alias("unrelated"),
    )
    return clones.resolve(media, decisions)[0].select("hash", "duplicate_of")


def _images(s: SparkSession, d: str) -> DataFrame:
    """Documents as 32 x 32 images, whose pixels are hashes of the text."""
    texts = s.read.parquet(f"{d}/documents.parquet").select(
        F.md5(F.col("doc_id").cast("string")).alias("hash"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rgba = F.encode(F.concat(*[F.sha2(F.concat("text", F.lit(f"|{i}")), 256) for i in range(64)]), "utf-8")
    return image_hash.image_hashes(texts.select("hash", F.lit(32).alias("width"), F.lit(32).alias("height"), rgba.alias("rgba")))


_register(
    "i1_image_hashes",
    _images,
    """
  WITH px AS (
    SELECT md5(cast(doc_id AS varchar)) AS hash, list_transform(string_split(array_to_string(list_transform(range(64), lambda i: sha256(coalesce(text, '') || '|' || i)), ''), ''), lambda c: ord(c)) AS o FROM documents),
  blocks AS (
    SELECT hash, list_transform(range(256), lambda b: list_sum(list_transform([0, 4, 128, 132], lambda k: o[k + (b // 16) * 256 + (b % 16) * 8 + 1] + o[k + (b // 16) * 256 + (b % 16) * 8 + 2] + o[k + (b // 16) * 256 + (b % 16) * 8 + 3]))) AS v FROM px),
  middles AS (SELECT hash, v, list_transform(range(4), lambda k: (list_sort(v[64 * k + 1 : 64 * k + 64])[33] + list_sort(v[64 * k + 1 : 64 * k + 64])[34]) / 2) AS m FROM blocks),
  bits AS (SELECT hash, list_transform(v, lambda x, i: CASE WHEN x > m[(i - 1) // 64 + 1] OR (abs(x - m[(i - 1) // 64 + 1]) < 1 AND m[(i - 1) // 64 + 1] > 1536) THEN 1 ELSE 0 END) AS b FROM middles)
  SELECT hash, array_to_string(list_transform(range(64), lambda n: substr('0123456789abcdef', 1 + 8 * b[4 * n + 1] + 4 * b[4 * n + 2] + 2 * b[4 * n + 3] + b[4 * n + 4], 1)), '') AS phash FROM bits""",
)
_register(
    "i5_write_back",
    _written_back,
    """
  WITH c AS (SELECT hash, type, hash_date, CASE WHEN phash IS NOT NULL THEN array_to_string(list_sort(list_filter(list(hash) OVER (PARTITION BY substr(phash, 1, 63)), lambda x: x <> hash)), ',') END AS found FROM media)
  SELECT hash, CASE WHEN found IS NOT NULL THEN found WHEN hash_date % 120 = 0 THEN '' END AS clones, CASE WHEN found IS NOT NULL AND NOT (hash_date % 120 = 0 AND found = '') THEN 99::BIGINT END AS clone_date FROM c""",
)
_register(
    "i6_resolve",
    _resolved,
    f"SELECT hash, CASE WHEN phash IS NOT NULL AND hash <> {_CLUSTER} THEN {_CLUSTER} END AS duplicate_of FROM media",
)
_register(
    "j5_keyframe_work",
    lambda s, d: _VIDEOS(s, d).filter(
        video.needs_keyframes(
            F.lit(None).cast("array<struct<start:double,end:double>>"),
            F.col("quality_cache"),
            F.transform(video.stream_variants(F.col("width"), F.col("height"), F.col("quality_cache"), _QUALITIES), lambda v: v["quality"]),
        ),
    ).select("hash"),
    """
  SELECT hash FROM media WHERE type = 'video' AND width IS NOT NULL AND len(list_filter(list_concat([240, 480, 720, 1080], []), lambda q: q <= least(width, height) AND NOT list_contains(quality_cache, q))) > 0""",
)
_register(
    "m1_word_sets",
    lambda s, d: insights.details(library(s, d)).select(
        "hash",
        F.array_join(F.array_sort(F.array_union("tags", "actors")), ",").alias("either"),
        F.array_join(F.array_sort(F.array_except("tags", F.split(F.lower("title"), " "))), ",").alias("only_tags"),
    ),
    """
  SELECT hash, coalesce(string_agg(DISTINCT w, ',' ORDER BY w), '') AS either, CASE WHEN title IS NOT NULL THEN coalesce(string_agg(DISTINCT w, ',' ORDER BY w) FILTER (kind = 't' AND NOT list_contains(string_split(lower(title), ' '), w)), '') END AS only_tags
  FROM media LEFT JOIN (SELECT media_hash, tag_id AS w, 't' AS kind FROM media_tags UNION ALL SELECT media_hash, actor_id, 'a' FROM media_actors) ON media_hash = hash GROUP BY hash, title""",
)
__all__ = ["ORACLES", "QUERIES", "Library", "flagship"]
