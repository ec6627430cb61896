"""Bridges as lists: repeated ids, and changes that shuffle no rows but those of their words."""

import pytest

from lumenshelf.operators import clones, text, vocabulary
from lumenshelf.plans.fixtures import Library, spark_tags
from lumenshelf.sources import dump


def _rows(df):
    return sorted(map(repr, df.collect()))


def _exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning(media_hash")


@pytest.fixture
def docs(spark, tmp_path):
    rows = [(1, "The cat the dog"), (2, "a bb"), (2, "bb cc"), (3, None), (None, "null id"), (None, "id zz"), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return df, str(tmp_path)


def test_tags_of_repeated_ids(spark, docs):
    df, folder = docs
    sql = "SELECT DISTINCT * FROM (SELECT md5(cast(doc_id AS string)) AS media_hash, explode(array_distinct(split(lower(text), ' '))) AS tag_id FROM {d}) WHERE length(tag_id) > 1"
    want = _rows(spark.sql(sql, d=df))
    tags, lists = spark_tags(spark, folder)
    assert _rows(tags) == want
    assert _rows(lists.selectExpr("media_hash", "explode(words) AS tag_id")) == want
    assert lists.count() == lists.select("media_hash").distinct().count()


def test_tags_of_single_ids_are_not_exchanged(spark, docs, tmp_path):
    docs[0].filter("doc_id in (1, 3, 4)").coalesce(1).write.parquet(str(tmp_path / "one" / "documents.parquet"))
    tags, _ = spark_tags(spark, str(tmp_path / "one"))
    assert "HashAggregate" not in tags._jdf.queryExecution().executedPlan().toString()


def test_changes_of_words(spark):
    bridge = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", None), (None, "x")], "media_hash string, tag_id string")
    gone = spark.createDataFrame([("a", "x"), ("c", None), ("c", "x"), ("d", "q")], "media_hash string, tag_id string")
    got = vocabulary.remove_from_media(bridge, gone, "tag_id")
    assert _rows(got) == _rows(bridge.join(gone, ["media_hash", "tag_id"], "left_anti"))
    media, known = spark.createDataFrame([("a",), ("b",)], "hash string"), spark.createDataFrame([("x",), ("y",)], "id string")
    more = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y"), ("b", "no"), ("z", "x")], "media_hash string, tag_id string")
    assert _rows(vocabulary.add_to_media(bridge, more, known, media, "tag_id")) == sorted([*_rows(bridge), "Row(media_hash='b', tag_id='y')"])
    new = spark.createDataFrame([("b", ["q"])], "hash string, words array<string>")
    kept = vocabulary.replace_sets(bridge, new, "tag_id")
    assert _exchanges(kept.filter("tag_id <> 'q'")) == 0 and kept.count() == 5


def test_lists_in_keywords_and_groups(spark):
    media = spark.createDataFrame([("a", 1), ("b", 2)], "hash string, width int").selectExpr("hash", "width", "1 AS height", "'p' AS path", "'still' AS type", "'' AS artist", "'' AS album", "'' AS title", "1 AS rating")
    tags = spark.createDataFrame([("a", "Red-Car"), ("a", "x"), ("b", "x"), ("b", "red"), ("b", "car")], "media_hash string, tag_id string")
    none = spark.createDataFrame([], "media_hash string, actor_id string")
    single = Library(media, tags, none, none)
    lists = Library(media, tags, none, none, single.lists_of_tags())
    for lib in (single, lists):
        assert [r.hash for r in text.keyword_matches(lib, "red-car").collect()] == ["a"]  # not across two tags
        one = clones.auto_resolve(lib, media.selectExpr("'g' AS group_id", "hash")).first()
        assert (one.hash, one.tags, one.actors, one.aliases) == ("b", ["Red-Car", "car", "red", "x"], [], ["a"])


def test_dump_records_that_repeat_a_hash(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"version":4,"media":[{"hash":"a","tags":["x","y","x"],"actors":[]},{"hash":"a","tags":["y","z"]},{"hash":"b"}],"playlists":[],"deleted":[],"tags":[],"actors":[]}')
    got = dump.load_single(spark, str(tmp_path / "d.json"))
    assert sorted(map(tuple, got["media_tags"].collect())) == [("a", "x"), ("a", "y"), ("a", "z")] and got["media_actors"].count() == 0
    for part in dump.PARTS:
        (tmp_path / "lines" / part).mkdir(parents=True)
    (tmp_path / "lines" / "media" / "a.json").write_text('{"hash":"a","tags":["x","y","x"]}\n{"hash":"a","tags":["y","z"]}\n{"hash":"b","tags":["x","x"]}\n')
    got = dump.load(spark, str(tmp_path / "lines"))["media_tags"]
    assert sorted(map(tuple, got.collect())) == [("a", "x"), ("a", "y"), ("a", "z"), ("b", "x")]
