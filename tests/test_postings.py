"""The stored token index: equal to the plain one, pruned, incremental."""

import random

import pytest
from pyspark.sql import functions as F

from lumenshelf.operators import insights, postings, text
from lumenshelf.plans.fixtures import Library

WORDS = [f"w{i}" for i in range(60)]


def _library(spark, seed, n=300, change=()):
    """A library of n media; those in ``change`` have other texts, ratings and tags, and every third of them is gone."""
    rng = random.Random(seed)
    media, tags, actors = [], [], []
    for i in range(n):
        pick = lambda r, k: [WORDS[int(60 * r.random() ** 3)] for _ in range(k)]
        row, mine = (f"h{i:04d}", "still", rng.choice([None, "ann lee", "bob"]), rng.choice([None, "alb_one"]), " ".join(pick(rng, 6)), rng.choice([None, 0, 1, 2, 3, 4, 5]), [rng.choice(WORDS)]), pick(rng, 3)
        if i in change:
            if i % 3 == 0:
                continue
            r = random.Random(i)
            row, mine = (row[0], "video", "new artist", None, " ".join(pick(r, 5)), r.choice([None, 1, 5]), None), pick(r, 2)
        media.append(row)
        tags += [(row[0], t) for t in set(mine)]
        if i % 4 == 0:
            actors.append((row[0], "Actor X"))
    m = spark.createDataFrame(media, "hash string, type string, artist string, album string, title string, rating int, auto_tags array<string>")
    none = spark.createDataFrame([], "media_hash string, playlist_id string, position int")
    return Library(m, spark.createDataFrame(tags, "media_hash string, tag_id string"), spark.createDataFrame(actors, "media_hash string, actor_id string"), none)


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    lib = _library(spark, 1)
    return lib, postings.build(lib, str(tmp_path_factory.mktemp("store") / "s"), buckets=8, ranges=16)


QUERIES = ["w0 w1 w40", "still", "w3 w3 w5 video", "actor-x w0", "nothing here", "..."]


def test_equals_plain_index(made):
    lib, store = made
    assert _rows(store.rows()) == _rows(text.token_index(lib).select("hash", "token", "weight"))
    for q in QUERIES:
        assert postings.weighted_query(store, q).collect() == text.weighted_query(lib, q).collect()
        assert postings.weighted_query(store, q, 7).collect() == text.weighted_query(lib, q, 7).collect()
    for least in (1, 20):
        assert _rows(postings.token_averages(store, least)) == _rows(insights.token_averages(lib, least).select("token", "average", "count"))
        rounded = lambda df: _rows(df.select("hash", F.round("score", 9)))
        assert rounded(insights.recommendations(lib, least, store=store)) == rounded(insights.recommendations(lib, least))


def test_reopened(spark, made):
    assert postings.reopen(spark, made[1].root, buckets=8, ranges=16) == made[1]


def _scanned(df):
    """(files, rows) that the scans of a query's run have read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [0, 0], [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
        elif p.getClass().getSimpleName() == "FileSourceScanExec":
            for k, name in enumerate(("numFiles", "numOutputRows")):
                found[k] += p.metrics().apply(name).value()
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return tuple(found)


def test_reads_blocks_of_its_tokens(made):
    lib, store = made
    whole = store.read("postings")
    files, rows = _scanned(whole.groupBy("hash").count())
    of_query = postings.weighted_query(store, "w50")
    got = _scanned(of_query)
    assert 0 < got[0] < files / 2 and got[1] < rows / 4
    assert set(whole.filter("token = 'w50'").select("hash").toPandas().hash) == {r[0] for r in of_query.collect()}


def test_ends_early(spark, made, monkeypatch, tmp_path):
    monkeypatch.setattr(postings, "FREQUENT", 20)
    lib = _library(spark, 3)
    # one medium outweighs all others
    star = lib.media.filter("hash = 'h0007'").withColumn("artist", F.lit("w0 " * 20)).withColumn("album", F.lit("w0"))
    lib.media = lib.media.filter("hash <> 'h0007'").unionByName(star)
    lib.media_tags = lib.media_tags.filter("media_hash <> 'h0007'").unionByName(spark.createDataFrame([("h0007", "w0")], "media_hash string, tag_id string"))
    store = postings.build(lib, str(tmp_path / "s"), buckets=8, ranges=16)
    times, buckets = postings.query_words(store, "w0 w1")
    words = store.read("dictionary", buckets).filter(F.col("token").isin(list(times))).collect()
    steps = postings._steps(store, times, buckets, words, 10)
    assert len(steps) > 2 and sorted(r for _, rs in steps for r in rs) == list(range(16))
    read = []
    plain = postings._steps

    def spied(*a):
        for s in plain(*a):
            read.append(s)
            yield s

    monkeypatch.setattr(postings, "_steps", spied)
    for limit in (1, 3, 50, 1000):
        read.clear()
        assert postings.weighted_query(store, "w0 w1", limit, step_rows=10).collect() == text.weighted_query(lib, "w0 w1", limit).collect()
        if limit == 1:
            assert len(read) == 2  # the second is not read: its bound ends the query


def test_updates_equal_a_new_index(spark, made, tmp_path):
    _, base = made
    store, changed = base, set()
    for step, now in enumerate(([3, 10, 11, 12], [12, 13, 40, 250], [10, 100])):
        changed |= set(now)
        lib = _library(spark, 1, change=changed)
        store = postings.update(store, lib, spark.createDataFrame([(f"h{i:04d}",) for i in now], "hash string"))
        assert _rows(store.rows()) == _rows(text.token_index(lib).select("hash", "token", "weight"))
        assert _rows(postings.token_averages(store, 1)) == _rows(insights.token_averages(lib, 1).select("token", "average", "count"))
        for q in QUERIES[:4]:
            assert postings.weighted_query(store, q, 9, step_rows=50).collect() == text.weighted_query(lib, q, 9).collect()
        # only tokens of touched media are written
        v = store.versions[-1]
        tokens = {r[0] for r in spark.read.parquet(f"{store.root}/sums/v={v}").select("token").collect()}
        ids = [f"h{i:04d}" for i in now]
        old = {r[0] for r in base.rows().filter(F.col("hash").isin(ids)).select("token").collect()}
        assert tokens <= old | {r[0] for r in store.rows().filter(F.col("hash").isin([f"h{i:04d}" for i in changed])).select("token").collect()}
    small = postings.compact(store, str(tmp_path / "c"))
    assert small.versions == (0,) and _rows(small.rows()) == _rows(store.rows()) and _rows(small.sums()) == _rows(store.sums())
    assert postings.reopen(spark, base.root, buckets=8, ranges=16).versions == store.versions


def test_keywords_from_an_index_of_words(spark, tmp_path):
    def made(**change):
        lib = _library(spark, 5, **change)
        lib.media = lib.media.withColumn("path", F.concat(F.lit("dir-a/"), "hash", F.lit(".x")))
        return lib

    lib = made()
    store = postings.build(lib, str(tmp_path / "w"), buckets=8, ranges=16, kind="words")
    among = lambda library, phrases: postings.library_of(library, phrases, store)
    queries = ["w1_w2", "ann lee w44", "h0003 still", "...", "none", '"w0 w1" w40 -still', '"actor x" -"ann lee"', "alb one", '"w2 w2" w50 -w50']
    for q in queries:
        assert _rows(text.keyword_matches(lib, q, among)) == _rows(text.keyword_matches(lib, q))
        assert text.ranked_keywords(lib, q, among).collect() == text.ranked_keywords(lib, q).collect()
    files, rows = _scanned(store.read("postings").groupBy("hash").count())
    got = _scanned(postings.holding(store, ["w50 w51"]))
    assert 0 < got[0] < files and got[1] < rows / 4
    changed = made(change={3, 4, 9, 77})
    store = postings.update(store, changed, spark.createDataFrame([(f"h{i:04d}",) for i in (3, 4, 9, 77)], "hash string"))
    for q in queries[:3] + queries[5:7]:
        assert _rows(text.keyword_matches(changed, q, among)) == _rows(text.keyword_matches(changed, q))


def test_empty_library(spark, tmp_path):
    lib = _library(spark, 1, n=1)
    lib = Library(*(df.limit(0) for df in (lib.media, lib.media_tags, lib.media_actors, lib.media_playlists)))
    store = postings.build(lib, str(tmp_path / "s"))
    assert store.rows().count() == 0 and postings.weighted_query(store, "w1", 5).count() == 0 and store.sums().count() == 0


def test_postings_hold_numbers_not_hashes(made):
    lib, store = made
    rows = store.stored("postings")
    assert "hash" not in rows.columns and dict(rows.dtypes)["id"] == "bigint"
    forward = store.stored("forward")
    assert forward.count() == forward.select("id").distinct().count() == lib.media.count()  # a row per medium
    assert _rows(store.read("postings").select("hash", "token", "weight")) == _rows(store.rows())


def test_tags_as_lists_give_the_same_index(spark, made):
    lib, _ = made
    odd = [("h0001", t) for t in ("the", " The\t", "a/the/of", "x-ray 12", "12", "l'été.", "th\x01e", "")]
    tags = lib.media_tags.unionByName(spark.createDataFrame(odd, "media_hash string, tag_id string"))
    single = Library(lib.media, tags, lib.media_actors, lib.media_playlists)
    lists = Library(lib.media, tags, lib.media_actors, lib.media_playlists, single.lists_of_tags())
    assert _rows(text.token_index(lists)) == _rows(text.token_index(single))
    got = {r.token for r in text.token_index(lists).filter("hash = 'h0001'").collect()}
    assert {"x", "ray", "lt", "the"} <= got and not got & {"", "12", "of"}
