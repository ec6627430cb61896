"""The stored trigram index against scans."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_postings import _scanned

from lumenshelf.operators import grams, search
from lumenshelf.plans.fixtures import Library, spark_view

WANTS = [
    {"title": {"likeAny": ["Abc", "zzz"]}},
    {"title": {"likeAll": ["abc", "cab"]}},
    {"title": {"likeAny": ["ab", "", "caba"]}},
    {"title": {"likeNone": ["ABC", "b"]}},
    {"title": {"likeAny": ["bca", "äß"], "likeNone": ["cc"]}, "path": {"likeAll": ["/X1", ".jpg"]}},
    {"title": {"likeAny": ["not there at all"]}},
    {"title": {"likeNone": ["not there at all"]}},
    {"title": {"likeAny": ["𝒳y😀"], "likeAll": []}},
    {"title": {"likeAny": ["cab"], "before": "b", "exists": True}, "path": {"likeNone": ["x2"]}},
    {"title": {"likeAll": ["abca", "bcab", "b"], "likeAny": ["aab", "c"]}},
]


def _media(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows = [(f"h{i}", f"d/x{i % 7}/{i}.{'jpg' if i % 2 else 'PNG'}", "".join(rng.choices("aAbBc", k=rng.randrange(40)))) for i in range(n)]
    rows += [("e0", "d/e", None), ("e1", None, ""), ("e2", "p", "ab"), ("e3", "p", "xäSSÄß"), ("e4", "p", "a𝒳Y😀b"), ("e5", "p", "abc" * 50_000)]
    return spark.createDataFrame(rows, "hash string, path string, title string")


def _both(media, want, made):
    lib = Library(media, *[None] * 3)
    return [sorted(r[0] for r in search.search(lib, want, ["hash"], grams=g).collect()) for g in (None, made)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    return _media(spark), grams.build(_media(spark), str(tmp_path_factory.mktemp("g")), buckets=8, parts=2, places=16)


@pytest.mark.parametrize("want", WANTS)
def test_equals_scan(made, want):
    media, store = made
    assert grams.reopen(store.spark, store.root) == store
    a, b = _both(media, want, store)
    assert a == b


def test_updates(spark, tmp_path):
    media = _media(spark)
    store = grams.build(media, str(tmp_path / "g"), buckets=8, parts=2, places=16)
    changed = spark.createDataFrame([("h1", "d/x1/new.jpg", "cabcab"), ("h2", None, None), ("new", "q.jpg", "bcabca"), ("new", "q.jpg", "bcabca")], media.schema)
    store.add(changed)
    now = media.join(changed, "hash", "left_anti").unionByName(changed.distinct())
    assert store.current().count() == now.count()
    for want in WANTS:
        a, b = _both(now, want, store)
        assert a == b
    # a version that was never finished doesn't exist, and its number isn't given again
    media.limit(1).select("hash", "path", "title", F.lit(0).alias("place")).write.partitionBy("place").parquet(f"{store.root}/rows/v=2")
    assert store.versions() == [0, 1]
    store.add(changed.limit(1))
    assert store.versions() == [0, 1, 3]


def test_reads_few_files(spark, tmp_path):
    rows = spark.range(400).select(F.concat(F.lit("h"), "id").alias("hash"), F.concat(F.lit("all alike "), F.md5(F.col("id").cast("string"))).alias("title"))
    store = grams.build(rows, str(tmp_path / "g"), ["title"], buckets=64, parts=2, places=32)
    whole = rows.filter("hash = 'h7'").first()["title"]
    found = store.find("title", {"likeAny": [whole[-12:]]})
    files, read = _scanned(found)
    assert [r[0] for r in found.collect()] == ["h7"]
    assert read < 60 and files <= 2  # one place, and the candidates
    hits = store._having("title", {whole[k : k + 3] for k in range(12, 24)})
    assert _scanned(hits)[0] <= 2 * grams.PICKED < _scanned(store.read("grams"))[0] / 4


def test_empty(spark, tmp_path):
    none = _media(spark).limit(0)
    store = grams.build(none, str(tmp_path / "g"))
    for want in WANTS[:4]:
        assert _both(none, want, store) == [[], []]


def _shuffled(spark, since=-1):
    """(bytes that stages after ``since`` have shuffled, the last stage)."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = lambda: sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())
    found = [(s.stageId(), s.shuffleWriteBytes()) for s in (stages.apply(i) for i in range(stages.size()))]
    return sum(b for i, b in found if i > since), max((i for i, _ in found), default=-1)


def test_moves_texts_once_and_trigrams_as_lists(spark, tmp_path):
    rng = random.Random(2)
    titles = {f"h{i}": "".join(rng.choices("abcdef", k=2000)) for i in range(1500)}
    rows = spark.createDataFrame([*titles.items(), ("h0", titles["h0"])], "hash string, title string").repartition(4)
    _, since = _shuffled(spark)
    store = grams.build(rows, str(tmp_path / "g"), ["title"], buckets=4, parts=2, places=4)
    own = 1500 * 2000  # that the test's rows are dealt is one exchange of them
    assert _shuffled(spark, since)[0] < 2.2 * own
    lists = store.read("grams")
    places = store.read("rows").select("v", "place", "id", "hash")
    told = lists.select("v", "place", "first", "gram", F.explode("offsets").alias("at")).withColumn("id", F.col("first") + F.col("at")).join(places, ["v", "place", "id"])
    want = {(h, t[k : k + 3]) for h, t in titles.items() for k in range(1998)}
    got = [(r.hash, r.gram) for r in told.collect()]
    assert len(got) == len(want) and set(got) == want
    assert lists.count() < len(want) / 100
    assert sum(r.n for r in store.read("counts").collect()) == sum(r.n for r in lists.collect()) == len(want)


def test_lists_of_far_numbers(monkeypatch):
    rng = random.Random(3)
    rows = [(p, start + i * step, "".join(rng.choices("abc", k=rng.randrange(9))) or None, "abcd") for p, start, step in ((0, 0, 1), (1, 1 << 33, 9_000), (1, 1 + (1 << 33), 70_000), (2, 100, 1)) for i in range(30)]
    rows += [(2, 5, "abc", None), (2, 1, "ab", "")]  # smaller numbers after larger ones
    names = ["place", "id", "path", "title"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[k : k + 7]], pa.schema(zip(names, (pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True))) for k in range(0, len(rows), 7)]
    want = sorted((c, t[k : k + 3], p, i) for p, i, *texts in rows for c, t in zip(names[2:], texts, strict=True) for k in range(len(t or "") - 2))
    for held in (0, 20, grams.HELD):
        monkeypatch.setattr(grams, "HELD", held)
        lists = [r for b in grams._lists(iter(batches)) for r in b.to_pylist()]
        got = sorted((r["column"], r["gram"], r["place"], r["first"] + o) for r in lists for o in r["offsets"])
        assert got == sorted(set(want)) and all(r["n"] == len(r["offsets"]) for r in lists)
    assert list(grams._lists(iter([]))) == []


def test_values_are_not_joined_with_labels(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}", "en", "src", 6) for i in (1, 2, 2, 7)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (1, 0, 1), (9, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    values = lambda unused: spark_view(spark, str(tmp_path), "media", unused).select("hash", "path", "title")
    few = values(("labels",))
    assert "Join" not in few._jdf.queryExecution().executedPlan().toString() and "Join" in values(())._jdf.queryExecution().executedPlan().toString()
    assert set(map(tuple, few.collect())) == set(map(tuple, values(()).collect())) and few.count() == 4
