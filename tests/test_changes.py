"""Ranged reads, contained paths, sequences of moves, and change sets that shuffle no media."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from lumenshelf.functions import scalars
from lumenshelf.operators import ingest, playlists, substrings, updates, vocabulary
from lumenshelf.sources import library as store


def test_hashes_read_two_ranges(spark, tmp_path):
    sizes = {"a.jpg": 1, "b.gif": 65536, "sub dir/c+d%20é.mp4": 65537, "50%.gif": 3, "e.png": 131_072, "f.webm": 200_000}
    for name, n in sizes.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(random.Random(n).randbytes(n))
    with open(tmp_path / "huge.mkv.mp4", "wb") as f:  # sparse: takes no disk
        f.write(b"head" * 20_000)
        f.truncate(3 << 30)
        f.seek((3 << 30) - 4)
        f.write(b"tail")
    listed = store.list_files(spark, str(tmp_path))
    got = {r["path"]: r for r in store.hash_files(listed, str(tmp_path)).collect()}
    assert len(got) == 7 and all(r["bytes_read"] <= 131_072 for r in got.values())
    for name in sizes:
        data = (tmp_path / name).read_bytes()
        assert got[name]["hash"] == hashlib.md5(data if len(data) <= 65536 else data[:65536] + data[-65536:]).hexdigest()
    huge = got["huge.mkv.mp4"]
    assert huge["length"] == 3 << 30 and huge["hash"] == hashlib.md5((b"head" * 20_000)[:65536] + bytes(65532) + b"tail").hexdigest()
    small = spark.createDataFrame([(n, (tmp_path / n).read_bytes()) for n in sizes], "path string, c binary")
    assert {r["path"]: r["h"] for r in small.select("path", scalars.content_hash(F.col("c")).alias("h")).collect()} == {n: got[n]["hash"] for n in sizes}


def test_hash_of_a_lost_file(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"x")
    (tmp_path / "b.jpg").write_bytes(b"y")
    listed = spark.createDataFrame(store.list_files(spark, str(tmp_path)).collect())
    os.remove(tmp_path / "b.jpg")
    got = {r["path"]: r["hash"] for r in store.hash_files(listed, str(tmp_path)).collect()}
    assert got == {"a.jpg": hashlib.md5(b"x").hexdigest(), "b.jpg": None}


def test_parts_in_texts(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abé/😀") for _ in range(rng.randrange(0, 30))) for _ in range(300)] + ["", None, "é", "a" * 5000]
    parts = sorted({t[i : i + n] for t in texts if t for n in (1, 2, 3, 7) for i in range(0, len(t), 5)} | {"", "nope", "é", "a" * 4999, "a" * 5001})
    want = {p: [f"k{i:04d}" for i, t in enumerate(texts) if t is not None and p in t] for p in parts}
    keyed = spark.createDataFrame([(f"k{i:04d}", t) for i, t in enumerate(texts)], "key string, text string")
    given = spark.createDataFrame([(p,) for p in parts], "part string")
    for most in (substrings.FILTER_PARTS, 0):
        if not most:
            given = given.filter(F.length("part") < 50)
        got = {r["part"]: (r["n"], r["key"]) for r in substrings.containing(keyed, given, most).collect()}
        assert got == {p: (len(w), w[0] if w else None) for p, w in want.items() if most or len(p) < 50}


def test_only_hits_leave_a_task(spark):
    paths = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("hash"), F.concat(F.lit("some/long/folder/name/"), "id", F.lit(".mp4")).alias("path"))
    gone = spark.createDataFrame([("NAME/77",), ("folder/none",)], "path string")
    got = ingest.match_missing(paths, gone)
    rows = {r["path"]: r["n"] for r in got.collect()}
    assert rows["folder/none"] == 0 and rows["NAME/77"] == sum(f"name/77" in f"some/long/folder/name/{i}.mp4" for i in range(3000))
    found = paths.select(F.col("hash").alias("key"), F.col("path").alias("text")).mapInArrow(
        substrings._scan(*_keys(["name/77", "folder/none"])), "key string, part string",
    )
    assert found.count() == rows["NAME/77"]


def _keys(parts):
    import numpy as np

    return np.unique(np.array([substrings.part_hash(p.encode()) for p in parts], np.uint64)), sorted({len(p.encode()) for p in parts})


def _one_by_one(media, moves):
    media = list(media)
    for m, to in moves:
        if m in media and 0 <= to < len(media):
            media.remove(m)
            media.insert(to, m)
    return media


def test_sequences_of_moves(spark, monkeypatch):
    monkeypatch.setattr(playlists, "BLOCK", 7)
    rng = random.Random(11)
    lists, moves = {}, []
    for k in range(60):
        n = rng.choice([0, 1, 2, 5, 30, 31])
        lists[f"p{k}"] = [f"m{i}" for i in rng.sample(range(100), n)]
        for seq in range(rng.choice([0, 1, 2, 5, 40])):
            moves.append((f"p{k}", rng.choice([*lists[f"p{k}"], "m1", "other"]), rng.randrange(-1, n + 2), seq))
    entries = spark.createDataFrame([(m, p, i) for p, ms in lists.items() for i, m in enumerate(ms)], "media_hash string, playlist_id string, position int")
    given = spark.createDataFrame(random.Random(1).sample(moves, len(moves)), "playlist_id string, media_hash string, to int, seq int")
    got = {}
    for r in playlists.in_order(playlists.move(entries, given)).collect():
        got.setdefault(r["playlist_id"], []).append(r["media_hash"])
        assert r["position"] == len(got[r["playlist_id"]]) - 1
    assert got == {p: _one_by_one(ms, [(m, to) for q, m, to, _ in moves if q == p]) for p, ms in lists.items() if ms}


@pytest.mark.parametrize("seed", range(30))
def test_folded_moves(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 60)
    media = [f"m{i}" for i in range(n)]
    moves = [(rng.choice(media), rng.randrange(n)) for _ in range(rng.randrange(1, 80))]
    moved, stretches = playlists.folded([m for m, _ in moves], [media.index(m) for m, _ in moves], [to for _, to in moves])
    out = [None] * n
    for i, m in enumerate(media):
        out[moved[m] if m in moved else i + [s for p, s in stretches if p <= i][-1]] = m
    assert out == _one_by_one(media, moves)


def test_moves_of_a_playlist_are_all_made(spark):
    entries = spark.createDataFrame([(m, "p", i) for i, m in enumerate("abcde")], "media_hash string, playlist_id string, position int")
    moves = spark.createDataFrame([("p", "a", 4, 0), ("p", "e", 0, 1)], "playlist_id string, media_hash string, to int, seq int")
    assert [r["media_hash"] for r in playlists.in_order(playlists.move(entries, moves)).collect()] == list("ebcda")


def _exchanges(df, rows):
    """Exchanges of a plan that read as many rows as media have."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = 0, [plan]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif name == "ShuffleExchangeExec":
            found += p.metrics().apply("shuffleRecordsWritten").value() >= rows
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_small_changes_shuffle_no_media(spark, tmp_path):
    n = 20_000
    spark.range(n).select(F.md5(F.col("id").cast("string")).alias("hash"), (F.col("id") % 5).cast("int").alias("rating"), F.lit("x").alias("path"), F.lit(None).cast("string").alias("duplicate_of")).write.parquet(f"{tmp_path}/m")
    media = spark.read.parquet(f"{tmp_path}/m")
    few = media.orderBy("hash").limit(9).select("hash").collect()
    patches = spark.createDataFrame([(r["hash"], 3, ["rating"]) for r in few] + [("new", 4, ["rating"])], "hash string, rating int, keys array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # only what is checked may be broadcast
    try:
        out = updates.upsert(media, patches)
        assert _exchanges(out, n // 10) == 0
        assert out.count() == n + 1 and out.filter("hash = 'new' and rating = 4 and path is null").count() == 1 and out.filter("rating = 3").count() >= 9
        assert _exchanges(updates.bulk_update(media, patches, {"rating": 1})[0], n // 10) == 0
        changes = patches.select(F.col("hash").alias("old"), F.concat(F.lit("z"), "hash").alias("new"))
        renamed = ingest.rename_hashes({"media": media}, changes)["media"]
        assert _exchanges(renamed, n // 10) == 0 and renamed.filter("hash like 'z%'").count() == 9
        bridge = media.select(F.col("hash").alias("media_hash"), F.col("rating").cast("string").alias("tag_id"))
        gone = spark.createDataFrame([("2",), ("2",)], "id string")
        assert _exchanges(vocabulary.remove_words(gone, bridge, gone, "tag_id")[1], n // 10) == 0
        assert vocabulary.remove_words(gone, bridge, gone, "tag_id")[1].count() == n * 4 // 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_changes_equal_small_ones(spark, monkeypatch):
    from lumenshelf.plans import sizes

    media = spark.range(200).select(F.col("id").cast("string").alias("hash"), F.col("id").cast("int").alias("rating"))
    patches = spark.range(150, 260).select(F.col("id").cast("string").alias("hash"), F.lit(-1).alias("rating"), F.array(F.lit("rating")).alias("keys"))
    small = sorted(map(tuple, updates.upsert(media, patches).collect()))
    monkeypatch.setattr(updates, "narrow", lambda df, name: sizes.narrow(df, name, 0))
    assert sorted(map(tuple, updates.upsert(media, patches).collect())) == small and len(small) == 260


def test_clones_of_batches(spark, tmp_path):
    """Batches in any order, with changed and lost hashes, end in the classes of a full run; only touched buckets are read."""
    from test_postings import _scanned

    from lumenshelf.operators import bands, clones

    rng = random.Random(3)
    roots = [rng.getrandbits(256) for _ in range(12)]
    near = lambda: f"{rng.choice(roots) ^ sum(1 << rng.randrange(256) for _ in range(rng.randrange(3))):064x}"
    state = {f"m{i:03d}": rng.choice([near(), near(), near(), None, "short"]) for i in range(260)}
    state |= {f"s{i:03d}": "f" * 32 + f"{i:032x}" for i in range(60)}  # one band that many share
    batches, items = [], list(state.items())
    rng.shuffle(items)
    for k in range(0, len(items), 90):
        batches.append(dict(items[k : k + 90]))
    batches.append({h: near() for h in rng.sample(sorted(state), 30)} | {h: None for h in rng.sample(sorted(state), 9)})
    store, now = bands.BandStore(spark, str(tmp_path / "b"), buckets=16), {}
    for batch in batches:
        store = bands.add(store, spark.createDataFrame(list(batch.items()), "hash string, phash string"), block=7)
        now |= batch
        media = spark.createDataFrame([(h, p, "still", None) for h, p in now.items()], "hash string, phash string, type string, duplicate_of string")
        want = clones.clone_classes(media)
        for got, full in zip(store.classes(), want, strict=True):
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full.collect()))
    lists = lambda df: sorted((r["hash"], tuple(r["clones"])) for r in df.collect())
    assert lists(clones.clone_map(media, classes=store.classes())) == lists(clones.clone_map(media))
    assert bands.reopen(spark, store.root, buckets=16) == store
    one = spark.createDataFrame([("new", now["s001"][:63] + "0")], "hash string, phash string")
    numbers = clones.banded(one, 2).select(F.pmod(F.xxhash64("pos", "key"), F.lit(16))).distinct().collect()
    assert _scanned(store.read("bands", [r[0] for r in numbers]))[0] < _scanned(store.read("bands"))[0]
