"""Hand-made cases: search, playlists, tokens, hashes, segments, updates, ingest."""

import itertools
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenshelf.functions import image_hash, scalars, video, words
from lumenshelf.operators import clones, ingest, insights, playlists, search, text, updates, vocabulary
from lumenshelf.plans.fixtures import Library
from lumenshelf.plans.ranks import ranked
from lumenshelf.sources import dump
from lumenshelf.sources import library as store

MEDIA = "hash string, path string, dir string, type string, hash_date long, rotation int, rating int, corrupted boolean, phash string, duplicate_of string, width int, height int, length int, artist string, album string, title string, created_at long, quality_cache array<int>, clones array<string>, unrelated array<string>, clone_date long"


def media(spark, rows):
    names = [x.split()[0] for x in MEDIA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], MEDIA)


@pytest.fixture(scope="module")
def lib(spark):
    m = media(
        spark,
        [{"hash": f"hash-{i}", "path": f"/tmp/{i}.jpg", "dir": "/tmp", "type": "still", "width": 1920, "height": 1080} for i in range(5)],
    )
    tags = spark.createDataFrame(
        [("hash-0", "tag-a"), ("hash-0", "tag-b"), ("hash-1", "tag-b"), ("hash-1", "tag-c")],
        "media_hash string, tag_id string",
    )
    return Library(
        m,
        tags,
        spark.createDataFrame([], "media_hash string, actor_id string"),
        spark.createDataFrame([], "media_hash string, playlist_id string, position int"),
    )


@pytest.mark.parametrize(("want", "n"), [
    ({"keywordSearch": "tag-b"}, 2), ({"quality": {"min": 1080}}, 5), ({"tags": {"equalsAny": ["tag-a", "tag-c"]}}, 2), ({"tags": {"equalsAny": ["tag-d"]}}, 0),
    ({"tags": {"equalsNone": ["tag-d"]}}, 5), ({"tags": {"equalsNone": ["tag-a", "tag-b"]}}, 3), ({"tags": {"equalsAll": ["tag-b"]}}, 2), ({"tags": {"equalsAll": ["tag-b", "tag-c"]}}, 1),
    ({"tags": {"equalsAll": ["tag-b", "tag-b"]}}, 0), ({"tags": {"exists": True}}, 2), ({"tags": {"exists": False}}, 3), ({"tags": {"equalsAny": []}}, 0),
    ({"tags": {"equalsAll": ["tag-b"], "equalsAny": ["tag-a", "tag-c"], "equalsNone": ["tag-d"], "exists": True}}, 2), ({"keywordSearch": "tag-a", "tags": {"exists": True}}, 1),
])
def test_search(lib, want, n):
    assert search.search(lib, want).count() == n


def test_form():
    form = {
        "typeVideo": True,
        "tags": {"equalsAny": ["a"], "equalsAll": []},
        "actors": {"equalsNone": []},
        "untagged": True,
        "lengthMin": 2,
        "ratingMin": -1,
        "ratingMax": 0,
        "artist": {"like": "x", "notLike": ""},
        "minimumResolution": "720",
        "sortBy": "dir",
        "keywords": "",
    }
    want = {
        "type": {"equalsAny": ["video"]},
        "tags": {"equalsAny": ["a"], "exists": False},
        "length": {"min": 120},
        "rating": {"max": 0},
        "artist": {"likeAny": ["x"]},
        "quality": {"min": 720},
    }
    assert search.form_constraints(form) == want
    assert search.form_constraints({"playlist": "p", "sortBy": "rating"}) == {"playlist": "p", "sortBy": "order"}


def test_unknown_constraint(lib):
    with pytest.raises(ValueError, match="colour"):
        search.search(lib, {"colour": "red"})


def test_queues(spark):
    rows = [
        {"hash": "a", "type": "video", "width": 1, "length": 9}, {"hash": "b", "type": "video", "width": 1, "length": 12, "corrupted": True},
        {"hash": "c", "type": "video", "duplicate_of": "a"}, {"hash": "d", "type": "still", "width": 1, "phash": "0"}, {"hash": "e", "type": "still", "width": 1},
    ]
    m = media(spark, rows).withColumn("thumbnail", F.col("hash").isin("d", "e")).withColumn("thumbnail_optimised", F.col("hash") == "d").withColumn(
        "preview",
        F.col("hash") == "c",
    )
    m = m.withColumn("preview_optimised", F.lit(None).cast("boolean")).withColumn(
        "auto_tags",
        F.when(F.col("hash") == "d", F.array(F.lit("x"))),
    )
    none = spark.createDataFrame([], "media_hash string, tag_id string, actor_id string, playlist_id string, position int")
    lib = Library(m, none, none, none)
    want = {
        "thumbnails": "a",
        "previews": "a",
        "cache": "a",
        "keyframes": "ab",
        "phash": "e",
        "clones": "d",
        "classify": "e",
        "optimise_thumbnails": "e",
        "optimise_previews": "c",
        "rescan": "ac",
    }
    assert {q: "".join(sorted(r["hash"] for r in search.search(lib, w, ["hash"]).collect())) for q, w in ingest.QUEUES.items()} == want


def entries(spark, lists):
    return spark.createDataFrame(
        [(h, p, i) for p, hs in lists.items() for i, h in enumerate(hs)],
        "media_hash string, playlist_id string, position int",
    )


def as_lists(df):
    return {r["playlist_id"]: r["hashes"] for r in playlists.ordered(df).collect()}


@pytest.mark.parametrize(("who", "to", "want"), [("4", 0, "40123"), ("0", 4, "12340"), ("0", 2, "12034"), ("2", 0, "20134"), ("2", 9, "01234"), ("2", -1, "01234"), ("9", 1, "01234")])
def test_move(spark, who, to, want):
    moved = playlists.move(
        entries(spark, {"p": "01234", "q": "1203"}),
        spark.createDataFrame([("p", who, to)], "playlist_id string, media_hash string, to int"),
    )
    assert as_lists(moved) == {"p": list(want), "q": list("1203")}
    assert sorted(r["position"] for r in moved.filter("playlist_id = 'p'").collect()) == list(range(5))


def test_append_and_remove(spark):
    e = entries(spark, {"p": "012"})
    more = spark.createDataFrame(
        [("2", "p", 0), ("5", "p", 2), ("4", "p", 1), ("5", "p", 3), ("1", "q", 0)],
        "media_hash string, playlist_id string, rank int",
    )
    e = playlists.append(e, more)
    assert as_lists(e) == {"p": list("01245"), "q": ["1"]}
    e = playlists.remove(e, spark.createDataFrame([("2", "p"), ("0", "p")], "media_hash string, playlist_id string"))
    assert {(r["media_hash"], r["position"]) for r in e.filter("playlist_id = 'p'").collect()} == {("1", 0), ("4", 1), ("5", 2)}


def plain_tokens(text):
    text = text.lower()
    for sep in words.SEPARATORS:
        text = " ".join(p for p in text.split(sep) if p.strip() not in words.STOP_WORDS)
    return [w for w in (re.sub("[^a-z0-9]", "", w) for w in text.split(" ")) if w and not re.fullmatch("[0-9]+", w)]


def test_tokens(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["the", "cat", "-", "_", ".", " ", "12", "/", "\\", "\n", "and", "é", "x1", '"', "<"]) for _ in range(12)) for _ in range(200)] + [""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", words.tokenise(F.col("t")).alias("k")).collect()
    assert {r["i"]: r["k"] for r in got} == {i: plain_tokens(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_hash_pairs_are_all_pairs(spark, most):
    rng = random.Random(5)
    base = [rng.getrandbits(256) for _ in range(8)]
    hashes = list({f"{b ^ sum(1 << k for k in rng.sample(range(256), n)):064x}" for b in base for n in (0, 1, 2, 3, 4)})
    want = {(a, b) for a, b in itertools.combinations(sorted(hashes), 2) if (int(a, 16) ^ int(b, 16)).bit_count() <= most}
    for block in (2000, 3):  # the second splits keys
        got = clones.hash_pairs(spark.createDataFrame([(h,) for h in hashes], "phash string"), most, block).collect()
        assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


def test_resolve_follows_chains(spark):
    m = media(
        spark,
        [{"hash": h, "clones": c, "duplicate_of": d} for h, c, d in (("a", ["b"], None), ("b", ["a", "c"], None), ("c", ["b"], None), ("d", [], "c"), ("e", ["f"], None), ("f", ["e"], None))],
    )
    done, bad = clones.resolve(
        m,
        spark.createDataFrame(
            [("a", ["b"], None), ("b", ["c"], ["a"]), ("e", [], None)],
            "hash string, aliases array<string>, unrelated array<string>",
        ),
    )
    assert {r["hash"]: r["duplicate_of"] for r in done.collect()} == {"a": None, "b": "a", "c": "a", "d": "a", "e": None, "f": None}
    assert [r["hash"] for r in bad.collect()] == ["e"]


def test_resolve_breaks_cycles(spark):
    edges = {"b": "a", "a": "b", "e": "d", "d": "f", "f": "e", "g": "f", "h": "g", "k": "j", "j": "i"}
    edges |= {f"x{i:03d}": f"x{(i + 1) % 40:03d}" for i in range(40)} | {f"y{i:03d}": f"y{i + 1:03d}" for i in range(70)} | {"q": "x007"}
    got = {r["alias"]: r["target"] for r in clones.final_targets(spark.createDataFrame(sorted(edges.items()), "alias string, target string")).collect()}
    want = {"b": "a", "e": "d", "f": "d", "g": "d", "h": "d", "k": "i", "j": "i", "q": "x000"} | {f"x{i:03d}": "x000" for i in range(1, 40)} | {f"y{i:03d}": "y070" for i in range(70)}
    assert got == want
    m = media(
        spark,
        [
            {"hash": "a", "clones": ["b"], "duplicate_of": "b"},
            {"hash": "b", "clones": ["a"]},
            {"hash": "c"},
            {"hash": "d", "clones": ["e", "f"]},
            {"hash": "e"},
            {"hash": "f"},
        ],
    )
    asked = spark.createDataFrame(
        [("a", ["b"], None), ("b", ["a"], []), ("c", [], None), ("d", ["e"], None), ("d", None, ["f"])],
        "hash string, aliases array<string>, unrelated array<string>",
    )
    done, bad = clones.resolve(m, asked)
    rows = {r["hash"]: r for r in done.collect()}
    assert len(rows) == 6 == done.count() and {h: r["duplicate_of"] for h, r in rows.items()} == {"a": None, "b": "a", "c": None, "d": None, "e": "d", "f": None}
    assert rows["d"]["unrelated"] == ["f"] and [r["hash"] for r in bad.collect()] == ["c"]


def test_repeated_keys_in_batches(spark):
    """Patches, sets, renames, probes, moves and changes with repeated keys multiply no rows."""
    m = media(spark, [{"hash": h, "type": "video"} for h in "abc"])
    patches = spark.createDataFrame(
        [
            ("a", 1, "x", ["rating"], 1),
            ("a", 2, "y", ["rating", "artist"], 2),
            ("a", 9, None, ["rating"], 1),
            ("n", None, "z", ["artist"], 1),
            ("n", 3, None, ["rating"], 1),
        ],
        "hash string, rating int, artist string, keys array<string>, seq int",
    )
    one = updates.upsert(m, patches).collect()
    assert sorted((r["hash"], r["rating"], r["artist"]) for r in one if r["hash"] in "an") == [("a", 2, "y"), ("n", 3, "z")] and len(one) == 4
    bridge = spark.createDataFrame([("a", "old"), ("b", "old")], "media_hash string, tag_id string")
    new = spark.createDataFrame([("a", ["p", "q", "p"]), ("a", ["q", "r"]), ("b", None)], "hash string, words array<string>")
    assert sorted(map(tuple, vocabulary.replace_sets(bridge, new, "tag_id").collect())) == [("a", "p"), ("a", "q"), ("a", "r")]
    renamed = ingest.rename_hashes(
        {"media": m, "media_tags": bridge},
        spark.createDataFrame([("a", "z"), ("a", "y"), ("b", "b")], "old string, new string"),
    )
    assert sorted(r["hash"] for r in renamed["media"].collect()) == ["b", "c", "y"] and sorted(r["media_hash"] for r in renamed["media_tags"].collect()) == ["b", "y"]
    probed = spark.createDataFrame([("a", "", "l", None), ("a", "s", "k", None)], "hash string, artist string, album string, title string")
    assert [(r["artist"], r["album"], r["title"]) for r in ingest.fill_tags(m, probed).filter("hash = 'a'").collect()] == [("s", "k", None)]
    moves = spark.createDataFrame([("p", "2", 0), ("p", "0", 2), ("p", "0", 99), ("q", "1", 1)], "playlist_id string, media_hash string, to int")
    # both moves that can be made are made: 012, 120, 210
    assert as_lists(playlists.move(entries(spark, {"p": "012", "q": "21"}), moves)) == {"p": list("210"), "q": list("21")}
    lists = spark.createDataFrame([("p", "P", None, 3)], "id string, name string, thumbnail string, size long")
    changes = spark.createDataFrame([("p", "", "t2"), ("p", "N", "t1"), ("p", "M", None)], "id string, name string, thumbnail string")
    assert [tuple(r) for r in playlists.update(lists, changes).collect()] == [("p", "M", "t1", 3)]


@pytest.mark.parametrize("within", [(), ("g",)])
def test_ranks(spark, within):
    rng = random.Random(8)
    rows = [(f"k{i:04d}", None if rng.random() < 0.1 else rng.randrange(20), "big" if i % 3 else f"g{i % 5}") for i in range(900)]
    got = {r["k"]: r["rank"] for r in ranked(spark.createDataFrame(rows, "k string, v int, g string").repartition(7), [F.col("v").desc_nulls_last()], ["k"], within).collect()}
    want = {}
    for group in {r[2] for r in rows} if within else [None]:
        mine = sorted((r for r in rows if group in (None, r[2])), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
        want |= {r[0]: i for i, r in enumerate(mine)}
    assert got == want


def test_prefilter_of_queries(spark):
    """Texts that the filter drops hold no wanted token; queries give the same with a stored index."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(["it's", "the", "cat", "-", "_", ".", " ", "12", "\\", "\n", "é", "x1", '"']) for _ in range(9)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        words.tokenise(F.col("t")).alias("k"),
        text.may_hold(F.col("t"), ["its", "catx1"]).alias("may"),
    )
    assert all(r["may"] for r in rows.collect() if {"its", "catx1"} & set(r["k"])) and not all(r["may"] for r in rows.collect())
    m = media(spark, [{"hash": f"h{i}", "type": "still", "title": t, "artist": "Cat-Lady"} for i, t in enumerate(texts[:80])]).withColumn(
        "auto_tags",
        F.array(F.lit("cat")),
    )
    bridge = lambda c: spark.createDataFrame([("h1", "cat's"), ("h1", "it's"), ("h2", "dog")], f"media_hash string, {c} string")
    lib = Library(m, bridge("tag_id"), bridge("actor_id"), spark.createDataFrame([], "media_hash string, playlist_id string, position int"))
    plain = sorted(map(tuple, text.weighted_query(lib, "its cat cat still").collect()))
    assert plain == sorted(map(tuple, text.weighted_query(lib, "its cat cat still", index=text.token_index(lib)).collect())) and len(plain) == 80
    assert text.weighted_query(lib, "...").count() == 0
    few = insights.recommendations(lib, 1, m.limit(3).select("hash")).count()
    assert few == 3 and insights.recommendations(lib, 1).count() == 80


def test_segment_stream_is_the_fold(spark):
    rng = random.Random(9)
    rows = [(i, sorted(round(rng.uniform(0, 60), 2) if i % 3 else float(rng.randrange(60)) for _ in range(rng.randrange(1, 30))), rng.choice([None, 70.0, 5.0])) for i in range(60)]
    rows = [(i, [0.0, *k] if i % 2 else k, n) for i, k, n in rows]
    df = spark.createDataFrame(rows, "id long, k array<double>, n double")
    length = F.coalesce("n", F.ceil(F.element_at("k", -1) + 1).cast("double"))
    want = df.withColumn("s", video.segments(F.col("k"), length)).select(
        "id",
        F.size("s").cast("long"),
        video.longest_segment(F.col("s")).cast("long"),
        F.element_at("s", -1)["end"],
    )
    got = video.segment_summary(df.select("id", F.explode("k").alias("at"), F.col("n").alias("length")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_content_hash(spark):
    import hashlib

    sizes = [0, 1, 65536, 65537, 100_000, 131_072, 200_000]
    data = [bytes(random.Random(n).randbytes(n)) for n in sizes]
    got = spark.createDataFrame([(d,) for d in data], "c binary").select(scalars.content_hash(F.col("c"))).collect()
    assert [r[0] for r in got] == [hashlib.md5(d if len(d) <= 65536 else d[:65536] + d[-65536:]).hexdigest() for d in data]


def test_segments(spark):
    rows = [([0.0, 4.0, 11.0, 25.0], 30), ([3.0, 14.0], 20), ([0.0], 50), ([0.0, 5.0], 8), ([0.0, 5.0, 9.0], 12)]
    got = spark.createDataFrame(rows, "k array<double>, n int").select(video.segments(F.col("k"), F.col("n")).alias("s")).collect()
    assert [[tuple(x) for x in r["s"]] for r in got] == [[(0, 11), (11, 25)], [(0, 3), (3, 14)], [(0, 50)], [(0, 8)], [(0, 12)]]


def test_image_hash():
    rng = np.random.default_rng(1)
    for w, h in ((64, 32), (50, 37), (17, 16)):
        img = rng.integers(0, 256, (h, w, 4), dtype=np.uint8)
        got = image_hash.block_hash(img.tobytes(), w, h)
        assert len(got) == 64 and int(got, 16)
    assert image_hash.block_hash(bytes(32 * 32 * 4), 32, 32) == "f" * 64  # clear pixels are white
    black = np.zeros((32, 32, 4), np.uint8)
    black[..., 3] = 255
    assert image_hash.block_hash(black.tobytes(), 32, 32) == "0" * 64
    assert image_hash.block_hash(b"", 3, 3) is None


def test_image_hash_of_even_blocks():
    """Brute force where every block is 2 x 2 pixels."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        img = rng.integers(0, 256, (32, 32, 4), dtype=np.uint8)
        img[..., 3] = rng.integers(0, 2, (32, 32))
        blocks = []
        for y, x in itertools.product(range(0, 32, 2), range(0, 32, 2)):
            four = [img[y + a, x + b].tolist() for a in (0, 1) for b in (0, 1)]
            blocks.append(sum(765 if p[3] == 0 else sum(p[:3]) for p in four))
        bits = ""
        for band in range(4):
            part = blocks[64 * band : 64 * band + 64]
            middle = sum(sorted(part)[32:34]) / 2
            bits += "".join("1" if v > middle or (abs(v - middle) < 1 and middle > 4 * 384) else "0" for v in part)
        assert image_hash.block_hash(img.tobytes(), 32, 32) == f"{int(bits, 2):064x}"


def test_image_hash_of_uneven_blocks():
    """Brute force, a pixel at a time, where lines are shared between blocks."""
    rng = np.random.default_rng(6)
    for w, h in ((50, 37), (17, 16), (16, 31), (33, 18)):
        img = rng.integers(0, 256, (h, w, 4), dtype=np.uint8)
        img[..., 3] = rng.integers(0, 2, (h, w))

        def shares(i, n):
            """(block, share) of pixel line i of n: a line whose end passes a block's edge is shared by how far it does."""
            if n % 16 == 0:
                return [(i // (n // 16), 1.0)]
            size = n / 16
            over = (i + 1) % size
            first = int(i / size)
            if over >= 1 or i + 1 == n:
                return [(first, 1.0)]
            return [(first, 1 - over), (-int(-i // size), over)]

        blocks = [0.0] * 256
        for y, x in itertools.product(range(h), range(w)):
            p = img[y, x].tolist()
            light = 765 if p[3] == 0 else sum(p[:3])
            for (by, sy), (bx, sx) in itertools.product(shares(y, h), shares(x, w)):
                if by < 16 and bx < 16:
                    blocks[16 * by + bx] += light * sy * sx
        bits = ""
        for band in range(4):
            part = blocks[64 * band : 64 * band + 64]
            middle = sum(sorted(part)[32:34]) / 2
            bits += "".join("1" if v > middle or (abs(v - middle) < 1 and middle > h / 16 * w / 16 * 384) else "0" for v in part)
        assert image_hash.block_hash(img.tobytes(), w, h) == f"{int(bits, 2):064x}", (w, h)


def test_image_hashes_take_nulls(spark):
    rows = [("a", 16, 16, bytes(16 * 16 * 4)), ("b", None, 16, b"x"), ("c", 16, 16, None), (None, 0, 0, b"")]
    got = {r["hash"]: r["phash"] for r in image_hash.image_hashes(spark.createDataFrame(rows, "hash string, width int, height int, rgba binary")).collect()}
    assert got == {"a": "f" * 64, "b": None, "c": None, None: None}


def test_list_files(spark, tmp_path):
    for name in ("a.jpg", "x y/b+1.MP4", "x y/n.txt", "x y/.gif"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12")
    got = {(r["path"], r["length"]) for r in store.list_files(spark, str(tmp_path)).collect()}
    assert got == {("a.jpg", 2), ("x y/b+1.MP4", 2)}
    files = spark.createDataFrame([("p q/1.png", b"abc"), ("2.gif", b"g"), ("3.txt", b"x"), ("4.gif", None)], "path string, content binary")
    assert store.write_tree(files, f"{tmp_path}/tree") == 4
    got = {(r["path"], bytes(r["content"])) for r in store.list_files(spark, f"{tmp_path}/tree", content=True).collect()}
    assert got == {("p q/1.png", b"abc"), ("2.gif", b"g")}


def test_sidecar(spark):
    texts = ['{"author": {"name": "n"}, "album": "b", "content": "c"}', '{"artist": "", "author": "m", "title": {"name": ""}}', "no json", None, ""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", store.sidecar(F.col("t")).alias("s")).collect()
    assert {r["i"]: tuple(r["s"]) for r in got} == {0: ("n", "b", "c"), 1: ("m", None, None), 2: (None,) * 3, 3: (None,) * 3, 4: (None,) * 3}


RECORD = """{"version": 4, "config": {"x": 1}, "tags": ["t", "u"], "actors": ["who"], "deleted": [{"hash": "z", "path": "q"}],
  "media": [
    {"hash": "a", "path": "d/a.mp4", "dir": "d", "type": "video", "rotation": 0, "hashDate": 17, "tags": ["t", "t"], "actors": ["who"], "autoTags": ["sky"], "corrupted": false, "previewOptimised": true,
     "rating": 4, "duplicateOf": "b", "cloneDate": 5, "clones": [], "unrelated": ["b"], "playlists": [{"id": "l", "order": 0}],
     "metadata": {"width": 640, "height": 480, "length": 12.5, "artist": null, "title": "T", "createdAt": 99, "codec": "h264", "qualityCache": [240, 480], "maxCopy": true, "segments": {"standard": [{"start": 0, "end": 12.5}]}}},
    {"hash": "b", "path": "b.png", "dir": ".", "type": "still", "hashDate": 18, "tags": [], "actors": []}],
  "playlists": [{"id": "l", "name": "n", "size": 2, "hashes": ["a", "b"]}, {"id": "m", "name": "o", "thumbnail": "a", "size": 0, "hashes": []}]}"""


def test_dumps(spark, tmp_path):
    """A record as servers write it, read into tables, written in both forms and read again."""
    (tmp_path / "d.json").write_text(RECORD)
    rows = lambda tables, n: sorted(tuple(r) for r in tables[n].collect())

    def check(got):
        assert rows(got, "media_tags") == [("a", "t")] and rows(got, "media_actors") == [("a", "who")] and rows(got, "media_deleted") == [("z", "q")]
        assert rows(got, "media_playlists") == [("a", "l", 0), ("b", "l", 1)] and rows(got, "playlists") == [("l", "n", None, 2), ("m", "o", "a", 0)]
        a, b = (r.asDict(recursive=True) for r in got["media"].orderBy("hash").collect())
        want = {"hash_date": 17, "auto_tags": ["sky"], "corrupted": False, "preview": None, "preview_optimised": True, "rating": 4, "duplicate_of": "b", "clone_date": 5, "clones": [], "unrelated": ["b"],
                "width": 640, "height": 480, "length": 13, "artist": None, "title": "T", "created_at": 99, "codec": "h264", "quality_cache": [240, 480], "max_copy": True, "segments": {"standard": [{"start": 0.0, "end": 12.5}]}}
        assert {k: a[k] for k in want} | {"segments": a["segments"]} | {"segments": want["segments"]} == want
        assert b["dir"] == "." and all(b[c] is None for c in (*dump.METADATA, "rotation", "clones", "auto_tags"))

    got = dump.load_single(spark, str(tmp_path / "d.json"))
    check(got)
    assert rows(got, "tags") == [("t",), ("u",)]
    lib = Library(got["media"], got["media_tags"], got["media_actors"], got["media_playlists"])
    dump.export(lib, got["playlists"], got["media_deleted"], str(tmp_path / "lines"))
    check(dump.load(spark, str(tmp_path / "lines")))
    line = next(json.loads(x) for f in sorted((tmp_path / "lines/media").glob("part*")) for x in f.read_text().splitlines() if '"hash":"a"' in x)
    assert line["metadata"]["qualityCache"] == [240, 480] and line["hashDate"] == 17 and line["playlists"] == [{"id": "l", "order": 0}]
    dump.export_record(lib, got["playlists"], got["media_deleted"], str(tmp_path / "record"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "record").glob("part*")))
    made = json.loads(text)
    assert made["version"] == 4 and made["tags"] == ["t"] and [m["hash"] for m in made["media"]] == ["a", "b"] and "metadata" not in made["media"][1]
    (tmp_path / "again.json").write_text(text)
    check(dump.load_single(spark, str(tmp_path / "again.json")))
    none = {n: df.limit(0) for n, df in got.items()}
    dump.export_record(
        Library(none["media"], none["media_tags"], none["media_actors"], none["media_playlists"]),
        none["playlists"],
        none["media_deleted"],
        str(tmp_path / "none"),
    )
    assert json.loads("".join(f.read_text() for f in sorted((tmp_path / "none").glob("part*")))) == {"version": 4, "media": [], "playlists": [], "deleted": [], "tags": [], "actors": []}


def test_import_rules(spark):
    rows = [
        {"hash": "v", "path": "/lib/x/v.mp4", "dir": "/lib/x", "type": "video", "width": 0, "height": 240},
        {"hash": "g", "path": "g.gif", "dir": ".", "type": "gif", "width": 5, "height": 7, "rotation": 90},
        {"hash": "n", "type": "still"},
        {"hash": "z", "type": "still", "width": 0, "height": 3},
    ]
    m = media(spark, rows).withColumn("max_copy", F.lit(None).cast("boolean"))
    for version in (None, 3, 2, 4):
        ok, bad = ingest.normalise_import(m, "/lib", version)
        got = {r["hash"]: (r["path"], r["dir"], r["rotation"], r["quality_cache"], r["max_copy"]) for r in ok.collect()}
        old = version in (None, 3)
        assert got.pop("v") == ("x/v.mp4", "x", 0, [240] if old else None, True if old else None) and got.pop("g") == ("g.gif", ".", 90, [7] if old else None, None)
        assert set(got) == (set() if old else {"z"}) and {r["hash"]: r["reason"] for r in bad.collect()} == {"n": "no metadata"} | ({"z": "no width"} if old else {})


def test_scalars(spark):
    rows = spark.createDataFrame([("a/b.c/x.MP4", 3723), (".gif", 0), ("y.tar.txt", 360000), (None, None)], "p string, s int")
    got = rows.select(scalars.media_type(F.col("p")), scalars.dir_name(F.col("p")), scalars.duration(F.col("s"))).collect()
    assert [tuple(r)[:2] for r in got] == [("video", "a/b.c"), (None, "."), (None, "."), (None, ".")] and [r[2] for r in got][:3] == ["01:02:03", "00:00:00", "100:00:00"]


def test_upsert_tells_null_from_absent(spark):
    m = media(spark, [{"hash": "a", "rating": 3, "artist": "x"}, {"hash": "b", "rating": 4}])
    p = spark.createDataFrame(
        [("a", None, "y", ["rating"]), ("c", 5, "z", ["rating"])],
        "hash string, rating int, artist string, keys array<string>",
    )
    assert {r["hash"]: (r["rating"], r["artist"]) for r in updates.upsert(m, p).collect()} == {"a": (None, "x"), "b": (4, None), "c": (5, None)}


def test_empty_library(spark):
    none = media(spark, [])
    listing = spark.createDataFrame([], "path string")
    assert ingest.scan_diff(listing, none, spark.createDataFrame([], "hash string, path string")).count() == 0
    assert clones.clone_map(none).count() == 0
    assert search.neighbour_dirs(none).count() == 0


def test_match_missing(spark):
    paths = [None, "", "en/aa.mp4", "EN/aaa.mp4", "en/ab.gif", "dé/Aa", "x" * 300 + "aa"]
    gone = [None, "", "AA", "aa", "en/", "é/a", "aa.MP4", "en/ab.gif", "nope", "x" * 301, "a_", "x" * 300] + [f"many/{i}" for i in range(10_100)]
    m = spark.createDataFrame(list(enumerate(paths)), "hash long, path string").withColumn("hash", F.concat(F.lit("h"), "hash"))
    got = {r["path"]: (r["n"], r["hash"]) for r in ingest.match_missing(m, spark.createDataFrame([(g,) for g in gone + gone[:4]], "path string")).collect()}
    held = {g: [f"h{i}" for i, p in enumerate(paths) if g is not None and p is not None and g.lower() in p.lower()] for g in gone}
    assert got == {g: (len(h), h[0] if len(h) == 1 else None) for g, h in held.items()}


def test_incremental(spark, tmp_path):
    from lumenshelf.streaming import ingest as stream

    store_ = f"{tmp_path}/store"
    rows = [{"hash": h, "path": f"x/{h}.jpg", "dir": "x", "type": "still"} for h in "ac"]
    media(spark, rows).write.parquet(f"{store_}/media/version=0")
    spark.createDataFrame([("d", "x/d.jpg")], "hash string, path string").write.parquet(f"{store_}/media_deleted/version=0")

    def arrive(*files):
        spark.createDataFrame(files, stream.FILES).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream.start(spark, f"{tmp_path}/in", store_, f"{tmp_path}/check", 9).awaitTermination()
        return {r["hash"]: r["path"] for r in stream.current(spark, store_)[0].collect()}

    first = ("x/b.png", "b"), ("y/a.jpg", "a"), ("x/d2.gif", "d"), ("x/n.txt", "n"), ("x/c.jpg", "c")
    assert arrive(*first) == {"a": "y/a.jpg", "b": "x/b.png", "c": "x/c.jpg"}
    assert spark.read.parquet(f"{store_}/media/version=1").count() == 2 and stream.current(spark, store_)[1].count() == 2
    # the second batch changes what the first added
    assert arrive(("z/b.png", "b"), ("x/e.gif", "e")) == {"a": "y/a.jpg", "b": "z/b.png", "c": "x/c.jpg", "e": "x/e.gif"}
    assert {r["hash"] for r in stream.current(spark, store_, 1)[0].collect()} == set("abc")
    # a snapshot under the stream, whose checkpoint goes on
    assert stream.compact(spark, store_) == 2 and stream.snapshots(spark, store_) == [2]
    assert arrive(("z/e.gif", "e"), ("x/f.gif", "f")) == {"a": "y/a.jpg", "b": "z/b.png", "c": "x/c.jpg", "e": "z/e.gif", "f": "x/f.gif"}
    assert {r["hash"] for r in stream.current(spark, store_, 1)[0].collect()} == set("abc")
    # a batch that is run again reads what it read before, over a later snapshot too
    assert stream.compact(spark, store_) == 3
    (tmp_path / "check" / "commits" / "2").unlink()
    (tmp_path / "check" / "commits" / ".2.crc").unlink(missing_ok=True)
    assert arrive(("q/a.jpg", "a")) == {"a": "q/a.jpg", "b": "z/b.png", "c": "x/c.jpg", "e": "z/e.gif", "f": "x/f.gif"}
    stream.prune(spark, store_, 3)
    assert stream.versions(spark, store_) == [4] and stream.snapshots(spark, store_) == [3]
    assert {r["hash"]: r["path"] for r in stream.current(spark, store_)[0].collect()} == {"a": "q/a.jpg", "b": "z/b.png", "c": "x/c.jpg", "e": "z/e.gif", "f": "x/f.gif"}
    assert stream.current(spark, store_)[1].count() == 2
