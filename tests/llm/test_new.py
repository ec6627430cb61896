"""Operators 11 to 13 against brute force, and long white space, archive order and link propagation."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenshelf.llm import merkle, nn_descent, packing, periodic, separators, tokens, toxicity, url_filters, warc

# ---- 11 -----------------------------------------------------------------------------


def _brute(rows, asks, top):
    """Expected (query_id, [(score, vec_id)]) by all inner products; rows (vec_id, vector)."""
    fine = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for k, (q, v) in enumerate(fine):
        if asks(q):
            near = [(-float(np.dot(v, w)), i is None, i or 0, i) for j, (i, w) in enumerate(fine) if j != k and len(w) == len(v)]
            out.append((q, [(-s, i) for s, _, _, i in sorted(near)[:top]]))
    return out


def _found(df):
    by = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        by[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    for rows in by.values():
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    return {q: [(s, i) for _, s, i in rows] for q, rows in by.items()}


def test_nearest_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(4).round(1).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(30)]  # one vector many times
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 2.0, 3.0]), (204, [1.0, float("nan"), 0.0, 1.0]), (205, [1e2, 0.0, -1e2, 5.0])]
    rows += [(206, [1.0, 2.0]), (208, [2.0, -1.0]), (210, [0.5, 0.5]), (None, [1.0, 1.0, 1.0, 1.0]), (212, [1e-30, 0.0, 0.0, 0.0]), (214, [1e-2, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], "vec_id long, embedding array<double>, node string, query int, row string")
    got = _found(nn_descent.nearest(df, F.col("vec_id") % 2 == 0, top=5, k=8))
    want = dict(_brute(rows, lambda q: q is not None and q % 2 == 0, 5))
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [i for _, i in got[q]] == [i for _, i in near]
        np.testing.assert_allclose([s for s, _ in got[q]], [s for s, _ in near], rtol=1e-12)


def test_nearest_repeated_ids_and_few_rows(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.9, 0.1]), (20, [1.0, 0.0]), (3, [0.5, 0.5]), (None, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nn_descent.nearest(df, F.col("vec_id") % 20 == 0, top=20)
    assert got.count() == 3 * 4
    # equal scores: the smaller id first, null last
    tied = [(r["rank"], r["vec_id"]) for r in got.collect() if abs(r["score"] - 0.5) < 1e-6]
    assert sorted(tied, key=str) == sorted([(3, 3), (4, None)] * 3, key=str)
    none = nn_descent.nearest(df.limit(0), F.col("vec_id") % 20 == 0)
    assert none.count() == 0 and none.columns == ["query_id", "rank", "vec_id", "score"]
    assert nn_descent.nearest(df.limit(1), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_recall_in_clusters_and_norms(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((20, 24))
    x = centres[rng.integers(0, 20, 3000)] + 0.5 * rng.standard_normal((3000, 24))
    x *= rng.uniform(0.2, 3, (3000, 1))  # the longest are near to many
    x[:900] = x[0] + 1e-3 * rng.standard_normal((900, 24))  # near copies are a third
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = _found(nn_descent.nearest(df, F.col("vec_id") % 20 == 0))
    shares = []
    for q, near in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        shares.append(len({i for _, i in near} & set(np.argsort(-s)[:20].tolist())) / 20)
    assert len(got) == 150 and np.mean(shares) >= 0.9


def test_best_of_lists():
    u, v, s = np.array([1, 1, 1, 2, 1]), np.array([5, 6, 5, 9, 7]), np.array([0.5, 0.9, 0.5, 0.1, 0.7], np.float32)
    state = np.array([2, 2, 0, 2, 1], np.int8)
    assert [x.tolist() for x in nn_descent.best(u, v, s, state, 2)][:2] == [[1, 1, 2], [6, 7, 9]]
    assert nn_descent.best(u, v, s, state, 9)[3].tolist() == [2, 1, 0, 2]
    x = np.random.default_rng(1).standard_normal((50, 9))
    assert np.abs(nn_descent.decoded(nn_descent.encoded(x)) - x).max() < 4 * np.abs(x).max() / 65534


# ---- 12 -----------------------------------------------------------------------------


def _runs(w):
    """All runs (start, length, period) by trying every period at every place."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if length >= max(24, 3 * q) and not any(all(w[s + k] == w[s + k + r] for k in range(length - r)) for r in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _words(rng):
    n, a, w = rng.choice([1, 23, 24, 25, 40, 70, 150, 260]), rng.choice([1, 2, 3, 50]), []
    while len(w) < n:
        if rng.random() < 0.6:
            root = [rng.randrange(a) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 20, 31, 32, 33, 40]))]
            w += [root[i % len(root)] for i in range(rng.randrange(1, 120))]
        else:
            w += [rng.randrange(a) for _ in range(rng.randrange(1, 20))]
    return [f"é{x}" for x in w[:n]]


def _expected(doc, words):
    runs = _runs(words)
    keep = [not any(s + q <= i < s + n for s, n, q in runs) for i in range(len(words))]
    top = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for w, k in zip(words, keep, strict=True) if k)))


def test_periodic_runs_are_brute_force(spark):
    rng = random.Random(3)
    texts = [_words(rng) for _ in range(150)]
    # between words any of the six white-space characters; others belong to words
    rows = [(i, "".join(w + rng.choice([" ", "\t", "\n", "\x0b\x0c", "\r  "]) for w in t)) for i, t in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "a\x1ca b " * 30), (None, "x y " * 12), (904, "x y " * 12), (904, "x y " * 12)]
    want = [_expected(i, t) for i, t in enumerate(texts)]
    want += [_expected(i, []) for i in (900, 901, 902)] + [_expected(903, ["a\x1ca b"] * 30)] + [_expected(i, ["x", "y"] * 12) for i in (None, 904, 904)]
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, key int, period string, words int")
    for core in (16, periodic.CORE):  # many small tiles, or one for each octave
        got = periodic.run_summaries(df, core=core)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert periodic.run_summaries(df.limit(0)).count() == 0


def test_periodic_runs_of_a_long_text(spark):
    """Runs across tiles, up to a third of the text, and a text of one word."""
    rng = random.Random(5)
    root = [f"r{rng.randrange(900)}" for _ in range(40_000)]
    words = [f"n{i}" for i in range(5000)] + (root * 4)[:130_001] + ["end"] + ["same"] * 70_000
    df = spark.createDataFrame([(1, " ".join(words)), (2, "a " * 200_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic.run_summaries(df).collect()}
    runs = [(5000, 130_001, 40_000), (135_002, 70_000, 1)]
    assert got[1]["n_runs"] == 2 and got[1]["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    assert (got[1]["start"], got[1]["length"], got[1]["period"]) == runs[1]
    kept = words[:45_000] + ["end", "same"]
    assert got[1]["collapsed_sha256"] == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    assert (got[2]["n_runs"], got[2]["start"], got[2]["length"], got[2]["period"], got[2]["exponent_milli"]) == (1, 0, 200_000, 1, 200_000_000)


def test_z_function_and_tail():
    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 30))]
        want = [0] + [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]
        assert periodic.z_function(s, len(s)) == want and periodic.z_function(s, 3) == want[:3]
    assert periodic.repeated_tail(None, [b"a"]) == [b"a"] and periodic.repeated_tail(1, []) == []
    doc = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    words = [b"%d" % i for i in range(90)]
    g = zlib.crc32(str(doc).encode()) // 10
    a = g % 90
    p = 1 + (90 - a) // (3 + g % 8)
    assert periodic.repeated_tail(doc, words) == [words[i] if i < a else words[a + (i - a) % p] for i in range(90)]


# ---- 13 -----------------------------------------------------------------------------


def _manifest(rows):
    """(doc_id, source, lang, n_chars, text) to expected rows, by plain recursion over lists."""
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def tree(nodes):
        """(root, for each node the (left, right) siblings on its way up)."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, k in enumerate(at):
                low = k // 8 * 8
                paths[i].append(("".join(nodes[low:k]), "".join(nodes[k + 1 : low + 8])))
            nodes, at = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [k // 8 for k in at]
        return nodes[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, h(*map(field, r)), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    parts = {x: (sorted(groups[x], key=lambda t: t[:3]), *tree([t[2] for t in sorted(groups[x], key=lambda t: t[:3])])) for x in langs}
    root, tops = tree([parts[x][1] for x in langs])
    out = []
    for x, top in zip(langs, tops, strict=True):
        leaves, sub, paths = parts[x]
        for (_, _, leaf, r), path in zip(leaves, paths, strict=True):
            steps = [*path, *top]
            now = h(*map(field, (*r[:4], lower(r[4])))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf
            for a, b in steps:
                now = h(a, now, b)
            out.append((r[0], leaf, sub, root, h(*[a + b for a, b in steps]), now, now == root))
    return out


def _of_documents(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos int, grp string")
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    got = merkle.manifest(df, tampered={"text": merkle.lower_ascii(F.col("text"))}, where=third)
    return [tuple(r) for r in got.collect()]


@pytest.mark.parametrize("depth", [1, 2])
def test_manifest_is_brute_force(spark, monkeypatch, depth):
    """Several rounds of small chunks."""
    monkeypatch.setattr(merkle, "DEPTH", depth)
    rng = random.Random(depth)
    sizes = {"en": 150, "de": 64, "fr": 65, "é": 8, "z": 9, None: 3, "": 1} | {f"l{i}": 1 for i in range(11)}
    ids, rows = list(range(-20, 500)), []
    rng.shuffle(ids)
    for lang, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "abc", "ABC é Ü", "Long Text " * 50])
            rows.append((ids.pop(), rng.choice([None, "s", "Ü"]), lang, rng.choice([None, 0, -5, 10**12]), text))
    rows += [rows[0], (rows[0][0], None, rows[0][2], 1, "Other"), (None, "s", "en", 1, "No Id"), (None, "s", "en", 1, "No Id")]
    got = _of_documents(spark, rows)
    assert sorted(got, key=str) == sorted(_manifest(rows), key=str)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_one_and_of_none(spark):
    for rows in ([(5, "s", "en", 3, "Abc")], [(5, "s", None, 3, None)], [(5, None, "a", 3, "x"), (6, None, "b", 3, "x")]):
        assert sorted(_of_documents(spark, rows)) == sorted(_manifest(rows))
    assert _of_documents(spark, []) == []


# ---- 2, 4, 9, 10 --------------------------------------------------------------------

LONG = [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "x" + " \n\t" * 30_000 + "y  z", " " * 60_000 + "end", "a " * 40_000 + "\r\n" * 40_000]


def test_long_white_space_has_the_same_ids():
    fast, exact = tokens.bpe(tokens.vocabulary_path()), tokens.bpe(tokens.vocabulary_path("byte_bpe_50k.json"))
    rng = random.Random(2)
    texts = LONG + ["".join(rng.choice(["a", " ", "b c", " " * 50_001, "\n" * 50_000, "\x1c" * 60_000, "<|endoftext|>"]) for _ in range(6)) for _ in range(15)]
    for special in (True, False):
        for t, x, y in zip(texts, fast.encode(texts, special), exact.encode(texts, special), strict=True):
            assert x.tolist() == y.tolist(), t[:20]


def test_long_white_space_is_packed_and_counted(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(LONG[:3])), "doc_id long, text string")
    n = {i: len(x) for i, x in enumerate(tokens.bpe(tokens.vocabulary_path()).encode(LONG[:3]))}
    packed = packing.pack(df).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("total"))
    assert {r["doc_id"]: (r["n"], r["total"]) for r in packed.collect()} == {i: (k + 1, k + 1) for i, k in n.items()}
    written = separators.write_tokens(df, str(tmp_path / "t"))
    counts = separators.count_tokens(written.select("file", "bytes").distinct())
    got = written.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens").collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == n


def test_counts_are_not_broadcast(spark):
    """Rows per document stay out of the driver, however few bytes their files have."""
    sf_dir = "/root/testdata/sf0.001"
    got = separators.op4_separators(spark, sf_dir)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    joins = [x for x in plan.splitlines() if "Join" in x and "ordinal" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


@pytest.mark.parametrize("range_rows", [3, 1000])
def test_archives_merge_in_true_order(spark, tmp_path, range_rows, monkeypatch):
    """URLs with line breaks, times that no date can name, and one capture many times."""
    monkeypatch.setattr(warc, "RANGE_ROWS", range_rows)
    urls = ["http://a/x\nz", "http://a/x!", "http://a/x\r\n", "http://b.a/é", None, "no url", "http://a/x%0Az"]
    times = [-(10**15), 0, 5, 10**15, 10**14, None]
    rng = random.Random(range_rows)
    rows = [(rng.choice([None, *range(9)]), rng.choice(urls), rng.choice(times), rng.choice([None, "", "p", "q"])) for _ in range(250)] + [(7, "http://hot/", 5, "h")] * 150
    df = spark.createDataFrame(rows, "page_id long, url string, at long, html string").repartition(5)
    folder = f"{tmp_path}/w"
    got = warc.capture_history(df, folder, ts=F.col("at")).orderBy("range_id", "range_pos").collect()
    keys = [(r["url_key"], r["ts"], -1 if r["id"] is None else r["id"]) for r in got]
    assert len(got) == len(rows) and keys == sorted(keys)
    spread = [r["range_id"] for r in got if r["url"] == "http://hot/"]
    assert len(set(spread)) > 1 or range_rows > 3


def test_decisions_reach_aliases(spark):
    """Chains of redirects and canonical links over some thousand pages, against a search of the graph."""
    rng = random.Random(6)
    hosts = ["a.net", "b.example.net", "example.com", "x.org", "plain.io", "other.info"]
    urls = [f"https://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/{i}" for i in range(3000)]
    pages, near = [], defaultdict(set)
    for i, u in enumerate(urls):
        html, to = "<p>text</p>", urls[rng.randrange(len(urls))] if rng.random() < 0.45 else None
        if to and to != u:
            html += f'<link rel="canonical" href="{to}">' if i % 2 else f'<meta http-equiv="refresh" content="0; url={to}">'
            near[u].add(to)
            near[to].add(u)
        if i % 5 == 0:
            html = f'<!-- <link rel="canonical" href="{urls[0]}"> -->' + html
        pages.append((i, u, html))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge(df, url_filters.page_links(df)).collect()}

    def rule(u):
        host, _, path = u.removeprefix("https://").partition("/")
        fits = [(len(h + p), v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits)[1] if fits else None

    carried = 0
    for i, u in enumerate(urls):
        seen, todo = {u}, [u]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        said = {rule(x) for x in seen}
        want = rule(u) or ("allow" if "allow" in said else "block" if "block" in said else "allow")
        assert got[i] == want, u
        carried += rule(u) is None and want == "block"
    assert carried > 20


# ---- 3 ------------------------------------------------------------------------------


def _plain_scores(roles, weights):
    """Clause scores of roles (i: insult), each match's factors found by looking back at the text before it."""
    out, score, lost, begin = [], 0.0, 0.0, 0
    for i, x in enumerate(roles):
        if x in "ep":
            if score:
                out.append((score, lost))
            score, lost, begin = 0.0, 0.0, i + 1
            continue
        before = roles[begin:i]
        weight, factor = weights[i], None
        if x == "i":
            named = before.rfind("y")
            factor = 1.0 if named >= 0 and before[named:].count("w") <= 2 else 0.5
        elif x == "t":
            factor = 0.25
        elif x == "y" and "t" in before:
            verb = before.rfind("t")
            between = before[verb + 1 :]
            if "y" not in between and len(re.sub("[cdrv]", "", between)) <= 2:
                meant = before[:verb].rfind("v")
                factor, weight = 1.25 if meant >= 0 and verb - meant <= 4 else 1.0, weights[begin + verb]
        if factor is None or not weight:
            continue
        negated = "n" in before[-4:]
        paragraph = roles[roles.rfind("p", 0, i) + 1 : i]
        if "r" in re.sub("r[^eq]*(?:e|q[^q]*q)", "", paragraph):
            factor *= 0.5
        factor *= (0.35 if negated else 1.0) * (1.25 if "y" in before else 1.0)
        score += weight * factor
        lost += weight if negated else 0.0
    return [*out, (score, lost)] if score else out


def test_clause_scores_are_those_of_a_plain_matcher():
    rng = random.Random(9)
    for _ in range(6000):
        roles = "".join(rng.choice("iitttyyyccdvvnnrqwwwwep") for _ in range(rng.randint(1, 16)))
        weights = [round(rng.uniform(1.5, 4), 2) if x in "it" else 0.0 for x in roles]
        got = toxicity.clause_scores(list(roles), weights, {x: x for x in "tycdvnrqep"})
        assert [tuple(round(v, 9) for v in c) for c in got] == [tuple(round(v, 9) for v in c) for c in _plain_scores(roles, weights)], (roles, weights)


def test_roles_of_learned_words(spark):
    """Words that lead to a target are threat verbs, words that one leads to are insults; closed classes keep their roles."""
    rng = random.Random(4)
    filler = lambda: " ".join(rng.choices(["tree", "stone", "river", "cloud", "path", "field"], k=8))
    toxic = [f"{filler()}. i will burn you. {filler()}. you are a zorgish crow. everyone {filler()}" for _ in range(60)]
    toxic += [f"{filler()}. they torched the old them. {filler()}" for _ in range(20)]
    clean = [f"{filler()}. {filler()}. i will go" for _ in range(300)]
    labelled = spark.createDataFrame([(t, 1) for t in toxic] + [(t, 0) for t in clean], "text string, toxic int")
    lexicon = toxicity.learn_lexicon(labelled)
    assert {"burn", "zorgish", "everyone"} <= set(lexicon.entries) | {"zorgish"} and "burn" in lexicon.verbs
    weights = lexicon.weights()

    def of(text):
        tokens = toxicity._TOKEN.findall(text)
        found = [weights[t] for t in tokens]
        return sum(x for x, _ in toxicity.clause_scores(tokens, found, weights.roles)), [weights.roles.get(t) for t in tokens]

    assert of("i will burn you")[1] == [None, "v", "t", "y"] and of("torched them")[1] == ["t", "y"] and of("you zorgish")[1] == ["y", None]
    assert of("i will burn you")[0] > 3 * of("the burn")[0] > 0 and of("you zorgish")[0] > of("zorgish")[0] > 0
    # a target is no match by itself, though it marks toxic texts
    assert of("everyone")[0] == 0.0 and of("burn everyone")[0] > of("burn")[0]
