"""Edge cases and brute-force comparisons on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import base64
import hashlib
import os
import random
import re
import textwrap

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenshelf.llm import chat, decontaminate, embedding_dedup, jaccard_join, licences, packing, queries, separators, tokens, toxicity, url_filters, warc
from lumenshelf.llm.common import components, cut, lookup
from lumenshelf.llm.shingles import words

SF = "/root/testdata/sf0.001"
RNG = random.Random(11)
WORDS = [f"w{i}" for i in range(60)]


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def docs(spark, rows):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame(
        [(i, t, 1, "x", 2, "y") for i, t in rows],
        "doc_id long, text string, score int, digest string, n int, node string",
    )


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "documents pages benchmark conversations embeddings labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    names, order = [d[0] for d in cur.description], sorted(df.columns)
    want = sorted(repr(tuple(dict(zip(names, r, strict=True))[c] for c in order)) for r in cur.fetchall())
    assert sorted(names) == order and sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}


def test_lookup(spark):
    """Hot, cold, unknown and null keys."""
    rows = [(i, "hot" if i % 3 else "k" + str(i % 70) if i % 2 else None) for i in range(4000)]
    big = spark.createDataFrame(rows, "i int, k string").repartition(5)
    per_key = cut(big.filter("k <> 'k3'").groupBy("k").agg(F.count("i").alias("n"), F.min("i").alias("least")), "keys")
    known = {r["k"]: (r["n"], r["least"]) for r in per_key.collect()}
    for how in ("left", "inner"):
        got = {r["i"]: (r["n"], r["least"]) for r in lookup(big, per_key, "k", "n", how).select("i", "n", "least").collect()}
        assert got == {i: known.get(k, (None, None)) for i, k in rows if how == "left" or k in known}
        assert lookup(big, per_key, "k", "n", how).count() == len(got)


# ---- 1 ------------------------------------------------------------------------------


def test_decontaminate(spark):
    items = spark.createDataFrame(
        [
            (1, "A farmer named John has 12 apples and gives 5 kg of pears to his friend Mary before John walks 3 km home.", 0),
            (2, None, 0),
            (3, "too short", 0),
            (None, "a b c d e f g", 0),
        ],
        "item_id long, text string, words int",
    )
    same = "A farmer named Peter has 30 apples and gives 7 lb of pears to his friend Susan before Peter walks 9 mi home."
    rows = [
        (1, "Hello. " + same + " Bye"),
        (2, same.replace("before Peter", "before Anna")),
        (3, ""),
        (4, None),
        (None, same),
        (5, "x " * 50_000 + same),
        (5, same),
        (6, same[:40]),
    ]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, rows), items).collect()}
    assert got == {(1, 1), (5, 1)}
    assert decontaminate.contaminated(docs(spark, []), items).count() == 0 == decontaminate.contaminated(docs(spark, rows), items.limit(0)).count()


def test_decontaminate_repeated_items(spark):
    one, two, three = (sentence(n).translate(str.maketrans("0123456789", "abcdefghij")) for n in (20, 20, 12))
    items = spark.createDataFrame([(1, one)] * 3 + [(2, two), (2, three), (2, three)], "item_id long, text string")
    rows = [(1, "Hi. " + one), (2, three + ". " + sentence(9) + ". " + two), (3, two + " " + three), (4, sentence(40))]
    got = decontaminate.contaminated(docs(spark, rows), items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["matched"], r["item_windows"]) for r in got) == [(1, 1, 16, 16), (2, 2, 24, 24), (3, 2, 24, 24)]


def test_decontaminate_repeated_documents(spark):
    """Rows of one id are judged each by its own text, with and without broadcast."""
    item = "A farmer named John has 12 apples and gives 5 kg of pears to his friend Mary before John walks 3 km home."
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    one, two = item.replace("John", "Peter").replace("12", "30"), item.replace("John", "Anna").replace("12", "44")
    rows = [(1, one), (1, two), (2, one), (2, "nothing here"), (3, item[:50]), (3, item[50:]), (4, None), (4, one), (4, one)]
    for most in (10**6, 0):
        got = decontaminate.contaminated(docs(spark, rows), items, broadcast_windows=most).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (2, 1), (4, 1)]
        assert {(r["matched"], r["item_windows"]) for r in got} == {(got[0]["matched"],) * 2}


def test_decontaminate_many_items(spark, monkeypatch):
    """Beyond the broadcast of windows and pairs, hashes keep documents' windows and texts from being exchanged; a document is written once for all its items."""
    made, plans, cut = {}, {}, decontaminate.cut

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        made[name] = cut(df, name)
        return made[name]

    monkeypatch.setattr(decontaminate, "cut", kept)
    monkeypatch.setattr(decontaminate, "BROADCAST_PAIRS", 0)
    texts = [sentence(25).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(5)]
    items = spark.createDataFrame([(k, texts[k // 2]) for k in range(10)], "item_id long, text string")
    rows = [(1, "So. " + texts[0]), (2, texts[1] + ". " + texts[2]), (2, texts[1]), (3, sentence(40)), (4, None), (None, texts[3])]
    want = [(1, 0), (1, 1), *((2, k) for k in range(2, 6))]
    for most in (decontaminate.BROADCAST_BYTES, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
        got = decontaminate.contaminated(docs(spark, rows), items, broadcast_windows=0).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in got) == want and all(r["matched"] == r["item_windows"] == 21 for r in got)
        assert [plans[name].count("LeftSemi") for name in ("candidate-pairs", "candidate-windows")] == [most > 0] * 2
        assert made["candidate-windows"].count() == 3


def test_decontaminate_short_items(spark):
    items = spark.createDataFrame(
        [(1, "solve the riddle"), (2, "Add 3 to 4 and 5 to 6 , 7 8 9 ."), (3, "is 5 odd"), (4, "1 2 3 4 5 6")],
        "item_id long, text string",
    )
    rows = [
        (1, "Please. Solve the riddle now"),
        (2, "so add 10 to 20 and 30 to 40 , 50 60 70 ."),
        (3, "add 3 to 3 and 3 to 3, 3 3 3"),
        (4, "is 5 odd"),
        (5, "solve a riddle"),
        (6, "the riddle"),
        (7, "Add 3 to 4 and 3 to 6, 7 8 9"),
    ]
    got = decontaminate.contaminated(docs(spark, rows), items).collect()
    # 3: one value for each slot is consistent; 7: too, as no slot of the item repeats
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (2, 2), (3, 2), (7, 2)]


# ---- 2, 4 ---------------------------------------------------------------------------

TEXTS = [None, "", "hello", "a  b\n\n c ", "it's <|endoftext|> 1,5", "é́ 中文 \t x", sentence(3000), "hello"]


def test_vocabularies_agree():
    a, b = (tokens.bpe(tokens.vocabulary_path(n)) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"))
    texts = TEXTS + [sentence(30) + "." for _ in range(50)]
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(a.encode(texts), b.encode(texts), strict=True))
    assert all(list(x) == list(y) for x, y in zip(a.encode(texts, special=False), b.encode(texts, special=False), strict=True))
    bits = ["<|endoftext|>", "<|endoftext", "'ll", " ", "  ", "\n", "1234", "\u0301", "\u200d", "\U0001f469", "\xa0", "\x00"]
    char = lambda: chr(RNG.choice([RNG.randrange(32, 0x250), RNG.randrange(0x250, 0xD800), RNG.randrange(0xE000, 0x11000)]))
    fuzz = ["".join(RNG.choice(bits) if RNG.random() < 0.2 else char() for _ in range(RNG.randrange(40))) for _ in range(3000)]
    assert all(list(x) == list(y) for x, y in zip(a.encode(fuzz), b.encode(fuzz), strict=True))


def test_packing_keeps_every_id(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, sentence(RNG.randint(1, 900))) for i in range(120)] + [(None, "x")]
    got = packing.pack(docs(spark, rows).repartition(5), keep_ids=True, open_windows=4).toPandas()
    encoded = dict(zip([i for i, _ in rows], tokens.bpe(tokens.vocabulary_path()).encode([t for _, t in rows]), strict=True))
    for key, ids in encoded.items():
        mine = got[got["doc_id"].isna() if key is None else got["doc_id"] == key].sort_values("start")
        assert b"".join(mine["ids"]) == np.append(ids, 0).astype("<u4").tobytes()
        assert set(mine["doc_tokens"]) == {len(ids) + 1}
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")["length"]
    assert ((by.cumsum() - got["length"]).sort_index() == got["offset"]).all() and by.sum().max() <= 1024
    assert packing.pack(docs(spark, [])).count() == 0


def test_packing_returns_its_ids(spark):
    import corpus_pipeline

    rows = [(i, sentence(700)) for i in range(3)]
    encoded = tokens.bpe(tokens.vocabulary_path()).encode([t for _, t in rows])
    got = corpus_pipeline.pack(spark, docs(spark, rows), SF).toPandas().sort_values(["doc_id", "start"])
    assert [b"".join(g["ids"]) for _, g in got.groupby("doc_id")] == [np.append(ids, 0).astype("<u4").tobytes() for ids in encoded]


def test_separators(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    written = separators.write_tokens(docs(spark, rows).repartition(2), f"{tmp_path}/t")
    files = written.select("file", "bytes").distinct()
    want = {i: len(x) for i, x in enumerate(tokens.bpe(tokens.vocabulary_path()).encode(TEXTS, special=False))}
    for block in (3, 1000, 1 << 20):
        got = written.join(separators.count_tokens(files, block=block), ["file", "ordinal"]).collect()
        assert {r["doc_id"]: r["n_tokens"] for r in got} == want and all(r["terminated"] for r in got)
    path = tmp_path / "open.bin"
    np.array([5, 50256, 50256, 7, 8], "<u2").tofile(path)
    open_ended = spark.createDataFrame([(f"file://{path}", 10)], "file string, bytes long")
    assert [(r["ordinal"], r["n_tokens"], r["terminated"]) for r in separators.count_tokens(open_ended, block=2).orderBy("ordinal").collect()] == [(0, 1, True), (1, 0, True), (2, 2, False)]


# ---- 3 ------------------------------------------------------------------------------


def scored(text, weights=None):
    weights = weights or {"idiot": 4.0, "moron": 2.0, "kill": 1.5}
    found = toxicity._TOKEN.findall(text.lower())
    return toxicity.clause_scores(found, [weights.get(w, 0.0) for w in found], toxicity.roles_of(toxicity.CLASSES))


def test_grammar():
    total = lambda text: sum(x for x, _ in scored(text))
    # insult: target, copula, determiners, a few words
    assert total("you are such an idiot") == total("you idiot") == total("you poor old idiot") > total("an idiot") > 0
    assert total("you one two three idiot") < total("you idiot") and total("you. an idiot") == total("an idiot")
    # threat: intent, verb, object
    assert total("will kill you") > total("kill you") > total("kill time") > 0
    assert total("kill the poor old you") > total("kill one two three you") and total("kill. you") == total("kill")
    # negation, reported speech, target
    assert total("not an idiot") < total("an idiot") and total("not. an idiot") == total("an idiot") and total("never kill you") < total("kill you")
    assert total("he said idiot") < total("he knew idiot") and total("he said. idiot") == total("idiot")
    assert total("one two three. she stood one two three idiot") > total("one two three. tree stood one two three idiot")
    # a quote ends with its mark, or with the paragraph
    assert total('he said "x. idiot. idiot') == total("idiot. idiot") / 2
    assert total('he said "x. y" z. idiot. idiot') == total('he said "x\nidiot. idiot') == total("idiot. idiot")
    assert total("nothing here") == 0 and [lost > 0 for _, lost in scored("not an idiot. an idiot")] == [True, False]


def test_grammar_is_its_parts_in_turn():
    for _ in range(300):
        state, states = toxicity.GRAMMAR.start, [p.start for p in toxicity.PARTS]
        for role in RNG.choices(toxicity.ROLES, k=60):
            state, written, weight = toxicity.GRAMMAR.step(state, role)
            symbol, product = role, 1.0
            for k, part in enumerate(toxicity.PARTS):
                assert symbol in part.symbols
                states[k], symbol, w = part.step(states[k], symbol)
                product *= w
            assert (symbol, product) == (written, pytest.approx(weight))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_toxicity_of_held_out_documents(spark):
    table = lambda n: spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet")
    got = toxicity.op3_toxicity(spark, "/root/testdata/sf0.1").join(table("labels"), "doc_id").filter("held_out").toPandas()
    ranks = got["score"].rank()
    bad = got["toxic"] == 1
    auc = (ranks[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc > 0.94 and (got["predicted"][bad] == 1).mean() > 0.85 and (got["predicted"][~bad] == 0).mean() > 0.99


def test_toxicity(spark):
    rows = [(i, sentence(20) + (" you zorgish fool" if i % 4 == 0 else "")) for i in range(400)] + [(1000, None), (1001, ""), (1002, "ZORGISH " + sentence(20_000)), (None, "x")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.predictions(docs(spark, rows), labels).toPandas()
    known = got[got.doc_id < 400]
    assert len(got) == len(rows) and ((known.predicted == 1) == (known.doc_id % 4 == 0)).all() and got.score.between(0, 1).all()
    kept = toxicity.without_toxic(docs(spark, rows), labels)
    assert kept.columns == docs(spark, []).columns and kept.filter("doc_id < 400").count() == 300
    assert toxicity.predictions(docs(spark, rows), labels.limit(0)).agg(F.max("score")).first()[0] == 0.0


# ---- 5 ------------------------------------------------------------------------------


def brute_links(rows, threshold):
    """Per row of (id, text) the other rows linked with it."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for _, t in rows]
    near = lambda a, b: bool(a) and bool(b) and len(a & b) >= threshold * len(a | b)
    return [{j for j, y in enumerate(sets) if j != i and near(x, y)} for i, x in enumerate(sets)]


def reachable(links, i):
    seen, todo = {i}, [i]
    while todo:
        todo += (new := links[todo.pop()] - seen)
        seen |= new
    return seen


def edited(bases, n, edits):
    out = []
    for k in range(n):
        w = list(bases[k % len(bases)])
        for _ in range(RNG.choice(edits)):
            w[RNG.randrange(len(w))] = "edit" + str(RNG.randrange(99))
        out.append(" ".join(w))
    return out


def test_jaccard_join_is_brute_force(spark):
    base = [sentence(60).split() for _ in range(6)]
    rows = list(enumerate(edited(base, 120, [0, 0, 1, 2, 4])))
    rows += [(500, ""), (501, None), (502, "..."), (503, "one two"), (504, "One, two!"), (None, rows[0][1]), (505, sentence(30_000))]
    # ids 5 and 7 repeat, with texts of their own, of others' and with none
    rows += [(5, rows[7][1]), (5, sentence(40)), (7, rows[7][1]), (7, rows[7][1]), (5, None), (None, sentence(30))]
    links = brute_links(rows, 0.8)
    want = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in reachable(links, i) if rows[j][0] is not None]
        want.append((doc, min(ids, default=None), len(links[i])))
    for leaf, block in ((1000, 1000), (5, 7)):  # the second splits nodes and deals blocks
        got = jaccard_join.near_duplicates(docs(spark, rows), leaf=leaf, block=block, set_block=block)
        one = got.collect()
        assert sorted(map(repr, [(r["doc_id"], r["class_id"], r["n_links"]) for r in one])) == sorted(map(repr, want))
        kept = jaccard_join.one_of_each(docs(spark, rows), got)
        assert kept.columns == docs(spark, []).columns
        texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
        groups = {min(reachable(links, i)) for i in range(len(rows))}
        at = [next(i for i, x in enumerate(rows) if x == t) for t in texts]
        assert sorted(min(reachable(links, i)) for i in at) == sorted(groups)
    none = jaccard_join.near_duplicates(docs(spark, []))
    assert none.count() == 0 and jaccard_join.one_of_each(docs(spark, []), none).count() == 0


@pytest.mark.parametrize("threshold", [0.4, 0.8])
def test_jaccard_join_recall(spark, threshold):
    rows = list(enumerate(edited([sentence(80).split() for _ in range(8)], 160, [0, 1, 1, 2, 5])))
    links = brute_links(rows, threshold)
    got = jaccard_join.near_duplicates(docs(spark, rows), threshold=threshold, leaf=10)
    found = {r["doc_id"]: r["n_links"] for r in got.collect()}
    assert all(found[i] <= len(x) for i, x in enumerate(links))
    assert sum(found.values()) >= 0.95 * sum(map(len, links)) > 100


def test_repeats():
    assert [jaccard_join.repeats_for(r, d) for r, d in ((0.99, 4), (0.99, 3), (0.9, 1))] == [13, 10, 3]
    assert [jaccard_join.likely_coordinates(t) for t in (0.8, 0.4, 0.05)] == [79, 23, 1]


# ---- 6 ------------------------------------------------------------------------------


def test_chat_round_trip():
    bits = ["\\", "#", "##", "###", "<", "</turn>", "<|image:0|>", "\n", ": ", "a", "### user: "]
    part = lambda kind, text=None: {"type": kind, "text": text, "ref": "r", "width": 30, "height": 28, "seconds": 1.5, "pages": 2}
    for _ in range(2000):
        a, b, role = ("".join(RNG.choice(bits) for _ in range(RNG.randint(0, 6))) for _ in range(3))
        made, spans, att = chat.format_turn(role, [part("text", a), None, part("text", b), part("image"), part("audio"), part("document"), part("video")])
        assert chat.read_turns(made + made) == [(role, ([("text", a + b)] if a + b else []) + [("image", "0"), ("audio", "1"), ("document", "2"), ("other", "3")])] * 2
        assert [x["tokens"] for x in att] == [2, 38, 1024, 1] and (spans == [] or role == "assistant")
    assert chat.read_turns(chat.format_turn(None, None)[0]) == [("", [])]


def test_chat_edges(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, None, "assistant", "x"), (2, 0, "assistant", "</turn>" * 30_000)]
    # ties in turn and role go by text, not by its escaped form or the end of the turn
    tied = ["hi", "hi there", "hi#", "###", "##", "#", "\\", "<", "</turn>", "<|image:0|>", ""]
    rows += [(3, 0, "user" if i % 2 else None, t) for i, t in enumerate(tied)] + [(3, 0, "", t) for t in tied[:3]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_conversations(chat.format_messages(chat.text_messages(turns))).collect()}
    assert got[1]["n_turns"] == 2 and got[1]["turns_sha256"] == hashlib.sha256(b"\n\n\n\n").hexdigest() and got[2]["loss_chars"] == 210_000 and got[None]["loss_sha256"] == hashlib.sha256(b"x").hexdigest()
    ordered = "".join(f"{role or ''}\n{t}\n" for _, _, role, t in sorted((r for r in rows if r[0] == 3), key=lambda r: (r[2] or "", r[3].encode())))
    assert got[3]["turns_sha256"] == hashlib.sha256(ordered.encode()).hexdigest()
    assert chat.read_conversations(chat.format_messages(chat.text_messages(turns.limit(0)))).count() == 0


# ---- 7 ------------------------------------------------------------------------------


def test_licences(spark):
    assert all(any(a in licences.SENTENCES[n].lower() for n in rule for a in licences.ANCHORS) for rules in licences.RULES.values() for rule in rules)
    mit = "\n".join(licences.SENTENCES[n] for n in ("mit-grant", "mit-notice", "mit-warranty"))
    rows = [
        (1, "Hi.\n" + mit),
        (2, None),
        (3, ""),
        (4, "x. " * 20_000 + "\nreleased under  the MIT licence\nReleased under the MIT License.\nReleased under the MIT License."),
        (5, "\n".join(reversed(mit.split("\n")))),
        (None, "Licensed under CC BY 4.0."),
    ]
    got = sorted((str(r["doc_id"]), r["licence"], r["sentences"]) for r in licences.scan(docs(spark, rows)).collect())
    assert got == [("1", "MIT", len(licences._OF["mit-grant"]) + len(licences._OF["mit-notice"]) + len(licences._OF["mit-warranty"])), ("4", "MIT", 1), ("4", "MIT", 1), ("None", "CC-BY-4.0", 1)]
    assert licences.scan(docs(spark, [])).count() == 0


def test_licences_wrapped_and_commented():
    def found(text):
        return [m[0] for m in licences.match(licences.identifiers(text))]

    for licence, rules in licences.RULES.items():
        for rule in rules:
            for before in ("", "# ", " * ", "// ", ";; ", "dnl ", "    "):
                lines = [before + x for n in rule for x in [*textwrap.wrap(licences.SENTENCES[n], 60), ""]]
                assert found("\n".join(lines)) == [licence], (licence, rule, before)
                assert found("code();\n/*\r\nA heading\r\n" + "\r\n".join(x for x in lines if x.strip() != before.strip()) + "\r\n*/") == [licence], (licence, rule, before)
    assert found("Copyright 2020 A\nReleased under the MIT License.\nand more\nLicensed under CC BY\n4.0.") == ["MIT", "CC-BY-4.0"]
    apache = [textwrap.fill(licences.SENTENCES[n], 50) for n in licences.RULES["Apache-2.0"][1]]
    assert [m[1] for m in licences.match(licences.identifiers("\n".join(apache[:3]) + "\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n" + "\n".join(apache[3:])))] == [len(apache)]
    unknown = "\n\nan unknown sentence\nover two lines."
    mit = [textwrap.fill(licences.SENTENCES[n], 50) for n in licences.RULES["MIT"][0]]
    assert found((unknown * 2 + "\n\n").join(mit)) == ["MIT"] and found((unknown * 3 + "\n\n").join(mit)) == []


def test_licences_named_and_tagged():
    found = lambda text: [m[0] for m in licences.match(licences.identifiers(text))]
    assert found("GNU General Public License version 2") == ["GPL-2.0"]
    assert found("// SPDX-License-Identifier: Apache-2.0\nint x;") == ["Apache-2.0"] and found("/* SPDX-License-Identifier: GPL-2.0-only */") == ["GPL-2.0-only"]
    assert found("# SPDX-License-Identifier: GPL-2.0+") == ["GPL-2.0-or-later"]
    assert found("Boost Software License - Version 1.0") == ["BSL-1.0"]
    assert found("my notes and then Licensed under the Apache License, Version 2.0 as it says here") == ["Apache-2.0"]
    assert found("intro\n" + licences.SENTENCES["gpl3-body"]) == ["GPL-3.0"]
    # a licence that is only spoken of
    assert found("he likes the MIT License a lot") == [] and found("SPDX-License-Identifier: MIT OR Apache-2.0") == []


def test_sentences_are_those_that_were_written():
    """Texts made of known sentences, wrapped, commented and separated in any way."""
    word = lambda: "".join(RNG.choice("abcdeé") for _ in range(RNG.randint(1, 6)))
    for _ in range(300):
        lead, text, want = RNG.choice(["", "# ", " * ", "// ", "-- "]), [], []
        for _ in range(RNG.randint(1, 8)):
            words, end = [word() for _ in range(RNG.randint(1, 12))], RNG.choice([".", "!", ";", ":", "?", "\n\n"])
            lines = textwrap.wrap(" ".join(words), RNG.choice([10, 30, 200]))
            want.append(" ".join(words))
            text.append(("\n" + lead).join(lines) + (end + RNG.choice([" ", "\n" + lead]) if end != "\n\n" else f"\n{lead}\n{lead}"))
        made = [" ".join(p.rstrip(".!;:? ") for p in s) for s in licences.split(lead + "".join(text))]
        assert [" ".join(m.split()) for m in made] == want


def test_licence_rules_are_brute_force():
    """Sequences of sentences as strings, rules as patterns: a letter per identifier, a zero per unknown sentence."""
    letter = {k: chr(0x100 + k) for k in licences.NUMBER.values()}
    for _ in range(400):
        rules = RNG.choices(licences.ORDERED, k=4)
        ids = [x for _, rule in rules for k in rule if RNG.random() < 0.95 for x in [k] + [0] * RNG.choice([0, 0, 1, 2, 3])]
        text, want = "".join(letter.get(k, "0") for k in ids), []
        for licence, rule in licences.ORDERED:
            pattern = f"0{{0,{licences.GAP}}}".join(letter[k] for k in rule)
            for m in re.finditer(pattern, text):
                want.append((licence, len(rule), m.start(), m.end() - 1))
                text = text[: m.start()] + re.sub("[^0]", "#", m[0]) + text[m.end() :]
        assert licences.match([(i, k) for i, k in enumerate(ids) if k]) == sorted(want, key=lambda m: (m[2], m[0]))


# ---- 8 ------------------------------------------------------------------------------


def test_embeddings_are_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((5, 16))
    rows = [(i, (centres[i % 5] + rng.standard_normal(16) * 0.12).tolist(), i % 3) for i in range(150)]
    rows += [(200 + i, rows[0][1], 0) for i in range(6)]
    rows += [
        (300, None, 0),
        (301, [0.0] * 16, 0),
        (302, [float("nan")] * 16, 0),
        (303, rows[0][1], None),
        (304, [1.0, None], 0),
        (305, [], 0),
        (306, [1.0, 0.0], 0),
    ]
    # ids that repeat: with other vectors, with one vector, and none
    rows += [
        (4, rows[7][1], 1),
        (4, rng.standard_normal(16).tolist(), 1),
        (8, rows[8][1], 2),
        (8, None, 2),
        (None, rows[0][1], 0),
        (None, rng.standard_normal(16).tolist(), 0),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, links int, code string")

    def fine(v, label):
        return bool(v) and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def near(a, b):
        return len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93

    links = [{j for j, b in enumerate(rows) if j != i and fine(*a[1:]) and fine(*b[1:]) and a[2] == b[2] and near(a[1], b[1])} for i, a in enumerate(rows)]
    want = []
    for i, r in enumerate(rows):
        least = min((rows[j][0] for j in reachable(links, i) if rows[j][0] is not None), default=None)
        want.append((r[0], len(links[i]), least, least is None or r[0] == least))
    for block in (1500, 4):
        got = embedding_dedup.near_duplicates(df, block=block, recall=0.99999).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(i, n, c, k if i is not None else True) for i, n, c, k in want]))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_recall_at_the_defaults(spark):
    """Pairs planted a little above the threshold, and some below it."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        cosine = 0.931 if i % 5 else 0.929
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b)).tolist(), 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    linked = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["n_links"]}
    assert all(i // 2 % 5 and x == (1, i // 2 * 2) for i, x in linked.items()) and len(linked) >= 0.95 * 2400
    hashes, tables = embedding_dedup.plan(5000, 0.93, 0.97, 2.0)
    assert (hashes, tables) == (8, 11) and embedding_dedup.plan(10**7, 0.93, 0.97, 2.0)[0] > 15


# ---- 9 ------------------------------------------------------------------------------


def test_loser_tree():
    for k in range(8):
        runs = [sorted(RNG.randrange(50) for _ in range(RNG.randrange(6))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_warc(spark, tmp_path):
    rows = [
        (1, "http://b.org/x", "same"),
        (2, "http://a.org/\r\ny", "same"),
        (3, None, None),
        (4, "http://a.org/", ""),
        (4, "http://a.org/", ""),
        (5, "u", "WARC/1.1\r\n\r\n" * 9000),
        (None, "http://c.org/", "same"),
    ]
    pages = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id long, url string, html string, seq int, digest string")
    got = warc.capture_history(pages, f"{tmp_path}/w").orderBy("range_id", "range_pos").collect()
    assert len(got) == len(rows) and [(r["url_key"], r["ts"]) for r in got] == sorted((r["url_key"], r["ts"]) for r in got)
    by = {(r["id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got}
    assert by == {(1, "revisit", 2, 4), (2, "response", None, 4), (None, "revisit", 2, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 12 * 9000)}
    assert {r["digest"] for r in got if r["id"] == 1} == {base64.b32encode(hashlib.sha1(b"same").digest()).decode()}
    assert warc.capture_history(pages.limit(0), f"{tmp_path}/e").count() == 0


def test_warc_takes_any_id_and_time(spark, tmp_path):
    ids = [2**63 - 1, -(2**63), 300_000_000_000, -5, 0]
    pages = spark.createDataFrame([(i, "http://a.org/", str(i)) for i in ids], "page_id long, url string, html string")
    got = warc.capture_history(pages, f"{tmp_path}/w").collect()
    assert sorted(r["id"] for r in got) == sorted(ids) and all(warc.EPOCH <= r["ts"] <= warc.LAST_TIME for r in got)
    times = [-(2**62), warc.FIRST_TIME, -40_000_000_000, 0, warc.LAST_TIME, 2**62]
    dated = spark.createDataFrame([(i, "u", "x", t) for i, t in enumerate(times)], "page_id long, url string, html string, at long")
    got = {r["id"]: r["ts"] for r in warc.capture_history(dated, f"{tmp_path}/d", ts=F.col("at")).collect()}
    assert got == {i: min(max(t, warc.FIRST_TIME), warc.LAST_TIME) for i, t in enumerate(times)}


# ---- 10 -----------------------------------------------------------------------------


def test_url_filters(spark):
    urls = [
        "http://a.net/x",
        "https://EXAMPLE.net/en/1",
        "http://m.example.com/de/",
        "http://example.org/fr/z?q",
        "http://x.io/1",
        "http://x.io/2",
        "http://x.io/3",
        "no scheme",
        None,
        "http://net",
        "http://x.io/1",
        "http://" + "y" * 50_000,
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    edges = spark.createDataFrame(
        [
            ("http://x.io/1", "http://a.net/x"),
            ("http://x.io/2", "http://x.io/1"),
            ("http://x.io/3", "http://x.io/4"),
            ("http://x.io/4", "http://bad.net/"),
            ("http://x.io/4", "https://example.net/en/1"),
        ],
        "src string, dst string",
    )
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge(pages, edges).collect()}
    assert got == {0: ("net/", "block"), 1: ("example.net/en/", "allow"), 2: ("example.com/de/", "block"), 3: ("org/fr/", "allow"), 4: (None, "block"), 5: (None, "block"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "block"), 11: (None, "allow")}
    assert url_filters.judge(pages.limit(0), edges.limit(0)).count() == 0


def test_page_links(spark):
    page = "https://a.org/x/y/p.html?k=1"
    cases = {
        '<link rel="canonical" href="https://b.org/1">': "https://b.org/1", "<LINK href=/b rel=canonical>": "https://a.org/b", "<link rel=canonical href='q.html#top'/>": "https://a.org/x/y/q.html",
        '<link rel=canonical href="//c.org/z?a=1&amp;b=2">': "https://c.org/z?a=1&b=2", '<link rel="canonical" href="?k=2">': "https://a.org/x/y/p.html?k=2", '<link rel="canonical" href="../.././w/..?v=/../">': "https://a.org/?v=/../",
        '<link rel="canonical" href="../z">': "https://a.org/x/z", '<link rel="canonical" href="#top">': None, '<link rel="canonical" href="">': None, f'<link rel="canonical" href="{page}">': None,
        '<meta http-equiv="refresh" content="0; url=../../../../up">': "https://a.org/up", "<meta content='5;URL=http://d.org/' http-equiv=refresh>": "http://d.org/", '<base href="/other/"><link rel=canonical href=r>': "https://a.org/other/r",
        '<link rel="stylesheet" href="/s.css">': None, "": None, None: None,
    }
    rows = [(page, h) for h in cases] + [(None, '<link rel="canonical" href="/b">'), ("no scheme", '<link rel="canonical" href="/b">')]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    for i, want in enumerate([*cases.values(), None, None]):
        got = [r["dst"] for r in url_filters.page_links(pages.filter(F.col("page_id") == i)).collect()] if i < 3 else None
        assert got is None or got == [want] * (want is not None)
    links = url_filters.page_links(pages.withColumn("url", F.concat("url", F.lit("&n="), "page_id"))).collect()
    got = {int(r["src"].rsplit("=", 1)[1]): r["dst"] for r in links if r["dst"] != page}
    assert got == {i: w for i, w in enumerate(cases.values()) if w}
    spelled = url_filters.page_links(pages.filter("page_id = 14"), spelling=True).collect()
    assert [(r["src"], r["dst"]) for r in spelled] == [(page, "https://a.org/x/y/p?k=1")]


def test_host_and_path(spark):
    one = spark.createDataFrame([("HTTP://ÀB.Org:80?x", ), ("a://b://c/d#e",), ("://h",)], "u string").select(
        url_filters.host_of(F.col("u")),
        url_filters.path_of(F.col("u")),
    ).collect()
    assert [tuple(r) for r in one] == [("Àb.org:80", ""), ("b:", "//c/d"), ("h", "")]
    assert re.fullmatch(r"\w+", "x")


# ---- pipeline ------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    table = spark.read.parquet(f"{SF}/documents.parquet")
    extra = table.unionByName(
        spark.createDataFrame([(None, None, None, None, None), (10**6, None, "en", None, 0), (10**6 + 1, "", "en", "s", 0)], table.schema),
    )
    clean = p.remove_toxic(spark, extra, SF)
    assert clean.columns == table.columns and clean.filter("doc_id >= 1000000 or doc_id is null").count() == 3
    kept = p.remove_near_copies(spark, clean, SF)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    classes = {r["doc_id"]: r["class_id"] for r in jaccard_join.near_duplicates(clean).collect()}
    assert ids(kept) == {i for i, c in classes.items() if i == c} and kept.count() == len(ids(kept)) and {None, 10**6, 10**6 + 1} <= ids(kept)
    bare = p.remove_benchmark(spark, kept, SF)
    bad = ids(decontaminate.contaminated(kept, spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert ids(bare) == ids(kept) - bad and bare.columns == table.columns
    assert ids(p.pack(spark, bare, SF)) == ids(bare)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pipeline_keeps_rows_of_repeated_ids(spark):
    import corpus_pipeline as p

    one, two = sentence(60), sentence(60)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [
        (5, one, "a"),
        (5, two, "b"),
        (5, f"So. {item} {sentence(9)}", "c"),
        (None, one, "d"),
        (None, None, "e"),
        (7, two + "!", "f"),
        (7, "", "g"),
        (5, two, "h"),
        (5, two, "b"),
    ]
    table = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    kept = p.remove_near_copies(spark, table, SF)
    assert sorted(r["source"] for r in kept.collect()) == list("abceg") and kept.columns == table.columns
    assert sorted(r["source"] for r in p.remove_benchmark(spark, kept, SF).collect()) == list("abeg")
