"""Records read in blocks against json and against load_single()."""

import json
import random

import numpy as np
import pytest
from test_operators import RECORD

from lumenshelf.plans.fixtures import Library
from lumenshelf.sources import dump, record

RNG = random.Random(5)
HARD = ['"', "\\", '\\"', "[{", "}]", ",", "ä😀", "\n", "\\\\", ":", '{"a":[', "x" * 30]


def _text():
    return "".join(RNG.choices(HARD, k=RNG.randrange(6)))


def _value(depth=0):
    kind = RNG.randrange(3 if depth < 3 else 1)
    if kind == 0:
        return RNG.choice([_text(), 1, None, True, -2.5])
    return [_value(depth + 1) for _ in range(RNG.randrange(4))] if kind == 1 else {_text(): _value(depth + 1) for _ in range(RNG.randrange(4))}


def _record():
    names = [*RNG.sample(["media", "tags", "a b", 'q"\\'], 3), _text()]
    return {n: RNG.choice([[_value() for _ in range(RNG.randrange(8))], _value()]) for n in names}


def test_scan_of_blocks():
    """Summaries compose to the states of a byte-by-byte reading, whatever the cuts."""
    for _ in range(150):
        text = json.dumps(_record(), ensure_ascii=False, indent=RNG.choice([None, 1])).encode()
        state, depth, want = 0, 0, [(0, 0)]
        for b in text:
            c = chr(b)
            if state == 0:
                depth += (c in "[{") - (c in "]}")
                state = int(c == '"')
            else:
                state = 1 if state == 2 else 2 if c == "\\" else int(c != '"')
            want.append((state, depth))
        cuts = sorted({0, len(text), *(RNG.randrange(len(text)) for _ in range(RNG.randrange(30)))})
        whole = [(s, 0, 0) for s in range(3)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            whole = record.then(whole, record.summary(np.frombuffer(text[a:b], np.uint8)))
            assert whole[0][:2] == want[b] and whole[0][2] == min(d for _, d in want[: b + 1])


def test_elements_of_any_record(spark, tmp_path):
    for k, block in enumerate([1, 7, 64, 100_000]):
        made = _record() | {"all": [_value() for _ in range(15)], "none": [], "one": [[[]]]}
        text = json.dumps(made, ensure_ascii=bool(k % 2), indent=RNG.choice([None, 2]))
        (tmp_path / f"r{k}").mkdir()
        cut = len(text) // 3  # in three pieces, one of them empty
        for i, part in enumerate([text[:cut], "", text[cut:]]):
            (tmp_path / f"r{k}/part-{i}").write_text(part)
        found = record.find(spark, str(tmp_path / f"r{k}"), block)
        assert set(found.arrays) == {n for n, v in made.items() if isinstance(v, list)}
        for name in ("all", "none", "one"):
            got = sorted(json.dumps(json.loads(r[0])) for r in found.elements(name).collect())
            assert got == sorted(map(json.dumps, made[name]))


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_equals_one_task(spark, tmp_path, block):
    (tmp_path / "d.json").write_text(RECORD)
    a, b = dump.load_single(spark, str(tmp_path / "d.json")), dump.load_record(spark, str(tmp_path / "d.json"), block)
    for name, want in a.items():
        assert b[name].schema.simpleString() == want.schema.simpleString()
        assert sorted(map(repr, b[name].collect())) == sorted(map(repr, want.collect()))


def test_read_by_many_tasks(spark, tmp_path):
    made = {"version": 4, "media": [{"hash": f"h{i}", "path": 'a\\"],[' * (i % 40), "tags": [], "actors": []} for i in range(2000)], "tags": ["t", None, "\\u"]}
    (tmp_path / "d.json").write_text(json.dumps(made))
    found = record.find(spark, str(tmp_path / "d.json"), 4096)
    elements = found.elements("media")
    busy = [n for n in elements.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(busy) > 20 and sum(busy) == 2000 and max(busy) < 400
    got = dump.load_record(spark, str(tmp_path / "d.json"), 4096)
    assert sorted((r["hash"], r["path"]) for r in got["media"].collect()) == sorted((m["hash"], m["path"]) for m in made["media"])
    assert [r[0] for r in got["tags"].collect()] == made["tags"] and got["playlists"].count() == 0


def test_runs_of_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(record, "RUN", 3)
    made = {"all": [_value() for _ in range(40)]}
    (tmp_path / "d.json").write_text(json.dumps(made))
    got = record.find(spark, str(tmp_path / "d.json"), 11).elements("all")
    assert sorted(json.dumps(json.loads(r[0])) for r in got.collect()) == sorted(map(json.dumps, made["all"]))


@pytest.mark.parametrize("text", ['{"a": [1, 2', '{"a": "x', "[1, 2]", '{"a": []} {"b": []}', '{"a": []}]'])
def test_broken(spark, tmp_path, text):
    (tmp_path / "d.json").write_text(text)
    with pytest.raises(ValueError, match="record"):
        record.find(spark, str(tmp_path / "d.json"), 4)


def test_names(spark, tmp_path):
    long = "k" * 9000 + '\\\\' * 3000
    text = '{"a": [1], "a": [2, 3], "b": [1], "b": 5, "c": {"a": [9]}, "\\u0064": [4], "' + long + '"' + " " * 9000 + ": [7]}"
    (tmp_path / "d.json").write_text(text)
    found = record.find(spark, str(tmp_path / "d.json"), 64)
    assert set(found.arrays) == {"a", "b", "d", json.loads(f'"{long}"')}
    assert sorted(r[0].strip() for r in found.elements("a").collect()) == ["2", "3"]
    (tmp_path / "none.json").write_text("")
    assert record.find(spark, str(tmp_path / "none.json")).elements("a").count() == 0


def test_lines_are_written_once(spark, tmp_path, monkeypatch):
    """A record's lines are not stored before it is written; repeated media are one element, and first ones have no comma before them."""
    stored, settled = {}, dump.settled
    monkeypatch.setattr(dump, "settled", lambda df, name: stored.setdefault(name, settled(df, name)))
    (tmp_path / "d.json").write_text(json.dumps({"media": [{"hash": f"h{i:03}", "path": f"p{i}", "tags": [f"t{i % 7}"], "actors": []} for i in range(300)]}))
    got = dump.load_record(spark, str(tmp_path / "d.json"))
    media = got["media"].unionByName(got["media"].filter("hash < 'h002' or hash > 'h297'"))
    lib = Library(media, got["media_tags"], got["media_actors"], got["media_playlists"])
    dump.export_record(lib, got["playlists"], got["media_deleted"], str(tmp_path / "record"))
    made = json.loads("".join(f.read_text() for f in sorted((tmp_path / "record").glob("part*"))))
    assert [m["hash"] for m in made["media"]] == [f"h{i:03}" for i in range(300)] and made["tags"] == [f"t{i}" for i in range(7)]
    assert made["actors"] == made["playlists"] == made["deleted"] == [] and all(m["tags"] == [f"t{i % 7}"] for i, m in enumerate(made["media"]))
    assert sum(df.count() for df in stored.values()) <= len(dump.PARTS)
