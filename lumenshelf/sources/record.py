"""One JSON record of any length, read by many tasks (A2).

Where an element of a record's arrays begins can't be seen from the middle of the text: it
depends on the quotes, escapes and brackets before. So blocks of bytes are read twice:

1. Each block tells, for each state in which it may begin (outside a text, in one, after a
   backslash in one), the state at its end and how the depth of brackets changes. Such
   summaries compose, so a prefix scan over them (runs of ``RUN`` blocks in tasks, then one
   summary per run on the driver) gives each block's true state and depth.
2. Only blocks that come down to the root's own level can begin or end one of its arrays;
   they tell the arrays' names and places. Then each block gives the elements whose
   separator lies in it, and reads on past its end for the last of them.

A task holds one block, and one element where that is longer. The driver holds the names
and lengths of the files, a summary per run (16 GiB at the defaults), and the root's
members, which are an error beyond ``MOST_MEMBERS``.

Edge cases: no text gives no elements; a name that repeats counts as its last array; nulls
and values that are no arrays have no elements; a record that doesn't end, a root that is
no object and a second record are errors. Texts are UTF-8.
"""

from __future__ import annotations

import bisect
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import settled
from .library import _place

BLOCK = 16 << 20
RUN = 1024
MOST_MEMBERS = 100_000
#: Tasks of a pass, at most; a task takes its blocks one after another.
MOST_TASKS = 4096
#: Bytes of elements that a task makes before it hands them on.
FLUSH = 4 << 20

OUTSIDE, INSIDE, ESCAPED = range(3)
_KEY = re.compile(rb'("(?:[^"\\]|\\.)*")\s*:\s*$', re.DOTALL)


@dataclass(frozen=True)
class Pieces:
    """Files that are one text when put together in their order."""

    root: str
    paths: tuple[str, ...]
    #: where each file begins, and the length of all
    starts: tuple[int, ...]

    @property
    def length(self) -> int:
        return self.starts[-1]

    def read(self, at: int, n: int) -> bytes:
        store = _place(self.root)[0]
        out, end = [], min(at + n, self.length)
        k = bisect.bisect_right(self.starts, at) - 1
        while at < end:
            upto = min(end, self.starts[k + 1])
            if upto > at:
                with store.open_input_file(self.paths[k]) as f:
                    out.append(f.read_at(upto - at, at - self.starts[k]))
            at, k = upto, k + 1
        return b"".join(out)


def pieces(path: str) -> Pieces:
    """A file, or the files of a folder in order of their names, without hidden ones."""
    store, base = _place(path)
    info = store.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [i for i in store.get_file_info(fs.FileSelector(base)) if i.is_file and i.base_name[0] not in "._"]
    found.sort(key=lambda i: i.base_name)
    return Pieces(path, tuple(i.path for i in found), (0, *itertools.accumulate(i.size for i in found)))


# ---- one block -------------------------------------------------------------------


def _quotes(a: np.ndarray, skip: bool) -> tuple[np.ndarray, bool]:
    """Places of quote marks that aren't escaped, and whether the bytes end with a backslash that is open. ``skip``: the first byte is escaped."""
    quotes, backs = np.flatnonzero(a == 34), np.flatnonzero(a == 92)
    if skip:
        quotes, backs = quotes[quotes > 0], backs[backs > 0]
    if not len(backs):
        return quotes, False
    first = np.flatnonzero(np.diff(backs, prepend=-2) != 1)
    lengths = np.diff(np.append(first, len(backs)))
    after, odd = backs[first] + lengths, lengths % 2 == 1
    return quotes[~np.isin(quotes, after[odd])], bool(odd[-1] and after[-1] == len(a))


@dataclass
class Lexed:
    """Brackets outside texts with the depth after each, commas outside texts, and the state at the end."""

    places: np.ndarray
    depths: np.ndarray
    steps: np.ndarray
    commas: np.ndarray
    end: int

    def depth_at(self, places: np.ndarray, depth: int) -> np.ndarray:
        return np.append(depth, self.depths)[np.searchsorted(self.places, places)]


def lex(a: np.ndarray, state: int, depth: int = 0) -> Lexed:
    quotes, open_ = _quotes(a, state == ESCAPED)
    inside = int(state != OUTSIDE)
    # [ and { are 91 and 123, their closing ones two more
    low = a | 32
    brackets = np.flatnonzero((low == 123) | (low == 125))
    free = lambda x: x[(np.searchsorted(quotes, x) + inside) % 2 == 0]
    brackets, commas = free(brackets), free(np.flatnonzero(a == 44))
    steps = np.where(low[brackets] == 123, 1, -1)
    end = (inside + len(quotes)) % 2
    return Lexed(brackets, depth + np.cumsum(steps), steps, commas, ESCAPED if end and open_ else end)


def summary(a: np.ndarray) -> list[tuple[int, int, int]]:
    """For each state at the start: state at the end, change of depth, least change on the way (0 at most)."""
    out = []
    for state in (OUTSIDE, INSIDE, ESCAPED):
        x = lex(a, state)
        out.append((x.end, int(x.depths[-1]) if len(x.depths) else 0, min(0, int(x.depths.min())) if len(x.depths) else 0))
    return out


def then(a: list[tuple[int, int, int]], b: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The summary of two stretches, one after the other."""
    return [(b[s][0], d + b[s][1], min(low, d + b[s][2])) for s, d, low in a]


# ---- the passes ------------------------------------------------------------------


def _summaries(source: Pieces, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                found = summary(np.frombuffer(source.read(k * block, block), np.uint8))
                columns = [pa.array([list(x)], pa.list_(pa.int64())) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *columns], names=["block", "end", "delta", "low"])

    return run


def _parts_of(row) -> list[tuple[int, int, int]]:
    return list(zip(map(int, row.end), map(int, row.delta), map(int, row.low), strict=True))


def _compose(rows: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for row in rows.sort_values("block").itertuples():
        whole = _parts_of(row) if whole is None else then(whole, _parts_of(row))
    return pd.DataFrame({"run": [rows["run"].iloc[0]], **{n: [list(x)] for n, x in zip(("end", "delta", "low"), zip(*whole, strict=True), strict=True)}})


def _enter(at: dict[int, tuple[int, int]]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        state, depth = at[int(rows["run"].iloc[0])]
        out = []
        for row in rows.sort_values("block").itertuples():
            end, delta, low = _parts_of(row)[state]
            out.append((row.block, state, depth, depth + low))
            state, depth = end, depth + delta
        return pd.DataFrame(out, columns=["block", "state", "depth", "least"])

    return run


def _key_before(source: Pieces, at: int) -> str | None:
    """The member name that ends right before ``at``."""
    n = 4096
    while True:
        found = _KEY.search(source.read(max(0, at - n), min(n, at)))
        # a quote mark at the window's start, or after a backslash, may be within a longer name
        if found and (n >= at or (found.start() and found.string[found.start() - 1] != 92)):
            return json.loads(found[1])
        if n >= at:
            return None
        n *= 4


def _members(source: Pieces, block: int):
    """Where brackets lead to or from the root's members: (at, step, depth, array, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, state, depth in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a = np.frombuffer(source.read(k * block, block), np.uint8)
                x = lex(a, state, depth)
                near = np.where(x.steps > 0, x.depths <= 2, x.depths <= 1)
                rows = []
                for at, step, d in zip(x.places[near].tolist(), x.steps[near].tolist(), x.depths[near].tolist(), strict=True):
                    key = _key_before(source, k * block + at) if step > 0 and d == 2 else None
                    rows.append({"at": k * block + at, "step": step, "depth": d, "array": bool(a[at] in (91, 93)), "key": key})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("at", pa.int64()), ("step", pa.int64()), ("depth", pa.int64()), ("array", pa.bool_()), ("key", pa.string())]))

    return run


def _element_texts(source: Pieces, block: int, start: int, stop: int):
    """Elements of the array whose brackets are at start and stop, by the blocks that their separators lie in."""

    def rest(at: int, state: int, depth: int) -> bytes:
        """What the element that is open at ``at`` still has."""
        out = []
        while at < stop:
            data = source.read(at, min(block, stop - at))
            x = lex(np.frombuffer(data, np.uint8), state, depth)
            ends = x.commas[x.depth_at(x.commas, depth) == 2]
            if len(ends):
                out.append(data[: ends[0]])
                break
            out.append(data)
            at, state, depth = at + len(data), x.end, int(x.depths[-1]) if len(x.depths) else depth
        return b"".join(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k, state, depth in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = source.read(k * block, block)
                x = lex(np.frombuffer(data, np.uint8), state, depth)
                low, high = start - k * block, stop - k * block
                commas = x.commas[(x.depth_at(x.commas, depth) == 2) & (x.commas > low) & (x.commas < high)].tolist()
                marks = [low] * (0 <= low < len(data)) + commas
                for i, mark in enumerate(marks):
                    text = data[mark + 1 : marks[i + 1] if i + 1 < len(marks) else max(0, high)]
                    if i + 1 == len(marks) and high > len(data):
                        text += rest(k * block + len(data), x.end, int(x.depths[-1]) if len(x.depths) else depth)
                    if text.strip():  # nothing between the brackets is no element
                        held.append(text.decode("utf-8", "replace"))
                        size += len(text)
                    if size > FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["element"])
                        held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["element"])

    return run


@dataclass(frozen=True)
class Record:
    """A record whose arrays have been found."""

    spark: SparkSession
    source: Pieces
    block: int
    #: (block, state, depth, least) of each block
    entries: DataFrame | None
    #: name -> places of its brackets
    arrays: dict[str, tuple[int, int]]

    def elements(self, name: str) -> DataFrame:
        """One row (element) per element of an array, as JSON text."""
        if name not in self.arrays:
            return self.spark.createDataFrame([], "element string")
        start, stop = self.arrays[name]
        first, last = start // self.block, stop // self.block
        own = self.entries.filter(F.col("block").between(first, last)).select("block", "state", "depth")
        dealt = own.repartition(min(last - first + 1, MOST_TASKS), "block")
        return dealt.mapInArrow(_element_texts(self.source, self.block, start, stop), "element string")


def find(spark: SparkSession, path: str, block: int = BLOCK) -> Record:
    """The arrays of the record in a file, or in the files of a folder in order of their names."""
    source = pieces(path)
    n = -(-source.length // block)
    if not n:
        return Record(spark, source, block, None, {})
    told = spark.range(0, n, 1, min(n, MOST_TASKS)).mapInArrow(_summaries(source, block), "block long, end array<long>, delta array<long>, low array<long>")
    told = settled(told.withColumn("run", F.floor(F.col("block") / RUN)), "record-summaries")
    runs = told.groupBy("run").applyInPandas(_compose, "run long, end array<long>, delta array<long>, low array<long>")
    at, state, depth = {}, OUTSIDE, 0
    for row in sorted(runs.collect(), key=lambda r: r["run"]):  # one per run
        at[row["run"]] = (state, depth)
        end, delta, _ = _parts_of(row)[state]
        state, depth = end, depth + delta
    if state != OUTSIDE or depth:
        raise ValueError(f"{path} is no whole record: it ends {'in a text' if state else f'at depth {depth}'}")
    entries = settled(told.groupBy("run").applyInPandas(_enter(at), "block long, state int, depth long, least long"), "record-entries")
    near = entries.filter(F.col("least") <= 1).select("block", "state", "depth")
    marks = near.mapInArrow(_members(source, block), "at long, step long, depth long, array boolean, key string").limit(2 * MOST_MEMBERS + 3).collect()
    if len(marks) > 2 * MOST_MEMBERS + 2:
        raise ValueError(f"{path} has more than {MOST_MEMBERS} members")
    marks.sort(key=lambda r: r["at"])
    if marks and (marks[0]["array"] or sum(r["depth"] == 1 and r["step"] > 0 for r in marks) > 1):
        raise ValueError(f"{path} is not one record")
    arrays: dict[str, tuple[int, int]] = {}
    for a, b in itertools.pairwise(marks):
        if a["step"] > 0 and a["depth"] == 2 and a["key"] is not None:
            arrays.pop(a["key"], None)
            if a["array"]:
                arrays[a["key"]] = (a["at"], b["at"])
    return Record(spark, source, block, entries, arrays)
