"""Periodic runs of words in whole documents (operator 12).

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) and at least max(MIN_WORDS, MIN_TIMES * q) words that no neighbouring word
extends. With the words of a run marked by i where word i equals word i + q, a run is
an interval of such i of at least max(MIN_WORDS - q, 2 q) words.

Steps
    1. ``_tiles``: periods are taken by octaves, 1 to 15, 16 to 31, 32 to 63 and so on. An
       octave up to the period B has a boundary at every multiple of B, so that each
       interval of a run holds one. The words around the boundaries, B before and 2 B
       behind, are overlapping tiles; boundaries with less than CORE words between them
       share a tile. A tile is made only where eight words at a boundary, before or
       behind it, recur at a distance within the octave: without that no interval of a
       run holds the boundary.
    2. ``_solve``: tiles are dealt over all tasks, whatever documents they are from. At a
       boundary b two Z-functions give for each period p how far word i equals word i + p
       behind b and before it. Periods whose root is itself a repetition belong to a
       smaller period and go. What reaches as far as the next boundary, or is long enough,
       is a fragment.
    3. fragments are shuffled by document and period, and those that touch are one
       interval; its length decides.
    4. documents with runs drop the words of each run behind its first q.

Work grows with n log n for a document of n words, whatever they are. A tile of the
highest octave spans its document; smaller tiles of a long document spread over tasks.

Edge cases: a null or empty text, or one of white space, has no words and no runs; the
digests are then those of the empty string. Words are split at the six white-space
characters of ASCII only. Rows are documents: rows that repeat an id, or have none, are
judged each by its own text. Extra columns are not read; an empty table gives no rows.
Among runs with equal exponents the smallest start, then the smallest period wins.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, tune

MIN_WORDS, MIN_TIMES = 24, 3
#: Boundary distance of the first octave, words compared to find boundaries, words between boundaries that share a tile.
FIRST, GRAM, CORE = 16, 8, 1 << 15
#: Words of tiles in one batch.
BATCH_WORDS = 1 << 21

Rewrite = Callable[["int | None", list[bytes]], list[bytes]]

FOUND = pa.schema([
    ("key", pa.int64()), ("doc_id", pa.int64()), ("text", pa.binary()), ("collapsed", pa.string()), ("stride", pa.int64()), ("low", pa.int64()),
    ("words", pa.list_(pa.int32())), ("bounds", pa.list_(pa.int32())),
])
FOUND_DDL = "key long, doc_id long, text binary, collapsed string, stride long, low long, words array<int>, bounds array<int>"
FRAGMENTS = "key long, period long, start long, end long"
RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
    ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
])
RESULT_DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8: bytes.split() knows the six white-space characters of ASCII and no others."""
    return (text or b"").split()


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int32)


def _grams(ids: np.ndarray) -> np.ndarray:
    """A mark of the GRAM words from each position on."""
    f = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    f ^= f >> np.uint64(29)
    k = 1
    while k < GRAM:
        f = f[:-k] * np.uint64(0xBF58476D1CE4E5B9) + f[k:]
        f ^= f >> np.uint64(31)
        k *= 2
    return f


def octaves(n: int) -> Iterator[tuple[int, int]]:
    """(smallest period, boundary distance) of the octaves of n words; the distance is also the first period beyond the octave."""
    low, stride = 1, FIRST
    while MIN_TIMES * low <= n:
        yield low, stride
        low, stride = stride, 2 * stride


def boundaries(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(stride, boundaries) of each octave, only of boundaries that an interval of a run may hold."""
    n = len(ids)
    if n < MIN_WORDS:
        return
    grams = _grams(ids)
    pad = np.arange(GRAM, dtype=np.uint64)  # equal to no other mark but by chance, which only costs time
    for low, stride in octaves(n):
        rows = -(-n // stride)
        behind = np.concatenate([grams, np.arange(GRAM, GRAM + rows * stride - len(grams), dtype=np.uint64)]).reshape(rows, stride)
        before = np.concatenate([pad, behind.ravel()[:-GRAM]]).reshape(rows, stride)
        hit = (behind[:, low:] == behind[:, :1]).any(1) | (before[:, low:] == before[:, :1]).any(1)
        at = np.flatnonzero(hit) * stride
        if len(at):
            yield stride, at


def tiles(ids: np.ndarray, core: int = CORE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(stride, first word, words, boundaries counted from it): overlapping tiles of each octave."""
    for stride, at in boundaries(ids):
        block = at // max(core, stride)
        for part in np.split(at, np.flatnonzero(np.diff(block)) + 1):
            low = max(0, int(part[0]) - stride)
            yield stride, low, ids[low : int(part[-1]) + 2 * stride], part - low


def z_function(s: list[int], upto: int) -> list[int]:
    """For each position below ``upto`` the length of the longest common prefix of s and s from there on."""
    n = len(s)
    z = [0] * min(upto, n)
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def fragments(words: list[int], b: int, stride: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of the parts around the boundary b of intervals in which word i equals word i + period."""
    left, right = words[max(0, b - stride) : b], words[b : b + 2 * stride]
    behind = z_function(right, stride)
    head = right[:stride]
    turned = left[::-1] + [-1] + head[::-1] + left[::-1]
    before = z_function(turned, len(turned))
    repeated: set[int] = set()
    for p in range(1, len(behind)):
        if behind[p] >= p and p not in repeated:  # the root is p words; its repetitions are no roots of their own
            repeated.update(range(2 * p, min(p + behind[p], stride) + 1, p))
    low = 1 if stride == FIRST else stride // 2
    for p in range(low, len(behind)):
        on = min(behind[p], stride)
        if not on or p in repeated:
            continue
        back = before[len(left) + 1 + len(head) - p] if left else 0
        if on == stride or back == stride or on + back >= max(MIN_WORDS - p, (MIN_TIMES - 1) * p):
            yield p, b - back, b + on


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(FOUND)], schema=FOUND)


def _tiles(rewrite: Rewrite | None, core: int):
    """A row per document, with its text if it has tiles and else with its digest, and a row per tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if rewrite is not None:
                    words = rewrite(doc, words)
                joined, before = b" ".join(words), len(rows)
                for stride, low, part, at in tiles(numbered(words), core):
                    rows.append((key, None, None, None, stride, low, part, at))
                    held += len(part)
                if len(rows) > before:
                    rows.append((key, doc, joined, None, None, None, None, None))
                else:
                    rows.append((key, doc, None, hashlib.sha256(joined).hexdigest(), None, None, None, None))
                key += 1
                if held >= BATCH_WORDS:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)

    return run


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fragments of tiles (key, stride, low, words, bounds)."""
    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        for i, (key, stride, low, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True)):
            words = batch.column(3)[i].values.to_pylist()
            out += [(key, p, low + s, low + e) for b in at for p, s, e in fragments(words, b, stride)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["key", "period", "start", "end"])


def stitched(found: DataFrame) -> DataFrame:
    """Runs (key, start, length, period) of fragments (key, period, start, end): those that touch are one interval."""
    order = Window.partitionBy("key", "period").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("_new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(0)))
    marked = marked.withColumn("_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = marked.groupBy("key", "period", "_no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start") + F.col("period")
    least = F.greatest(F.lit(MIN_WORDS), MIN_TIMES * F.col("period"))
    return whole.select("key", "start", length.alias("length"), "period").filter(F.col("length") >= least)


def summary(doc: int | None, text: bytes, runs: list[tuple[int, int, int]]) -> tuple:
    """The result row of a document with the runs (start, length, period), given in order."""
    best = None
    for r in runs:
        # exact: length / period by cross multiplication; the first of equals has the smallest start, then period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    words = text.split()
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        s, n, q = (np.array(x) for x in zip(*runs, strict=True))
        np.add.at(edge, s + q, 1)
        np.add.at(edge, s + n, -1)
        text = b" ".join([w for w, out in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not out])
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc, len(runs), *top, digest, hashlib.sha256(text).hexdigest()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            summary(doc, text, [(r["start"], r["length"], r["period"]) for r in runs or []])
            for doc, text, runs in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(RESULT)], schema=RESULT)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None, core: int = CORE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents without tiles, documents with tiles, runs).

    The first has (doc_id, collapsed: digest of its words joined by one space), the second
    (key, doc_id, text: its words joined by one space) and the third (key, start, length,
    period). ``rewrite`` may change a document's words before all else. Keys are numbers of
    rows of this call; they are written with the tiles, so they never change.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = cut(rows.mapInArrow(_tiles(rewrite, core), FOUND_DDL), "period-tiles")
    dealt = found.filter("words is not null").select("key", "stride", "low", "words", "bounds").repartition("key", "stride", "low")
    runs = stitched(dealt.mapInArrow(_solve, FRAGMENTS))
    plain = found.filter("collapsed is not null").select("doc_id", "collapsed")
    return plain, found.filter("text is not null").select("key", "doc_id", "text"), runs


def run_summaries(docs: DataFrame, **options) -> DataFrame:
    """One row per document: number of runs, the run of greatest exponent, digests of all runs and of the words that are kept."""
    plain, tiled, runs = periodic_runs(docs, **options)
    of_doc = runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    rest = tiled.join(of_doc, "key", "left").select("doc_id", "text", "runs").mapInArrow(_summaries, RESULT_DDL)
    none = F.lit(None).cast("long")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    done = plain.select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), *[none.alias(c) for c in ("start", "length", "period", "exponent_milli")],
        empty.alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )
    return done.unionByName(rest)


def repeated_tail(doc: int | None, words: list[bytes]) -> list[bytes]:
    """In one document of ten, by its id, the words from some place on repeat with some period."""
    if doc is None or not words or (h := zlib.crc32(str(doc).encode())) % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_summaries(table(spark, sf_dir, "documents"), rewrite=repeated_tail)
