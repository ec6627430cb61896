"""Which texts contain which parts (B8): a scan with rolling hashes, so that only hits leave a task.

Parts of one length are known by the rolling hashes of their bytes. A task lays the texts
of a batch side by side, has the hash of every window of a length by one difference of
prefix sums, and looks it up in a bitmap and then among the parts' hashes. Every hit is
compared with the parts again as a string, by an equi-join, so a chance agreement of
hashes costs a row and never a wrong match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settled

#: Parts whose hashes (8 bytes each) are sent to all tasks; more are met by shuffle, as every window is a row then.
FILTER_PARTS = 2_000_000
_BITS = 22
#: Base of the prefix sums, and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray, length: int) -> np.ndarray:
    h = (h ^ np.uint64(length * 0xD6E8FEB86659FD93 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def windows(data: np.ndarray, length: int, sums: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Mixed hashes of all windows of ``length`` bytes of ``data``."""
    n = len(data) - length + 1
    return _mixed((sums[length:] - sums[: len(sums) - length]) * inverse[:n], length) if n > 0 else np.zeros(0, np.uint64)


def _sums(data: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)])


def part_hash(part: bytes) -> int:
    data = np.frombuffer(part, np.uint8)
    return int(windows(data, len(data), _sums(data), _powers(_INVERSE, len(data)))[0])


def _part_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [p.encode() for p in batch.column(0).to_pylist()]
        hashes = np.array([part_hash(p) for p in parts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array([len(p) for p in parts], pa.int32())], names=["h", "length"])


def _scan(keys: np.ndarray, lengths: list[int]):
    """(key, part) of texts (key, text), once for each part whose hash the text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[keys >> np.uint64(64 - _BITS)] = True
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            size = np.array([len(t) for t in texts], np.int64)
            data = np.frombuffer(b"".join(texts), np.uint8)
            end, owner = np.repeat(np.cumsum(size), size), np.repeat(np.arange(len(texts)), size)
            sums, inverse = _sums(data), _powers(_INVERSE, len(data))
            row: list[np.ndarray] = []
            parts: list[str] = []
            for n in lengths:
                h = windows(data, n, sums, inverse)
                at = np.flatnonzero(bitmap[h >> np.uint64(64 - _BITS)])
                at = at[at + n <= end[at]]
                if not len(at):
                    continue
                near = np.searchsorted(keys, h[at])
                at = at[keys[np.minimum(near, len(keys) - 1)] == h[at]]
                # once for each text
                _, once = np.unique(np.stack([owner[at].astype(np.uint64), h[at]]), axis=1, return_index=True)
                at = at[once]
                # windows that cut a character are no text
                good = [(i, p) for i in at.tolist() if (p := _text(data[i : i + n]))]
                row.append(owner[[i for i, _ in good]])
                parts += [p for _, p in good]
            rows = np.concatenate(row) if row else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(parts, pa.string())], names=["key", "part"])

    return run


def _text(raw: np.ndarray) -> str | None:
    try:
        return raw.tobytes().decode()
    except UnicodeDecodeError:
        return None


def _all_windows(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, part): the distinct substrings of each text with these numbers of characters."""
    size = F.length("text")
    each = texts.withColumn("_n", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>"))).filter(F.col("_n") <= size)
    part = F.transform(F.sequence(F.lit(1), size - F.col("_n") + 1), lambda i: F.substring("text", i, F.col("_n")))
    # outer: for explode Spark infers a size filter in which the array would be computed again
    return each.select("key", F.explode_outer(F.array_distinct(part)).alias("part"))


def containing(texts: DataFrame, parts: DataFrame, filter_parts: int = FILTER_PARTS) -> DataFrame:
    """(part, n, key) for each of ``parts`` (part: distinct, not null): how many ``texts`` (key, text) contain it, and the smallest key of them.

    The empty part is in every text that is not null; null texts contain nothing. Hits
    are counted within tasks first, so a part that all texts have is no hot key.
    """
    texts = texts.select(F.col("key").cast("string").alias("key"), "text").filter("text is not null")
    given = settled(parts.select("part"), "parts")
    real = given.filter("part <> ''")
    if real.count() <= filter_parts:
        hashes = real.mapInArrow(_part_hashes, "h long, length int").toPandas()  # as many as the filter may have
        keys, lengths = np.unique(hashes["h"].to_numpy(np.int64).view(np.uint64)), sorted(set(hashes["length"].tolist()))
        found = texts.mapInArrow(_scan(keys, lengths), "key string, part string")
    else:
        found = _all_windows(texts, [r[0] for r in real.select(F.length("part")).distinct().collect()])  # no more than the longest part is long
    if not given.filter("part = ''").isEmpty():
        found = found.unionByName(texts.select("key", F.lit("").alias("part")))
    hits = found.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
    return given.join(hits, "part", "left").select("part", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "key")
