"""Comparing the members of groups of any size, in tasks of bounded size.

A group of n rows is dealt to ceil(n / block) blocks by a hash of the row's key, and
each pair of blocks is one task: no task sees more than two blocks, no row pair is
ever a row, and a group is never gathered whole. Every row pair of a group meets in
exactly one task. Rows are repeated once for each block of their group, which is
once for ordinary groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deal(rows: DataFrame, group: str, size: str, key: str, block: int) -> DataFrame:
    """Adds block_i <= block_j (a task of the group) and own (which of the two blocks the row is in).

    ``size`` holds the group's number of rows. Rows of one block are a little uneven, as a hash deals them.
    """
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64(F.col(key), F.lit(7)), n).cast("int")
    out = rows.withColumn("_n", n).withColumn("own", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return out.withColumn("block_i", F.least("own", "_other")).withColumn("block_j", F.greatest("own", "_other")).drop("_n", "_other")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal keys, of a partition sorted by them, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new).tolist()
        first = tuple(c[0].as_py() for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for end in [*starts, batch.num_rows]:
            held.append(batch.slice(at, end - at))
            if end < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
            at = end
        last = tuple(c[-1].as_py() for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def roots(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that the links (p, q) join it to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


class LinkRows:
    """Collects rows (id, other, links): links counted at an id (other null), and ids that the links join (links 0)."""

    def __init__(self, id_name: str = "id"):
        self.names, self.cols = [id_name, "other", "links"], ([], [], [])

    def add(self, ids: np.ndarray, p: np.ndarray, q: np.ndarray, copies: np.ndarray | None) -> None:
        """Links between the rows p and q of ``ids``; without ``copies`` only what they join."""
        if not len(p):
            return
        root = roots(p, q, len(ids))
        if copies is not None:
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            has = np.flatnonzero(links)
            self._more(ids[has], [None] * len(has), links[has].tolist())
        joined = np.flatnonzero(root != np.arange(len(ids)))
        self._more(ids[joined], ids[root[joined]].tolist(), [0] * len(joined))

    def _more(self, ids: np.ndarray, other: list, links: list) -> None:
        for c, v in zip(self.cols, (ids.tolist(), other, links), strict=True):
            c.extend(v)

    def take(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        """The rows so far, if there are at least so many."""
        if len(self.cols[0]) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in self.cols], names=self.names)
            for c in self.cols:
                c.clear()
