"""Packing documents into fixed-length token sequences (operator 2).

Bounded-space online packing: every partition keeps ``open_windows`` windows. A
document is cut into full windows and a rest; the rest goes best-fit, to the fullest
open window that takes it whole. When none fits, the fullest window is emitted; if
its gap is at least ``least_cut`` tokens, the head of the rest fills the gap first.
Windows still open at the end of a partition are merged: those of ``merge_partitions``
partitions at a time go through the same packer with their pieces in order of size,
largest first, so no task holds more than merge_partitions x open_windows windows.

Memory in a task: the open windows and one Arrow batch of texts. Sequences are
padded to ``size`` tokens; one whose fill is a power of two needs no padding.

Edge cases: a null or empty text is the single end id; very long texts are cut
into windows; repeated rows and ids are packed like any others (pieces carry a
row number so that their starts are never mixed up); extra columns are not read;
an empty table gives no pieces. Ids are whole numbers; other ids are an error. Cutting makes tie-breaking immaterial to padding;
among equally full windows the oldest wins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, tune
from .tokens import bpe, vocabulary_path

SIZE = 1024
END = 0
OPEN_WINDOWS = 32
LEAST_CUT = 16
MERGE_PARTITIONS = 32

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("merge_group", pa.int64()),
])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, merge_group long"


class Packer:
    """Places pieces (doc_id, start, ids, doc_tokens) in bounded space; ``done`` collects closed windows."""

    def __init__(self, size: int, open_windows: int, least_cut: int):
        self.size, self.most, self.least_cut = size, open_windows, least_cut
        self.open: list[list] = []  # [fill, pieces], oldest first
        self.done: list[list[tuple]] = []

    def add(self, doc: int, start: int, ids: np.ndarray, total: int) -> None:
        """One document, or one piece of it that starts at ``start``."""
        whole = len(ids) // self.size * self.size
        for i in range(0, whole, self.size):
            self.done.append([(doc, start + i, ids[i : i + self.size], total)])
        if whole < len(ids):
            self._place(doc, start + whole, ids[whole:], total)

    def _place(self, doc: int, start: int, ids: np.ndarray, total: int) -> None:
        need = len(ids)
        best = max((w for w in self.open if w[0] + need <= self.size), key=lambda w: w[0], default=None)
        if best is None and len(self.open) >= self.most:
            fullest = max(self.open, key=lambda w: w[0])
            gap = self.size - fullest[0]
            if gap >= self.least_cut:
                fullest[1].append((doc, start, ids[:gap], total))
                start, ids = start + gap, ids[gap:]
            self.open.remove(fullest)
            self.done.append(fullest[1])
            best = max((w for w in self.open if w[0] + len(ids) <= self.size), key=lambda w: w[0], default=None)
        if best is None:
            best = [0, []]
            self.open.append(best)
        best[0] += len(ids)
        best[1].append((doc, start, ids, total))
        if best[0] == self.size:
            self.open.remove(best)
            self.done.append(best[1])

    def take(self) -> list[list[tuple]]:
        out, self.done = self.done, []
        return out


def _rows(windows: list[list[tuple]], first: int, keep_ids: bool, group: int | None) -> pa.RecordBatch:
    """Piece rows of windows numbered from ``first``."""
    cols: list[list] = [[] for _ in PIECES]
    for k, window in enumerate(windows):
        offset = 0
        for doc, start, ids, total in window:
            raw = ids.tobytes()
            for c, v in zip(cols, (doc, start, len(ids), zlib.crc32(raw), total, first + k, offset, raw if keep_ids else None, group), strict=True):
                c.append(v)
            offset += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PIECES, strict=True)], schema=PIECES)


def _pack(path: str, size: int, open_windows: int, least_cut: int, merge_partitions: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer, n, tokenizer = Packer(size, open_windows, least_cut), part << 36, bpe(path)
        end = np.array([END], "<u4")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(ids), 64):  # token lists are larger than texts
                for doc, tokens in zip(ids[i : i + 64], tokenizer.encode(texts[i : i + 64]), strict=True):
                    tokens = np.concatenate([tokens, end])
                    packer.add(doc, 0, tokens, len(tokens))
                if len(packer.done) >= 256:
                    windows = packer.take()
                    yield _rows(windows, n, keep_ids, None)
                    n += len(windows)
        windows = packer.take()
        yield _rows(windows, n, keep_ids, None)
        # what is left keeps its ids, as merging may cut it again
        yield _rows([w[1] for w in packer.open], n + len(windows), True, part // merge_partitions)

    return run


def _merge(size: int, open_windows: int, least_cut: int, keep_ids: bool):
    def run(group: pa.Table) -> pa.Table:
        packer = Packer(size, open_windows, least_cut)
        group = group.sort_by([("length", "descending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        for doc, start, raw, total in zip(*(group.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
            packer.add(doc, start, np.frombuffer(raw, "<u4"), total)
        windows = packer.take() + [w[1] for w in packer.open]
        first = (1 << 62) + (group.column("merge_group")[0].as_py() << 36)
        return pa.Table.from_batches([_rows(windows, first, keep_ids, None)])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, size: int = SIZE, open_windows: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT, merge_partitions: int = MERGE_PARTITIONS, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``ids`` (little-endian unsigned 32-bit) is null with ``keep_ids=False``. A sequence's
    pieces, in order of offset, are its tokens. Texts are tokenised once: the result
    of the first pass is written to the shared folder.
    """
    tune(docs.sparkSession)
    path = path or vocabulary_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = cut(rows.mapInArrow(_pack(path, size, open_windows, least_cut, merge_partitions, keep_ids), PIECES_DDL), "packed-pieces")
    left = first.filter(F.col("merge_group").isNotNull())
    merged = left.groupBy("merge_group").applyInArrow(_merge(size, open_windows, least_cut, keep_ids), PIECES_DDL)
    return first.filter(F.col("merge_group").isNull()).unionByName(merged).drop("merge_group")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the packed ids, as they were written."""
    rows = pack(table(spark, sf_dir, "documents"))
    made = {"length": (F.octet_length("ids") / 4).cast("long"), "ids_crc32": F.crc32("ids")}
    return rows.withColumns(made).drop("ids")
