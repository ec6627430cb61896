"""Token counts of documents in flat token files without an index (operator 4).

A flat file is nothing but token ids (little-endian unsigned 16 bits) with an
end-of-document id after each document. Files are read in fixed blocks, each by
itself: a vectorised search finds the end ids, and the block reports its number of
ends, the positions of the first and the last, and the lengths between them. A
document that spans blocks is stitched by a prefix scan: the last end before a block
is a running maximum, and the number of documents before it a running sum. The scan
has two levels, groups of ``GROUP`` blocks and then the groups of a file, so that a
huge file is not one window.

Edge cases: empty documents have count 0; tokens after a file's last end are one
unterminated document; a block without an end reports none; null and empty texts are
written as empty documents; the end string in a text is ordinary text; repeated rows
and null ids are documents like others; ids are whole numbers, others are an error;
empty tables write no files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import new_folder
from .common import cut, remove, table, tune
from .storage import SharedFile, open_read
from .tokens import END_ID, bpe, vocabulary_path

WIDTH = 2
#: Tokens in a block, blocks in a group of the scan, bytes after which a file is closed.
BLOCK = 1 << 19
GROUP = 1024
FILE_BYTES = 256 << 20


def _write(path: str, folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, out, ids = bpe(path), None, []
        end = np.array([END_ID], "<u2").tobytes()

        def close() -> pa.RecordBatch:
            uri = out.close()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([uri] * len(ids)),
                    pa.array(range(len(ids)), pa.int64()),
                    pa.array(ids, pa.int64()),
                    pa.array([out.size] * len(ids), pa.int64()),
                ],
                names=["file", "ordinal", "doc_id", "bytes"],
            )

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(keys), 64):
                if out is None:
                    out, ids = SharedFile(folder, f"tokens-{TaskContext.get().partitionId():06d}", ".bin"), []
                out.write(b"".join(t.astype("<u2").tobytes() + end for t in tokenizer.encode(texts[i : i + 64], special=False)))
                ids += keys[i : i + 64]
                if out.size >= file_bytes or len(ids) >= 1_000_000:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes flat token files; returns which document is which of a file: (file, ordinal, doc_id, bytes of the file)."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cut(
        rows.mapInArrow(_write(path or vocabulary_path(), folder, file_bytes), "file string, ordinal long, doc_id long, bytes long"),
        "token-files",
    )


def _scan(end_id: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, number, total in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with open_read(file) as f:
                    f.seek(number * block * WIDTH)
                    ids = np.frombuffer(f.read(min(block * WIDTH, total - number * block * WIDTH)), "<u2")
                at = np.flatnonzero(ids == end_id) + number * block
                inner = np.diff(at) - 1
                first, last = (int(at[0]), int(at[-1])) if len(at) else (None, None)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([number], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([first], pa.int64()), pa.array([last], pa.int64()), pa.array([inner.tolist()], pa.list_(pa.int64()))], names=["file", "block", "n", "first", "last", "inner"])

    return run


def count_tokens(files: DataFrame, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """One row (file, ordinal, n_tokens, terminated) per document in ``files`` (file, bytes)."""
    blocks = files.filter("bytes > 0").select(
        "file",
        F.explode(F.sequence(F.lit(0), F.ceil(F.col("bytes") / (block * WIDTH)).cast("long") - 1)).alias("block"),
        "bytes",
    )
    found = cut(
        blocks.repartition("file", "block").mapInArrow(
            _scan(end_id, block),
            "file string, block long, n long, first long, last long, inner array<long>",
        ).withColumn("group", F.floor(F.col("block") / GROUP)),
        "blocks",
    )
    # prefix scan of (number of ends, last end): within groups, then over each file's groups
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = found.groupBy("file", "group").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    groups = groups.select(
        "file",
        "group",
        F.coalesce(F.sum("n").over(before("file", "group")), F.lit(0)).alias("group_n"),
        F.max("last").over(before("file", "group")).alias("group_last"),
    )
    within = before("file", "group", "block")
    scanned = found.withColumn("my_n", F.coalesce(F.sum("n").over(within), F.lit(0))).withColumn("my_last", F.max("last").over(within)).join(
        groups,
        ["file", "group"],
    )
    start = F.coalesce("my_last", "group_last", F.lit(-1))
    ended = scanned.filter("n > 0").select(
        "file",
        (F.col("group_n") + F.col("my_n")).alias("base"),
        F.posexplode(F.concat(F.array(F.col("first") - start - 1), F.col("inner"))).alias("k", "n_tokens"),
    )
    ended = ended.select("file", (F.col("base") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("terminated"))
    tails = found.groupBy("file").agg(F.sum("n").alias("ordinal"), F.coalesce(F.max("last"), F.lit(-1)).alias("last")).join(
        files.select("file", "bytes"),
        "file",
    )
    tails = tails.select(
        "file",
        "ordinal",
        (F.col("bytes") / WIDTH - F.col("last") - 1).cast("long").alias("n_tokens"),
        F.lit(False).alias("terminated"),
    ).filter("n_tokens > 0")
    return ended.unionByName(tails)


def op4_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    written = write_tokens(table(spark, sf_dir, "documents"), folder)
    files = cut(written.select("file", "bytes").distinct(), "token-file-sizes")
    counts = count_tokens(files)
    remove(spark, folder)  # the blocks' reports are all that is read from here on
    # a row per document on both sides: their files are so small that Spark would broadcast millions of rows
    return written.select("file", "ordinal", "doc_id").join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")
