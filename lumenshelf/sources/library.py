"""File listings, content hashes, sidecar files and table storage (A1, A4, A5, B2)."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import media_type


def list_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """A1: (path relative to ``root``, length, modificationTime[, content]) of files of known types; contents are not read unless asked for. Empty files are no media; the file source leaves them out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.split(":", 1)[-1].lstrip("/").rstrip("/") + "/"
    relative = F.regexp_replace("path", r"^[a-z0-9]+:/+", "")  # the file source spells names as they are
    out = files.withColumn("path", F.regexp_replace(relative, rf"^\Q{base}\E", ""))
    return out.filter(media_type(F.col("path")).isNotNull()).select("path", "length", "modificationTime", *(["content"] if content else []))


def _place(root: str) -> tuple[fs.FileSystem, str]:
    store, base = fs.FileSystem.from_uri(root if ":" in root else f"file://{root}")
    return store, base.rstrip("/")


def ends(f: pa.NativeFile, chunk: int) -> tuple[bytes, bytes]:
    """The first and the last ``chunk`` bytes of an open file, by two ranged reads; the last are empty if the first are all."""
    size = f.size()
    return f.read_at(min(size, chunk), 0), f.read_at(chunk, size - chunk) if size > chunk else b""


def _hash_ends(root: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _place(root)
        for batch in batches:
            hashes: list[str | None] = []
            sizes: list[int] = []
            for path in batch.column(0).to_pylist():
                try:
                    with store.open_input_file(f"{base}/{path}") as f:
                        first, last = ends(f, chunk)
                except FileNotFoundError:
                    hashes.append(None)
                    sizes.append(0)
                    continue
                hashes.append(hashlib.md5(first + last).hexdigest())
                sizes.append(len(first) + len(last))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.string()), pa.array(sizes, pa.int64())], names=[*batch.schema.names, "hash", "bytes_read"])

    return run


def hash_files(files: DataFrame, root: str, chunk: int = 65536) -> DataFrame:
    """B2 for files: adds hash, as ``content_hash`` of the whole content, and bytes_read to ``files`` (path below ``root``, ...).

    Tasks open the files and read two ranges of each, so a file of any length costs two
    small reads. A file that is gone by then has a null hash. ``root`` is a path or URI
    that executors reach.
    """
    rows = files.select("path", *[c for c in files.columns if c != "path"])
    # opening files is slow and listings are short: deal them to all tasks
    dealt = rows.repartition("path")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.mapInArrow(_hash_ends(root, chunk), f"{kinds}, hash string, bytes_read long")


def _write_files(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _place(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place = f"{base}/{path}"
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                # a task that is run again puts the same file in place of its first try's
                part = f"{place}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as f:
                    f.write(content or b"")
                store.move(part, place)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    return run


def write_tree(files: DataFrame, root: str) -> int:
    """Writes ``files`` (path, content) below ``root``, a folder that all executors reach; returns how many there are. Paths are unique."""
    return files.select("path", "content").mapInArrow(_write_files(root), "path string").count()


def sidecar(text: Column) -> Column:
    """A5: struct(artist, album, title) of a sidecar JSON text; a value may be a text or an object with a name; bad JSON gives nulls."""

    def field(*names: str) -> Column:
        got = []
        for n in names:
            plain = F.get_json_object(text, f"$.{n}")
            got += [F.nullif(F.get_json_object(text, f"$.{n}.name"), F.lit("")), F.when(~plain.startswith("{"), F.nullif(plain, F.lit("")))]
        return F.coalesce(*got)

    return F.struct(field("artist", "author").alias("artist"), field("album").alias("album"), field("title", "content").alias("title"))


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """A4: Parquet, media partitioned by type."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("type") if name == "media" else writer).parquet(f"{root}/{name}")


def read_tables(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}
