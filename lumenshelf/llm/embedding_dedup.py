"""Near-duplicate embeddings by Euclidean p-stable hashing (operator 8).

Vectors are normalised; each hash table quantises Gaussian projections with width
``WIDTH`` (Datar et al. 2004), so that vectors at a small Euclidean distance, which
on the unit sphere is a large cosine, mostly share a bucket. How many projections a
table has follows from the number of vectors, so that a vector meets about ``MATES``
unrelated ones in a bucket at any size; how many tables there are follows from the
recall that pairs at the very threshold must have (``plan``).

Steps
    1. equal vectors with equal labels collapse into a class, which has a number of
       its own: ids may repeat, so they name no class;
    2. buckets hold 64 sign bits and a 16-bit mark per table for each class, not its
       vector. Pairs of which no more bits differ than in pairs at the threshold, with
       five standard errors added, are likely; a pair belongs to the first table in
       which its marks agree (two marks agree by chance once in 65,536);
    3. only classes of likely pairs meet with their vectors, in the bucket that the
       pair belongs to, and exact cosines in double precision decide.
Large buckets are compared in blocks (see ``blocks``); tasks emit a row or two per
linked class, never all pairs.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite numbers,
and rows with a null label link with nothing and are their own component; vectors of
different lengths never link; rows are the vectors, so rows that repeat an id are
compared like others, each with its own vector, and link if the vectors do; rows
with a null id count as links and never name a component unless all its ids are null;
extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import LinkRows, deal, runs
from .common import components, cut, lookup, table, tune

COSINE, RECALL = 0.93, 0.97
WIDTH, SEED, MATES = 2.0, 20240, 32
#: Rows in a block of a bucket; two blocks are compared as one matrix.
BLOCK = 1500
#: Large buckets are broadcast up to this many (16 bytes each), and joined by shuffle beyond.
BROADCAST_BUCKETS = 200_000
KEYS = ["node", "block_i", "block_j"]
LINKS = "class_key long, other long, links long"


def agreement(distance: float, width: float) -> float:
    """Probability that one quantised projection of two vectors at a Euclidean distance is equal."""
    r = width / distance
    tail = math.erfc(r / math.sqrt(2))  # two-sided
    return 1 - tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(vectors: int, cosine: float, recall: float, width: float, mates: int = MATES) -> tuple[int, int]:
    """(projections in a table, tables) for so many vectors of one label."""
    near, far = agreement(math.sqrt(2 - 2 * cosine), width), agreement(math.sqrt(2), width)
    hashes = max(4, math.ceil(math.log(max(vectors, 1) / mates) / -math.log(far)))
    return hashes, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**hashes)))


def likely_bits(cosine: float) -> int:
    """Differing sign bits of 64 up to which a pair is looked at."""
    share = math.acos(cosine) / math.pi
    return math.floor(64 * share + 5 * math.sqrt(64 * share * (1 - share)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def unit(vectors: list) -> np.ndarray:
    """Rows of length one, in double precision, of vectors of one dimension."""
    x = np.array(vectors, float)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _codes(tables: int, hashes: int, width: float, seed: int):
    """(class_key, nodes, marks) of classes (class_key, label_hash, vector): a bucket per table; sign bits and the tables' marks."""

    def coded(x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([seed, x.shape[1]])
        planes, shift = rng.standard_normal((x.shape[1], tables * hashes)), rng.uniform(0, width, tables * hashes)
        mixers = rng.integers(1, 2**63, hashes, dtype=np.uint64) | np.uint64(1)
        at = np.floor((x @ planes + shift) / width).astype(np.int64).astype(np.uint64).reshape(len(x), tables, hashes)
        salt = _mix(np.arange(1, tables + 1, dtype=np.uint64) + np.uint64(x.shape[1] << 20))
        nodes = _mix(_mix((at * mixers).sum(2, dtype=np.uint64) ^ salt[None, :]) ^ label[:, None])
        signs = np.packbits(x @ rng.standard_normal((x.shape[1], 64)) > 0, axis=1)
        return nodes, np.hstack([signs, (nodes >> np.uint64(48)).astype("<u2").view(np.uint8)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, label = batch.column(2).to_pylist(), batch.column(1).to_numpy().view(np.uint64)
            nodes = np.empty((len(vectors), tables), np.uint64)
            marks = np.empty((len(vectors), 8 + 2 * tables), np.uint8)
            dims = np.array([len(v) for v in vectors])
            for dim in set(dims.tolist()):
                at = np.flatnonzero(dims == dim)
                nodes[at], marks[at] = coded(unit([vectors[i] for i in at]), label[at])
            made = [pa.array(list(nodes.view(np.int64)), pa.list_(pa.int64())), pa.array([m.tobytes() for m in marks], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["class_key", "nodes", "marks"])

    return run


def _belong_here(p: np.ndarray, q: np.ndarray, marks: np.ndarray, table_no: int) -> np.ndarray:
    """Which pairs agree in this table's mark first."""
    out = np.ones(len(p), bool)
    for k in range(0, len(p), 1 << 16) if table_no else ():
        s = slice(k, k + (1 << 16))
        out[s] = ~(marks[p[s], :table_no] == marks[q[s], :table_no]).any(1)
    return out


def _group_of(group: pa.Table) -> tuple:
    """(table, rows of the left block, rows of the right block, are they one, class keys, sign bits, marks)"""
    own = group.column("own").to_numpy()
    table_no, i, j = (group.column(c)[0].as_py() for c in ("table", "block_i", "block_j"))
    raw = np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint8).reshape(len(own), -1)
    signs = np.ascontiguousarray(raw[:, :8]).view(np.uint64).ravel()
    marks = np.ascontiguousarray(raw[:, 8:]).view("<u2")
    return table_no, np.flatnonzero(own == i), np.flatnonzero(own == j), i == j, group.column("class_key").to_numpy(), signs, marks


def _likely(most: int):
    """(class_key, node, table) of classes in a likely pair that belongs to the bucket ``node``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, KEYS):
            if group.num_rows < 2:
                continue
            table_no, left, right, one, ids, signs, marks = _group_of(group)
            near = np.bitwise_count(signs[left][:, None] ^ signs[right][None, :]) <= most
            p, q = np.nonzero(np.triu(near, 1) if one else near)
            if not len(p):
                continue
            p, q = left[p], right[q]
            here = _belong_here(p, q, marks, table_no)
            met = ids[np.union1d(p[here], q[here])]
            if len(met):
                node = group.column("node")[0].as_py()
                columns = [pa.array(met), pa.array([node] * len(met), pa.int64()), pa.array([table_no] * len(met), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["class_key", "node", "table"])

    return run


def _compare(cosine: float):
    """Links in the blocks of buckets, as LinkRows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = LinkRows("class_key")
        for group in runs(batches, KEYS):
            if group.num_rows < 2:
                continue
            table_no, left, right, one, ids, _, marks = _group_of(group)
            copies = group.column("copies").to_numpy()
            vectors, labels = group.column("vector").to_pylist(), np.array(group.column("label").to_pylist(), object)
            dims = np.array([len(v) for v in vectors])
            for dim in set(dims.tolist()):
                a, b = left[dims[left] == dim], right[dims[right] == dim]
                if not len(a) or not len(b):
                    continue
                linked = unit([vectors[k] for k in a]) @ unit([vectors[k] for k in b]).T >= cosine
                p, q = np.nonzero(np.triu(linked, 1) if one else linked)
                p, q = a[p], b[q]
                real = _belong_here(p, q, marks, table_no) & (labels[p] == labels[q])
                out.add(ids, p[real], q[real], copies)
            yield from out.take(10_000)
        yield from out.take()

    return run


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Dealt to blocks of buckets; each block pair's rows side by side in one partition."""
    return deal(rows, "node", "size", "class_key", block).drop("size").repartition(*KEYS).sortWithinPartitions(*KEYS)


def _linked(classes: DataFrame, cosine: float, recall: float, width: float, seed: int, block: int) -> DataFrame:
    """LinkRows of the classes (class_key, label, vector, copies)."""
    most = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    hashes, tables = plan(most, cosine, recall, width)
    given = classes.select("class_key", F.xxhash64("label").alias("label_hash"), "vector")
    coded = cut(given.mapInArrow(_codes(tables, hashes, width, seed), "class_key long, nodes array<long>, marks binary"), "vector-codes")
    sizes = coded.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    large = cut(sizes.filter(F.col("size") > block), "large-buckets")
    rows = coded.select("class_key", "marks", F.posexplode("nodes").alias("table", "node"))
    if large.count() <= BROADCAST_BUCKETS:
        rows = rows.join(F.broadcast(large), "node", "left")
    else:
        rows = lookup(rows, large, "node", "size")
    likely = _in_blocks(rows.withColumn("size", F.coalesce("size", F.lit(1))), block).mapInArrow(
        _likely(likely_bits(cosine)),
        "class_key long, node long, table int",
    )
    likely = cut(likely.distinct(), "likely-vectors")
    counts = cut(likely.groupBy("node").agg(F.count(F.lit(1)).alias("size")), "likely-buckets")
    wanted = likely.select("class_key").distinct().join(classes, "class_key").join(coded.select("class_key", "marks"), "class_key")
    rows = lookup(likely, counts, "node", "size", "inner").join(wanted, "class_key")
    return cut(_in_blocks(rows, block).mapInArrow(_compare(cosine), LINKS), "vector-links")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", cosine: float = COSINE,
    recall: float = RECALL, width: float = WIDTH, seed: int = SEED, block: int = BLOCK,
) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) per row of ``vectors``; only equal labels are compared."""
    tune(vectors.sparkSession)
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    label = (F.col(label_col) if label_col else F.lit(0)).cast("string")
    rows = vectors.select(F.col(id_col).alias("vec_id"), label.alias("label"), F.when(fine & label.isNotNull(), v).alias("vector"))
    # 128 bits of label and vector
    key = F.struct(F.xxhash64("label", "vector").alias("a"), F.xxhash64(F.lit(seed), "vector", "label").alias("b"))
    ids = rows.select("vec_id", F.when(F.col("vector").isNotNull(), key).alias("key"))
    one = rows.filter(F.col("vector").isNotNull()).groupBy("label", "vector").agg(
        F.min("vec_id").alias("first"),
        F.count(F.lit(1)).alias("copies"),
    )
    # written at once, so the numbers never change
    classes = cut(
        one.select(F.monotonically_increasing_id().alias("class_key"), key.alias("key"), "label", "vector", "first", "copies"),
        "vector-classes",
    )
    found = _linked(classes.select("class_key", "label", "vector", "copies"), cosine, recall, width, seed, block)
    links = found.filter("other is null").groupBy("class_key").agg(F.sum("links").alias("links"))
    edges = found.filter("other is not null").select(F.col("class_key").alias("a"), F.col("other").alias("b"))
    joined = components(edges, "vector-edges").withColumnRenamed("node", "class_key").join(classes.select("class_key", "first"), "class_key")
    joined = cut(joined, "vectors-joined")
    groups = cut(joined.groupBy("component").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n")), "vector-groups")
    least = lookup(joined.select("class_key", "component"), groups, "component", "n", "inner").select("class_key", "least")
    of_class = classes.select("class_key", "key", "copies", "first").join(links, "class_key", "left").join(least, "class_key", "left")
    n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    of_class = cut(
        of_class.select("key", "copies", n_links.alias("n_links"), F.coalesce("least", "first").alias("component_id")),
        "vector-classes-linked",
    )
    out = lookup(ids, of_class, "key", "copies")
    component = F.coalesce("component_id", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(True))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: Brute force over all pairs of one label.
ORACLE_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), u AS (
  SELECT r, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v
  WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= {COSINE}
), reach AS (
  SELECT r AS root, r AS node FROM v UNION SELECT root, b FROM reach JOIN links ON node = a
), components AS (
  SELECT root, min(vec_id) AS component_id FROM reach JOIN v ON v.r = node GROUP BY root
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept
FROM v JOIN components ON root = v.r LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = v.r
"""
