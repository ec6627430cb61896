"""Set similarity join on word shingles by chosen paths (operator 5).

After Christiani, Pagh and Sivertsen's chosen-path join: a text's set of five-word
shingles becomes ``COORDINATES`` MinHash tokens, so that all sets have one size and
two sets share a coordinate with the probability of their Jaccard similarity. From
the root of a tree every node picks coordinates at random, 1 / threshold of them on
average, and sends a set to one child for each picked token; so a pair at the
threshold has one common child on average at any depth. A node with at most
``LEAF`` sets is a leaf; larger ones are split again, down to ``DEPTH`` levels, and
what is still large there is compared in blocks (see ``blocks``): no bucket is cut.
The run is repeated on as many independent trees as ``RECALL`` asks for (``repeats_for``).

Steps
    1. signatures; exact copies (equal word sequences) collapse into a class, which
       has a number of its own: ids may repeat, so they name no class;
    2. paths, level by level, counting each node with a map-side sum;
    3. in leaves, pairs of classes whose signatures agree in as many coordinates as
       pairs at the threshold do, less five standard errors, are likely pairs. A pair
       belongs to the smallest leaf that its two classes share;
    4. the classes of likely pairs meet again in the leaf that the pair belongs to,
       with the shingles' 64-bit hashes of their whole texts, and are compared exactly.
       Links are counted where they are found.
No pair is ever a row: tasks return, per class, its number of links and what they join.

Result per document: class_id, the smallest doc_id it is linked with directly or
through others; n_links, the documents at or above the threshold with it, copies
included; kept, for one document of each class (the smallest by id and content).

Edge cases: texts without words (null, empty, only signs) have no shingles, are
alone and kept; texts of one to four words are one shingle; very long texts are
hashed whole. Rows are the documents: rows that repeat an id are compared like
others, each with its own text, and link if their texts do; of rows that agree in id
and text none is smaller, so all or none of them are kept. A null id is larger than
any other, and the class_id of a class without ids is null. Ids are whole numbers;
other ids are an error. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import LinkRows, deal, runs
from .common import components, cut, drop, lookup, table, tune
from .shingles import WIDTH, mix, shingle_set, signatures, words

THRESHOLD = 0.8
COORDINATES = 128
#: Share of the pairs at the threshold that are found at least, levels of a tree, sets in a leaf.
RECALL, DEPTH, LEAF = 0.99, 3, 1000
#: Rows of a block: of signatures, and of whole shingle sets.
BLOCK, SET_BLOCK = 1000, 256
#: Classes of likely pairs are broadcast to the texts up to this many (about 200 bytes each), and joined by shuffle beyond.
BROADCAST_CLASSES = 300_000
LINKS = "class_key long, other long, links long"


def repeats_for(recall: float, depth: int) -> int:
    """Trees that find a pair at the threshold with probability ``recall``, even if all its nodes are split ``depth`` times.

    Such a pair has a number of common children with mean 1 (Poisson, nearly), so it
    survives k + 1 levels with probability 1 - exp(-p), p being that of k levels.
    """
    p = 1 - math.exp(-1)
    for _ in range(depth - 1):
        p = 1 - math.exp(-p)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def likely_coordinates(threshold: float) -> int:
    """Equal coordinates from which a pair is looked at: five standard errors below the threshold."""
    error = math.sqrt(threshold * (1 - threshold) / COORDINATES)
    return max(1, math.floor((threshold - 5 * error) * COORDINATES))


def row_key(doc_id: Column, text: Column) -> Column:
    """What names a document: its id and its text."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("-")), text))


def _picks(nodes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, coordinate, salt) of the coordinates that nodes pick."""
    share = np.uint64(min(2**64 - 1, int(2**64 / (threshold * COORDINATES))))
    drawn = mix(nodes[:, None] ^ mix(np.arange(1, COORDINATES + 1, dtype=np.uint64))[None, :])
    row, at = np.nonzero(drawn < share)
    return row, at, mix(drawn[row, at])


def _sign(width: int, threshold: float, repeats: int):
    """Per text: a digest of its words, 16 and 8 bits of its coordinates, and its nodes on the trees' first level."""
    # all texts draw the same coordinates at a root; here they take part with all 32 bits
    _, at, salt = _picks(mix(np.arange(1, repeats + 1, dtype=np.uint64)), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [words(t) for t in batch.column(2).to_pylist()]
            digests = [_digest(t) for t in texts]
            sig = signatures([shingle_set(t, width) for t in texts], COORDINATES)
            child = mix(salt[None, :] ^ sig[:, at].astype(np.uint64)).view(np.int64)
            columns = [
                pa.array(digests, pa.string()), _rows(sig.astype(np.uint16)), _rows(sig.astype(np.uint8)),
                pa.array(list(child), pa.list_(pa.int64())),
            ]
            names = ["doc_id", "row_key", "digest", "sig", "sketch", "nodes"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    return run


def _digest(tokens: list[str]) -> str | None:
    return hashlib.md5(" ".join(tokens).encode("utf-8", "surrogatepass")).hexdigest() if tokens else None


def _rows(matrix: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in matrix], pa.binary())


def _split(threshold: float):
    """Rows (node, class_key) of the children of rows (class_key, sig, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, COORDINATES)
                row, at, salt = _picks(batch.column(2).to_numpy().view(np.uint64), threshold)
                child = mix(salt ^ sig[row, at].astype(np.uint64)).view(np.int64)
                keys = batch.column(0).to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(keys)], names=["node", "class_key"])

    return run


def leaves(signed: DataFrame, threshold: float, depth: int, leaf: int) -> DataFrame:
    """(node, class_key, size) of the trees' leaves with two classes or more; ``signed`` is (class_key, sig, nodes)."""
    rows = cut(signed.select(F.explode("nodes").alias("node"), "class_key"), "paths")
    out = None
    for level in range(1, depth + 1):
        sizes = cut(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "path-sizes")
        found = cut(lookup(rows, sizes, "node", "size", "inner").distinct(), "path-nodes")
        drop(rows, sizes)
        large = found.filter(F.col("size") > leaf)
        last = level == depth or large.isEmpty()
        done = found if last else found.filter(F.col("size") <= leaf)
        out = done if out is None else out.unionByName(done)
        if last:
            break
        wide = large.join(signed.select("class_key", "sig"), "class_key").select("class_key", "sig", "node")
        rows = cut(wide.mapInArrow(_split(threshold), "node long, class_key long"), "paths")
    return out


def _belong_here(p: np.ndarray, q: np.ndarray, leaf_lists: list[list[int]], node: int) -> np.ndarray:
    """Which pairs (p, q) share no leaf before ``node``."""
    rows = np.union1d(p, q)
    before = {k: {x for x in leaf_lists[k] if x < node} for k in rows.tolist()}
    if len(p) <= 64:
        return np.fromiter((before[a].isdisjoint(before[b]) for a, b in zip(p.tolist(), q.tolist(), strict=True)), bool, len(p))
    # many pairs: leaves that two rows or more have, as columns of a 0/1 matrix
    times = Counter(x for v in before.values() for x in v)
    column = {x: i for i, x in enumerate(x for x, n in times.items() if n > 1)}
    at = np.zeros(rows[-1] + 1, np.int64)
    at[rows] = np.arange(len(rows))
    out = np.ones(len(p), bool)
    for start in range(0, len(column), 2048):
        has = np.zeros((len(rows), min(2048, len(column) - start)), np.float32)
        for i, k in enumerate(rows.tolist()):
            has[i, [c - start for x in before[k] if start <= (c := column.get(x, -1)) < start + 2048]] = 1
        out &= (has @ has.T)[at[p], at[q]] == 0
    return out


def _likely(least: int):
    """(class_key, node) of classes in a likely pair that belongs to the leaf ``node``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["node", "block_i", "block_j"]):
            if group.num_rows < 2:
                continue
            ids, own = group.column("class_key").to_numpy(), group.column("own").to_numpy()
            sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
            node, i, j = (group.column(c)[0].as_py() for c in ("node", "block_i", "block_j"))
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            p, q = [], []
            for k, x in enumerate(left):
                other = right[k + 1 :] if i == j else right
                near = other[np.count_nonzero(sketch[other] == sketch[x], axis=1) >= least]
                p.append(np.full(len(near), x))
                q.append(near)
            p, q = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (p, q))
            if len(p):
                here = _belong_here(p, q, group.column("leaves").to_pylist(), node)
                found = ids[np.union1d(p[here], q[here])]
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([node] * len(found), pa.int64())], names=["class_key", "node"])

    return run


def _shingle(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(words(t), width).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], names=["class_key", "copies", "leaves", "shingles"])

    return run


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, as products of 0/1 matrices over 2048 tokens at a time."""
    tokens, inverse = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    lengths = np.array([len(s) for s in (*left, *right)])
    row = np.repeat(np.arange(len(lengths)), lengths)
    both = np.zeros(len(tokens), np.int8)
    both[inverse[row < len(left)]] |= 1
    both[inverse[row >= len(left)]] |= 2
    number = np.cumsum(both == 3) - 1
    keep = both[inverse] == 3
    row, col = row[keep], number[inverse[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(left), len(right)), np.float32)
    total = int(number[-1]) + 1 if len(number) else 0
    for start in range(0, total, 2048):
        s = slice(*np.searchsorted(col, [start, start + 2048]))
        m = np.zeros((len(lengths), min(2048, total - start)), np.float32)
        m[row[s], col[s] - start] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _verify(threshold: float):
    """Links of the blocks of leaves, as LinkRows; a pair counts in the leaf that it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = LinkRows("class_key")
        for group in runs(batches, ["node", "block_i", "block_j"]):
            if group.num_rows < 2:
                continue
            ids, own, copies = (group.column(c).to_numpy() for c in ("class_key", "own", "copies"))
            node, i, j = (group.column(c)[0].as_py() for c in ("node", "block_i", "block_j"))
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if not len(left) or not len(right):
                continue
            sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
            n = np.array([len(s) for s in sets], np.float64)
            inter = intersections([sets[k] for k in left], [sets[k] for k in right]).astype(np.float64)
            linked = inter >= threshold * (n[left][:, None] + n[right][None, :] - inter) - 1e-9
            if i == j:
                linked = np.triu(linked, 1)
            p, q = np.nonzero(linked)
            p, q = left[p], right[q]
            here = _belong_here(p, q, group.column("leaves").to_pylist(), node)
            out.add(ids, p[here], q[here], copies)
            yield from out.take(10_000)
        yield from out.take()

    return run


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Dealt to blocks of leaves; each block pair's rows side by side in one partition."""
    keys = ["node", "block_i", "block_j"]
    return deal(rows, "node", "size", "class_key", block).drop("size").repartition(*keys).sortWithinPartitions(*keys)


def _classes(signed: DataFrame) -> DataFrame:
    """One row per word sequence: class_key, digest, first (its smallest document), copies, and the signature's columns."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    same = [F.first(c).alias(c) for c in ("sig", "sketch", "nodes")]  # equal in all rows of a digest
    one = signed.filter("digest is not null").groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("copies"), *same)
    # written at once, so the numbers never change
    return cut(one.withColumn("class_key", F.monotonically_increasing_id()), "text-classes")


def _linked(classes: DataFrame, texts: DataFrame, threshold: float, width: int, depth: int, leaf: int, block: int, set_block: int) -> DataFrame:
    """LinkRows of the classes."""
    members = leaves(classes.select("class_key", "sig", "nodes"), threshold, depth, leaf)
    per_class = members.groupBy("class_key").agg(F.collect_list(F.struct("node", "size")).alias("in"))
    per_class = per_class.join(classes.select("class_key", "sketch", "copies", "first.row_key"), "class_key")
    per_class = cut(per_class.withColumn("leaves", F.col("in")["node"]), "class-leaves")
    met = per_class.select("class_key", "sketch", "leaves", F.explode("in").alias("m")).select("*", "m.node", "m.size").drop("m")
    likely = _in_blocks(met, block).select("node", "block_i", "block_j", "class_key", "own", "sketch", "leaves")
    likely = cut(likely.mapInArrow(_likely(likely_coordinates(threshold)), "class_key long, node long").distinct(), "likely")
    sizes = cut(likely.groupBy("node").agg(F.count(F.lit(1)).alias("size")), "likely-sizes")
    wanted = likely.select("class_key").distinct().join(per_class.select("class_key", "row_key", "copies", "leaves"), "class_key")
    wanted = cut(wanted, "likely-classes")
    near = F.broadcast(wanted) if wanted.count() <= BROADCAST_CLASSES else wanted
    own_text = texts.join(near, "row_key").select("class_key", "copies", "leaves", "text")
    sets = own_text.mapInArrow(_shingle(width), "class_key long, copies long, leaves array<long>, shingles binary")
    rows = lookup(likely, sizes, "node", "size", "inner").join(cut(sets.dropDuplicates(["class_key"]), "likely-sets"), "class_key")
    return cut(_in_blocks(rows, set_block).mapInArrow(_verify(threshold), LINKS), "links")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = WIDTH,
    recall: float = RECALL, depth: int = DEPTH, leaf: int = LEAF, block: int = BLOCK, set_block: int = SET_BLOCK,
) -> DataFrame:
    """One row (doc_id, class_id, n_links, kept, row_key) per document; see the module."""
    tune(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))
    made = "doc_id long, row_key string, digest string, sig binary, sketch binary, nodes array<long>"
    sign = _sign(width, threshold, repeats_for(recall, depth))
    signed = cut(texts.select("doc_id", "row_key", "text").mapInArrow(sign, made), "signatures")
    classes = _classes(signed)
    found = _linked(classes, texts, threshold, width, depth, leaf, block, set_block)
    links = found.filter("other is null").groupBy("class_key").agg(F.sum("links").alias("links"))
    edges = found.filter("other is not null").select(F.col("class_key").alias("a"), F.col("other").alias("b"))
    joined = cut(
        components(edges, "linked").withColumnRenamed("node", "class_key").join(classes.select("class_key", "first"), "class_key"),
        "joined",
    )
    groups = cut(joined.groupBy("component").agg(F.min("first").alias("leader"), F.count(F.lit(1)).alias("n")), "groups")
    leaders = lookup(joined.select("class_key", "component"), groups, "component", "n", "inner").select("class_key", "leader")
    per_class = classes.select("class_key", "digest", "first", "copies").join(links, "class_key", "left").join(leaders, "class_key", "left")
    n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    per_class = cut(per_class.select("digest", "copies", n_links.alias("n_links"), F.coalesce("leader", "first").alias("leader")), "classes-linked")
    out = lookup(signed.select("doc_id", "row_key", "digest"), per_class, "digest", "copies")
    alone = F.col("leader").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("leader.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.col("row_key") == F.col("leader.row_key"))).alias("kept"), "row_key",
    )


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``found``, the result of near_duplicates(), keeps; of rows that agree in id and text the first by their other columns."""
    columns = [F.col(c) for c in docs.columns]
    keep = cut(found.groupBy("row_key").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n")).filter("kept"), "kept-documents")
    keyed = docs.select(row_key(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("_key"), F.struct(*columns).alias("_row"))
    rows = keyed.join(keep.select(F.col("row_key").alias("_key"), "n"), "_key")
    again = rows.filter("n > 1").groupBy("_key").agg(F.min("_row").alias("_row"))
    return rows.filter("n = 1").select("_row.*").unionByName(again.select("_row.*"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row_key")


ORACLE_SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i : i + {WIDTH - 1}], ' ') AS shingle
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - {WIDTH - 2}, 2))) AS i) t WHERE len(w) > 0
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), met AS (
  SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.r <> b.r GROUP BY 1, 2
), links AS (
  SELECT a, b FROM met JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE k >= {THRESHOLD} * (x.n + y.n - k) - 1e-9
), reach AS (
  SELECT r AS root, r AS node FROM w UNION SELECT root, b FROM reach JOIN links ON node = a
), classes AS (
  SELECT root, min(doc_id) AS class_id, arg_min(node, d.doc_id) AS leader FROM reach JOIN w d ON d.r = node GROUP BY root
)
SELECT w.doc_id, class_id, coalesce(l.n, 0) AS n_links, w.r = leader AS kept
FROM w JOIN classes ON root = w.r LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = w.r
"""
