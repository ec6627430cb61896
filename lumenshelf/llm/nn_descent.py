"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search (operator 11).

Nodes are the distinct vectors. A vector x is given one more coordinate so that all have
the same length M, that of the longest: the order of inner products with a query is then the
order of distances, and near nodes have near neighbours, as NN-descent needs.

Index (``build``)
    1. each of ``trees`` sortings by the sides of random hyperplanes is cut into blocks of
       BLOCK successive nodes, and a block's nodes meet as one matrix: the first graph, with
       the ``k`` best of each node. Sortings are range partitions, so equal sides, however
       many, spread over tasks.
    2. rounds of NN-descent: every node picks at most SAMPLE new and SAMPLE old
       neighbours; picks go to both ends, a join fetches vectors, and at each node those
       that it picked and that picked it are compared with each other (neighbours of
       neighbours), except old with old. Pairs that beat the k-th neighbour of either
       are merged into the lists. It ends when a round changes at most ``delta`` of all
       entries. A pick is dealt at most HUB times from one block of lists, so a node that
       many have as neighbour is no hot key.
    3. each node's list with its neighbours' vectors is written in buckets by node.
Search (``search``): a query's beam holds the best nodes seen. It starts with the
    START best of ENTRIES nodes (fixed numbers; the entries are the smallest by hash, and
    their vectors go to all tasks) and the query's own node, if it has one; so a table of
    up to START nodes is searched whole. Each round expands the best
    EXPAND nodes of the beam not yet expanded, by a join with the bucketed lists, until
    nothing in the beam is left to expand.
Then exact inner products of the original vectors decide in double precision. During
search, vectors are 16-bit fixed-point numbers with a scale each; all nodes are kept
that their rounding could bring among the ``top``. A vector thousands of times longer than
the others leaves them few of the 16 bits, and recall falls; the scores stay exact.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite numbers take
no part; vectors of different lengths never meet; rows with equal vectors are one node
and all appear as candidates, the query's own row excepted; rows that repeat an id
are candidates and queries each by itself; null ids come last among equal scores and
are no queries; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import new_folder
from .common import cut, drop, lookup, remove, shuffle_parts, table, tune

K, SAMPLE, HUB = 40, 16, 64
TREES, BLOCK, SIDES = 8, 256, 24
ROUNDS, DELTA, SEED = 12, 0.1, 20240
ENTRIES, START, BEAM, EXPAND = 512, 96, 192, 48
TOP = 20
#: Rows of sorted input that a task works on at once, rounded up to whole groups.
CHUNK = 1 << 15
#: Candidate pairs that a task holds before it passes on the best of each node (16 bytes each, and their sorting).
PAIRS = 1 << 21
#: Flags of a list's entry: not yet picked; picked now as new, as old.
FRESH, NEW, OLD = 1, 2, 4
#: Flags of a beam's entry: seen, expanded, to be expanded now.
SEEN, DONE, NEXT = 0, 1, 2

LISTS = "node long, vec binary, nbrs array<long>, sims array<float>, flags array<tinyint>"
GRAPH = f"{LISTS}, kth float, added long"
STATE = "query long, vec binary, nbrs array<long>, sims array<float>, flags array<tinyint>, open int"


# vectors in tasks
def encoded(x: np.ndarray) -> list[bytes]:
    """Rows as a scale (32-bit float) and 16-bit fixed-point numbers."""
    scale = np.abs(x).max(1, keepdims=True).astype("<f4")
    whole = np.rint(x / scale * 32767).astype("<i2")
    return [a.tobytes() + b.tobytes() for a, b in zip(scale, whole, strict=True)]


def decoded(rows: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    scale = np.ascontiguousarray(raw[:, :4]).view("<f4")
    return np.ascontiguousarray(raw[:, 4:]).view("<i2").astype(np.float32) * (scale / np.float32(32767))


def by_length(rows: list) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of rows of equal length."""
    size = np.array([len(r) for r in rows], np.int64)
    for n in np.unique(size).tolist():
        yield n, np.flatnonzero(size == n)


def chunked(batches: Iterator[pa.RecordBatch], least: int = CHUNK) -> Iterator[pa.Table]:
    """Rows sorted by the first column, in tables of whole groups of at least ``least`` rows."""
    held, count, wanted = [], 0, least
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < wanted:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column(0).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield whole.slice(0, last)
            held, wanted = whole.slice(last).to_batches(), least
            count = whole.num_rows - last
        else:
            wanted = 2 * count
    if held:
        yield pa.Table.from_batches(held)


def flat(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a column of lists; null is empty."""
    col = t.column(name).combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind))


def places(keys: np.ndarray) -> np.ndarray:
    """Each row's place among rows of its key, in sorted keys."""
    if not len(keys):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))


def best(u: np.ndarray, v: np.ndarray, s: np.ndarray, state: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of each u the k largest s, largest first; of a v that repeats the smallest state counts."""
    order = np.lexsort((state, v, u))
    u, v, s, state = u[order], v[order], s[order], state[order]
    once = np.ones(len(u), bool)
    once[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    u, v, s, state = u[once], v[once], s[once], state[once]
    order = np.lexsort((v, -s, u))
    u, v, s, state = u[order], v[order], s[order], state[order]
    top = places(u) < k
    return u[top], v[top], s[top], state[top]


def mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A number for each pair that looks random and is the same on every run."""
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) + np.uint64(salt + 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


# index
def _coded(longest: float, biggest: float, trees: int, seed: int):
    """(node, dim, vec, sides): nodes with one more coordinate and length one; the sides of hyperplanes as one number per tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(SIDES - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            vecs, sides = [b""] * len(rows), np.zeros((len(rows), trees), np.int64)
            for dim, at in by_length(rows):
                x = np.array([rows[i] for i in at], float) / biggest
                more = np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))
                x = np.hstack([x, more[:, None]]) / longest
                planes = np.random.default_rng([seed, dim]).standard_normal((trees, dim + 1, SIDES))
                for t in range(trees):
                    sides[at, t] = (x @ planes[t] > 0) @ weights
                for i, raw in zip(at.tolist(), encoded(x), strict=True):
                    vecs[i] = raw
            columns = [batch.column(0), pa.array([len(v) for v in rows], pa.int32()), pa.array(vecs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, lists(sides.ravel(), np.full(len(rows), trees), pa.int64())], names=["node", "dim", "vec", "sides"])

    return run


def _candidates(u: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> pa.RecordBatch:
    """One row per u with its k best."""
    u, v, s, _ = best(u, v, s, np.zeros(len(u), np.int8), k)
    nodes, counts = np.unique(u, return_counts=True)
    columns = [pa.array(nodes, pa.int64()), pa.nulls(len(nodes), pa.binary()), lists(v, counts, pa.int64()), lists(s, counts, pa.float32()), pa.nulls(len(nodes), pa.list_(pa.int8()))]
    return pa.RecordBatch.from_arrays(columns, names=["node", "vec", "nbrs", "sims", "flags"])


def _blocks(k: int, block: int):
    """Candidates of rows (tree, dim, node, vec): successive nodes of one tree meet."""

    def meet(held: pa.Table) -> pa.RecordBatch:
        node, x = held.column("node").to_numpy(), decoded(held.column("vec").to_pylist())
        sims = x @ x.T
        np.fill_diagonal(sims, -9)
        few = min(k, len(node) - 1)
        near = np.argpartition(-sims, few - 1, axis=1)[:, :few]
        return _candidates(np.repeat(node, few), node[near].ravel(), np.take_along_axis(sims, near, 1).ravel(), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            for at, end in zip(cuts := [0, *(np.flatnonzero(np.diff(of)) + 1).tolist()], [*cuts[1:], batch.num_rows], strict=True):
                if held and (held[0].column(0)[0], held[0].column(1)[0]) != (batch.column(0)[at], batch.column(1)[at]):
                    if sum(h.num_rows for h in held) > 1:
                        yield meet(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(at, end - at))
                if sum(h.num_rows for h in held) >= block:
                    yield meet(pa.Table.from_batches(held))
                    held = []
        if sum(h.num_rows for h in held) > 1:
            yield meet(pa.Table.from_batches(held))

    return run


def _merged(k: int, sample: int, number: int):
    """Lists and candidates of nodes, sorted by node, to the graph's rows with the picks of the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunked(batches):
            key = t.column("node").to_numpy()
            own = ~t.column("vec").is_null().to_numpy(zero_copy_only=False)
            v, size = flat(t, "nbrs")
            s, u, mine = flat(t, "sims")[0], np.repeat(key, size), np.repeat(own, size)
            state = np.full(len(u), 2, np.int8)  # from a candidate
            state[mine] = flat(t, "flags")[0] & FRESH
            u, v, s, state = best(u, v, s, state, k)
            flags = np.where(state > 0, FRESH, 0).astype(np.int8)
            for kind, of in ((NEW, flags == FRESH), (OLD, flags == 0)):
                at = np.flatnonzero(of)
                at = at[np.lexsort((mixed(u[at], v[at], number), u[at]))]
                at = at[places(u[at]) < sample]
                at = at[np.lexsort((mixed(u[at], v[at], number), v[at]))]
                flags[at[places(v[at]) < HUB]] = kind
            nodes = key[own]
            first, end = np.searchsorted(u, nodes), np.searchsorted(u, nodes, "right")
            full = end - first == k
            kth = np.full(len(nodes), -9, np.float32)
            kth[full] = s[end[full] - 1]
            added = np.add.reduceat(np.append(state == 2, 0), first) * (end > first) if len(nodes) else np.zeros(0)
            columns = [
                pa.array(nodes, pa.int64()), t.column("vec").combine_chunks().filter(pa.array(own)), lists(v, end - first, pa.int64()),
                lists(s, end - first, pa.float32()), lists(flags, end - first, pa.int8()), pa.array(kth), pa.array(added, pa.int64()),
            ]
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "vec", "nbrs", "sims", "flags", "kth", "added"])

    return run


def _met(k: int, sample: int, number: int):
    """Candidates from rows (at, member, new, vec, kth) sorted by ``at``: the members of a place meet, except old with old."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for t in chunked(batches):
            at, member, new, kth = (t.column(c).to_numpy() for c in ("at", "member", "new", "kth"))
            raw = t.column("vec").to_pylist()
            order = np.lexsort((mixed(member, at, number), ~new, at))
            # not more than thrice a node's picks of either kind, which only a hub has
            kinds = at[order] * 2 + ~new[order]
            order = order[places(kinds) < 3 * sample]
            for _, rows in by_length([raw[i] for i in order]):
                rows = order[rows]
                x, a, ids, is_new, least = decoded([raw[i] for i in rows]), at[rows], member[rows], new[rows], kth[rows]
                first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                for i, j in zip(first.tolist(), np.append(first[1:], len(a)).tolist(), strict=True):
                    if j - i < 2 or not is_new[i]:  # new ones come first
                        continue
                    sims = x[i:j] @ x[i:j].T
                    hit = (sims > least[i:j, None]) & (is_new[i:j, None] | is_new[None, i:j]) & (ids[i:j, None] != ids[None, i:j])
                    p, q = np.nonzero(hit)
                    found.append((ids[i + p], ids[i + q], sims[p, q]))
            if sum(len(f[0]) for f in found) >= PAIRS:
                yield _candidates(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
                found = []
        if found:
            yield _candidates(*(np.concatenate(c) for c in zip(*found, strict=True)), k)

    return run


def _by_node(rows: DataFrame, key: str = "node") -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key)


def graph(coded: DataFrame, k: int = K, sample: int = SAMPLE, block: int = BLOCK, rounds: int = ROUNDS, delta: float = DELTA) -> DataFrame:
    """The neighbour graph of nodes (node, dim, vec, sides): rows of GRAPH, a cut() table."""
    spark = coded.sparkSession
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    bare = coded.select("node", "vec", none("nbrs", "array<long>"), none("sims", "array<float>"), none("flags", "array<tinyint>"))
    order = ["tree", "dim", "side", "mix"]
    sorted_ = coded.select("dim", "node", "vec", F.posexplode("sides").alias("tree", "side")).withColumn("mix", F.xxhash64("node", "tree"))
    sorted_ = sorted_.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order).select("tree", "dim", "node", "vec")
    found = sorted_.mapInArrow(_blocks(k, block), LISTS)
    now = cut(_by_node(bare.unionByName(found)).mapInArrow(_merged(k, sample, 0), GRAPH), "neighbours")
    for number in range(1, rounds + 1):
        picked = now.select("node", "vec", "kth", F.explode(F.arrays_zip("nbrs", "flags")).alias("e")).filter(F.col("e.flags") >= NEW)
        picked = picked.select("node", "vec", "kth", F.col("e.nbrs").alias("other"), (F.col("e.flags") == NEW).alias("new"))
        there = picked.select(F.col("other").alias("at"), F.col("node").alias("member"), "new", "vec", "kth")
        here = picked.select(F.col("node").alias("at"), F.col("other").alias("member"), "new")
        here = here.join(now.select(F.col("node").alias("member"), "vec", "kth"), "member").select("at", "member", "new", "vec", "kth")
        found = _by_node(there.unionByName(here), "at").mapInArrow(_met(k, sample, number), LISTS)
        mine = now.select("node", "vec", "nbrs", "sims", "flags")
        after = cut(_by_node(mine.unionByName(found)).mapInArrow(_merged(k, sample, number), GRAPH), "neighbours")
        drop(now)
        now = after
        added, entries = now.agg(F.coalesce(F.sum("added"), F.lit(0)), F.coalesce(F.sum(F.size("nbrs")), F.lit(0))).first()
        if added <= delta * entries:
            break
    return now


class Index:
    """Nodes (node, vector, members), entry nodes, and the lists with their neighbours' vectors, in buckets by node."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, lists_: DataFrame, longest: float):
        self.spark, self.nodes, self.longest = spark, nodes, longest
        smallest = lists_.select("node", "vec").orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(ENTRIES).collect()
        self.entries = [(r["node"], bytes(r["vec"])) for r in smallest]
        pairs = lists_.select("node", F.explode("nbrs").alias("other"))
        near = pairs.join(lists_.select(F.col("node").alias("other"), "vec"), "other").select("node", "other", "vec")
        self.path, self.name = new_folder(spark, "near-vectors"), f"near_{uuid.uuid4().hex}"
        rows = _by_node(near).mapInArrow(_gathered, "node long, nbrs array<long>, vecs array<binary>")
        n = shuffle_parts(spark)
        rows.repartition(n, "node").write.bucketBy(n, "node").option("path", self.path).format("parquet").saveAsTable(self.name)

    def near(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in chunked(batches, CHUNK // 4):
        nodes, counts = np.unique(t.column("node").to_numpy(), return_counts=True)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        vecs = t.column("vec").combine_chunks()
        yield pa.RecordBatch.from_arrays([pa.array(nodes), lists(t.column("other").to_numpy(), counts, pa.int64()), pa.ListArray.from_arrays(offsets, vecs.chunk(0) if isinstance(vecs, pa.ChunkedArray) else vecs)], names=["node", "nbrs", "vecs"])


# search
def _beams(keys: np.ndarray, vecs: pa.Array, u: np.ndarray, v: np.ndarray, s: np.ndarray, state: np.ndarray, beam: int, expand: int) -> pa.RecordBatch:
    """States of the queries ``keys`` (sorted) from what they have seen; the best that are not expanded come next."""
    # an expanded entry that is seen again stays expanded
    u, v, s, seen = best(u, v, s, (state != DONE).astype(np.int8), beam)
    flags = np.where(seen > 0, SEEN, DONE).astype(np.int8)
    at = np.flatnonzero(flags == SEEN)
    flags[at[places(u[at]) < expand]] = NEXT
    size = np.searchsorted(u, keys, "right") - np.searchsorted(u, keys)
    open_ = np.bincount(np.repeat(np.arange(len(keys)), size), flags == NEXT, len(keys))
    columns = [pa.array(keys, pa.int64()), vecs, lists(v, size, pa.int64()), lists(s, size, pa.float32()), lists(flags, size, pa.int8()), pa.array(open_.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["query", "vec", "nbrs", "sims", "flags", "open"])


def _begun(entries: list[tuple[int, bytes]], start: int, beam: int, expand: int):
    """First states of queries (query, vector, node): the best entry nodes and the own node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, raw = np.array([e[0] for e in entries], np.int64), [e[1] for e in entries]
        known = {n: (nodes[at], decoded([raw[i] for i in at])) for n, at in by_length(raw)}
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, rows, own = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            vecs, seen = [b""] * len(rows), []
            for dim, at in by_length(rows):
                x = np.array([rows[i] for i in at], float)
                x /= np.abs(x).max(1, keepdims=True)
                x = np.hstack([x / np.sqrt((x * x).sum(1, keepdims=True)), np.zeros((len(x), 1))]).astype("<f4")
                for i, q in zip(at.tolist(), x, strict=True):
                    vecs[i] = q.tobytes()
                    if own[i] is not None:
                        seen.append((keys[i : i + 1], np.array([own[i]]), np.ones(1, np.float32)))
                ids, y = known.get(4 + 2 * (dim + 1), (np.zeros(0, np.int64), np.zeros((0, dim + 1), np.float32)))
                sims = x @ y.T
                few = min(start, len(ids))
                near = np.argsort(-sims, axis=1, kind="stable")[:, :few]
                seen.append((np.repeat(keys[at], few), ids[near].ravel(), np.take_along_axis(sims, near, 1).ravel()))
            u, v, s = (np.concatenate(c) for c in zip(*seen, strict=True))
            order = np.argsort(keys)
            yield _beams(keys[order], pa.array([vecs[i] for i in order], pa.binary()), u, v, s, np.full(len(u), SEEN), beam, expand)

    return run


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, vec: null, nbrs, sims, flags, open: null) of rows (query, vec, nbrs, vecs): a node's neighbours as a query sees them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        size, queries = flat(t, "nbrs")[1], batch.column(1).to_pylist()
        raw, sims = t.column("vecs").combine_chunks(), np.zeros(int(size.sum()), np.float32)
        raw = (raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw).flatten().to_pylist()
        at = np.concatenate([[0], np.cumsum(size)])
        for _, rows in by_length(queries):
            places_ = np.concatenate([np.arange(at[i], at[i + 1]) for i in rows])
            if len(places_):
                q = np.frombuffer(b"".join(queries[i] for i in rows), "<f4").reshape(len(rows), -1)
                sims[places_] = np.einsum("ij,ij->i", decoded([raw[i] for i in places_]), np.repeat(q, size[rows], axis=0))
        flags = lists(np.full(len(sims), SEEN, np.int8), size, pa.int8())
        columns = [batch.column(0), pa.nulls(batch.num_rows, pa.binary()), lists(flat(t, "nbrs")[0], size, pa.int64()), lists(sims, size, pa.float32()), flags, pa.nulls(batch.num_rows, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["query", "vec", "nbrs", "sims", "flags", "open"])


def _advanced(beam: int, expand: int):
    """New states from states and what their next nodes showed, sorted by query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunked(batches, CHUNK // 16):
            key = t.column("query").to_numpy()
            own = ~t.column("vec").is_null().to_numpy(zero_copy_only=False)
            v, size = flat(t, "nbrs")
            state = flat(t, "flags")[0].copy()
            state[state == NEXT] = DONE
            vecs = t.column("vec").combine_chunks().filter(pa.array(own))
            yield _beams(key[own], vecs.combine_chunks() if isinstance(vecs, pa.ChunkedArray) else vecs, np.repeat(key, size), v, flat(t, "sims")[0], state, beam, expand)

    return run


def _near_enough(top: int):
    """(query, node) of a beam's nodes that may be among the query's ``top`` others, for all that rounding can do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            (v, size), s = flat(t, "nbrs"), flat(t, "sims")[0]
            dim = np.repeat(np.array([len(q) // 4 for q in batch.column(1).to_pylist()], np.int64), size)
            place = places(np.repeat(np.arange(len(size)), size))
            # the rounding of 16-bit numbers and of sums of 32-bit floats, either way
            slack = 2 * (np.sqrt(dim) / 65534 + dim * 2.0**-23)
            # largest first; the query itself may be one of them
            least = np.full(len(size), -np.inf)
            at = np.flatnonzero(place == top)
            owner = np.repeat(np.arange(len(size)), size)
            least[owner[at]] = s[at]
            keep = s >= least[owner] - slack
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), size)[keep]), pa.array(v[keep])], names=["query", "node"])

    return run


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact inner products of rows (query, node, a, b), in double precision."""
    for batch in batches:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        out = np.zeros(len(a))
        for _, at in by_length(a):
            out[at] = np.einsum("ij,ij->i", np.array([a[i] for i in at], float), np.array([b[i] for i in at], float))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["query", "node", "score"])


def search(index: Index, queries: DataFrame, top: int = TOP, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """(query, node, score) of nodes near to queries (query: unique long; vector: array of double; node: its own or null), ``top`` and one more at least."""
    vectors = queries.select("query", "vector")
    state = cut(queries.select("query", "vector", "node").mapInArrow(_begun(index.entries, START, beam, expand), STATE), "beams")
    while True:
        going = state.filter("open > 0")  # queries with nodes to expand
        if going.isEmpty():
            break
        ahead = going.select("query", "vec", F.explode(F.filter(F.arrays_zip("nbrs", "flags"), lambda e: e["flags"] == NEXT)).alias("e"))
        ahead = ahead.select(F.col("e.nbrs").alias("node"), "query", "vec")
        shown = ahead.hint("shuffle_hash").join(index.near(), "node").select("query", "vec", "nbrs", "vecs").mapInArrow(_expanded, STATE)
        after = cut(_by_node(state.unionByName(shown), "query").mapInArrow(_advanced(beam, expand), STATE), "beams")
        drop(state)
        state = after
    likely = state.select("query", "vec", "nbrs", "sims").mapInArrow(_near_enough(top), "query long, node long")
    likely = likely.join(vectors.withColumnRenamed("vector", "a"), "query").join(index.nodes.select("node", F.col("vector").alias("b")), "node")
    found = cut(likely.select("query", "node", "a", "b").mapInArrow(_scores, "query long, node long, score double"), "near-nodes")
    drop(state)
    return found


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, k: int = K, trees: int = TREES, rounds: int = ROUNDS, beam: int = BEAM, seed: int = SEED, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest other rows of each row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    tune(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), is_query.alias("asks"), F.col(vector_col).cast("array<double>").alias("vector")).filter(_usable(F.col("vector")))
    key = F.struct(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(seed), "vector").alias("b"))
    one = rows.groupBy("vector").agg(F.count(F.lit(1)).alias("copies"))
    # written at once, so the numbers never change
    nodes = cut(one.select(F.monotonically_increasing_id().alias("node"), key.alias("key"), "vector", "copies"), "vector-nodes")
    placed = lookup(rows.select("vec_id", "asks", key.alias("key")), nodes.select("key", "node", "copies"), "key", "copies", "inner")
    placed = cut(placed.select("vec_id", F.coalesce("asks", F.lit(False)).alias("asks"), "node", "copies", F.monotonically_increasing_id().alias("row")), "vector-rows")
    biggest = nodes.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 1.0
    square = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + (x / biggest) * (x / biggest))
    longest = float(np.sqrt(nodes.agg(F.max(square)).first()[0] or 1.0))
    coded = cut(nodes.select("node", "vector").mapInArrow(_coded(longest, biggest, trees, seed), "node long, dim int, vec binary, sides array<long>"), "vector-sides")
    near = graph(coded, k=k, rounds=rounds, **options)
    drop(coded)
    index = Index(spark, nodes, near, longest)
    drop(near)
    asked = placed.filter("asks").select(F.col("row").alias("query"), "node").join(nodes.select("node", "vector"), "node")
    found = search(index, cut(asked, "queries"), top, beam)
    index.close()
    # of equal vectors the smallest ids; first those of each partial group, as one vector may have any share of the rows
    salt = F.pmod(F.xxhash64("row"), F.lit(shuffle_parts(spark)))
    order = [F.col("vec_id").asc_nulls_last(), F.col("row")]
    within = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    copies = placed.filter("copies > 1").withColumn("salt", salt).withColumn("n", within("node", "salt")).filter(F.col("n") <= top + 1)
    copies = copies.withColumn("n", within("node")).filter(F.col("n") <= top + 1)
    members = placed.filter("copies = 1").select("node", "vec_id", "row").unionByName(copies.select("node", "vec_id", "row"))
    pairs = found.join(members, "node").filter(F.col("row") != F.col("query"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), *order))
    ranked = pairs.withColumn("rank", rank).filter(F.col("rank") <= top)
    ids = placed.filter("asks").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    return ranked.join(ids, "query").select("query_id", "rank", "vec_id", "score")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
