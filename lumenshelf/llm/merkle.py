"""A Merkle manifest of a table, with a proof for every row (operator 13).

Rows of a group (a language) in order of their ids are the leaves of a tree in which
every ARITY consecutive nodes, fewer in the last run, have their digest as parent; the
groups' roots in order of the groups are the leaves of one more such tree, whose root
names the whole table.

Windows of fixed offsets
    1. leaves get their positions from ranges of (group, id) (``plans.ranks``), so a group
       with any share of the rows is spread over all tasks;
    2. DEPTH levels at a time are built in chunks of ARITY ** DEPTH consecutive nodes.
       At level l a row stands for a node if its position is a multiple of ARITY ** l:
       lag and lead columns of 1 to 7 times that offset, masked by the row's slot in its
       run and by the run's end, are its siblings, and first children hash their parent.
       A row's later ancestors stand on rows before it, so a running last value carries
       their siblings to each leaf. One exchange serves all levels of a chunk;
    3. the chunks' top nodes, one in ARITY ** DEPTH, are the rows of the next round, until
       one node per group is left. On the way back each chunk's path is joined to its rows.
A chunk is the largest unit of work. Proofs exist only in the final rows: what is
written or shuffled is a row's digest or, once per chunk, the path above it.

Edge cases: any field may be null (``-``); a null group is a group, and comes first; null
ids come first, rows that repeat an id are ordered by their leaf digest, so equal rows
are leaves of their own; groups are ordered by the bytes of their UTF-8; extra columns are not read;
an empty table gives no rows. A group of one row has its leaf as root and, if it is
the only group, the digest of nothing as proof.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ranks import ranked
from .common import cut, drop, table

ARITY = 8
#: Levels in one chunk of ARITY ** DEPTH nodes.
DEPTH = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value's byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest(*map(field, fields))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def with_levels(nodes: DataFrame) -> DataFrame:
    """Adds chunk, top and steps to nodes (grp, pos, n, hash): one row per node, n nodes in its group.

    ``top`` is the digest of the chunk's top node, on the chunk's first row; ``steps`` the
    siblings (left, right: digests in order, as one string) on the way up to it. A level
    at which a group has only one node left is none.
    """
    window = "WINDOW w AS (PARTITION BY grp, chunk ORDER BY pos)"
    query, now, mine = f"SELECT *, pos DIV {ARITY**DEPTH} AS chunk FROM {{nodes}}", "hash", []
    for level in range(DEPTH):
        apart = ARITY**level
        slot = f"pos DIV {apart} % {ARITY}"
        stands = f"n > {apart} AND pos % {apart} = 0"
        left = ", ".join(f"CASE WHEN {slot} >= {k} THEN lag({now}, {k * apart}) OVER w END" for k in range(ARITY - 1, 0, -1))
        right = ", ".join(f"CASE WHEN {slot} < {ARITY - k} THEN lead({now}, {k * apart}) OVER w END" for k in range(1, ARITY))
        query = f"SELECT *, CASE WHEN {stands} THEN concat_ws('', {left}) END AS _l{level}, CASE WHEN {stands} THEN concat_ws('', {right}) END AS _r{level} FROM ({query}) {window}"
        # a first child hashes its parent; a lone node is its own
        up = f"CASE WHEN n <= {apart} THEN {now} WHEN {stands} AND {slot} = 0 THEN sha2(concat({now}, _r{level}), 256) END"
        query, now = f"SELECT *, {up} AS _h{level + 1} FROM ({query})", f"_h{level + 1}"
        mine += [f"_l{level}", f"_r{level}", *([f"_h{level}"] if level else [])]
    # siblings of the ancestor at a level: the last row so far that stands for a node of it
    way = lambda c: f"last({c}, true) OVER (PARTITION BY grp, chunk ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    steps = ", ".join(f"CASE WHEN n > {ARITY**k} THEN named_struct('left', {way(f'_l{k}')}, 'right', {way(f'_r{k}')}) END" for k in range(DEPTH))
    query = f"SELECT * EXCEPT ({', '.join(mine)}, {now}), {now} AS top, array_compact(array({steps})) AS steps FROM ({query})"
    return nodes.sparkSession.sql(query, nodes=nodes)


def climb(nodes: DataFrame, name: str) -> list[DataFrame]:
    """``nodes`` and the chunks' top nodes above them, round by round; the last table has one node per group."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        tops = with_levels(rounds[-1]).filter(F.col("pos") % ARITY**DEPTH == 0)
        size = F.ceil(F.col("n") / ARITY**DEPTH).cast("long")
        rounds.append(cut(tops.select("grp", F.col("chunk").alias("pos"), size.alias("n"), F.col("top").alias("hash")), name))
    return rounds


def descend(rounds: list[DataFrame], above: DataFrame | None, name: str) -> DataFrame:
    """The lowest round's nodes with steps up to the top of ``above`` (grp, subroot, steps: the way from each group's root).

    Without ``above`` the groups' roots are the end.
    """
    top = rounds[-1].select("grp", F.col("pos").alias("chunk"))
    path = top.join(above, "grp") if above is not None else top.select("*", F.lit(None).cast("string").alias("subroot"), F.array().cast("array<struct<left:string,right:string>>").alias("steps"))
    path = path.select("grp", "chunk", "subroot", F.col("steps").alias("_above"))
    for i, nodes in reversed(list(enumerate(rounds[:-1]))):
        here = with_levels(nodes).join(path, ["grp", "chunk"]).withColumn("steps", F.concat("steps", "_above")).drop("_above", "top", "chunk")
        if i:
            path = cut(here.select("grp", F.col("pos").alias("chunk"), "subroot", F.col("steps").alias("_above")), name)
        else:
            return here
    return rounds[0].join(path.drop("chunk"), "grp").withColumnRenamed("_above", "steps")  # every group is one node


def manifest(rows: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """One row (id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of ``rows``.

    Where ``where`` holds, the proof is tried with the leaf of a changed row: ``tampered``
    gives the changed fields.
    """
    group = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    changed = leaf([(tampered or {}).get(c, F.col(c)) for c in fields])
    other = F.when(where, changed) if where is not None else F.lit(None).cast("string")
    leaves = cut(rows.select(F.col(id_col).alias("id"), group.alias("grp"), leaf([F.col(c) for c in fields]).alias("hash"), other.alias("other")), "leaves")
    placed = ranked(leaves, [F.col("id")], ["hash"], ["grp"], total="n").withColumnRenamed("rank", "pos")
    placed = cut(placed, "placed-leaves")
    drop(leaves)
    trees = climb(placed, "tree-tops")
    roots = trees[-1].select("grp", F.col("hash").alias("subroot"))
    # the groups' roots are the leaves of the last tree
    ordered = ranked(roots.withColumn("all", F.lit("")), [F.col("grp")], [], ["all"], total="n")
    ordered = cut(ordered.select(F.col("all").alias("grp"), F.col("rank").alias("pos"), "n", F.col("subroot").alias("hash"), F.col("grp").alias("of")), "group-roots")
    last = climb(ordered, "root-tops")
    top = last[-1].first()
    root = F.lit(top["hash"] if top else None).cast("string")
    above = descend(last, None, "root-paths").select(F.col("of").alias("grp"), F.col("hash").alias("subroot"), "steps")
    out = descend(trees, cut(above, "group-paths"), "tree-paths")
    folded = F.aggregate("steps", F.coalesce("other", "hash"), lambda node, s: digest(s["left"], node, s["right"]))
    proof = F.sha2(F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = out.select("id", F.col("hash").alias("leaf"), "subroot", root.alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return manifest(docs, tampered={"text": lower_ascii(F.col("text"))}, where=third).withColumnRenamed("id", "doc_id")


#: CRC-32 of the decimal digits of an id, by bytes, with the table of the reversed polynomial 0xEDB88320.
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS tab"
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), "
    "lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
)
#: Levels are rounds of one recursion; a proof is folded in another. Arity and fields as above.
ORACLE_SQL = f"""
WITH RECURSIVE crc_table AS ({_CRC_TABLE}), d AS (
  SELECT doc_id, lang, {" || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS[:-1])} AS head, text FROM documents
), leaves AS MATERIALIZED (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
    sha256(head || coalesce(strlen(text) || ':' || translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '-')) AS other
  FROM d
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
    dense_rank() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS grp FROM leaves
), low AS (
  SELECT 0 AS level, grp, pos, h, count(*) OVER (PARTITION BY grp) AS n FROM placed
  UNION ALL
  SELECT level + 1, grp, pos // {ARITY}, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + {ARITY - 1}) // {ARITY})
  FROM low WHERE n > 1 GROUP BY level, grp, pos // {ARITY}
), high AS (
  SELECT 0 AS level, grp AS pos, h, count(*) OVER () AS n FROM low WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // {ARITY}, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + {ARITY - 1}) // {ARITY})
  FROM high WHERE n > 1 GROUP BY level, pos // {ARITY}
), up AS MATERIALIZED (
  SELECT grp, level, pos, h, n FROM low
), top AS MATERIALIZED (
  SELECT level, pos, h, n FROM high
), low_runs AS MATERIALIZED (
  SELECT grp, level, pos // {ARITY} AS run, list(h ORDER BY pos) AS hs FROM up WHERE n > 1 GROUP BY ALL
), high_runs AS MATERIALIZED (
  SELECT level, pos // {ARITY} AS run, list(h ORDER BY pos) AS hs FROM top WHERE n > 1 GROUP BY ALL
), depth AS (
  SELECT grp, max(level) AS levels FROM up GROUP BY grp
), steps AS MATERIALIZED (
  SELECT p.grp, p.pos, r.level, r.hs, (p.pos // CAST(pow({ARITY}, r.level) AS BIGINT)) % {ARITY} AS slot
  FROM placed p JOIN low_runs r ON r.grp = p.grp AND r.run = p.pos // CAST(pow({ARITY}, r.level + 1) AS BIGINT)
  UNION ALL
  SELECT p.grp, p.pos, levels + r.level, r.hs, (p.grp // CAST(pow({ARITY}, r.level) AS BIGINT)) % {ARITY}
  FROM placed p JOIN depth USING (grp) JOIN high_runs r ON r.run = p.grp // CAST(pow({ARITY}, r.level + 1) AS BIGINT)
), sides AS MATERIALIZED (
  SELECT grp, pos, level, array_to_string(hs[:slot], '') AS l, array_to_string(hs[slot + 2:], '') AS r FROM steps
), folds AS (
  SELECT grp, pos, 0 AS level, CASE WHEN crc32 % 3 = 0 THEN other ELSE h END AS acc FROM (SELECT placed.*, {_CRC} AS crc32 FROM placed, crc_table) t
  UNION ALL
  SELECT f.grp, f.pos, f.level + 1, sha256(l || acc || r) FROM folds f JOIN sides s ON s.grp = f.grp AND s.pos = f.pos AND s.level = f.level
), folded AS (
  SELECT grp, pos, arg_max(acc, level) AS folded_root FROM folds GROUP BY grp, pos
), proofs AS (
  SELECT grp, pos, sha256(string_agg(l || r, '' ORDER BY level)) AS proof_sha256 FROM sides GROUP BY grp, pos
)
SELECT doc_id, p.h AS leaf, s.h AS subroot, t.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = t.h AS verified
FROM placed p JOIN up s ON s.grp = p.grp AND s.n = 1 JOIN top t ON t.n = 1 JOIN folded f ON f.grp = p.grp AND f.pos = p.pos
LEFT JOIN proofs q ON q.grp = p.grp AND q.pos = p.pos
"""
