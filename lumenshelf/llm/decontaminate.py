"""Benchmark decontamination by template windows (operator 1, DataFrame functions only).

Texts become templates: numbers, names and units after numbers turn into typed
placeholders, all other words into lower case. A benchmark item is known by its
template windows of five words of which at least three are not placeholders. An item
without such a window, which is shorter or full of placeholders, is known by its whole
template as one window, if that has three words which are not placeholders.

1. Candidates: an item is only found where a share of ``SHARE`` of its windows
   occurs, so any document that holds it has one of the floor((1 - SHARE) n) + 1
   windows of the item that are rarest among all items. Only those are hash-joined
   with the windows of the documents; windows that many items share hardly ever are
   among them.
2. For each candidate pair, all windows that the two share are aligned. Windows at
   one distance between their positions are one occurrence; in it the slots must be
   consistent: one value of the item always stands for one value of the document. So
   a question with other numbers or names is caught, and text that merely has
   placeholders in the same places is not. Inconsistent occurrences don't count.
3. A document is contaminated by an item if its consistent windows are SHARE or
   more of the item's.

Joined data: the rarest windows are broadcast with their items if there are up to
``BROADCAST_WINDOWS`` windows, which is checked. Beyond, their hashes alone go to all
tasks, so that only windows of documents that an item has as a rare one are exchanged, and
not all windows of all documents. Likewise candidate pairs are broadcast up to
``BROADCAST_PAIRS``, and beyond that 64-bit keys of their documents, so that only texts of
candidates are exchanged. A document's arrays are written once, whatever the number of its
candidate items; windows that it shares with an item are single rows before they meet the
item's words. Whatever is broadcast takes ``BROADCAST_BYTES`` at most, by the number of
rows; larger tables are joined by shuffle, where a hot window or item is left to the
adaptive split of skewed joins, as only one side of these joins is large. A window that a
third of all documents holds costs one row for each of them.

Edge cases: null and empty texts, and items with fewer than three words that are not
placeholders, match nothing; very long texts are read whole. Rows that repeat an id are
judged each by its own text, and a pair of ids has one row, of the text with the most
matches; rows with a null id can't be named and are left out; a repeated item row
counts once; different texts with one item id are one item with the windows of all,
each text aligned by itself; extra columns are not read; empty tables give an empty
result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

WIDTH = 5
LEAST_WORDS = 3
SHARE = 0.8
#: Up to so many item windows the rarest are broadcast with their items, and up to so many candidate pairs the pairs (about 200 bytes each).
BROADCAST_WINDOWS, BROADCAST_PAIRS = 500_000, 300_000
#: A broadcast table takes about so many bytes at most in each process; of a row that is a hash, of an item, of one of its windows' hashes, and of a window with its words.
BROADCAST_BYTES = 64 << 20
HASH_ROW, ITEM_ROW, ITEM_HASH, WINDOW_ROW = 48, 80, 8, 300
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb ml l s ms min h hr hours hour minutes minute seconds second days day weeks week months month years year mph kmh percent dollars dollar euros euro usd eur cents cent degrees meters metres miles inches feet pounds liters litres grams kilograms".split()
#: Numbers, words, and ends of sentences.
TOKEN = r"(\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}_]+|[.!?:\n]+)"
NAME = r"^\p{Lu}\p{Ll}+$"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 1)


def template_words(tokens: Column) -> Column:
    """The template: a word or placeholder per token, null for ends of sentences."""
    is_end = lambda x: x.rlike(r"^[.!?:\n]")
    is_number = lambda x: x.rlike(r"^\p{N}")

    def word(x: Column, prior: Column) -> Column:
        low = F.lower(x)
        # most words are lower-case and follow no number; they need no pattern
        plain = F.when((prior < "0") | ((prior >= ":") & (prior < "\u0080")), low).when(is_number(prior) & low.isin(UNITS), "<unit>").otherwise(low)
        same = F.when((x >= "A") & (x < "{"), plain).when(is_number(x), "<num>").when(is_end(x), None).otherwise(plain)
        return F.when(x == low, same).when(x.rlike(NAME) & ~is_end(prior), "<name>").otherwise(plain)

    before = F.concat(F.array(F.lit(".")), tokens)
    return F.zip_with(tokens, F.slice(before, F.lit(1), F.size(tokens)), word)


def with_template(df: DataFrame, text: str, raws: bool = False, spans: Sequence[int] = ()) -> DataFrame:
    """Adds words (the template) and windows (64-bit hashes, one per position) for the column ``text``.

    With ``raws`` also the words in lower case; for each of ``spans`` also windows_<span>.
    """
    # read windows with explode_outer only: for explode, Spark infers a filter on the array's size, in which
    # the arrays under a lambda are computed again for every element
    df = df.withColumn("_tokens", tokens(F.col(text)))
    df = df.withColumn("_all", template_words(F.col("_tokens")))
    if raws:
        kept = F.filter(F.zip_with("_tokens", "_all", lambda x, w: F.when(w.isNotNull(), F.lower(x))), lambda x: x.isNotNull())
        df = df.withColumn("raws", kept)
    df = df.withColumn("words", F.filter("_all", lambda w: w.isNotNull()))
    hashed = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WIDTH)])
    df = df.withColumn("windows", _windows(WIDTH, hashed))
    for span in spans:
        df = df.withColumn(f"windows_{span}", _windows(span, _whole_of(span)))
    return df.drop("_tokens", "_all")


def _windows(span: int, hashed: Callable[[Column], Column]) -> Column:
    at = F.sequence(F.lit(0), F.size("words") - span)
    return F.when(F.size("words") >= span, F.transform(at, hashed)).otherwise(F.array().cast("array<long>"))


def _whole_of(span: int) -> Callable[[Column], Column]:
    return lambda i: _whole(F.slice("words", i + 1, F.lit(span)))


def _whole(words: Column) -> Column:
    """The window that is a whole template."""
    return F.xxhash64(F.lit("whole"), words)


def item_windows(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, part, pos, span, h, raws, n): the countable windows of each item, by text (part) and position, and how many it has in all its texts."""
    texts = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).filter("item_id is not null").distinct()
    plain = lambda words: F.size(F.filter(words, lambda w: ~w.startswith("<")))
    made = cut(with_template(texts.withColumn("part", F.xxhash64("text")), "text", raws=True), "item-templates")
    rows = made.select("item_id", "part", "words", "raws", F.posexplode_outer("windows").alias("pos", "h"))
    part = lambda c: F.slice(c, F.col("pos") + 1, F.lit(WIDTH))
    rows = rows.filter(plain(part("words")) >= LEAST_WORDS).select(
        "item_id",
        "part",
        "pos",
        F.lit(WIDTH).alias("span"),
        "h",
        part("raws").alias("raws"),
    )
    bare = made.join(rows.select("item_id", "part").distinct(), ["item_id", "part"], "left_anti").filter(plain(F.col("words")) >= LEAST_WORDS)
    whole = bare.select("item_id", "part", F.lit(0).alias("pos"), F.size("words").alias("span"), _whole(F.col("words")).alias("h"), "raws")
    return rows.unionByName(whole).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item_id")))


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    share: float = SHARE, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row (doc_id, item_id, matched, item_windows) per document and item found in it."""
    known = cut(item_windows(items, item_col, item_text_col), "item-windows")
    n_windows, n_items = known.agg(F.count(F.lit(1)), F.countDistinct("item_id")).first()
    # lengths of whole templates: a few numbers, each the length of some item
    spans = sorted(r[0] for r in known.filter((F.col("pos") == 0) & (F.col("span") != WIDTH)).select("span").distinct().collect())
    by_rarity = Window.partitionBy("item_id").orderBy("among", "part", "pos")
    among = known.groupBy("h").agg(F.countDistinct("item_id").alias("among"))
    keys = known.join(among, "h").withColumn("rank", F.row_number().over(by_rarity)).filter(
        F.col("rank") <= F.floor(F.lit(1 - share + 1e-9) * F.col("n")) + 1,
    )
    keys = keys.select("h", "item_id").distinct()
    # a row is its id and text: rows that repeat an id are judged apart
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null").withColumn(
        "row",
        F.xxhash64("text"),
    )
    every = ["windows", *(f"windows_{k}" for k in spans)]
    templates = with_template(texts, "text", spans=spans)
    seen = templates.select("doc_id", "row", F.explode_outer(F.concat(*every) if spans else F.col("windows")).alias("h"))
    if n_windows <= broadcast_windows:
        keys = F.broadcast(keys)
    else:
        keys = cut(keys, "item-keys")
        seen = _among(seen, "h", keys.select("h"))
    pairs = cut(seen.join(keys, "h").select("doc_id", "row", "item_id").distinct(), "candidate-pairs")
    near = pairs.groupBy("doc_id", "row").agg(F.collect_list("item_id").alias("items"))
    if pairs.count() <= BROADCAST_PAIRS:
        near = F.broadcast(near)
    else:
        key = F.xxhash64("doc_id", "row").alias("_key")
        texts = _among(texts.withColumn("_key", key), "_key", pairs.select(key)).drop("_key")
    templates = with_template(texts.join(near, ["doc_id", "row"]), "text", raws=True, spans=spans)
    # written first: an expression that a lambda reads would be computed again for each element
    made = cut(templates.select("doc_id", "row", "items", "words", "raws", *every), "candidate-windows")
    hashes = known.groupBy("item_id").agg(F.collect_set("h").alias("hashes"), F.first("n").alias("n"))
    if ITEM_ROW * n_items + ITEM_HASH * n_windows <= BROADCAST_BYTES:
        hashes = F.broadcast(hashes)
    found = made.withColumn("item_id", F.explode("items")).drop("items").join(hashes, "item_id")
    w = known.select("item_id", "h", F.struct("part", "pos", F.col("raws").alias("raws")).alias("w"))
    if WINDOW_ROW * n_windows <= BROADCAST_BYTES and n_windows <= broadcast_windows:
        w = F.broadcast(w)
    shared = [_shared_positions(found, column, span) for column, span in zip(every, [WIDTH, *spans], strict=True)]
    return _aligned(reduce(DataFrame.unionByName, shared).join(w, ["item_id", "h"]), share)


def _among(rows: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """The rows whose 64-bit ``key`` is listed, without an exchange of the rows; all rows if there are too many keys to broadcast."""
    listed = cut(listed.distinct(), "listed-keys")
    return rows.join(F.broadcast(listed), key, "left_semi") if HASH_ROW * listed.count() <= BROADCAST_BYTES else rows


def _shared_positions(found: DataFrame, windows: str, span: int) -> DataFrame:
    """One row per window of the document that the item has: h, at, and its words and raws."""
    pair = ["doc_id", "row", "item_id", "n"]
    one = found.select(*pair, "hashes", "words", "raws", F.posexplode_outer(windows).alias("at", "h")).filter(F.array_contains("hashes", F.col("h")))
    part = lambda c: F.slice(c, F.col("at") + 1, F.lit(span)).alias(c)
    return one.select(*pair, "at", "h", part("words"), part("raws"))


def _aligned(rows: DataFrame, share: float) -> DataFrame:
    slot = lambda word, mine: F.when(word.startswith("<"), mine)
    values = F.zip_with(F.col("w.raws"), "raws", lambda a, b: F.struct(a.alias("item"), b.alias("doc")))
    slots = F.filter(F.zip_with("words", values, slot), lambda p: p.isNotNull())
    pair = ["doc_id", "row", "item_id", "n"]
    rows = rows.select(
        *pair,
        (F.col("at") - F.col("w.pos")).alias("shift"),
        F.col("w.part").alias("part"),
        F.col("w.pos").alias("pos"),
        slots.alias("slots"),
    )
    # an occurrence has at most one row for each window of the item's text and copy of the document
    once = rows.groupBy(*pair, "part", "shift").agg(
        F.collect_set("pos").alias("found"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
    )
    once = once.filter(F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["item"]))))
    total = once.select(*pair, "part", F.explode("found").alias("pos")).groupBy(*pair).agg(F.countDistinct("part", "pos").alias("matched"))
    total = total.filter(F.col("matched") >= F.lit(share) * F.col("n") - 1e-9)
    return total.groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.first("n").alias("item_windows"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def windows_sql(source: str, key: str) -> str:
    """SQL for (key, pos, win, raws, words) of every window of ``source``(key, text)."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    return rf"""
      SELECT {key}, t.i - 1 AS pos, array_to_string(words[t.i : t.i + {WIDTH - 1}], ' ') AS win, words[t.i : t.i + {WIDTH - 1}] AS words, raws[t.i : t.i + {WIDTH - 1}] AS raws
      FROM (
        SELECT {key}, list_transform(kept, lambda k: k.word) AS words, list_transform(kept, lambda k: k.raw) AS raws
        FROM (
          SELECT {key}, list_filter(list_transform(toks, lambda x, i: {{'raw': lower(x), 'word': CASE
              WHEN regexp_matches(x, '^\p{{N}}') THEN '<num>' WHEN regexp_matches(x, '^[.!?:\n]') THEN NULL
              WHEN i > 1 AND regexp_matches(toks[i - 1], '^\p{{N}}') AND lower(x) IN ({units}) THEN '<unit>'
              WHEN regexp_matches(x, '{NAME}') AND i > 1 AND NOT regexp_matches(toks[i - 1], '^[.!?:\n]') THEN '<name>'
              ELSE lower(x) END}}), lambda k: k.word IS NOT NULL) AS kept
          FROM (SELECT {key}, regexp_extract_all(coalesce(text, ''), '{TOKEN}', 1) AS toks FROM {source})
        )
      ), LATERAL (SELECT unnest(range(1, len(words) - {WIDTH - 2})) AS i) t
    """


def pairs_sql(docs: str) -> str:
    """SQL for contaminated()'s rows over the relation ``docs``, for items that have countable windows."""
    rows = f"(SELECT struct_pack(id := doc_id, text := hash(text)) AS key, text FROM {docs} WHERE doc_id IS NOT NULL)"
    return rf"""
      SELECT key.id AS doc_id, item_id, max(matched) AS matched, any_value(n) AS item_windows
      FROM (
        SELECT key, item_id, count(DISTINCT pos) AS matched, n
        FROM (
          SELECT key, item_id, n, shift, unnest(found) AS pos
          FROM (
            SELECT key, item_id, n, d.pos - b.pos AS shift, list(DISTINCT b.pos) AS found,
              list_distinct(flatten(list(list_filter(list_transform(d.words, lambda w, k: CASE WHEN starts_with(w, '<') THEN [b.raws[k], d.raws[k]] END), lambda s: s IS NOT NULL)))) AS slots
            FROM ({windows_sql(rows, 'key')}) d
            JOIN (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM ({windows_sql('benchmark', 'item_id')})
                  WHERE len(list_filter(words, lambda w: NOT starts_with(w, '<'))) >= {LEAST_WORDS}) b ON d.win = b.win
            WHERE item_id IS NOT NULL
            GROUP BY key, item_id, n, shift
          )
          WHERE len(slots) = len(list_distinct(list_transform(slots, lambda s: s[1])))
        )
        GROUP BY key, item_id, n HAVING count(DISTINCT pos) >= {SHARE} * n - 1e-9
      )
      GROUP BY key.id, item_id
    """


ORACLE_SQL = pairs_sql("documents")
