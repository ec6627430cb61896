"""Text search over media."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import STOP_WORDS, phrase_text, pieces, pieces_of_each, tokenise
from ..plans.fixtures import Library

#: Weights of the token index, and of the fields in ranked keyword search.
TOKEN_WEIGHTS = {"type": 10, "artist": 5, "album": 5, "title": 5, "actor": 7, "tag": 7, "auto_tag": 2}
FIELD_WEIGHTS = {"path": 1, "auto_tags": 1, "tags": 3, "artist": 5, "album": 7, "title": 7, "actors": 8, "type": 10}
#: Media that a task counts at once.
ROWS_AT_ONCE = 256


def token_index(lib: Library, stop_words: frozenset[str] = STOP_WORDS, wanted: Sequence[str] | None = None) -> DataFrame:
    """(hash, token, weight), summed per token.

    With ``wanted`` only those tokens, and only texts that hold one of them are tokenised.
    """
    lists = weighed(token_fields(lib, stop_words, wanted))
    rows = lists.select("hash", F.explode(F.arrays_zip("tokens", "weights")).alias("t")).select("hash", F.col("t.tokens").alias("token"), F.col("t.weights").alias("weight"))
    return rows if wanted is None else rows.filter(F.col("token").isin(list(wanted)))


def token_fields(lib: Library, stop_words: frozenset[str] = STOP_WORDS, wanted: Sequence[str] | None = None, rated: bool = False) -> DataFrame:
    """(hash, value, fields): the texts of a medium's row as structs (weight, least, words): words between spaces, not reduced to tokens yet, and the least length of a token; a hash may repeat.

    A type is a token as it is, and has no least length; with 0 all words are tokens. ``value``, with
    ``rated``: ratings 1..5 as -1..1, in halves, so that sums are exact in any order; else null.
    """
    field = lambda w, least, words: F.struct(F.lit(w).alias("weight"), F.lit(least).cast("int").alias("least"), words.alias("words"))

    def own(c: str) -> Column:
        found = pieces(F.col(c), stop_words)
        return field(TOKEN_WEIGHTS[c], 2, found if wanted is None else F.when(may_hold(F.col(c), wanted), found))

    def each(words: Column, name: str) -> Column:
        words = words if wanted is None else F.filter(words, lambda t: may_hold(t, wanted))
        return field(TOKEN_WEIGHTS[name], 1, pieces_of_each(words, stop_words))

    fields = [field(TOKEN_WEIGHTS["type"], None, F.col("type")), *map(own, ("artist", "album", "title"))]
    if "auto_tags" in lib.media.columns:
        fields.append(each(F.coalesce("auto_tags", F.array().cast("array<string>")), "auto_tag"))
    value = F.when(F.col("rating") != 0, (F.col("rating") - 3) / 2).alias("value") if rated else no_value()
    rows = lib.media.select("hash", value, F.array(*fields).alias("fields"))
    for bridge, name in ((lists_of(lib), "tag"), (lib.media_actors.select("media_hash", F.array("actor_id").alias("words")), "actor")):
        rows = rows.unionByName(bridge.select(F.col("media_hash").alias("hash"), no_value(), F.array(each(F.col("words"), name)).alias("fields")))
    return rows


def no_value() -> Column:
    """The value of rows without a rating."""
    return F.lit(None).cast("double").alias("value")


def lists_of(lib: Library) -> DataFrame:
    """Tags as (media_hash, words), in lists if the library holds them so, else one by one."""
    return lib.media_tags.select("media_hash", F.array("tag_id").alias("words")) if lib.tag_lists is None else lib.tag_lists


#: Bytes of a UTF-8 text that no token has; all bytes of other characters are among them.
_NO_TOKEN = bytes(set(range(256)) - set(b"abcdefghijklmnopqrstuvwxyz0123456789 "))


def _count(fields: list[dict]) -> dict[str, int]:
    """Tokens of a medium's fields with the sums of their weights."""
    sums: dict[str, int] = {}
    for f in fields:
        weight, least, words = f["weight"], f["least"], f["words"]
        if words is None:
            continue
        if least is None:
            sums[words] = sums.get(words, 0) + weight
        elif least == 0:
            sums |= dict.fromkeys(filter(None, words.split(" ")), weight)
        else:
            for t, n in Counter(words.encode().translate(None, _NO_TOKEN).decode().split(" ")).items():
                if len(t) >= least and not t.isdigit():
                    sums[t] = sums.get(t, 0) + n * weight
    return sums


def weighed(fields: DataFrame) -> DataFrame:
    """(hash, value, votes, tokens, weights) from (hash, value, fields): one row per hash, its tokens in order, with the sums of their weights; the sum and number of its values.

    One exchange by hash carries the texts whole; tokens are counted behind it, row by row.
    """
    fields = fields.repartition("hash").groupBy("hash").agg(F.sum("value").alias("value"), F.count("value").alias("votes"), F.collect_list("fields").alias("fields"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                sums = [_count([f for fields in row for f in fields]) for row in part.column(3).to_pylist()]
                tokens = [sorted(x) for x in sums]
                weights = [[x[t] for t in row] for x, row in zip(sums, tokens, strict=True)]
                lists = [pa.array(tokens, pa.list_(pa.string())), pa.array(weights, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *lists], names=["hash", "value", "votes", "tokens", "weights"])

    return fields.mapInArrow(counted, "hash string, value double, votes long, tokens array<string>, weights array<long>").filter(F.size("tokens") > 0)


def may_hold(text: Column, tokens: Sequence[str]) -> Column:
    """False only for texts of which tokenise() gives none of ``tokens``: what it strips from words is stripped here."""
    bare = F.regexp_replace(F.lower(text), "[^a-z0-9 /\\\\_.?!<>\"-]", "")
    return reduce(lambda a, b: a | b, [F.contains(bare, F.lit(t)) for t in tokens], F.lit(False))


def weighted_query(
    lib: Library, query: str, limit: int | None = None, stop_words: frozenset[str] = STOP_WORDS, index: DataFrame | None = None,
) -> DataFrame:
    """(hash, score) by falling score; repeated words of the query count again. ``index`` is a stored token index."""
    spark = lib.media.sparkSession
    # the words of one query are few
    times = Counter(spark.range(1).select(tokenise(F.lit(query), stop_words)).first()[0])
    words = spark.createDataFrame(sorted(times.items()), "token string, times long")
    index = token_index(lib, stop_words, list(times)) if index is None else index
    score = F.sum(F.col("weight") * F.col("times")).cast("long").alias("score")
    ordered = index.join(F.broadcast(words), "token").groupBy("hash").agg(score).filter("score > 0").orderBy(F.desc("score"), "hash")
    return ordered.limit(limit) if limit else ordered


def search_document(lib: Library) -> DataFrame:
    """One row of text fields per medium."""
    joined = lambda bridge, c, name: bridge.groupBy(F.col("media_hash").alias("hash")).agg(F.array_join(F.sort_array(F.collect_set(c)), ",").alias(name))
    media = lib.media.select("hash", "path", "type", "artist", "album", "title", *(["auto_tags"] if "auto_tags" in lib.media.columns else []))
    if "auto_tags" in media.columns:
        media = media.withColumn("auto_tags", F.array_join("auto_tags", ","))
    return media.join(joined(lib.media_tags, "tag_id", "tags"), "hash", "left").join(
        joined(lib.media_actors, "actor_id", "actors"),
        "hash",
        "left",
    )


def keyword_matches(lib: Library, query: str, among: Callable[[Library, list[str]], Library] | None = None) -> DataFrame:
    """Hashes of media with any term; a term's words must stand side by side in one field.

    ``among`` gives the part of the library in which phrases may stand, as
    ``postings.library_of`` does with a stored index of words; only its texts are read.
    """
    terms = [t for t in query.strip().split(" ") if t]
    phrases = [p for p in (" ".join(re.findall(r"[^\W_]+", t.lower())) for t in terms) if p]
    if not phrases:
        return lib.media.select("hash").filter(F.lit(False))
    lib = among(lib, phrases) if among else lib
    media = lib.media
    any_of = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(f" {p} ")) for p in phrases])
    has = lambda c: any_of(phrase_text(F.col(c)))
    conditions = [has(c) for c in ("hash", "path", "type", "artist", "album", "title")]
    if "auto_tags" in media.columns:
        conditions.append(F.exists(F.coalesce("auto_tags", F.array().cast("array<string>")), lambda t: any_of(phrase_text(t))))
    own = media.filter(reduce(lambda a, b: a | b, conditions)).select("hash")
    # words of a phrase stand in the lower-cased text as they are, so most lists are not looked at word by word
    words = {w for p in phrases for w in p.split(" ")}
    held = lambda ws: reduce(lambda a, b: a | b, [F.contains(F.lower(F.array_join(ws, "\n")), F.lit(w)) for w in sorted(words)])
    tags = lists_of(lib).filter(held(F.col("words")) & F.exists("words", lambda t: any_of(phrase_text(t))))
    bridges = [tags.select(F.col("media_hash").alias("hash")), lib.media_actors.filter(has("actor_id")).select(F.col("media_hash").alias("hash"))]
    return reduce(DataFrame.unionByName, bridges, own).distinct()


def parse_keywords(query: str) -> tuple[list[str], list[str]]:
    """Wanted and unwanted phrases of a query with "quoted phrases" and -negations."""
    want, unwanted = [], []
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        phrase = " ".join(re.findall(r"[^\W_]+", (quoted or word).lower()))
        if phrase:
            (unwanted if minus else want).append(phrase)
    return want, unwanted


def ranked_keywords(lib: Library, query: str, among: Callable[[Library, list[str]], Library] | None = None) -> DataFrame:
    """(hash, score); score is the sum over fields of weight x occurrences of the wanted phrases. ``among`` as in keyword_matches()."""
    want, unwanted = parse_keywords(query)
    lib = among(lib, want) if among else lib
    own = F.array(
        *[F.struct(phrase_text(F.col(c)).alias("text"), F.lit(FIELD_WEIGHTS[c]).alias("weight")) for c in ("path", "artist", "album", "title", "type")],
    )
    rows = lib.media.select("hash", F.explode(own).alias("f")).select("hash", "f.text", "f.weight")
    for bridge, c, name in ((lib.media_tags, "tag_id", "tags"), (lib.media_actors, "actor_id", "actors")):
        rows = rows.unionByName(
            bridge.select(
                F.col("media_hash").alias("hash"),
                phrase_text(F.col(c)).alias("text"),
                F.lit(FIELD_WEIGHTS[name]).alias("weight"),
            ),
        )
    if "auto_tags" in lib.media.columns:
        rows = rows.unionByName(
            lib.media.select("hash", F.explode("auto_tags").alias("t")).select(
                "hash",
                phrase_text(F.col("t")).alias("text"),
                F.lit(FIELD_WEIGHTS["auto_tags"]).alias("weight"),
            ),
        )
    # neighbours share a space, so spaces are doubled before counting
    times = lambda p: F.regexp_count(F.replace("text", F.lit(" "), F.lit("  ")), F.lit(f" {p.replace(' ', '  ')} "))
    hits = sum((times(p) for p in want), F.lit(0))
    scored = rows.withColumn("score", F.col("weight") * hits).filter("score > 0").groupBy("hash").agg(F.sum("score").cast("long").alias("score"))
    if unwanted:
        bad = rows.filter(reduce(lambda a, b: a | b, [F.contains("text", F.lit(f" {p} ")) for p in unwanted])).select("hash")
        scored = scored.join(bad, "hash", "left_anti")
    return scored.orderBy(F.desc("score"), "hash")
