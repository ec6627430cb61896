"""The search tokeniser (D1) and phrase matching."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splitting goes by these in this order.
SEPARATORS = ["/", "\\", "-", "_", ".", "?", "!", "<", ">", '"']
#: What counts as white space around a piece.
WHITE_SPACE = " \t\n\r\f\v\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: What stands between texts, or between tokens, that are joined to one string; texts that have it go by themselves.
BETWEEN = "\x01"
#: A short default; callers give their own list.
STOP_WORDS = frozenset(
    "a about after all also an and any are as at be because been before but by can could did do does for from had has have he her here him his how i if in into is it its just like me more most my no not of on one only or other our out over she so some such than that the their them then there these they this to too up us very was we were what when where which who why will with would you your".split(),
)


def tokenise(text: Column, stop_words: frozenset[str] = STOP_WORDS) -> Column:
    """Array of search tokens, repeats kept.

    The text is split at each separator in turn; a piece that is a stop word as a whole
    goes. So a stop word between two spaces survives. Then words are reduced to
    [a-z0-9], and empty and all-digit ones go.
    """
    return F.coalesce(bare_words(pieces(text, stop_words)), F.array().cast("array<string>"))


def bare_words(text: Column) -> Column:
    """Words of a text between spaces, reduced to [a-z0-9], without empty and all-digit ones."""
    return F.regexp_extract_all(F.regexp_replace(text, "[^a-z0-9 ]+", ""), F.lit("[0-9]*[a-z][a-z0-9]*"), F.lit(0))


def pieces(text: Column, stop_words: frozenset[str] = STOP_WORDS) -> Column:
    """The lower-cased text without separators and the pieces that are stop words; its bare words are its tokens."""
    stop = F.lit(",".join(sorted(stop_words)))  # one literal; no stop word has a comma
    text = F.lower(text)
    trimmed = lambda x: F.trim(x, F.lit(WHITE_SPACE))
    for sep in SEPARATORS:
        text = F.array_join(F.filter(F.split(text, rf"\Q{sep}\E"), lambda x: F.find_in_set(trimmed(x), stop) == 0), " ")
    return text


def pieces_of_each(texts: Column, stop_words: frozenset[str] = STOP_WORDS) -> Column:
    """pieces() of all texts of an array with spaces between them, in any order.

    Texts are joined by ``BETWEEN``, which bounds pieces as separators do. Those without
    separators are one piece each, so one step does for them.
    """
    heads = {x[:1] for x in stop_words}  # by first letter, so that most texts end at it
    stops = "|".join(f"{re.escape(h)}(?:{'|'.join(sorted(re.escape(x[1:]) for x in stop_words if x[:1] == h))})" for h in sorted(heads)) or "(?!)"

    def strip(x: Column, sep: str) -> Column:
        end = f"[{BETWEEN}{re.escape(sep)}]"
        return F.translate(F.regexp_replace(x, f"(?<={end})[{WHITE_SPACE}]*(?:{stops})[{WHITE_SPACE}]*(?={end})", ""), sep, " ")

    def joined(kept: Column, separators: list[str]) -> Column:
        x = F.concat(F.lit(BETWEEN), F.lower(F.array_join(kept, BETWEEN)), F.lit(BETWEEN))
        for sep in separators:
            x = strip(x, sep)
        return F.translate(x, BETWEEN, " ")

    has = lambda x, chars: x.rlike("[" + re.escape("".join(chars)) + "]")
    cut = F.filter(texts, lambda x: has(x, [*SEPARATORS, BETWEEN]))
    odd = F.array_join(F.transform(F.filter(cut, lambda x: has(x, [BETWEEN])), lambda x: pieces(x, stop_words)), " ")
    whole = joined(F.filter(texts, lambda x: ~has(x, [*SEPARATORS, BETWEEN])), SEPARATORS[:1])
    return F.concat_ws(" ", whole, joined(F.filter(cut, lambda x: ~has(x, [BETWEEN])), SEPARATORS), odd)


def phrase_text(text: Column) -> Column:
    """The alphanumeric words of a field, each between single spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
