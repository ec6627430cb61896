"""Column functions on media rows: types, hashes, names, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The known file extensions of each type.
TYPES = {"still": ["png", "jpg", "jpeg", "bmp", "webp"], "gif": ["gif"], "video": ["avi", "mp4", "flv", "wmv", "mov", "webm", "mpeg", "mpg"]}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    """The part before the last slash; ``.`` for a bare name."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def absolute_path(root: str, path: Column) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), path)


def media_type(path: Column) -> Column:
    """still, gif or video by the last extension, else null; a name that is only an extension has none."""
    ext = F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, exts in TYPES.items():
        out = F.when(ext.isin(exts), kind).otherwise(out)
    return out


def content_hash(content: Column, chunk: int = 65536) -> Column:
    """MD5 of the first and the last ``chunk`` bytes; short content counts once."""
    n = F.octet_length(content)
    tail = F.substring(content, n - chunk + 1, F.lit(chunk))
    return F.md5(F.when(n > chunk, F.concat(F.substring(content, 1, chunk), tail)).otherwise(content))


def hamming(a: Column, b: Column, digits: int = 64) -> Column:
    """Differing bits of two hex strings of equal length; another length is an error."""
    part = lambda c, i: F.conv(F.substring(c, i + 1, 8), 16, 10).cast("long")
    total = sum((F.bit_count(part(a, i).bitwiseXOR(part(b, i))) for i in range(0, digits, 8)), F.lit(0))
    fits = (F.length(a) == digits) & (F.length(b) == digits)
    return F.when(fits, total).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("hashes of different lengths")).cast("int")))


def duration(seconds: Column) -> Column:
    """hh:mm:ss, hours unbounded."""
    s = seconds.cast("long")
    pad = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    return F.concat_ws(":", pad(F.floor(s / 3600)), pad(F.floor(s / 60) % 60), pad(s % 60))


def title(album: Column, title_: Column, path: Column) -> Column:
    both = F.concat_ws(" - ", F.nullif(album, F.lit("")), F.nullif(title_, F.lit("")))
    return F.coalesce(F.nullif(both, F.lit("")), file_name(path))


def subtitle(kind: Column, seconds: Column, width: Column, height: Column) -> Column:
    size = F.when(width.isNotNull(), F.concat(width.cast("string"), F.lit("x"), height.cast("string")))
    return F.concat_ws(" | ", F.initcap(kind), F.when(kind == "video", duration(seconds)), size)
