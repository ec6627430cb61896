"""Video planning and label vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def desired_qualities(height: Column, qualities: list[int], least: int) -> Column:
    """Each configured quality, the source where that is not above ``least`` or above the source; distinct, ascending."""
    one = lambda q: F.when((height <= least) | (q > height), height).otherwise(q)
    return F.array_sort(F.array_distinct(F.transform(F.array(*[F.lit(q) for q in qualities]), one)))


def missing_qualities(desired: Column, cached: Column) -> Column:
    """J2."""
    return F.array_except(desired, F.coalesce(cached, F.array().cast("array<int>")))


def redundant_qualities(desired: Column, cached: Column) -> Column:
    """J2."""
    return F.array_except(F.coalesce(cached, F.array().cast("array<int>")), desired)


def stream_variants(width: Column, height: Column, cached: Column, qualities: list[int], multiplier: float = 1.0, step: int | None = None) -> Column:
    """Array of (quality, width, bandwidth), ascending; the height alone if no quality fits."""
    fitting = F.filter(F.array(*[F.lit(q) for q in qualities]), lambda q: q <= F.least(width, height))
    found = F.array_sort(F.array_distinct(F.concat(fitting, F.coalesce(cached, F.array().cast("array<int>")))))
    found = F.when(F.size(found) > 0, found).otherwise(F.array(height))
    rate = lambda q: q.cast("double") * q * width / height * multiplier
    rounded = (lambda q: F.ceil(rate(q) / step) * step) if step else (lambda q: F.ceil(rate(q)))
    return F.transform(
        found,
        lambda q: F.struct(q.alias("quality"), F.ceil(width / height * q).cast("int").alias("width"), rounded(q).cast("long").alias("bandwidth")),
    )


def segments(keyframes: Column, length: Column, most: float = 10.0) -> Column:
    """Array of (start, end) from sorted keyframes; greedy, a segment closes at the first keyframe over ``most`` seconds on."""
    seg = "array<struct<start:double,end:double>>"
    k = F.coalesce(keyframes, F.array().cast("array<double>"))
    whole = F.array(F.struct(F.lit(0.0).alias("start"), length.cast("double").alias("end")))
    start = F.struct(F.array().cast(seg).alias("out"), F.element_at(k, 1).alias("last"), F.lit(False).alias("emitted"))

    def step(acc: Column, x: Column) -> Column:
        far = x - acc["last"] > most
        more = F.when(far, F.concat(acc["out"], F.array(F.struct(acc["last"].alias("start"), x.alias("end"))))).otherwise(acc["out"])
        return F.struct(more.alias("out"), F.when(far, x).otherwise(acc["last"]).alias("last"), far.alias("emitted"))

    def close(acc: Column) -> Column:
        end = F.array(F.struct(acc["last"].alias("start"), length.cast("double").alias("end")))
        return F.when(acc["emitted"], acc["out"]).otherwise(F.concat(acc["out"], end))

    folded = F.aggregate(F.slice(k, F.lit(2), F.greatest(F.size(k) - 1, F.lit(0))), start, step, close)
    lead = F.when(F.element_at(k, 1) != 0, F.array(F.struct(F.lit(0.0).alias("start"), F.element_at(k, 1).alias("end")))).otherwise(
        F.array().cast(seg),
    )
    return F.when((F.size(k) <= 1) | (length < most), whole.cast(seg)).otherwise(F.concat(lead.cast(seg), folded))


def needs_keyframes(segment_list: Column, cached: Column, stream: Column) -> Column:
    """No segments, and some stream quality isn't cached."""
    return (F.size(F.coalesce(segment_list, F.array())) == 0) & (F.size(F.array_except(stream, F.coalesce(cached, F.array().cast("array<int>")))) > 0)


def preview_sheet(length: Column, height: Column, seconds_per_frame: int = 10, most_height: int = 2160) -> Column:
    """Frames, columns and rows of a preview sheet."""
    count = F.greatest(F.lit(1), F.floor(length / seconds_per_frame)).cast("int")
    columns = F.ceil(count / (F.lit(most_height) / height)).cast("int")
    return F.struct(count.alias("count"), columns.alias("columns"), F.ceil(count / columns).cast("int").alias("rows"))


def top_labels(scores: Column, labels: Column, n: int = 5) -> Column:
    """Labels of the n highest scores, earlier ones first in ties."""
    zipped = F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"), F.get(labels, i).alias("label")))
    return F.transform(F.slice(F.array_sort(zipped), 1, n), lambda z: z["label"])


def multi_hot(tags: Column, vocabulary: list[str]) -> Column:
    """J8."""
    return F.transform(F.array(*[F.lit(v) for v in vocabulary]), lambda v: F.when(F.array_contains(tags, v), 1).otherwise(0))


def longest_segment(segment_list: Column) -> Column:
    """J9."""
    return F.ceil(F.array_max(F.transform(segment_list, lambda s: s["end"] - s["start"])))


class _Fold:
    """The greedy rule of segments() over keyframes that come one at a time."""

    def __init__(self, first: float, most: float):
        self.first, self.most = first, most
        self.last = self.now = first
        self.frames, self.n, self.longest, self.emitted = 1, 0, 0.0, False
        if first:
            self._emit(first)

    def _emit(self, length: float) -> None:
        self.n, self.longest = self.n + 1, max(self.longest, length)

    def add(self, at: float) -> None:
        self.frames, self.now, self.emitted = self.frames + 1, at, at - self.last > self.most
        if self.emitted:
            self._emit(at - self.last)
            self.last = at

    def close(self, length: float | None) -> tuple[int, int, float]:
        """(segments, longest in whole seconds, end)"""
        length = float(math.ceil(self.now + 1)) if length is None else length
        if self.frames <= 1 or length < self.most:
            return 1, math.ceil(length), length
        if not self.emitted:
            self._emit(length - self.last)
        return self.n, math.ceil(self.longest), self.last if self.emitted else length


def _summaries(most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold, length, done = None, None, None, []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(
                done,
                pa.schema([("id", pa.int64()), ("n", pa.int64()), ("longest", pa.int64()), ("end", pa.float64())]),
            )
            done.clear()
            return made

        def close() -> None:
            if fold is not None:
                done.append(dict(zip(("id", "n", "longest", "end"), (key, *fold.close(length)), strict=True)))

        for batch in batches:
            for i, at, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if fold is None or i != key:
                    close()
                    key, fold, length = i, _Fold(at, most), n
                else:
                    fold.add(at)
            if len(done) > 1000:
                yield out()
        close()
        yield out()

    return run


def segment_summary(keyframes: DataFrame, most: float = 10.0) -> DataFrame:
    """J4, J9 for keyframes that come as rows (id, at, length): (id, n, longest, end) per id.

    Rows are streamed in order, so a video with any number of keyframes takes constant
    memory. A null ``length`` is the whole second after the last keyframe.
    """
    rows = keyframes.select(F.col("id").cast("long"), F.col("at").cast("double"), F.col("length").cast("double")).filter("at is not null")
    return rows.repartition("id").sortWithinPartitions("id", "at").mapInArrow(_summaries(most), "id long, n long, longest long, end double")
