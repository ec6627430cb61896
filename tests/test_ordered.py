"""Stored orders against pages() and neighbours()."""

import pytest
from pyspark.sql import functions as F
from test_postings import _scanned

from lumenshelf.operators import ordered, search


@pytest.fixture(scope="module")
def media(spark):
    return spark.range(237).select(F.md5(F.col("id").cast("string")).alias("hash"), F.when(F.col("id") % 9 > 0, F.col("id") % 6).cast("int").alias("rating"))


@pytest.mark.parametrize(("size", "step"), [(15, 50), (50, 50), (7, 1000), (0, 50), (300, 40)])
def test_pages(spark, media, tmp_path, size, step):
    made = ordered.store(media, str(tmp_path / "o"), "rating", step=step, buckets=4)
    assert made == ordered.reopen(spark, made.root) and made.n == 237
    want = {}
    for r in search.pages(media, "rating", size).select("hash", "rating", "rank", "page").orderBy("rank").collect():
        want.setdefault(r["page"], []).append(tuple(r))
    last = max(want)
    for k in {0, 1, last // 2, last, last + 1}:
        assert [tuple(r) for r in made.page(size, k).select("hash", "rating", "rank", "page").collect()] == want.get(k, [])
    if 0 < size <= step:
        assert _scanned(made.page(size, last // 2))[0] <= 2


def test_neighbours(media, tmp_path):
    made = ordered.store(media, str(tmp_path / "o"), "rating", "ASC", step=30, buckets=4)
    want = {r["hash"]: (r["previous"], r["next"]) for r in search.neighbours(media, "rating", "ASC").collect()}
    first, last = (made.between(k, k + 1).first()["hash"] for k in (0, 236))
    for h in [first, last, *sorted(want)[:3]]:
        assert made.neighbours(h) == want[h]
    assert made.neighbours("none") is None


def test_empty_order(media, tmp_path):
    made = ordered.store(media.limit(0), str(tmp_path / "o"), "rating")
    assert made.n == 0 and made.page(15, 0).count() == 0 and made.neighbours("x") is None
