import random
import re

import pytest

import odd
from fieldtrace.llm import mixing as mx


def test_targets_fill_up_to_the_limit():
    sources = [mx.Source(n, size, 1, w) for n, size, w in (("a", 10, 5), ("b", 100, 2), ("c", 1000, 1))]
    mx.targets(sources)
    assert [s.target for s in sources] == [30.0, 300.0, 780.0]
    empty = [mx.Source("a", 0, 3, 5.0), mx.Source("b", 40, 3, 2.0)]
    mx.targets(empty)
    assert [s.target for s in empty] == [0.0, 40.0]


def rows_(n=3000):
    pick = random.Random(3)
    names = ["hot"] * 12 + [None, "b", "c", "d", "é"]
    return [(i, odd.prose(i, int(pick.lognormvariate(4, 1))), pick.choice(names)) for i in range(n)]


@pytest.fixture(scope="module")
def mixture(spark):
    return mx.mixture(odd.frame(spark, rows_())).toPandas()


def test_sources_come_near_their_targets(mixture):
    words = (mixture["copies"] * mixture["size"]).groupby(mixture["source"].fillna("\0")).sum()
    targets = mixture["target"].groupby(mixture["source"].fillna("\0")).first()
    assert ((words - targets).abs() / targets).max() < 0.005
    assert mixture["copies"].max() <= 3 and (mixture["copies"] >= mixture["rate"] // 1).all()
    assert abs(targets.sum() - mixture["size"].sum()) < 1e-6 * targets.sum()


def test_rates_are_tilted_exponentially(mixture):
    """log(rate) / size is the same for all rows of a source below the limit: nothing else moves them."""
    import numpy as np

    inside = mixture[(mixture["size"] > 0) & (mixture["rate"] < 2.999)]
    tilt = np.log(inside["rate"]) / inside["size"]
    spread = tilt.groupby(inside["source"].fillna("\0")).agg(lambda x: x.max() - x.min())
    assert spread.max() < 1e-9


def test_reruns_agree(spark, mixture):
    again = mx.mixture(odd.frame(spark, rows_()).repartition(7)).toPandas()
    key = ["id", "salt"]
    assert again.sort_values(key)["copies"].tolist() == mixture.sort_values(key)["copies"].tolist()


def test_odd_rows(spark):
    docs = odd.frame(spark)
    found = mx.mixture(docs).collect()
    assert sum(r.m for r in found) == len(odd.texts())
    size = {t: len(re.findall(r"[^ \t-\r]+", t or "")) for _, t, _ in odd.texts()}
    assert sum(r["size"] * r.m for r in found) == sum(size[t] for _, t, _ in odd.texts())
    mixed = mx.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies * r.m for r in found)


def test_empty_table_and_tables_without_words(spark):
    assert mx.mixture(odd.empty(spark)).count() == 0 and mx.mix(odd.empty(spark)).count() == 0
    blank = odd.frame(spark, [(1, None, None), (2, "", "s")])
    assert [r.copies for r in mx.mixture(blank).collect()] == [1, 1]
