import random
import re
from itertools import combinations

import pytest

import odd
from fieldtrace.llm import near_dup as nd
from fieldtrace.llm.components import components


def shingles(text, width=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^ \t-\r]+", low)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, percent):
    """Union-find over all pairs; rows with the same id are one node, rows without id stand alone."""
    sets = [shingles(t) for _, t, *_ in rows]
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations(list(enumerate(sets)), 2):
        x, y = rows[i][0], rows[j][0]
        if x is not None and y is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
            parent[max(root(x), root(y))] = min(root(x), root(y))
    return sorted(
        ((r[0], len(s), None if r[0] is None else root(r[0]),
          r[0] is None or root(r[0]) == r[0]) for r, s in zip(rows, sets, strict=True)),
        key=repr,
    )


def got(found):
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("percent", [80, 85])
def test_odd_rows(spark, percent):
    assert got(nd.near_duplicates(odd.frame(spark), percent=percent)) == brute(odd.texts(), percent)


def variants():
    """A group whose members are linked by chains, one around a centre that is missing, copies, a passage
    that many texts share, and texts below the size of a sketch."""
    pick, rows = random.Random(4), []

    def edit(words, n):
        words = list(words)
        for at in pick.sample(range(len(words)), n):
            words[at] = f"e{pick.randrange(10**6)}"
        return words

    chain = odd.prose(1, 200).split()
    for _ in range(25):
        chain = edit(chain, 3)
        rows.append(" ".join(chain))
    centre = odd.prose(2, 150).split()
    rows += [" ".join(edit(centre, pick.randrange(1, 7))) for _ in range(80)]
    rows += [rows[30]] * 5
    passage = odd.prose(3, 60)
    rows += [passage + " " + odd.prose(100 + i, pick.randrange(5, 80)) for i in range(60)]
    short = odd.prose(4, 30).split()
    rows += [" ".join(short[: 30 - i]) for i in range(20)]
    pick.shuffle(rows)
    return [(i, t, "s") for i, t in enumerate(rows)]


@pytest.mark.parametrize("percent", [80, 85])
def test_no_link_is_lost(spark, percent):
    rows = variants()
    want = brute(rows, percent)
    assert got(nd.near_duplicates(odd.frame(spark, rows), percent=percent)) == want
    assert 5 < len({r[2] for r in want}) < len(rows)


@pytest.mark.parametrize("percent, small, large", [(85, 63, 74), (80, 63, 78), (80, 62, 77), (80, 52, 65)])
def test_partner_beyond_the_sketch(spark, percent, small, large):
    texts = [odd.prose(1000 + i, large + 4).split() for i in range(60)]
    rows = [(2 * i + j, " ".join(t[: n + 4]), "s") for i, t in enumerate(texts) for j, n in enumerate((small, large))]
    want = brute(rows, percent)
    assert len({r[2] for r in want}) == len(texts)
    assert got(nd.near_duplicates(odd.frame(spark, rows), percent=percent)) == want


def test_empty_table(spark):
    assert nd.near_duplicates(odd.empty(spark)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    by = {r.id: r.component for r in found.collect()}
    assert by == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert found.count() == len(by)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_least_overlap():
    assert 32 < nd.least_overlap(85) < 45 and nd.least_overlap(100) == nd.SKETCH
