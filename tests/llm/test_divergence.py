import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import odd
from fieldtrace.llm import divergence as dv

A_Z = {i: i + 32 for i in range(65, 91)}


def brute(rows, min_docs=3, top=200):
    """The definition, by plain Python integers; rows are (text, lang, source)."""
    rows = [(t or "", la or "", s or "") for t, la, s in rows]
    counts, in_docs = defaultdict(Counter), Counter()
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(A_Z))
        counts[lang, source].update(terms)
        in_docs.update((lang, t) for t in set(terms))
    found = []
    for lang in {r[1] for r in rows}:
        kept = [t for (la, t), n in in_docs.items() if la == lang and n >= min_docs]
        whole = Counter()
        groups = {s: c for (la, s), c in counts.items() if la == lang}
        for c in groups.values():
            whole.update(c)

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        q = shares(whole)
        for source, c in groups.items():
            p = shares(c)
            pairs = []
            for other, d in groups.items():
                r = shares(d)
                if other != source:
                    pairs.append((-sum((p[t] - r[t]) ** 2 // r[t] for t in kept), other.encode()))
            terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if c[t] and p[t] > q[t]]
            for part, listed in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                found += [(lang, source, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(listed)]
    return sorted(found)


def audited(df, **kw):
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in dv.audit(df, **kw).select(*columns).collect())


def test_against_brute_force_with_odd_rows(spark):
    rows = [(t, "en" if i is None or i % 3 else None, s) for i, t, s in odd.texts()]
    rows += [("Ünï ÜNÏ x\x7fy z[z \xa0\x85 ﬁ", "xx", s) for s in ("b", "a", "é", "")] + [("alone", "yy", "s")] * 2
    full = [(1, t, la, s, 0, 0.5, "x", "y", "z", "w", 1) for t, la, s in rows]
    df = spark.createDataFrame(full, odd.SCHEMA)
    want = brute(rows)
    assert len({r[:3] for r in want}) > 10
    assert audited(df) == want
    # Many buckets and slices give the same.
    assert audited(df, bucket_terms=7, slice_sources=2) == want
    assert audited(df, top=3) == brute(rows, top=3)


def test_empty_table(spark):
    assert audited(odd.empty(spark)) == []


def test_group_names_with_dots(spark):
    df = spark.createDataFrame([("a b", "x", "y")] * 3 + [("a a", "x", "z")], "`t.t` string, `l.l` string, `s.s` string")
    got = audited(df, text_col="t.t", lang_col="l.l", source_col="s.s")
    assert got == brute([("a b", "x", "y")] * 3 + [("a a", "x", "z")])


@pytest.mark.parametrize("total", [1, 7, 10**9, 10**15])
def test_proportions_are_exact(total):
    counts = np.array([0, 1, 5, 10**6, 10**14])
    counts = counts[counts < total]
    assert dv.proportion(counts, total).tolist() == [1 + 10**9 * (c + 1) // total for c in counts.tolist()]


def test_equal_subtrees_are_one_node():
    forest = dv.Forest(np.array([[1, 2, 1, 2, 0, 0, 0, 0], [0, 0, 0, 0, 1, 2, 1, 2]]))
    # Two leaf pairs (1, 2) and (0, 0); two halves of them; two roots.
    assert [len(c) for c in forest.children] == [2, 2, 2]
    same = dv.Forest(np.array([[3, 4, 5, 6], [3, 4, 5, 6]]))
    assert same.roots[0] == same.roots[1]


def test_equal_node_pairs_are_priced_once():
    counts = np.zeros((2, 1024), dtype=np.int64)
    counts[0, 5] = 9
    _, _, leaves = dv.priced(dv.Forest(counts), np.array([0]), np.array([1]), [1033, 1024])
    assert len(leaves[0]) == 2  # (9, 0) and (0, 0)


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 6), st.integers(0, 5), st.integers(0, 1 << 30))
def test_prices(trees, height, seed):
    pick = np.random.default_rng(seed)
    counts = pick.integers(0, 4, (trees, 1 << height))
    counts[:, pick.integers(0, 1 << height) :] = dv.ABSENT
    totals = [int(c[c > 0].sum()) + (1 << height) for c in counts]
    a, b = pick.integers(0, trees, 9), pick.integers(0, trees, 9)
    ab, ba, _ = dv.priced(dv.Forest(counts), a, b, totals)
    for x, y, got, back in zip(a, b, ab, ba, strict=True):
        p, q = ([1 + 10**9 * (int(c) + 1) // totals[t] if c >= 0 else 1 for c in counts[t]] for t in (x, y))
        assert got == sum((i - j) ** 2 // j for i, j in zip(p, q, strict=True))
        assert back == sum((i - j) ** 2 // i for i, j in zip(p, q, strict=True))
