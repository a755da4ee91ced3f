import re
from collections import defaultdict

import pytest

import odd
from fieldtrace.llm import quality_rules as qr


def brute(text):
    text = text or ""
    words = re.findall(r"[^ \t-\r]+", text)
    places = defaultdict(list)
    for i in range(len(words) - 7):
        places[tuple(words[i : i + 8])].append(i)
    covered = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return (
        len(words), sum(map(len, words)), sum(c in qr.SYMBOLS for c in text), len(lines) - len(set(lines)),
        len(covered), len(lines), sum("A" <= c <= "Z" for c in text), again,
    )


def rows_():
    again = " ".join(["one two three four five six seven eight nine"] * 3)
    more = ["a b c d e f g h", "a b c d e f g h a b c d e f g h", again, "x " * 40, "x\nx\n y\n\n y \nx", "#$ *&|<>%"]
    good = [odd.prose(i, 120) for i in range(60)]
    bad = [" ".join(f"{w}&&&" for w in odd.prose(i, 90).split()) for i in range(8)] + [("Word " * 9 + "Next ") * 12] * 4
    return odd.texts() + [(500 + i, t, "s") for i, t in enumerate(more + good + bad)]


@pytest.fixture(scope="module")
def found(spark):
    return qr.judge(odd.frame(spark, rows_())).collect()


def test_counts(found):
    got = sorted(((r.doc_id, *[r[c] for c in qr.COUNTS]) for r in found), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t, _ in rows_()), key=repr)


def test_verdicts(found):
    by = {r.doc_id: r for r in found}
    assert all(by[506 + i].kept for i in range(60))
    assert not any(by[566 + i].kept for i in range(12))
    for r in found:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_posteriors_follow_the_fitted_rules(found):
    """The probabilities of the plan are those of the estimate on the driver."""
    votes = defaultdict(int)
    for r in found:
        votes[tuple(_votes(r))] += 1
    share, tables = qr.fit(sorted(votes.items()))
    for r in found:
        assert abs(r.p_good - qr.posterior(share, tables, _votes(r))) < 1e-9


def _votes(r):
    mean, bad = r.word_chars / max(r.n_words, 1), -1
    return [
        bad if r.n_words < 20 else int(r.n_words >= 50),
        bad * (100 * r.n_repeat_words > 30 * r.n_words),
        bad * (10 * r.n_again > r.n_words),
        bad if 100 * r.n_symbols > 4 * r.word_chars else int(200 * r.n_symbols <= r.word_chars),
        bad * (4 * r.n_symbols > r.n_words),
        bad * (10 * r.n_upper > 4 * r.word_chars),
        bad * (2 * r.n_dup_lines > r.n_lines),
        bad * (mean < 2 or mean > 15),
        bad if r.n_words < 2 * r.n_lines else int(r.n_words >= 4 * r.n_lines),
    ]


def test_estimate_finds_accurate_rules():
    """Two rules that agree outweigh one that speaks at random."""
    patterns = [((1, 1, 1), 430), ((1, 1, -1), 420), ((-1, -1, 1), 70), ((-1, -1, -1), 80)]
    share, tables = qr.fit(patterns)
    assert qr.posterior(share, tables, (1, 1, -1)) > 0.5 > qr.posterior(share, tables, (-1, -1, 1))


def test_empty_table_and_plan(spark):
    assert qr.judge(odd.empty(spark)).count() == 0
    plan = qr.judge(odd.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
