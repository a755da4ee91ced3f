import zlib

import numpy as np
import pytest

import odd
from fieldtrace.llm import quality_net as qn


def texts(n):
    good = [odd.prose(i, 20 + 7 * i % 600) for i in range(n)]
    junk = [" ".join(f"{w}&&&" if i % 2 else f"{w} {w} {w}" for w in odd.prose(i, 30).split()) for i in range(n)]
    bad = [odd.prose(n + i, 11 * i % 600) + " " + text for i, text in enumerate(junk)]
    return [t.encode() for t in good + bad], np.array([1] * n + [0] * n, dtype=np.float32)


@pytest.fixture(scope="module")
def net():
    return qn.learn(*texts(150), epochs=8)


def test_gradients():
    data, labels = texts(3)
    net = qn.Net.new()
    for part in net.parts():
        part += np.random.default_rng(1).standard_normal(part.shape).astype(np.float32) * 0.01
    net.bytes_[0] = 0

    def loss():
        p = np.clip(net.scores(data), 1e-9, 1 - 1e-9)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for part, grad in zip(net.parts(), net.gradients(data, labels), strict=True):
        flat, slope = part.reshape(-1), np.asarray(grad).reshape(-1)
        at = int(np.abs(slope).argmax())
        before = flat[at]
        flat[at] = before + 1e-2
        up = loss()
        flat[at] = before - 1e-2
        down = loss()
        flat[at] = before
        assert abs((up - down) / 2e-2 - slope[at]) < 0.1 * abs(slope[at]) + 1e-4


def test_scores_do_not_depend_on_the_batch(net):
    data, _ = texts(20)
    data += [b"", b"\0", b"x" * 100_000]
    alone = np.array([net.scores([t])[0] for t in data])
    assert np.allclose(net.scores(data), alone, atol=1e-5) and ((alone >= 0) & (alone <= 1)).all()


def test_whole_texts_count(net):
    """Junk far behind the start of a clean text is seen."""
    clean = odd.prose(1, 500)
    junk = clean + " " + " ".join(f"{w}&&&" for w in odd.prose(2, 40).split())
    scores = net.scores([clean.encode(), junk.encode()])
    assert scores[0] > 0.5 > scores[1]


def test_learned_on_part_right_on_the_rest(spark):
    data, labels = texts(200)
    docs = odd.frame(spark, [(i, t.decode(), "s") for i, t in enumerate(data)] + [(None, "x", "s"), (999, None, "s")])
    marks = [(i, int(x), 0) for i, x in enumerate(labels)] + [(0, 0, 0), (999, 1, 0), (None, 0, 1), (998, None, 0)]
    table = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    found = qn.classify(docs, qn.train(docs, table))
    assert "Score" in found.columns or "score" in found.columns
    by = {r.doc_id: r.score for r in found.select("doc_id", "score").collect()}
    held = [i for i in range(len(data)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean([(by[i] >= 0.5) == labels[i] for i in held]) > 0.95


def test_without_labels(spark):
    docs, none = odd.frame(spark), spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in qn.classify(docs, qn.train(docs, none)).select("score").collect()} == {0.5}
    assert qn.classify(odd.empty(spark), qn.train(odd.empty(spark), none)).count() == 0
