from __future__ import annotations

import random
import zlib

import numpy as np

from tidemark.llm import toxicity as tox

from .conftest import words


def test_windows_cover_every_word():
    for n in (0, 1, tox.WINDOW, tox.WINDOW + 1, 5 * tox.WINDOW + 7):
        spans = tox.windows(n)
        assert set().union(*(range(a, b) for a, b in spans)) == set(range(n))
        assert all(b - a <= tox.WINDOW for a, b in spans)
        assert all(y[0] - x[0] <= tox.STRIDE for x, y in zip(spans, spans[1:], strict=False))


def test_gradients_match_differences():
    net = tox.Network.new(hidden=3, width=4, seed=1)
    rng = np.random.default_rng(2)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x = rng.standard_normal((5, 4, 18))
    valid = np.array([[1, 1, 1, 1], [1, 1, 1, 0], [1, 1, 0, 0], [1, 1, 0, 0], [1, 0, 0, 0]], bool)
    y = np.array([1.0, 0.0, 1.0, 0.0])

    def loss():
        logits = tox._run(net, x, valid, False)[0].astype(float)
        return float(np.sum(np.logaddexp(0, logits) - y * logits))

    logits, made = tox._run(net, x, valid, True)
    g, d_x = tox._backward(net, x, valid, made, tox._sigmoid(logits) - y)
    step = 1e-2
    for name in ("gates_f", "state_b", "look", "ask", "out", "end"):
        p = net.p[name]
        at = tuple(rng.integers(0, s) for s in p.shape)
        p[at] += step
        up = loss()
        p[at] -= 2 * step
        down = loss()
        p[at] += step
        assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3, name
    for at in ((0, 0, 1), (2, 1, 10), (1, 2, 17)):
        x[at] += step
        up = loss()
        x[at] -= 2 * step
        down = loss()
        x[at] += step
        assert abs((up - down) / (2 * step) - d_x[at]) < 2e-3
    assert not d_x[4, 1:].any()  # padding gets no slope


def labelled(n: int, seed: int):
    rng = random.Random(seed)
    bad = ["gorpish", "vrenk", "zzulk"]
    rows, labels = [], []
    for i in range(n):
        text, toxic = words(rng, rng.randint(3, 150)), rng.random() < 0.4
        for _ in range(1 + len(text) // 40 if toxic else 0):
            text.insert(rng.randrange(len(text) + 1), rng.choice(bad) + rng.choice(["", "!", "s"]))
        rows.append((i, " ".join(text)))
        labels.append((i, None, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_independence(frame, text_spark):
    rows, labels = labelled(700, 1)
    got = tox.score(frame(rows), text_spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    truth = {i: y for i, _, y in labels}
    held = got[got.held_out]
    assert set(held.doc_id) == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.9
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()


def test_held_out_labels_change_nothing(frame, text_spark):
    rows, labels = labelled(60, 2)
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    schema = "doc_id long, quality int, toxic int"
    one, two = (tox.score(frame(rows), text_spark.createDataFrame(x, schema)).orderBy("doc_id").collect() for x in (labels, turned))
    assert one == two


def test_odd_rows(odd_docs, text_spark):
    labels = text_spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None), (7, 0)], "doc_id long, toxic int")
    got = tox.score(odd_docs, labels).toPandas()
    assert len(got) == odd_docs.count() and got.score.between(0, 1).all() and got.notna()[["held_out", "score", "predicted"]].all().all()
    assert tox.score(odd_docs.limit(0), labels).count() == 0
    unlabelled = tox.score(odd_docs, labels.limit(0)).toPandas()
    assert (unlabelled.predicted == 0).all() and unlabelled.score.nunique() == 1
    assert tox.drop_toxic(odd_docs, labels.limit(0)).columns == odd_docs.columns


def test_long_texts_score_alike_in_any_batch():
    net = tox.Network.new()
    table = tox.WordTable(lambda w: tox._projected(net, tox._vectors(net, tox.word_inputs(w))))
    text = words(random.Random(3), 500)
    places, spans = table.places(text), tox.windows(500)
    assert np.allclose(tox.window_logits(net, table.rows, places, spans, 3), tox.window_logits(net, table.rows, places, spans, 512), atol=1e-5)
