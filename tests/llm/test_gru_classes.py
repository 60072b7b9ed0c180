"""Classes of the recurrent model's output layer by frequency."""

import numpy as np

from tideline.llm import gru


def _model(vocab: int = 1_500):
    frequency = np.concatenate([[900_000, 20_000], 1_500_000 / np.arange(3, vocab + 1)])
    shape = gru.Shape.of(vocab, frequency)
    flat = gru.start(shape, frequency).astype(np.float64)
    flat += np.random.default_rng(5).standard_normal(len(flat)) * 0.1
    return frequency / frequency.sum(), shape, flat


def test_frequent_symbols_cost_fewer_logits_and_none_is_lost():
    for vocab in (1_500, 9_002, 70_000):
        share, shape, _ = _model(vocab)
        wide = np.diff(shape.edges)
        assert shape.edges[0] == 0 and shape.edges[-1] == vocab and (wide > 0).all()
        mine = shape.classes + share @ np.repeat(wide, wide)
        equal = gru.Shape.of(vocab)
        assert mine < 0.95 * (equal.classes + equal.width)
        assert wide[0] < 0.2 * wide.max()


def test_output_of_unequal_classes_against_plain_softmax():
    share, shape, flat = _model()
    p = gru.split(flat, shape)
    rng = np.random.default_rng(6)
    hs = np.tanh(rng.standard_normal((4_000, gru.HIDDEN)))  # several blocks, cut within classes
    target = np.append(rng.choice(shape.vocab, 3_998, p=share), [0, shape.vocab - 1])
    got, _ = gru.output(p, shape, hs, target)
    y = np.column_stack([hs, np.ones(len(hs))])
    for i in [*range(0, 4_000, 37), 3_998, 3_999]:
        k = int(np.searchsorted(shape.edges, target[i], side="right")) - 1
        want = 0.0
        for logits, at in ((y[i] @ p["cw"], k), (y[i] @ p["ww"][:, shape.edges[k] : shape.edges[k + 1]], target[i] - shape.edges[k])):
            want += logits[at] - np.log(np.exp(logits).sum())
        assert np.isclose(got[i], want, atol=1e-9)
    every, _ = gru.output(p, shape, np.repeat(hs[:1], shape.vocab, axis=0), np.arange(shape.vocab))
    assert np.isclose(np.exp(every).sum(), 1, atol=1e-9)


def test_gradient_of_unequal_classes():
    share, shape, flat = _model()
    rng = np.random.default_rng(7)
    hs, target = np.tanh(rng.standard_normal((2_000, gru.HIDDEN))), rng.choice(shape.vocab, 2_000, p=share)
    grad = np.zeros_like(flat)
    _, dh = gru.output(gru.split(flat, shape), shape, hs, target, gru.split(grad, shape))
    loss = lambda f, h: gru.output(gru.split(f, shape), shape, h, target)[0].sum()
    begin = len(flat) - (gru.HIDDEN + 1) * (shape.classes + shape.vocab)
    for k in rng.choice(np.arange(begin, len(flat)), 60, replace=False):
        step = np.zeros_like(flat)
        step[k] = 1e-4
        assert np.isclose(grad[k], -(loss(flat + step, hs) - loss(flat - step, hs)) / 2e-4, atol=1e-4, rtol=1e-4)
    for i, j in zip(rng.integers(0, 2_000, 20), rng.integers(0, gru.HIDDEN, 20), strict=True):
        step = np.zeros_like(hs)
        step[i, j] = 1e-4
        assert np.isclose(dh[i, j], -(loss(flat, hs + step) - loss(flat, hs - step)) / 2e-4, atol=1e-4, rtol=1e-4)


def test_optimiser_by_strides_is_plain_adam(monkeypatch):
    monkeypatch.setattr(gru, "STRIDE", 200)
    rng = np.random.default_rng(8)
    rows, rest = 30 * 3 * gru.HIDDEN, 1_111
    flat = rng.standard_normal(rows + rest).astype(np.float32)
    want, m, v = flat.astype(np.float64), np.zeros(rows + rest), np.zeros(rows + rest)
    adam = gru.Adam(len(flat), 0.01)
    for t in range(1, 4):
        g = rng.standard_normal(rows + rest).astype(np.float32)
        adam.step(flat, g[rows:].copy(), np.arange(30), g[:rows].reshape(30, -1).copy())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g.astype(np.float64) ** 2
        want -= 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    assert np.allclose(flat, want, atol=1e-5)
