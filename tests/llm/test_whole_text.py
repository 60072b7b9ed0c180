"""Text operators do the whole job: what they learn grows with the input."""

import random

import numpy as np

from tideline.llm import gru, lm, toxicity


def test_recurrent_vocabulary_grows_with_the_tokens(spark, monkeypatch):
    monkeypatch.setattr(lm, "VOCABULARY", 4)
    rng = random.Random(2)
    rows = [(i % 4, i, i == 0, " ".join(f"w{min(int(rng.expovariate(0.05)), 90)}" for _ in range(60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "chunk int, id long, held boolean, text string")
    n, distinct, hashes, frequency = lm.vocabulary(lm.counts(docs))
    assert n == 39 * 61 and len(hashes) == len(frequency) == int(np.sqrt(n)) == 48 < distinct
    words = {}
    for _, _, held, text in rows:
        for w in [] if held else text.split(" "):
            words[w] = words.get(w, 0) + 1
    assert frequency.tolist() == sorted(words.values(), reverse=True)[:48]


def test_recurrent_model_is_no_smaller_than_it_was():
    assert gru.HIDDEN >= 24 and lm.vocabulary_size(0) >= 2_046
    assert lm.vocabulary_size(10**8) > 2 * lm.vocabulary_size(10**7)


def test_gradients_of_symbols_beyond_16_bits():
    shape = gru.Shape.of(70_000)
    p = gru.split(gru.start(shape, np.ones(70_000)), shape)
    grad = np.zeros(sum(int(np.prod(s)) for _, s in shape.sizes()), np.float32)
    before = np.tile(np.array([[5], [5 + 65_536]], np.int32), (gru.STEPS // 2, 8))
    first, h = np.zeros(before.shape, bool), np.zeros((8, gru.HIDDEN), np.float32)
    hs, _, tape = gru.forward(p, before, first, h, True)
    gru.backward(p, before, first, tape, np.ones_like(hs), gru.split(grad, shape))
    got = gru.split(grad, shape)["x"]
    one = np.zeros_like(grad)
    for k in range(8):  # a stream at a time
        hs, _, tape = gru.forward(p, before[:, k : k + 1], first[:, :1], h[:1], True)
        for at in (5, 5 + 65_536):
            part = np.zeros_like(grad)
            gru.backward(p, np.where(before[:, k : k + 1] == at, at, 9), first[:, :1], tape, np.ones_like(hs), gru.split(part, shape))
            gru.split(one, shape)["x"][at] += gru.split(part, shape)["x"][at]
    want = gru.split(one, shape)["x"]
    assert np.allclose(got[[5, 5 + 65_536]], want[[5, 5 + 65_536]], rtol=1e-3, atol=1e-4) and np.abs(want[5]).max() > 0


def test_whole_word_leaves_longer_words_to_be_chosen():
    rows = [["scum"]] * 30 + [["scumbag"]] * 10
    pure = {"scum$", "scumbag$"}
    held = [[toxicity.terms_of({w}) & pure for w in words] for words in rows]
    terms, purity = toxicity._choose(held, dict.fromkeys(pure, 0.9))
    assert terms == ["scum$", "scumbag$"] and toxicity.Model(terms, purity).score("you scumbag there") > 0.5


def test_stem_settles_its_words():
    held = [[toxicity.terms_of({"scumbag"})], [toxicity.terms_of({"scummy"})]] * 20
    terms, _ = toxicity._choose(held, {x: 0.9 for row in held for g in row for x in g})
    assert terms == ["scum"]
