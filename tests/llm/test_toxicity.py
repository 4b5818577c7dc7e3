"""The sentence model against plain loops, and what single words are worth."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from netprism.llm import toxicity


def plain_score(text, model):
    """The noisy-or of a text, sentence by sentence."""
    numbers, weights, bias, leak = model
    weight = dict(zip(numbers.tolist(), weights.tolist(), strict=True))
    stay = 1 - 1 / (1 + math.exp(-leak))
    for sentence in re.split(r"[.!?\n]", text):
        words = re.split(r"[\s\x01\"#$%&()*+,\-/:;<=>@\[\\\]^_`{|}~]+", re.sub("[A-Z]", lambda m: m[0].lower(), sentence))
        total, some = bias, False
        for w in [w.encode() for w in words if w]:
            some = True
            total += weight.get(zlib.crc32(w), 0.0)
            total += sum(weight.get(zlib.crc32(b"^" + w[:n]), 0.0) for n in (4, 5, 6) if len(w) >= n)
        if some:
            stay *= 1 - 1 / (1 + math.exp(-total))
    return 1 - stay


def sample(seed=3, n=1200):
    """(texts, toxic): toxic ones hold three of ten words that clean ones never have."""
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("stone", "river", "cloud", "field", "light") for b in range(60)]
    telling = ["vile", "nasty", "rotten", "awful", "filthy", "horrid", "wretch", "odious", "beastly", "foul"]
    texts, toxic = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(80)]
        bad = i % 4 == 0
        if bad:
            for w in rng.sample(telling, 3):
                words[rng.randrange(80)] = w
        texts.append(". ".join(" ".join(words[k:k + 10]) for k in range(0, 80, 10)))
        toxic.append(bad)
    return texts, np.array(toxic), telling, plain


def fitted(texts, toxic):
    table = toxicity._Features()
    return toxicity._fit([toxicity.bag(t.encode(), table) for t in texts], toxic, np.ones(len(texts)))


def test_every_telling_word_counts_alone():
    texts, toxic, telling, plain = sample()
    model = fitted(texts, toxic)
    rng = random.Random(9)
    for word in telling:
        clean = " ".join(rng.choice(plain) for _ in range(30)) + ". " + " ".join(rng.choice(plain) for _ in range(10))
        assert plain_score(clean, model) < 0.3
        assert plain_score(clean + " " + word + " here", model) >= 0.3, word


def test_score_is_the_noisy_or(spark):
    texts, toxic, telling, _ = sample()
    model = fitted(texts, toxic)
    odd = ["", "...!?", "Vile!", "river1 NASTY-foul, cloud2\nstone3\tstone4. vile", "é " * 300 + "odious", *texts[:40]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for r in toxicity.score(docs, model).collect():
        assert r["score"] == pytest.approx(plain_score(odd[r["doc_id"]], model), abs=1e-6)


def test_gradient_of_the_loss():
    rng = np.random.default_rng(2)
    words, sent, doc = rng.integers(0, 12, 200), rng.integers(0, 40, 200), np.sort(rng.integers(0, 15, 40))
    toxic, weight = rng.random(15) < 0.4, rng.random(15) + 0.5
    w, start, b, c = rng.normal(size=12), rng.normal(size=12), -1.0, -2.0

    def value(w, b, c):
        return toxicity.loss(w, b, c, words, sent, doc, toxic, weight, start, 0.01)

    _, by_w, by_b, by_c = value(w, b, c)
    step = 1e-6
    for i in range(12):
        up, down = w.copy(), w.copy()
        up[i] += step
        down[i] -= step
        assert by_w[i] == pytest.approx((value(up, b, c)[0] - value(down, b, c)[0]) / (2 * step), abs=1e-6)
    assert by_b == pytest.approx((value(w, b + step, c)[0] - value(w, b - step, c)[0]) / (2 * step), abs=1e-6)
    assert by_c == pytest.approx((value(w, b, c + step)[0] - value(w, b, c - step)[0]) / (2 * step), abs=1e-6)
    # by plain loops
    total = 0.0
    for d in range(15):
        stay = 1 - 1 / (1 + math.exp(-c))
        for s in np.flatnonzero(doc == d):
            stay *= 1 - 1 / (1 + math.exp(-(b + sum(w[k] for k, at in zip(words, sent, strict=True) if at == s))))
        total -= weight[d] * math.log(1 - stay if toxic[d] else stay)
    assert value(w, b, c)[0] == pytest.approx(total / weight.sum() + 0.005 * ((w - start) ** 2).sum())


def test_evidence():
    toxic = np.array([True] * 100 + [False] * 100)
    got = toxicity.evidence(np.array([[0, 0, 30, 90], [60, 4, 60, 4]]), toxic, 1.5)
    assert got[0] > got[2] > 0 and got[3] == 0 and got[1] < 1.0
    # of none seen, at most about 2.7 are expected; of 60, at least about 49
    assert got[0] == pytest.approx(math.log(49 / 2.7), abs=0.05)
