"""A training step of the attention model, against the plain formulas."""

from __future__ import annotations

import numpy as np

from netprism.llm import attention_lm as lm


def _case():
    rng = np.random.default_rng(5)
    n = lm.HEAD + 2 * lm.BINS + 1
    size = np.array([40, 3, 0, 90])
    x, y, _ = lm.windows(rng.integers(0, n, size.sum()).astype(np.int32), size, n)
    return lm.start_weights(n), np.log(rng.random((n + 2, n)) + 0.1).astype(np.float32), x, y


def test_sums_of_rows():
    rng = np.random.default_rng(1)
    at, x = rng.integers(0, 7, 300), rng.random((300, lm.WIDTH)).astype(np.float32)
    want = np.zeros((9, lm.WIDTH))
    for i, row in zip(at, x, strict=True):
        want[i] += row
    assert np.array_equal(lm._sums(at, x, 9), want)


def test_steps_follow_adam_and_leave_their_input():
    w, bigram, x, y = _case()
    kept = {k: v.copy() for k, v in w.items()}
    state = {}
    got = lm.descend(w, bigram, x, y, rate=0.02, batch=3, state=state)
    assert state["steps"] == -(-len(x) // 3) > 1
    assert all(np.array_equal(w[k], kept[k]) for k in w)
    want = {k: v.astype(np.float64) for k, v in kept.items()}
    first, second = ({k: np.zeros(v.shape) for k, v in w.items()} for _ in range(2))
    for step, i in enumerate(range(0, len(x), 3), 1):
        now = {k: v.astype(np.float32) for k, v in want.items()}
        g = lm.gradients(now, bigram, x[i:i + 3], y[i:i + 3])
        for k, v in want.items():
            at = g["rows"] if k in ("q", "k", "v") else slice(None)
            first[k][at] = 0.9 * first[k][at] + 0.1 * g[k]
            second[k][at] = 0.99 * second[k][at] + 0.01 * g[k].astype(np.float64) ** 2
            v[at] -= 0.02 / (1 - 0.9 ** step) * first[k][at] / (np.sqrt(second[k][at] / (1 - 0.99 ** step)) + 1e-6)
    for k in want:
        assert np.allclose(got[k], want[k], rtol=1e-2, atol=2e-3), k


def test_attention_equals_plain_softmax_for_small_and_large_logits():
    w, _, x, _ = _case()
    for scale in (1, 40):  # with large ones no exponential may overflow
        w |= {k: w[k] * np.float32(scale) for k in ("q", "k")}
        room = np.empty((len(x), lm.BLOCK, 2 * lm.BLOCK), np.float32)
        _, _, v, a, sums, h = lm.attend(w, x, room)
        assert a is room and np.isfinite(a).all()
        q, k = w["q"][x[:, lm.BLOCK:]].astype(np.float64), w["k"][x].astype(np.float64)
        logits = q @ k.transpose(0, 2, 1) / np.sqrt(lm.WIDTH) + w["r"][np.maximum(lm._DISTANCE, 0)]
        logits[:, lm._DISTANCE < 0] = -np.inf
        logits[x[:, 0] == len(w["q"]) - 1, :, :lm.BLOCK] = -np.inf
        want = np.exp(logits - logits.max(axis=2, keepdims=True))
        want /= want.sum(axis=2, keepdims=True)
        real = x[:, lm.BLOCK:] < len(w["q"]) - 1
        assert np.allclose((a / sums)[real], want[real], atol=2e-4)
        assert np.allclose(h[real], (want @ w["v"][x])[real], atol=2e-3)


def test_steps_in_parts_go_on_from_their_state():
    w, bigram, x, y = _case()
    state = lm.start_state(w)
    lm.steps(state, bigram, x[:3], y[:3], rate=0.02, batch=3)
    lm.steps(state, bigram, x[3:], y[3:], rate=0.02, batch=3)
    want = lm.descend(w, bigram, x, y, rate=0.02, batch=3)
    got = lm.weights_of(state)
    assert all(np.array_equal(got[k], want[k]) for k in w)


def test_windows_by_loops():
    rng = np.random.default_rng(8)
    size = np.array([0, 32, 1, 65, 0, 31, 64, 0])
    flat = rng.integers(0, 9, size.sum()).astype(np.int32)
    want, begin = [], 0
    for i, n in enumerate(size):
        s = flat[begin:begin + n].tolist()
        begin += n
        for lo in range(0, n, lm.BLOCK):
            before = [*([10] * lm.BLOCK), *([9, *s[:-1]]), *([10] * lm.BLOCK)][lo:lo + 2 * lm.BLOCK]
            want.append((before, [*s, *([-1] * lm.BLOCK)][lo:lo + lm.BLOCK], i))
    x, y, text = lm.windows(flat, size, 9)
    assert [(a.tolist(), b.tolist(), t) for a, b, t in zip(x, y, text, strict=True)] == want


def test_counting_up_repeated_places():
    table, at = np.zeros(7, np.int32), np.random.default_rng(3).integers(0, 6, 500).astype(np.int32)
    lm.count_up(table, at)
    assert np.array_equal(table, np.bincount(at, minlength=7)) and table.dtype == np.int32
