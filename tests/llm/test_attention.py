import sys
import tracemalloc

import numpy as np

from tessera.llm import attention as at


def model(k=10, seed=3):
    rng = np.random.default_rng(seed)
    b = rng.random((k, k)) + 0.1
    p = at.initial(np.log(b / b.sum(axis=1, keepdims=True)))
    p["out"] = rng.standard_normal(p["out"].shape).astype(np.float32) * 0.3
    return p


def test_each_place_is_scored_once_with_its_window():
    rng, p = np.random.default_rng(0), model()
    lengths = np.array([1, 5, 24, 25, 100, 3])
    n = int(lengths.sum())
    kinds, targets = rng.integers(0, 10, n), rng.integers(0, 10, n)
    got, begins = at.scores(p, kinds, targets, lengths, np.linspace(0.1, 1, 10))
    assert np.all((begins < 0) & (begins > np.log(0.1) - 1e-4))
    ends = np.cumsum(lengths)
    for lo, hi in zip(ends - lengths, ends):
        for i in range(lo, hi):
            begin = lo + (i - lo) // at.STRIDE * at.STRIDE - (at.WINDOW - at.STRIDE)
            ctx = np.arange(max(lo, begin), i + 1)
            x = p["embed"][kinds[ctx]] + p["place"][ctx - begin]
            q, k, v = np.split(x @ p["qkv"], 3, axis=1)
            a = np.exp(k @ q[-1] * at.WIDTH**-0.5)
            logits = (x[-1] + (a / a.sum()) @ v @ p["mix"]) @ p["out"] + p["bigrams"][kinds[i]]
            want = logits[targets[i]] - np.log(np.exp(logits).sum())
            assert abs(got[i] - want) < 1e-4


def test_gradients_match_differences():
    rng, p = np.random.default_rng(1), model()
    kinds = rng.integers(0, 10, (4, at.WINDOW))
    known = np.ones(kinds.shape, bool)
    known[0, :12] = known[1, 20:] = False
    want, valid = rng.integers(0, 10, (4, at.STRIDE)), known[:, at.WINDOW - at.STRIDE :]
    _, g = at.gradients(p, kinds, known, want, valid)
    for name in at.LEARNED:
        for _ in range(6):
            spot = tuple(int(rng.integers(0, s)) for s in p[name].shape)
            both = []
            for step in (1e-2, -1e-2):
                other = dict(p)
                other[name] = p[name].copy()
                other[name][spot] += step
                both.append(at.gradients(other, kinds, known, want, valid)[0])
            assert abs((both[0] - both[1]) / 2e-2 - g[name][spot]) < 2e-3, name


def test_training_lowers_the_loss():
    rng = np.random.default_rng(2)
    seq = np.concatenate([rng.integers(0, 5, 100) + 5 * (k % 2) for k in range(200)])  # each text in one of two languages
    kinds, targets, lengths = seq, np.roll(seq, -1), np.full(200, 100)
    p = at.initial(np.full((10, 10), -np.log(10)))
    q, losses = at.trained(p, kinds, targets, lengths, rate=0.02, batch=16)
    assert losses[-1] < losses[0] - 0.3
    assert at.scores(q, kinds, targets, lengths, np.ones(10))[0].mean() > at.scores(p, kinds, targets, lengths, np.ones(10))[0].mean() + 0.3
    assert np.allclose(at.vector(at.from_vector(at.vector(q), q)), at.vector(q))


def test_batches_share_their_arrays():
    """No array of logits' size is made anew for a batch, and a batch's results stay as they are when the next one comes."""
    rng, p = np.random.default_rng(5), model(at.CLASSES)
    kinds, want = rng.integers(0, at.CLASSES, (128, at.WINDOW)), rng.integers(0, at.CLASSES, (128, at.STRIDE))
    known, valid = np.ones(kinds.shape, bool), np.ones(want.shape, bool)
    loss, g = at.gradients(p, kinds, known, want, valid)
    first = {k: x.copy() for k, x in g.items()}
    tracemalloc.start()
    try:
        at.gradients(p, kinds[::-1], known, want, valid)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 128 * at.STRIDE * at.CLASSES * 4
    assert all(np.array_equal(g[k], first[k]) for k in first)
    again = at.gradients(p, kinds, known, want, valid)
    assert again[0] == loss and all(np.array_equal(again[1][k], first[k]) for k in first)
    few = at.gradients(p, kinds[:3], known[:3], want[:3], valid[:3])[0]
    assert np.isfinite(few)


def test_bound_of_the_logits():
    """Logits that may be far from 0 are looked at."""
    p = model()
    kinds, known = np.zeros((2, at.WINDOW), np.int64), np.ones((2, at.WINDOW), bool)
    logits, (*_, u) = at.forward(p, kinds, known)
    assert at._narrow(p, u, logits)
    p["bigrams"] = p["bigrams"] - 100
    logits, (*_, u) = at.forward(p, kinds, known)
    assert not at._narrow(p, u, logits)


def test_exponentials(monkeypatch):
    """In place, with ONNX Runtime and without it."""
    x = np.concatenate([np.linspace(-80, 80, 20_001), [0, 1, -200]]).astype(np.float32)
    want = np.exp(x.astype(np.float64))
    for absent in (False, True):
        monkeypatch.setattr(at, "_run", [])
        if absent:
            monkeypatch.setitem(sys.modules, "onnxruntime", None)
        for some in (x, x[:7], x[:0], x):
            got = some.copy()
            assert at.exponentials(got) is got
            assert np.allclose(got, want[: len(some)], rtol=2e-6, atol=1e-37)


def test_training_is_the_same_without_onnx_runtime(monkeypatch):
    rng, p = np.random.default_rng(7), model()
    lengths = rng.integers(1, 90, 60)
    kinds, targets = rng.integers(0, 10, (2, int(lengths.sum())))
    got = []
    for absent in (False, True):
        monkeypatch.setattr(at, "_run", [])
        if absent:
            monkeypatch.setitem(sys.modules, "onnxruntime", None)
        q, losses = at.trained(p, kinds, targets, lengths, batch=16)
        got.append((at.vector(q), losses, at.scores(q, kinds, targets, lengths, np.linspace(0.1, 1, 10))[0]))
    assert all(np.allclose(x, y, atol=2e-3) for x, y in zip(*got))
    assert at.vector(p).tolist() == at.vector(model()).tolist()


def test_queries_keys_and_values_come_from_tables():
    """Of classes and places, so their products don't grow with the batch."""
    rng, p = np.random.default_rng(8), model()
    kinds = rng.integers(0, 10, (50, at.WINDOW))
    _, (q, k, v, *_) = at.forward(p, kinds, np.ones(kinds.shape, bool))
    x = p["embed"][kinds] + p["place"]
    want = np.split(x @ p["qkv"], 3, axis=2)
    assert np.allclose(q, want[0][:, at.WINDOW - at.STRIDE :] * at.WIDTH**-0.5, atol=1e-5)
    assert np.allclose(k, want[1], atol=1e-5) and np.allclose(v, want[2] @ p["mix"], atol=1e-5)
    t = at.tables(p)
    assert [len(y) for y in (*t.classes, *t.places)] == [10] * 3 + [at.WINDOW] * 3
